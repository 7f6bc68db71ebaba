"""Ranked lexical search by pipelined term partitioning.

Terms are owned by the stages of a pipeline: ``RARITY`` cuts them by the share of documents that hold them, the rarest first.
A bundle of items travels from owner to owner and carries a sparse accumulator, the scores so far of the documents that any
of its terms touched. At a stage the accumulators of a block of documents meet, by cogroup, the owner's postings of that
block, and whole-number contributions are added. Frequent terms touch nearly every document, so they come last: only then
are accumulators dense, and there the best ``top`` documents per item and block are chosen at once, before anything travels.

Texts are read once: a task turns each batch of documents into one index row (a block) with the postings of the terms that
some item asks for, the length of each document, and document frequencies, which are added up over all blocks. A posting list
is spread over the blocks of its documents, so a word that every document holds is many small pieces. Accumulators are
exact: none is dropped, and every document with a score above 0 takes part in the selection.

Items are dealt to bundles of about ``BUNDLE_BYTES`` of text by hash; the terms of one bundle are what is broadcast. Larger
item tables take several passes over the documents, one per bundle.

Defined cases: a null text has no terms; rows of one item id count as one item with the terms of all; a null item id is an
item and a null document id a document, ordered before the others; repeated document rows are documents of their own; extra
columns are ignored; an empty table has no result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumetrics.llm.common import prepare
from albumetrics.sources.workspace import Scratch

TOP = 50
BUNDLE_BYTES = 8 << 20
#: Terms in at most this share of the documents belong to the owner of that place; all others to one more owner.
RARITY = (0.001, 0.01, 0.1)
# Texts are cut into words a stretch of this many bytes at a time.
STRETCH = 1 << 20

# In UTF-8 every byte of a character beyond ASCII is above 0x7F, so words are found byte by byte.
_WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
_FOLD = bytes(b if b in _WORD_BYTES else 0x20 for b in bytes(range(256)).lower())


def stretches(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, a bounded stretch at a time."""
    folded = text.translate(_FOLD)
    start = 0
    while start < len(folded):
        end = start + STRETCH
        if end < len(folded):
            cut = folded.find(b" ", end)
            end = len(folded) if cut < 0 else cut
        yield folded[start:end].split()
        start = end


INDEX_DDL = ("block long, docs long, words long, doc_ids array<long>, lengths array<long>, terms array<int>, at array<int>, "
             "tf array<long>, seen array<int>, df array<long>")


def _index_batches(vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = vocabulary.value
    part, names = TaskContext.get().partitionId(), [c.split()[0] for c in INDEX_DDL.split(", ")]
    for count, batch in enumerate(batches):
        if batch.num_rows == 0:
            continue
        lengths, terms, at, tf = [], [], [], []
        for place, text in enumerate(batch.column(1).to_pylist()):
            found: Counter = Counter()
            length = 0
            for words in stretches(text or b""):
                length += len(words)
                found.update(map(numbers.get, words))
            found.pop(None, None)
            lengths.append(length)
            terms.extend(found.keys())
            tf.extend(found.values())
            at.extend([place] * len(found))
        df = np.bincount(np.asarray(terms, np.int64), minlength=1)
        seen = np.flatnonzero(df)
        lists = (
            batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.int32()), pa.array(at, pa.int32()),
            pa.array(tf, pa.int64()), pa.array(seen.astype(np.int32)), pa.array(df[seen].astype(np.int64)))
        columns = [pa.array([v], pa.int64()) for v in ((part << 32) + count, sum(n > 0 for n in lengths), sum(lengths))]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists]
        yield pa.RecordBatch.from_arrays(columns, names)


class Bundle:
    """Items of one bundle: their ids, the terms they ask for, and per term the items that ask for it."""

    def __init__(self, rows: list[tuple[int | None, bytes]]):
        asked: dict[int | None, set[bytes]] = {}
        for item, text in rows:
            words = asked.setdefault(item, set())
            for part in stretches(text or b""):
                words.update(part)
        self.items = list(asked)
        self.numbers = {word: n for n, word in enumerate(sorted(set().union(*asked.values())))}
        self.terms = [np.array(sorted(self.numbers[w] for w in words), np.int64) for words in asked.values()]


class Owners:
    """What the stages need of the whole corpus: counts, and per term its weight and its owner."""

    def __init__(self, bundle: Bundle, docs: int, words: int, df: dict[int, int]):
        self.docs, self.words, self.asked = docs, words, bundle.terms
        size = len(bundle.numbers)
        counts = [df.get(t, 0) for t in range(size)]
        self.weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * c + 1))) for c in counts], np.int64)
        self.owner = np.searchsorted(np.array(RARITY) * max(docs, 1), np.array(counts, np.float64), side="left")


POSTINGS_DDL = "block long, terms array<int>, at array<int>, gain array<long>"


def _lists(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _postings_of(shared, stage: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of one owner, as whole-number contributions."""
    owners = shared.value
    for batch in batches:
        for row in range(batch.num_rows):
            terms = _lists(batch, "terms", row)
            mine = owners.owner[terms] == stage
            terms, at, tf = terms[mine], _lists(batch, "at", row)[mine], _lists(batch, "tf", row)[mine]
            if len(terms) == 0:
                continue
            lengths = _lists(batch, "lengths", row)
            m = 100 - 50 + (50 * lengths * owners.docs) // max(owners.words, 1)
            gain = owners.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[at]))
            order = np.argsort(terms, kind="stable")
            lists = [pa.array(terms[order], pa.int32()), pa.array(at[order], pa.int32()), pa.array(gain[order], pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("block").slice(row, 1), *(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists)],
                [c.split()[0] for c in POSTINGS_DDL.split(", ")])


BUNDLE_DDL = "block long, doc_ids array<long>, item array<int>, at array<int>, score array<long>"
CHOSEN_DDL = "item int, doc_id long, score long"


def _added(owners: Owners, left: pa.Table, right: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Per item of the bundle the scores of all documents of the block after this stage."""
    size = len(left.column("doc_ids")[0])
    held_item, held_at, held = (left.column(n)[0].values.to_numpy(zero_copy_only=False) for n in ("item", "at", "score"))
    bounds = np.searchsorted(held_item, np.arange(len(owners.asked) + 1))
    if right.num_rows:
        terms, at, gain = (right.column(n)[0].values.to_numpy(zero_copy_only=False) for n in ("terms", "at", "gain"))
    else:
        terms = at = gain = np.empty(0, np.int64)
    present, starts = np.unique(terms, return_index=True)
    ends = np.append(starts[1:], len(terms))
    for item, asked in enumerate(owners.asked):
        mine = slice(bounds[item], bounds[item + 1])
        places = np.searchsorted(present, asked)
        places = places[places < len(present)] if len(present) else places[:0]
        hits = places[np.isin(present[places], asked)] if len(places) else places
        if mine.start == mine.stop and len(hits) == 0:
            continue
        total = np.zeros(size, np.int64)
        total[held_at[mine]] = held[mine]
        for k in np.unique(hits):
            # A document occurs once in a term's postings.
            total[at[starts[k]:ends[k]]] += gain[starts[k]:ends[k]]
        yield item, total


def _carry(shared, left: pa.Table, right: pa.Table) -> pa.Table:
    """One stage: the bundle's accumulators of a block with this owner's contributions added."""
    items, ats, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for item, total in _added(shared.value, left, right):
        touched = np.flatnonzero(total)
        items.append(np.full(len(touched), item))
        ats.append(touched)
        scores.append(total[touched])
    lists = [
        pa.array(np.concatenate(items), pa.int32()), pa.array(np.concatenate(ats), pa.int32()),
        pa.array(np.concatenate(scores), pa.int64())]
    packed = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists]
    return pa.table([left.column("block"), left.column("doc_ids"), *packed], [c.split()[0] for c in BUNDLE_DDL.split(", ")])


def _choose(shared, top: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """The last stage: the best documents of the block per item."""
    ids = left.column("doc_ids")[0].values
    known, numbers = np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy(zero_copy_only=False)
    items, docs, scores = [], [], []
    for item, total in _added(shared.value, left, right):
        touched = np.flatnonzero(total > 0)
        if len(touched) > top:
            # All that tie with the last place stay for the ordering by id.
            least = np.partition(total[touched], len(touched) - top)[len(touched) - top]
            touched = touched[total[touched] >= least]
        best = touched[np.lexsort((numbers[touched], known[touched], -total[touched]))][:top]
        items.append(np.full(len(best), item))
        docs.append(best)
        scores.append(total[best])
    if not items:
        return pa.table([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())], ["item", "doc_id", "score"])
    return pa.table(
        [pa.array(np.concatenate(items), pa.int32()), ids.take(pa.array(np.concatenate(docs))),
         pa.array(np.concatenate(scores), pa.int64())], ["item", "doc_id", "score"])


def _search_bundle(texts: DataFrame, bundle: Bundle, top: int, scratch: Scratch) -> DataFrame:
    spark = texts.sparkSession
    context = spark.sparkContext
    index = scratch.table(texts.mapInArrow(partial(_index_batches, context.broadcast(bundle.numbers)), INDEX_DDL), "index")
    whole = index.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    # At most one row per term of the bundle.
    df = index.select(F.explode(F.arrays_zip("seen", "df")).alias("s")).groupBy("s.seen").agg(F.sum("s.df").alias("df"))
    counts = {r["seen"]: r["df"] for r in df.collect()}
    shared = context.broadcast(Owners(bundle, whole["docs"] or 0, whole["words"] or 0, counts))
    carried = index.select(
        "block", "doc_ids", F.expr("CAST(array() AS array<int>)").alias("item"), F.expr("CAST(array() AS array<int>)").alias("at"),
        F.expr("CAST(array() AS array<bigint>)").alias("score"))
    postings = index.select("block", "lengths", "terms", "at", "tf")
    for stage in range(len(RARITY) + 1):
        owned = postings.mapInArrow(partial(_postings_of, shared, stage), POSTINGS_DDL).groupBy("block")
        met = carried.groupBy("block").cogroup(owned)
        if stage < len(RARITY):
            carried = met.applyInArrow(lambda a, b: _carry(shared, a, b), BUNDLE_DDL)
        else:
            carried = met.applyInArrow(lambda a, b: _choose(shared, top, a, b), CHOSEN_DDL)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = carried.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(n, item) for n, item in enumerate(bundle.items)], "item int, item_id long")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, scratch: Scratch, top: int = TOP) -> DataFrame:
    """The ``top`` best documents of each item: item_id, rank, doc_id, score."""
    spark = prepare(docs.sparkSession)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.encode("text", "utf-8").alias("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "utf-8").alias("text"))
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    bundles = max(1, -(-size // BUNDLE_BYTES))
    place = F.pmod(F.xxhash64("item_id"), F.lit(bundles))
    results = None
    for number in range(bundles):
        # About BUNDLE_BYTES by construction, whatever the size of the table.
        rows = asked.filter(place == number).toArrow()
        if rows.num_rows == 0:
            continue
        bundle = Bundle(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())))
        found = _search_bundle(texts, bundle, top, scratch)
        found = scratch.table(found, f"bundle-{number}") if bundles > 1 else found
        results = found if results is None else results.unionByName(found)
    if results is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return results


def oracle(top: int = TOP) -> str:
    """The same ranking in SQL."""
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = f"unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '{word}')) AS term"
    return f"""WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
  held AS (SELECT r, doc_id, {terms} FROM numbered),
  sized AS (SELECT r, doc_id, count(*) AS n FROM held GROUP BY r, doc_id),
  whole AS (SELECT count(*) AS docs, sum(n) AS words FROM sized),
  asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {terms} FROM benchmark)),
  counted AS (SELECT r, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
  weighed AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM counted, whole GROUP BY term),
  gains AS (SELECT c.r, c.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words))) AS gain
    FROM counted c JOIN weighed USING (term) JOIN sized USING (r), whole),
  scored AS (SELECT item_id, r, CAST(sum(gain) AS BIGINT) AS score FROM asked JOIN gains USING (term) GROUP BY item_id, r HAVING sum(gain) > 0),
  ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS n
    FROM scored JOIN sized USING (r))
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM ranked WHERE n <= {top}"""
