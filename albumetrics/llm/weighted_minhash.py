"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

1. Shingles of five words (lower case, letters and digits; shorter texts are one shingle) get 64-bit hashes from prefix
   sums over the bytes. Document frequencies of all shingles go to a count sketch of ``SKETCH`` counters: tasks add their
   documents up, the blocks are merged in two steps, and what chance puts into a counter (the mean) is taken off. The sum
   has a fixed size, so it can be broadcast. A shingle weighs ``(1 + ln tf) * (1 + IDF_SHARE * idf)`` with idf scaled to
   0..1, which keeps near copies near in large groups, whose common shingles are no longer rare.
2. Improved consistent weighted sampling draws ``BANDS * ROWS`` samples per document. Two documents agree in a sample
   with the probability of their weighted Jaccard similarity. Documents with the same words are one class from here on.
3. Documents that agree in all samples of a band share a bucket. Within a bucket similarities are estimated from the
   share of equal samples. A bucket gives a spanning forest of likely links (and a second, edge-disjoint one where the
   first is unsure) plus the strongest unsure links between its trees: about as many pairs as members, never all pairs.
   Buckets of more than ``BLOCK`` members are dealt to blocks by hash. Every two blocks meet with all their members; such
   a meeting adds links across the two blocks only where trees of their own links do not connect them already.
4. Each proposed pair is verified on the whole texts: weighted Jaccard similarity of at least ``LEAST``. Connected
   components of the verified links (large star, small star) are groups so far.
5. What the proposals left out is settled exactly: documents that proposals connect, but whose verification left more
   than one group, meet in pairs of blocks of ``BRIDGE_BLOCK``, each with its text once per pair of blocks. There every
   unsure or likely link between different groups is verified. Components of all links are the groups; a group is named
   by its least id.

Defined cases: documents without words (null, empty, signs only) are each a group of their own, as are rows with a null
id (named null); rows of one id count as one document, with its least text; ties go to the smaller id; empty tables give
no rows; other columns are left alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumetrics.llm.bpe_stream import char_class
from albumetrics.llm.common import mix, prepare, slices
from albumetrics.sources.workspace import Scratch, materialize

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 16, 5
SAMPLES = BANDS * ROWS
IDF_SHARE = 0.2
SKETCH = 1 << 20
SKETCH_BLOCK = 1 << 13
#: Rows of the table of random draws; shingles that share one tie, and ties fall by hash, so agreement stays unbiased.
DRAWS = 1 << 14
BLOCK = 1024
SURE, LIKELY, UNSURE = 0.92, 0.85, 0.66
#: Unsure links between two trees that are verified first; the others are left to ``bridges``.
FIRST = 4
BRIDGE_BLOCK = 256
#: Ids are sifted by this many marks before texts are joined by id.
MARKS = 1 << 20

_L1, _LN = (char_class("L", 0x100) + char_class("N", 0x100)), (char_class("L") + char_class("N"))
_NARROW, _WIDE = re.compile(f"[{_L1}]+"), re.compile(f"[{_LN}]+")
_BEYOND = re.compile("[^\\x00-\\xff]")
_PRIME = 0x100000001B3
_INVERSE = pow(_PRIME, -1, 1 << 64)


def plain_words(text: str) -> str:
    low = text.lower()
    return " ".join((_WIDE if _BEYOND.search(low) else _NARROW).findall(low))


class _Powers:
    """Powers of an odd number modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self._base, self._values = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self._values) < n:
            steps = np.full(max(n, 1 << 21), self._base, np.uint64)
            steps[0] = 1
            self._values = np.multiply.accumulate(steps)
        return self._values[:n]


_UP, _DOWN = _Powers(_PRIME), _Powers(_INVERSE)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of plain texts: number of the text, hash, and how often; sorted by text and hash."""
    data = np.frombuffer(("\n".join(texts) + "\n").encode(), np.uint8)
    line_end = data == 10
    gap = line_end | (data == 32)
    ends = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    line = np.cumsum(line_end) - line_end
    text = line[starts]
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    count = np.diff(np.concatenate([first, [len(text)]]))
    place = np.arange(len(text)) - np.repeat(first, count)
    size = np.repeat(count, count)
    begins = place <= np.maximum(size - WORDS, 0)
    at = np.flatnonzero(begins)
    last = at + np.minimum(size[at], WORDS) - 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * _UP.upto(len(data)))])
    hashes = mix((sums[ends[last]] - sums[starts[at]]) * _DOWN.upto(len(data))[starts[at]])
    owner = text[at]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]))
    often = np.diff(np.concatenate([new, [len(hashes)]]))
    return owner[new], hashes[new], often


# --- document frequencies -------------------------------------------------------------------------------------------

def _count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    counts, docs = np.zeros(SKETCH, np.int64), 0
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for _, part in slices(texts, texts):
            _, hashes, _ = shingles([plain_words(t) for t in part])
            counts += np.bincount((hashes % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
            docs += len(part)
    if docs:
        salt = TaskContext.get().partitionId() % 32
        for block, part in enumerate(counts.reshape(-1, SKETCH_BLOCK)):
            yield _sketch_row(block, salt, docs if block == 0 else 0, part)


def _sketch_row(block: int, salt: int, docs: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "block": pa.array([block], pa.int32()), "salt": pa.array([salt], pa.int32()), "docs": pa.array([docs], pa.int64()),
        "counts": [zlib.compress(counts.astype("<i8").tobytes(), 1)],
    })


_SKETCH_DDL = "block int, salt int, docs long, counts binary"


def _merge_counts(table: pa.Table) -> pa.Table:
    total = np.zeros(SKETCH_BLOCK, np.int64)
    for data in table.column("counts").to_pylist():
        total += np.frombuffer(zlib.decompress(data), "<i8")
    docs = sum(table.column("docs").to_pylist())
    return pa.Table.from_batches([_sketch_row(table.column("block")[0].as_py(), 0, docs, total)])


class Weights:
    """Inverse document frequencies of hashed shingles from the summed sketch."""

    def __init__(self, counts: np.ndarray, docs: int):
        found = np.maximum(counts - counts.mean(), 1.0)
        idf = np.clip(np.log((docs + 1) / np.minimum(found, docs + 1)) / np.log(docs + 2), 0, 1)
        self._factor = (1 + IDF_SHARE * idf).astype(np.float32)

    def of(self, hashes: np.ndarray, often: np.ndarray) -> np.ndarray:
        return (1 + np.log(often)) * self._factor[(hashes % np.uint64(SKETCH)).astype(np.int64)]


def learn_weights(docs: DataFrame, text_col: str = "text") -> Weights:
    """Document frequencies over all of ``docs``, as a sketch of fixed size."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text")).filter("text is not null")
    parts = rows.mapInArrow(_count_shingles, _SKETCH_DDL)
    merged = parts.groupBy("block", "salt").applyInArrow(_merge_counts, _SKETCH_DDL)
    merged = merged.groupBy("block").applyInArrow(_merge_counts, _SKETCH_DDL)
    counts, n = np.zeros((SKETCH // SKETCH_BLOCK, SKETCH_BLOCK), np.int64), 0
    for row in merged.collect():
        counts[row["block"]] = np.frombuffer(zlib.decompress(row["counts"]), "<i8")
        n += row["docs"]
    return Weights(counts.ravel(), n)


# --- samples --------------------------------------------------------------------------------------------------------

@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    random = np.random.default_rng(9)
    r = random.gamma(2, 1, (DRAWS, SAMPLES)).astype(np.float32)
    log_c = np.log(random.gamma(2, 1, (DRAWS, SAMPLES))).astype(np.float32)
    beta = random.random((DRAWS, SAMPLES)).astype(np.float32)
    return r, log_c, beta


def samples(hashes: np.ndarray, weights: np.ndarray, step: int = 2048) -> np.ndarray:
    """The consistent samples of one weighted set; ``hashes`` ascend, so a tie goes to the smaller hash."""
    r_all, c_all, b_all = _draws()
    best = np.full(SAMPLES, np.inf, np.float32)
    out = np.zeros(SAMPLES, np.uint64)
    for first in range(0, len(hashes), step):
        own = hashes[first:first + step]
        rows = (own >> np.uint64(40)) % np.uint64(DRAWS)
        rows = rows.astype(np.int64)
        r, beta = r_all[rows], b_all[rows]
        level = np.floor(np.log(weights[first:first + step]).astype(np.float32)[:, None] / r + beta)
        value = c_all[rows] - r * (level - beta) - r
        k = value.argmin(axis=0)
        columns = np.arange(SAMPLES)
        least = value[k, columns]
        better = least < best
        chosen = own[k] ^ (level[k, columns].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out[better] = chosen[better]
        best[better] = least[better]
    return mix(out)


def bands(drawn: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band is part of it."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for column in drawn.reshape(BANDS, ROWS).T:
        key = mix(key ^ column)
    return key


_SIGNED_DDL = "doc_id long, same binary, bands array<long>, drawn binary"


def _sign(weights, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    scale = weights.value
    for batch in batches:
        for ids, texts in slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            plain = [plain_words(t) for t in texts]
            owner, hashes, often = shingles(plain)
            weight = scale.of(hashes, often)
            edges = np.searchsorted(owner, np.arange(len(texts) + 1))
            out: tuple[list, list, list, list] = ([], [], [], [])
            for k, doc_id in enumerate(ids):
                if edges[k] == edges[k + 1]:
                    continue
                drawn = samples(hashes[edges[k]:edges[k + 1]], weight[edges[k]:edges[k + 1]])
                for column, value in zip(out, (
                    doc_id, hashlib.blake2b(plain[k].encode(), digest_size=16).digest(),
                    bands(drawn).astype(np.int64), (drawn & np.uint64(0xFFFF)).astype("<u2").tobytes(),
                )):
                    column.append(value)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(out[0], pa.int64()), "same": pa.array(out[1], pa.binary()),
                "bands": pa.array(out[2], pa.list_(pa.int64())), "drawn": pa.array(out[3], pa.binary()),
            })


# --- pairs within buckets -------------------------------------------------------------------------------------------

def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of edges (in their order) that join two trees, and the trees' roots."""
    parent, taken = list(range(n)), []
    roots = np.arange(n)
    first, step = 0, 4096
    while first < len(a) and len(taken) < n - 1:
        # Edges within a tree are passed over, more of them at once as trees grow.
        open_ = first + np.flatnonzero(roots[a[first:first + step]] != roots[b[first:first + step]])
        for k, x, y in zip(open_.tolist(), a[open_].tolist(), b[open_].tolist()):
            x, y = _root(parent, x), _root(parent, y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                taken.append(k)
        roots = np.array([_root(parent, x) for x in range(n)])
        first, step = first + step, step * 2
    return np.array(taken, np.int64), roots


def propose(drawn: np.ndarray, own: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of members to verify. ``own``: the members' blocks; where they are two, only pairs across them."""
    n = len(drawn)
    equal = np.zeros((n, n), np.uint8)
    for column in drawn.T:
        equal += column[:, None] == column[None, :]
    a, b = np.nonzero(np.triu(equal >= UNSURE * drawn.shape[1], 1))
    strength = equal[a, b] / np.float32(drawn.shape[1])
    across = np.ones(len(a), bool) if own is None or own.min() == own.max() else own[a] != own[b]
    # Likely links first; among them, those within a block, whose own proposals hold them already.
    likely = int((strength >= LIKELY).sum())
    order = np.lexsort((-strength, across & (strength >= LIKELY), strength < LIKELY))
    a, b, strength, across = a[order], b[order], strength[order], across[order]
    taken, roots = _forest(a[:likely], b[:likely], n)
    chosen = taken.tolist()
    # Where the forest rests on weaker links, a second one without its edges.
    if (strength[taken] < SURE).any():
        rest = np.setdiff1d(np.arange(likely), taken)
        again, _ = _forest(a[rest], b[rest], n)
        chosen += [int(rest[k]) for k in again if strength[rest[k]] < SURE]
    between: dict[tuple[int, int], int] = {}
    for k in (likely + np.flatnonzero(across[likely:] & (roots[a[likely:]] != roots[b[likely:]]))).tolist():
        u, v = int(roots[a[k]]), int(roots[b[k]])
        trees = (min(u, v), max(u, v))
        if between.get(trees, 0) < FIRST:
            between[trees] = between.get(trees, 0) + 1
            chosen.append(k)
    return sorted({(int(a[k]), int(b[k])) for k in chosen if across[k]})


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and block in; pairs out."""
    held: list[tuple[int, int, bytes]] = []
    key = None
    out: list[tuple[int, int]] = []

    def close() -> None:
        members = {doc: (own, drawn) for doc, own, drawn in held}
        if len(members) > 1:
            ids = sorted(members)
            pairs = propose(np.stack([np.frombuffer(members[i][1], "<u2") for i in ids]),
                            np.array([members[i][0] for i in ids]))
            out.extend((ids[x], ids[y]) for x, y in pairs)
        held.clear()

    def rows() -> pa.RecordBatch:
        columns = zip(*out) if out else ((), ())
        batch = pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(("a", "b"), columns)})
        out.clear()
        return batch

    for batch in batches:
        for bucket, block, *row in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if (bucket, block) != key:
                close()
            key = (bucket, block)
            held.append(tuple(row))
        yield rows()
    close()
    yield rows()


def candidate_pairs(classes: DataFrame, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` to verify. ``classes``: doc_id, bands, drawn; one row per different text."""
    rows = classes.select("doc_id", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    scratch = scratch or Scratch(classes.sparkSession, "minhash")
    live = scratch.table(rows.join(sizes, "key"), "buckets")
    drawn = scratch.table(classes.select("doc_id", "drawn").join(live.select("doc_id").distinct(), "doc_id"), "drawn")
    members = live.withColumn("n", F.ceil(F.col("n") / block).cast("long")).join(drawn, "doc_id")
    members = members.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("n")))
    # Every two blocks of a bucket meet in one group, which holds all members of both.
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    met = met.withColumn("block", F.least("own", "other") * F.col("n") + F.greatest("own", "other"))
    dealt = met.repartition("key", "block").sortWithinPartitions("key", "block")
    pairs = dealt.select("key", "block", "doc_id", "own", "drawn").mapInArrow(_bucket_pairs, "a long, b long")
    return pairs.distinct()


# --- verification and groups ----------------------------------------------------------------------------------------

def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets given as ascending hashes with weights."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    shared = np.minimum(x[1][i], y[1][j]).sum(dtype=np.float64)
    either = x[1].sum(dtype=np.float64) + y[1].sum(dtype=np.float64) - shared
    return float(shared / either) if either else 0.0


def _verify(weights, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scale = weights.value
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def weighed(doc: int, text: str) -> tuple[np.ndarray, np.ndarray]:
        if doc not in known:
            if len(known) >= 256:
                known.pop(next(iter(known)))
            _, hashes, often = shingles([plain_words(text)])
            known[doc] = (hashes, scale.of(hashes, often))
        return known[doc]

    for batch in batches:
        out = []
        for a, b, text_a, text_b in zip(*(batch.column(k).to_pylist() for k in range(4))):
            found = similarity(weighed(a, text_a), weighed(b, text_b))
            if found >= LEAST:
                out.append({"a": a, "b": b, "similarity": found})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())]))


#: A name that no table has.
_MARK = "_albumetrics_minhash_mark"


def _mark(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("long"), F.lit(3)), F.lit(MARKS))


def _marks(ids: DataFrame, column: str) -> DataFrame:
    """Marks of the ids: at most ``MARKS`` rows, so a broadcast. Texts without a mark need not travel to a join by id."""
    return F.broadcast(ids.select(_mark(column).alias(_MARK)).distinct())


def pair_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` of the documents in ``pairs``."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    near = docs.join(_marks(named, "doc_id"), _mark("doc_id") == F.col(_MARK), "left_semi")
    return near.join(named, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))


def verified_links(texts: DataFrame, pairs: DataFrame, weights: Weights) -> DataFrame:
    """``a``, ``b``, ``similarity`` of the pairs that reach ``LEAST``. ``texts``: doc_id, text; one row per document."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    both = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a").join(
        texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(partial(_verify, shared), "a long, b long, similarity double")


def _bridge_block(scale: Weights, rows: list[tuple]) -> Iterator[dict]:
    """Links between different groups among the (id, group, own block, samples, text) of two blocks, or of one."""
    drawn = np.stack([np.frombuffer(r[3], "<u2") for r in rows])
    equal = np.zeros((len(rows), len(rows)), np.uint8)
    for column in drawn.T:
        equal += column[:, None] == column[None, :]
    group, own = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    meet = np.triu(equal >= UNSURE * SAMPLES, 1) & (group[:, None] != group[None, :])
    if own.min() != own.max():
        meet &= own[:, None] != own[None, :]
    a, b = np.nonzero(meet)
    order = np.argsort(-equal[a, b].astype(int), kind="stable")
    sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    names = {g: k for k, g in enumerate(dict.fromkeys(r[1] for r in rows))}
    parent = list(range(len(names)))
    for x, y in zip(a[order].tolist(), b[order].tolist()):
        u, v = (_root(parent, names[rows[k][1]]) for k in (x, y))
        if u == v:
            continue
        for k in (x, y):
            if k not in sets:
                _, hashes, often = shingles([plain_words(rows[k][4])])
                sets[k] = (hashes, scale.of(hashes, often))
        found = similarity(sets[x], sets[y])
        if found >= LEAST:
            parent[max(u, v)] = min(u, v)
            yield {"a": min(rows[x][0], rows[y][0]), "b": max(rows[x][0], rows[y][0]), "similarity": found}


def _bridge(weights, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    key = None
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
    for batch in batches:
        for whole, block, *row in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if (whole, block) != key and held:
                yield pa.RecordBatch.from_pylist(list(_bridge_block(weights.value, held)), schema)
                held = []
            key = (whole, block)
            held.append(tuple(row))
    if held:
        yield pa.RecordBatch.from_pylist(list(_bridge_block(weights.value, held)), schema)


def bridges(texts: DataFrame, pairs: DataFrame, roots: DataFrame, drawn: DataFrame, weights: Weights,
            block: int = BRIDGE_BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """Verified links between documents that ``pairs`` connect and ``roots`` (doc_id, root) leave in different groups."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    scratch = scratch or Scratch(texts.sparkSession, "minhash")
    members = components(pairs, scratch).withColumnRenamed("root", "whole").join(roots, "doc_id", "left")
    members = scratch.table(members.select("whole", "doc_id", F.coalesce("root", "doc_id").alias("root")), "wholes")
    mixed = members.groupBy("whole").agg(
        F.ceil(F.count("*") / block).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")
    ).filter("low <> high").select("whole", "n")
    rows = members.join(mixed, "whole").withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("n")))
    rows = rows.join(drawn, "doc_id").join(texts, "doc_id")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.withColumn("block", F.least("own", "other") * F.col("n") + F.greatest("own", "other"))
    dealt = rows.repartition("whole", "block").sortWithinPartitions("whole", "block", "doc_id")
    return dealt.select("whole", "block", "doc_id", "root", "own", "drawn", "text").mapInArrow(
        partial(_bridge, shared), "a long, b long, similarity double")


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id``, ``root``: every linked id with the least id of its component (large star and small star in turn)."""
    scratch = scratch or Scratch(links.sparkSession, "minhash")
    edges = scratch.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.table(small, "edges")
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            break
        mark = seen
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.unionByName(roots).groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "doc_id")


def _one_text_each(named: DataFrame, signed: DataFrame, sign, scratch: Scratch) -> DataFrame:
    """``signed`` with one text per id: an id with several texts counts with the least of them."""
    digest = F.xxhash64("text")
    several = scratch.table(
        named.groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high")).filter("low <> high").select("doc_id"),
        "several")
    if several.isEmpty():
        return signed
    least = named.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    again = least.select("doc_id", "text").mapInArrow(sign, _SIGNED_DDL)
    return scratch.table(signed.join(several, "doc_id", "left_anti").unionByName(again), "documents")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``class_id``: one row per id; a class is named by its least id.

    An id with several texts is one document with the least of them. Tables made on the way are dropped.
    """
    spark: SparkSession = prepare(docs.sparkSession)
    scratch = Scratch(spark, "minhash")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    weights = learn_weights(rows)
    sign = partial(_sign, spark.sparkContext.broadcast(weights))
    named = rows.filter("doc_id is not null and text is not null")
    every = scratch.table(named.mapInArrow(sign, _SIGNED_DDL), "signed")
    signed = _one_text_each(named, every, sign, scratch)
    classes = scratch.table(signed.groupBy("same").agg(
        F.min("doc_id").alias("doc_id"), F.min_by(F.struct("bands", "drawn"), "doc_id").alias("x")
    ).select("same", "doc_id", "x.bands", "x.drawn"), "classes")
    pairs = scratch.table(candidate_pairs(classes, block, scratch), "pairs")
    texts = scratch.table(pair_texts(named, pairs), "texts")
    links = scratch.table(verified_links(texts, pairs, weights), "links")
    first = scratch.table(components(links, scratch), "roots")
    drawn = classes.select("doc_id", "drawn").join(texts.select("doc_id"), "doc_id", "left_semi")
    more = bridges(texts, pairs, first, drawn, weights, scratch=scratch)
    roots = components(links.unionByName(more), scratch)
    named_classes = classes.select("same", F.col("doc_id").alias("rep")).join(
        roots.withColumnRenamed("doc_id", "rep"), "rep", "left").select("same", F.coalesce("root", "rep").alias("class_id"))
    found = signed.select("doc_id", "same").join(named_classes, "same").select("doc_id", "class_id")
    ids = rows.select("doc_id").distinct()
    best = found.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return scratch.finish(
        ids.join(best, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names its group (and those with a null id); all columns stay."""
    found = groups(docs, id_col, text_col)
    copies = materialize(found.filter("class_id <> doc_id").select(F.col("doc_id").alias(id_col)), "minhash-copies")
    marks = _marks(copies, id_col)
    sure = docs.join(marks, _mark(id_col) == F.col(_MARK), "left_anti")
    rest = docs.join(marks, _mark(id_col) == F.col(_MARK), "left_semi").join(copies, id_col, "left_anti")
    return sure.unionByName(rest.select(docs.columns))
