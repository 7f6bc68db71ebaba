"""Toxicity scores: a learned lexicon, misspellings of it, and the context that parts quotation from abuse.

Learning. From a bounded sample of labelled documents (``TRAIN_DOCS`` per class, by a hash of the id) the words are
taken whose document frequency differs strongly between the classes. Those of the toxic class are the lexicon.

Matching. A Levenshtein automaton of a word (one edit; its states are two bit masks over the word's positions) walks the
trie of the lexicon; a branch ends when no state is left. Spellings with digits or signs for letters are read as letters
first, and runs of a letter are shortened. A word that clean documents use as well is no misspelling. An edit leaves one
half of a term whole, so words that share no half with a term of their length skip the walk. Words recur; results are
kept in a bounded memo.

Context. Around every hit a window of ``WINDOW`` words is scored: the share of its words that are hits, and whether quote
marks enclose the hit there. Quoted and unquoted hits are separate features, and their weights are learned, so that a
text that reports a term and a text that uses it can differ.

The document score is a logistic regression over those features. Labels, language, source and id are never inputs.

Defined cases: a null or empty text has no hit and gets the score of a text without any; rows without a label are
scored like others; a document with several labels counts as toxic if one says so; repeated rows give repeated results;
with no label of one class every score is that of an empty lexicon.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetrics.llm.bpe_stream import char_class
from albumetrics.llm.common import Memo, by_slices, class_draw, fit_logistic, logistic, prepare, slices

#: Labelled documents of each class to learn from.
TRAIN_DOCS = 8000
#: Terms with the strongest evidence that are kept.
LEAST_DOCS = 3
LEAST_LOG_ODDS = 3.0
#: Terms shorter than this have no misspellings.
LEAST_FUZZY = 5
WINDOW = 8

# Signs that stand for letters in disguised spellings.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")

_L1, _L = char_class("L", 0x100), char_class("L")
_WORDS_1 = re.compile(f"[{_L1}]+")
_WORDS = re.compile(f"[{_L}]+")
_DISGUISED_1 = re.compile(f"[{_L1}]+(?:[0-9@$!|*]+[{_L1}]+)+")
_DISGUISED = re.compile(f"[{_L}]+(?:[0-9@$!|*]+[{_L}]+)+")
_BEYOND = re.compile("[^\\x00-\\xff]")
_SIGNS = re.compile("[0-9@$!|*]")
_RUN = re.compile(r"(.)\1{2,}")
_MARKS = {'"': '"', "'": "'", "«": "»", "“": "”", "‘": "’", "„": "“", "‹": "›"}


def words_of(low: str) -> list[str]:
    """Runs of letters, then disguised spellings (letters with signs between them)."""
    wide = _BEYOND.search(low)
    found = (_WORDS if wide else _WORDS_1).findall(low)
    if _SIGNS.search(low):
        found += (_DISGUISED if wide else _DISGUISED_1).findall(low)
    return found


class Trie:
    """Terms by letter; a node is a dictionary of children, and its term (if one ends there) is under ''."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for term in terms:
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node[""] = term

    def within_one_edit(self, word: str) -> Iterator[str]:
        """Terms that the word's automaton accepts while it walks the trie."""
        masks: dict[str, int] = {}
        for k, letter in enumerate(word):
            masks[letter] = masks.get(letter, 0) | 1 << k
        accept = 1 << len(word)
        # Bit k of a mask: the first k letters of the word are read, with no error, or with one.
        stack = [(self.root, 1, 2)]
        while stack:
            node, clean, spent = stack.pop()
            for letter, child in node.items():
                if letter == "":
                    if (clean | spent) & accept:
                        yield child
                    continue
                mask = masks.get(letter, 0)
                next_clean = (clean & mask) << 1
                # Same letter; a letter of the term replaced or left out in the word; or one more in the word.
                next_spent = (spent & mask) << 1 | clean << 1 | clean | next_clean << 1
                if next_clean or next_spent:
                    stack.append((child, next_clean, next_spent & (accept << 1) - 1))


@dataclass
class Lexicon:
    weights: dict[str, float]
    established: frozenset[str] = frozenset()
    _trie: Trie | None = field(default=None, repr=False)

    def __post_init__(self):
        terms = [t for t in self.weights if len(t) >= LEAST_FUZZY]
        self._trie = Trie(terms)
        self._heads = {(len(t), t[:len(t) // 2]) for t in terms}
        self._tails = {(len(t), t[len(t) // 2:]) for t in terms}

    def _may_match(self, word: str) -> bool:
        for size in (len(word) - 1, len(word), len(word) + 1):
            half = size // 2
            if (size, word[:half]) in self._heads or (size, word[half - size:]) in self._tails:
                return True
        return False

    def near(self, word: str) -> str | None:
        """The term of most weight that is one edit away."""
        if len(word) < LEAST_FUZZY - 1 or not self._may_match(word):
            return None
        found = sorted(self._trie.within_one_edit(word), key=lambda t: (-self.weights[t], t))
        return found[0] if found else None

    def look_up(self, word: str) -> tuple[float, bool] | bool:
        """(weight, exact) of a hit; False for any other word."""
        weight = self.weights.get(word)
        if weight is not None:
            return weight, True
        for form in dict.fromkeys((word, word.translate(LOOKALIKES), _RUN.sub(r"\1", word.translate(LOOKALIKES)))):
            if form != word and form in self.weights:
                return self.weights[form], False
            if form not in self.established:
                term = self.near(form)
                if term is not None:
                    return self.weights[term], False
        return False


FEATURES = 7


def _in_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isalnum()


def _opens(text: str, at: int) -> bool:
    """Single marks also stand for letters left out: one opens only before a word and not after a letter."""
    return text[at] not in "'‘’" or (not _in_word(text, at - 1) and _in_word(text, at + 1))


def _closes(text: str, at: int) -> bool:
    return text[at] not in "'‘’" or (not _in_word(text, at + 1) and at > 0 and not text[at - 1].isspace())


def closing(text: str, start: int, end: int, mark: str) -> int:
    """The first place from ``start`` to ``end`` where the mark closes, or -1."""
    at = text.find(mark, start, end)
    while at >= 0 and not _closes(text, at):
        at = text.find(mark, at + 1, end)
    return at


def is_open(text: str, start: int, end: int, mark: str, other: str) -> bool:
    """Has a mark been opened between ``start`` and ``end`` that is not closed there?"""
    held = False
    for at in range(start, end):
        if held and text[at] == other and _closes(text, at):
            held = False
        elif not held and text[at] == mark and _opens(text, at):
            held = True
    return held


class Scorer:
    def __init__(self, lexicon: Lexicon, coefficients: np.ndarray | None = None):
        self._lexicon = lexicon
        self._memo = Memo(lexicon.look_up, 200_000)
        self.coefficients = coefficients

    def _quoted(self, text: str, start: int, end: int) -> bool:
        """A quote mark opens within the window before the hit, and the mark that goes with it closes within the one after."""
        reach = 8 * WINDOW
        first = max(text.rfind("\n", max(0, start - reach), start) + 1, start - reach, 0)
        last = text.find("\n", end, end + reach)
        last = min(len(text), end + reach) if last < 0 else last
        before = text[first:start]
        return any(
            mark in before and is_open(text, first, start, mark, other) and closing(text, end, last, other) >= 0
            for mark, other in _MARKS.items())

    def features(self, text: str) -> list[float]:
        low = text.lower()
        words = words_of(low)
        found = list(map(self._memo.__getitem__, words))
        if not any(found):
            return [0.0] * FEATURES
        hits = [(k, h) for k, h in enumerate(found) if h]
        exact = sum(h[1] for _, h in hits)
        evidence: dict[str, float] = {}
        crowd = 0.0
        for k, h in hits:
            evidence[words[k]] = max(evidence.get(words[k], 0.0), h[0] if h[1] else 0.5 * h[0])
            near = found[max(0, k - WINDOW):k + WINDOW + 1]
            crowd = max(crowd, sum(1 for x in near if x) / len(near))
        quoted = 0
        at = 0
        for k, _ in hits:
            start = low.find(words[k], at)
            if start < 0:
                start = low.find(words[k])
            quoted += self._quoted(low, start, start + len(words[k]))
            at = start + len(words[k])
        top = sorted(evidence.values(), reverse=True)
        return [
            math.log1p(exact), math.log1p(len(hits) - exact), math.log1p(quoted), math.log1p(len(evidence)),
            top[0], sum(top[:4]) / 4, crowd,
        ]

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(-1, FEATURES)
        return logistic(np.column_stack([np.ones(len(x)), x]) @ self.coefficients)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class per word."""
    for batch in batches:
        toxic = batch.column(0).to_pylist()
        for labels, texts in slices(toxic, batch.column(1).to_pylist(), 4 << 20):
            counts = (Counter(), Counter())
            for label, text in zip(labels, texts):
                counts[label].update(set(words_of(text.lower())))
            every = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_pydict({
                "word": pa.array(every, pa.string()),
                "clean": pa.array([counts[0][w] for w in every], pa.int64()),
                "toxic": pa.array([counts[1][w] for w in every], pa.int64()),
            })


def _near_forms(lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = lexicon.value
    for batch in batches:
        keep = [w not in own.weights and own.near(w) is not None for w in batch.column(0).to_pylist()]
        yield batch.filter(pa.array(keep, pa.bool_()))


def _sample_features(lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(lexicon.value)
    for batch in batches:
        rows = [scorer.features(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_pydict({
            "toxic": batch.column(0), "x": pa.array(rows, pa.list_(pa.float64())),
        })


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS,
          lexicon_terms: int | None = None) -> Scorer:
    """Learn lexicon and weights from the labels for which ``usable`` (a condition on ``id_col``) holds."""
    spark = prepare(docs.sparkSession)
    chosen = class_draw(labels, id_col, label_col, "toxic", usable, train_docs, seed=2)
    if chosen is None:
        return Scorer(Lexicon({}), np.array([-4.0] + [0.0] * FEATURES))
    # The chosen labels are bounded by ``train_docs`` per class, so they fit a broadcast.
    texts = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)
    # Copies of one text would lend its rare words false support.
    sample = texts.filter("text is not null").groupBy(F.xxhash64("text").alias("same")).agg(
        F.max("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text").repartition(6).cache()
    classes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = classes.get(0, 0), classes.get(1, 0)
    words = sample.mapInArrow(_word_counts, "word string, clean long, toxic long").groupBy("word").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    found = words.filter(F.col("toxic") >= max(LEAST_DOCS, toxic // 400)).select("word", odds.alias("odds")).filter(
        F.col("odds") >= LEAST_LOG_ODDS).orderBy(F.desc("odds"), "word")
    # Words of the chosen documents only, whose number is bounded.
    found = (found if lexicon_terms is None else found.limit(lexicon_terms)).collect()
    lexicon = Lexicon({r["word"]: float(r["odds"]) for r in found})
    shared = spark.sparkContext.broadcast(lexicon)
    common = words.filter(F.col("clean") > 0).select("word").mapInArrow(partial(_near_forms, shared), "word string")
    lexicon = Lexicon(lexicon.weights, frozenset(r["word"] for r in common.collect()))
    shared = spark.sparkContext.broadcast(lexicon)
    rows = sample.mapInArrow(partial(_sample_features, shared), "toxic int, x array<double>").collect()
    sample.unpersist()
    y = np.array([r["toxic"] for r in rows], float)
    x = np.column_stack([np.ones(len(rows)), np.array([r["x"] for r in rows])])
    return Scorer(lexicon, fit_logistic(x, y, np.ones(len(y))))


def _score_batch(model, ids: list, texts: list[str]) -> pa.RecordBatch:
    scores = _scorer(model).score(texts)
    return pa.RecordBatch.from_pydict({
        "id": pa.array(ids, pa.string()), "score": pa.array(scores, pa.float64()),
        "predicted": pa.array((scores >= 0.5).astype(np.int32), pa.int32()),
    })


_SCORERS: dict[str, Scorer] = {}


def _scorer(model) -> Scorer:
    """The scorer of a broadcast model, with its memo, once per Python worker."""
    key, lexicon, coefficients = model.value
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(lexicon, coefficients)
    return _SCORERS[key]


def _shared(spark, scorer: Scorer):
    """The broadcast model under a name of its own, by which Python workers tell models apart."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, scorer._lexicon, scorer.coefficients))


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score``, ``predicted``: one row per row of ``docs``."""
    spark = prepare(docs.sparkSession)
    shared = _shared(spark, scorer)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(by_slices(partial(_score_batch, shared)), "id string, score double, predicted int")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "score", "predicted")


def _keep_batch(model, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scorer = _scorer(model)
    for batch in batches:
        keep: list[bool] = []
        for _, texts in slices([None] * batch.num_rows, batch.column(at).to_pylist()):
            keep += (scorer.score(texts) < 0.5).tolist()
        yield batch.filter(pa.array(keep, pa.bool_()))


def keep_clean(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; all columns stay."""
    spark = prepare(docs.sparkSession)
    shared = _shared(spark, scorer)
    return docs.mapInArrow(partial(_keep_batch, shared, docs.columns.index(text_col)), docs.schema)
