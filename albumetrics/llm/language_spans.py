"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Learning. Character grams of one to four letters (with word ends) are counted per language over a bounded sample of
labelled documents (``TRAIN_DOCS`` per language, by a hash of the id, so copies of a run agree). Counts go to a table of
hashed grams. The share of each script in a language's letters is learned with them.

Labelling. A word's candidates are the languages that write in its script. Its score for a candidate is the sum of the
grams' log odds against the mean language, held within ``CLIP``. A path over the words pays ``SWITCH`` for every change
of language; the best path gives the spans. Most texts have one language: if no run of words gains more than half a
switch in any other language, the best path is the constant one (a region of m runs gains at most m halves and pays at
least m - 1 switches, or m where it borders the rest), so only the remaining texts need the full recursion.

Defined cases: a text that is null or has no letter gets ``und`` and score 0; with no labelled document at all every
text gets ``und``; ties between languages go to the alphabetically first; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetrics.llm.bpe_stream import char_class
from albumetrics.llm.common import by_slices, prepare, slices

#: Documents per language to learn from.
TRAIN_DOCS = 3000
BUCKETS = 1 << 16
LONGEST_GRAM = 4
CLIP = 6.0
SWITCH = 12.0
#: A script counts for a language from this share of its letters.
SCRIPT_SHARE = 0.01
NO_LANGUAGE = "und"

# First code points of Unicode blocks, and the script that starts there.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "cherokee"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"),
    (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0x10000, "other"),
    (0x20000, "han"), (0x40000, "other"),
]
_STARTS = np.array([s for s, _ in SCRIPTS], np.uint32)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])

_NARROW = re.compile(f"[{char_class('L', 0x100)}]+")
_WIDE = re.compile(f"[{char_class('L')}]+")
_BEYOND = re.compile("[^\\x00-\\xff]")


def word_pattern(text: str) -> re.Pattern:
    return _WIDE if _BEYOND.search(text) else _NARROW


class WordGrams:
    """Hashed grams of distinct words, all at once: for each gram its word and its bucket."""

    def __init__(self, words: list[str]):
        points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        space = points == 32
        word = np.cumsum(space) - 1
        self.lengths = np.array([len(w) for w in words], np.int64)
        first = np.flatnonzero(space)[:-1] + 1
        self.script = _SCRIPT_OF[np.searchsorted(_STARTS, points[first], side="right") - 1]
        self._letters, self._word = points[~space], word[~space]
        owners, buckets = [], []
        inner = np.zeros(len(points), bool)
        code = np.zeros(len(points), np.uint32)
        for n in range(1, LONGEST_GRAM + 1):
            size = len(points) - n + 1
            if size <= 0:
                break
            if n > 2:
                inner[:size] |= space[n - 2:n - 2 + size]
            code[:size] = (code[:size] * np.uint32(0x01000193)) ^ (points[n - 1:] * np.uint32(0x9E3779B1))
            keep = ~inner[:size]
            keep &= ~(space[:size] & space[n - 1:]) if n < 3 else True
            at = np.flatnonzero(keep)
            owners.append(word[at])
            buckets.append(((code[at] + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(16))
        self.owner = np.concatenate(owners)
        self.bucket = np.concatenate(buckets)


    def script_letters(self) -> np.ndarray:
        """Letters of each script in each word [words, scripts]; a word may mix scripts."""
        n = len(SCRIPT_NAMES)
        script = _SCRIPT_OF[np.searchsorted(_STARTS, self._letters, side="right") - 1]
        return np.bincount(self._word * n + script, minlength=len(self.lengths) * n).reshape(-1, n)


class _Numbers(dict):
    """Numbers keys in order of first use."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def distinct_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case words, the word at each place, and the first place of each text (one more at the end)."""
    index = _Numbers()
    places: list[int] = []
    borders = [0]
    for text in texts:
        low = text.lower()
        places.extend(map(index.__getitem__, word_pattern(low).findall(low)))
        borders.append(len(places))
    return list(index), np.array(places, np.int64), np.array(borders, np.int64)


def _count_languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        for langs, texts in slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for lang in set(langs):
                words, places, _ = distinct_words([t for k, t in zip(langs, texts) if k == lang])
                if not words:
                    continue
                found = WordGrams(words)
                often = np.bincount(places, minlength=len(words)).astype(np.float64)
                counts = np.bincount(found.bucket, weights=often[found.owner], minlength=BUCKETS)
                letters = np.bincount(found.script, weights=often * found.lengths, minlength=len(SCRIPT_NAMES))
                grams[lang] = grams.get(lang, 0) + counts
                scripts[lang] = scripts.get(lang, 0) + letters
    for lang in grams:
        yield pa.RecordBatch.from_pydict({
            "lang": [lang], "grams": [grams[lang].astype("<f8").tobytes()], "scripts": [scripts[lang].astype("<f8").tobytes()],
        })


class LanguageModel:
    """Log odds of hashed grams per language, and the languages of each script."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        n = len(self.languages)
        table = np.zeros((n, BUCKETS))
        self.allowed = np.zeros((len(SCRIPT_NAMES), n), bool)
        for k, lang in enumerate(self.languages):
            grams, letters = counts[lang]
            table[k] = np.log((grams + 0.5) / (grams.sum() + 0.5 * BUCKETS))
            self.allowed[:, k] = letters >= SCRIPT_SHARE * max(letters.sum(), 1)
        self.table = (table - table.mean(axis=0)).astype(np.float32) if n else table.astype(np.float32)

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores [words, languages] and the words' lengths; a language outside the word's script gets the least."""
        found = WordGrams(words)
        scores = np.stack([
            np.bincount(found.owner, weights=row[found.bucket], minlength=len(words)) for row in self.table
        ], axis=1)
        np.clip(scores, -CLIP, CLIP, out=scores)
        allowed = self.allowed[found.script]
        scores[~allowed & allowed.any(axis=1, keepdims=True)] = -CLIP
        # A script that no language was learned in says nothing.
        scores[~allowed.any(axis=1)] = 0
        return scores, found.lengths


def best_path(scores: np.ndarray) -> np.ndarray:
    """Viterbi: the language of each word on the best path; a tie keeps the language, then takes the first."""
    n, k = scores.shape
    back = np.empty((n, k), np.int32)
    best = scores[0].copy()
    stay = np.arange(k)
    for t in range(1, n):
        top = int(best.argmax())
        move = best[top] - SWITCH > best
        back[t] = np.where(move, top, stay)
        best = np.where(move, best[top] - SWITCH, best) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = int(best.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def constant_texts(scores: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's best single language, and whether that is surely the best path. Every text has a word."""
    starts, sizes = borders[:-1], np.diff(borders)
    sums = np.add.reduceat(scores, starts, axis=0)
    best = sums.argmax(axis=1)
    text = np.repeat(np.arange(len(starts)), sizes)
    gain = scores - scores[np.arange(len(scores)), best[text]][:, None]
    total = np.cumsum(gain, axis=0)
    before = total - gain
    # Steps down between texts keep one text's least sum out of the next.
    step = (np.abs(gain).max(axis=1).sum() + 1) * np.arange(len(starts))
    least = np.minimum.accumulate(before - step[text][:, None], axis=0) + step[text][:, None]
    most = np.maximum.reduceat((total - least).max(axis=1), starts)
    return best, most <= SWITCH / 2


class Labeller:
    def __init__(self, model: LanguageModel):
        self.model = model

    def paths(self, texts: list[str], split: tuple | None = None) -> Iterator[tuple[int, int | np.ndarray, np.ndarray] | None]:
        """Per text: the main language, one language or one per word, and word lengths; None without letters."""
        words, places, borders = split or distinct_words(texts)
        if not words or not self.model.languages:
            yield from (None for _ in texts)
            return
        scores, lengths = self.model.word_scores(words)
        full = np.flatnonzero(np.diff(borders))
        flat = scores[places]
        best, sure = constant_texts(flat, borders[np.append(full, len(texts))])
        settled = dict(zip(full.tolist(), zip(best.tolist(), sure.tolist())))
        for k in range(len(texts)):
            if k not in settled:
                yield None
                continue
            own = lengths[places[borders[k]:borders[k + 1]]]
            lang, constant = settled[k]
            if constant:
                yield lang, lang, own
            else:
                path = best_path(flat[borders[k]:borders[k + 1]])
                yield int(np.bincount(path, weights=own).argmax()), path, own

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language of most letters and its share of them."""
        names, shares = [], []
        for found in self.paths(texts):
            if found is None:
                names.append(NO_LANGUAGE)
                shares.append(0.0)
            else:
                lang, path, own = found
                names.append(self.model.languages[lang])
                shares.append(1.0 if isinstance(path, int) else float(own[path == lang].sum() / own.sum()))
        return names, shares

    def coverage(self, texts: list[str]) -> list[float]:
        """The largest share of a text's letters that lie in one language's words and in a script it was learned in."""
        words, places, borders = split = distinct_words(texts)
        known = WordGrams(words).script_letters() @ self.model.allowed.astype(np.int64) if words else None
        out = []
        for k, found in enumerate(self.paths(texts, split)):
            if found is None:
                out.append(0.0)
                continue
            _, path, own = found
            at = places[borders[k]:borders[k + 1]]
            covered = known[at, path].sum() if isinstance(path, int) else np.bincount(path, weights=known[at, path]).max()
            out.append(float(covered / own.sum()))
        return out

    def spans(self, texts: list[str]) -> list[list[dict]]:
        """Runs of one language as character ranges, from a first word's start to a last word's end."""
        out = []
        for text, found in zip(texts, self.paths(texts)):
            runs: list[dict] = []
            if found is not None:
                low = text.lower()
                # Lower case keeps the number of characters in nearly all texts; where it does not, spans refer to it.
                for k, match in enumerate(word_pattern(low).finditer(low)):
                    name = self.model.languages[found[1] if isinstance(found[1], int) else found[1][k]]
                    if runs and runs[-1]["lang"] == name:
                        runs[-1]["end"] = match.end()
                    else:
                        runs.append({"start": match.start(), "end": match.end(), "lang": name})
            out.append(runs)
        return out


def learn(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Learn from the labelled rows for which ``usable`` holds, at most about ``train_docs`` of each language."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"),
                       F.col(text_col).alias("text"), (F.lit(True) if usable is None else usable).alias("usable"))
    rows = rows.filter("usable and lang is not null and text is not null")
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not found:
        return LanguageModel({})
    share = F.lit(0.0)
    for lang, n in sorted(found.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, train_docs / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(draw < share).select("lang", "text").repartition(6)
    counted = sample.mapInArrow(_count_languages, "lang string, grams binary, scripts binary").collect()
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for row in counted:
        grams, letters = np.frombuffer(row["grams"], "<f8"), np.frombuffer(row["scripts"], "<f8")
        old = sums.get(row["lang"], (0, 0))
        sums[row["lang"]] = (old[0] + grams, old[1] + letters)
    return LanguageModel(sums)


def _predict_batch(model, ids: list, texts: list[str]) -> pa.RecordBatch:
    names, shares = Labeller(model.value).predict(texts)
    return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.string()), "lang_pred": names, "score": shares})


def _spans_batch(model, ids: list, texts: list[str]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    return pa.RecordBatch.from_pydict({
        "id": pa.array(ids, pa.string()), "spans": pa.array(Labeller(model.value).spans(texts), kind),
    })


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score``: one row per row of ``docs``. The model's size depends on languages only."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    out = _keyed(docs, id_col, text_col).mapInArrow(
        by_slices(partial(_predict_batch, shared)), "id string, lang_pred string, score double")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "lang_pred", "score")


def label_spans(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``spans``: the runs of one language in each text."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    out = _keyed(docs, id_col, text_col).mapInArrow(
        by_slices(partial(_spans_batch, shared)), "id string, spans array<struct<start:long,end:long,lang:string>>")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "spans")


def _keep_batch(model, least: float, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labeller = Labeller(model.value)
    for batch in batches:
        keep: list[bool] = []
        for _, texts in slices([None] * batch.num_rows, batch.column(at).to_pylist()):
            keep += [share > 0 and share >= least for share in labeller.coverage(texts)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which one language covers at least ``least`` of the letters; all columns stay.

    Letters of a script that the language was not learned in count as not covered.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_keep_batch, shared, least, docs.columns.index(text_col)), docs.schema)


