"""Quality scores by co-training: a text-content view and a page-metadata view teach each other.

The text view sees words: how many differ, repeat the word before, are in capitals, are letters only, how long they are.
The metadata view sees no word: size and shape of the page (characters, lines), shares of classes of signs, declared
language and source (hashed). Each view has a ridge-penalised logistic regression.

Labelled rows are a bounded sample (``TRAIN_DOCS`` documents per class, by a hash of the id). The pool that the views
teach each other on is every other document of the table: its features are written once, and rows with equal features
count once, so copies have no more say than one text. In each of ``ROUNDS`` rounds a view scores the whole pool; counts of
its log odds by narrow bins give the cut-offs above which a row goes to the other view with a pseudo-label: those at least
``CONFIDENT``, and in round r at most r times ``GROWTH`` of the pool per class, by whole bins. Each view is then fitted by
Newton steps whose sums over the pool come back as one short row, so the driver holds the labelled sample and nothing else.
Pseudo-labels of a class weigh together at most as much as its labelled rows. A part of the labelled rows
(``CALIBRATION``) is never fitted on: there each view's log odds are calibrated, and the calibrated views are combined by
a regression on both. All documents are then scored by the combination.

Defined cases: a null or empty text has zero features and is scored like any other; missing metadata columns or nulls in
them count as no value; an id with several labels has the largest; repeated rows give repeated results; with no label of
one class every score is 0.5; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetrics.llm.common import class_draw, fit_logistic, logistic, prepare
from albumetrics.sources.workspace import Scratch

TRAIN_DOCS = 4000
ROUNDS = 4
#: Pseudo-labels need this confidence, and round r hands over at most r times this share of the pool per class.
CONFIDENT = 0.95
GROWTH = 0.1
#: Newton steps per round at most; a round starts from the weights of the one before.
STEPS = 8
SMALL_STEP = 1e-6
#: Bins per unit of asinh(log odds).
BINS = 1000
CALIBRATION = 0.3
HASHED = 8
RIDGE = 0.5

_CLASSES = np.zeros(256, np.int64)
for _k, _signs in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n",
                             b".,;:'\"?-()", b"!", b"|", b"#$%&*+=@^_~<>[]{}/\\`")):
    _CLASSES[list(_signs)] = _k + 1
_CLASSES[128:] = 10
_N_CLASSES = 11

TEXT_FEATURES = 8
META_FEATURES = 4 + _N_CLASSES + 2 * HASHED


def text_features(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * TEXT_FEATURES
    different = len(set(words))
    return [
        1.0, different / n, np.log1p(different) / np.log1p(n), sum(map(eq, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n, sum(map(str.isalpha, words)) / n, (len(text) - n) / n / 10, np.log1p(n) / 10,
    ]


def meta_features(text: str, lang: str | None, source: str | None) -> np.ndarray:
    out = np.zeros(META_FEATURES)
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data):
        counts = np.bincount(_CLASSES[data], minlength=_N_CLASSES)
        lines = counts[5] + 1
        out[:4] = 1.0, np.log1p(len(data)) / 10, np.log1p(lines) / 5, np.log1p(len(data) / lines) / 10
        out[4:4 + _N_CLASSES] = np.sqrt(counts / len(data))
    for k, value in enumerate((lang, source)):
        if value is not None:
            out[4 + _N_CLASSES + k * HASHED + zlib.crc32(value.encode()) % HASHED] = 0.1
    return out


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = [t or "" for t in batch.column("text").to_pylist()]
    words = np.array([text_features(t) for t in texts]).reshape(-1, TEXT_FEATURES)
    langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
    meta = np.array([meta_features(*x) for x in zip(texts, langs, sources)]).reshape(-1, META_FEATURES)
    return words, meta


def _constant(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


class Model:
    """Weights of both views, and of the combination of their calibrated log odds."""

    def __init__(self, words: np.ndarray, meta: np.ndarray, calibration: np.ndarray, combined: np.ndarray):
        self.views, self.calibration, self.combined = (words, meta), calibration, combined

    def view_odds(self, words: np.ndarray, meta: np.ndarray) -> np.ndarray:
        raw = np.column_stack([_constant(x) @ beta for x, beta in zip((words, meta), self.views)])
        return self.calibration[:, 0] + self.calibration[:, 1] * np.clip(raw, -20, 20)

    def score(self, words: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return logistic(_constant(self.view_odds(words, meta)) @ self.combined)


def odds_bins(odds: np.ndarray) -> np.ndarray:
    """Narrow bins of log odds: of equal width near 0, of equal ratio further out."""
    return np.floor(np.arcsinh(odds) * BINS).astype(np.int64)


_SURE = int(np.floor(np.arcsinh(np.log(CONFIDENT / (1 - CONFIDENT))) * BINS)) + 1


def cutoffs(bins: np.ndarray, counts: np.ndarray, most: int) -> tuple[int | None, int, int | None, int]:
    """Lowest bin of label 1 and its rows, highest bin of label 0 and its rows; None where no bin fits into ``most``."""
    out: list = []
    for sign in (1, -1):
        # Mirrored, a bin b of negative odds becomes -b - 1.
        own = bins if sign == 1 else -bins - 1
        order = np.argsort(-own, kind="stable")
        total = np.cumsum(counts[order])
        taken = int(((own[order] >= _SURE) & (total <= most)).sum())
        out += [int(bins[order[taken - 1]]), int(total[taken - 1])] if taken else [None, 0]
    return tuple(out)


def _pseudo(view: np.ndarray, beta: np.ndarray, cut: tuple) -> np.ndarray:
    """The label that a view hands over per row, -1 for none."""
    bins = odds_bins(_constant(view) @ beta)
    label = np.full(len(view), -1)
    if cut[0] is not None:
        label[bins >= cut[0]] = 1
    if cut[2] is not None:
        label[bins <= cut[2]] = 0
    return label


def _split(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, TEXT_FEATURES + META_FEATURES)
    return x[:, :TEXT_FEATURES], x[:, TEXT_FEATURES:]


def _count_bins(betas: list[np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[Counter] = [Counter(), Counter()]
    for batch in batches:
        for k, view in enumerate(_split(batch)):
            found, n = np.unique(odds_bins(_constant(view) @ betas[k]), return_counts=True)
            held[k].update(dict(zip(found.tolist(), n.tolist())))
    for k, own in enumerate(held):
        yield pa.RecordBatch.from_pydict({
            "view": pa.array([k] * len(own), pa.int32()), "bin": pa.array(list(own), pa.int64()),
            "n": pa.array(list(own.values()), pa.int64()),
        })


def newton_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Slope and curve of the weighted loss, laid out in one row."""
    p = logistic(x @ beta)
    return np.concatenate([x.T @ (weights * (p - y)), ((x * (weights * p * (1 - p))[:, None]).T @ x).ravel()])


def _pool_sums(teachers, cuts, weights, betas, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = [np.zeros(len(b) * (len(b) + 1)) for b in betas]
    for batch in batches:
        views = _split(batch)
        for k, view in enumerate(views):
            label = _pseudo(views[1 - k], teachers[1 - k], cuts[1 - k])
            rows = label >= 0
            if rows.any():
                y = label[rows].astype(float)
                total[k] += newton_sums(_constant(view[rows]), y, np.where(y == 1, weights[k][1], weights[k][0]), betas[k])
    values = np.concatenate(total)
    yield pa.RecordBatch.from_pydict({"pos": pa.array(np.arange(len(values)), pa.int32()), "value": pa.array(values)})


class Pool:
    """The unlabelled rows, one per different features, as a written table."""

    def __init__(self, rows: DataFrame):
        self._rows, self.size = rows, rows.count()

    def cutoffs(self, betas: list[np.ndarray], most: int) -> list[tuple]:
        """Both views' cut-offs. What returns is bounded by the number of bins, not of rows."""
        found = self._rows.mapInArrow(partial(_count_bins, betas), "view int, bin bigint, n bigint")
        counts = found.groupBy("view", "bin").agg(F.sum("n").alias("n")).toPandas()
        views = [counts[counts["view"] == k] for k in range(2)]
        return [cutoffs(v["bin"].to_numpy(), v["n"].to_numpy(), most) for v in views]

    def sums(self, teachers, cuts, weights, betas) -> list[np.ndarray]:
        found = self._rows.mapInArrow(partial(_pool_sums, teachers, cuts, weights, betas), "pos int, value double")
        total = found.groupBy("pos").agg(F.sum("value").alias("value")).toPandas().sort_values("pos")["value"].to_numpy()
        first = len(betas[0]) * (len(betas[0]) + 1)
        return [total[:first], total[first:]]


def _teach(views, targets, teachers, cuts, pool: Pool) -> list[np.ndarray]:
    """Fit each view on its labelled rows and on what the other view hands over."""
    own = np.array([(targets == c).sum() for c in (0, 1)], float)
    weights, labelled = [], []
    for k in range(2):
        handed = np.array([cuts[1 - k][3], cuts[1 - k][1]], float)
        each = np.minimum(1.0, own / np.maximum(handed, 1))
        # Classes weigh the same, however many pseudo-labels each has.
        total = own + each * handed
        balance = total.mean() / total
        weights.append(balance * each)
        rows = targets >= 0
        y = targets[rows].astype(float)
        labelled.append((_constant(views[k][rows]), y, np.where(y == 1, balance[1], balance[0])))
    betas, moving = [b.copy() for b in teachers], True
    for _ in range(STEPS):
        sums = pool.sums(teachers, cuts, weights, betas)
        moving = False
        for k, beta in enumerate(betas):
            d = len(beta)
            both = sums[k] + newton_sums(*labelled[k], beta)
            penalty = np.full(d, RIDGE)
            penalty[0] = 1e-6
            step = np.linalg.solve(both[d:].reshape(d, d) + np.diag(penalty), both[:d] + penalty * beta)
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            betas[k] = beta - step
            moving |= bool(np.abs(step).max() >= SMALL_STEP)
        if not moving:
            break
    # Sums over tasks differ in their last digits between runs; cut-offs shall not.
    return [np.round(b, 7) for b in betas]


def co_train(words: np.ndarray, meta: np.ndarray, labels: np.ndarray, calibrate: np.ndarray, pool: Pool) -> Model:
    """``labels``: 0 or 1; ``calibrate``: labelled rows that no view is fitted on."""
    views = (words, meta)
    targets = np.where(calibrate, -1, labels)
    rows = targets >= 0
    y = targets[rows].astype(float)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    betas = [np.round(fit_logistic(_constant(v[rows]), y, weight, ridge=RIDGE), 7) for v in views]
    for turn in range(1, ROUNDS + 1):
        cuts = pool.cutoffs(betas, int(GROWTH * turn * pool.size)) if pool.size else [(None, 0, None, 0)] * 2
        if not any(c[1] + c[3] for c in cuts):
            break
        betas = _teach(views, targets, betas, cuts, pool)
    y = labels[calibrate].astype(float)
    ones = np.ones(len(y))
    calibration = np.array([
        fit_logistic(_constant(np.clip(_constant(v[calibrate]) @ b, -20, 20)[:, None]), y, ones, ridge=1e-2)
        for v, b in zip(views, betas)
    ])
    model = Model(betas[0], betas[1], calibration, np.array([0.0, 0.5, 0.5]))
    model.combined = fit_logistic(_constant(model.view_odds(words[calibrate], meta[calibrate])), y, ones, ridge=1e-2)
    return model


def _feature_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.hstack(_features(batch))
        yield pa.RecordBatch.from_pydict({
            "id": batch.column("id"), "label": batch.column("label"), "x": pa.array(list(x), pa.list_(pa.float64())),
        })


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    have = {c.lower() for c in docs.columns}
    extra = [(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")]
    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), *extra)


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Learn from the labels for which ``usable`` (a condition on ``id_col``) holds; None unless both labels occur."""
    prepare(docs.sparkSession)
    chosen = class_draw(labels, id_col, label_col, "label", usable, TRAIN_DOCS, seed=8)
    if chosen is None:
        return None
    chosen = chosen.select(F.col(id_col).cast("string").alias("id"), "label")
    # Bounded by TRAIN_DOCS per class.
    marked = _columns(docs, id_col, text_col).join(F.broadcast(chosen), "id", "left")
    marked = marked.select("id", F.coalesce("label", F.lit(-1)).alias("label"), "text", "lang", "source")
    scratch = Scratch(docs.sparkSession, "cotraining")
    try:
        rows = scratch.table(marked.mapInArrow(_feature_batch, "id string, label int, x array<double>"), "features")
        found = rows.filter("label >= 0").toPandas().sort_values(["id", "label"], kind="stable")
        labels_ = found["label"].to_numpy()
        if len(set(labels_)) < 2:
            return None
        spread = np.array([zlib.crc32(f"calibrate {i}".encode()) % 1000 for i in found["id"]]) / 1000
        calibrate = spread < CALIBRATION
        x = np.stack(found["x"].to_numpy())
        if len(set(labels_[calibrate])) < 2 or len(set(labels_[~calibrate])) < 2:
            # Too few labels to set some aside: the fitted rows calibrate as well.
            x, calibrate = np.concatenate([x, x]), np.repeat([False, True], len(x))
            labels_ = np.concatenate([labels_, labels_])
        pool = Pool(scratch.table(rows.filter("label < 0").select("x").distinct(), "pool"))
        return co_train(x[:, :TEXT_FEATURES], x[:, TEXT_FEATURES:], labels_, calibrate, pool)
    finally:
        scratch.drop()


def _score_batch(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = model.value
    for batch in batches:
        scores = own.score(*_features(batch)) if own is not None else np.full(batch.num_rows, 0.5)
        yield pa.RecordBatch.from_pydict({
            "id": batch.column("id"), "score": pa.array(scores, pa.float64()),
            "predicted": pa.array((scores >= 0.5).astype(np.int32), pa.int32()),
        })


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (that the quality is good), ``predicted``: one row per row of ``docs``."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    out = _columns(docs, id_col, text_col).mapInArrow(
        partial(_score_batch, shared), "id string, score double, predicted int")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "score", "predicted")
