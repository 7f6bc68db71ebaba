"""Helpers shared by the operators: settings, table access, batches, hashes, bounded memos."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumetrics.session import configure

#: Rows and bytes handed to a Python task at once; texts may be very long.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # Texts travel through Python; a column of views saves no copy here.
    "spark.sql.execution.arrow.useLargeVarTypes": "false",
}

HELD_OUT_FOLDS = 5


def prepare(spark: SparkSession) -> SparkSession:
    return configure(spark, **SETTINGS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for rows whose crc32(doc_id as text) mod 5 is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % HELD_OUT_FOLDS == 0


def draw(key: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the key alone, so that a rerun draws the same rows."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def class_draw(labels: DataFrame, id_col: str, label_col: str, name: str, usable: Column | None, rows: int,
               seed: int) -> DataFrame | None:
    """At most about ``rows`` ids of each label 0 and 1, as (id, ``name``); None unless both labels occur.

    An id with several labels has the largest.
    """
    marks = labels.select(F.col(id_col), F.col(label_col).cast("int").alias(name))
    marks = marks.filter((F.lit(True) if usable is None else usable) & F.col(name).isin(0, 1) & F.col(id_col).isNotNull())
    marks = marks.groupBy(id_col).agg(F.max(name).alias(name))
    sizes = {r[name]: r["n"] for r in marks.groupBy(name).agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col(name) == 1, F.lit(min(1.0, rows / sizes[1]))).otherwise(min(1.0, rows / sizes[0]))
    return marks.filter(draw(F.col(id_col), seed) < share)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic regression; the first column is the constant and has no penalty."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = logistic(x @ beta)
        slope = x.T @ (weights * (p - y)) + penalty * beta
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def slices(ids: list, texts: list, chars: int = 1 << 20) -> Iterator[tuple[list, list[str]]]:
    """Cut a batch into runs of whole documents of about ``chars`` characters; a null text becomes empty."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= chars:
            yield ids[start:k + 1], [t or "" for t in texts[start:k + 1]]
            start, size = k + 1, 0
    if start < len(texts):
        yield ids[start:], [t or "" for t in texts[start:]]


def by_slices(work: Callable[[list, list[str]], pa.RecordBatch]) -> Callable:
    """A function for ``mapInArrow`` over the columns (id, text) that hands whole texts to ``work``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in slices(ids, texts):
                yield work(*part)

    return run


class Memo(dict):
    """``make(key)``, remembered in two generations so that memory stays bounded.

    A full young generation becomes the old one; keys in use move back. ``map(memo.__getitem__, keys)``
    costs one dictionary lookup for a remembered key.
    """

    def __init__(self, make: Callable, limit: int = 150_000):
        super().__init__()
        self._make, self._limit, self._old = make, limit, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        self[key] = value

    def known(self, key) -> bool:
        return key in self or key in self._old


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs get unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
