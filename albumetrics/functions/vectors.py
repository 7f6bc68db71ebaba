"""Vector arithmetic: codecs, cosine distance and group centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY_NORM = 1e-10
TINY_WEIGHT = 1e-6
_FLUSH_KEYS = 4096
#: Sums of a hot key from many tasks are first merged in so many parts.
MERGE_PARTS = 32


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a two-dimensional float64 array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype=np.float64).reshape(len(column), -1)


def list_column(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def distance_matrix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosine distance of all row pairs; a vanishing norm product gives 1."""
    norms = np.linalg.norm(left, axis=1)[:, None] * np.linalg.norm(right, axis=1)[None, :]
    tiny = norms < TINY_NORM
    out = 1.0 - (left @ right.T) / np.where(tiny, 1.0, norms)
    out[tiny] = 1.0
    return out


@F.arrow_udf(T.DoubleType())
def cosine_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Row-wise cosine distance in Arrow batches; a null vector gives null."""
    valid = np.asarray(a.is_valid()) & np.asarray(b.is_valid())
    out = np.full(len(a), np.nan)
    if valid.any():
        mask = pa.array(valid)
        left, right = matrix(a.filter(mask)), matrix(b.filter(mask))
        norms = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
        tiny = norms < TINY_NORM
        dots = np.einsum("ij,ij->i", left, right)
        out[valid] = np.where(tiny, 1.0, 1.0 - dots / np.where(tiny, 1.0, norms))
    return pa.array(out, mask=~valid)


@F.arrow_udf(T.BinaryType())
def vector_to_bytes(vectors: pa.Array) -> pa.Array:
    """Vectors as little-endian float32 bytes."""
    present = np.asarray(vectors.is_valid())
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4")
    sizes = np.where(present, vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    return _joined(values.tobytes(), sizes * 4, present)


def _joined(data: bytes, sizes: np.ndarray, present: np.ndarray) -> pa.Array:
    """One binary array over one buffer, cut by the sizes."""
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    valid = pa.py_buffer(np.packbits(present, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(sizes), [valid, pa.py_buffer(edges.tobytes()), pa.py_buffer(data)])


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def bytes_to_vector(blobs: pa.Array) -> pa.Array:
    present = np.asarray(blobs.is_valid())
    sizes = np.where(present, pc.binary_length(blobs).fill_null(0).to_numpy(zero_copy_only=False), 0) // 4
    # Bytes that make no whole number at the end of a blob are left out.
    data = b"".join(b[:len(b) // 4 * 4] for b in blobs.drop_null().to_pylist())
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.array(np.frombuffer(data, "<f4").astype(np.float64))
    return pa.ListArray.from_arrays(pa.array(edges), values, mask=pa.array(~present))


def _partial_sums(key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def emit():
            keys = list(held)
            sums = np.stack([held[k] for k in keys])
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type), list_column(sums)], ["_key", "_sums"]
            )

        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column(0)
            vectors = matrix(batch.column(1))
            weights = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            encoded = keys.dictionary_encode()
            codes = encoded.indices.to_numpy()
            # Four running parts per key: weighted sum, plain sum, weight and row count.
            rows = np.hstack(
                [vectors * weights[:, None], vectors, weights[:, None], np.ones((len(weights), 1))]
            )
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
            sums = np.add.reduceat(rows[order], starts, axis=0)
            names = encoded.dictionary.to_pylist()
            for code, row in zip(codes[order][starts], sums, strict=True):
                key = names[code]
                held[key] = held[key] + row if key in held else row
            if len(held) >= _FLUSH_KEYS:
                yield emit()
                held.clear()
        if held:
            yield emit()

    return run


def _merge_sums(partial: DataFrame, arrow_key: pa.DataType, key_type: str, *by: str) -> DataFrame:
    """One row per key and task again, after rows that agree in ``by`` have come together.

    Rows come sorted by key, so a task holds one batch and the sum of one key.
    """
    partial = partial.repartition(*by).sortWithinPartitions("_key").select("_key", "_sums")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            names = batch.column("_key").to_pylist()
            starts = [k for k, name in enumerate(names) if k == 0 or name != names[k - 1]]
            sums = np.add.reduceat(matrix(batch.column("_sums")), starts, axis=0)
            keys = [names[k] for k in starts]
            if last == keys[0]:
                sums[0] += total
            elif last is not None:
                keys, sums = [last, *keys], np.vstack([total, sums])
            last, total = keys[-1], sums[-1].copy()
            if len(keys) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(keys[:-1], arrow_key), list_column(sums[:-1])], ["_key", "_sums"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], arrow_key), list_column(total[None, :])], ["_key", "_sums"])

    return partial.mapInArrow(run, f"_key {key_type}, _sums array<double>")


def centroids(df: DataFrame, key: str, vec: str, weight: Column | float = 1.0) -> DataFrame:
    """Weighted centroid per key: ``(key, n, centroid)``.

    Where the weights of a group sum to nothing the plain mean is taken. Each
    task first adds up its own rows, so a hot key reaches the shuffle as one
    short row per task.
    """
    weight = F.lit(weight).cast("double") if isinstance(weight, (int, float)) else weight.cast("double")
    key_type = df.schema[key].dataType.simpleString()
    arrow_key = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[key_type]
    rows = df.filter(F.col(vec).isNotNull() & F.col(key).isNotNull()).select(key, vec, weight.alias("_w"))
    partial = rows.mapInArrow(_partial_sums(arrow_key), f"_key {key_type}, _sums array<double>")
    # Sums of several tasks meet twice: by key and a part of the tasks, then by key; each step sends one row per key.
    parts = partial.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)))
    merged = _merge_sums(_merge_sums(parts, arrow_key, key_type, "_key", "_part"), arrow_key, key_type, "_key")
    summed = (
        merged.withColumnRenamed("_sums", "_s")
        .withColumn("_dim", ((F.size("_s") - 2) / 2).cast("int"))
        .withColumn("_total", F.element_at("_s", -2))
        .withColumn("_n", F.element_at("_s", -1))
    )
    weighted = F.transform(F.slice("_s", F.lit(1), F.col("_dim")), lambda v: v / F.col("_total"))
    plain = F.transform(F.slice("_s", F.col("_dim") + 1, F.col("_dim")), lambda v: v / F.col("_n"))
    return summed.select(
        F.col("_key").alias(key),
        F.col("_n").cast("bigint").alias("n"),
        F.when(F.col("_total") > TINY_WEIGHT, weighted).otherwise(plain).alias("centroid"),
    )


def spreads(df: DataFrame, centres: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean distance of a group's vectors to their centroid; groups of one give 0."""
    joined = df.join(centres.select(key, "n", "centroid"), key)
    return joined.groupBy(key).agg(
        F.when(F.max("n") < 2, F.lit(0.0))
        .otherwise(F.avg(cosine_distance(F.col(vec), F.col("centroid"))))
        .alias("spread")
    )
