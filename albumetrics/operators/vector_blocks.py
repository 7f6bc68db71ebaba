"""Joins of vectors over blocks in files: no row is copied, whatever it has to be compared with.

A table of vectors is cut into blocks of bounded size, each written once to a file of the shared folder. Blocks hold vectors
that lie near one pivot, and a manifest has the centre and the radius of each block on the unit sphere. By these two numbers
no vector of one block is nearer to one of another than ``|centre - centre| - radius - radius``, nor further than the same
with plus signs, so most pairs of blocks are settled by the manifest. A task gets the names of two blocks that are not,
reads both files and compares them. What travels between tasks is the manifest, pairs of names, and results.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumetrics.functions.vectors import list_column, matrix
from albumetrics.operators.vector_join import SLACK, _arrow_schema, choose_pivots, run_tiles
from albumetrics.sources.shared_files import read_table, write_table
from albumetrics.sources.workspace import Scratch

BLOCK_ROWS = 4096
LEAST_ROWS = 256
#: Manifests up to this many blocks are sent to every task; longer ones are compared in tiles of two chunks.
SHARED_BLOCKS = 2048
#: Pairs of blocks that one task works on, where there are many.
PAIRS_PER_TASK = 64
#: Parts of a block that are compared with all other blocks by one call each.
BLOCK_PARTS = 4
HELD_BLOCKS = 6
ROUNDING = 1e-12

# Cells of vectors whose direction says nothing: the zero vector, and those so short that a product of norms may vanish.
ZERO, SHORT = -1, -2
SHORT_NORM = 1e-4

MANIFEST_DDL = "id bigint, block string, rows bigint, kind int, radius double, vec array<double>, bound double, mark string"

Keep = Callable[[pa.Table, pa.Table], np.ndarray]
Tile = Callable[[pa.Table, pa.Table, bool], pa.Table | Iterator[pa.Table]]


def _cells(pivots: np.ndarray, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``_cell``, the nearest pivot of each row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        points = matrix(batch.column(at))
        norms = np.linalg.norm(points, axis=1)
        own = np.zeros(len(points), np.int64)
        if len(pivots):
            own = (points @ pivots.T).argmax(axis=1).astype(np.int64)
        own = np.where(norms == 0, ZERO, np.where(norms < SHORT_NORM, SHORT, own))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], [*batch.schema.names, "_cell"])


def _written(root: str, columns: list[str], mark: str | None, table: pa.Table) -> pa.Table:
    """Write one block and return its row of the manifest."""
    cell = table.column("_cell")[0].as_py()
    table = table.sort_by("id")
    points = matrix(table.column("vec"))
    norms = np.linalg.norm(points, axis=1)
    unit = points / np.where(norms > 0, norms, 1.0)[:, None]
    centre = unit.mean(axis=0)
    radius = float(np.linalg.norm(unit - centre, axis=1).max())
    # A repeated attempt writes a file of its own; the manifest names the one that counts.
    name = f"{root}/{uuid.uuid4().hex}.arrow"
    write_table(name, table.select(columns))
    number = int(np.int64(int(uuid.uuid5(uuid.NAMESPACE_OID, f"{table.column('id')[0]}-{cell}-{table.num_rows}").hex[:15], 16)))
    return pa.table([
        pa.array([number]), pa.array([name]), pa.array([table.num_rows], pa.int64()),
        pa.array([min(cell, 0)], pa.int32()), pa.array([radius]), list_column(centre[None, :]), pa.array([None], pa.float64()),
        pa.array([None if mark is None else str(table.column(mark)[0].as_py())], pa.string()),
    ], ["id", "block", "rows", "kind", "radius", "vec", "bound", "mark"])


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _names(manifest: pa.Table) -> np.ndarray:
    return np.array(manifest.column("block").to_pylist(), object)


def centre_distances(left: pa.Table, right: pa.Table) -> np.ndarray:
    a, b = matrix(left.column("vec")), matrix(right.column("vec"))
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def _no_direction(left: pa.Table, right: pa.Table, kind: int) -> np.ndarray:
    return (_numbers(left, "kind") == kind)[:, None] | (_numbers(right, "kind") == kind)[None, :]


def least_distance(left: pa.Table, right: pa.Table) -> np.ndarray:
    """Per pair of blocks, a cosine distance that no pair of their vectors is below."""
    chord = centre_distances(left, right) - _numbers(left, "radius")[:, None] - _numbers(right, "radius")[None, :] - SLACK
    # Computed distances of equal vectors may fall below 0 by rounding.
    low = np.maximum(chord, 0.0) ** 2 / 2 - ROUNDING
    return np.where(_no_direction(left, right, SHORT), -ROUNDING, np.where(_no_direction(left, right, ZERO), 1.0 - SLACK, low))


def most_distance(left: pa.Table, right: pa.Table) -> np.ndarray:
    """Per pair of blocks, a cosine distance that no pair of their vectors is above."""
    chord = centre_distances(left, right) + _numbers(left, "radius")[:, None] + _numbers(right, "radius")[None, :] + SLACK
    high = np.minimum(chord, 2.0 + SLACK) ** 2 / 2
    return np.where(_no_direction(left, right, SHORT), 3.0, np.where(_no_direction(left, right, ZERO), 1.0 + SLACK, high))


def nearer_than(limit: float) -> Keep:
    """Pairs of blocks that may hold a pair of vectors nearer than ``limit``."""
    return lambda left, right: least_distance(left, right) < limit


class VectorBlocks:
    """Blocks of one table ``vectors`` (id, vec and any other columns) and their manifest.

    Ids are unique, and ``vec`` is never null. ``mark`` names a column whose values are never mixed in a block.
    """

    def __init__(self, vectors: DataFrame, scratch: Scratch, mark: str | None = None, rows: int | None = None):
        self.spark, self.scratch = vectors.sparkSession, scratch
        total = vectors.count() if rows is None else rows
        cores = self.spark.sparkContext.defaultParallelism
        # Enough pairs of blocks for all cores where the table is small.
        size = int(min(BLOCK_ROWS, max(LEAST_ROWS, math.ceil(total / math.sqrt(4 * cores)))))
        pivots = choose_pivots(vectors, total, per_pivot=size)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
        placed = vectors.mapInArrow(partial(_cells, pivots, vectors.columns.index("vec")), f"{fields}, _cell bigint")
        keys = ["_cell"] if mark is None else ["_cell", mark]
        counts = placed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("_parts"))
        cut = placed.join(counts, keys).withColumn("_part", F.pmod(F.xxhash64("id", F.lit(7)), F.col("_parts"))).drop("_parts")
        write = partial(_written, f"{scratch.root}/blocks", vectors.columns, mark)
        self.manifest = scratch.table(cut.groupBy(*keys, "_part").applyInArrow(lambda t: write(t), MANIFEST_DDL), "manifest")
        self.count = self.manifest.count()

    def bounded(self, bounds: DataFrame) -> None:
        """Give blocks a ``bound`` from (block, bound), for ``Keep`` functions to use."""
        self.manifest = self.scratch.table(
            self.manifest.drop("bound").join(bounds, "block", "left").select(self.manifest.columns), "bounds")

    def pairs(self, keep: Keep, other: VectorBlocks | None = None) -> DataFrame:
        """Names of the blocks (a, b) to compare; each pair of blocks of one table once, a block also with itself."""
        def chosen(left: pa.Table, near: pa.Table, same: bool) -> pa.Table:
            hits = keep(left, near)
            if same:
                hits = hits & (_names(left)[:, None] <= _names(near)[None, :])
            rows, cols = np.nonzero(hits)
            return pa.table({"a": pa.array(_names(left)[rows], pa.string()), "b": pa.array(_names(near)[cols], pa.string())})

        return self._meet(chosen, "a string, b string", other)

    def _meet(self, work: Tile, schema: str, other: VectorBlocks | None = None) -> DataFrame:
        """``work`` over the manifests: every two parts of them meet, of one manifest those of one part with themselves."""
        right = self if other is None else other
        arrow_schema = _arrow_schema(schema)
        if max(self.count, right.count) <= SHARED_BLOCKS:
            shared = self.spark.sparkContext.broadcast(right.manifest.toArrow())
            alone = other is None

            def against_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows and shared.value.num_rows:
                        yield from work(pa.Table.from_batches([batch]), shared.value, alone).cast(arrow_schema).to_batches()

            return self.manifest.mapInArrow(against_all, schema)
        one = F.lit(0).cast("bigint").alias("_cell")
        mine = self.manifest.select("*", one, F.lit(True).alias("_home"))
        if other is not None:
            mine = mine.unionByName(right.manifest.select("*", one, F.lit(False).alias("_home")))
        return run_tiles(mine, work, schema, within=other is None)

    def least(self, value: Callable[[pa.Table, pa.Table], np.ndarray]) -> float:
        """The least of ``value`` over all pairs of blocks, from the manifest alone; infinite where there is none."""
        low = self._meet(
            lambda left, near, _same: pa.table({"v": [float(value(left, near).min(initial=np.inf))]}),
            "v double").agg(F.min("v")).first()[0]
        return math.inf if low is None else low

    def compare(self, tile: Tile, schema: str, keep: Keep, other: VectorBlocks | None = None) -> DataFrame:
        """``tile(left, right, same)`` over every pair of blocks that ``keep`` does not rule out; it gives one table or several."""
        pairs = self.scratch.table(self.pairs(keep, other), "pairs")
        count = pairs.count()
        cores = self.spark.sparkContext.defaultParallelism
        tasks = max(1, min(count, 4 * cores), math.ceil(count / PAIRS_PER_TASK))
        alone, arrow_schema = other is None, _arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = lru_cache(maxsize=HELD_BLOCKS)(read_table)
            for batch in batches:
                for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = tile(block(a), block(b), alone and a == b)
                    for table in [found] if isinstance(found, pa.Table) else found:
                        yield from table.cast(arrow_schema).to_batches()

        return pairs.repartition(tasks, "a", "b").sortWithinPartitions("a", "b").mapInArrow(run, schema)

    def gather(self, work: Callable[[pa.Table, slice, Iterator[pa.Table]], pa.Table], schema: str, keep: Keep) -> DataFrame:
        """``work(block, part, others)`` over the parts of every block: one call sees all blocks that ``keep`` does not rule
        out, the own among them, so it can hold what is best for each of its rows and hand over no more than that.
        """
        once = self.scratch.table(self.pairs(keep), "pairs")
        back = once.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))
        parts = F.explode(F.sequence(F.lit(0), F.lit(BLOCK_PARTS - 1))).alias("part")
        # A list of names of blocks, not of rows.
        calls = once.unionByName(back).groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("others")).select("a", parts, "others")
        count, cores = self.count * BLOCK_PARTS, self.spark.sparkContext.defaultParallelism
        tasks = max(1, min(count, 4 * cores), math.ceil(count / PAIRS_PER_TASK))
        arrow_schema = _arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = lru_cache(maxsize=HELD_BLOCKS)(read_table)
            for batch in batches:
                for name, part, others in zip(*[column.to_pylist() for column in batch.columns]):
                    mine = block(name)
                    rows = slice(mine.num_rows * part // BLOCK_PARTS, mine.num_rows * (part + 1) // BLOCK_PARTS)
                    yield from work(mine, rows, map(block, others)).cast(arrow_schema).to_batches()

        return calls.repartition(tasks, "a", "part").mapInArrow(run, schema)

    def each(self, work: Callable[[pa.Table, str], pa.Table], schema: str) -> DataFrame:
        """``work(block, name)`` over every block."""
        arrow_schema = _arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    yield from work(read_table(name), name).cast(arrow_schema).to_batches()

        tasks = max(1, min(self.count, 4 * self.spark.sparkContext.defaultParallelism), math.ceil(self.count / PAIRS_PER_TASK))
        return self.manifest.select("block").repartition(tasks, "block").mapInArrow(run, schema)

