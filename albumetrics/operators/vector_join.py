"""Vector joins in cells, cut into chunks; ``vector_blocks`` has the exact joins that copy no rows.

Vectors are cut into cells around pivots. Two vectors closer than the
threshold can only meet where one of them lives, so a vector is sent to its
own cell and to those neighbour cells whose border lies within reach. Cells are
cut into chunks of bounded size and every pair of chunks is one small task, so
a cell that holds a third of all vectors is worked on by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetrics.functions.vectors import matrix

CHUNK_ROWS = 4096
MAX_PIVOTS = 2048
ROWS_PER_PIVOT = 4096
# Slack on the geometric bounds, against rounding.
SLACK = 1e-6


def reach(threshold: float) -> float:
    """Chord length between unit vectors at that cosine distance."""
    return math.sqrt(max(0.0, 2.0 * threshold)) + SLACK


def choose_pivots(
    vectors: DataFrame, rows: int, vec: str = "vec", ident: str = "id", per_pivot: int | None = None
) -> np.ndarray:
    """A bounded, repeatable choice of unit vectors to build cells around.

    At most ``MAX_PIVOTS`` vectors come to the driver, whatever the table size.
    """
    wanted = int(min(MAX_PIVOTS, max(1, math.ceil(rows / (per_pivot or ROWS_PER_PIVOT)))))
    if wanted == 1:
        return np.empty((0, 0))
    picked = (
        vectors.select(vec, F.xxhash64(ident).alias("_h"))
        .orderBy("_h")
        .limit(wanted * 2)
        .select(vec)
        .toArrow()
    )
    points = matrix(picked.column(0))
    norms = np.linalg.norm(points, axis=1)
    points = points[norms > 0] / norms[norms > 0][:, None]
    return np.unique(points, axis=0)[:wanted]


def _assign_cells(pivots: np.ndarray, radius: float, replicate: bool, vec_index: int):
    """Batch function adding ``_cell`` and ``_home``; replicas only if asked for.

    A replica goes to every cell whose border is within reach; of two cells
    that could both hold a pair, the one with the smaller number does.
    """
    count = len(pivots)
    gaps = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (pivots @ pivots.T))) if count else None

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if count == 0:
                take, cells = None, np.zeros(batch.num_rows, np.int64)
                home = np.ones(batch.num_rows, bool)
            else:
                points = matrix(batch.column(vec_index))
                norms = np.linalg.norm(points, axis=1)
                points = points / np.where(norms > 0, norms, 1.0)[:, None]
                square = np.maximum(0.0, 1.0 + (norms > 0)[:, None] - 2.0 * (points @ pivots.T))
                own = square.argmin(axis=1)
                rows = np.arange(len(own))
                if replicate:
                    # Distance to the plane halfway between the own and the other pivot.
                    gap = gaps[own]
                    border = (square - square[rows, own][:, None]) / np.where(gap > 0, 2 * gap, 1.0)
                    near = (border <= radius) | (gap <= 0)
                    near &= np.arange(count)[None, :] < own[:, None]
                    extra_rows, extra_cells = np.nonzero(near)
                    take = np.concatenate([rows, extra_rows])
                    cells = np.concatenate([own, extra_cells]).astype(np.int64)
                    home = np.concatenate([np.ones(len(rows), bool), np.zeros(len(extra_rows), bool)])
                else:
                    take, cells, home = None, own.astype(np.int64), np.ones(len(own), bool)
            kept = batch if take is None else batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(cells), pa.array(home)], [*kept.schema.names, "_cell", "_home"]
            )

    return run


def _with_cells(df: DataFrame, run: Callable) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, _cell bigint, _home boolean")


def _spread(
    placed: DataFrame, chunk_rows: int, salt: Column, within: bool, few_cells: bool
) -> DataFrame:
    """Cut every cell into chunks and send each row to the chunk pairs it takes part in.

    The pair (a, b) holds chunk a of the cell's own rows against chunk b of its
    own rows (a <= b, if ``within``) or against chunk b of the rows sent in
    (numbered from the number of own chunks on).
    """
    sizes = placed.groupBy("_cell").agg(
        F.ceil(F.sum(F.col("_home").cast("bigint")) / chunk_rows).alias("_own"),
        F.ceil(F.sum((~F.col("_home")).cast("bigint")) / chunk_rows).alias("_sent"),
    ).filter("_own > 0" if within else "_own > 0 AND _sent > 0")
    cut = placed.join(F.broadcast(sizes) if few_cells else sizes, "_cell").withColumn(
        "_chunk",
        F.when(F.col("_home"), F.pmod(salt, F.col("_own"))).otherwise(
            F.col("_own") + F.pmod(salt, F.greatest(F.col("_sent"), F.lit(1)))
        ),
    )
    last = F.when(F.col("_home"), F.col("_own") + F.col("_sent")).otherwise(F.col("_own")) - 1
    first = F.lit(0) if within else F.when(F.col("_home"), F.col("_own")).otherwise(0)
    partner = F.explode(F.sequence(first.cast("bigint"), last.cast("bigint")))
    return (
        cut.withColumn("_partner", partner)
        .withColumn("_lo", F.least("_chunk", "_partner"))
        .withColumn("_hi", F.greatest("_chunk", "_partner"))
        .drop("_partner", "_own", "_sent")
    )


def run_tiles(
    placed: DataFrame, tile: Callable[[pa.Table, pa.Table, bool], pa.Table | Iterator[pa.Table]], schema: str,
    within: bool = True, few_cells: bool = True, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Apply ``tile(left, right, same)`` to every pair of chunks of every cell; it gives one table, or several in turn.

    ``placed`` carries ``_cell`` and ``_home``. Where ``same`` is true the two
    sides are one chunk. ``within=False`` compares own rows only with rows sent
    in. ``few_cells`` says that the number of cells has a fixed bound, so their
    sizes can be broadcast.
    """
    salt = F.xxhash64("id", F.lit(7))
    columns = [c for c in placed.columns if c not in ("_cell", "_home")]
    spread = _spread(placed, chunk_rows, salt, within, few_cells)
    arrow_schema = _arrow_schema(schema)

    def per_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        low = table.column("_lo")[0].as_py()
        high = table.column("_hi")[0].as_py()
        # A fixed order makes a repeated task give the same bits.
        table = table.sort_by("id")
        chunk = table.column("_chunk").to_numpy()
        if low == high:
            side = table.select(columns)
            out = tile(side, side, True)
        else:
            left = table.filter(pa.array(chunk == low)).select(columns)
            right = table.filter(pa.array(chunk == high)).select(columns)
            if left.num_rows == 0 or right.num_rows == 0:
                return
            out = tile(left, right, False)
        for part in [out] if isinstance(out, pa.Table) else out:
            yield from part.cast(arrow_schema).to_batches()

    return spread.groupBy("_cell", "_lo", "_hi").applyInArrow(per_tile, schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    pairs = [part.strip().rsplit(" ", 1) for part in ddl.split(",")]
    return pa.schema([(name, kinds[kind]) for name, kind in pairs])


def place_self(vectors: DataFrame, threshold: float, rows: int | None = None) -> DataFrame:
    """Rows with ``_cell`` and ``_home`` such that every pair under the threshold shares one cell."""
    rows = vectors.count() if rows is None else rows
    index = vectors.columns.index("vec")
    # Above 1 a vanishing vector is near everything, and no border helps.
    pivots = choose_pivots(vectors, rows) if threshold <= 1.0 else np.empty((0, 0))
    return _with_cells(vectors, _assign_cells(pivots, reach(threshold), True, index))
