"""Similarity edges between vectors: exact or by random-hyperplane buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumetrics.functions.temporal import penalty_pairs
from albumetrics.functions.vectors import TINY_NORM, distance_matrix, matrix
from albumetrics.operators.vector_blocks import VectorBlocks, least_distance, most_distance, nearer_than
from albumetrics.operators.vector_join import run_tiles
from albumetrics.sources.workspace import Scratch

# Fixed values.
TOP_K = 256
LSH_BITS = 10
LSH_TABLES = 8
LSH_SEED = 42
# Of the arithmetic that makes the planes.
PRIME, PLANE_STEP, PLACE_STEP = 2_147_483_647, 104_729, 15_485_863

# Most cells of a distance matrix held at a time; a worker holds some ten arrays of that many.
STRIPE_CELLS = 1_000_000
# Weights are ranked in whole parts of this size, so that pairs which differ by rounding alone are ties, whatever the block.
WEIGHT_SCALE = 1 << 30
# What may be lost by rounding where far pairs are passed over.
FAR_SLACK = 1e-9
#: Rows of a bucket that are joined in one piece. A larger bucket is sent once per piece, so pieces are larger than elsewhere.
BUCKET_ROWS = 16_384

EDGE_SCHEMA = "src bigint, dst bigint, weight double"


def _dates(table: pa.Table) -> np.ndarray:
    return table.column("taken_at").cast(pa.float64()).to_numpy()


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("id").to_numpy()


class _Side:
    """One side of a tile: its vectors at length 1 (zero vectors stay), their norms and dates."""

    def __init__(self, table: pa.Table):
        self.rows, self.ids = table.num_rows, _ids(table)
        points = matrix(table.column("vec"))
        self.norms = np.linalg.norm(points, axis=1)
        self.units = points / np.where(self.norms > 0, self.norms, 1.0)[:, None]
        self.dates = _dates(table)

    def stripes(self, width: int) -> list[slice]:
        """Stripes of rows that make a matrix of bounded size with ``width`` columns."""
        step = max(1, STRIPE_CELLS // max(1, width))
        return [slice(at, min(at + step, self.rows)) for at in range(0, self.rows, step)]


def _near(left: _Side, part: slice, right: _Side, threshold: float, time_weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs nearer than ``threshold``: rows of ``left``, rows of ``right`` and distances, row by row.

    The penalty is never negative, so a pair whose vectors alone are too far apart needs no date.
    """
    norms = left.norms[part]
    cosine = left.units[part] @ right.units.T
    hits = cosine > 1.0 - threshold - FAR_SLACK
    if threshold > 1.0:
        hits |= norms[:, None] * right.norms[None, :] < TINY_NORM
    at = np.flatnonzero(hits)
    rows, cols = np.divmod(at, max(1, right.rows))
    distance = np.where(norms[rows] * right.norms[cols] < TINY_NORM, 1.0, 1.0 - cosine.ravel()[at])
    rows += part.start
    distance += penalty_pairs(left.dates[rows], right.dates[cols], time_weight, threshold)
    keep = distance < threshold
    return (rows, cols, distance) if keep.all() else (rows[keep], cols[keep], distance[keep])


def _untested(left: pa.Table, right: pa.Table, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Pairs whose first common bucket is this one, so that each pair counts once."""
    table = left.column("bucket_table")[0].as_py()
    mine, theirs = matrix(left.column("signatures")), matrix(right.column("signatures"))
    first = np.ones(len(rows), bool)
    for t in range(table):
        first &= mine[rows, t] != theirs[cols, t]
    return first


def _strongest(rows: np.ndarray, cols: np.ndarray, distance: np.ndarray, first: int, shape: tuple[int, int], top_k: int | None):
    """Per row the ``top_k`` nearest of the pairs (all, if None); ties go to the smaller column, as blocks are sorted by id."""
    counts = np.bincount(rows - first, minlength=shape[0])
    if top_k is None or not (counts > top_k).any():
        return rows, cols, distance
    if top_k <= 0:
        return rows[:0], cols[:0], distance[:0]
    far = -np.rint((1.0 - distance) * WEIGHT_SCALE)
    dense = np.full(shape, np.inf)
    dense[rows - first, cols] = far
    dense.partition(top_k - 1, axis=1)
    # All that are as near as the last one, then exactly so many of them.
    keep = far <= dense[:, top_k - 1][rows - first]
    rows, cols, distance, far = rows[keep], cols[keep], distance[keep], far[keep]
    order = np.lexsort((cols, far, rows))
    rows, cols, distance = rows[order], cols[order], distance[order]
    counts = np.bincount(rows - first, minlength=shape[0])
    rank = np.arange(len(rows)) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)
    keep = rank < top_k
    return rows[keep], cols[keep], distance[keep]


def _edge_stripes(threshold: float, time_weight: float, top_k: int | None, bucketed: bool):
    def one_way(left: pa.Table, right: pa.Table, same: bool) -> Iterator[pa.Table]:
        """Edges from each left row; the matrix is made a stripe of rows at a time."""
        mine = _Side(left)
        theirs = mine if same else _Side(right)
        for part in mine.stripes(theirs.rows):
            rows, cols, distance = _near(mine, part, theirs, threshold, time_weight)
            keep = rows != cols if same else np.ones(len(rows), bool)
            if bucketed:
                keep &= _untested(left, right, rows, cols)
            rows, cols, distance = _strongest(
                rows[keep], cols[keep], distance[keep], part.start, (part.stop - part.start, theirs.rows), top_k)
            yield pa.table({"src": mine.ids[rows], "dst": theirs.ids[cols], "weight": 1.0 - distance})

    def tile(left: pa.Table, right: pa.Table, same: bool) -> Iterator[pa.Table]:
        """A table per stripe, so that no worker holds all edges of two blocks."""
        left, right = left.sort_by("id"), right.sort_by("id")
        yield from one_way(left, right, same)
        if not same:
            yield from one_way(right, left, same)

    return tile


def _edge_tile(threshold: float, time_weight: float, top_k: int | None, bucketed: bool):
    """The same edges as one table, for tiles that must give one."""
    stripes = _edge_stripes(threshold, time_weight, top_k, bucketed)
    return lambda left, right, same: pa.concat_tables(stripes(left, right, same))


def _held_edges(threshold: float, time_weight: float, top_k: int):
    def held(block: pa.Table, part: slice, others: Iterator[pa.Table]) -> pa.Table:
        """The ``top_k`` strongest edges of some rows of a block to all others; no more than twice as many are held."""
        mine = _Side(block)
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for other in others:
            theirs = _Side(other)
            step = max(1, STRIPE_CELLS // max(1, theirs.rows))
            found = [best]
            for at in range(part.start, part.stop, step):
                stripe = slice(at, min(at + step, part.stop))
                rows, cols, distance = _near(mine, stripe, theirs, threshold, time_weight)
                keep = mine.ids[rows] != theirs.ids[cols]
                rows, cols, distance = _strongest(
                    rows[keep], cols[keep], distance[keep], at, (stripe.stop - at, theirs.rows), top_k)
                found.append((rows, theirs.ids[cols], distance))
            rows, targets, distance = (np.concatenate(parts) for parts in zip(*found))
            order = np.lexsort((targets, -np.rint((1.0 - distance) * WEIGHT_SCALE), rows))
            rows, targets, distance = rows[order], targets[order], distance[order]
            keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < top_k
            best = rows[keep], targets[keep], distance[keep]
        return pa.table({"src": mine.ids[best[0]], "dst": best[1], "weight": 1.0 - best[2]})

    return held


def strongest_edges(edges: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """The ``top_k`` heaviest edges of each source; ties go to the smaller target."""
    order = Window.partitionBy("src").orderBy(F.desc(F.rint(F.col("weight") * WEIGHT_SCALE)), "dst")
    return edges.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= top_k).drop("_n")


def symmetrise(edges: DataFrame) -> DataFrame:
    """Add each missing back edge, which may take a node above the cap."""
    forth = F.struct("src", "dst")
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = edges.select(F.explode(F.array(forth, back)).alias("_e"), "weight").select("_e.src", "_e.dst", "weight")
    return both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def planes(count: int, width: int, seed: int = LSH_SEED) -> np.ndarray:
    """``count`` planes with components from -1 to 1, by whole-number arithmetic that any engine can repeat."""
    plane, place = np.arange(count, dtype=np.int64)[:, None], np.arange(1, width + 1, dtype=np.int64)[None, :]
    x = (plane * PLANE_STEP + place * PLACE_STEP + seed) % PRIME
    for _ in range(3):
        x = (x * x + PLANE_STEP) % PRIME
    return x / ((PRIME - 1) / 2) - 1


def signatures(vectors: DataFrame, bits: int = LSH_BITS, tables: int = LSH_TABLES, seed: int = LSH_SEED) -> DataFrame:
    """Add ``signatures``: per table, the sign bits against ``bits`` hyperplanes."""
    powers = 1 << np.arange(bits, dtype=np.int64)

    @F.arrow_udf("array<bigint>")
    def sign(column: pa.Array) -> pa.Array:
        points = matrix(column)
        positive = (points @ planes(tables * bits, points.shape[1], seed).T > 0).reshape(len(points), tables, bits)
        codes = positive @ powers
        return pa.ListArray.from_arrays(
            pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32)), pa.array(codes.ravel())
        )

    return vectors.withColumn("signatures", sign("vec"))


def bucketed(vectors: DataFrame, bits: int = LSH_BITS, tables: int = LSH_TABLES, seed: int = LSH_SEED) -> DataFrame:
    """One row per vector and table, ready for the bucket join."""
    signed = signatures(vectors, bits, tables, seed)
    return (
        signed.select("*", F.posexplode("signatures").alias("bucket_table", "_sig"))
        .withColumn("_cell", F.col("bucket_table").cast("bigint") * (1 << bits) + F.col("_sig"))
        .withColumn("_home", F.lit(True))
        .drop("_sig")
    )


def crowd_of_copies(vectors: DataFrame, top_k: int) -> tuple[DataFrame, DataFrame] | None:
    """Split off the copies that no node can have among its strongest edges.

    Of a vector stored more than ``top_k + 1`` times with one date only the
    smallest ids can be a target, since copies weigh the same and ties go to
    the smaller id. Returns (vectors to join, edges of the split-off copies),
    or None where no vector is stored that often.
    """
    marked = vectors.withColumn("_h", F.xxhash64("vec", "taken_at"))
    hot = marked.groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > top_k + 1)
    if hot.isEmpty():
        return None
    square = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)
    crowd = marked.join(hot.select("_h"), "_h", "left_semi").filter(square >= 1e-8)
    group = ["_h", "vec", "taken_at"]
    order = Window.partitionBy(*group).orderBy("id")
    anchors = crowd.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= top_k + 1)
    # A list of at most top_k ids per group.
    targets = (
        anchors.filter(F.col("_n") <= top_k).groupBy(*group)
        .agg(F.collect_list("id").alias("_targets"))
        .withColumnsRenamed({"vec": "_v", "taken_at": "_t"})
    )
    rest = crowd.join(anchors.select("id"), "id", "left_anti")
    edges = (
        rest.join(
            targets,
            (rest["_h"] == targets["_h"]) & (F.col("vec") == F.col("_v")) & F.col("taken_at").eqNullSafe(F.col("_t")),
        )
        .select(F.col("id").alias("src"), F.explode("_targets").alias("dst"))
        .withColumn("weight", F.lit(1.0))
    )
    return vectors.join(rest.select("id"), "id", "left_anti"), edges


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("vec").isNotNull()).select("id", "vec", "taken_at")


def _own_scratch(vectors: DataFrame, scratch: Scratch | None, work, label: str) -> DataFrame:
    """``work(scratch)``; without a scratch folder of the caller the result is written and what it took is dropped."""
    if scratch is not None:
        return work(scratch)
    own = Scratch(vectors.sparkSession, label)
    return own.finish(work(own))


def candidate_edges(
    vectors: DataFrame, threshold: float, time_weight: float = 0.0, top_k: int | None = TOP_K,
    strategy: str = "exact", bits: int = LSH_BITS, tables: int = LSH_TABLES, seed: int = LSH_SEED, scratch: Scratch | None = None,
) -> DataFrame:
    """Directed edges ``(src, dst, weight)`` of every pair nearer than ``threshold``.

    ``vectors``: id, vec, taken_at (null where undated). The distance is cosine
    distance plus the temporal penalty; the weight is 1 minus it. With ``exact``
    every pair is compared and a node keeps its ``top_k`` strongest edges, so no
    more than those are ever written; with ``lsh`` pairs that share a bucket are,
    and a node keeps so many per pair of chunks. With ``top_k=None`` every pair
    is an edge, and the result is as large as that.
    """
    if strategy not in ("exact", "lsh"):
        raise ValueError(f"unknown strategy {strategy!r}")
    vectors = _usable(vectors)

    def work(scratch: Scratch) -> DataFrame:
        split = crowd_of_copies(vectors, top_k) if threshold > 0 and top_k is not None else None
        joined, extra = split if split else (vectors, None)
        if strategy == "exact" and top_k is not None:
            edges = VectorBlocks(joined, scratch).gather(
                _held_edges(threshold, time_weight, top_k), EDGE_SCHEMA, nearer_than(threshold))
        elif strategy == "exact":
            tile = _edge_stripes(threshold, time_weight, top_k, False)
            edges = VectorBlocks(joined, scratch).compare(tile, EDGE_SCHEMA, nearer_than(threshold))
        else:
            tile = _edge_tile(threshold, time_weight, top_k, True)
            edges = run_tiles(bucketed(joined, bits, tables, seed), tile, EDGE_SCHEMA, few_cells=(tables << bits) <= 100_000)
        return edges if extra is None else edges.unionByName(extra)

    return _own_scratch(vectors, scratch, work, "edges")


def near_pairs(
    vectors: DataFrame, threshold: float, time_weight: float = 0.0, scratch: Scratch | None = None, strategy: str = "exact",
    bits: int = LSH_BITS, tables: int = LSH_TABLES, seed: int = LSH_SEED,
) -> DataFrame:
    """Every pair nearer than ``threshold`` once: ``(a, b, distance)`` with ``a < b``; with ``lsh`` those that share a bucket."""
    if strategy not in ("exact", "lsh"):
        raise ValueError(f"unknown strategy {strategy!r}")
    schema = "a bigint, b bigint, distance double"

    def tile(left: pa.Table, right: pa.Table, same: bool) -> Iterator[pa.Table]:
        """A table per stripe, so that no worker holds all pairs of two crowded blocks."""
        mine = _Side(left)
        theirs = mine if same else _Side(right)
        for part in mine.stripes(theirs.rows):
            rows, cols, distance = _near(mine, part, theirs, threshold, time_weight)
            a, b = mine.ids[rows], theirs.ids[cols]
            once = a < b if same else np.ones(len(a), bool)
            if strategy == "lsh":
                once &= _untested(left, right, rows, cols)
            a, b, distance = a[once], b[once], distance[once]
            yield pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "distance": distance})

    def work(scratch: Scratch) -> DataFrame:
        usable = _usable(vectors)
        if strategy == "lsh":
            return run_tiles(bucketed(usable, bits, tables, seed), tile, schema, few_cells=(tables << bits) <= 100_000)
        return VectorBlocks(usable, scratch).compare(tile, schema, nearer_than(threshold))

    return _own_scratch(vectors, scratch, work, "pairs")


def build_edges(
    vectors: DataFrame, threshold: float, time_weight: float = 0.0, top_k: int | None = TOP_K, strategy: str = "exact",
    scratch: Scratch | None = None, **options
) -> DataFrame:
    """Symmetric similarity graph: the strongest edges of each node (all, if ``top_k`` is None) and their back edges."""

    def work(scratch: Scratch) -> DataFrame:
        if top_k is None:
            # A pair is found once and is an edge both ways.
            forth, back = F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))
            pairs = near_pairs(vectors, threshold, time_weight, scratch, strategy, **options)
            return pairs.select(F.explode(F.array(forth, back)).alias("_e"), (1 - F.col("distance")).alias("weight")).select(
                "_e.src", "_e.dst", "weight")
        found = candidate_edges(vectors, threshold, time_weight, top_k, strategy, scratch=scratch, **options)
        # Exact edges are the strongest already.
        return symmetrise(found if strategy == "exact" else strongest_edges(found, top_k))

    return _own_scratch(vectors, scratch, work, "edges")


def degrees(vectors: DataFrame, threshold: float, time_weight: float = 0.0, scratch: Scratch | None = None) -> DataFrame:
    """Number of neighbours under the threshold, uncapped: ``(id, copies, degree)``.

    One row per distinct vector and date; ``copies`` is how often it is stored.
    """
    grouped = (
        vectors.filter(F.col("vec").isNotNull()).groupBy("vec", "taken_at")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
        .select("id", "vec", "taken_at", "copies")
    )

    def tile(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        """The matrix is made a stripe of rows at a time."""
        mine, theirs = left.column("copies").to_numpy(), right.column("copies").to_numpy()
        forth, back = np.zeros(left.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        one = _Side(left)
        other = one if same else _Side(right)
        for part in one.stripes(other.rows):
            rows, cols, _ = _near(one, part, other, threshold, time_weight)
            # Whole numbers below 2^53 are exact as weights; of a vector's own copies all but itself count.
            weights = theirs[cols] - (rows == cols) if same else theirs[cols]
            forth += np.bincount(rows, weights, left.num_rows).astype(np.int64)
            if not same:
                back += np.bincount(cols, mine[rows], right.num_rows).astype(np.int64)
        ids, counts = (_ids(left), forth) if same else (np.concatenate([_ids(left), _ids(right)]), np.concatenate([forth, back]))
        hit = counts > 0
        return pa.table({"id": ids[hit], "degree": counts[hit]})

    def work(scratch: Scratch) -> DataFrame:
        distinct = scratch.table(grouped, "distinct")
        parts = VectorBlocks(distinct, scratch).compare(tile, "id bigint, degree bigint", nearer_than(threshold))
        total = parts.groupBy("id").agg(F.sum("degree").alias("degree"))
        return distinct.select("id", "copies").join(total, "id", "left").select(
            "id", "copies", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))

    return _own_scratch(vectors, scratch, work, "degrees")


def bucket_links(
    vectors: DataFrame, threshold: float, bits: int = LSH_BITS, tables: int = LSH_TABLES, seed: int = LSH_SEED, scratch: Scratch | None = None
) -> DataFrame:
    """What the bucket join finds for each vector: ``(id, class_id, links, strongest, weakest)``.

    A link is a pair that shares a bucket and is nearer than ``threshold``; its weight is 1 minus the cosine distance. Links
    are counted where they are found, so the result has a row per vector, however many vectors lie together. Equal vectors are
    a class, named after its smallest id; one of them is joined and counts for all.
    """
    vectors = vectors.filter(F.col("vec").isNotNull()).select("id", "vec")
    no_date = F.lit(None).cast("bigint").alias("taken_at")
    grouped = vectors.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "vec", no_date, "copies")

    def tile(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        """The matrix is made a stripe of rows at a time."""
        mine, theirs = (t.column("copies").to_numpy() for t in (left, right))
        # Per row the number of links, the least and the greatest distance; of the right side only where it is another one.
        forth, back = ([np.zeros(n), np.full(n, np.inf), np.full(n, -np.inf)] for n in (len(mine), len(theirs)))
        one = _Side(left)
        other = one if same else _Side(right)

        def count(found: list, at: np.ndarray, weights: np.ndarray, distance: np.ndarray) -> None:
            found[0] += np.bincount(at, weights, len(found[0]))
            np.minimum.at(found[1], at, distance)
            np.maximum.at(found[2], at, distance)

        for part in one.stripes(other.rows):
            rows, cols, distance = _near(one, part, other, threshold, 0.0)
            keep = _untested(left, right, rows, cols)
            if same:
                # Of a vector's own copies all but itself count.
                keep &= (rows != cols) | (mine[rows] > 1)
            rows, cols, distance = rows[keep], cols[keep], distance[keep]
            count(forth, rows, theirs[cols] - (rows == cols) if same else theirs[cols], distance)
            if not same:
                count(back, cols, mine[rows], distance)
        sides = [(_ids(left), forth)] if same else [(_ids(left), forth), (_ids(right), back)]
        ids = np.concatenate([i for i, _ in sides])
        links, low, high = (np.concatenate([found[k] for _, found in sides]) for k in range(3))
        hit = links > 0
        return pa.table({"id": ids[hit], "links": links[hit].astype(np.int64), "low": low[hit], "high": high[hit]})

    def work(scratch: Scratch) -> DataFrame:
        distinct = scratch.table(grouped, "distinct")
        parts = run_tiles(
            bucketed(distinct, bits, tables, seed), tile, "id bigint, links bigint, low double, high double",
            few_cells=(tables << bits) <= 100_000, chunk_rows=BUCKET_ROWS)
        found = parts.groupBy(F.col("id").alias("class_id")).agg(
            F.sum("links").alias("links"), (1 - F.min("low")).alias("strongest"), (1 - F.max("high")).alias("weakest"))
        several = distinct.filter("copies > 1").select(F.col("id").alias("class_id"), F.col("vec").alias("_vec"))
        members = vectors.join(several, F.col("vec") == F.col("_vec")).select("id", "class_id").unionByName(
            distinct.filter("copies = 1").select("id", F.col("id").alias("class_id")))
        return members.join(found, "class_id", "left").select(
            "id", "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), "strongest", "weakest")

    return _own_scratch(vectors, scratch, work, "links")


def graph_diagnostics(vectors: DataFrame, threshold: float, time_weight: float = 0.0) -> DataFrame:
    """Nodes, pairs compared, edges under the threshold and nodes without any."""
    counted = degrees(vectors, threshold, time_weight)
    return counted.agg(
        F.sum("copies").alias("nodes"),
        F.expr("CAST(sum(copies) * (sum(copies) - 1) div 2 AS BIGINT)").alias("pairs"),
        F.expr("CAST(sum(copies * degree) div 2 AS BIGINT)").alias("edges"),
        F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("copies"))), F.lit(0)).alias("isolated"),
    )


def distance_histogram(distances: DataFrame, column: str = "distance") -> DataFrame:
    """Ten bins of width 0.1; values outside fall into the first or last bin."""
    bin_no = F.least(F.greatest(F.floor(F.col(column) * 10), F.lit(0)), F.lit(9)).cast("int")
    return distances.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def tested_pairs_histogram(
    vectors: DataFrame, bits: int = LSH_BITS, tables: int = LSH_TABLES, seed: int = LSH_SEED
) -> DataFrame:
    """Histogram of cosine distances over the pairs that share a bucket, counted in place."""

    def tile(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        points, others = matrix(left.column("vec")), matrix(right.column("vec"))
        counts, step = np.zeros(10, np.int64), max(1, STRIPE_CELLS // max(1, len(others)))
        for at in range(0, len(points), step):
            cosine = distance_matrix(points[at : at + step], others)
            rows, cols = np.nonzero(np.triu(np.ones(cosine.shape, bool), at + 1) if same else np.ones(cosine.shape, bool))
            first = _untested(left, right, at + rows, cols)
            bins = np.clip(np.trunc(cosine[rows[first], cols[first]] * 10), 0, 9).astype(np.int32)
            counts += np.bincount(bins, minlength=10)
        hit = np.flatnonzero(counts)
        return pa.table({"bin": hit.astype(np.int32), "n": counts[hit].astype(np.int64)})

    vectors = vectors.filter(F.col("vec").isNotNull()).select("id", "vec", "taken_at")
    cells = bucketed(vectors, bits, tables, seed)
    parts = run_tiles(cells, tile, "bin int, n bigint", few_cells=(tables << bits) <= 100_000)
    return parts.groupBy("bin").agg(F.sum("n").alias("n"))


def separation_report(vectors: DataFrame) -> DataFrame:
    """Do labelled vectors separate? ``vectors``: id, vec, label.

    Counts of same- and different-label pairs, the largest same-label and the
    smallest different-label distance, and whether the first is below the
    second. Blocks hold one label each. What every block finds within itself
    and what the manifest says of all pairs bounds both numbers; then only
    pairs of blocks that could beat the bounds are read.
    """
    vectors = vectors.filter(F.col("vec").isNotNull())
    sizes = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    counts = sizes.agg(
        F.expr("CAST(sum(m * (m - 1) div 2) AS BIGINT)").alias("same_pairs"),
        F.expr("CAST(sum(m) * (sum(m) - 1) div 2 - sum(m * (m - 1) div 2) AS BIGINT)").alias("different_pairs"),
    )
    # Copies change no extreme except that two of one label are at distance 0.
    distinct = vectors.groupBy("vec", "label").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    scratch = Scratch(vectors.sparkSession, "separation")
    blocks = VectorBlocks(scratch.table(distinct.select("id", "vec", "label", "copies"), "distinct"), scratch, mark="label")

    def farthest(left: pa.Table, right: pa.Table, same: bool) -> float:
        distance = distance_matrix(matrix(left.column("vec")), matrix(right.column("vec")))
        if same:
            lone = np.flatnonzero(left.column("copies").to_numpy() < 2)
            distance[lone, lone] = -1.0
        return float(distance.max())

    def nearest(left: pa.Table, right: pa.Table) -> float:
        return float(distance_matrix(matrix(left.column("vec")), matrix(right.column("vec"))).min())

    def row(kind: str, value: float | None) -> pa.Table:
        return pa.table({"kind": [kind], "d": pa.array([value], pa.float64())})

    def within(block: pa.Table, _name: str) -> pa.Table:
        top = farthest(block, block, True)
        return row("same", top if top >= -0.5 else None)

    schema = "kind string, d double"
    inner = scratch.table(blocks.each(within, schema), "inner").agg(F.max("d")).first()[0]
    high = -np.inf if inner is None else inner

    def one_label(left: pa.Table, right: pa.Table) -> np.ndarray:
        mine, theirs = (np.array(t.column("mark").to_pylist(), object) for t in (left, right))
        return mine[:, None] == theirs[None, :]

    def may_part(left: pa.Table, right: pa.Table) -> np.ndarray:
        others = np.array(left.column("block").to_pylist(), object)[:, None] != np.array(right.column("block").to_pylist(), object)[None, :]
        return one_label(left, right) & others & (most_distance(left, right) > high)

    # No vector is further from its block's own centre than the radius, so two blocks are at most this near apart.
    def reachable(left: pa.Table, right: pa.Table) -> np.ndarray:
        return np.where(one_label(left, right), np.inf, most_distance(left, right))

    low = blocks.least(reachable)

    def may_meet(left: pa.Table, right: pa.Table) -> np.ndarray:
        return ~one_label(left, right) & (least_distance(left, right) <= low)

    # Labels live in the files, too, so a pair knows which of the two questions it answers.
    def label_of(table: pa.Table):
        return table.column("label")[0].as_py()

    def compare(left: pa.Table, right: pa.Table, _same: bool) -> pa.Table:
        return row("same", farthest(left, right, False)) if label_of(left) == label_of(right) else row("different", nearest(left, right))

    found = blocks.compare(compare, schema, lambda a, b: may_part(a, b) | may_meet(a, b))
    both = found.agg(F.max(F.when(F.col("kind") == "same", F.col("d"))).alias("d"), F.min(F.when(F.col("kind") == "different", F.col("d"))).alias("min_different"))
    largest = F.greatest("d", F.lit(inner).cast("double")).alias("max_same")
    # Each side is one row by construction.
    out = counts.join(F.broadcast(both.select(largest, "min_different")), F.lit(True)).withColumn(
        "ok", F.col("max_same") < F.col("min_different"))
    return scratch.finish(out)
