"""Nearest neighbours by inner product: a robust-pruned directed graph per shard, searched with a beam.

Vectors are dealt to shards of about ``SHARD_ROWS`` rows by a hash of their id, so copies of one vector spread evenly;
within a shard equal vectors are one node with many ids. To turn the largest inner product into the least distance,
each node gets one more coordinate that brings it to the longest norm of its shard.

A shard's graph is built by batches that double in size: a greedy search from the node nearest the mean proposes
neighbours; relaxed pruning goes through them by distance and drops a candidate ``c`` where a kept neighbour ``p`` has
``ALPHA * d(p, c) <= d(node, c)``, so long diverse edges stay; reverse edges are added and pruned the same way. The
index is a table in the shared folder, one row per shard.

Every query is searched in every shard of its dimension: a beam of ``BEAM`` nodes is widened by the neighbours of its best
unvisited members until all are visited. The beam is scored again in double precision on the original vectors, nodes
become ids, and the best of all shards remain. Queries are dealt in groups of ``QUERY_ROWS`` per shard, so a task holds
one shard and one group of queries, whatever the sizes of the tables.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids; rows of
one id count once, with the least vector; vectors are compared with those of their own dimension; a query with fewer
candidates gets all of them; ties go to the smaller id; empty tables give no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from albumetrics.llm.common import prepare
from albumetrics.sources.workspace import materialize

SHARD_ROWS = 8192
QUERY_ROWS = 8192
DEGREE = 32
BUILD_BEAM = 64
BEAM = 96
ALPHA = 1.2
EXPAND = 4
BATCH = 256


def usable(vector: Column) -> Column:
    """The vector has components, all of them finite numbers, and one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Graph:
    """The graph of one shard. ``points`` are the lifted nodes in single precision."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray | None = None, start: int = 0):
        norms = (vectors * vectors).sum(axis=1)
        lift = np.sqrt(np.maximum(norms.max() - norms, 0))
        self.points = np.column_stack([vectors, lift]).astype(np.float32)
        self.start = start
        self.edges = edges
        if edges is None:
            self._build()

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of each query's final beam, best first (-1 where there are fewer), and their products."""
        rows, n = len(queries), len(self.points)
        beam = min(beam, n)
        ids = np.full((rows, beam), -1, np.int64)
        sims = np.full((rows, beam), -np.inf, np.float32)
        done = np.zeros((rows, beam), bool)
        seen = np.zeros((rows, n), bool)
        ids[:, 0] = self.start
        sims[:, 0] = queries @ self.points[self.start]
        seen[:, self.start] = True
        active = np.arange(rows)
        while len(active):
            open_ = (ids[active] >= 0) & ~done[active]
            more = open_.any(axis=1)
            active, open_ = active[more], open_[more]
            if not len(active):
                break
            pick = open_ & (np.cumsum(open_, axis=1) <= EXPAND)
            at = np.nonzero(pick)
            owner = active[at[0]]
            nodes = ids[owner, at[1]]
            done[owner, at[1]] = True
            near = self.edges[nodes].astype(np.int64)
            key = (at[0][:, None] * np.int64(n) + near)[near >= 0]
            key = np.unique(key)
            line, node = key // n, key % n
            fresh = ~seen[active[line], node]
            line, node = line[fresh], node[fresh]
            if not len(line):
                continue
            query = active[line]
            seen[query, node] = True
            found = np.einsum("ij,ij->i", self.points[node], queries[query])
            counts = np.bincount(line, minlength=len(active))
            width = int(counts.max())
            place = np.arange(len(line)) - np.repeat(np.cumsum(counts) - counts, counts)
            new_ids = np.full((len(active), width), -1, np.int64)
            new_sims = np.full((len(active), width), -np.inf, np.float32)
            new_ids[line, place] = node
            new_sims[line, place] = found
            all_ids = np.concatenate([ids[active], new_ids], axis=1)
            all_sims = np.concatenate([sims[active], new_sims], axis=1)
            all_done = np.concatenate([done[active], np.zeros_like(new_ids, bool)], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[active] = np.take_along_axis(all_ids, order, axis=1)
            sims[active] = np.take_along_axis(all_sims, order, axis=1)
            done[active] = np.take_along_axis(all_done, order, axis=1)
        return ids, sims

    def _distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances between groups of points [rows, i, d] and [rows, j, d]; all points have one norm."""
        products = np.matmul(a, b.transpose(0, 2, 1))
        return np.sqrt(np.maximum(2 * (self._norm - products), 0))

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Kept neighbours [rows, DEGREE] out of candidates [rows, c]; -1 fills up."""
        out = np.full((len(nodes), DEGREE), -1, np.int32)
        for first in range(0, len(nodes), 64):
            own, cand = nodes[first:first + 64], candidates[first:first + 64]
            alive = (cand >= 0) & (cand != own[:, None])
            points = self.points[np.maximum(cand, 0)]
            to_node = self._distances(points, self.points[own][:, None, :])[:, :, 0]
            order = np.argsort(np.where(alive, to_node, np.inf), axis=1, kind="stable")
            cand, to_node, alive = (np.take_along_axis(x, order, axis=1) for x in (cand, to_node, alive))
            points = np.take_along_axis(points, order[:, :, None], axis=1)
            between = ALPHA * self._distances(points, points)
            rows = np.arange(len(own))
            for k in range(DEGREE):
                best = alive.argmax(axis=1)
                live = alive[rows, best]
                if not live.any():
                    break
                out[first + rows[live], k] = cand[rows[live], best[live]]
                alive &= (between[rows, best] > to_node) | ~live[:, None]
                alive[rows, best] = False
        return out

    def _build(self) -> None:
        n = len(self.points)
        self._norm = np.float32((self.points[0] * self.points[0]).sum())
        self.edges = np.full((n, DEGREE), -1, np.int32)
        degree = np.zeros(n, np.int64)
        self.start = int(np.argmax(self.points @ self.points.mean(axis=0)))
        order = np.random.default_rng(n).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]])
        at, size = 1, 1
        while at < n:
            batch = order[at:at + size]
            found, _ = self.search(self.points[batch], BUILD_BEAM)
            # Members of one batch do not see each other through the graph; the few nearest of them are proposed too.
            if len(batch) > 1:
                close = self.points[batch] @ self.points[batch].T
                np.fill_diagonal(close, -np.inf)
                own = batch[np.argsort(-close, axis=1)[:, :16]]
                found = np.concatenate([found, own], axis=1)
            kept = self._prune(batch, found)
            self.edges[batch] = kept
            degree[batch] = (kept >= 0).sum(axis=1)
            self._add_reverse(batch, kept, degree)
            at += len(batch)
            size = min(2 * size, BATCH)

    def _add_reverse(self, batch: np.ndarray, kept: np.ndarray, degree: np.ndarray) -> None:
        line, column = np.nonzero(kept >= 0)
        target, source = kept[line, column].astype(np.int64), batch[line]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        unique, counts = np.unique(target, return_counts=True)
        place = np.arange(len(target)) - np.repeat(np.cumsum(counts) - counts, counts)
        fits = degree[unique] + counts <= DEGREE
        room = np.repeat(fits, counts)
        self.edges[target[room], (degree[target] + place)[room]] = source[room]
        degree[unique[fits]] += counts[fits]
        full = unique[~fits]
        # Nodes with many new edges are pruned apart, so that padding stays small.
        for low, high in ((0, 32), (32, 128), (128, 1 << 30)):
            chosen = (counts > low) & (counts <= high) & ~fits
            nodes = unique[chosen]
            if not len(nodes):
                continue
            width = int(counts[chosen].max())
            extra = np.full((len(nodes), width), -1, np.int64)
            mine = np.isin(target, nodes)
            extra[np.searchsorted(nodes, target[mine]), place[mine]] = source[mine]
            pruned = self._prune(nodes, np.concatenate([self.edges[nodes], extra], axis=1))
            self.edges[nodes] = pruned
            degree[nodes] = (pruned >= 0).sum(axis=1)
        assert (degree[full] <= DEGREE).all()


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(rows, -1)


INDEX_DDL = "dim int, shard int, start int, vectors binary, edges binary, borders binary, ids binary"


def _build_shard(table: pa.Table) -> pa.Table:
    ids = table.column("vec_id").to_numpy()
    vectors = _matrix(table.column("vector"), len(ids)) + 0.0
    nodes, member = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, member.ravel()))
    borders = np.concatenate([[0], np.cumsum(np.bincount(member.ravel(), minlength=len(nodes)))])
    graph = Graph(nodes)
    return pa.table({
        "dim": pa.array([table.column("dim")[0].as_py()], pa.int32()),
        "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
        "start": pa.array([graph.start], pa.int32()), "vectors": [nodes.astype("<f8").tobytes()],
        "edges": [graph.edges.astype("<i4").tobytes()], "borders": [borders.astype("<i8").tobytes()],
        "ids": [ids[order].astype("<i8").tobytes()],
    })


class Index:
    """The shards' table and, for each dimension, how many shards it has."""

    def __init__(self, shards: DataFrame, sizes: dict[int, int]):
        self.shards, self.sizes = shards, sizes


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return rows.withColumn("dim", F.size("vector"))


def build(vectors: DataFrame, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    prepare(vectors.sparkSession)
    rows = _clean(vectors, id_col, vector_col)
    found = rows.groupBy("dim").agg(F.count("*").alias("n")).collect()
    sizes = {r["dim"]: -(-r["n"] // shard_rows) for r in found}
    count = F.lit(1)
    for dim, n in sorted(sizes.items()):
        count = F.when(F.col("dim") == dim, F.lit(n)).otherwise(count)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), count).cast("int"))
    shards = dealt.groupBy("dim", "shard").applyInArrow(_build_shard, INDEX_DDL)
    return Index(materialize(shards, "graph-index"), sizes)


RESULT_DDL = "query_id long, vec_id long, score double"


def _search_shard(k: int, beam: int, shard: pa.Table, queries: pa.Table) -> pa.Table:
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if shard.num_rows and queries.num_rows:
        row = shard.slice(0, 1).to_pylist()[0]
        nodes = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
        borders, ids = np.frombuffer(row["borders"], "<i8"), np.frombuffer(row["ids"], "<i8")
        graph = Graph(nodes, np.frombuffer(row["edges"], "<i4").reshape(-1, DEGREE), row["start"])
        query_ids = queries.column("query_id").to_numpy()
        asked = _matrix(queries.column("vector"), len(query_ids))
        flat = np.column_stack([asked, np.zeros(len(asked))]).astype(np.float32)
        for first in range(0, len(query_ids), BATCH):
            found, _ = graph.search(flat[first:first + BATCH], max(beam, k + 1))
            for j, near in enumerate(found):
                near = near[near >= 0]
                scores = (nodes[near] * asked[first + j]).sum(axis=1)
                own = query_ids[first + j]
                # The first ids of a node suffice: k of others and the query's own.
                members = [(s, i) for s, v in zip(scores, near) for i in ids[borders[v]:min(borders[v + 1], borders[v] + k + 1)]]
                best = sorted((-s, i) for s, i in members if i != own)[:k]
                out["query_id"] += [own] * len(best)
                out["vec_id"] += [i for _, i in best]
                out["score"] += [-s for s, _ in best]
    return pa.table({
        "query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
        "score": pa.array(out["score"], pa.float64()),
    })


def nearest(index: Index, queries: DataFrame, k: int = 20, beam: int = BEAM, query_rows: int = QUERY_ROWS,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` largest products found for each query row."""
    spark = prepare(queries.sparkSession)
    if not index.sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = _clean(queries, id_col, vector_col).withColumnRenamed("vec_id", "query_id")
    groups = max(1, -(-rows.count() // query_rows))
    shards = F.create_map(*(F.lit(x) for pair in sorted(index.sizes.items()) for x in pair))
    asked = rows.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), shards[F.col("dim")] - 1)))
    held = index.shards.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    keys = ("dim", "shard", "group")
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(partial(_search_shard, k, beam), RESULT_DDL)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
