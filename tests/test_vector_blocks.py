"""Joins over blocks in files against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from albumetrics.operators import graph, matching, similarity, vector_blocks
from albumetrics.operators.vector_blocks import VectorBlocks, nearer_than
from albumetrics.sources import shared_files, workspace
from albumetrics.sources.workspace import Scratch, child_names, work_dir
from tests.test_vectors import clustered, distances, edges_of, frame


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK_ROWS", 24)
    monkeypatch.setattr(vector_blocks, "LEAST_ROWS", 24)


def odd_matrix():
    """Groups, copies, zero vectors and vectors of vanishing length."""
    rng = np.random.default_rng(2)
    matrix = clustered(n=240)
    return np.vstack([matrix, np.repeat(matrix[:1], 40, axis=0), np.zeros((3, 8)), 1e-6 * rng.normal(size=(3, 8)), 1e4 * matrix[:2]])


@pytest.mark.parametrize("shared", [2048, 3])
@pytest.mark.parametrize("threshold", [0.02, 0.3, 1.3])
def test_near_pairs_equal_brute_force(spark, monkeypatch, threshold, shared):
    monkeypatch.setattr(vector_blocks, "SHARED_BLOCKS", shared)
    matrix = odd_matrix()
    d = distances(matrix, matrix)
    rows = similarity.near_pairs(frame(spark, matrix), threshold).collect()
    found = {(r.a, r.b): r.distance for r in rows}
    assert len(found) == len(rows)
    assert set(found) == {(i, j) for i, j in zip(*np.nonzero(d < threshold), strict=True) if i < j}
    assert all(v == pytest.approx(d[k]) for k, v in found.items())


def test_bounds_hold_for_every_pair(spark):
    matrix = odd_matrix()
    scratch = Scratch(spark, "test")
    blocks = VectorBlocks(frame(spark, matrix), scratch)
    manifest = blocks.manifest.toArrow()
    low, high = vector_blocks.least_distance(manifest, manifest), vector_blocks.most_distance(manifest, manifest)
    names = manifest.column("block").to_pylist()
    members = [shared_files.read_table(n).column("id").to_numpy() for n in names]
    assert sorted(np.concatenate(members)) == list(range(len(matrix)))
    d = distances(matrix, matrix)
    for i, mine in enumerate(members):
        for j, theirs in enumerate(members):
            part = d[np.ix_(mine, theirs)]
            assert part.min() >= low[i, j] and part.max() <= high[i, j]
    scratch.drop()


def test_far_blocks_are_never_read(spark):
    scratch = Scratch(spark, "test")
    blocks = VectorBlocks(frame(spark, clustered(n=240, noise=0.05)), scratch)
    assert blocks.pairs(nearer_than(0.05)).count() <= blocks.count * (blocks.count + 1) // 4
    scratch.drop()


def test_top_k_edges_over_many_blocks(spark):
    matrix = clustered(n=200)
    d = distances(matrix, matrix)
    np.fill_diagonal(d, 9)
    top = {(i, int(j)) for i in range(200) for j in np.argsort(d[i], kind="stable")[:3] if d[i, j] < 0.9}
    assert set(edges_of(similarity.build_edges(frame(spark, matrix), 0.9, top_k=3))) == top | {(j, i) for i, j in top}


def test_large_gallery_equals_the_broadcast_one(spark):
    rng = np.random.default_rng(7)
    known, asked = clustered(n=150, seed=3), clustered(n=90, seed=3) + 0.3 * rng.normal(size=(90, 8))
    owners = np.minimum(rng.integers(0, 30, 150), 20)
    gallery = frame(spark, known).withColumn("person_id", F.element_at(F.array(*[F.lit(int(o)) for o in owners]), (F.col("id") + 1).cast("int")).cast("bigint"))
    gallery = gallery.withColumn("boost", F.lit(0.5))
    queries = frame(spark, asked)
    large = {(r.id, r.person_id): r.distance for r in matching.person_distances(queries, gallery, 0.4, 0.7, broadcast_bytes=0).collect()}
    small = {(r.id, r.person_id): r.distance for r in matching.person_distances(queries, gallery, 0.4, 0.7).collect()}
    assert set(large) == set(small) and all(v == pytest.approx(small[k]) for k, v in large.items())
    profiles = frame(spark, known)
    near = {r.id: (r.profile_id, r.distance) for r in matching.nearest_profile(queries, profiles, 0.5, 0.0, broadcast_bytes=0).collect()}
    d = distances(asked, known)
    want = {i: (int(row.argmin()), row.min()) for i, row in enumerate(d) if row.min() < 0.5}
    assert set(near) == set(want) and all(near[i][0] == want[i][0] for i in want)


def test_nearest_other_and_separation(spark):
    matrix = clustered(n=130, groups=40)
    stats = frame(spark, matrix).select(F.col("id").alias("cluster_id"), F.col("vec").alias("centroid"))
    d = distances(matrix, matrix)
    np.fill_diagonal(d, np.inf)
    low = dict(graph.nearest_other(stats).collect())
    assert low == {i: pytest.approx(v) for i, v in enumerate(d.min(axis=1))}
    assert graph.nearest_other(stats.limit(1)).first()["nearest_other"] is None
    labels = np.arange(130) % 6
    data = frame(spark, clustered(n=130)).withColumn("label", F.col("id") % 6)
    d = distances(clustered(n=130), clustered(n=130))
    np.fill_diagonal(d, np.nan)
    same = labels[:, None] == labels[None, :]
    report = similarity.separation_report(data).first()
    assert report.max_same == pytest.approx(np.nanmax(np.where(same, d, np.nan)))
    assert report.min_different == pytest.approx(np.nanmin(np.where(same, np.nan, d)))


def test_empty_tables_and_nothing_left_behind(spark):
    empty = spark.createDataFrame([], "id bigint, vec array<double>, taken_at bigint")
    assert similarity.near_pairs(empty, 0.5).count() == 0
    before = set(child_names(spark, f"{work_dir(spark)}/albumetrics"))
    similarity.build_edges(frame(spark, clustered(n=60)), 0.5)
    left = set(child_names(spark, f"{work_dir(spark)}/albumetrics")) - before
    # The table of the test and the result.
    assert sorted(n.rsplit("-", 1)[0] for n in left) == ["edges-result", "test"]


def test_locations():
    for uri in ("/tmp/x", "file:/tmp/x", "file:///tmp/x"):
        assert shared_files.locate(uri)[1] == "/tmp/x"


def test_exact_candidates_are_the_strongest_of_all_blocks(spark):
    """However many blocks a node meets, no more than its strongest edges are handed over, ties to the smaller id."""
    matrix = clustered(n=300)
    matrix = np.vstack([matrix, matrix[:3]])
    found = similarity.candidate_edges(frame(spark, matrix), 0.9, top_k=3).collect()
    weight = np.rint((1 - distances(matrix, matrix)) * similarity.WEIGHT_SCALE)
    near = distances(matrix, matrix) < 0.9
    np.fill_diagonal(near, False)
    want = set()
    for i in range(len(matrix)):
        others = sorted(np.flatnonzero(near[i]), key=lambda j: (-weight[i, j], j))
        want |= {(i, int(j)) for j in others[:3]}
    assert len(found) == len(want) and {(r.src, r.dst) for r in found} == want


def test_written_tables_leave_no_shuffle_files(spark):
    """Shuffle files of an intermediate table go when it is written, and its rows can still be computed again."""
    counted = spark.range(0, 20_000).groupBy((F.col("id") % 997).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with workspace.shuffles_dropped(spark):
        assert spark.conf.get(name) == "true"
        written = workspace.materialize(counted, "shuffles")
    assert spark.conf.get(name) == before
    assert written.agg(F.sum("n")).first()[0] == counted.agg(F.sum("n")).first()[0] == 20_000
