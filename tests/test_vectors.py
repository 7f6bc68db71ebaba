"""Vector joins, matching and clustering against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from albumetrics.functions import temporal, vectors
from albumetrics.operators import graph, matching, similarity, vector_join
from albumetrics.operators.ranks import upper_median
from albumetrics.operators.representatives import representatives
from albumetrics.sources.workspace import drop_path, materialize, new_path

VECTOR_DDL = "id bigint, vec array<double>, taken_at bigint"


def frame(spark, matrix, taken=None):
    taken = [None] * len(matrix) if taken is None else taken
    rows = [(i, [float(x) for x in v], t) for i, (v, t) in enumerate(zip(matrix, taken, strict=True))]
    return materialize(spark.createDataFrame(rows, VECTOR_DDL), "test")


def distances(a, b):
    norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return np.where(norms < 1e-10, 1.0, 1 - a @ b.T / np.where(norms < 1e-10, 1, norms))


def clustered(n=300, dim=8, groups=6, noise=0.25, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return centres[np.arange(n) % groups] + noise * rng.normal(size=(n, dim))


def edges_of(df):
    return {(r.src, r.dst): r.weight for r in df.collect()}


@pytest.mark.parametrize("threshold", [0.02, 0.2, 0.9, 1.3])
def test_exact_edges_equal_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(vector_join, "ROWS_PER_PIVOT", 20)
    matrix = np.vstack([clustered(), np.zeros((2, 8))])
    d = distances(matrix, matrix)
    tile = similarity._edge_tile(threshold, 0.0, 10_000, False)
    placed = vector_join.place_self(frame(spark, matrix), threshold)
    found = edges_of(vector_join.run_tiles(placed, tile, similarity.EDGE_SCHEMA, chunk_rows=16))
    expected = {(i, j) for i, j in zip(*np.nonzero(d < threshold), strict=True) if i != j}
    assert set(found) == expected
    assert all(w == pytest.approx(1 - d[k]) for k, w in found.items())


def test_every_pair_comes_from_one_tile(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "ROWS_PER_PIVOT", 20)
    placed = vector_join.place_self(frame(spark, clustered()), 0.9)
    tile = similarity._edge_tile(0.9, 0.0, 10_000, False)
    rows = vector_join.run_tiles(placed, tile, similarity.EDGE_SCHEMA, chunk_rows=16)
    assert rows.count() == rows.select("src", "dst").distinct().count()


def test_top_k_and_back_edges(spark):
    matrix = clustered(n=60)
    d = distances(matrix, matrix)
    np.fill_diagonal(d, 9)
    top = {(i, int(j)) for i in range(60) for j in np.argsort(d[i], kind="stable")[:3] if d[i, j] < 0.9}
    found = set(edges_of(similarity.build_edges(frame(spark, matrix), 0.9, top_k=3)))
    assert found == top | {(j, i) for i, j in top}


def test_crowd_of_copies_loses_nothing(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 6))
    # A third of all rows are copies of one vector; half of those carry a date.
    matrix = np.vstack([base, np.repeat(base[:1], 40, axis=0), base[:1] + 0.05 * rng.normal(size=(20, 6))])
    taken = [None] * 12 + [None] * 20 + [10**12] * 20 + [None] * 20
    df = frame(spark, matrix, taken)
    assert similarity.crowd_of_copies(df, 5) is not None
    found = set(edges_of(similarity.build_edges(df, 0.5, 0.0, top_k=5)))
    d = np.round(distances(matrix, matrix), 12)
    np.fill_diagonal(d, 9)
    top = set()
    for i in range(len(d)):
        order = np.lexsort((np.arange(len(d)), d[i]))[:5]
        top |= {(i, int(j)) for j in order if d[i, j] < 0.5}
    # Copies with and without a date weigh the same, up to rounding.
    named = {(min(i, 99), min(j, 99)) for i, j in found ^ (top | {(j, i) for i, j in top})}
    assert all(abs(d[i, j]) < 1e-9 for i, j in named)
    degrees = {}
    for i, _j in found:
        degrees[i] = degrees.get(i, 0) + 1
    assert set(degrees) >= set(range(12, 52))


def test_temporal_penalty_removes_edges(spark):
    matrix = np.repeat([[1.0, 0.2]], 2, axis=0) + [[0, 0], [0, 0.4]]
    year = int(365.25 * 24 * 3600 * 1000)
    near = similarity.build_edges(frame(spark, matrix, [0, 1]), 0.3, 1.0)
    far = similarity.build_edges(frame(spark, matrix, [0, 30 * year]), 0.3, 1.0)
    assert near.count() == 2 and far.count() == 0


def test_lsh_edges_are_a_subset_with_high_recall(spark):
    matrix = clustered(n=400, dim=16, noise=0.15)
    df = frame(spark, matrix)
    exact = set(edges_of(similarity.build_edges(df, 0.3)))
    lsh = set(edges_of(similarity.build_edges(df, 0.3, strategy="lsh")))
    assert lsh <= exact and len(lsh) >= 0.9 * len(exact)


def test_lsh_tests_a_pair_once(spark):
    df = frame(spark, clustered(n=200, dim=8))
    tile = similarity._edge_tile(0.5, 0.0, 10_000, True)
    rows = vector_join.run_tiles(similarity.bucketed(df, bits=3, tables=4), tile, similarity.EDGE_SCHEMA, chunk_rows=16)
    assert rows.count() == rows.select("src", "dst").distinct().count()


def test_far_pairs_need_no_date_and_stripes_bound_the_matrix(monkeypatch):
    monkeypatch.setattr(similarity, "STRIPE_CELLS", 1000)
    dated, cells = [], []
    pairs, near = similarity.penalty_pairs, similarity._near
    monkeypatch.setattr(similarity, "penalty_pairs", lambda a, *rest: dated.append(a.size) or pairs(a, *rest))
    monkeypatch.setattr(similarity, "_near", lambda left, part, right, *rest: cells.append((part.stop - part.start) * right.rows) or near(left, part, right, *rest))
    matrix, taken = clustered(n=200), np.arange(200) * 10**10
    tables = [
        pa.table({"id": np.arange(200)[half], "vec": vectors.list_column(matrix[half]), "taken_at": taken[half]})
        for half in (slice(0, 90), slice(90, 200))]
    found = similarity._edge_tile(0.3, 0.25, 4, False)(*tables, False)
    d = distances(matrix[:90], matrix[90:])
    assert sum(dated) == 2 * (d < 0.3).sum() and max(cells) <= 1000
    d += temporal.penalty_matrix(taken[:90].astype(float), taken[90:].astype(float), 0.25, 0.3)
    forth = {(i, 90 + int(j)) for i in range(90) for j in np.argsort(d[i])[:4] if d[i, j] < 0.3}
    back = {(90 + j, int(i)) for j in range(110) for i in np.argsort(d[:, j])[:4] if d[i, j] < 0.3}
    assert set(zip(found["src"].to_pylist(), found["dst"].to_pylist(), strict=True)) == forth | back


def test_edges_leave_a_tile_a_stripe_at_a_time(monkeypatch):
    monkeypatch.setattr(similarity, "STRIPE_CELLS", 1000)
    matrix, held = clustered(n=200), []
    table = pa.table({"id": np.arange(200), "vec": vectors.list_column(matrix), "taken_at": pa.array([None] * 200, pa.int64())})
    strongest = similarity._strongest
    monkeypatch.setattr(similarity, "_strongest", lambda *args: held.append(1) or strongest(*args))
    sizes, parts = [], []
    for part in similarity._edge_stripes(0.3, 0.0, 4, False)(table.slice(0, 90), table.slice(90), False):
        # What was made is handed over before more is made.
        assert held.pop() == 1 and not held
        sizes.append(part.num_rows)
        parts.append(part)
    # Stripes of 9 rows against 110 and of 11 against 90, of at most 4 edges a row.
    assert len(sizes) == 20 and max(sizes) <= 44
    whole = similarity._edge_tile(0.3, 0.0, 4, False)(table.slice(0, 90), table.slice(90), False)
    assert pa.concat_tables(parts).equals(whole) and whole.num_rows > 44


@pytest.mark.parametrize("piece", [16, 4096])
def test_links_of_buckets_are_one_row_per_vector(spark, monkeypatch, piece):
    monkeypatch.setattr(similarity, "BUCKET_ROWS", piece)
    monkeypatch.setattr(similarity, "STRIPE_CELLS", 1000)
    matrix = clustered(n=150)
    matrix = np.vstack([matrix, np.repeat(matrix[:2], 30, axis=0), np.zeros((3, 8))])
    df = frame(spark, matrix)
    pairs = edges_of(similarity.build_edges(df, 0.5, top_k=None, strategy="lsh"))
    found = {r.id: r for r in similarity.bucket_links(df, 0.5).collect()}
    assert sorted(found) == list(range(len(matrix)))
    first = [int(np.flatnonzero((matrix == row).all(axis=1))[0]) for row in matrix]
    for i, row in found.items():
        weights = [w for (src, _dst), w in pairs.items() if src == i]
        assert (row.class_id, row.links) == (first[i], len(weights))
        assert (row.strongest, row.weakest) == ((pytest.approx(max(weights)), pytest.approx(min(weights))) if weights else (None, None))


def test_bucket_edges_are_all_pairs_both_ways(spark):
    """The query gives every pair that shares a bucket as two edges."""
    from registry import all_entries
    from registry.vectors import PLANTED_EDGE, _planted

    folder = "/root/testdata/sf0.001"
    edges = all_entries()["j16_bucket_edges"].run(spark, folder)
    found = {(r.src, r.dst): r.weight for r in edges.collect()}
    assert edges.columns == ["src", "dst", "weight"] and all(found[b, a] == weight for (a, b), weight in found.items())
    rows = similarity.signatures(_planted(spark, folder)).select("id", "vec", "signatures").collect()
    points, signed = np.array([r.vec for r in rows]), np.array([r.signatures for r in rows])
    near = (distances(points, points) < PLANTED_EDGE) & (signed[:, None, :] == signed[None, :, :]).any(axis=2)
    np.fill_diagonal(near, False)
    assert found.keys() == {(rows[a].id, rows[b].id) for a, b in np.argwhere(near)} and found


def test_scores_of_a_broadcast_gallery_hold_a_million_cells_at_most(monkeypatch):
    cells, adjusted = [], matching._adjusted
    monkeypatch.setattr(matching, "_adjusted", lambda q, d, v, *rest: cells.append(len(q) * len(v)) or adjusted(q, d, v, *rest))
    known, asked = clustered(n=2000), clustered(n=1500, seed=4)
    starts = np.arange(0, 2000, 20)

    class Shared:
        value = (starts + 7, starts, starts + 20, known, np.full(2000, np.nan), np.ones(2000))

    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(1500)), vectors.list_column(asked), pa.array([None] * 1500, pa.int64())], ["id", "vec", "taken_at"])
    found = pa.Table.from_batches(matching._score_batches(Shared, 1.0, 2.0, True)([batch]))
    assert max(cells) <= 1_000_000 and sum(cells) == 3_000_000
    d = np.sort(distances(asked, known).reshape(1500, 100, 20), axis=2)
    score = d[:, :, 0] + 0.5 * (d[:, :, 4] - d[:, :, 0])
    assert found["distance"].to_numpy() == pytest.approx(score.min(axis=1))


def test_nearest_profiles_and_centroids_hold_a_million_cells_at_most(monkeypatch):
    cells = []
    for module in (matching, graph):
        whole = module.distance_matrix
        monkeypatch.setattr(module, "distance_matrix", lambda a, b, whole=whole: cells.append(len(a) * len(b)) or whole(a, b))
    one, two = (
        pa.table({"id": np.arange(n) + first, "vec": vectors.list_column(points), "taken_at": pa.array([None] * n, pa.int64())})
        for n, first, points in ((1500, 0, clustered(n=1500, seed=4)), (2000, 5000, clustered(n=2000))))
    d = distances(vectors.matrix(one["vec"]), vectors.matrix(two["vec"]))
    found = pa.concat_tables(matching._nearest_rows(0.2, 0.0)(one, two))
    assert max(cells) <= 1_000_000 and sum(cells) == 3_000_000
    near = d.min(axis=1) < 0.2
    assert found["id"].to_pylist() == np.flatnonzero(near).tolist()
    assert found["distance"].to_numpy() == pytest.approx(d.min(axis=1)[near], abs=1e-9)
    cells.clear()
    low = graph._lowest(one, two, False)
    assert max(cells) <= 1_000_000 and sum(cells) == 3_000_000
    assert low["low"].to_numpy() == pytest.approx(np.r_[d.min(axis=1), d.min(axis=0)], abs=1e-9)
    own = distances(vectors.matrix(one["vec"]), vectors.matrix(one["vec"]))
    np.fill_diagonal(own, np.inf)
    low = graph._lowest(one, one, True)
    assert low["id"].to_pylist() == list(range(1500)) and low["low"].to_numpy() == pytest.approx(own.min(axis=1), abs=1e-9)


def test_weights_that_differ_by_rounding_are_ties(spark):
    noise = 2.0**-52 * np.arange(9, -1, -1)
    rows, cols = np.zeros(10, np.int64), np.arange(10)
    found = similarity._strongest(rows, cols, 0.25 + noise, 0, (1, 10), 3)
    assert sorted(found[1].tolist()) == [0, 1, 2]
    edges = spark.createDataFrame([(0, j, 1.0 - float(n)) for j, n in enumerate(noise, 1)], similarity.EDGE_SCHEMA)
    assert sorted(r.dst for r in similarity.strongest_edges(edges, 3).collect()) == [1, 2, 3]
    root = new_path(spark, "votes")
    votes = graph._bucketed_edges(edges, root, "albumetrics_votes_of_ties").filter("own = 0").select("vote").distinct().collect()
    spark.sql("DROP TABLE albumetrics_votes_of_ties")
    drop_path(spark, root)
    assert [r.vote for r in votes] == [graph.VOTE_SCALE]


def cluster_ids(spark, matrix, edge=0.3):
    nodes = frame(spark, matrix)
    found = graph.propagate(similarity.build_edges(nodes, edge), nodes)
    return dict(found.collect())


def test_clusters_of_two_groups(spark):
    groups = [[1, 0.01, 0], [1, 0.02, 0.01], [0.99, 0, 0.02], [0.01, 1, 0], [0.02, 1, 0.01], [0, 0.99, 0.02]]
    assert cluster_ids(spark, np.array(groups, float)) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}


def test_identical_orthogonal_single_and_empty(spark):
    assert set(cluster_ids(spark, np.ones((3, 3))).values()) == {0}
    assert cluster_ids(spark, np.eye(3)) == {0: 0, 1: 1, 2: 2}
    assert cluster_ids(spark, np.ones((1, 3))) == {0: 0}
    empty = spark.createDataFrame([], VECTOR_DDL)
    assert graph.propagate(similarity.build_edges(empty, 0.3), empty).count() == 0


def test_propagation_is_repeatable_and_partitions_the_nodes(spark):
    matrix = clustered(n=120, noise=0.5, seed=9)
    first, second = cluster_ids(spark, matrix, 0.4), cluster_ids(spark, matrix, 0.4)
    assert first == second and set(first) == set(range(120))
    for node, name in first.items():
        assert first[name] == name <= node


def gallery(spark, matrix, owners, taken, boosts):
    rows = [
        (1000 + i, int(o), f"P{o}", [float(x) for x in v], t, float(b))
        for i, (v, o, t, b) in enumerate(zip(matrix, owners, taken, boosts, strict=True))
    ]
    ddl = "id bigint, person_id bigint, person_name string, vec array<double>, taken_at bigint, boost double"
    return materialize(spark.createDataFrame(rows, ddl), "gallery")


def expected_scores(queries, dates, matrix, owners, taken, boosts, weight):
    out = {}
    for q in range(len(queries)):
        d = distances(queries[q : q + 1], matrix)[0]
        for i in range(len(matrix)):
            if weight > 0 and dates[q] and taken[i]:
                years = (dates[q] - taken[i]) / 31557600000
                d[i] -= 0.15 * weight * np.exp(-years * years / 18) * boosts[i]
        for p in np.unique(owners):
            mine = np.sort(d[owners == p])
            k = 1 if len(mine) <= 2 else 2 if len(mine) <= 5 else 3 if len(mine) <= 10 else 5
            out[(q, int(p))] = mine[0] + 0.5 * (mine[k - 1] - mine[0])
    return out


@pytest.mark.parametrize("limit", [1 << 30, 0])
@pytest.mark.parametrize("weight", [0.0, 1.0])
def test_person_distances_equal_brute_force(spark, monkeypatch, limit, weight):
    monkeypatch.setattr(vector_join, "ROWS_PER_PIVOT", 10)
    rng = np.random.default_rng(11)
    known = clustered(n=90, seed=4)
    # Persons of 1, 2, 4, 8 and very many faces.
    owners = np.repeat([1, 2, 3, 4, 5], [1, 2, 4, 8, 75])
    taken = [None if i % 7 == 0 else int(1e12 + 1e10 * (i % 30)) for i in range(90)]
    boosts = rng.uniform(0, 1, 90)
    asked = clustered(n=40, seed=8)
    dates = [None if i % 5 == 0 else int(1e12 + 2e10 * i) for i in range(40)]
    full = expected_scores(asked, dates, known, owners, taken, boosts, weight)
    args = (frame(spark, asked, dates), gallery(spark, known, owners, taken, boosts), weight, 0.8)
    found = {(r.id, r.person_id): r.distance for r in matching.person_distances(*args, broadcast_bytes=limit).collect()}
    assert set(found) == {k for k, v in full.items() if v < 0.8}
    assert all(v == pytest.approx(full[k]) for k, v in found.items())
    best = {r.id: (r.person_id, r.distance) for r in matching.best_person(*args, broadcast_bytes=limit).collect()}
    for q in range(40):
        low = min((v, p) for (i, p), v in full.items() if i == q)
        assert (q in best) == (low[0] < 0.8)
        if q in best:
            assert best[q][0] == low[1] and best[q][1] == pytest.approx(low[0])


def test_nearest_profile_paths_agree(spark):
    queries, profiles = frame(spark, clustered(n=30, seed=1)), frame(spark, clustered(n=50, seed=2))
    one = set(matching.nearest_profile(queries, profiles, 0.9, 0.0).select("id", "profile_id").collect())
    two = set(matching.nearest_profile(queries, profiles, 0.9, 0.0, broadcast_bytes=0).select("id", "profile_id").collect())
    assert one == two and one


def test_matching_without_a_gallery(spark):
    empty = gallery(spark, np.empty((0, 8)), [], [], [])
    assert matching.best_person(frame(spark, clustered(n=5)), empty, 1.0, 0.8).count() == 0


def test_separation_report(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "ROWS_PER_PIVOT", 20)
    matrix = clustered(n=120, noise=0.6)
    labels = np.arange(120) % 6
    rows = [(i, [float(x) for x in v], int(k)) for i, (v, k) in enumerate(zip(matrix, labels, strict=True))]
    df = materialize(spark.createDataFrame(rows, "id bigint, vec array<double>, label bigint"), "labels")
    row = similarity.separation_report(df).first()
    d = distances(matrix, matrix)
    upper = np.triu(np.ones_like(d, bool), 1)
    same = labels[:, None] == labels[None, :]
    assert row.same_pairs == (upper & same).sum() and row.different_pairs == (upper & ~same).sum()
    assert row.max_same == pytest.approx(d[upper & same].max())
    assert row.min_different == pytest.approx(d[upper & ~same].min())
    assert row.ok == (row.max_same < row.min_different)


def test_degrees_count_copies(spark):
    matrix = np.vstack([clustered(n=40), np.repeat(clustered(n=1, seed=2), 30, axis=0)])
    row = similarity.graph_diagnostics(frame(spark, matrix), 0.4).first()
    near = distances(matrix, matrix) < 0.4
    np.fill_diagonal(near, False)
    assert (row.nodes, row.pairs) == (70, 70 * 69 // 2)
    assert row.edges == near.sum() // 2 and row.isolated == (near.sum(axis=1) == 0).sum()


def test_upper_median(spark):
    rows = [(k, t) for k, ts in {1: [5, 1, 9], 2: [4, 8], 3: [7], 4: [-3, -3, 10**12, None]}.items() for t in ts]
    df = spark.createDataFrame(rows, "k bigint, t bigint")
    assert dict(upper_median(df, "k", "t").collect()) == {1: 5, 2: 8, 3: 7, 4: -3}


def test_coverage_and_cap(spark):
    stats = spark.createDataFrame([(i, s, True) for i, s in enumerate([9, 5, 5, 5, 2, 2])], "cluster_id bigint, size bigint, pure boolean")
    chosen = lambda n: sorted(r.cluster_id for r in graph.select_by_coverage(stats, n).collect())
    assert chosen(28) == [0, 1] and chosen(2) == [0] and chosen(36) == [0, 1, 2] and chosen(10**6) == [0, 1, 2, 3, 4, 5]
    counts = spark.createDataFrame([(1, 4), (2, 9), (3, 4), (4, 1)], "person_id bigint, face_count bigint")
    assert sorted(r.person_id for r in graph.suggestions_over_cap(counts, 2).collect()) == [3, 4]


def test_purity(spark):
    rows = [(1, 5, [1.0, 0.0], 0.1), (2, 5, [0.0, 1.0], 0.9), (3, 5, [1.0, 0.01], 0.0)]
    stats = spark.createDataFrame(rows, "cluster_id bigint, size bigint, centroid array<double>, spread double")
    assert {r.cluster_id: r.pure for r in graph.mark_pure(stats).collect()} == {1: False, 2: False, 3: True}
    assert all(r.pure for r in graph.mark_pure(stats.filter("cluster_id = 2")).collect())


def test_representative(spark):
    rows = [
        (1, 1, None, [1.0, 0.0], 0.5), (2, 1, None, [1.0, 0.1], 0.5), (3, 1, None, [1.0, 0.05], 0.5), (4, 1, None, [-1.0, 0.0], 0.5),
        (5, 2, None, [1.0, 0.0], 0.0), (6, 3, None, [1.0, 0.0], 0.5), (7, 3, None, [1.0, 0.0], 0.5),
        (8, 4, "N", [0.0, 1.0], 0.5), (9, 4, None, [1.0, 0.0], 0.9),
    ]
    faces = spark.createDataFrame(rows, "face_id bigint, person_id bigint, name string, embedding array<double>, quality_score double")
    found = dict(representatives(faces.withColumn("ignored", F.lit(False))).collect())
    assert found == {1: 3, 2: 5, 3: 6, 4: 8} or (found[1] in (1, 2, 3) and {k: found[k] for k in (2, 3, 4)} == {2: 5, 3: 6, 4: 8})


def test_centroid_of_a_hot_key_over_many_tasks(spark):
    rows = spark.range(0, 6000, 1, 40).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 500) END AS k",
        "array(CAST(id AS DOUBLE), CAST(id % 7 AS DOUBLE)) AS v", "CAST(id % 4 AS DOUBLE) AS w")
    got = {r.k: r for r in vectors.centroids(rows, "k", "v", F.col("w")).collect()}
    want = {}
    for r in rows.collect():
        want.setdefault(r.k, []).append((r.w, *r.v))
    assert got.keys() == want.keys()
    for key, members in want.items():
        total = sum(w for w, *_ in members)
        for i in (0, 1):
            mean = sum(m[0] * m[1 + i] for m in members) / total if total else sum(m[1 + i] for m in members) / len(members)
            assert abs(got[key].centroid[i] - mean) < 1e-6
        assert got[key].n == len(members)
