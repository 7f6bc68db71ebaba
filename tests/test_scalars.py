"""Distances, dates, quality, boxes and folders against known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from albumetrics.functions import dates, geometry, paths, quality, temporal, vectors

YEAR = int(temporal.YEAR_MS)


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_cosine_distance(spark):
    rows = [
        ([1.0, 2.0], [1.0, 2.0], 0.0), ([1.0, 2.0], [10.0, 20.0], 0.0), ([1.0, 0.0], [0.0, 3.0], 1.0),
        ([1.0, 1.0], [-2.0, -2.0], 2.0), ([0.0, 0.0], [1.0, 1.0], 1.0),
    ]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, d double")
    for row in df.select("d", vectors.cosine_distance("a", "b").alias("x"), vectors.cosine_distance("b", "a").alias("y")).collect():
        assert row.x == pytest.approx(row.d, abs=1e-9)
        assert row.x == pytest.approx(row.y, abs=1e-12)
    assert df.select(vectors.cosine_distance(F.lit(None).cast("array<double>"), "b")).first()[0] is None


@pytest.mark.parametrize(
    "rows,expected",
    [
        ([([0.0, 0.0], 3.0), ([4.0, 4.0], 1.0)], [1.0, 1.0]),
        ([([0.0, 0.0], 0.0), ([2.0, 6.0], 0.0)], [1.0, 3.0]),
        ([([2.0, 4.0], 1.0), ([4.0, 8.0], 1.0)], [3.0, 6.0]),
    ],
)
def test_centroid(spark, rows, expected):
    df = spark.createDataFrame([(1, v, w) for v, w in rows], "k int, v array<double>, w double")
    found = vectors.centroids(df, "k", "v", F.col("w")).collect()
    assert [(r.k, r.n) for r in found] == [(1, len(rows))]
    assert found[0].centroid == pytest.approx(expected, abs=1e-9)


def test_centroid_of_nothing(spark):
    df = spark.createDataFrame([], "k int, v array<double>")
    assert vectors.centroids(df, "k", "v").count() == 0


def test_spread_of_one_is_zero(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 0.0]), (2, [0.0, 1.0])], "k int, v array<double>")
    found = dict(vectors.spreads(df, vectors.centroids(df, "k", "v"), "k", "v").collect())
    assert found[1] == 0.0
    assert found[2] == pytest.approx(1 - math.sqrt(0.5))


def test_codec(spark):
    df = spark.createDataFrame([([0.5, -1.25, 3.0],), (None,)], "v array<double>")
    back = df.select(vectors.bytes_to_vector(vectors.vector_to_bytes("v"))).collect()
    assert [r[0] for r in back] == [[0.5, -1.25, 3.0], None]


def _penalty(spark, a, b, weight=1.0, reference=0.5):
    col = lambda v: F.lit(v).cast("bigint")
    return one(spark, temporal.penalty(col(a), col(b), weight, reference))[0]


def test_temporal_penalty(spark):
    assert _penalty(spark, 5, 5) == 0
    assert _penalty(spark, None, 5) == 0
    assert _penalty(spark, 5, 6, weight=0.0) == 0
    assert _penalty(spark, 1, 3 * YEAR + 1) == pytest.approx(0.25, abs=0.02)
    assert _penalty(spark, -YEAR, 0) > 0
    values = [_penalty(spark, 0, n * YEAR) for n in (1, 3, 5, 10, 100)]
    assert values == sorted(values) and values[-1] <= 0.5
    assert _penalty(spark, 0, 7 * YEAR) == _penalty(spark, 7 * YEAR, 0)
    assert _penalty(spark, 0, 100 * YEAR, weight=5.0) == 0.5


def test_temporal_bonus(spark):
    col = lambda v: F.lit(v).cast("bigint")
    same, early, none = one(
        spark, temporal.bonus(col(9), col(9), 1.0), temporal.bonus(col(0), col(9), 1.0), temporal.bonus(col(None), col(9), 1.0)
    )
    assert same == pytest.approx(0.15) and early == 0 and none == 0


def test_matrices_agree_with_columns(spark):
    a, b = np.array([1e12, np.nan, -5e11]), np.array([1.3e12, 9e11])
    pen, bon = temporal.penalty_matrix(a, b, 0.7, 0.6), temporal.bonus_matrix(a, b, 0.7)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            left = F.lit(None if x != x else int(x)).cast("bigint")
            row = one(spark, temporal.penalty(left, F.lit(int(y)), 0.7, 0.6), temporal.bonus(left, F.lit(int(y)), 0.7))
            assert row[0] == pytest.approx(pen[i, j]) and row[1] == pytest.approx(bon[i, j])


def _region(x=0.25, y=0.40, w=0.20, h=0.10, marks=None):
    landmarks = F.lit(None).cast("array<double>") if marks is None else F.array(*[F.lit(m) for m in marks])
    return F.struct(*[F.lit(v).alias(n) for n, v in zip("xywh", (x, y, w, h), strict=True)], landmarks.alias("landmarks"))


@pytest.mark.parametrize(
    "degrees,expected",
    [
        (0, (0.25, 0.40, 0.20, 0.10)), (90, (0.60, 0.25, 0.10, 0.20)), (180, (0.75, 0.60, 0.20, 0.10)),
        (270, (0.40, 0.75, 0.10, 0.20)), (-90, (0.40, 0.75, 0.10, 0.20)), (450, (0.60, 0.25, 0.10, 0.20)), (45, (0.25, 0.40, 0.20, 0.10)),
    ],
)
def test_rotate_region(spark, degrees, expected):
    out = one(spark, geometry.rotate_region(_region(marks=[0.1, 0.2]), F.lit(degrees)))[0]
    assert (out.x, out.y, out.w, out.h) == pytest.approx(expected)


def test_four_quarter_turns_change_nothing(spark):
    region = _region(marks=[0.1, 0.2, 0.3, 0.9])
    turned = region
    df = spark.range(1).select(turned.alias("r"))
    for _ in range(4):
        df = df.select(geometry.rotate_region(F.col("r"), F.lit(90)).alias("r"))
    out = df.first()[0]
    assert (out.x, out.y, out.w, out.h) == pytest.approx((0.25, 0.40, 0.20, 0.10))
    assert out.landmarks == pytest.approx([0.1, 0.2, 0.3, 0.9])


def test_orientation_codes(spark):
    cases = [(1, 90, 6), (6, 90, 3), (3, 90, 8), (8, 90, 1), (1, -90, 8), (2, 90, 6)]
    for code, delta, expected in cases:
        assert one(spark, geometry.rotate_orientation(F.lit(code), F.lit(delta)))[0] == expected


def test_quality_follows_the_formula(spark):
    small, middle = one(spark, quality.size_score(F.lit(0.1), F.lit(0.1)), quality.size_score(F.lit(0.25), F.lit(0.2)))
    assert small == pytest.approx(0.4013, abs=1e-3) and middle == pytest.approx(0.5)
    assert one(spark, quality.region_quality(F.lit(0.25), F.lit(0.2)))[0] == pytest.approx(0.5)
    assert one(spark, quality.match_boost(F.lit(0.8), F.lit(True)))[0] == 1.0


def test_sharpness(spark):
    flat, tiny = bytes([9] * 16), bytes([1, 2, 3, 4])
    checker = bytes([0 if (x + y) % 2 else 255 for y in range(4) for x in range(4)])
    df = spark.createDataFrame([(flat, 4), (tiny, 2), (checker, 4)], "d binary, n int")
    scores = [r[0] for r in df.select(quality.sharpness_score("d", "n", "n", F.lit(1))).collect()]
    assert scores[0] == 0 and scores[1] == 0.5 and scores[2] == pytest.approx(1.0)


def test_similarity_transform_recovers_a_known_one(spark):
    source = np.array([[0, 0], [2, 1], [1, 3], [4, 0], [2, 5.0]])
    a, b, tx, ty = 1.5, -0.5, 3.0, -2.0
    target = source @ np.array([[a, b], [-b, a]]) + [tx, ty]
    lit = lambda m: F.array(*[F.lit(float(v)) for v in m.ravel()])
    out = one(spark, geometry.similarity_transform(lit(source), lit(target)))[0]
    assert (out.a, out.b, out.tx, out.ty) == pytest.approx((a, b, tx, ty))
    assert one(spark, geometry.similarity_transform(lit(np.ones((5, 2))), lit(target)))[0] is None


def test_wrapped_roll_of_an_upright_face_is_zero(spark):
    anchors = spark.createDataFrame(
        [(1, 8, 0, 0.9, [1.0] * 4, [-1.0, 0.0, 1.0, 0.0, 0.0, 1.0, -1.0, 2.0, 1.0, 2.0], 640, 640)],
        "photo_id bigint, stride int, anchor int, score double, box array<double>, points array<double>, image_w int, image_h int",
    )
    plain = geometry.decode_anchors(anchors).first().rotation
    wrapped = geometry.decode_anchors(anchors, wrap_roll=True).first().rotation
    assert abs(plain) == pytest.approx(math.pi) and wrapped == pytest.approx(0)


def test_dates(spark):
    good, bad = one(spark, dates.parse_taken_at(F.lit("2021:03:04 05:06:07")), dates.parse_taken_at(F.lit("2021-03-04")))
    assert good == 1614834367000 and bad is None
    filled, kept = one(
        spark, dates.fill_taken_at(F.lit(None).cast("bigint"), F.lit(12345)), dates.fill_taken_at(F.lit(-5).cast("bigint"), F.lit(12345))
    )
    assert filled == 12000 and kept == -5
    assert one(spark, dates.month_key(F.lit(-1).cast("bigint")))[0] == "1969-12"


@pytest.mark.parametrize(
    "path,expected",
    [
        ("DCIM/Camera", "CAMERA"), ("DCIM", "CAMERA"), ("Pictures", "COMMON"), ("Pictures/ChatGPT", "COMMON"), ("Download", "COMMON"),
        ("Downloads/x", "COMMON"), ("Android/media/com.x", "APPS"), ("Android/data", "APPS"), ("PicturesX", "OTHER"), ("", "OTHER"),
        ("dcim/camera", "OTHER"), ("Music", "OTHER"),
    ],
)
def test_category(spark, path, expected):
    assert one(spark, paths.category(F.lit(path)))[0] == expected


def test_folder_sets(spark):
    names = ["Pictures", "Pictures/A", "Pictures/A/B", "PicturesX", "DCIM/Camera", "DCIM/Camera/2024/Jan"]
    df = spark.createDataFrame([(n,) for n in names], "folder string")
    assert sorted(r[0] for r in paths.minimise(df).collect()) == ["DCIM/Camera", "Pictures", "PicturesX"]
    assert paths.minimal(list(reversed(names))) == ["DCIM/Camera", "Pictures", "PicturesX"]
    chosen = paths.select_folder(df.filter("folder LIKE '%/%'"), "Pictures")
    assert sorted(r[0] for r in chosen.collect()) == ["DCIM/Camera", "DCIM/Camera/2024/Jan", "Pictures"]
    assert sorted(r[0] for r in paths.preselect(df).collect()) == ["DCIM/Camera"]
    other = spark.createDataFrame([("My camera",), ("My camera/x",), ("Music",)], "folder string")
    assert [r[0] for r in paths.preselect(other).collect()] == ["My camera"]


def test_whitelist_root(spark):
    roots = ["Pictures", "Pictures/A", "DCIM/Camera"]
    cols = [paths.whitelist_root(F.lit(p), roots) for p in ("Pictures/A/B", "PicturesX", "DCIM", "DCIM/Camera")]
    assert list(one(spark, *cols)) == ["Pictures", None, None, "DCIM/Camera"]
    assert one(spark, paths.whitelist_root(F.lit("Pictures"), []))[0] is None
