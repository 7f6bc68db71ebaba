"""Column functions: distances, dates, quality, boxes, detector output."""

from __future__ import annotations

from pyspark.sql import functions as F

from albumetrics.functions import dates, geometry, quality, temporal, vectors
from albumetrics.operators import boxes, matching
from registry import fixtures as fx
from registry import register
from registry.fixtures import bonus, cosd, penalty, sql

# --- distances and time -------------------------------------------------------------

_PAIR_SQL = """pairs AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS va, CAST(b.embedding AS DOUBLE[]) AS vb
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def _vector_pairs(spark, sf):
    table = fx.table(spark, sf, "embeddings").selectExpr("vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS va")
    after = table.select((F.col("vec_id") - 1).alias("vec_id"), F.col("va").alias("vb"))
    return table.join(after, "vec_id")


@register("e01_cosine_distance", sql(f"SELECT vec_id, round({cosd('va', 'vb')}, 6) AS d FROM pairs", extra=_PAIR_SQL))
def _(spark, sf):
    pairs = _vector_pairs(spark, sf)
    return pairs.select("vec_id", F.round(vectors.cosine_distance("va", "vb"), 6).alias("d"))


_NEIGHBOUR_SQL = """near AS (SELECT a.photo_id, a.taken_at AS ta, b.taken_at AS tb FROM photos a JOIN photos b ON b.photo_id = a.photo_id + 1)"""


def _photo_pairs(spark, sf):
    photos = fx.photos(spark, sf)
    after = photos.select((F.col("photo_id") - 1).alias("photo_id"), F.col("taken_at").alias("tb"))
    return photos.select("photo_id", F.col("taken_at").alias("ta")).join(after, "photo_id")


@register(
    "e02_temporal_penalty",
    sql(f"SELECT photo_id, round({penalty('ta', 'tb', 1.0, 0.64)}, 6) AS p FROM near", "photos", extra=_NEIGHBOUR_SQL),
)
def _(spark, sf):
    p = temporal.penalty(F.col("ta"), F.col("tb"), 1.0, 0.64)
    return _photo_pairs(spark, sf).select("photo_id", F.round(p, 6).alias("p"))


@register(
    "e03_temporal_bonus",
    sql(f"SELECT photo_id, round({bonus('ta', 'tb', 1.0)}, 6) AS b FROM near", "photos", extra=_NEIGHBOUR_SQL),
)
def _(spark, sf):
    return _photo_pairs(spark, sf).select(
        "photo_id", F.round(temporal.bonus(F.col("ta"), F.col("tb"), 1.0), 6).alias("b")
    )


@register(
    "e04_adjusted_distance",
    sql(
        """SELECT face_id, round(least(coalesce(quality_score, 0.5) * CASE WHEN name IS NOT NULL THEN 1.5 ELSE 1.0 END, 1.0), 6) AS boost,
        round(0.5 - 0.15 * least(coalesce(quality_score, 0.5) * CASE WHEN name IS NOT NULL THEN 1.5 ELSE 1.0 END, 1.0), 6) AS adjusted FROM faces""",
        "faces",
    ),
)
def _(spark, sf):
    boost = quality.match_boost(F.col("quality_score"), F.col("name").isNotNull())
    return fx.faces(spark, sf).select(
        "face_id", F.round(boost, 6).alias("boost"), F.round(F.lit(0.5) - 0.15 * boost, 6).alias("adjusted")
    )


@register(
    "e05_adaptive_k",
    "SELECT user_id, n, CAST(CASE WHEN n <= 2 THEN 1 WHEN n <= 5 THEN 2 WHEN n <= 10 THEN 3 ELSE 5 END AS INTEGER) AS k "
    "FROM (SELECT user_id, event_type, count(*) // 3 AS n FROM events GROUP BY user_id, event_type)",
)
def _(spark, sf):
    sizes = fx.table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.floor(F.count(F.lit(1)) / 3).cast("bigint").alias("n")
    )
    return sizes.select("user_id", "n", matching.adaptive_k(F.col("n")).alias("k"))


# --- quality ---------------------------------------------------------------------------

_ROT_SQL = "CASE WHEN face_id % 11 = 0 THEN NULL ELSE CAST(face_id % 13 - 6 AS DOUBLE)/10 END"
_SIZE_SQL = "(1/(1+exp(-10.0*(least(greatest(w*h,0.0),1.0)-0.05))))"
_FRONT_SQL = "exp(-(r*r)/0.245)"


def _rotated(spark, sf):
    return fx.faces(spark, sf).withColumn(
        "r", F.expr("CASE WHEN face_id % 11 = 0 THEN NULL ELSE CAST(face_id % 13 - 6 AS DOUBLE)/10 END")
    )


@register(
    "e06_region_quality",
    sql(
        f"""SELECT face_id, round(least(greatest(0.40*{_SIZE_SQL} + 0.35*coalesce({_FRONT_SQL}, 0.5) + 0.25*0.5, 0.0), 1.0), 6) AS q
        FROM (SELECT *, {_ROT_SQL} AS r FROM faces)""",
        "faces",
    ),
)
def _(spark, sf):
    q = quality.region_quality(F.col("region.w"), F.col("region.h"), F.col("r"))
    return _rotated(spark, sf).select("face_id", F.round(q, 6).alias("q"))


@register("e07_size_score", sql(f"SELECT face_id, round({_SIZE_SQL}, 6) AS s FROM faces", "faces"))
def _(spark, sf):
    s = quality.size_score(F.col("region.w"), F.col("region.h"))
    return fx.faces(spark, sf).select("face_id", F.round(s, 6).alias("s"))


@register("e08_frontality", sql(f"SELECT face_id, round({_FRONT_SQL}, 6) AS s FROM (SELECT face_id, {_ROT_SQL} AS r FROM faces)", "faces"))
def _(spark, sf):
    return _rotated(spark, sf).select("face_id", F.round(quality.frontal_score(F.col("r")), 6).alias("s"))


# Each vector read as an eight by eight grey image.
@register(
    "e09_sharpness",
    """WITH px AS (SELECT vec_id, i, CAST(floor(least(greatest((embedding[i+1] + 1) * 127.5, 0), 255)) AS DOUBLE) AS g
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings), range(0, 64) t(i)),
    lap AS (SELECT c.vec_id, (u.g + d.g + l.g + r.g - 4 * c.g) AS v FROM px c
      JOIN px u ON u.vec_id = c.vec_id AND u.i = c.i - 8 JOIN px d ON d.vec_id = c.vec_id AND d.i = c.i + 8
      JOIN px l ON l.vec_id = c.vec_id AND l.i = c.i - 1 JOIN px r ON r.vec_id = c.vec_id AND r.i = c.i + 1
      WHERE c.i % 8 BETWEEN 1 AND 6 AND c.i // 8 BETWEEN 1 AND 6)
    SELECT vec_id, round(1 - exp(-avg(v*v)/200.0), 6) AS s FROM lap GROUP BY vec_id""",
)
def _(spark, sf):
    image = fx.table(spark, sf, "embeddings").selectExpr(
        "vec_id",
        """unhex(array_join(transform(CAST(embedding AS ARRAY<DOUBLE>), v ->
          lpad(hex(CAST(floor(least(greatest((v + 1) * 127.5D, 0D), 255D)) AS INT)), 2, '0')), '')) AS data""",
    )
    score = quality.sharpness_score(F.col("data"), F.lit(8), F.lit(8), F.lit(1))
    return image.select("vec_id", F.round(score, 6).alias("s"))


@register(
    "e10_quality_blend",
    sql("SELECT face_id, round(coalesce(quality_score, w)*0.667 + w*0.333, 6) AS q FROM faces", "faces"),
)
def _(spark, sf):
    blended = quality.blend_quality(F.col("quality_score"), F.col("region.w"))
    return fx.faces(spark, sf).select("face_id", F.round(blended, 6).alias("q"))


# --- boxes -----------------------------------------------------------------------------------

_TURNS = (-90, 0, 45, 90, 180, 270, 450)


@register(
    "e11_rotate_region",
    sql(
        """SELECT face_id, deg, round(CASE t WHEN 90 THEN 1-y WHEN 180 THEN 1-x WHEN 270 THEN y ELSE x END, 6) AS x,
          round(CASE t WHEN 90 THEN x WHEN 180 THEN 1-y WHEN 270 THEN 1-x ELSE y END, 6) AS y,
          CASE WHEN t IN (90, 270) THEN h ELSE w END AS w, CASE WHEN t IN (90, 270) THEN w ELSE h END AS h,
          round(CASE t WHEN 90 THEN 1-landmarks[10] WHEN 180 THEN 1-landmarks[9] WHEN 270 THEN landmarks[10] ELSE landmarks[9] END, 6) AS mouth_x,
          round(CASE t WHEN 90 THEN landmarks[9] WHEN 180 THEN 1-landmarks[10] WHEN 270 THEN 1-landmarks[9] ELSE landmarks[10] END, 6) AS mouth_y
        FROM (SELECT faces.*, deg, ((deg % 360) + 360) % 360 AS t FROM faces, (VALUES (-90),(0),(45),(90),(180),(270),(450)) v(deg))""",
        "faces",
    ),
)
def _(spark, sf):
    turned = (
        fx.faces(spark, sf)
        .withColumn("deg", F.explode(F.array(*[F.lit(t) for t in _TURNS])))
        .withColumn("n", geometry.rotate_region(F.col("region"), F.col("deg")))
    )
    return turned.select(
        "face_id", "deg", F.round("n.x", 6).alias("x"), F.round("n.y", 6).alias("y"), "n.w", "n.h",
        F.round(F.col("n.landmarks")[8], 6).alias("mouth_x"), F.round(F.col("n.landmarks")[9], 6).alias("mouth_y"),
    )


@register(
    "e12_orientation_code",
    """SELECT event_id, CAST(CASE d WHEN 90 THEN 6 WHEN 180 THEN 3 WHEN 270 THEN 8 ELSE 1 END AS INTEGER) AS code
    FROM (SELECT event_id, (CASE event_id % 9 WHEN 6 THEN 90 WHEN 3 THEN 180 WHEN 8 THEN 270 ELSE 0 END
      + CASE WHEN event_id % 2 = 0 THEN 90 ELSE -90 END + 360) % 360 AS d FROM events)""",
)
def _(spark, sf):
    delta = F.when(F.col("event_id") % 2 == 0, 90).otherwise(-90)
    code = geometry.rotate_orientation(F.col("event_id") % 9, delta)
    return fx.table(spark, sf, "events").select("event_id", code.alias("code"))


_IOU_SQL = """CASE WHEN aw*ah + qw*qh - greatest(least(ax+aw,qx+qw)-greatest(ax,qx),0.0)*greatest(least(ay+ah,qy+qh)-greatest(ay,qy),0.0) <= 0 THEN 0.0
 ELSE greatest(least(ax+aw,qx+qw)-greatest(ax,qx),0.0)*greatest(least(ay+ah,qy+qh)-greatest(ay,qy),0.0)
  / (aw*ah + qw*qh - greatest(least(ax+aw,qx+qw)-greatest(ax,qx),0.0)*greatest(least(ay+ah,qy+qh)-greatest(ay,qy),0.0)) END"""


@register(
    "e13_iou",
    sql(
        f"""SELECT face_id, round({_IOU_SQL}, 6) AS iou FROM (
        SELECT a.face_id, a.x-a.w/2 AS ax, a.y-a.h/2 AS ay, a.w AS aw, a.h AS ah, b.x-b.w/2 AS qx, b.y-b.h/2 AS qy, b.w AS qw, b.h AS qh
        FROM faces a JOIN faces b ON b.face_id = a.face_id + 1)""",
        "faces",
    ),
)
def _(spark, sf):
    faces = fx.faces(spark, sf).selectExpr("face_id", "region.x", "region.y", "region.w", "region.h")
    after = faces.selectExpr("face_id - 1 AS face_id", "x AS bx", "y AS by", "w AS bw", "h AS bh")
    corner = (F.col("bx") - F.col("bw") / 2, F.col("by") - F.col("bh") / 2, F.col("bw"), F.col("bh"))
    iou = geometry.iou_centre_corner((F.col("x"), F.col("y"), F.col("w"), F.col("h")), corner)
    return faces.join(after, "face_id").select("face_id", F.round(iou, 6).alias("iou"))


_DETECTION_SQL = """detections AS (SELECT face_id AS detection_id, photo_id, 800 + face_id % 5 * 100 AS image_w, 600 + face_id % 3 * 100 AS image_h,
  (x - w/2) * 0.97 AS nx, (y - h/2) * 0.98 AS ny, w * 1.05 AS nw, h * 0.95 AS nh, landmarks FROM faces WHERE face_id % 6 <> 0)"""


def _detections(spark, sf):
    """Normalised detector boxes close to, but not equal to, the stored regions."""
    return fx.faces(spark, sf).filter("face_id % 6 <> 0").selectExpr(
        "face_id AS detection_id", "photo_id", "800 + face_id % 5 * 100 AS image_w", "600 + face_id % 3 * 100 AS image_h",
        "(region.x - region.w/2) * 0.97D AS x_min", "(region.y - region.h/2) * 0.98D AS y_min",
        "region.w * 1.05D AS width", "region.h * 0.95D AS height", "region.landmarks AS landmarks",
    )


@register(
    "e14_normalise_box",
    sql(
        """SELECT detection_id, round((nx*image_w + nw*image_w/2)/image_w, 6) AS x, round((ny*image_h + nh*image_h/2)/image_h, 6) AS y,
        round(nw*image_w/image_w, 6) AS w, round(nh*image_h/image_h, 6) AS h,
        round(landmarks[3]*image_w/image_w, 6) AS eye_x, round(landmarks[4]*100/image_h, 6) AS eye_y FROM detections""",
        "faces", extra=_DETECTION_SQL,
    ),
)
def _(spark, sf):
    pixels = _detections(spark, sf).selectExpr(
        "detection_id", "image_w", "image_h", "x_min*image_w AS x_min", "y_min*image_h AS y_min", "width*image_w AS width",
        "height*image_h AS height", "transform(landmarks, (v,i) -> v * CASE WHEN i % 2 = 0 THEN image_w ELSE 100 END) AS landmarks",
    )
    box = geometry.normalise_box(*[F.col(c) for c in ("x_min", "y_min", "width", "height", "landmarks", "image_w", "image_h")])
    return pixels.withColumn("n", box).select(
        "detection_id", *[F.round(f"n.{c}", 6).alias(c) for c in "xywh"],
        F.round(F.col("n.landmarks")[2], 6).alias("eye_x"), F.round(F.col("n.landmarks")[3], 6).alias("eye_y"),
    )


@register(
    "e15_parse_taken_at",
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000 END AS taken_at FROM events""",
)
def _(spark, sf):
    text = F.when(F.col("event_id") % 10 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(
        F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    )
    return fx.table(spark, sf, "events").select("event_id", dates.parse_taken_at(text).alias("taken_at"))


@register(
    "e16_fill_taken_at",
    sql("SELECT photo_id, coalesce(taken_at, (modified_at // 1000) * 1000) AS taken_at FROM photos", "photos"),
)
def _(spark, sf):
    return fx.photos(spark, sf).select(
        "photo_id", dates.fill_taken_at(F.col("taken_at"), F.col("modified_at")).alias("taken_at")
    )


# --- detector output ------------------------------------------------------------------------------

def _cells(spark, sf):
    base = fx.table(spark, sf, "embeddings").selectExpr("vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS v")
    return base.selectExpr(
        "vec_id", "vec_id % 50 AS photo_id", "CASE vec_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS stride",
        "vec_id % 19 AS row", "vec_id % 17 AS col", "0.7D + v[0] AS cls", "0.8D + v[1] AS obj",
        "array(v[2], v[3], v[4]*4, v[5]*4) AS box", "slice(v, 7, 10) AS points", "0.5D AS scale", "10 AS dx", "20 AS dy",
        "900 AS image_w", "700 AS image_h",
    )


_CELL_SQL = """cells AS (SELECT vec_id, vec_id % 50 AS photo_id, CASE vec_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS stride,
  vec_id % 19 AS r, vec_id % 17 AS c, CAST(0.7 AS DOUBLE) + v[1] AS cls, CAST(0.8 AS DOUBLE) + v[2] AS obj, v[3] AS b0, v[4] AS b1, v[5]*4 AS b2, v[6]*4 AS b3,
  v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))"""


@register(
    "e18_grid_decode",
    sql(
        """SELECT photo_id, round(score, 6) AS score, round(x, 6) AS x_min, round(y, 6) AS y_min, round(least(w, 900 - x), 6) AS width,
          round(least(h, 700 - y), 6) AS height, round(least(greatest(((c + v[7])*stride - 10)/0.5, 0.0), 900.0), 6) AS eye_x,
          round(least(greatest(((r + v[16])*stride - 20)/0.5, 0.0), 700.0), 6) AS mouth_y
        FROM (SELECT *, sqrt(greatest(cls, 0.0)*greatest(obj, 0.0)) AS score,
          least(greatest(((c + b0)*stride - exp(b2)*stride/2 - 10)/0.5, 0.0), 900.0) AS x,
          least(greatest(((r + b1)*stride - exp(b3)*stride/2 - 20)/0.5, 0.0), 700.0) AS y,
          exp(b2)*stride/0.5 AS w, exp(b3)*stride/0.5 AS h FROM cells)
        WHERE score >= 0.6 AND least(w, 900 - x) > 1 AND least(h, 700 - y) > 1""",
        extra=_CELL_SQL,
    ),
)
def _(spark, sf):
    found = geometry.decode_grid_cells(_cells(spark, sf))
    return found.select(
        "photo_id", *[F.round(c, 6).alias(c) for c in ("score", "x_min", "y_min", "width", "height")],
        F.round(F.col("landmarks")[0], 6).alias("eye_x"), F.round(F.col("landmarks")[9], 6).alias("mouth_y"),
    )


def _anchors(spark, sf, photo="vec_id % 20"):
    base = fx.table(spark, sf, "embeddings").selectExpr("vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS v")
    return base.selectExpr(
        f"{photo} AS photo_id", "CASE vec_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS stride",
        "vec_id % 701 AS anchor", "0.6D + v[0] AS score",
        "transform(slice(v, 2, 4), x -> 2D + 8D * abs(x)) AS box", "slice(v, 7, 10) AS points",
        "1280 AS image_w", "960 AS image_h",
    )


_ANCHOR_SQL = """placed AS (SELECT vec_id % 20 AS photo_id, stride, CAST(0.6 AS DOUBLE) + v[1] AS score,
   ((vec_id % 701 // 2) % (640 // stride)) * stride AS cx, ((vec_id % 701 // 2) // (640 // stride)) * stride AS cy,
   2 + 8*abs(v[2]) AS b0, 2 + 8*abs(v[3]) AS b1, 2 + 8*abs(v[4]) AS b2, 2 + 8*abs(v[5]) AS b3, v
   FROM (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS stride, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)),
 found AS (SELECT *, least(greatest((cx - b0*stride)*2, 0.0), 1280.0) AS l, least(greatest((cy - b1*stride)*1.5, 0.0), 960.0) AS t,
   least(greatest((cx + b2*stride)*2, 0.0), 1280.0) AS rt, least(greatest((cy + b3*stride)*1.5, 0.0), 960.0) AS bt FROM placed WHERE score >= 0.5)"""


@register(
    "e19_anchor_decode",
    sql(
        """SELECT photo_id, round(score, 6) AS score, round(l, 6) AS x_min, round(t, 6) AS y_min, round(rt - l, 6) AS width, round(bt - t, 6) AS height,
          round(atan2((v[8] - v[10])*stride, (v[7] - v[9])*stride), 6) AS rotation,
          round(least(greatest((cx + v[9]*stride)*2, 0.0), 1280.0), 6) AS left_eye_x FROM found""",
        extra=_ANCHOR_SQL,
    ),
)
def _(spark, sf):
    found = geometry.decode_anchors(_anchors(spark, sf))
    return found.select(
        "photo_id", *[F.round(c, 6).alias(c) for c in ("score", "x_min", "y_min", "width", "height", "rotation")],
        F.round(F.col("landmarks")[2], 6).alias("left_eye_x"),
    )


# Target positions of the five points in an aligned 112-pixel crop.
_TARGET = (38.2946, 51.6963, 73.5318, 51.5014, 56.0252, 71.7366, 41.5493, 92.3655, 70.7299, 92.2041)
_PAIRS_SQL = ", ".join(f"({i}, {_TARGET[2 * i]}, {_TARGET[2 * i + 1]})" for i in range(5))


@register(
    "e20_similarity_transform",
    f"""WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[2*i+1] AS sx, CAST(embedding AS DOUBLE[])[2*i+2] AS sy, CAST(dx AS DOUBLE) AS dx, CAST(dy AS DOUBLE) AS dy
      FROM embeddings, (VALUES {_PAIRS_SQL}) t(i, dx, dy)),
    m AS (SELECT vec_id, avg(sx) AS mx, avg(sy) AS my, avg(dx) AS nx, avg(dy) AS ny FROM p GROUP BY vec_id),
    s AS (SELECT vec_id, sum((sx-mx)*(dx-nx) + (sy-my)*(dy-ny)) / sum((sx-mx)*(sx-mx) + (sy-my)*(sy-my)) AS a,
      sum((sx-mx)*(dy-ny) - (sy-my)*(dx-nx)) / sum((sx-mx)*(sx-mx) + (sy-my)*(sy-my)) AS b FROM p JOIN m USING (vec_id) GROUP BY vec_id)
    SELECT vec_id, round(a, 5) AS a, round(b, 5) AS b, round(nx - (a*mx - b*my), 5) AS tx, round(ny - (b*mx + a*my), 5) AS ty FROM s JOIN m USING (vec_id)""",
)
def _(spark, sf):
    base = fx.table(spark, sf, "embeddings").selectExpr("vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS v")
    fit = geometry.similarity_transform(F.col("v"), F.array(*[F.lit(float(t)) for t in _TARGET]))
    return base.withColumn("t", fit).select("vec_id", *[F.round(f"t.{c}", 5).alias(c) for c in ("a", "b", "tx", "ty")])


@register(
    "e21_crop_rectangle",
    sql(
        """SELECT face_id, CAST(trunc(l) AS INTEGER) AS "left", CAST(trunc(t) AS INTEGER) AS top,
          CAST(trunc(r) AS INTEGER) - CAST(trunc(l) AS INTEGER) AS width, CAST(trunc(b) AS INTEGER) - CAST(trunc(t) AS INTEGER) AS height,
          CAST(trunc(sl) AS INTEGER) AS sq_left, CAST(trunc(st) AS INTEGER) AS sq_top,
          CAST(trunc(least(sl + side, 801.0) - sl) AS INTEGER) AS sq_width, CAST(trunc(least(st + side, 607.0) - st) AS INTEGER) AS sq_height
        FROM (SELECT *, greatest((pl + pr)/2 - side/2, 0.0) AS sl, greatest((pt + pb)/2 - side/2, 0.0) AS st FROM (
          SELECT *, greatest(pr - pl, pb - pt) AS side FROM (
          SELECT face_id, greatest(x*801 - w*801/2, 0.0) AS l, greatest(y*607 - h*607/2, 0.0) AS t,
          least(x*801 + w*801/2, 801.0) AS r, least(y*607 + h*607/2, 607.0) AS b,
          greatest(x*801 - w*801/2 - (w*801/2)*0.1, 0.0) AS pl, greatest(y*607 - h*607/2 - (h*607/2)*0.1, 0.0) AS pt,
          least(x*801 + w*801/2 + (w*801/2)*0.1, 801.0) AS pr, least(y*607 + h*607/2 + (h*607/2)*0.1, 607.0) AS pb FROM faces)))""",
        "faces",
    ),
)
def _(spark, sf):
    sized = fx.faces(spark, sf).select(
        "face_id",
        geometry.crop_rectangle(F.col("region"), F.lit(801), F.lit(607)).alias("c"),
        geometry.square_crop(F.col("region"), F.lit(801), F.lit(607)).alias("s"),
    )
    return sized.select(
        "face_id", "c.left", "c.top", "c.width", "c.height", *[F.col(f"s.{n}").alias(f"sq_{n}") for n in ("left", "top", "width", "height")]
    )


@register(
    "j13_best_overlap",
    sql(
        f"""SELECT face_id AS region_id, round(iou, 6) AS iou, detection_id, round(landmarks[1], 6) AS eye_x FROM faces LEFT JOIN (
          SELECT face_id, iou, detection_id, dl AS landmarks FROM (
          SELECT face_id, detection_id, dl, {_IOU_SQL} AS iou FROM (
            SELECT f.face_id, d.detection_id, d.landmarks AS dl, f.x-f.w/2 AS ax, f.y-f.h/2 AS ay, f.w AS aw, f.h AS ah,
              d.nx AS qx, d.ny AS qy, d.nw AS qw, d.nh AS qh FROM faces f JOIN detections d USING (photo_id) WHERE d.landmarks IS NOT NULL))
          WHERE iou > 0.3 QUALIFY row_number() OVER (PARTITION BY face_id ORDER BY iou DESC, detection_id) = 1) m USING (face_id)""".replace("round(landmarks[1], 6)", "round(m.landmarks[1], 6)"),
        "faces", extra=_DETECTION_SQL,
    ),
)
def _(spark, sf):
    regions = fx.faces(spark, sf).select(F.col("face_id").alias("region_id"), "photo_id", "region")
    found = boxes.best_overlap(regions, _detections(spark, sf))
    return found.select("region_id", F.round("iou", 6).alias("iou"), "detection_id", F.round(F.col("landmarks")[0], 6).alias("eye_x"))


_SUPPRESS_SQL = f"""WITH RECURSIVE {_ANCHOR_SQL.replace("SELECT vec_id % 20 AS photo_id,", "SELECT vec_id, vec_id % 20 AS photo_id,")},
 ranked AS (SELECT photo_id, vec_id AS box_id, score, l, t, rt - l AS w, bt - t AS h,
   row_number() OVER (PARTITION BY photo_id ORDER BY score DESC, vec_id) AS n FROM found),
 settled AS (SELECT photo_id, n, [{{'box_id': box_id, 'score': score, 'l': l, 't': t, 'w': w, 'h': h}}] AS kept FROM ranked WHERE n = 1
   UNION ALL SELECT s.photo_id, r.n, CASE WHEN len(list_filter(s.kept, lambda k:
     greatest(0.0, least(k.l + k.w, r.l + r.w) - greatest(k.l, r.l)) * greatest(0.0, least(k.t + k.h, r.t + r.h) - greatest(k.t, r.t))
     / nullif(k.w*k.h + r.w*r.h - greatest(0.0, least(k.l + k.w, r.l + r.w) - greatest(k.l, r.l)) * greatest(0.0, least(k.t + k.h, r.t + r.h) - greatest(k.t, r.t)), 0) > 0.4)) > 0
     THEN s.kept ELSE list_append(s.kept, {{'box_id': r.box_id, 'score': r.score, 'l': r.l, 't': r.t, 'w': r.w, 'h': r.h}}) END
   FROM settled s JOIN ranked r ON r.photo_id = s.photo_id AND r.n = s.n + 1),
 last AS (SELECT photo_id, unnest(kept) AS k FROM settled QUALIFY n = max(n) OVER (PARTITION BY photo_id))
SELECT photo_id, k.box_id AS box_id, round(k.score, 6) AS score FROM last"""


@register("w06_suppression", _SUPPRESS_SQL)
def _(spark, sf):
    # The decoder hands the photo on, so the row is named there first.
    found = geometry.decode_anchors(_anchors(spark, sf, "vec_id"))
    found = found.withColumn("box_id", F.col("photo_id")).withColumn("photo_id", F.col("box_id") % 20)
    return boxes.suppress(found, 0.4).select("photo_id", "box_id", F.round("score", 6).alias("score"))
