"""Matching and thinning of boxes on the same photo."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumetrics.functions.geometry import iou_centre_corner, iou_corner
from albumetrics.sources.workspace import drop_path, new_path

MIN_OVERLAP = 0.3
GROUP_LIMIT = 20_000
CROWD = 1_000


def _cells(df: DataFrame, crowded: DataFrame, low_x, low_y, width, height) -> DataFrame:
    """One row per grid cell a box touches.

    Only photos listed in ``crowded`` are cut into cells, as wide as their
    average box; every other photo is a single cell.
    """
    pitch = F.coalesce("_pitch", F.lit(float("inf")))

    def touched(low, size):
        first = F.floor(low / pitch)
        return F.explode(F.sequence(first, F.greatest(first, F.floor((low + size) / pitch))))

    return (
        df.join(crowded, "photo_id", "left")
        .withColumn("_cx", touched(low_x, width))
        .withColumn("_cy", touched(low_y, height))
    )


def _crowded(boxes: DataFrame, limit: int) -> DataFrame:
    return (
        boxes.groupBy("photo_id")
        .agg(
            F.count(F.lit(1)).alias("_boxes"),
            F.greatest(F.avg(F.greatest("width", "height")), F.lit(1e-6)).alias("_pitch"),
        )
        .filter(F.col("_boxes") > limit)
        .select("photo_id", "_pitch")
    )


def best_overlap(
    regions: DataFrame, detections: DataFrame, min_iou: float = MIN_OVERLAP, crowd: int = CROWD
) -> DataFrame:
    """Give each region the landmarks of the detected box on its photo that overlaps it most.

    ``regions``: region_id, photo_id, region. ``detections``: photo_id,
    detection_id, x_min, y_min, width, height (normalised), landmarks. A region
    that nothing overlaps by more than ``min_iou`` keeps null landmarks; ties go
    to the smaller detection_id. Copies of a box are compared once.
    """
    geometry = ["x_min", "y_min", "width", "height"]
    found = (
        detections.filter("landmarks IS NOT NULL")
        .groupBy("photo_id", *geometry)
        .agg(F.min_by(F.struct("detection_id", "landmarks"), "detection_id").alias("_d"))
    )
    flat = regions.select(
        "region_id", "photo_id", *[F.col(f"region.{c}").alias(f"_{c}") for c in "xywh"]
    )
    crowded = _crowded(found, crowd)
    box = [F.col(f"_{c}") for c in "xywh"]
    left = _cells(
        flat.drop("region_id").distinct(), crowded, box[0] - box[2] / 2, box[1] - box[3] / 2, box[2], box[3]
    ).drop("_pitch")
    right = _cells(found, crowded, *[F.col(c) for c in geometry]).drop("_pitch")
    overlap = iou_centre_corner(tuple(box), tuple(F.col(c) for c in geometry))
    best = (
        left.join(right, ["photo_id", "_cx", "_cy"])
        .withColumn("iou", overlap)
        .filter(F.col("iou") > min_iou)
        .groupBy("photo_id", "_x", "_y", "_w", "_h")
        .agg(
            F.max_by(F.struct("iou", "_d"), F.struct("iou", -F.col("_d.detection_id"))).alias("_m")
        )
    )
    matched = flat.join(best, ["photo_id", "_x", "_y", "_w", "_h"]).select(
        "region_id", "_m.iou", "_m._d.detection_id", "_m._d.landmarks"
    )
    return regions.join(matched, "region_id", "left")


def _greedy(boxes: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows survive, for rows sorted by descending score."""
    left, top, width, height = boxes.T
    right, bottom, area = left + width, top + height, width * height
    alive = np.ones(len(boxes), bool)
    for i in range(len(boxes)):
        if not alive[i]:
            continue
        w = np.maximum(0.0, np.minimum(right[i], right[i + 1 :]) - np.maximum(left[i], left[i + 1 :]))
        h = np.maximum(0.0, np.minimum(bottom[i], bottom[i + 1 :]) - np.maximum(top[i], top[i + 1 :]))
        inter = w * h
        union = area[i] + area[i + 1 :] - inter
        iou = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
        alive[i + 1 :] &= iou <= threshold
    return alive


def suppress(
    boxes: DataFrame, iou_threshold: float, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """Greedy suppression per photo: by score, drop later boxes that overlap a kept one.

    ``boxes``: photo_id, box_id, x_min, y_min, width, height, score; ties in
    score go to the smaller box_id. A detector yields a bounded number of boxes
    per photo and those are thinned photo by photo; a photo above
    ``group_limit`` boxes is settled by joins instead, never in one task.
    """
    # Of equal boxes only the best can survive: what drops it drops the others too.
    geometry = ["x_min", "y_min", "width", "height"]
    rank = F.struct("score", -F.col("box_id"))
    solid = boxes.filter("width > 0 AND height > 0").groupBy("photo_id", *geometry).agg(
        F.max_by(F.struct("box_id", "score"), rank).alias("_b")
    ).select("photo_id", *geometry, "_b.box_id", "_b.score")
    flat = boxes.filter("NOT (width > 0 AND height > 0)")
    distinct = solid.unionByName(flat.select(*solid.columns))
    large = _crowded(distinct, group_limit).select("photo_id")
    normal = distinct.join(large, "photo_id", "left_anti")

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "box_id"], ascending=[False, True], kind="stable")
        alive = _greedy(pdf[["x_min", "y_min", "width", "height"]].to_numpy(float), iou_threshold)
        return pdf.loc[alive, ["photo_id", "box_id"]]

    id_type = boxes.schema["photo_id"].dataType.simpleString()
    kept = (
        normal.select("photo_id", "box_id", "x_min", "y_min", "width", "height", "score")
        .groupBy("photo_id")
        .applyInPandas(thin, f"photo_id {id_type}, box_id bigint")
    )
    if not large.isEmpty():
        crowded = distinct.join(large, "photo_id", "left_semi")
        kept = kept.unionByName(suppress_by_rounds(crowded, iou_threshold))
    return boxes.join(kept, ["photo_id", "box_id"], "left_semi")


def suppress_by_rounds(boxes: DataFrame, iou_threshold: float) -> DataFrame:
    """The same survivors by joins, for photos with any number of boxes.

    Overlapping boxes meet in the cells of a grid over the photo. A box with no
    stronger undecided neighbour is kept, its weaker neighbours go; repeat.
    """
    spark = boxes.sparkSession
    geometry = ["x_min", "y_min", "width", "height"]
    gridded = _cells(boxes, _crowded(boxes, 0), *[F.col(c) for c in geometry])
    left = gridded.select(
        "photo_id", "_cx", "_cy", "_pitch", F.col("box_id").alias("strong"), F.col("score").alias("_s"),
        *[F.col(c).alias(f"_a_{c}") for c in geometry],
    )
    right = gridded.select(
        "photo_id", "_cx", "_cy", F.col("box_id").alias("weak"), F.col("score").alias("_t"),
        *[F.col(c).alias(f"_b_{c}") for c in geometry],
    )
    overlap = iou_corner(
        tuple(F.col(f"_a_{c}") for c in geometry), tuple(F.col(f"_b_{c}") for c in geometry)
    )
    stronger = (F.col("_s") > F.col("_t")) | (
        (F.col("_s") == F.col("_t")) & (F.col("strong") < F.col("weak"))
    )
    # A pair that shares several cells counts only in the first of them.
    first_x = F.floor(F.greatest("_a_x_min", "_b_x_min") / F.col("_pitch")) == F.col("_cx")
    first_y = F.floor(F.greatest("_a_y_min", "_b_y_min") / F.col("_pitch")) == F.col("_cy")
    root = new_path(spark, "suppress")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    pairs = stored(
        left.join(right, ["photo_id", "_cx", "_cy"])
        .filter(stronger & first_x & first_y & (overlap > iou_threshold))
        .select("photo_id", "strong", "weak"),
        "pairs-0",
    )
    state = stored(boxes.select("photo_id", "box_id", F.lit(None).cast("boolean").alias("kept")), "state-0")
    step = 0
    while True:
        step += 1
        open_boxes = state.filter("kept IS NULL").select("photo_id", "box_id")
        blocked = pairs.select("photo_id", F.col("weak").alias("box_id"))
        winners = open_boxes.join(blocked, ["photo_id", "box_id"], "left_anti").withColumn("_win", F.lit(True))
        losers = (
            pairs.join(winners.select("photo_id", F.col("box_id").alias("strong")), ["photo_id", "strong"], "left_semi")
            .select("photo_id", F.col("weak").alias("box_id")).distinct().withColumn("_lose", F.lit(True))
        )
        state = stored(
            state.join(winners, ["photo_id", "box_id"], "left").join(losers, ["photo_id", "box_id"], "left")
            .select(
                "photo_id", "box_id",
                F.coalesce("kept", F.col("_win"), F.when(F.col("_lose"), F.lit(False))).alias("kept"),
            ),
            f"state-{step}",
        )
        if state.filter("kept IS NULL").isEmpty():
            break
        undecided = state.filter("kept IS NULL").select("photo_id", "box_id")
        pairs = stored(
            pairs.join(undecided.select("photo_id", F.col("box_id").alias("strong")), ["photo_id", "strong"], "left_semi")
            .join(undecided.select("photo_id", F.col("box_id").alias("weak")), ["photo_id", "weak"], "left_semi"),
            f"pairs-{step}",
        )
        if step > 1:
            drop_path(spark, f"{root}/pairs-{step - 2}")
            drop_path(spark, f"{root}/state-{step - 2}")
    return state.filter("kept").select("photo_id", "box_id")
