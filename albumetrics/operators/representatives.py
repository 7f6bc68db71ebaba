"""Which face stands for a person: the one nearest to the centroid of their faces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumetrics.functions.vectors import centroids, cosine_distance


def representatives(faces: DataFrame, weighted: bool = True) -> DataFrame:
    """``(person_id, face_id)`` for every person with a usable face.

    Confirmed faces count if there are any, else all. ``weighted`` uses the
    quality-weighted centroid (whole runs), otherwise the plain mean (edits).
    """
    usable = faces.filter("person_id IS NOT NULL AND NOT ignored AND embedding IS NOT NULL").select(
        "face_id", "person_id", "embedding", "quality_score", F.col("name").isNotNull().alias("_named")
    )
    has_named = usable.groupBy("person_id").agg(F.bool_or("_named").alias("_any"))
    basis = usable.join(has_named, "person_id").filter(F.col("_named") | ~F.col("_any"))
    weight = F.coalesce("quality_score", F.lit(0.5)) if weighted else 1.0
    centre = centroids(basis, "person_id", "embedding", weight)
    distance = cosine_distance(F.col("embedding"), F.col("centroid"))
    near = basis.join(centre.select("person_id", "centroid"), "person_id").select(
        "person_id", "face_id", distance.alias("_d")
    )
    return near.groupBy("person_id").agg(F.min_by("face_id", F.struct("_d", "face_id")).alias("face_id"))


def refresh_representatives(
    persons: DataFrame, faces: DataFrame, touched: DataFrame | None = None, weighted: bool = False,
    clear_missing: bool = True,
) -> DataFrame:
    """Persons with their representative recomputed, for the ``touched`` ones or for all."""
    pool = faces if touched is None else faces.join(touched.select("person_id"), "person_id", "left_semi")
    found = representatives(pool, weighted).select("person_id", F.col("face_id").alias("_rep"))
    joined = persons.join(found, "person_id", "left")
    if touched is None:
        hit = F.lit(True)
    else:
        marks = touched.select("person_id").distinct().withColumn("_touched", F.lit(True))
        joined = joined.join(marks, "person_id", "left")
        hit = F.coalesce("_touched", F.lit(False))
    old = F.col("representative_face_id")
    fresh = F.col("_rep") if clear_missing else F.coalesce("_rep", old)
    return joined.withColumn("representative_face_id", F.when(hit, fresh).otherwise(old)).select(*persons.columns)
