"""Table schemas, stage codes and the named face states used by every query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGE_NEW = 0
STAGE_NEEDS_DETECTION = 1
STAGE_DONE = 2

REGION_TYPE = "struct<x:double,y:double,w:double,h:double,landmarks:array<double>>"

PHOTOS_DDL = (
    "photo_id bigint, path string, folder string, modified_at bigint, "
    "taken_at bigint, stage int, pending_xmp_write boolean"
)
PERSONS_DDL = "person_id bigint, name string, representative_face_id bigint"
FACES_DDL = (
    "face_id bigint, photo_id bigint, person_id bigint, name string, "
    f"region {REGION_TYPE}, embedding array<double>, ignored boolean, "
    "quality_score double, embedding_failed boolean"
)

NARROW_FACE = (
    "face_id",
    "photo_id",
    "person_id",
    "name",
    "ignored",
    "quality_score",
    "embedding_failed",
)


@dataclass(frozen=True)
class Library:
    """The three tables that every edit takes and returns."""

    photos: DataFrame
    persons: DataFrame
    faces: DataFrame


def confirmed() -> Column:
    return F.col("name").isNotNull() & ~F.col("ignored")


def suggested() -> Column:
    return F.col("person_id").isNotNull() & F.col("name").isNull() & ~F.col("ignored")


def unknown() -> Column:
    return F.col("person_id").isNull() & ~F.col("ignored") & ~F.col("embedding_failed")


def ignored() -> Column:
    return F.col("ignored")


def awaiting_vector() -> Column:
    return F.col("embedding").isNull() & ~F.col("ignored") & ~F.col("embedding_failed")


def clusterable() -> Column:
    return F.col("person_id").isNull() & ~F.col("ignored") & F.col("embedding").isNotNull()
