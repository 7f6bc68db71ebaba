"""Lookups, joins, counts, lists and reports over the three tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetrics.functions.dates import month_key
from albumetrics.schema import NARROW_FACE, confirmed, ignored, suggested, unknown

LIST_LIMIT = 10_000
PAGE_SIZE = 90


# --- projections and lookups -------------------------------------------------


def by_column(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def person_by_name(persons: DataFrame, name: str) -> DataFrame:
    """One person of that name: the smallest id where several share it."""
    return (
        persons.filter(F.col("name") == name)
        .groupBy("name")
        .agg(F.min("person_id").alias("person_id"))
    )


def in_folders(photos: DataFrame, folders: list[str]) -> DataFrame:
    return photos.filter(F.col("folder").isin(folders)) if folders else photos.filter(F.lit(False))


def by_stage(photos: DataFrame, stage: int) -> DataFrame:
    return photos.filter(F.col("stage") == stage)


def named_persons(persons: DataFrame) -> DataFrame:
    return persons.filter(F.col("name").isNotNull())


def suggestions(persons: DataFrame) -> DataFrame:
    return persons.filter(F.col("name").isNull())


def narrow_faces(faces: DataFrame) -> DataFrame:
    """Faces without vector and box."""
    return faces.select(*NARROW_FACE)


def face_label() -> Column:
    return F.when(confirmed(), "confirmed").when(suggested(), "unconfirmed")


def split_faces(faces: DataFrame, person_id) -> DataFrame:
    """A person's faces, each marked confirmed or unconfirmed; ignored ones are left out."""
    labelled = by_column(faces, "person_id", person_id).withColumn("label", face_label())
    return labelled.filter(F.col("label").isNotNull())


def search_names(persons: DataFrame, query: str) -> DataFrame:
    """Case-insensitive contains search.

    When no name equals the query (and it is not blank), one more row without an id holds the query as its name and
    ``offer_create``; so the offer is there without any hit.
    """
    asked = query.strip()
    named = named_persons(persons)
    hits = named.filter(F.contains(F.lower("name"), F.lit(asked.lower()))).withColumn("offer_create", F.lit(False))
    equal = F.coalesce(F.bool_or(F.lower("name") == asked.lower()), F.lit(False))
    offer = named.agg(equal.alias("_equal")).filter(~F.col("_equal") & F.lit(asked != ""))
    values = {"name": F.lit(asked), "offer_create": F.lit(True)}
    types = {f.name: f.dataType for f in hits.schema.fields}
    return hits.unionByName(offer.select(*[values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in hits.columns]))


# --- joins ---------------------------------------------------------------------


def faces_with_date(faces: DataFrame, photos: DataFrame) -> DataFrame:
    return faces.join(photos.select("photo_id", "taken_at"), "photo_id")


def visible_faces(faces: DataFrame, photos: DataFrame, folders: list[str]) -> DataFrame:
    """Faces on photos inside the whitelisted folders, with the capture date."""
    shown = in_folders(photos, folders).select("photo_id", "taken_at")
    return faces.join(shown, "photo_id")


def photos_without_confirmed(photos: DataFrame, faces: DataFrame) -> DataFrame:
    return photos.join(faces.filter(confirmed()).select("photo_id"), "photo_id", "left_anti")


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def person_counts(
    persons: DataFrame, faces: DataFrame, photos: DataFrame, folders: list[str]
) -> DataFrame:
    """Named persons with visible confirmed and unconfirmed counts, busiest first."""
    counts = (
        visible_faces(faces.filter("person_id IS NOT NULL"), photos, folders)
        .groupBy("person_id")
        .agg(
            _count_if(confirmed()).alias("confirmed_count"),
            _count_if(F.col("name").isNull() & ~ignored()).alias("unconfirmed_count"),
        )
    )
    return (
        named_persons(persons)
        .select("person_id", "name")
        .join(counts, "person_id")
        .orderBy(F.desc("confirmed_count"), F.asc("name"), F.asc("person_id"))
    )


def _visible_counts(faces: DataFrame, photos: DataFrame, folders: list[str]) -> DataFrame:
    return (
        visible_faces(faces.filter("person_id IS NOT NULL"), photos, folders)
        .groupBy("person_id")
        .agg(_count_if(~ignored()).alias("visible_count"))
    )


def visible_namesakes(
    persons: DataFrame, faces: DataFrame, photos: DataFrame, folders: list[str], requests: DataFrame
) -> DataFrame:
    """For each ``(person_id, new_name)`` request: other persons of that name with visible faces."""
    wanted = requests.select(
        F.col("person_id").alias("request_id"), F.col("new_name").alias("name")
    )
    return (
        named_persons(persons)
        .select("person_id", "name")
        .join(wanted, "name")
        .filter("person_id <> request_id")
        .join(_visible_counts(faces, photos, folders), "person_id")
        .filter("visible_count > 0")
        .orderBy("request_id", F.desc("visible_count"), "person_id")
    )


def visible_suggestions(
    persons: DataFrame, faces: DataFrame, photos: DataFrame, folders: list[str]
) -> DataFrame:
    """Suggestions with any visible face, ordered by their visible faces that are not ignored."""
    return (
        suggestions(persons)
        .select("person_id")
        .join(_visible_counts(faces, photos, folders), "person_id")
        .orderBy(F.desc("visible_count"), "person_id")
    )


def confirmed_photos(
    photos: DataFrame, faces: DataFrame, person_id, folders: list[str]
) -> DataFrame:
    mine = by_column(faces, "person_id", person_id).filter(confirmed()).select("photo_id")
    return in_folders(photos, folders).join(mine, "photo_id", "left_semi").orderBy(
        F.desc_nulls_last("taken_at"), "photo_id"
    )


def confirmed_face_by_photo(faces: DataFrame, person_id) -> DataFrame:
    """One confirmed face of the person per photo: the last id where several exist."""
    mine = by_column(faces, "person_id", person_id).filter(confirmed())
    return mine.groupBy("photo_id").agg(F.max("face_id").alias("face_id"))


def face_visibility(faces: DataFrame, photos: DataFrame, folders: list[str]) -> DataFrame:
    """Each face with a flag telling whether its photo is inside the folders."""
    inside = F.col("folder").isin(folders) if folders else F.lit(False)
    return faces.join(photos.select("photo_id", inside.alias("inside")), "photo_id")


def orphaned_persons(persons: DataFrame, faces: DataFrame) -> DataFrame:
    held = faces.filter("person_id IS NOT NULL").select("person_id")
    return persons.join(held, "person_id", "left_anti")


def orphan_artefacts(files: DataFrame, faces: DataFrame, column: str = "file_name") -> DataFrame:
    """Files whose stem is no known face id."""
    stem = F.regexp_replace(F.col(column), r"\.[^.]*$", "")
    known = faces.select(F.col("face_id").cast("string").alias("_stem"))
    return files.withColumn("_stem", stem).join(known, "_stem", "left_anti").drop("_stem")


# --- counts and reports ----------------------------------------------------------


def suggestion_face_counts(persons: DataFrame, faces: DataFrame) -> DataFrame:
    return (
        faces.filter("person_id IS NOT NULL")
        .groupBy("person_id")
        .agg(F.count(F.lit(1)).alias("face_count"))
        .join(suggestions(persons).select("person_id"), "person_id")
        .orderBy(F.desc("face_count"), "person_id")
    )


def pool_counts(faces: DataFrame, photos: DataFrame, folders: list[str]) -> DataFrame:
    return visible_faces(faces, photos, folders).agg(
        _count_if(unknown()).alias("unknown_count"), _count_if(ignored()).alias("ignored_count")
    )


def overview(
    persons: DataFrame, faces: DataFrame, photos: DataFrame, folders: list[str]
) -> DataFrame:
    """All rows of the overview screen: persons, suggestions and the two pools."""
    named = person_counts(persons, faces, photos, folders).select(
        F.lit("person").alias("kind"), F.col("person_id").cast("bigint").alias("id"), "name",
        F.col("confirmed_count").alias("n"), F.col("unconfirmed_count").alias("m"),
        F.lit(None).cast("bigint").alias("first_face"),
    )
    all_faces = faces.filter("person_id IS NOT NULL").groupBy("person_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("face_id").alias("first_face")
    )
    shown = visible_suggestions(persons, faces, photos, folders)
    proposed = shown.join(all_faces, "person_id").select(
        F.lit("suggestion").alias("kind"), F.col("person_id").cast("bigint").alias("id"),
        F.lit(None).cast("string").alias("name"), "n", F.col("visible_count").alias("m"), "first_face",
    )
    pools = pool_counts(faces, photos, folders).select(
        F.lit("pools").alias("kind"), F.lit(None).cast("bigint").alias("id"),
        F.lit(None).cast("string").alias("name"), F.col("unknown_count").alias("n"),
        F.col("ignored_count").alias("m"), F.lit(None).cast("bigint").alias("first_face"),
    )
    return named.unionByName(proposed).unionByName(pools)


def detection_check(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Found against expected regions per photo; ``ok`` where the two counts agree."""
    return (
        expected.groupBy("photo_id").agg(F.count(F.lit(1)).alias("expected"))
        .join(found.groupBy("photo_id").agg(F.count(F.lit(1)).alias("found")), "photo_id", "full")
        .select(
            "photo_id",
            F.coalesce("expected", F.lit(0)).cast("bigint").alias("expected"),
            F.coalesce("found", F.lit(0)).cast("bigint").alias("found"),
        )
        .withColumn("ok", F.col("expected") == F.col("found"))
    )


# --- lists -------------------------------------------------------------------------


def photos_by_date(photos: DataFrame, folders: list[str]) -> DataFrame:
    return in_folders(photos, folders).orderBy(F.desc_nulls_last("taken_at"), "photo_id")


def person_faces(
    faces: DataFrame, photos: DataFrame, person_id, folders: list[str], limit: int = LIST_LIMIT
) -> DataFrame:
    """Unconfirmed faces first, then newest first."""
    mine = narrow_faces(by_column(faces, "person_id", person_id))
    return (
        visible_faces(mine, photos, folders)
        .orderBy(F.col("name").isNotNull(), F.desc_nulls_last("taken_at"), "face_id")
        .limit(limit)
    )


def unknown_faces(
    faces: DataFrame, photos: DataFrame, folders: list[str], limit: int = LIST_LIMIT
) -> DataFrame:
    return _pool_list(faces.filter(unknown()), photos, folders).limit(limit)


def ignored_faces(
    faces: DataFrame, photos: DataFrame, folders: list[str], limit: int = LIST_LIMIT
) -> DataFrame:
    return _pool_list(faces.filter(ignored()), photos, folders).limit(limit)


def _pool_list(faces: DataFrame, photos: DataFrame, folders: list[str]) -> DataFrame:
    return visible_faces(narrow_faces(faces), photos, folders).orderBy(
        F.desc_nulls_last("taken_at"), "face_id"
    )


def unknown_page(
    faces: DataFrame,
    photos: DataFrame,
    folders: list[str],
    after: tuple[int | None, int] | None = None,
    size: int = PAGE_SIZE,
) -> DataFrame:
    """The page behind the ``(taken_at, face_id)`` of the last row seen; no offset is counted."""
    rows = visible_faces(narrow_faces(faces.filter(unknown())), photos, folders)
    if after is not None:
        taken, face_id = after
        same = F.col("taken_at").eqNullSafe(F.lit(taken)) & (F.col("face_id") > face_id)
        if taken is None:
            rows = rows.filter(same)
        else:
            rows = rows.filter(same | (F.col("taken_at") < taken) | F.col("taken_at").isNull())
    return rows.orderBy(F.desc_nulls_last("taken_at"), "face_id").limit(size)


def month_headers(photos: DataFrame) -> DataFrame:
    """One header per month of a date-descending list; undated photos come last.

    In such a list a month is one contiguous run, so the headers are the groups
    of the month key and no global ordering of the photos is needed.
    """
    return (
        photos.withColumn("month_key", month_key(F.col("taken_at")))
        .groupBy("month_key")
        .agg(F.count(F.lit(1)).alias("photo_count"), F.max("taken_at").alias("newest"))
        .orderBy(F.desc_nulls_last("newest"))
    )


def month_list(photos: DataFrame) -> DataFrame:
    """Photos with a flag on the first of each month of the date-descending list.

    The first of a month is a least value, which tasks find before the shuffle; no month is sorted.
    """
    keyed = photos.withColumn("month_key", month_key(F.col("taken_at")))
    place = F.struct(F.coalesce(-F.col("taken_at"), F.lit((1 << 63) - 1)).alias("at"), "photo_id")
    firsts = keyed.groupBy("month_key").agg(F.min(place).alias("_first"))
    firsts = firsts.select(F.col("month_key").alias("_month"), F.col("_first.photo_id").alias("_id"))
    joined = keyed.join(firsts, F.col("month_key").eqNullSafe(F.col("_month")))
    return joined.withColumn("starts_month", F.col("photo_id") == F.col("_id")).drop("_month", "_id")
