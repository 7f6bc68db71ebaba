"""Media catalogue: scanning, folder roots, reconciliation with known photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumetrics.functions.paths import category, trim_slashes, whitelist_root
from albumetrics.schema import STAGE_DONE, STAGE_NEW, Library


def read_media_files(spark: SparkSession, root: str) -> DataFrame:
    """Catalogue of the JPEG files below ``root``: only the listing is read, no content."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG}")
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    base = root.rstrip("/")
    # Listed paths carry a scheme and may differ from ``root`` in their leading slashes.
    tail = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    plain = base if base.startswith("/") else "/" + base.split("://", 1)[-1]
    relative = F.substring(tail, F.lit(len(plain) + 2), F.length(tail))
    return files.select(
        "path",
        F.regexp_extract(relative, "^(.*/)?[^/]*$", 1).alias("rel_path"),
        F.lit("image/jpeg").alias("mime_type"),
        F.unix_millis("modificationTime").alias("modified_at"),
    )


def jpegs(catalogue: DataFrame) -> DataFrame:
    return catalogue.filter(F.col("mime_type") == "image/jpeg")


def scan(
    catalogue: DataFrame, folders: list[str], since_ms: int | None = None, ordered: bool = True
) -> DataFrame:
    """JPEG entries inside the whitelist, under their whitelist root, newest first if ``ordered``.

    ``since_ms`` keeps only entries modified after the stored high-water mark.
    """
    rows = jpegs(catalogue)
    if since_ms is not None:
        rows = rows.filter(F.col("modified_at") > since_ms)
    rooted = rows.withColumn("folder", whitelist_root(trim_slashes(F.col("rel_path")), folders))
    kept = rooted.filter(F.col("folder").isNotNull())
    return kept.orderBy(F.desc("modified_at"), "path") if ordered else kept


def folder_listing(catalogue: DataFrame) -> DataFrame:
    return (
        jpegs(catalogue)
        .select(trim_slashes(F.col("rel_path")).alias("folder"))
        .filter(F.trim("folder") != "")
        .distinct()
        .orderBy("folder")
    )


def folders_by_category(folders: DataFrame) -> DataFrame:
    """``(category, folder)``, one row per folder however many a category has."""
    return folders.select(category(F.col("folder")).alias("category"), "folder").distinct()


def folders_per_category(folders: DataFrame) -> DataFrame:
    """One line per category for a screen: its folders joined, so only for listings of a size to be shown."""
    return folders_by_category(folders).groupBy("category").agg(
        F.array_join(F.array_sort(F.collect_list("folder")), ",").alias("folders")
    )


def reconcile(entries: DataFrame, photos: DataFrame) -> DataFrame:
    """What a scan does to each entry: NEW, MODIFIED, UNCHANGED or RESUME.

    Photos with a pending packet write are left out: their modification time
    is about to change.
    """
    known = photos.select(
        "path", "photo_id", F.col("modified_at").alias("known_modified_at"), "stage", "pending_xmp_write"
    )
    same = F.col("modified_at") == F.col("known_modified_at")
    action = (
        F.when(F.col("photo_id").isNull(), "NEW")
        .when(~same, "MODIFIED")
        .when(F.col("stage") == STAGE_DONE, "UNCHANGED")
        .otherwise("RESUME")
    )
    return (
        entries.join(known, "path", "left")
        .filter(~F.coalesce("pending_xmp_write", F.lit(False)))
        .withColumn("action", action)
        .drop("pending_xmp_write")
    )


def missing_paths(photos: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Known photos whose file is nowhere in the whole JPEG catalogue."""
    return photos.join(jpegs(catalogue).select("path"), "path", "left_anti")


def path_id(path: Column) -> Column:
    """Content-derived id of a new photo, so that a repeated scan changes nothing."""
    return F.xxhash64(path)


def ingest(
    library: Library, catalogue: DataFrame, folders: list[str], since_ms: int | None = None,
    check_deletions: bool = True,
) -> Library:
    """Apply one scan to the library: register, refresh and, if asked, delete photos."""
    entries = scan(catalogue, folders, since_ms, ordered=False)
    if "taken_at" not in entries.columns:
        entries = entries.withColumn("taken_at", F.lit(None).cast("bigint"))
    changes = reconcile(entries, library.photos).filter(F.col("action").isin("NEW", "MODIFIED"))
    refreshed = changes.select(
        F.coalesce("photo_id", path_id(F.col("path"))).alias("photo_id"),
        "path", "folder", "modified_at", "taken_at",
        F.lit(STAGE_NEW).alias("stage"), F.lit(False).alias("pending_xmp_write"),
    )
    kept = library.photos.join(refreshed.select("photo_id"), "photo_id", "left_anti")
    photos = kept.unionByName(refreshed)
    stale = changes.filter("action = 'MODIFIED'").select("photo_id")
    if check_deletions:
        gone = missing_paths(library.photos, catalogue).select("photo_id")
        photos = photos.join(gone, "photo_id", "left_anti")
        stale = stale.unionByName(gone)
    faces = library.faces.join(stale, "photo_id", "left_anti")
    return Library(photos, library.persons, faces.select(*library.faces.columns))


def normalize_folders(photos: DataFrame, roots: list[str]) -> DataFrame:
    """Photos stored under a sub-folder of a root move to the root itself."""
    root = whitelist_root(F.col("folder"), roots)
    return photos.withColumn("folder", F.coalesce(root, F.col("folder")))
