"""Incremental forms: ingest, staged processing, matching and live counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from albumetrics.operators import catalog, matching
from albumetrics.schema import PHOTOS_DDL, STAGE_DONE, STAGE_NEEDS_DETECTION, STAGE_NEW
from albumetrics.sources.manifest import Manifests
from albumetrics.sources.workspace import child_names, drop_path
from albumetrics.streaming.changes import ChangeLog


def start_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Work off what has arrived, batch by batch, and stop."""
    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


class MediaIngest:
    """Catalogue entries to photo rows, with a high-water mark per batch.

    A stream brings each entry once, in any order, and its checkpoint says what
    is new, so its batches are not sifted by the mark. The mark, the newest
    modification time handled, serves ``rescan`` of a whole catalogue. ``force``
    starts over, whatever the mark says. Each batch also leaves the ids of the
    photos that it modified or took out: the faces of those no longer hold.
    """

    def __init__(self, spark: SparkSession, root: str, folders: list[str], force: bool = False):
        self.spark, self.root, self.folders, self.force = spark, root.rstrip("/"), folders, force
        self.photos = ChangeLog(spark, f"{self.root}/photos", PHOTOS_DDL, "photo_id")
        self._marks = ChangeLog(spark, f"{self.root}/marks", "kind string, mark bigint", "kind")

    def mark(self, before: int | None = None) -> int | None:
        if self.force:
            return None
        newest = self._marks.read(before=before).first()
        return None if newest is None else newest.mark

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        self._store(batch, catalog.scan(batch, self.folders, ordered=False), batch_id)

    def rescan(self, catalogue: DataFrame, batch_id: int) -> DataFrame:
        """Read a whole catalogue as batch ``batch_id``; returns the ids of photos whose faces no longer hold.

        Entries up to the mark are left out, unless forced or while no photo is
        stored. A forced rescan also takes out the photos that the catalogue no
        longer has. The faces of those, and of modified photos, are to be dropped.
        """
        known = self.photos.read(before=batch_id)
        since = None if self.force or known.isEmpty() else self.mark(before=batch_id)
        gone = catalog.missing_paths(known, catalogue).select("photo_id") if self.force else None
        self._store(catalogue, catalog.scan(catalogue, self.folders, since, ordered=False), batch_id, gone)
        return self.stale_photos(batch_id)

    def stale_photos(self, batch_id: int | None = None) -> DataFrame:
        """Ids of the photos that a batch (or any, if None) modified or took out."""
        path = f"{self.root}/stale" if batch_id is None else f"{self.root}/stale/batch={batch_id}"
        if not child_names(self.spark, path):
            return self.spark.createDataFrame([], "photo_id bigint")
        return self.spark.read.schema("photo_id bigint").parquet(path).select("photo_id").distinct()

    def without_stale(self, faces: DataFrame, batch_id: int) -> DataFrame:
        """The faces that still hold after a batch."""
        return faces.join(self.stale_photos(batch_id), "photo_id", "left_anti")

    def _store(self, batch: DataFrame, entries: DataFrame, batch_id: int, gone: DataFrame | None = None) -> None:
        # Photos of this table are named after their path.
        asked = entries.select(catalog.path_id(F.col("path")).alias("photo_id"))
        known = self.photos.read(before=batch_id, only=asked)
        actions = catalog.reconcile(entries, known).filter(F.col("action").isin("NEW", "MODIFIED"))
        rows = actions.select(
            F.coalesce("photo_id", catalog.path_id(F.col("path"))).alias("photo_id"), "path", "folder", "modified_at",
            "taken_at", F.lit(STAGE_NEW).alias("stage"), F.lit(False).alias("pending_xmp_write"),
        )
        rows = rows.withColumn("deleted", F.lit(False))
        if gone is not None:
            out = self.photos.read(before=batch_id).join(gone, "photo_id", "left_semi").withColumn("deleted", F.lit(True))
            rows = rows.unionByName(out.select(rows.columns))
        stale = actions.filter("action = 'MODIFIED'").select("photo_id")
        if gone is not None:
            stale = stale.unionByName(gone)
        stale.write.mode("overwrite").parquet(f"{self.root}/stale/batch={batch_id}")
        self.photos.write(batch_id, rows)
        earlier = self._marks.read(before=batch_id).select("mark")
        handled = catalog.jpegs(batch).select(F.col("modified_at").alias("mark")).unionByName(earlier)
        self._marks.write(batch_id, handled.agg(F.max("mark").alias("mark")).select(F.lit("modified_at").alias("kind"), "mark"))

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        start_batches(stream, self.handle, checkpoint).awaitTermination()


class StagePipeline:
    """New photos move through their stages; every step can be repeated.

    ``has_regions`` marks photos whose metadata is imported at once; the others
    wait for detection, and ``detect`` says which of those a run settles.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.photos = ChangeLog(spark, f"{root.rstrip('/')}/staged", "photo_id bigint, stage int", "photo_id")

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        known = self.photos.read(before=batch_id, only=batch).select("photo_id", F.col("stage").alias("_known"))
        joined = batch.select("photo_id", "stage", "has_regions", "detected").join(known, "photo_id", "left")
        now = F.coalesce("_known", "stage")
        triaged = F.when(now == STAGE_NEW, F.when(F.col("has_regions"), STAGE_DONE).otherwise(STAGE_NEEDS_DETECTION)).otherwise(now)
        settled = F.when((triaged == STAGE_NEEDS_DETECTION) & F.col("detected"), STAGE_DONE).otherwise(triaged)
        self.photos.write(batch_id, joined.select("photo_id", settled.cast("int").alias("stage")))

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        start_batches(stream, self.handle, checkpoint).awaitTermination()


class VectorMatcher:
    """Vectors are matched against the gallery as they arrive: ``(id, person_id, match, distance)``."""

    ddl = "id bigint, person_id bigint, match string, distance double"

    def __init__(self, spark: SparkSession, root: str, gallery: DataFrame, individual: float, margin: float, time_weight: float):
        self.gallery, self.individual, self.margin, self.time_weight = gallery, individual, margin, time_weight
        self.matches = ChangeLog(spark, f"{root.rstrip('/')}/matches", self.ddl, "id")

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        band = self.individual * (1 + self.margin)
        best = matching.best_person(batch.select("id", "vec", "taken_at"), self.gallery, self.time_weight, band)
        found = matching.match_faces(best, self.individual, self.margin)
        self.matches.write(batch_id, found.select("id", "person_id", "match", "distance"))

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        start_batches(stream, self.handle, checkpoint).awaitTermination()


def live_counts(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> None:
    """Counts per key over everything seen: each batch publishes a new version, the one before stays readable."""
    counts = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    manifests = Manifests(stream.sparkSession, f"{path}/manifests")

    def write(batch: DataFrame, batch_id: int) -> None:
        name = f"{batch_id}-{uuid.uuid4().hex}"
        batch.write.mode("error").parquet(f"{path}/versions/{name}")
        manifests.publish(batch_id, {"name": name}, replace=True)
        numbers = manifests.numbers()
        for number in numbers[:-2]:
            manifests.drop(number)
        named = {manifests.read(number)["name"] for number in numbers[-2:]}
        for old in child_names(batch.sparkSession, f"{path}/versions"):
            if old not in named:
                drop_path(batch.sparkSession, f"{path}/versions/{old}")

    (
        counts.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )


def read_counts(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The counts published last; ``ddl`` names their columns."""
    manifests = Manifests(spark, f"{path}/manifests")
    newest = manifests.latest()
    if newest is None:
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(f"{path}/versions/{manifests.read(newest)['name']}")
