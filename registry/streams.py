"""Streams over the given tables, worked off to the end and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from albumetrics.operators import matching
from albumetrics.sources.workspace import is_folder, materialize, new_path
from albumetrics.streaming import pipelines, state
from registry import fixtures as fx
from registry import register
from registry.fixtures import FOLDERS, sql
from registry.reads import SCAN_SQL
from registry.sources import REMAINING_SQL, progress_events
from registry.vectors import _MATCH_VIEWS, _raw_extra, _BAND, _BEST_SQL, _HEAVY, _LABEL_SQL


def _stream(spark, sf, name):
    """The table, one file or a folder of them, as a stream of its files."""
    path = f"{sf}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # A stream reads folders only: a table that is one file is picked from the folder it lies in.
    return reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _catalogue_stream(spark, sf):
    return _stream(spark, sf, "events").selectExpr(
        "concat('/media/', event_id, '.jpg') AS path",
        """CASE event_type WHEN 'click' THEN 'DCIM/Camera/' WHEN 'view' THEN 'DCIM/Camera/2024/'
             WHEN 'purchase' THEN 'Pictures/' WHEN 'signup' THEN 'Pictures/Trips/' ELSE 'Download/' END AS rel_path""",
        "CASE WHEN event_id % 41 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS mime_type",
        "1700000000000 + event_id*1000 + CASE WHEN event_id % 13 = 0 THEN 500 ELSE 0 END AS modified_at",
        "CASE WHEN event_id % 17 = 0 THEN NULL ELSE 1104537600000 + ((event_id*37) % 1000)*604800000 END AS taken_at",
    )


@register("t01_ingest", sql("SELECT path, folder, modified_at, taken_at, CAST(0 AS INTEGER) AS stage FROM scan", "catalogue", extra=SCAN_SQL))
def _(spark, sf):
    root = new_path(spark, "ingest")
    ingest = pipelines.MediaIngest(spark, root, FOLDERS)
    ingest.run(_catalogue_stream(spark, sf), f"{root}/checkpoint")
    return ingest.photos.read().select("path", "folder", "modified_at", "taken_at", "stage")


@register("t05_forced_resync", sql("SELECT path, folder, modified_at, CAST(0 AS INTEGER) AS stage FROM scan", "catalogue", extra=SCAN_SQL))
def _(spark, sf):
    """A second, forced run over the same files changes nothing."""
    root = new_path(spark, "resync")
    first = pipelines.MediaIngest(spark, root, FOLDERS)
    first.run(_catalogue_stream(spark, sf), f"{root}/checkpoint-1")
    forced = pipelines.MediaIngest(spark, root, FOLDERS, force=True)
    forced.handle(fx.catalogue(spark, sf), 1)
    return forced.photos.read().select("path", "folder", "modified_at", "stage")


@register(
    "t01_ingest_unordered",
    sql("SELECT path, folder, modified_at, taken_at, CAST(0 AS INTEGER) AS stage FROM scan", "catalogue", extra=SCAN_SQL),
)
def _(spark, sf):
    """Three batches whose times overlap: nothing is lost, whatever came before."""
    ingest = pipelines.MediaIngest(spark, new_path(spark, "unordered"), FOLDERS)
    catalogue = fx.catalogue(spark, sf)
    for batch_id, part in enumerate((2, 0, 1)):
        ingest.handle(catalogue.filter(F.pmod(F.col("modified_at") / 1000, F.lit(3)).cast("int") == part), batch_id)
    return ingest.photos.read().select("path", "folder", "modified_at", "taken_at", "stage")


@register("t01_modified_photos", sql("SELECT path FROM scan WHERE path LIKE '%3.jpg'", "catalogue", extra=SCAN_SQL))
def _(spark, sf):
    """Three batches of which the last brings changed files: whose faces have to go."""
    ingest = pipelines.MediaIngest(spark, new_path(spark, "modified"), FOLDERS)
    catalogue = fx.catalogue(spark, sf)
    odd = F.col("path").like("%3.jpg")
    ingest.handle(catalogue.filter(odd), 0)
    ingest.handle(catalogue.filter(~odd), 1)
    ingest.handle(catalogue.filter(odd).withColumn("modified_at", F.col("modified_at") + 1000), 2)
    return ingest.photos.read().join(ingest.stale_photos(2), "photo_id", "left_semi").select("path")


@register(
    "t05_resync_with_deletions",
    sql(
        """SELECT path, folder, modified_at, CAST(0 AS INTEGER) AS stage FROM scan WHERE NOT path LIKE '%7.jpg'""",
        "catalogue", extra=SCAN_SQL,
    ),
)
def _(spark, sf):
    """A forced rescan of a catalogue that has lost files takes their photos out."""
    ingest = pipelines.MediaIngest(spark, new_path(spark, "deletions"), FOLDERS, force=True)
    catalogue = fx.catalogue(spark, sf)
    ingest.handle(catalogue, 0)
    ingest.rescan(catalogue.filter("NOT path LIKE '%7.jpg'"), 1)
    return ingest.photos.read().select("path", "folder", "modified_at", "stage")


@register(
    "t02_stages",
    sql(
        """SELECT photo_id, CAST(CASE WHEN stage = 2 THEN 2 WHEN stage = 0 AND photo_id % 4 = 0 THEN 2 WHEN photo_id % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS stage FROM photos""",
        "photos",
    ),
)
def _(spark, sf):
    root = new_path(spark, "stages")
    staged = pipelines.StagePipeline(spark, root)
    stream = _stream(spark, sf, "events").selectExpr(
        "event_id AS photo_id", "CAST(event_id % 3 AS INT) AS stage", "event_id % 4 = 0 AS has_regions", "event_id % 5 = 0 AS detected"
    )
    staged.run(stream, f"{root}/checkpoint")
    return staged.photos.read()


@register(
    "t03_match_arrivals",
    sql(f"SELECT id, person_id, {_LABEL_SQL} AS match, round(distance, 6) AS distance FROM best WHERE distance < {_BAND}", *_MATCH_VIEWS, extra=_raw_extra(_BEST_SQL)),
)
def _(spark, sf):
    lib = fx.library(spark, sf, planted=False)
    gallery = matching.build_gallery(lib.persons, lib.faces, lib.photos)
    root = new_path(spark, "arrivals")
    matcher = pipelines.VectorMatcher(spark, root, gallery, _HEAVY.individual_match, _HEAVY.suggest_margin, 1.0)
    arriving = _stream(spark, sf, "embeddings").filter("(vec_id % 5 = 0 OR vec_id % 23 = 0) AND vec_id % 23 <> 0 AND vec_id % 37 <> 0").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), ((F.col("vec_id") % 250) * 2).alias("photo_id")
    )
    dated = arriving.join(lib.photos.select("photo_id", "taken_at"), "photo_id")
    matcher.run(dated, f"{root}/checkpoint")
    return matcher.matches.read().select("id", "person_id", "match", F.round("distance", 6).alias("distance"))


@register(
    "t04_live_counts",
    sql(
        """SELECT person_id, CASE WHEN ignored THEN 'ignored' WHEN name IS NOT NULL THEN 'confirmed' WHEN person_id IS NOT NULL THEN 'suggested' ELSE 'unknown' END AS state,
        count(*) AS n FROM faces GROUP BY 1, 2""",
        "faces",
    ),
)
def _(spark, sf):
    root = new_path(spark, "live")
    stream = _stream(spark, sf, "embeddings").selectExpr(*fx._FACE_COLUMNS[:4], "vec_id % 23 = 0 AS ignored")
    state_of = F.expr("CASE WHEN ignored THEN 'ignored' WHEN name IS NOT NULL THEN 'confirmed' WHEN person_id IS NOT NULL THEN 'suggested' ELSE 'unknown' END")
    pipelines.live_counts(stream.withColumn("state", state_of), ["person_id", "state"], f"{root}/counts", f"{root}/checkpoint")
    return pipelines.read_counts(spark, f"{root}/counts", "person_id bigint, state string, n bigint")


@register(
    "t07_gate_stream",
    """WITH d AS (SELECT user_id AS device, event_id AS seq, (event_id * 7) % 50 + 10 AS b, 20 + value % 24 AS t, CASE WHEN event_id % 97 = 0 THEN 3 ELSE 0 END AS th FROM events),
    k AS (SELECT *, CASE WHEN b < 20 OR t > 40 OR th >= 3 THEN true WHEN NOT (b < 25 OR t > 35) THEN false END AS decision FROM d)
    SELECT device, seq, coalesce(last_value(decision IGNORE NULLS) OVER (PARTITION BY device ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS blocked FROM k""",
)
def _(spark, sf):
    stream = _stream(spark, sf, "events").selectExpr(
        "user_id AS device", "event_id AS seq", "CAST((event_id * 7) % 50 + 10 AS INT) AS battery_pct",
        "CAST(20 + value % 24 AS DOUBLE) AS temp_c", "CASE WHEN event_id % 97 = 0 THEN 3 ELSE 0 END AS thermal",
    )
    gate = state.GateStream(spark, new_path(spark, "gate"), block=500)
    gate.run(stream, f"{gate.root}/checkpoint")
    return gate.read()


@register("t06_remaining_stream", REMAINING_SQL)
def _(spark, sf):
    stream = _stream(spark, sf, "events").selectExpr(
        "user_id AS run", "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS ts_ms", "event_id - event_id % 3 AS done", "2000000 AS total",
        "CASE WHEN event_type = 'view' THEN 60000 ELSE 0 END AS paused_ms",
    )
    remaining = state.RemainingStream(spark, new_path(spark, "remaining"))
    remaining.run(stream, f"{remaining.root}/checkpoint")
    return remaining.read().select("run", "ts_ms", F.round("per_item_ms", 3).alias("per_item_ms"))


@register("t06_remaining_batches", REMAINING_SQL)
def _(spark, sf):
    """Five batches in order of time: each goes on from what the runs handed over."""
    progress = progress_events(spark, sf)
    span = progress.agg(F.min("ts_ms").alias("_a"), F.max("ts_ms").alias("_z"))
    part = F.expr("(ts_ms - _a) * 5 div (_z - _a + 1)")
    cut = materialize(progress.join(F.broadcast(span)).withColumn("_part", part), "progress-batches")
    remaining = state.RemainingStream(spark, new_path(spark, "remaining-batches"))
    for batch_id in range(5):
        remaining.handle(cut.filter(F.col("_part") == batch_id), batch_id)
    return remaining.read().select("run", "ts_ms", F.round("per_item_ms", 3).alias("per_item_ms"))
