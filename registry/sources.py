"""Packets, codecs, scoring, logs and run events."""

from __future__ import annotations

from pyspark.sql import functions as F

from albumetrics.functions import vectors
from albumetrics.operators import runs, scoring
from albumetrics.schema import REGION_TYPE
from albumetrics.sources import logs, xmp
from registry import fixtures as fx
from registry import register
from registry.fixtures import sql

_NS = " ".join(f"xmlns:{prefix}='{uri}'" for prefix, uri in xmp.NS.items())


def _written(spark, sf):
    """Packets as the writer makes them for the photos that hold a face."""
    faces = fx.faces(spark, sf)
    photos = fx.photos(spark, sf).join(faces.select("photo_id"), "photo_id", "left_semi")
    return xmp.write_packets(photos, faces)


# Region text in every form a packet may have: fields as elements or attributes,
# an older nested level, another type, a blank name, a missing coordinate.
_ITEM = """concat('<rdf:li', CASE form
  WHEN 0 THEN concat(' rdf:parseType="Resource"><mwg-rs:Type>Face</mwg-rs:Type><mwg-rs:Name>P', n, '</mwg-rs:Name><mwg-rs:Area rdf:parseType="Resource"><stArea:x>', x, '</stArea:x><stArea:y>', y, '</stArea:y><stArea:w>', w, '</stArea:w><stArea:h>', h, '</stArea:h></mwg-rs:Area></rdf:li>')
  WHEN 1 THEN concat('><rdf:Description mwg-rs:Type="FACE" mwg-rs:Name="P', n, '"><mwg-rs:Area stArea:x="', x, '" stArea:y="', y, '" stArea:w="', w, '" stArea:h="', h, '"/></rdf:Description></rdf:li>')
  WHEN 2 THEN concat(' rdf:parseType="Resource"><mwg-rs:RegionExtensions rdf:parseType="Resource"><mwg-rs:Type>Face</mwg-rs:Type><mwg-rs:Name>P', n, '</mwg-rs:Name><mwg-rs:Area stArea:x="', x, '" stArea:y="', y, '" stArea:w="', w, '" stArea:h="', h, '"/></mwg-rs:RegionExtensions></rdf:li>')
  WHEN 3 THEN concat(' rdf:parseType="Resource"><mwg-rs:Type>Pet</mwg-rs:Type><mwg-rs:Area stArea:x="', x, '" stArea:y="', y, '" stArea:w="', w, '" stArea:h="', h, '"/></rdf:li>')
  WHEN 4 THEN concat(' rdf:parseType="Resource"><mwg-rs:Type>Face</mwg-rs:Type><mwg-rs:Name>  </mwg-rs:Name><mwg-rs:Area stArea:x="', x, '" stArea:y="', y, '" stArea:w="', w, '" stArea:h="', h, '"/></rdf:li>')
  ELSE concat(' rdf:parseType="Resource"><mwg-rs:Type>Face</mwg-rs:Type><mwg-rs:Area stArea:x="', x, '" stArea:y="?" stArea:w="', w, '" stArea:h="', h, '"/></rdf:li>') END)"""


def _mixed_packets(spark, sf):
    items = fx.faces(spark, sf).selectExpr(
        "face_id AS photo_id", "face_id % 6 AS form", "face_id % 9 AS n", "region.x AS x", "region.y AS y", "region.w AS w", "region.h AS h"
    )
    body = F.expr(_ITEM)
    return items.select(
        "photo_id",
        F.concat(
            F.lit(f"<x:xmpmeta {_NS}><rdf:RDF><rdf:Description rdf:about=''><mwg-rs:Regions rdf:parseType='Resource'><mwg-rs:RegionList><rdf:Bag>"),
            body, F.lit("</rdf:Bag></mwg-rs:RegionList></mwg-rs:Regions></rdf:Description></rdf:RDF></x:xmpmeta>"),
        ).alias("packet"),
    )


@register(
    "s05_read_regions",
    sql(
        """SELECT face_id AS photo_id, CASE WHEN face_id % 6 < 3 THEN 'P' || CAST(face_id % 9 AS VARCHAR) END AS name,
          round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM faces WHERE face_id % 6 IN (0, 1, 2, 4)""",
        "faces",
    ),
)
def _(spark, sf):
    found = xmp.read_regions(_mixed_packets(spark, sf))
    return found.select("photo_id", "name", *[F.round(f"region.{c}", 6).alias(c) for c in "xywh"])


@register(
    "s06_locate_packet",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type || ' ' || props END AS packet FROM events""",
)
def _(spark, sf):
    """Packets inside JPEG bytes, some behind another segment or a byte order mark, some absent."""
    text = F.encode(F.concat("event_type", F.lit(" "), "props"), "UTF-8")
    marked = F.when(F.col("event_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), text)).otherwise(text)
    body = F.concat(F.encode(F.lit("http://ns.adobe.com/xap/1.0/"), "UTF-8"), F.unhex(F.lit("00")), marked)
    size = F.unhex(F.lpad(F.hex(F.length(body) + 2), 4, "0"))
    segment = F.concat(F.unhex(F.lit("FFE1")), size, body)
    before = F.when(F.col("event_id") % 3 == 0, F.unhex(F.lit("FFE00004ABCD"))).otherwise(F.unhex(F.lit("")))
    held = F.when(F.col("event_id") % 7 == 0, F.unhex(F.lit(""))).otherwise(segment)
    content = F.concat(F.unhex(F.lit("FFD8")), before, held, F.unhex(F.lit("FFDA0000FFD9")))
    return fx.table(spark, sf, "events").select("event_id", xmp.packet_of(content).alias("packet"))


@register(
    "s07_write_regions",
    sql("SELECT photo_id, name, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM faces", "faces"),
)
def _(spark, sf):
    """What is written can be read back: every face of every photo."""
    found = xmp.read_regions(_written(spark, sf))
    return found.select("photo_id", "name", *[F.round(f"region.{c}", 6).alias(c) for c in "xywh"])


@register(
    "s07_crowded_photos",
    """SELECT l_suppkey AS photo_id, count(*) AS regions, count(DISTINCT 'N' || l_partkey) AS names,
      max(l_linenumber) / 8.0 AS widest FROM lineitem GROUP BY l_suppkey""",
)
def _(spark, sf):
    """Photos of hundreds of faces: supplier by supplier, a face per line item; packets are cut for a file and put together again."""
    lines = fx.table(spark, sf, "lineitem")
    unit = F.lit(0.5)
    width = (F.col("l_linenumber") / 8.0).alias("w")
    faces = lines.select(
        F.col("l_suppkey").alias("photo_id"), F.xxhash64("l_orderkey", "l_linenumber").alias("face_id"),
        F.concat(F.lit("N"), F.col("l_partkey").cast("string")).alias("name"), F.lit(False).alias("ignored"),
        F.struct(unit.alias("x"), unit.alias("y"), width, unit.alias("h")).alias("region"))
    packets = xmp.write_packets(lines.select(F.col("l_suppkey").alias("photo_id")).distinct(), faces)
    # Marker and length of each segment, then the end of the picture.
    bodies = F.transform(xmp.segments_of("packet"), lambda b: F.concat(
        F.unhex(F.lit("FFE1")), F.unhex(F.lpad(F.hex(F.length(b) + 2), 4, "0")), b))
    content = F.concat(F.unhex(F.lit("FFD8")), F.aggregate(bodies, F.unhex(F.lit("")), lambda a, b: F.concat(a, b)), F.unhex(F.lit("FFD9")))
    read = packets.select("photo_id", xmp.packet_of(content).alias("packet"))
    return xmp.read_regions(read).groupBy("photo_id").agg(
        F.count(F.lit(1)).alias("regions"), F.countDistinct("name").alias("names"), F.max("region.w").alias("widest"))


@register(
    "s08_person_tags",
    sql(
        """SELECT photo_id, string_agg(name, ',' ORDER BY name) AS persons, string_agg('People/' || name, ',' ORDER BY name) AS tags,
          string_agg('People|' || name, ',' ORDER BY name) AS hierarchy FROM (SELECT DISTINCT photo_id, name FROM faces WHERE name IS NOT NULL) GROUP BY photo_id""",
        "faces",
    ),
)
def _(spark, sf):
    named = fx.faces(spark, sf).filter("name IS NOT NULL")
    lists = named.groupBy("photo_id").agg(xmp.person_tags(F.array_sort(F.collect_set("name"))).alias("t"))
    return lists.select("photo_id", *[F.array_join(f"t.{c}", ",").alias(c) for c in ("persons", "tags", "hierarchy")])


@register(
    "s09_merge_subjects",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lang || ',' || source || ',New' WHEN doc_id % 4 = 1 THEN source || ',New' ELSE lang || ',' || source || ',New' END AS subject FROM documents""",
)
def _(spark, sf):
    """The old tag list is absent, names the language, or names something else."""
    old = F.expr("CASE WHEN doc_id % 4 = 1 THEN array(concat('People/', lang), 'Places/x') WHEN doc_id % 4 = 2 THEN array('People/none') WHEN doc_id % 4 = 3 THEN array(lang) END")
    merged = xmp.merge_subjects(F.array("lang", "source"), old, F.array(F.lit("New")))
    return fx.table(spark, sf, "documents").select("doc_id", F.array_join(merged, ",").alias("subject"))


@register("s10_clear_packets", sql("SELECT DISTINCT photo_id, 0 AS regions, '' AS subject, '' AS tags FROM faces", "faces"))
def _(spark, sf):
    cleared = xmp.clear_packets(_written(spark, sf))
    lists = xmp.tag_lists("packet")
    return cleared.select("photo_id", F.size(xmp.regions_of("packet")).alias("regions"), lists.alias("t")).select(
        "photo_id", "regions", F.array_join("t.subject", ",").alias("subject"), F.array_join("t.tags", ",").alias("tags")
    )


@register(
    "s11_vector_codec",
    "SELECT vec_id, CAST(len(embedding) * 4 AS INTEGER) AS bytes, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings",
)
def _(spark, sf):
    coded = fx.table(spark, sf, "embeddings").select("vec_id", vectors.vector_to_bytes(F.col("embedding").cast("array<double>")).alias("b"))
    back = coded.select("vec_id", F.length("b").alias("bytes"), vectors.bytes_to_vector("b").alias("v"))
    return back.select("vec_id", "bytes", F.round(F.aggregate("v", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@register(
    "s12_region_json",
    sql("SELECT face_id, round(x, 6) AS x, round(h, 6) AS h, landmarks IS NULL AS bare, round(landmarks[10], 6) AS last FROM faces", "faces"),
)
def _(spark, sf):
    coded = fx.faces(spark, sf).select("face_id", F.to_json("region").alias("j"))
    back = coded.select("face_id", F.from_json("j", REGION_TYPE).alias("r"))
    return back.select(
        "face_id", F.round("r.x", 6).alias("x"), F.round("r.h", 6).alias("h"), F.col("r.landmarks").isNull().alias("bare"),
        F.round(F.get("r.landmarks", F.lit(9)), 6).alias("last"),
    )


@register(
    "s13_drain_pending",
    sql(
        """SELECT photo_id, pending_xmp_write AND photo_id % 5 = 0 AND photo_id % 3 <> 0 AS pending_xmp_write,
          CASE WHEN pending_xmp_write AND photo_id % 3 <> 0 AND photo_id % 5 <> 0 THEN modified_at + 1 ELSE modified_at END AS modified_at FROM photos""",
        "photos",
    ),
)
def _(spark, sf):
    """Every third file is gone, every fifth fails."""
    photos, faces = fx.photos(spark, sf), fx.faces(spark, sf)
    present = photos.filter("photo_id % 3 <> 0").select("path")
    failed = photos.filter("photo_id % 5 = 0").select("photo_id")
    after, _packets = xmp.drain_pending(photos, faces, present, F.col("modified_at") + 1, failed)
    return after.select("photo_id", "pending_xmp_write", "modified_at")


@register(
    "s13_drained_packets",
    sql(
        """SELECT p.photo_id, count(f.face_id) AS regions FROM photos p LEFT JOIN faces f USING (photo_id)
        WHERE pending_xmp_write AND photo_id % 3 <> 0 AND photo_id % 5 <> 0 GROUP BY p.photo_id""",
        "photos", "faces",
    ),
)
def _(spark, sf):
    photos, faces = fx.photos(spark, sf), fx.faces(spark, sf)
    present = photos.filter("photo_id % 3 <> 0").select("path")
    failed = photos.filter("photo_id % 5 = 0").select("photo_id")
    _after, packets = xmp.drain_pending(photos, faces, present, F.col("modified_at") + 1, failed)
    return packets.select("photo_id", F.size(xmp.regions_of("packet")).cast("bigint").alias("regions"))


@register(
    "s14_score_batches",
    sql(
        """SELECT face_id, CASE WHEN face_id % 7 <> 0 AND face_id % 11 <> 0 THEN round(x + y, 6) END AS score,
          CASE WHEN face_id % 7 = 0 OR face_id % 11 = 0 THEN true ELSE false END AS failed FROM faces""",
        "faces",
    ),
)
def _(spark, sf):
    def model(frame):
        if (frame["face_id"] % 7 == 0).any():
            raise ValueError("unreadable crop")
        return [None if i % 11 == 0 else [x + y] for i, x, y in zip(frame["face_id"], frame["x"], frame["y"], strict=True)]

    pending = fx.faces(spark, sf).select("face_id", F.col("region.x").alias("x"), F.col("region.y").alias("y"))
    scored = scoring.score_batches(pending, model, "face_id")
    return scored.select("face_id", F.round(F.get("result", F.lit(0)), 6).alias("score"), F.col("error").isNotNull().alias("failed"))


@register(
    "s14_embed_pending",
    sql(
        """SELECT face_id, embedding IS NOT NULL OR (NOT ignored AND NOT embedding_failed AND face_id % 2 = 1) AS has_vector,
          embedding_failed OR (embedding IS NULL AND NOT ignored AND face_id % 2 = 0) AS embedding_failed FROM faces""",
        "faces",
    ),
)
def _(spark, sf):
    def model(frame):
        return [[float(i)] if i % 2 else None for i in frame["face_id"]]

    after = scoring.embed_pending(fx.faces(spark, sf), model)
    return after.select("face_id", F.col("embedding").isNotNull().alias("has_vector"), "embedding_failed")


@register(
    "s17_refresh_imported",
    sql(
        """SELECT f.photo_id, count(*) AS regions, count(f.name) AS named FROM faces f JOIN photos p USING (photo_id) WHERE p.stage = 2 GROUP BY f.photo_id
        UNION ALL SELECT photo_id, 0, 0 FROM photos WHERE stage = 2 AND photo_id NOT IN (SELECT photo_id FROM faces)""",
        "photos", "faces",
    ),
)
def _(spark, sf):
    photos, faces = fx.photos(spark, sf), fx.faces(spark, sf)
    packets = xmp.refresh_imported(photos, faces, photos.filter("stage = 2"))
    regions = xmp.regions_of("packet")
    return packets.select("photo_id", regions.alias("r")).select(
        "photo_id", F.size("r").cast("bigint").alias("regions"), F.size(F.filter("r", lambda e: e["name"].isNotNull())).cast("bigint").alias("named")
    )


# --- logs ---------------------------------------------------------------------------------


def _log_lines(spark, sf):
    return fx.table(spark, sf, "events").select(
        F.col("user_id").alias("file"), F.col("event_id").alias("line_no"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("    at frame "), "props")).otherwise(
            F.concat(F.date_format("ts", "MM-dd HH:mm:ss.SSS"), F.lit("  "), (F.col("user_id") % 40 + 100).cast("string"), F.lit("  7 I "), "event_type", F.lit(": "), "props")
        ).alias("line"),
    )


_LOG_SQL = """log AS (SELECT user_id AS file, event_id AS line_no, CASE WHEN event_id % 3 = 0 THEN '    at frame ' || props ELSE
   strftime(ts, '%m-%d %H:%M:%S.%g') || '  ' || CAST(user_id % 40 + 100 AS VARCHAR) || '  7 I ' || event_type || ': ' || props END AS line FROM events)"""
_CUTOFF = "01-10 12:00:00.000"


@register(
    "s15_log_range",
    sql(
        f"""SELECT file, line_no FROM (SELECT *, last_value(CASE WHEN line_no % 3 <> 0 THEN line[1:18] END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stamp FROM log) WHERE stamp >= '{_CUTOFF}'""",
        extra=_LOG_SQL,
    ),
)
def _(spark, sf):
    return logs.filter_by_stamp(_log_lines(spark, sf), _CUTOFF, block=1000).select("file", "line_no")


@register(
    "s16_process_lines",
    sql(
        """SELECT line_no, pid FROM (SELECT *, CASE WHEN line_no % 3 <> 0 THEN CAST(split_part(line, '  ', 2) AS INTEGER) END AS pid FROM log)
        WHERE pid IN (SELECT user_id % 40 + 100 FROM events WHERE event_id % 3 <> 0 AND props = '{"k": 42}')""",
        extra=_LOG_SQL,
    ),
)
def _(spark, sf):
    return logs.lines_of_processes(_log_lines(spark, sf), ['"k": 42}']).select("line_no", "pid")


# --- run events ----------------------------------------------------------------------------

_RUN_KIND = """CASE WHEN rn = 1 THEN 'start' WHEN rn = n THEN 'finish' WHEN event_type = 'click' THEN 'pause_manual'
   WHEN event_type = 'view' THEN 'pause_power' ELSE 'resume' END"""


def run_events(spark, sf):
    """A user's events read as the events of one run, with their extremes as start and finish."""
    events = fx.table(spark, sf, "events").select("user_id", "event_type", "event_id", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("ts_ms"))
    ends = events.groupBy("user_id").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    kind = (
        F.when(F.col("event_id") == F.col("lo"), "start").when(F.col("event_id") == F.col("hi"), "finish")
        .when(F.col("event_type") == "click", "pause_manual").when(F.col("event_type") == "view", "pause_power").otherwise("resume")
    )
    return events.join(ends, "user_id").select(F.col("user_id").alias("run"), "ts_ms", kind.alias("kind"), F.col("event_id").alias("seq"))


@register(
    "a16_pause_accounting",
    f"""WITH e AS (SELECT user_id AS run, epoch_us(ts) // 1000 AS ts_ms, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    k AS (SELECT run, ts_ms, {_RUN_KIND} AS kind FROM e),
    s AS (SELECT *, lead(ts_ms) OVER (PARTITION BY run ORDER BY ts_ms) - ts_ms AS span FROM k),
    t AS (SELECT run, max(ts_ms) FILTER (kind = 'finish') - min(ts_ms) FILTER (kind = 'start') AS total_ms,
      CAST(coalesce(sum(span) FILTER (kind = 'pause_manual'), 0) AS BIGINT) AS manual_ms, CAST(coalesce(sum(span) FILTER (kind = 'pause_power'), 0) AS BIGINT) AS power_ms FROM s GROUP BY run)
    SELECT *, greatest(total_ms - manual_ms - power_ms, 0) AS net_ms FROM t""",
)
def _(spark, sf):
    return runs.pause_accounting(run_events(spark, sf))


@register(
    "a16_pauses_with_ties",
    f"""WITH e AS (SELECT user_id AS run, epoch_us(ts) // 1000 // 14400000 * 14400000 AS ts_ms, event_id AS seq, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    k AS (SELECT run, ts_ms, seq, {_RUN_KIND} AS kind FROM e),
    s AS (SELECT *, lead(ts_ms) OVER (PARTITION BY run ORDER BY ts_ms, seq) - ts_ms AS span FROM k),
    t AS (SELECT run, max(ts_ms) FILTER (kind = 'finish') - min(ts_ms) FILTER (kind = 'start') AS total_ms,
      CAST(coalesce(sum(span) FILTER (kind = 'pause_manual'), 0) AS BIGINT) AS manual_ms, CAST(coalesce(sum(span) FILTER (kind = 'pause_power'), 0) AS BIGINT) AS power_ms FROM s GROUP BY run)
    SELECT *, greatest(total_ms - manual_ms - power_ms, 0) AS net_ms FROM t""",
)
def _(spark, sf):
    """Clocks of four hours: many events of a run share their time and act in the order of calls."""
    events = run_events(spark, sf).withColumn("ts_ms", F.expr("ts_ms div 14400000 * 14400000"))
    return runs.pause_accounting(events)


def progress_events(spark, sf):
    """A user's events as progress of one run: one to three items each, with some idle events and pauses."""
    return fx.table(spark, sf, "events").selectExpr(
        "user_id AS run", "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS ts_ms", "event_id - event_id % 3 AS done", "2000000 AS total",
        "CASE WHEN event_type = 'view' THEN 60000 ELSE 0 END AS paused_ms",
    )


REMAINING_SQL = """WITH p AS (SELECT user_id AS run, epoch_us(ts) // 1000 AS ts_ms, event_id - event_id % 3 AS done, CASE WHEN event_type = 'view' THEN 60000 ELSE 0 END AS paused_ms FROM events),
    c AS (SELECT *, sum(paused_ms) OVER w AS paused, max(done) OVER (PARTITION BY run ORDER BY ts_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
      FROM p WINDOW w AS (PARTITION BY run ORDER BY ts_ms)),
    a AS (SELECT *, lag(ts_ms) OVER w AS pt, lag(done) OVER w AS pd, lag(CASE WHEN top IS NULL THEN 0 ELSE paused END) OVER w AS pp FROM c WHERE top IS NULL OR done > top
      WINDOW w AS (PARTITION BY run ORDER BY ts_ms)),
    m AS (SELECT run, ts_ms, CAST(ts_ms - pt - (paused - pp) AS DOUBLE) / (done - pd) AS x FROM a WHERE ts_ms - pt - (paused - pp) > 0 AND done > 8),
    l AS (SELECT c.run, c.ts_ms, c.done, (SELECT list(x ORDER BY m.ts_ms) FROM m WHERE m.run = c.run AND m.ts_ms <= c.ts_ms) AS xs FROM c)
    SELECT run, ts_ms, round(CASE WHEN len(xs) > 0 THEN list_reduce(xs, lambda s, x: 0.15 * x + 0.85 * s) END, 3) AS per_item_ms FROM l"""


@register("t06_remaining_time", REMAINING_SQL)
def _(spark, sf):
    left = runs.remaining_time(progress_events(spark, sf))
    return left.select("run", "ts_ms", F.round("per_item_ms", 3).alias("per_item_ms"))


def telemetry(spark, sf):
    """A user's events as readings of one device."""
    return fx.table(spark, sf, "events").selectExpr(
        "user_id AS device", "event_id AS seq", "CAST((event_id * 7) % 50 + 10 AS INT) AS battery_pct",
        "CAST(20 + value % 24 AS DOUBLE) AS temp_c", "CASE WHEN event_id % 97 = 0 THEN 3 ELSE 0 END AS thermal",
    )


@register(
    "t07_gate_states",
    """WITH d AS (SELECT user_id AS device, event_id AS seq, (event_id * 7) % 50 + 10 AS b, 20 + value % 24 AS t, CASE WHEN event_id % 97 = 0 THEN 3 ELSE 0 END AS th FROM events),
    k AS (SELECT *, CASE WHEN b < 20 OR t > 40 OR th >= 3 THEN true WHEN NOT (b < 25 OR t > 35) THEN false END AS decision FROM d)
    SELECT device, seq, coalesce(last_value(decision IGNORE NULLS) OVER (PARTITION BY device ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS blocked FROM k""",
)
def _(spark, sf):
    return runs.gate_states(telemetry(spark, sf), block=500).select("device", "seq", "blocked")
