"""Box matching, suppression, packets, scoring, logs, runs and snapshots."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from albumetrics.operators import boxes, catalog, runs, scoring, sequences
from albumetrics.schema import FACES_DDL, PERSONS_DDL, PHOTOS_DDL, Library
from albumetrics.sources import logs, snapshots, xmp
from albumetrics.sources.workspace import new_path
from albumetrics.streaming.changes import ChangeLog

BOX_DDL = "photo_id bigint, box_id bigint, x_min double, y_min double, width double, height double, score double"


def random_boxes(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y = rng.uniform(0, 60, 2)
        rows.append((i % 2, i, float(x), float(y), float(rng.uniform(5, 15)), float(rng.uniform(5, 15)), float(round(rng.uniform(), 1))))
    rows += [(0, 1000 + i, *rows[0][2:6], 0.5) for i in range(50)]
    rows.append((0, 2000, 1.0, 1.0, 0.0, 0.0, 0.9))
    return spark.createDataFrame(rows, BOX_DDL), rows


def greedy(rows, threshold):
    kept = []
    for row in sorted(rows, key=lambda r: (-r[6], r[1])):
        def iou(a, b):
            w = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
            h = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
            inter = max(w, 0) * max(h, 0)
            union = a[4] * a[5] + b[4] * b[5] - inter
            return inter / union if union > 0 else 0
        if all(r[0] != row[0] or iou(r, row) <= threshold for r in kept):
            kept.append(row)
    return {r[1] for r in kept}


@pytest.mark.parametrize("limit", [20_000, 10])
def test_suppression_equals_greedy(spark, limit):
    df, rows = random_boxes(spark)
    found = {r.box_id for r in boxes.suppress(df, 0.3, group_limit=limit).collect()}
    assert found == greedy(rows, 0.3)


@pytest.mark.parametrize("crowd", [1000, 5])
def test_best_overlap(spark, crowd):
    rng = np.random.default_rng(2)
    regions, found = [], []
    for i in range(40):
        x, y, w, h = (float(v) for v in (*rng.uniform(0.2, 0.8, 2), *rng.uniform(0.1, 0.3, 2)))
        regions.append((i, 1, (x, y, w, h, None)))
        found.append((1, 100 + i, x - w / 2 + 0.02, y - h / 2, w, h, [float(i)]))
    found.append((1, 50, *found[0][2:6], [99.0]))
    ddl = "region_id bigint, photo_id bigint, region struct<x:double,y:double,w:double,h:double,landmarks:array<double>>"
    r = spark.createDataFrame(regions, ddl)
    d = spark.createDataFrame(found, "photo_id bigint, detection_id bigint, x_min double, y_min double, width double, height double, landmarks array<double>")
    best = {row.region_id: row.detection_id for row in boxes.best_overlap(r, d, crowd=crowd).collect()}

    def iou(region, det):
        x, y, w, h, _ = region[2]
        iw = min(x + w / 2, det[2] + det[4]) - max(x - w / 2, det[2])
        ih = min(y + h / 2, det[3] + det[5]) - max(y - h / 2, det[3])
        inter = max(iw, 0) * max(ih, 0)
        return inter / (w * h + det[4] * det[5] - inter)

    for region in regions:
        scored = max(((round(iou(region, det), 12), -det[1]) for det in found))
        assert best[region[0]] == (-scored[1] if scored[0] > 0.3 else None)


def test_packet_round_trip_and_tags():
    regions = [{"name": "A & B <x>", "x": 0.1, "y": 0.2, "w": 0.3, "h": 0.4}, {"name": None, "x": 0.5, "y": 0.5, "w": 0.1, "h": 0.1}]
    packet = xmp.rewrite_packet(None, regions)
    assert xmp.parse_regions(packet) == regions
    again = xmp.rewrite_packet(packet, regions[1:])
    assert xmp.parse_regions(again) == regions[1:] and "A &amp; B" not in again


def test_packet_keeps_other_properties():
    ns = " ".join(f'xmlns:{p}="{u}"' for p, u in xmp.NS.items())
    packet = (
        f'<x:xmpmeta {ns}><rdf:RDF><rdf:Description rdf:about="" dc:format="image/jpeg">'
        "<dc:subject><rdf:Bag><rdf:li>beach</rdf:li><rdf:li>Ann</rdf:li></rdf:Bag></dc:subject>"
        "<digiKam:TagsList><rdf:Seq><rdf:li>People/Ann</rdf:li></rdf:Seq></digiKam:TagsList>"
        "</rdf:Description></rdf:RDF></x:xmpmeta>"
    )
    written = xmp.rewrite_packet(packet, [{"name": "Bo", "x": 0.1, "y": 0.1, "w": 0.1, "h": 0.1}])
    root = xmp.ET.fromstring(written)
    assert [li.text for li in xmp._items(root, "dc:subject")] == ["beach", "Bo"]
    assert "image/jpeg" in written
    cleared = xmp.ET.fromstring(xmp.rewrite_packet(written, None, clear=True))
    assert [li.text for li in xmp._items(cleared, "dc:subject")] == ["beach"]
    assert xmp._items(cleared, "digiKam:TagsList") == []


@pytest.mark.parametrize("faces", [3, 600, 700, 3000])
def test_photos_of_many_faces_keep_all(spark, faces):
    photos = spark.createDataFrame([(1, "a.jpg", True, 5), (2, "b.jpg", True, 5)], "photo_id bigint, path string, pending_xmp_write boolean, modified_at bigint")
    rows = spark.range(faces).select(
        F.lit(1).cast("bigint").alias("photo_id"), F.col("id").alias("face_id"), F.concat(F.lit("Ü"), F.col("id").cast("string")).alias("name"),
        F.lit(False).alias("ignored"), F.struct(*[F.lit(0.25).alias(c) for c in "xywh"]).alias("region"))
    after, packets = xmp.drain_pending(photos, rows, photos.select("path"), F.lit(9).cast("bigint"))
    assert {tuple(r) for r in after.select("photo_id", "pending_xmp_write", "modified_at").collect()} == {(1, False, 9), (2, False, 9)}
    packet = {r.photo_id: r.packet for r in packets.collect()}[1]
    bodies = xmp.packet_segments(packet)
    assert all(len(b) + 2 <= 0xFFFF for b in bodies) and (len(bodies) > 1) == (len(packet.encode()) > 65_504)
    # Segments may come in any order.
    jpeg = b"\xff\xd8" + b"".join(b"\xff\xe1" + (len(b) + 2).to_bytes(2, "big") + b for b in [bodies[0], *bodies[:0:-1]]) + b"\xff\xd9"
    read = xmp.parse_regions(xmp.locate_packet(jpeg))
    assert {r["name"] for r in read} == {f"Ü{k}" for k in range(faces)} and len(read) == faces


def test_broken_packets():
    assert xmp.parse_regions("<not xml") == [] and xmp.parse_regions(None) == []
    assert xmp.rewrite_packet(None, None, clear=True) is None
    assert xmp.locate_packet(b"no jpeg") is None
    body = xmp.PACKET_HEADER + xmp.BOM + "<p>ü</p>".encode()
    jpeg = b"\xff\xd8\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xd9"
    assert xmp.locate_packet(jpeg) == "<p>ü</p>"


def test_scoring_isolates_the_failing_row(spark):
    def model(frame):
        if (frame["k"] == 3).any():
            raise RuntimeError("bad row")
        return [[float(k)] for k in frame["k"]]

    pending = spark.range(8).withColumnRenamed("id", "k")
    found = {r.k: (r.result, r.error) for r in scoring.score_batches(pending, model, "k").collect()}
    assert found[3] == (None, "RuntimeError: bad row")
    assert all(found[k] == ([float(k)], None) for k in range(8) if k != 3)


def test_log_lines_of_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("01-01 00:00:00.000 I x: one\n  trace\n01-03 00:00:00.000 I x: two\n  more\n")
    lines = logs.read_log_lines(spark, str(tmp_path))
    kept = [r.line for r in logs.filter_by_stamp(lines, "01-02 00:00:00.000").orderBy("line_no").collect()]
    assert kept == ["01-03 00:00:00.000 I x: two", "  more"]


def test_process_lines(spark):
    rows = [(0, "01-01 00:00:00.000  12  1 I A: marker"), (1, "01-01 00:00:01.000  12  1 I B: x"), (2, "01-01 00:00:01.000  13  1 I B: y"), (3, "--------- beginning")]
    df = spark.createDataFrame(rows, "line_no bigint, line string")
    assert sorted(r.line_no for r in logs.lines_of_processes(df, ["marker"]).collect()) == [0, 1]


def _progress(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "run bigint, ts_ms bigint, done bigint, total bigint, paused_ms bigint")


def _left(df):
    return {r.done: r.remaining_ms for r in runs.remaining_time(df, block=200_000).collect()}


def test_remaining_time(spark):
    minute = 60_000
    steady = _left(_progress(spark, [(i * minute + 1, i, 100, 0) for i in range(0, 11)]))
    assert steady[8] is None and steady[10] == 90 * minute
    paused = [(i * minute + 1 + (60 * minute if i >= 15 else 0), i, 100, 60 * minute if i == 15 else 0) for i in range(0, 21)]
    assert _left(_progress(spark, paused))[20] == 80 * minute
    done = _left(_progress(spark, [(i * minute + 1, i, 12, 0) for i in range(0, 13)]))
    assert done[12] is None
    slower = [(i * minute + 1, i, 200, 0) for i in range(0, 21)] + [(20 * minute + 1 + k * 3 * minute, 20 + k, 200, 0) for k in range(1, 31)]
    assert _left(_progress(spark, slower))[50] == pytest.approx(150 * 3 * minute, rel=0.05)


def test_blocks_do_not_change_results(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), i, None if rng.uniform() < 0.7 else int(i), float(rng.uniform())) for i, k in enumerate(rng.integers(0, 3, 200))]
    df = spark.createDataFrame(rows, "k bigint, o bigint, v bigint, x double")
    for fn in (
        lambda b: sequences.carry_forward(df, "k", "o", "v", "out", b).select("k", "o", "out"),
        lambda b: sequences.previous_row(df, "k", "o", ["x"], b).select("k", "o", F.col("prev_x").alias("out")),
        lambda b: sequences.running_sum(df, "k", "o", F.col("o"), "out", b).select("k", "o", "out"),
        lambda b: sequences.running_sum(df, "k", "o", F.col("o"), "s", b, top=("x", "out")).select("k", "o", "out"),
        lambda b: sequences.smooth(df, "k", "o", "x", "out", 0.15, b).select("k", "o", F.round("out", 9).alias("out")),
    ):
        assert sorted(fn(7).collect()) == sorted(fn(10_000).collect())


def test_gate(spark):
    readings = [(50, 30.0, 0), (19, 30.0, 0), (22, 30.0, 0), (25, 30.0, 0), (50, 41.0, 0), (50, 38.0, 0), (50, 35.0, 0), (50, 30.0, 3), (-1, 0.0, 0)]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(readings)], "device bigint, seq bigint, battery_pct int, temp_c double, thermal int")
    states = [r.blocked for r in runs.gate_states(df, block=2).orderBy("seq").collect()]
    assert states == [False, True, True, False, True, True, False, True, False]
    # A resume limit laxer than the pause limit is pulled up to it.
    assert runs.GateConfig(resume_battery=10, resume_temp=50.0).limits(True) == (20, 40.0)


def test_pause_kinds_close_each_other(spark):
    rows = [("start", 0), ("pause_manual", 10), ("pause_power", 25), ("resume", 30), ("finish", 100)]
    df = spark.createDataFrame([(1, t, k) for k, t in rows], "run bigint, ts_ms bigint, kind string")
    row = runs.pause_accounting(df, block=20).first()
    assert (row.total_ms, row.manual_ms, row.power_ms, row.net_ms) == (100, 15, 5, 80)


def test_tied_events_have_one_answer(spark):
    rows = [("start", 0, 1), ("pause_manual", 4000, 2), ("resume", 4000, 3), ("finish", 8000, 4)]
    for known, want in ((True, 0), (False, 0)):
        answers = set()
        for turn in range(4):
            mixed = rows[turn:] + rows[:turn]
            df = spark.createDataFrame([(1, t, k, s) for k, t, s in mixed], "run bigint, ts_ms bigint, kind string, seq bigint")
            answers.add(runs.pause_accounting(df if known else df.drop("seq"), block=3000).first().manual_ms)
        assert answers == {want}
    # Called the other way round, the pause lasts.
    df = spark.createDataFrame([(1, 0, "start", 1), (1, 4000, "resume", 2), (1, 4000, "pause_manual", 3), (1, 8000, "finish", 4)], df.schema)
    assert runs.pause_accounting(df).first().manual_ms == 4000


def small_library(spark):
    photos = [(1, "/a.jpg", "DCIM/Camera", 100, None, 2, False), (2, "/b.jpg", "DCIM/Camera", 100, None, 2, False), (3, "/c.jpg", "DCIM/Camera", 100, None, 1, False)]
    faces = [(10, 1, 5, "Ann", None, None, False, None, False), (11, 2, 5, None, None, None, False, None, False)]
    return Library(
        spark.createDataFrame(photos, PHOTOS_DDL), spark.createDataFrame([(5, "Ann", None)], PERSONS_DDL), spark.createDataFrame(faces, FACES_DDL)
    )


def test_ingest_twice_is_ingest_once(spark):
    lib = small_library(spark)
    files = [("/a.jpg", "DCIM/Camera/", "image/jpeg", 100, None), ("/b.jpg", "DCIM/Camera/x/", "image/jpeg", 200, 7), ("/d.jpg", "DCIM/Camera/", "image/jpeg", 50, None), ("/e.jpg", "Music/", "image/jpeg", 50, None)]
    listing = spark.createDataFrame(files, "path string, rel_path string, mime_type string, modified_at bigint, taken_at bigint")
    once = catalog.ingest(lib, listing, ["DCIM/Camera"])
    twice = catalog.ingest(once, listing, ["DCIM/Camera"])
    state = lambda x: sorted((r.path, r.modified_at, r.stage) for r in x.photos.collect())
    assert state(once) == [("/a.jpg", 100, 2), ("/b.jpg", 200, 0), ("/d.jpg", 50, 0)] == state(twice)
    assert [r.face_id for r in twice.faces.collect()] == [10]


def test_snapshots(spark):
    store = snapshots.SnapshotStore(spark, new_path(spark, "store"))
    lib = small_library(spark)
    assert store.latest() is None and store.write(lib) == 1
    second = Library(snapshots.upsert(lib.photos, lib.photos.filter("photo_id = 1").withColumn("stage", F.lit(0)), "photo_id"), lib.persons, lib.faces)
    assert store.write(second) == 2
    assert {r.photo_id: r.stage for r in store.read().photos.collect()} == {1: 0, 2: 2, 3: 1}
    assert {r.photo_id: r.stage for r in store.read(1).photos.collect()} == {1: 2, 2: 2, 3: 1}


def test_change_log_replay(spark):
    log = ChangeLog(spark, new_path(spark, "changes"), "k bigint, v string", "k")
    assert log.read().count() == 0
    first, second = (spark.createDataFrame(r, "k bigint, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    for batch, rows in ((0, first), (1, second), (1, second), (0, first)):
        log.write(batch, rows)
    assert sorted(map(tuple, log.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    log.write(2, second.withColumn("deleted", F.col("k") == 3))
    assert sorted(map(tuple, log.read().collect())) == [(1, "a"), (2, "c")]
    assert sorted(map(tuple, log.read(before=1).collect())) == [(1, "a"), (2, "b")]


def test_media_files(spark, tmp_path):
    (tmp_path / "DCIM" / "Camera").mkdir(parents=True)
    (tmp_path / "DCIM" / "Camera" / "a.jpg").write_bytes(b"x")
    (tmp_path / "DCIM" / "b.txt").write_bytes(b"x")
    found = catalog.read_media_files(spark, str(tmp_path)).collect()
    assert [r.rel_path for r in found] == ["DCIM/Camera/"]


@pytest.mark.parametrize("block", [3, 1000, 3_600_000])
def test_averages_of_many_runs_share_calls(spark, block):
    """Runs longer than an Arrow batch and runs of one row equal a plain loop, with no Python call per run."""
    rng = np.random.default_rng(4)
    sizes = {1: 1, 2: 7, 3: 12_000 if block > 3 else 200, **{k: 2 for k in range(10, 300)}}
    rows = [(k, i, float(v)) for k, n in sizes.items() for i, v in enumerate(rng.uniform(0, 9, n))]
    smoothed = sequences.smooth(spark.createDataFrame(rows, "k bigint, o bigint, v double"), "k", "o", "v", "e", 0.15, block)
    assert "FlatMapGroups" not in smoothed._jdf.queryExecution().toString()
    found, level = {(r.k, r.o): r.e for r in smoothed.collect()}, {}
    for k, o, v in rows:
        level[k] = v if o == 0 else 0.15 * v + 0.85 * level[k]
        assert found[k, o] == pytest.approx(level[k], abs=1e-9)


def test_packets_are_handed_over_in_pieces():
    """Crowded photos of one Arrow batch come back in several, each of bounded size, and none is lost."""
    region = {"name": "N", "x": 0.5, "y": 0.5, "w": 0.1, "h": 0.2}
    batch = pa.RecordBatch.from_pylist([{"photo_id": i, "packet": None, "regions": [region] * 20_000 if i else None} for i in range(6)])
    pieces = list(xmp._written(iter([batch])))
    assert [i for p in pieces for i in p.column(0).to_pylist()] == list(range(6))
    assert len(pieces) > 1 and max(p.nbytes for p in pieces) < 2 * xmp.BATCH_CHARS
    assert len(xmp.parse_regions(pieces[-1].column(1)[0].as_py())) == 20_000


def test_batches_of_large_packets_are_bounded_by_bytes(spark):
    """Packets go to Python a few megabytes at a time, however many rows that makes."""
    from albumetrics.session import configure

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    large = configure(spark).range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("packet"))
    found = [r.n for r in large.mapInArrow(rows, "n bigint").collect()]
    assert sum(found) == 40 and max(found) <= 9
