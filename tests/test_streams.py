"""Batch-wise results against the same computation over whole tables."""

import random

import pytest
from pyspark.sql import functions as F

from albumetrics.operators.runs import gate_states, remaining_time
from albumetrics.operators.sequences import smooth
from albumetrics.sources.workspace import new_path
from albumetrics.streaming import pipelines, state

READINGS = "device bigint, seq bigint, battery_pct int, temp_c double, thermal int"


def test_gate_orders_a_whole_batch(spark):
    chance = random.Random(1)
    rows = [(1 + k % 2, k, chance.randint(10, 60), chance.uniform(20, 45), 0) for k in range(24000)]
    late = rows[12000:]
    chance.shuffle(late)
    gate = state.GateStream(spark, new_path(spark, "gate-test"), block=1000)
    for batch_id, part in enumerate((rows[:12000][::-1], late)):
        for _ in range(2):  # a replay changes nothing
            gate.handle(spark.createDataFrame(part, READINGS).repartition(8), batch_id)
    want = gate_states(spark.createDataFrame(rows, READINGS)).select("device", "seq", "blocked")
    assert sorted(map(tuple, gate.read().collect())) == sorted(map(tuple, want.collect()))


def test_remaining_time_of_late_batches(spark):
    rows = [(r, 1000 * k + r, k, 500, 250 if k % 7 == 0 else 0) for r in (1, 2) for k in range(1, 60)]
    schema = "run bigint, ts_ms bigint, done bigint, total bigint, paused_ms bigint"
    stream = state.RemainingStream(spark, new_path(spark, "remaining-test"))
    for batch_id, part in enumerate((rows[:30], rows[59:80], rows[30:59] + rows[80:])):
        stream.handle(spark.createDataFrame(part, schema), batch_id)
    want = remaining_time(spark.createDataFrame(rows, schema)).select("run", "ts_ms", F.round("per_item_ms", 6), "remaining_ms")
    got = stream.read().select("run", "ts_ms", F.round("per_item_ms", 6), "remaining_ms")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_rescan_marks_and_stale_faces(spark):
    ddl = "path string, rel_path string, mime_type string, modified_at bigint, taken_at bigint"
    entry = lambda name, at: (f"/m/{name}.jpg", "DCIM/", "image/jpeg", at, None)
    root = new_path(spark, "rescan-test")
    ingest = pipelines.MediaIngest(spark, root, ["DCIM"])
    # With nothing stored the whole catalogue counts, whatever the mark.
    assert ingest.rescan(spark.createDataFrame([entry("a", 10), entry("b", 20)], ddl), 0).count() == 0
    assert ingest.photos.read().count() == 2
    stale = ingest.rescan(spark.createDataFrame([entry("a", 30), entry("c", 15), entry("d", 40)], ddl), 1)
    paths = {r.photo_id: r.path for r in ingest.photos.read().collect()}
    assert [paths[r.photo_id] for r in stale.collect()] == ["/m/a.jpg"]
    assert sorted(paths.values()) == ["/m/a.jpg", "/m/b.jpg", "/m/d.jpg"]
    forced = pipelines.MediaIngest(spark, root, ["DCIM"], force=True)
    gone = forced.rescan(spark.createDataFrame([entry("a", 30), entry("c", 15)], ddl), 2)
    assert {paths[r.photo_id] for r in gone.collect()} == {"/m/b.jpg", "/m/d.jpg"}
    assert sorted(r.path for r in forced.photos.read().collect()) == ["/m/a.jpg", "/m/c.jpg"]


def _estimates(events, warmup=8, alpha=0.15):
    """Plain Python: the estimate after each time of one run's events."""
    top = last = None
    paused, ema, out = 0, None, {}
    for ts, done, _, gap in sorted(events, key=lambda e: (e[0], e[1], e[3])):
        paused += max(gap, 0)
        if top is None:
            last, top, paused = (ts, done), done, 0 if gap <= 0 else paused
        elif done > top:
            working = ts - last[0] - paused
            if working > 0 and done > warmup:
                per_item = working / (done - last[1])
                ema = per_item if ema is None else alpha * per_item + (1 - alpha) * ema
            last, top, paused = (ts, done), done, 0
        out[ts] = ema
    return out


def test_remaining_stream_equals_plain_python(spark):
    """Seven batches with late events, ties and repeated rows: each row shows what its batch could know."""
    chance = random.Random(7)
    schema = "run bigint, ts_ms bigint, done bigint, total bigint, paused_ms bigint"
    stream = state.RemainingStream(spark, new_path(spark, "remaining-random"), block=5000)
    known: dict[int, list] = {}
    want = []
    for batch_id in range(7):
        rows = []
        for run in (1, 2, 3):
            for _ in range(12):
                at = batch_id * 12 + chance.randrange(12) - (30 if run == 2 and chance.random() < 0.2 else 0)
                at = max(at, 0)
                rows.append((run, 1000 + at * 700, max(at * 2 + chance.randint(-3, 3), 0), 150, chance.choice((0, 0, 100, 900))))
        rows.append(rows[-1])
        if batch_id == 5:  # one run starts from the very beginning again
            rows.append((3, 1, 0, 150, 50))
        for row in rows:
            known.setdefault(row[0], []).append(row[1:])
        shown = {run: _estimates(events) for run, events in known.items()}
        for run, ts, done, total, _ in rows:
            ema = shown[run][ts]
            left = None if ema is None or done >= total else int((total - done) * ema + 1e-9)
            want.append((run, ts, ema, left))
        for _ in range(2 if batch_id in (2, 5) else 1):  # a replay changes nothing
            stream.handle(spark.createDataFrame(rows, schema).repartition(3), batch_id)
    rank = lambda r: (r[0], r[1], round(r[2] or -1, 3), r[3] or -1)
    got, want = sorted(map(tuple, stream.read().collect()), key=rank), sorted(want, key=rank)
    for found, plain in zip(got, want, strict=True):
        assert found[:2] == plain[:2]
        assert found[2] == plain[2] or found[2] == pytest.approx(plain[2], rel=1e-9)
        assert found[3] == plain[3] or abs(found[3] - plain[3]) <= 1


def test_a_batch_in_order_reads_no_event(spark, monkeypatch):
    schema = "run bigint, ts_ms bigint, done bigint, total bigint, paused_ms bigint"
    stream = state.RemainingStream(spark, new_path(spark, "remaining-flat"))
    monkeypatch.setattr(stream.kept, "read", lambda **_: 1 / 0)
    monkeypatch.setattr(stream.marked, "read", lambda **_: 1 / 0)
    rows = [(1, 1000 * k, k, 100, 0) for k in range(1, 61)]
    for batch_id in range(12):
        stream.handle(spark.createDataFrame(rows[batch_id * 5:batch_id * 5 + 5], schema), batch_id)
    assert len(stream.kept.runs()) < 16 and len(stream.carried.runs()) < 16
    assert {r.per_item_ms for r in stream.read().collect()} == {None, 1000.0}


def test_tied_progress_has_one_answer(spark):
    rows = [(1, 1000 * (k // 2), k, 100, 300 if k % 5 == 0 else 0) for k in range(1, 40)]
    schema = "run bigint, ts_ms bigint, done bigint, total bigint, paused_ms bigint"
    answers = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = remaining_time(spark.createDataFrame(rows, schema).repartition(4)).select("ts_ms", "done", F.round("per_item_ms", 6))
        answers.add(tuple(sorted(map(tuple, got.collect()), key=str)))
    assert len(answers) == 1
    plain = _estimates([r[1:] for r in rows])
    assert all(e == (None if plain[ts] is None else round(plain[ts], 6)) for ts, _, e in answers.pop())


def test_remaining_stream_of_an_empty_batch(spark):
    schema = "run bigint, ts_ms bigint, done bigint, total bigint, paused_ms bigint"
    stream = state.RemainingStream(spark, new_path(spark, "remaining-empty"))
    stream.handle(spark.createDataFrame([], schema), 0)
    stream.handle(spark.createDataFrame([(1, 1000, 9, 20, None), (1, 3000, 10, 20, 0)], schema), 1)
    stream.handle(spark.createDataFrame([], schema), 2)
    assert sorted((r.ts_ms, r.remaining_ms) for r in stream.read().collect()) == [(1000, None), (3000, 20000)]


def test_averages_survive_a_join_that_turns_into_a_broadcast(spark):
    """A join planned with a shuffle, of which the small side is broadcast at run time, leaves each run's rows together and in order."""
    chance = random.Random(3)
    rows = [(run, 1000 * k, float(chance.randint(1, 900))) for run in range(40) for k in range(50)]
    chance.shuffle(rows)
    want = {}
    for run, ts, value in sorted(rows):
        before = want.get((run, ts - 1000))
        want[run, ts] = value if before is None else 0.15 * value + 0.85 * before
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "16KB",
        # Several tasks even for few rows.
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "4KB",
    }
    earlier = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        frame = spark.createDataFrame(rows, "run bigint, ts_ms bigint, x double").repartition(8)
        got = {(r.run, r.ts_ms): r.ema for r in smooth(frame, "run", "ts_ms", "x", "ema", 0.15, block=20).collect()}
    finally:
        for name, value in earlier.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
