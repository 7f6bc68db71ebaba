"""Change logs by levels, published counts, and snapshots by slices with two writers."""

import pytest
from pyspark.sql import functions as F

from albumetrics.schema import Library
from albumetrics.sources import snapshots
from albumetrics.sources.manifest import VersionTaken
from albumetrics.sources.workspace import child_names, new_path
from albumetrics.streaming.changes import KEEP, ChangeLog


def test_runs_stay_few_and_old_versions_whole(spark):
    log = ChangeLog(spark, new_path(spark, "levels"), "k bigint, v bigint", "k", merge=3)
    want, versions = {}, {}
    for batch in range(30):
        rows = [(k, batch) for k in range(batch % 4, 12, 4)]
        gone = batch % 5 == 4
        frame = spark.createDataFrame(rows, "k bigint, v bigint").coalesce(1)
        for _ in range(1 + (batch in (8, 9))):  # replays, one of them of a batch that merges
            log.write(batch, frame.withColumn("deleted", F.lit(gone) & (F.col("k") < 4)))
        for k, v in rows:
            want[k] = v
            if gone and k < 4:
                del want[k]
        versions[batch] = dict(want)
        assert len(log.runs()) <= 2 * 4
    held = log.read(before=29)
    assert {r.k: r.v for r in log.read().collect()} == want
    log.write(30, spark.createDataFrame([(0, 99)], "k bigint, v bigint"))
    assert {r.k: r.v for r in held.collect()} == versions[28]
    assert len(child_names(spark, f"{log.root}/manifests")) <= 2 * KEEP + 2


def library(spark, n):
    photos = spark.range(n).selectExpr(
        "id AS photo_id", "concat('/', id) AS path", "'f' AS folder", "id AS modified_at", "CAST(NULL AS BIGINT) AS taken_at",
        "0 AS stage", "false AS pending_xmp_write")
    empty = [spark.createDataFrame([], ddl) for ddl in (snapshots.PERSONS_DDL, snapshots.FACES_DDL)]
    return Library(photos, *empty)


def test_an_edit_writes_one_slice(spark):
    store = snapshots.SnapshotStore(spark, new_path(spark, "slices"), slices=8)
    first = store.write(library(spark, 200))
    row = store.read().photos.filter("photo_id = 7").withColumn("stage", F.lit(2))
    second = store.edit({"photos": row})
    before, after = store.files(first, "photos"), store.files(second, "photos")
    assert before.keys() == after.keys() and sum(before[s] != after[s] for s in before) == 1
    assert store.read().photos.count() == 200 and store.read().faces.count() == 0
    assert [r.photo_id for r in store.read().photos.filter("stage = 2").collect()] == [7]
    third = store.edit({"photos": row.withColumn("photo_id", F.lit(500).cast("bigint"))},
                       {"photos": store.read().photos.filter("photo_id < 3").select("photo_id")})
    assert store.read(third).photos.count() == 198 and store.read(first).photos.count() == 200
    store.expire(keep=1)
    assert store.read().photos.count() == 198 and store.latest() == third


def test_of_two_writers_the_second_is_told(spark):
    store = snapshots.SnapshotStore(spark, new_path(spark, "writers"), slices=4)
    base = store.write(library(spark, 20))
    other = snapshots.SnapshotStore(spark, store.root, slices=4)
    rows = store.read().photos
    store.edit({"photos": rows.filter("photo_id = 1").withColumn("stage", F.lit(1))}, parent=base)
    late = {"photos": rows.filter("photo_id = 2").withColumn("stage", F.lit(2))}
    with pytest.raises(VersionTaken):
        other.edit(late, parent=base)
    other.edit(late)
    assert {r.photo_id: r.stage for r in store.read().photos.filter("stage > 0").collect()} == {1: 1, 2: 2}
