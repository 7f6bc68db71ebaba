"""Per-key results over streams: device alarms and remaining time, batch by batch.

A batch goes through the same block functions as a whole table, so its rows are ordered across everything that arrives
together and no key is held in one task. Each batch writes folders of its own; replaying it changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from albumetrics.operators.runs import ALPHA, CARRIED, HOUR_MS, WARMUP, GateConfig, carried_after, follow_progress, gate_states
from albumetrics.operators.sequences import BLOCK
from albumetrics.sources.workspace import Scratch
from albumetrics.streaming.changes import ChangeLog
from albumetrics.streaming.pipelines import start_batches

EVENT = ("run", "ts_ms", "done", "total", "paused_ms")


class GateStream:
    """Alarm state per reading ``(device, seq, battery_pct, temp_c, thermal)``.

    Readings count in the order of arrival, and by ``seq`` within a batch. Between batches one row per device is carried.
    """

    ddl = "device bigint, seq bigint, blocked boolean"

    def __init__(self, spark: SparkSession, root: str, config: GateConfig | None = None, block: int = BLOCK):
        self.spark, self.root, self.config, self.block = spark, root.rstrip("/"), config or GateConfig(), block
        self.carried = ChangeLog(spark, f"{self.root}/carried", "device bigint, blocked boolean", "device")

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        start = self.carried.read(before=batch_id, only=batch)
        states = gate_states(batch, self.config, self.block, start).select("device", "seq", "blocked")
        path = f"{self.root}/states/batch={batch_id}"
        states.write.mode("overwrite").parquet(path)
        written = self.spark.read.schema(self.ddl).parquet(path)
        self.carried.write(batch_id, written.groupBy("device").agg(F.max_by("blocked", "seq").alias("blocked")))

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        start_batches(stream, self.handle, checkpoint).awaitTermination()

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"{self.ddl}, batch bigint").parquet(f"{self.root}/states").drop("batch")


class RemainingStream:
    """Remaining time per progress event ``(run, ts_ms, done, total, paused_ms)``, from what is known at its batch.

    Per run one row is carried (``CARRIED``), so a batch that goes on in time reads no earlier event. What a run handed on
    after each of its batches stays as a mark: where events come late, the run is replayed from the last mark before them
    that no late event has touched, and only events after that mark are read. Rows already given out are not given again.
    Batches come in order, and the last may be replayed.
    """

    events = "event struct<batch:bigint,ts_ms:bigint,done:bigint,total:bigint,paused_ms:bigint,run:bigint>, run bigint, n bigint"
    marks = f"mark struct<run:bigint,at:bigint>, from_ms bigint, {CARRIED}"
    ddl = "run bigint, ts_ms bigint, per_item_ms double, remaining_ms bigint"

    def __init__(self, spark: SparkSession, root: str, warmup: int = WARMUP, alpha: float = ALPHA, block: int = HOUR_MS):
        self.spark, self.root, self.warmup, self.alpha, self.block = spark, root.rstrip("/"), warmup, alpha, block
        self.kept = ChangeLog(spark, f"{self.root}/events", self.events, "event")
        self.marked = ChangeLog(spark, f"{self.root}/marks", self.marks, "mark")
        self.carried = ChangeLog(spark, f"{self.root}/carried", CARRIED, "run")

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        scratch = Scratch(self.spark, "remaining")
        arrived = scratch.table(batch.select(*[F.col(c).cast("bigint").alias(c) for c in EVENT]), "arrived")
        spans = arrived.groupBy("run").agg(F.min("ts_ms").alias("from_ms"))
        start = scratch.table(self.carried.read(before=batch_id, only=spans).join(spans, "run"), "start")
        events = arrived.withColumn("_new", F.lit(True))
        late = start.filter("from_ms <= ts_ms").select("run", "from_ms")
        if not late.isEmpty():
            resumed = scratch.table(self._marks_before(late, batch_id), "resumed")
            events = events.unionByName(self._events_after(late, resumed, batch_id).withColumn("_new", F.lit(False)))
            start = start.filter("from_ms > ts_ms").select(*resumed.columns).unionByName(resumed)
        followed = scratch.table(
            follow_progress(events, start.drop("from_ms"), self.warmup, self.alpha, self.block, scratch.table), "followed")
        followed.filter("_new").select("run", "ts_ms", "per_item_ms", "remaining_ms").write.mode("overwrite").parquet(
            f"{self.root}/remaining/batch={batch_id}")
        at = F.lit(batch_id).cast("bigint")
        ends = scratch.table(carried_after(followed), "ends")
        # Equal events are one row with their number.
        event = F.struct(at.alias("batch"), *EVENT[1:], "run").alias("event")
        self.kept.write(batch_id, arrived.groupBy(*EVENT).agg(F.count(F.lit(1)).alias("n")).select(event, "run", "n"))
        self.marked.write(
            batch_id, ends.join(spans, "run").select(F.struct("run", at.alias("at")).alias("mark"), "from_ms", *ends.columns))
        self.carried.write(batch_id, ends)
        scratch.drop()

    def _marks_before(self, late: DataFrame, batch_id: int) -> DataFrame:
        """Per run the last mark that lies before its late events and that no batch since has gone behind."""
        marks = self.marked.read(before=batch_id, only=late, by="run").withColumnRenamed("from_ms", "_began")
        since = Window.partitionBy("run").orderBy(F.desc("mark.at")).rowsBetween(Window.unboundedPreceding, -1)
        holding = marks.withColumn("_behind", F.min("_began").over(since)).join(late, "run").filter(
            (F.col("ts_ms") < F.least("from_ms", F.coalesce("_behind", "from_ms"))))
        names = [c for c in self.carried.columns() if c != "run"]
        best = holding.groupBy("run").agg(F.max_by(F.struct(*names), "ts_ms").alias("_m"))
        return best.select("run", *[F.col(f"_m.{c}").alias(c) for c in names])

    def _events_after(self, late: DataFrame, resumed: DataFrame, batch_id: int) -> DataFrame:
        """Earlier events of late runs, from the marks on."""
        kept = self.kept.read(before=batch_id, only=late, by="run").select("run", "event.ts_ms", "event.done", "event.total", "event.paused_ms", "n")
        after = kept.join(resumed.select("run", F.col("ts_ms").alias("_mark")), "run", "left").filter("_mark IS NULL OR ts_ms > _mark")
        return after.select(*EVENT, F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("col")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        start_batches(stream, self.handle, checkpoint).awaitTermination()

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"{self.ddl}, batch bigint").parquet(f"{self.root}/remaining").drop("batch")
