"""Progress, pauses and alarms of runs and devices, from event tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetrics.operators.sequences import (
    BLOCK,
    carry_forward,
    previous_row,
    running_sum,
    smooth,
)
from albumetrics.sources.workspace import materialize

# Fixed values.
WARMUP = 8
ALPHA = 0.15
THERMAL_SEVERE = 3

KINDS = ("start", "pause_manual", "pause_power", "resume", "finish")

# Events of one run are worked on hour by hour.
HOUR_MS = 3_600_000


@dataclass(frozen=True)
class GateConfig:
    """Pause and resume limits; a resume limit is never laxer than its pause limit."""

    min_battery: int = 20
    max_temp: float = 40.0
    resume_battery: int = 25
    resume_temp: float = 35.0

    def limits(self, blocked: bool) -> tuple[int, float]:
        if not blocked:
            return self.min_battery, self.max_temp
        return max(self.resume_battery, self.min_battery), min(self.resume_temp, self.max_temp)


def over_limit(config: GateConfig, blocked: bool) -> Column:
    """Does a status (battery_pct, temp_c, thermal) count as bad under the limits in force?

    A battery below 0 or a temperature at or below 0 is an unknown reading.
    """
    battery, temp = config.limits(blocked)
    low = (F.col("battery_pct") >= 0) & (F.col("battery_pct") < battery)
    hot = (F.col("temp_c") > 0) & (F.col("temp_c") > temp)
    return low | hot | (F.col("thermal") >= THERMAL_SEVERE)


def gate_states(
    telemetry: DataFrame, config: GateConfig | None = None, block: int = BLOCK, start: DataFrame | None = None
) -> DataFrame:
    """Telemetry ``(device, seq, battery_pct, temp_c, thermal)`` with ``blocked`` per reading.

    A reading past a pause limit blocks, one inside the resume limits clears;
    any other leaves the state alone, so the state is the last that decided.
    ``start`` (device, blocked) is the state before the first reading.
    """
    config = config or GateConfig()
    decision = F.when(over_limit(config, False), True).when(~over_limit(config, True), False)
    marked = telemetry.withColumn("_decision", decision)
    filled = carry_forward(marked, "device", "seq", "_decision", "blocked", block)
    if start is None:
        return filled.withColumn("blocked", F.coalesce("blocked", F.lit(False))).drop("_decision")
    begun = filled.join(start.select("device", F.col("blocked").alias("_start")), "device", "left")
    return begun.withColumn("blocked", F.coalesce("blocked", "_start", F.lit(False))).drop("_decision", "_start")


def pause_accounting(events: DataFrame, block: int = HOUR_MS) -> DataFrame:
    """Total, paused and net time per run from ``(run, ts_ms, kind)`` and, if known, ``seq``, the order of calls.

    Kinds: ``start``, ``pause_manual``, ``pause_power``, ``resume``, ``finish``.
    A pause lasts to the next event that starts or ends a pause, or to the
    finish; so a change of kind closes the one and opens the other. Events of
    one time act in the order of ``seq``, and where that is absent or equal in
    the order of the list above: one answer for every order of the input.
    """
    seq = F.col("seq") if "seq" in events.columns else F.lit(0)
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    events = events.select("run", "ts_ms", "kind", seq.alias("_seq"), place.alias("_place"))
    ordered = previous_row(events, "run", "ts_ms", ["kind", "ts_ms"], block, ties=("_seq", "_place"))
    span = F.greatest(F.col("ts_ms") - F.col("prev_ts_ms"), F.lit(0))

    def spent(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("prev_kind") == kind, span)), F.lit(0))

    total = F.max(F.when(F.col("kind") == "finish", F.col("ts_ms"))) - F.min(F.when(F.col("kind") == "start", F.col("ts_ms")))
    summed = ordered.groupBy("run").agg(
        total.alias("total_ms"), spent("pause_manual").alias("manual_ms"), spent("pause_power").alias("power_ms")
    )
    net = F.greatest(F.col("total_ms") - F.col("manual_ms") - F.col("power_ms"), F.lit(0))
    return summed.withColumn("net_ms", net)


#: What a run hands on after an event: its time, the greatest ``done``, the pauses so far, the last event that brought
#: new items (with the pauses counted up to it), and the average.
CARRIED = "run bigint, ts_ms bigint, top bigint, paused bigint, adv_ts bigint, adv_done bigint, adv_paused bigint, ema double"


def remaining_time(
    progress: DataFrame, warmup: int = WARMUP, alpha: float = ALPHA, block: int = HOUR_MS
) -> DataFrame:
    """Remaining time per progress event ``(run, ts_ms, done, total, paused_ms)``, null until warm.

    Only events that bring new items are measured, in working time per item
    without the pauses since the last of them, and not within the warm-up.
    ``paused_ms`` is what was paused before the event. Events of one time act in
    the order of ``done``, then of ``paused_ms``, and all show the estimate after
    the last of them.
    """
    followed = follow_progress(progress, None, warmup, alpha, block)
    return followed.drop(*[c for c in followed.columns if c.startswith("_") and c not in progress.columns])


def follow_progress(
    progress: DataFrame, start: DataFrame | None, warmup: int = WARMUP, alpha: float = ALPHA, block: int = HOUR_MS,
    store: Callable[[DataFrame, str], DataFrame] = materialize,
) -> DataFrame:
    """``remaining_time`` with what ``carried_after`` needs in columns that start with ``_``.

    ``start`` (``CARRIED``) is what each run handed on before its first event
    here; the events are then continued from it as if those before were here.
    """
    if start is None:
        start = progress.sparkSession.createDataFrame([], CARRIED)
    before = start.select("run", *[F.col(c).alias(f"_from_{c}") for c in start.columns if c != "run"])
    paused = F.greatest("paused_ms", F.lit(0))
    summed = running_sum(progress, "run", "ts_ms", paused, "_paused", block, top=("done", "_top"), ties=("done", "paused_ms"))
    topped = summed.join(before, "run", "left").withColumns({
        "_paused": F.col("_paused") + F.coalesce("_from_paused", F.lit(0)), "_top": F.greatest("_top", "_from_top"),
    })
    advance = F.col("_top").isNull() | (F.col("done") > F.col("_top"))
    # What was paused before a run's first event counts for its first step.
    counted = F.when(F.col("_top").isNull(), F.lit(0)).otherwise(F.col("_paused"))
    topped = store(topped.withColumns({"_advance": advance, "_counted": counted}), "progress")
    steps = previous_row(topped.filter("_advance"), "run", "ts_ms", ["done", "ts_ms", "_counted"], block, ties=("done",))
    since = F.col("ts_ms") - F.coalesce("prev_ts_ms", "_from_adv_ts")
    working = since - (F.col("_paused") - F.coalesce("prev__counted", "_from_adv_paused"))
    items = F.col("done") - F.coalesce("prev_done", "_from_adv_done")
    measured = steps.select("run", "ts_ms", "done", working.alias("_working"), (working / items).alias("_per_item")).filter(
        (F.col("_working") > 0) & (F.col("done") > warmup)
    )
    # The average handed on is the first value of what is smoothed here, so it is continued.
    handed = start.filter("ema IS NOT NULL").select("run", "ts_ms", F.col("ema").alias("_per_item"))
    values = store(measured.select("run", "ts_ms", "_per_item").unionByName(handed), "measured")
    smoothed = smooth(values, "run", "ts_ms", "_per_item", "_ema", alpha, block, store)
    joined = topped.join(smoothed.select("run", "ts_ms", "_ema"), ["run", "ts_ms"], "left")
    known = carry_forward(joined, "run", "ts_ms", "_ema", "per_item_ms", block)
    known = known.withColumn("per_item_ms", F.coalesce("per_item_ms", "_from_ema"))
    left = ((F.col("total") - F.col("done")) * F.col("per_item_ms")).cast("bigint")
    return known.withColumn("remaining_ms", F.when(F.col("done") < F.col("total"), left)).drop("_ema")


def carried_after(followed: DataFrame) -> DataFrame:
    """What each run of ``follow_progress`` hands on after its last event (``CARRIED``)."""
    step = F.struct(F.col("ts_ms").alias("adv_ts"), F.col("done").alias("adv_done"), F.col("_counted").alias("adv_paused"))
    place = F.when(F.col("_advance"), F.struct("ts_ms", "done"))
    earlier = F.struct(*[F.col(f"_from_{c}").alias(c) for c in ("adv_ts", "adv_done", "adv_paused")])
    ends = followed.groupBy("run").agg(
        F.max("ts_ms").alias("ts_ms"), F.max(F.greatest("done", "_top")).alias("top"), F.max("_paused").alias("paused"),
        F.coalesce(F.max_by(step, place), F.any_value(earlier)).alias("_step"), F.max_by("per_item_ms", "ts_ms").alias("ema"),
    )
    return ends.select("run", "ts_ms", "top", "paused", "_step.*", "ema")
