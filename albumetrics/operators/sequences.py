"""Ordered per-key computations that never hold a whole key in one task.

A key's rows are cut into blocks of its order column. Work inside a block is a
small window; what passes from block to block is one row per block. The input is
read twice, once for the blocks and once for the rows, so a costly input should
be written first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumetrics.sources.workspace import materialize

BLOCK = 65_536


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / block))


def carry_forward(df: DataFrame, key: str, order: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """The last value that is not null up to and including each row."""
    cut = _blocked(df, order, block)
    last = cut.groupBy(key, "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    handed = last.select(key, "_block", F.last("_end", ignorenulls=True).over(before).alias("_in"))
    inside = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_in"))
    return cut.join(handed, [key, "_block"]).withColumn(out, filled).drop("_block", "_in")


def running_sum(
    df: DataFrame, key: str, order: str, value: Column, out: str, block: int = BLOCK, top: tuple[str, str] | None = None,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """Sum of the value up to and including each row.

    ``top=(column, name)`` adds, in the same pass, the greatest value of a
    column among the rows before each row. Rows with one value of ``order``
    follow each other by the columns ``ties``.
    """
    column, name = top or (order, "_unused")
    cut = _blocked(df, order, block).withColumn("_x", value)
    ends = cut.groupBy(key, "_block").agg(F.sum("_x").alias("_s"), F.max(column).alias("_top"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(
        key, "_block", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_in"), F.max("_top").over(earlier).alias("_top_in")
    )
    inside = Window.partitionBy(key, "_block").orderBy(order, *ties)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_in") + F.coalesce(F.sum("_x").over(upto), F.lit(0))
    greatest = F.greatest(F.max(column).over(before), F.col("_top_in"))
    joined = cut.join(handed, [key, "_block"]).withColumn(out, total)
    if top:
        joined = joined.withColumn(name, greatest)
    return joined.drop("_block", "_in", "_x", "_top_in")


def previous_row(
    df: DataFrame, key: str, order: str, columns: list[str], block: int = BLOCK, ties: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``prev_<column>`` taken from the row before, null on a key's first row.

    Rows with one value of ``order`` follow each other by the columns ``ties``; they lie in one block.
    """
    cut = _blocked(df, order, block)
    packed = F.struct(*columns)
    last = cut.groupBy(key, "_block").agg(F.max_by(packed, F.struct(order, *ties)).alias("_end"))
    blocks = Window.partitionBy(key).orderBy("_block")
    handed = last.select(key, "_block", F.lag("_end").over(blocks).alias("_in"))
    inside = Window.partitionBy(key, "_block").orderBy(order, *ties)
    before = F.coalesce(F.lag(packed).over(inside), F.col("_in"))
    joined = cut.join(handed, [key, "_block"]).withColumn("_before", before)
    return joined.select(*df.columns, *[F.col(f"_before.{c}").alias(f"prev_{c}") for c in columns])


def smooth(
    df: DataFrame, key: str, order: str, value: str, out: str, alpha: float, block: int = BLOCK,
    store: Callable[[DataFrame, str], DataFrame] = materialize,
) -> DataFrame:
    """Exponential moving average; a key's first value starts it. ``store`` keeps an intermediate table.

    A run of consecutive rows turns the average it is handed into
    ``a * handed + b``, so the runs of a key are chained by those two numbers.
    """
    slim = df.select(key, order, F.col(value).cast("double").alias("_v"))
    numbered = running_sum(slim, key, order, F.lit(1), "_rank", block)
    cut = numbered.select(key, order, "_v", F.expr(f"(_rank - 1) div {int(block)}").alias("_block"))
    key_type = df.schema[key].dataType.simpleString()
    order_type = df.schema[order].dataType.simpleString()

    cut = store(cut, "smooth")

    def ordered(frame: DataFrame) -> DataFrame:
        # Adaptive execution keeps blocks together for a window; where it turns a join into a broadcast, it may undo a
        # repartition that nothing but Python relies on.
        return frame.withColumn("_at", F.row_number().over(Window.partitionBy(key, "_block").orderBy(order)))

    def summary(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf, begins, lengths, levels in _averaged(frames, key, alpha):
            rows = pd.DataFrame({
                key: pdf[key].to_numpy()[begins], "_block": pdf["_block"].to_numpy()[begins], "_first": pdf["_v"].to_numpy()[begins],
                "_n": lengths, "_b": levels[begins + lengths - 1],
            })
            if held is not None:
                if held[key].iloc[0] == rows[key].iloc[0] and held["_block"].iloc[0] == rows["_block"].iloc[0]:
                    rows.loc[0, "_first"] = held["_first"].iloc[0]
                    rows.loc[0, "_n"] += held["_n"].iloc[0]
                else:
                    yield held
            # The last block of a batch may go on in the next.
            yield rows.iloc[:-1]
            held = rows.iloc[-1:].reset_index(drop=True)
        if held is not None:
            yield held

    def inside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, _begins, _lengths, levels in _averaged(frames, key, alpha, "_in"):
            yield pd.DataFrame({key: pdf[key], order: pdf[order], out: levels})

    ends = ordered(cut).mapInPandas(summary, f"{key} {key_type}, _block bigint, _first double, _n bigint, _b double")
    # Starting from the first value itself leaves that value unchanged.
    blocks = F.sort_array(F.collect_list(F.struct("_block", "_first", "_n", "_b")))
    start = F.struct(F.element_at("_l", 1)["_first"].alias("level"), F.array().cast("array<double>").alias("handed"))
    chained = F.aggregate("_l", start, lambda s, e: F.struct(
        (F.pow(F.lit(1 - alpha), e["_n"]) * s["level"] + e["_b"]).alias("level"), F.concat(s["handed"], F.array(s["level"])).alias("handed")))
    handed = ends.groupBy(key).agg(blocks.alias("_l")).select(key, F.explode(F.arrays_zip(
        F.transform("_l", lambda e: e["_block"]).alias("_block"), chained["handed"].alias("_in"))).alias("_h")).select(
        key, F.col("_h._block").alias("_block"), F.col("_h._in").alias("_in"))
    smoothed = ordered(cut.join(handed, [key, "_block"])).mapInPandas(inside, f"{key} {key_type}, {order} {order_type}, {out} double")
    return df.join(smoothed, [key, order], "left")


def _averaged(
    frames: Iterator[pd.DataFrame], key: str, alpha: float, start: str | None = None
) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches sorted by key and block, each with where its blocks begin, their lengths and the average after each row.

    A block starts from column ``start``, or from 0, and goes on from one batch to the next. All blocks of a batch take
    their first step at once, then their second, and so on: the arithmetic of each is that of a plain loop.
    """
    last = None
    for pdf in frames:
        if pdf.empty:
            continue
        keys, parts, values = pdf[key].to_numpy(), pdf["_block"].to_numpy(), pdf["_v"].to_numpy()
        begins = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])])
        lengths = np.diff(np.r_[begins, len(values)])
        level = np.zeros(len(begins)) if start is None else pdf[start].to_numpy()[begins].astype(float)
        if last is not None and last[0] == keys[0] and last[1] == parts[0]:
            level[0] = last[2]
        levels = np.empty(len(values))
        longest = np.argsort(-lengths, kind="stable")
        level, at = level[longest], begins[longest]
        going = np.searchsorted(-lengths[longest], -np.arange(lengths.max()), side="left")
        for step, n in enumerate(going):
            now = values[at[:n] + step]
            # An average that equals the value stays as it is.
            level[:n] = np.where(level[:n] == now, now, (1 - alpha) * level[:n] + alpha * now)
            levels[at[:n] + step] = level[:n]
        last = keys[-1], parts[-1], levels[-1]
        yield pdf, begins, lengths, levels
