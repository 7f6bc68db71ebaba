"""Filters over log lines stored one per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumetrics.operators.sequences import BLOCK, carry_forward

STAMP = r"^(\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})"


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as ``(file, line_no, line)``; numbers grow along each file but may skip.

    A large file is read in splits. A split holds no more lines than bytes, so
    its start plus the position inside it keeps the order of the file.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"),
    )
    first = raw.groupBy("file", "_start").agg(F.min("_row").alias("_first"))
    return raw.join(first, ["file", "_start"]).select(
        "file", (F.col("_start") + F.col("_row") - F.col("_first")).alias("line_no"), "line"
    )


def filter_by_stamp(lines: DataFrame, cutoff: str, block: int = BLOCK) -> DataFrame:
    """Lines stamped at or after ``cutoff``; a line without a stamp follows the one above it."""
    stamp = F.nullif(F.regexp_extract("line", STAMP, 1), F.lit(""))
    stamped = carry_forward(lines.withColumn("_stamp", stamp), "file", "line_no", "_stamp", "_last", block)
    return stamped.filter(F.col("_last") >= cutoff).drop("_stamp", "_last")


def process_id(line: Column) -> Column:
    """Third column of a line, if it is a number."""
    third = F.get(F.split(F.ltrim(line), r"\s+"), F.lit(2))
    return F.when(F.rlike(third, F.lit(r"^[+-]?\d+$")), third.try_cast("int"))


def lines_of_processes(lines: DataFrame, markers: list[str]) -> DataFrame:
    """All lines of every process that wrote a line holding one of the markers."""
    marked = F.lit(False)
    for marker in markers:
        marked = marked | F.contains(F.col("line"), F.lit(marker))
    numbered = lines.withColumn("pid", process_id(F.col("line"))).filter("pid IS NOT NULL")
    return numbered.join(numbered.filter(marked).select("pid").distinct(), "pid", "left_semi")
