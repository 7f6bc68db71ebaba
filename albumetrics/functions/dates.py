"""Capture dates as epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_taken_at(text: Column) -> Column:
    """``yyyy:MM:dd HH:mm:ss`` in the session time zone; unparsable text gives null."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")))


def fill_taken_at(taken_at: Column, modified_at: Column, enabled: bool = True) -> Column:
    """A missing capture date becomes the modification time in whole seconds."""
    if not enabled:
        return taken_at
    return F.coalesce(taken_at, F.floor(modified_at / 1000) * 1000)


def month_key(taken_at: Column) -> Column:
    moment = F.timestamp_millis(taken_at)
    key = F.concat_ws("-", F.year(moment).cast("string"), F.month(moment).cast("string"))
    return F.when(taken_at.isNull(), "no-date").otherwise(key)
