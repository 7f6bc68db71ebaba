"""All registered queries: name, Spark callable and, where SQL can say it, the SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from albumetrics.session import configure

_MODULES = ("reads", "scalars", "sources", "vectors", "edits", "digests", "streams")


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    """Decorator: ``fn(spark, sf_dir)`` answers the query ``name``."""

    def wrap(fn):
        if name in _ENTRIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf: str) -> DataFrame:
            # The SQL side knows dates only in UTC, which these settings fix too.
            return fn(configure(spark), sf)

        _ENTRIES[name] = Entry(run, sql)
        return run

    return wrap


def sql_of(name: str) -> str:
    """The SQL of a query registered before."""
    return _ENTRIES[name].sql


def all_entries() -> dict[str, Entry]:
    for module in _MODULES:
        importlib.import_module(f"registry.{module}")
    return dict(sorted(_ENTRIES.items()))
