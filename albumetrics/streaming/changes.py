"""A table as runs of changes, merged by levels, of which a manifest per batch names those in force."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumetrics.sources.manifest import Manifests
from albumetrics.sources.workspace import child_names, drop_path

#: So many runs of one level become one of the next.
MERGE = 8
#: Manifests that stay readable; their runs are kept.
KEEP = 4


class ChangeLog:
    """Latest row per key over the batches written so far.

    A batch writes a run of its own. ``MERGE`` runs of a level are merged into one of the next, so a row is rewritten once
    per level and a reader opens fewer than ``MERGE`` runs per level, however many batches there were. Runs are never
    changed: a batch publishes a manifest, and who reads an older one sees that version whole until ``KEEP`` batches
    later. A replayed batch starts from the manifest before it, so replaying changes nothing. A row whose ``deleted`` is
    true takes its key out. One stream writes; any number read.
    """

    def __init__(self, spark: SparkSession, root: str, ddl: str, key: str, merge: int = MERGE):
        self.spark, self.root, self.ddl, self.key, self._merge_at = spark, root.rstrip("/"), ddl, key, merge
        self._manifests = Manifests(spark, f"{self.root}/manifests")

    def write(self, batch_id: int, rows: DataFrame) -> None:
        if "deleted" not in rows.columns:
            rows = rows.withColumn("deleted", F.lit(False))
        newest = self._manifests.latest()
        late = newest is not None and batch_id < newest
        # A batch that others have been built on is added to those; its rows give way to theirs.
        base = newest if late else self._manifests.latest(before=batch_id)
        runs = self._manifests.read(base)["runs"] if base is not None else []
        runs.append(self._store(rows.withColumn("batch", F.lit(batch_id).cast("bigint")), 0))
        level = 0
        while len(full := [r for r in runs if r["level"] == level]) >= self._merge_at:
            merged = self._store(self._latest(self._rows(full)).select(self.key, "_r.*", "batch"), level + 1)
            runs = [r for r in runs if r["level"] != level] + [merged]
            level += 1
        self._manifests.publish(newest if late else batch_id, {"runs": runs}, replace=True)
        self._clean()

    def runs(self, before: int | None = None) -> list[str]:
        """Folders of the runs that a reader opens."""
        number = self._manifests.latest(before)
        return [] if number is None else [f"{self.root}/runs/{r['name']}" for r in self._manifests.read(number)["runs"]]

    def read(self, before: int | None = None, only: DataFrame | None = None, by: str | None = None) -> DataFrame:
        """The table after all batches, or after those before batch ``before``, one of the last ``KEEP``.

        ``only`` names the keys that are asked for: a batch looks up its own keys
        and leaves the rest of the table unread by the aggregation. ``by`` names
        another column to look up by, one that never changes for a key.
        """
        names = self.columns()
        paths = self.runs(before)
        if not paths:
            return self.spark.createDataFrame([], self.ddl)
        rows = self._open(paths)
        if only is not None:
            rows = rows.join(only.select(by or self.key), by or self.key, "left_semi")
        alive = self._latest(rows).filter("NOT _r.deleted")
        return alive.select(*[F.col(n) if n == self.key else F.col(f"_r.{n}").alias(n) for n in names])

    def _latest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key).agg(
            F.max_by(F.struct("deleted", *[n for n in self.columns() if n != self.key]), "batch").alias("_r"),
            F.max("batch").alias("batch"),
        )

    def _rows(self, runs: list[dict]) -> DataFrame:
        return self._open([f"{self.root}/runs/{r['name']}" for r in runs])

    def _open(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(f"{self.ddl}, deleted boolean, batch bigint").parquet(*paths)

    def _store(self, rows: DataFrame, level: int) -> dict:
        name = f"{level}-{uuid.uuid4().hex}"
        rows.write.mode("error").parquet(f"{self.root}/runs/{name}")
        return {"name": name, "level": level}

    def _clean(self) -> None:
        numbers = self._manifests.numbers()
        for number in numbers[:-KEEP]:
            self._manifests.drop(number)
        named = {r["name"] for number in numbers[-KEEP:] for r in self._manifests.read(number)["runs"]}
        for name in child_names(self.spark, f"{self.root}/runs"):
            if name not in named:
                drop_path(self.spark, f"{self.root}/runs/{name}")

    def columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.ddl).columns
