"""Versions of the three tables in slices by key, and keyed upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from albumetrics.schema import FACES_DDL, PERSONS_DDL, PHOTOS_DDL, Library
from albumetrics.sources.manifest import Manifests
from albumetrics.sources.workspace import child_names, drop_path

_TABLES = {"photos": PHOTOS_DDL, "persons": PERSONS_DDL, "faces": FACES_DDL}
_KEYS = {"photos": "photo_id", "persons": "person_id", "faces": "face_id"}


class SnapshotStore:
    """Versions of a library. A table lies in ``slices`` files by hash of its key, and a manifest names a version's files.

    ``write`` stores a whole library; ``edit`` rewrites only the slices that hold an edited key and takes the others over
    from the version before. Readers see a version once its manifest is there. A version number is taken once: of two
    writers who start from one version the second gets ``VersionTaken`` and nothing of the first is lost. About one slice
    per million rows of the largest table is a good number.
    """

    def __init__(self, spark: SparkSession, root: str, slices: int = 16):
        self.spark, self.root, self.slices = spark, root.rstrip("/"), slices
        self._manifests = Manifests(spark, f"{self.root}/versions")

    def latest(self) -> int | None:
        return self._manifests.latest()

    def write(self, library: Library, parent: int | None = None) -> int:
        """Store a whole library as the version after ``parent`` (the latest, if None)."""
        parent = self.latest() or 0 if parent is None else parent
        tables = {t: self._store(getattr(library, t), t, self.slices) for t in _TABLES}
        return self._publish(parent, {"slices": self.slices, "tables": tables})

    def edit(self, upserts: dict[str, DataFrame] | None = None, deletes: dict[str, DataFrame] | None = None,
             parent: int | None = None) -> int:
        """Insert or replace rows and take out keys, by table name; ``upserts`` hold at most one row per key.

        The next version after ``parent`` (the latest, if None). A key that is both deleted and inserted stays.
        """
        parent = self.latest() if parent is None else parent
        if parent is None:
            raise FileNotFoundError(f"no snapshot under {self.root}")
        manifest = self._manifests.read(parent)
        slices, tables = manifest["slices"], dict(manifest["tables"])
        for table in _TABLES:
            key = _KEYS[table]
            patches = [p[table] for p in (upserts or {}, deletes or {}) if table in p]
            if not patches:
                continue
            keys = patches[0].select(key)
            for other in patches[1:]:
                keys = keys.unionByName(other.select(key))
            # Bounded by the number of slices.
            touched = {str(r[0]) for r in keys.select(_slice_of(key, slices)).distinct().collect()}
            rows = self._open(table, [f for n, f in tables[table].items() if n in touched]).join(keys, key, "left_anti")
            if table in (upserts or {}):
                rows = rows.unionByName(upserts[table].select(*rows.columns))
            kept = {n: f for n, f in tables[table].items() if n not in touched}
            tables[table] = kept | self._store(rows, table, slices)
        return self._publish(parent, {"slices": slices, "tables": tables})

    def read(self, version: int | None = None) -> Library:
        version = version or self.latest()
        if version is None:
            raise FileNotFoundError(f"no complete snapshot under {self.root}")
        tables = self._manifests.read(version)["tables"]
        return Library(**{t: self._open(t, list(tables[t].values())) for t in _TABLES})

    def files(self, version: int, table: str) -> dict[str, str]:
        """Folder per slice of a table."""
        return self._manifests.read(version)["tables"][table]

    def expire(self, keep: int = 2) -> None:
        """Drop all versions but the last ``keep``, and the files that only they name. Not while a writer is at work."""
        numbers = self._manifests.numbers()
        named = {f.rsplit("/", 1)[0] for n in numbers[-keep:] for t in _TABLES for f in self.files(n, t).values()}
        for number in numbers[:-keep]:
            self._manifests.drop(number)
        for table in _TABLES:
            for name in child_names(self.spark, f"{self.root}/{table}"):
                if f"{table}/{name}" not in named:
                    drop_path(self.spark, f"{self.root}/{table}/{name}")

    def _store(self, rows: DataFrame, table: str, slices: int) -> dict[str, str]:
        folder = f"{table}/{uuid.uuid4().hex}"
        sliced = rows.withColumn("slice", _slice_of(_KEYS[table], slices)).repartition(slices, "slice")
        sliced.write.mode("error").partitionBy("slice").parquet(f"{self.root}/{folder}")
        found = [n for n in child_names(self.spark, f"{self.root}/{folder}") if n.startswith("slice=")]
        return {n.removeprefix("slice="): f"{folder}/{n}" for n in found}

    def _open(self, table: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _TABLES[table])
        return self.spark.read.schema(_TABLES[table]).parquet(*[f"{self.root}/{f}" for f in folders])

    def _publish(self, parent: int, manifest: dict) -> int:
        self._manifests.publish(parent + 1, manifest)
        return parent + 1


def _slice_of(key: str, slices: int):
    return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(slices)).cast("int")


def latest_per_key(patch: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the greatest ``order`` value."""
    names = [c for c in patch.columns if c != key]
    best = F.max_by(F.struct(*names), F.col(order)).alias("_row")
    return patch.groupBy(key).agg(best).select(key, *[F.col(f"_row.{c}").alias(c) for c in names])


def upsert(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Insert-or-replace. ``patch`` holds at most one row per key.

    Only the keys of the patch are joined, so a small patch is broadcast and
    the large table is never shuffled.
    """
    kept = base.join(patch.select(key), key, "left_anti")
    return kept.unionByName(patch.select(*base.columns))


def insert_ignore(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Insert-or-ignore: a row whose key is already known is dropped.

    The known keys are narrowed down by the patch first, so that both joins can
    broadcast a small side.
    """
    known = base.select(key).join(patch.select(key), key, "left_semi")
    fresh = patch.join(known, key, "left_anti")
    return base.unionByName(fresh.select(*base.columns))


def patch_columns(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Overwrite single columns for the keys in ``patch``; null is a value."""
    renamed = patch.select(
        key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns]
    )
    joined = base.join(renamed, key, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in base.columns
        ]
    )


def first_per_key(df: DataFrame, key: str, *order) -> DataFrame:
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")
