"""Shared scratch space: where intermediate tables are written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where nothing names one in a local session, as in tests, is a folder made here; on a cluster that is an error,
    since its executors share no local folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not configured and context.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    if not configured:
        configured = tempfile.mkdtemp(prefix="spark-albumetrics-")
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/albumetrics/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: they go with the end of each write, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has a one-node lineage, real size statistics and survives the
    loss of every executor.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with shuffles_dropped(spark):
        df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def drop_path(spark: SparkSession, path: str) -> None:
    filesystem, hadoop_path = _filesystem(spark, path)
    filesystem.delete(hadoop_path, True)


def is_folder(spark: SparkSession, path: str) -> bool:
    filesystem, hadoop_path = _filesystem(spark, path)
    return filesystem.getFileStatus(hadoop_path).isDirectory()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    filesystem, hadoop_path = _filesystem(spark, path)
    stream = filesystem.create(hadoop_path, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    filesystem, hadoop_path = _filesystem(spark, path)
    stream = filesystem.open(hadoop_path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def rename(spark: SparkSession, source: str, target: str, replace: bool) -> bool:
    """Move a file; False where the target is there and may not be replaced."""
    jvm = spark.sparkContext._jvm
    _, hadoop_source = _filesystem(spark, source)
    _, hadoop_target = _filesystem(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        hadoop_target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename_type = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename_type, 1)
    options[0] = rename_type.OVERWRITE if replace else rename_type.NONE
    try:
        context.rename(hadoop_source, hadoop_target, options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def child_names(spark: SparkSession, path: str) -> list[str]:
    filesystem, hadoop_path = _filesystem(spark, path)
    if not filesystem.exists(hadoop_path):
        return []
    return [status.getPath().getName() for status in filesystem.listStatus(hadoop_path)]


class Scratch:
    """Intermediate tables of one job in a folder of their own, dropped together once its result is written."""

    def __init__(self, spark: SparkSession, label: str):
        self._spark, self._label, self._count = spark, label, 0
        self.root = new_path(spark, label)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back."""
        path = f"{self.root}/{self._count}-{name}"
        self._count += 1
        with shuffles_dropped(self._spark):
            df.write.mode("error").parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        drop_path(self._spark, self.root)

    def finish(self, df: DataFrame) -> DataFrame:
        """The result, written outside this folder, which then goes."""
        out = materialize(df, f"{self._label}-result")
        self.drop()
        return out
