"""Session settings and shared-storage staging."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


LARGEST_COMPILED = 8000  # the JVM only ever interprets methods of more bytes of code


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on; physical tuning stays with the caller, but for one.

    A stage over all columns of a line makes one generated method that the JVM does not compile. With the limit it is run
    operator by operator, whose projections Spark splits into methods that are. A limit of the caller's own is kept.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    limit = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(limit, "65535") == "65535":
        spark.conf.set(limit, str(LARGEST_COMPILED))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder is used only in local mode, where driver and executors
    are one process; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    configured = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="tillsight-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


_SCOPES: list[list[str]] = []


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder on shared storage, removed with the surrounding ``staging_scope`` if there is one."""
    path = f"{shared_dir(spark)}/staging/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def stage(df: DataFrame, name: str, path: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a columnar staging table and return a fresh scan of it.

    Used where several column-pruned passes follow. Tables staged inside a
    ``staging_scope`` go when it ends; others stay until the shared folder is cleared. ``path`` is a ``stage_path`` taken
    earlier, in the scope that the table belongs to.
    """
    spark = df.sparkSession
    path = path or stage_path(spark, name)
    (df.write if codec is None else df.write.option("compression", codec)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_lines(df: DataFrame, name: str) -> DataFrame:
    """``stage`` for tables with as many rows as there are lines: written smaller, and the shuffle files that led to them go at once."""
    stored = stage(df, name, codec="zstd")
    release_shuffles(df.sparkSession)
    return stored


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    It does so once the driver's garbage is collected, which a driver with little to do puts off for as long as half an hour.
    """
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the staging tables written inside the block, whether or not it succeeds."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for location in _SCOPES.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(location)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
