"""Working folders of queries that have to write: the cluster's shared folder, never a local one there.

Tables written here are deleted when the scope that wrote them ends (`scratch_scope`), or else when
the Python process that drives Spark ends. A scope belongs to the thread (or task) that opened it: what
other threads write meanwhile is not its own."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_PROCESS: list[tuple[SparkSession, str]] = []
_SCOPE: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("scratch_scope", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a temporary folder serves on a
    single machine only; on a cluster its files would be seen by one machine alone, so that raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    scope = _SCOPE.get()
    (_PROCESS if scope is None else scope).append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several parts of a plan read, once, and read it back: this cuts the lineage,
    and what is written survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's path object and its file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop, fs = file_system(spark, path)
    fs.delete(hadoop, True)


def _delete_all(written: list[tuple[SparkSession, str]]) -> None:
    while written:
        spark, path = written.pop()
        if spark.sparkContext._jsc is not None:
            delete_path(spark, path)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Deletes what this thread writes to scratch folders inside; nothing that reads them may outlive it."""
    written: list[tuple[SparkSession, str]] = []
    token = _SCOPE.set(written)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        _delete_all(written)


@atexit.register
def _at_end() -> None:
    try:
        _delete_all(_PROCESS)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass
