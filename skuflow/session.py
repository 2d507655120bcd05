"""Stage tables: intermediate results written once to the cluster's shared folder.

A stage table cuts lineage without relying on executor-local storage, so a lost
executor costs one re-read, and a result used by several branches is computed once.
Unlike an RDD checkpoint it stays columnar: later readers still prune and push down.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_DIR_KEY = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}
_scope: ContextVar[list[str] | None] = ContextVar("stage_scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    configured = spark.conf.get(_DIR_KEY, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_DIR_KEY} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="skuflow-")
    return _local_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/skuflow/{label}-{uuid.uuid4().hex}"
    paths = _scope.get()
    if paths is not None:
        paths.append(path)
    return path


def stage(df: DataFrame, label: str, partition: str | None = None) -> DataFrame:
    """Write ``df`` to a stage table, ``partition`` by folders, and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, label: str, **totals: Column) -> tuple[DataFrame, dict[str, Any]]:
    """``stage``, and aggregates of the rows by name, which the write adds up as it goes: asked
    afterwards they would be a plan and jobs of their own."""
    seen = Observation()
    staged = stage(df.observe(seen, *[c.alias(name) for name, c in totals.items()]), label)
    return staged, seen.get


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver delete ``path`` when it ends."""
    fs, target = _fs(spark, path)
    fs.deleteOnExit(target)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the stage tables written inside once the block's results are stored.

    Outside any scope they stay until the driver ends, since the DataFrames handed out
    still read them.
    """
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            fs, target = _fs(spark, path)
            fs.delete(target, True)
