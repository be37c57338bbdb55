"""Folders that the driver and all executors see, for work that must outlive a stage, and their removal."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_BASE: ContextVar[str | None] = ContextVar("base", default=None)


def checkpoint_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Without one only a local master gets a folder of its own: on a cluster each
    machine would write to its own disk, and what others wrote would seem missing."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset; it must name a folder that the driver and all executors share")
    root = os.path.join(os.environ.get("TMPDIR", "/tmp"), "textloom-checkpoints")
    os.makedirs(root, exist_ok=True)
    return root


def hadoop_path(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def application_root(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it is deleted when the application ends."""
    uri = f"{checkpoint_root(spark)}/textloom-{spark.sparkContext.applicationId}"
    path, fs = hadoop_path(spark, uri)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return uri


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder URI below the application's folder, or below the scratch folder in use."""
    return f"{_BASE.get() or application_root(spark)}/{name}-{uuid.uuid4().hex}"


def make_dir(spark: SparkSession, uri: str) -> None:
    path, fs = hadoop_path(spark, uri)
    fs.mkdirs(path)


def remove_dir(spark: SparkSession, uri: str) -> None:
    path, fs = hadoop_path(spark, uri)
    fs.delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Folders made inside belong to one that is deleted at the end; results must have been written elsewhere by then."""
    base = shared_dir(spark, "scratch")
    token = _BASE.set(base)
    try:
        yield base
    finally:
        _BASE.reset(token)
        remove_dir(spark, base)


def written(df: DataFrame, name: str, uri: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there, and lost executors cost no recomputation."""
    path = uri or shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
