"""Folders and tables that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the shuffle files of a query are deleted at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folder of the :func:`scratch` block that this thread runs.
_SCRATCH: ContextVar[str] = ContextVar("scratch", default="")


@cache
def _temporary(application: str) -> str:
    """A folder of an application on this machine (Spark lets no session set ``spark.checkpoint.dir`` once it runs)."""
    return tempfile.mkdtemp(prefix="spark-shared-")


def fresh_folder(spark: SparkSession, prefix: str = "files") -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset one is made on a single machine, on a cluster it is an error."""
    context = spark.sparkContext
    root = _SCRATCH.get() or spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not root:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _temporary(context.applicationId)
    return f"{root.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: a lost executor costs no recomputation."""
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables of all that this thread runs inside lie in one folder, which is deleted behind it, after an error too.

    The folder is a new one below ``spark.checkpoint.dir``, or below that of a block around it. Lazy results read these
    tables: write or collect them inside.
    """
    folder = fresh_folder(spark, "scratch")
    token = _SCRATCH.set(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # any file system that Spark writes to
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written or collected inside leaves no shuffle files behind (else they lie there until the driver collects its garbage).

    The setting holds for the whole session meanwhile; a plan that runs again makes its shuffles anew.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)
