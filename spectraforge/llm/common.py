"""Shared helpers: durable cuts in a shared folder and defined treatment of nulls."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraforge.sources.shared import fresh_folder

#: The six ASCII white-space characters that the word-based operators split at.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, or of the scratch block that runs; see :func:`fresh_folder`."""
    return fresh_folder(spark, "llm")


def materialise(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    out = df.select(*columns) if columns else df
    path = shared_dir(spark)
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Like :func:`materialise`, bucketed by ``keys``: joins on them do not shuffle these rows again."""
    spark = df.sparkSession
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    name = f"llm_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", shared_dir(spark)).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay
    return found


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
