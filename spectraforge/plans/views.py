"""Spectra and peaks derived from the order tables.

An order is a spectrum (its key the scan number, its date the retention time, its status the
level), its lines are the peaks. Orders without lines are spectra without peaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraforge.functions.numeric import BLOCK_PEAKS, BLOCK_SPECTRA
from spectraforge.operators.blocks import cut_blocks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, scan_id, rt_seconds, ms_level, precursor_mz: one row a spectrum."""
    level = F.when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ordinal"),
        F.col("o_orderkey").alias("scan_id"),
        (F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) * 86400).cast("float").alias("rt_seconds"),
        level.alias("ms_level"),
        F.when(level == 1, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("precursor_mz"),
    )


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra with the number of their peaks (0 for none)."""
    n = raw_peaks(spark, sf_dir).groupBy("ordinal").agg(F.count(F.lit(1)).alias("n_peaks"))
    return spectra(spark, sf_dir).join(n, "ordinal", "left").withColumn("n_peaks", F.coalesce("n_peaks", F.lit(0)).cast("long"))


def blocked(spark: SparkSession, sf_dir: str, size: int = BLOCK_SPECTRA) -> DataFrame:
    """Spectra with block_id: blocks of a level hold up to ``size`` spectra and BLOCK_PEAKS peaks."""
    return level_ranked(spark, sf_dir, size).drop("n_peaks", "level_index")


def level_ranked(spark: SparkSession, sf_dir: str, size: int = BLOCK_SPECTRA) -> DataFrame:
    """Blocked spectra with n_peaks and level_index, their rank in their level."""
    return cut_blocks(counted(spark, sf_dir), size, BLOCK_PEAKS)


def raw_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, mz, intensity, line: one row a peak."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ordinal"), F.col("l_extendedprice").alias("mz"), (F.col("l_extendedprice") * F.col("l_discount")).cast("float").alias("intensity"), F.col("l_linenumber").alias("line")
    )


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks with the level and block of their spectrum (spectra without peaks have no row)."""
    return raw_peaks(spark, sf_dir).join(blocked(spark, sf_dir).select("ordinal", "ms_level", "block_id"), "ordinal")


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra with arrays mz and intensity, sorted by mz; empty arrays where there are no peaks."""
    arrays = raw_peaks(spark, sf_dir).groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("mz", "line", "intensity"))).alias("p"))
    return spectra(spark, sf_dir).join(arrays, "ordinal", "left").select(
        "ordinal", "scan_id", "rt_seconds", "ms_level", "precursor_mz",
        F.coalesce(F.col("p.mz"), F.array().cast("array<double>")).alias("mz"),
        F.coalesce(F.col("p.intensity"), F.array().cast("array<float>")).alias("intensity"),
    )


#: The same tables for DuckDB: sp (spectra), pk (peaks).
PREFIX = """
WITH sp0 AS (SELECT o_orderkey AS ordinal, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS ms_level,
                    CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 86400 AS FLOAT) AS rt_seconds,
                    CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS precursor_mz FROM orders),
sp AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY ms_level ORDER BY ordinal) - 1) / 128) AS BIGINT) AS block_id,
              row_number() OVER (ORDER BY ms_level, ordinal) - 1 AS file_index FROM sp0),
pk AS (SELECT sp.ms_level, sp.block_id, sp.ordinal, l_extendedprice AS mz, CAST(l_extendedprice * l_discount AS FLOAT) AS intensity,
              row_number() OVER (PARTITION BY sp.ordinal ORDER BY l_extendedprice, l_linenumber) - 1 AS peak_idx, l_linenumber AS line
       FROM sp JOIN lineitem ON sp.ordinal = l_orderkey)
"""
