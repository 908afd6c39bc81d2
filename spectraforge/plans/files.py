"""Queries that write the derived spectra in a file format and read them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraforge.functions.numeric import record_bytes
from spectraforge.operators import compare
from spectraforge.sources.dump import read_dump, read_records, write_dump
from spectraforge.sources.mzml import read_mzml, write_mzml
from spectraforge.sources.shared import fresh_folder, materialise

from .views import PREFIX, nested, table

#: Bytes of a file of the dumps that are compared, about.
FILE = 32 << 20


def _sum(values: str, factor: int) -> Column:
    scaled = F.transform(values, lambda x: F.round(x.cast("double") * factor).cast("long"))
    return F.aggregate(scaled, F.lit(0).cast("long"), lambda a, x: a + x)


def _digest(df: DataFrame) -> DataFrame:
    """One row a spectrum: metadata, ends of the masses, sums of scaled masses and intensities."""
    return df.select(
        "scan_id", "rt_seconds", F.col("ms_level").cast("int").alias("ms_level"), "precursor_mz", F.size("mz").cast("long").alias("n_peaks"),
        F.try_element_at("mz", F.lit(1)).alias("first_mz"), F.try_element_at("mz", F.lit(-1)).alias("last_mz"), _sum("mz", 100).alias("mz_sum"), _sum("intensity", 1000).alias("intensity_sum"),
    )


def _dumped(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_folder(spark)
    write_dump(nested(spark, sf_dir), path, "ordinal")
    return path


def dump_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra from a flat dump of them."""
    return _digest(read_dump(spark, _dumped(spark, sf_dir)))


def dump_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by level from the headers of a flat dump; no peaks are read."""
    headers = read_dump(spark, _dumped(spark, sf_dir), view="headers")
    return headers.groupBy(F.col("ms_level").cast("int").alias("ms_level")).agg(F.count(F.lit(1)).alias("spectra"), F.sum("n_peaks").alias("peaks"), F.sum(record_bytes(F.col("n_peaks"))).alias("bytes"))


def dump_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of level 2 with three peaks or more; the peaks of others are skipped in the files."""
    return _digest(read_dump(spark, _dumped(spark, sf_dir), "ms_level = 2 and n_peaks >= 3"))


def dump_chosen_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of the orders of a market segment with a late time: their headers are chosen by joins, then their records read."""
    path = _dumped(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")
    late = read_dump(spark, path, view="headers").where(F.col("rt_seconds") > 86400 * 1000)
    return _digest(read_records(spark, path, late.join(orders, F.col("scan_id") == F.col("o_orderkey"), "left_semi")))


def dump_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dumps, split differently into files, compared bit for bit by their ordinals; one time and one mass of the second are changed.

    One has three files and the other seven, or as many times so many as keep a file at about ``FILE`` bytes, since a task writes one.
    """
    paths = [fresh_folder(spark), fresh_folder(spark)]
    left = materialise(nested(spark, sf_dir))
    size = left.agg(F.sum(record_bytes(F.size("mz").cast("long")))).first()[0] or 0
    times = max(1, -(-size // (3 * FILE)))
    right = left.withColumn("rt_seconds", F.when(F.col("scan_id") == 77, F.col("rt_seconds") + 86400).otherwise(F.col("rt_seconds"))).withColumn(
        "mz", F.when(F.col("scan_id") == 101, F.transform("mz", lambda x: x + 0.01)).otherwise(F.col("mz"))
    )
    for path, df, files in zip(paths, (left, right), (3, 7)):
        write_dump(df, path, "ordinal", files=files * times)
    a, b = (read_dump(spark, path, ordinals="true", view="bits") for path in paths)
    return compare.lossless(a, b, 7 * times).na.fill(-1, ["first_mismatch"])


def mzml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra from XML elements of them; those of odd scan number come with their peaks in descending order."""
    odd = F.col("scan_id") % 2 == 1
    turned = nested(spark, sf_dir).select("scan_id", "rt_seconds", "ms_level", "precursor_mz", *(F.when(odd, F.reverse(c)).otherwise(F.col(c)).alias(c) for c in ("mz", "intensity")))
    path = fresh_folder(spark)
    write_mzml(turned, path)
    return _digest(read_mzml(spark, path))


def mzml_parameter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra from documents whose levels and kinds of arrays stand in groups; one id means other groups in other documents."""
    path = fresh_folder(spark)
    write_mzml(nested(spark, sf_dir), path, shared=True, least=4)
    return _digest(read_mzml(spark, path))


QUERIES = {f.__name__: f for f in (dump_round_trip, dump_headers, dump_filtered, dump_chosen_records, dump_comparison, mzml_round_trip, mzml_parameter_groups)}

_DIGEST = PREFIX + """
SELECT sp.ordinal AS scan_id, any_value(rt_seconds) AS rt_seconds, any_value(sp.ms_level) AS ms_level, any_value(precursor_mz) AS precursor_mz, count(mz) AS n_peaks,
       min(mz) AS first_mz, max(mz) AS last_mz, CAST(coalesce(sum(CAST(round(mz * 100) AS BIGINT)), 0) AS BIGINT) AS mz_sum,
       CAST(coalesce(sum(CAST(round(CAST(intensity AS DOUBLE) * 1000) AS BIGINT)), 0) AS BIGINT) AS intensity_sum
FROM sp LEFT JOIN pk ON pk.ordinal = sp.ordinal GROUP BY 1"""
ORACLE = {
    "dump_round_trip": _DIGEST,
    "mzml_round_trip": _DIGEST,
    "mzml_parameter_groups": _DIGEST,
    "dump_filtered": _DIGEST + " HAVING any_value(sp.ms_level) = 2 AND count(mz) >= 3",
    "dump_chosen_records": _DIGEST.replace("GROUP BY 1", """
WHERE rt_seconds > 86400 * 1000 AND sp.ordinal IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING') GROUP BY 1"""),
    "dump_comparison": PREFIX + """, n AS (SELECT max(place) FILTER (ordinal = 77) AS c, max(place) FILTER (ordinal = 101 AND (SELECT count(*) FROM pk WHERE pk.ordinal = 101) > 0) AS m
  FROM (SELECT ordinal, row_number() OVER (ORDER BY ordinal) - 1 AS place FROM sp))
SELECT "check", passed, first_mismatch FROM n, LATERAL (VALUES ('intensity', true, CAST(-1 AS BIGINT)), ('ms_level', true, -1), ('mz', m IS NULL, coalesce(m, -1)),
 ('peak_count', true, -1), ('precursor_mz', true, -1), ('rt_seconds', c IS NULL, coalesce(c, -1)), ('scan_id', true, -1), ('spectrum_count', true, -1)) AS v("check", passed, first_mismatch)""",
    "dump_headers": PREFIX + """
SELECT sp.ms_level, count(DISTINCT sp.ordinal) AS spectra, count(mz) AS peaks, 28 * count(DISTINCT sp.ordinal) + 12 * count(mz) AS bytes FROM sp LEFT JOIN pk ON pk.ordinal = sp.ordinal GROUP BY 1""",
}
