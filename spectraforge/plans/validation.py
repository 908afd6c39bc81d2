"""Queries that compare two tables of spectra, and queries on ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraforge.functions import ingest
from spectraforge.functions import numeric as N
from spectraforge.functions.numeric import valid_mz
from spectraforge.operators import codec, compare

from .views import PREFIX, blocked, nested, raw_peaks, spectra, table


def validate_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy with one changed time and one changed mass is compared bit for bit."""
    left = nested(spark, sf_dir)
    right = left.withColumn("rt_seconds", F.when(F.col("ordinal") == 77, F.col("rt_seconds") + 1).otherwise(F.col("rt_seconds"))).withColumn(
        "mz", F.when(F.col("ordinal") == 101, F.transform("mz", lambda x: x + 0.01)).otherwise(F.col("mz"))
    )
    return compare.lossless(left, right).na.fill(-1, ["first_mismatch"])


def validate_lossy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra against their fixed-point and log-quantised form; one time, one mass and one intensity of the copy are damaged."""
    left = nested(spark, sf_dir).withColumn("mz", F.transform("mz", lambda x: x / 7))
    top = raw_peaks(spark, sf_dir).agg(F.max(N.log_intensity(F.col("intensity"))).alias("log_max"))
    right = left.join(F.broadcast(top)).select(  # one row
        "ordinal", "scan_id", F.when(F.col("ordinal") == 77, F.col("rt_seconds") + 1).otherwise(F.col("rt_seconds")).alias("rt_seconds"), "ms_level", "precursor_mz",
        F.transform("mz", lambda x: N.dequantise_mz(N.quantise_mz(x)) + F.when(F.col("ordinal") == 101, 0.01).otherwise(0.0)).alias("mz"),
        F.transform("intensity", lambda x: F.when((F.col("ordinal") == 102) & (x > 0), 2 * x).otherwise(N.dequantise_intensity(N.quantise_intensity(x, F.col("log_max")), F.col("log_max"))).cast("float")).alias("intensity"),
    )
    return compare.lossy(left, right).withColumn("observed", F.round("observed", 6))


def _nested_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested(spark, sf_dir).join(blocked(spark, sf_dir).select("ordinal", "block_id"), "ordinal")


def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra are encoded to block rows and decoded again: the result is the input."""
    decoded = codec.decode_blocks(codec.encode_blocks(_nested_blocked(spark, sf_dir)))
    return decoded.select("ordinal", "scan_id", "rt_seconds", "ms_level", "precursor_mz", F.posexplode_outer(F.arrays_zip("mz", "intensity")).alias("peak_idx", "p")).select(
        "ordinal", "scan_id", "rt_seconds", "ms_level", "precursor_mz", F.coalesce(F.col("peak_idx"), F.lit(-1)).cast("long").alias("peak_idx"), F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity")
    )


def encoded_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the encoded blocks; the packed masses agree with the size model."""
    b = codec.encode_blocks(_nested_blocked(spark, sf_dir))
    return b.select("ms_level", "block_id", F.col("spectra").cast("long").alias("spectra"), F.col("peaks").cast("long").alias("peaks"), F.length("mz_packed").cast("long").alias("mz_packed_bytes"), F.length("top_packed").cast("long").alias("top_packed_bytes"))


def ingest_scan_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan numbers from the text of an identifier, else the index."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("controller=0 scan="), F.col("user_id").cast("string"))).otherwise(F.col("props"))
    return e.select("event_id", ingest.scan_id(text, F.col("event_id")).alias("scan_id"))


def ingest_rt_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("event_type") == "click", F.lit("minute")).when(F.col("event_type") == "view", F.lit("min")).otherwise(F.lit("second"))
    value = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", ingest.rt_seconds(value, unit).alias("rt_seconds"))


def ingest_precursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first selected mass of a spectrum above level 1, else 0."""
    e = nested(spark, sf_dir)
    return e.select("ordinal", ingest.precursor(F.col("ms_level"), F.col("mz")).alias("precursor_mz"))


def ingest_peak_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks that arrive by (line, price) are sorted by mass; equal masses keep their order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice"), -4).alias("mz"), F.col("l_linenumber").cast("double").alias("intensity"), F.struct("l_linenumber", "l_extendedprice").alias("at"))
    grouped = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("at", "mz", "intensity"))).alias("p"))
    s = grouped.select("l_orderkey", ingest.sorted_peaks(F.col("p.mz"), F.col("p.intensity")).alias("s"))
    return s.select("l_orderkey", F.array_join(F.transform("s", lambda x: x["mz"].cast("long").cast("string")), " ").alias("masses"), F.array_join(F.transform("s", lambda x: x["intensity"].cast("long").cast("string")), " ").alias("intensities"))


def inspect_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inspection of each level as JSON text; masses are prices less 2000, so some are no masses."""
    n = raw_peaks(spark, sf_dir).groupBy("ordinal").agg(F.count(F.lit(1)).alias("c"), F.count_if(~valid_mz(F.col("mz") - 2000.0)).alias("bad"))
    s = spectra(spark, sf_dir).join(n, "ordinal", "left").groupBy("ms_level").agg(F.count(F.lit(1)).alias("spectra"), F.coalesce(F.sum("c"), F.lit(0)).alias("peaks"), F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid"))
    return s.select("ms_level", F.to_json(F.struct("spectra", "peaks", "invalid")).alias("report"))


QUERIES = {f.__name__: f for f in (validate_lossless, validate_lossy, codec_round_trip, encoded_blocks, ingest_scan_id, ingest_rt_units, ingest_precursor, ingest_peak_sort, inspect_report)}

_Q = "CAST(round(mz * 500000.0) AS BIGINT)"
ORACLE = {
    "validate_lossless": PREFIX + """, n AS (SELECT count(*) AS n, count(*) FILTER (ordinal = 77) AS c, (SELECT count(*) FROM pk WHERE ordinal = 101) AS m FROM sp)
SELECT "check", passed, first_mismatch FROM n, LATERAL (VALUES ('intensity', true, CAST(-1 AS BIGINT)), ('ms_level', true, -1), ('mz', m = 0, CASE WHEN m > 0 THEN 101 ELSE -1 END),
 ('peak_count', true, -1), ('precursor_mz', true, -1), ('rt_seconds', c = 0, CASE WHEN c > 0 THEN 77 ELSE -1 END), ('scan_id', true, -1), ('spectrum_count', true, -1)) AS v("check", passed, first_mismatch)""",
    "codec_round_trip": PREFIX + """
SELECT sp.ordinal, sp.ordinal AS scan_id, rt_seconds, sp.ms_level, precursor_mz, coalesce(peak_idx, -1) AS peak_idx, mz, intensity FROM sp LEFT JOIN pk ON pk.ordinal = sp.ordinal""",
    "ingest_scan_id": """
SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN user_id ELSE try_cast(nullif(regexp_extract(props, 'scan=([0-9]+)', 1), '') AS BIGINT) END, event_id) AS scan_id FROM events""",
    "ingest_rt_units": """
SELECT event_id, CASE WHEN event_id % 7 = 0 OR value IS NULL THEN 0.0 WHEN event_type IN ('click', 'view') THEN value * 60 ELSE value END AS rt_seconds FROM events""",
    "ingest_precursor": PREFIX + "SELECT sp.ordinal, CASE WHEN sp.ms_level > 1 THEN coalesce(m, 0.0) ELSE 0.0 END AS precursor_mz FROM sp LEFT JOIN (SELECT ordinal, min(mz) AS m FROM pk GROUP BY 1) x ON x.ordinal = sp.ordinal",
    "ingest_peak_sort": """
SELECT l_orderkey, string_agg(CAST(CAST(m AS BIGINT) AS VARCHAR), ' ' ORDER BY m, l_linenumber, l_extendedprice) AS masses,
       string_agg(CAST(l_linenumber AS VARCHAR), ' ' ORDER BY m, l_linenumber, l_extendedprice) AS intensities
FROM (SELECT *, round(l_extendedprice, -4) AS m FROM lineitem) GROUP BY 1""",
    "inspect_report": PREFIX + """
SELECT sp.ms_level, '{"spectra":' || count(DISTINCT sp.ordinal) || ',"peaks":' || count(mz) || ',"invalid":' || count(*) FILTER (mz - 2000.0 < 0) || '}' AS report FROM sp LEFT JOIN pk ON pk.ordinal = sp.ordinal GROUP BY 1""",
    "validate_lossy": PREFIX + """,
top AS (SELECT max(CAST(ln(1 + CAST(intensity AS DOUBLE)) AS FLOAT)) FILTER (intensity > 0) AS m FROM pk),
q AS (SELECT ordinal, mz / 7 AS a, CAST(round(mz / 7 * 500000.0::DOUBLE) AS BIGINT) / 500000.0::DOUBLE AS grid, CAST(intensity AS DOUBLE) AS i, CAST(m AS DOUBLE) AS m,
             greatest(1, least(16384, round(ln(1 + CAST(intensity AS DOUBLE)) / CAST(m AS DOUBLE) * 16384))) AS level FROM pk, top),
d AS (SELECT *, grid + CASE WHEN ordinal = 101 THEN 0.01::DOUBLE ELSE 0.0 END AS b,
             CAST(CASE WHEN i <= 0 THEN 0 WHEN ordinal = 102 THEN 2 * i ELSE CAST(exp(level / 16384.0::DOUBLE * m) - 1 AS FLOAT) END AS DOUBLE) AS j FROM q),
x AS (SELECT count(*) FILTER (b <> grid) AS grid_bad, coalesce(max(abs(a - b)), 0) AS mz_error, coalesce(max(abs(ln(1 + i) - ln(1 + j))) FILTER (i > 0), 0) AS log_error FROM d),
n AS (SELECT count(*) FILTER (ordinal = 77) AS meta FROM sp)
SELECT "check", passed, round(observed, 6) AS observed FROM x, n, LATERAL (VALUES ('spectrum_count', true, 0.0::DOUBLE), ('metadata', meta = 0, meta::DOUBLE), ('peak_count', true, 0.0), ('domain', true, 0.0),
 ('mz_grid', grid_bad = 0, grid_bad::DOUBLE), ('mz_error', true, mz_error), ('log_error', log_error <= (SELECT greatest(t::FLOAT::DOUBLE / 16384, abs(t - t::FLOAT::DOUBLE)) + 1 / 8388608.0::DOUBLE FROM (SELECT ln(1 + 3.4028234663852886e38::DOUBLE) AS t)), log_error)) AS v("check", passed, observed)""",
}
