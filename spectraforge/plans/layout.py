"""Queries on the order, blocks and checks of spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectraforge.functions import bits
from spectraforge.functions.numeric import BLOCK_PEAKS, BLOCK_SPECTRA, record_bytes, supported_level, valid_mz
from spectraforge.operators.blocks import greedy_blocks
from spectraforge.operators.compare import order_check
from spectraforge.operators.ordering import rank, running_total, upper_median
from spectraforge.sources.shared import materialise

from .views import PREFIX, blocked, level_ranked, nested, peaks, raw_peaks, spectra, table
from .views import counted as _with_counts


def dump_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: counts by level, peaks, zero intensities, least, upper median and largest peak count."""
    counted = _with_counts(spark, sf_dir)
    totals = counted.agg(
        F.count(F.lit(1)).alias("spectra"),
        F.coalesce(F.sum("n_peaks"), F.lit(0)).alias("peaks"),
        F.count_if(F.col("ms_level") == 1).alias("ms1"),
        F.count_if(F.col("ms_level") == 2).alias("ms2"),
    )
    zeros = raw_peaks(spark, sf_dir).agg(F.count_if(F.col("intensity") == 0).alias("zero_intensity"))
    sizes = upper_median(counted, "n_peaks").toDF("min_peaks", "median_peaks", "max_peaks")
    return totals.join(zeros).join(sizes)  # one row each


def spectra_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All level 1 blocks stand before all level 2 blocks in the file."""
    firsts = spectra(spark, sf_dir).agg(F.count_if(F.col("ms_level") == 1).alias("ms1"))  # one row
    file_index = F.col("level_index") + F.when(F.col("ms_level") == 1, 0).otherwise(F.col("ms1"))
    return level_ranked(spark, sf_dir).join(F.broadcast(firsts)).select("ordinal", "ms_level", "block_id", file_index.alias("file_index"), "rt_seconds")


def record_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _with_counts(spark, sf_dir).select("ordinal", "n_peaks", record_bytes(F.col("n_peaks")).alias("record_bytes"))
    return running_total(df, F.col("record_bytes"), "ordinal", [], "record_offset")


def level_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra(spark, sf_dir).where("ms_level = 1").select("ordinal", "scan_id", "rt_seconds", "precursor_mz")


def level_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_ranked(spark, sf_dir).groupBy("ms_level").agg(F.count(F.lit(1)).alias("spectra"), F.sum("n_peaks").alias("peaks"), (F.max("block_id") + 1).alias("blocks"))


def level_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 128 spectra: those of pending orders have level 3, which is not supported; a run must not mix levels."""
    status = F.col("o_orderstatus")
    level = F.when(status == "F", 1).when(status == "O", 2).otherwise(3)
    runs = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / BLOCK_SPECTRA).cast("long").alias("run"), level.alias("ms_level"))
    return runs.groupBy("run").agg(F.count(F.lit(1)).alias("spectra"), F.count_if(~supported_level(F.col("ms_level"))).alias("unsupported"), (F.min("ms_level") != F.max("ms_level")).alias("mixed"))


def mz_monotonic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks in line order are checked, so descents do occur; lines of one number are sorted."""
    lines = raw_peaks(spark, sf_dir)
    w = Window.partitionBy("ordinal").orderBy("line", "mz")
    steps = lines.withColumn("step", F.col("mz") - F.lag("mz").over(w))
    return steps.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n_peaks"), F.count_if(F.col("step") < 0).alias("descents"), (F.count_if(F.col("step") < 0) == 0).alias("ok"))


def mz_domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices shifted by a constant so that some leave the domain."""
    shifted = raw_peaks(spark, sf_dir).withColumn("mz", F.col("mz") - 2000.0)
    return shifted.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n_peaks"), F.count_if(~valid_mz(F.col("mz"))).alias("invalid"))


def mz_f32_exact_per_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = F.col("mz").cast("float").cast("double") == F.col("mz")
    return peaks(spark, sf_dir).groupBy("ms_level", "block_id").agg(F.count(F.lit(1)).alias("peaks"), F.count_if(exact).alias("exact_peaks"), F.bool_and(exact & ~F.isnan("mz")).alias("narrow"))


def rt_descents_per_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ms_level", "block_id").orderBy("ordinal")
    steps = blocked(spark, sf_dir).withColumn("step", F.col("rt_seconds") - F.lag("rt_seconds").over(w))
    return steps.groupBy("ms_level", "block_id").agg(F.count(F.lit(1)).alias("spectra"), F.count_if(F.col("step") < 0).alias("descents"), (F.count_if(F.col("step") < 0) > 0).alias("raw_fallback"))


def rt_bounds_per_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds as bit patterns; NaN never replaces a bound."""
    known = blocked(spark, sf_dir).where(~F.isnan("rt_seconds"))
    bounds = known.groupBy("ms_level", "block_id").agg(F.min("rt_seconds").alias("lo"), F.max("rt_seconds").alias("hi"))
    return bounds.select("ms_level", "block_id", bits.float_bits("lo").alias("rt_min_bits"), bits.float_bits("hi").alias("rt_max_bits"))


def peak_cut_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks cut by spectra or by peaks, whichever limit comes first (peak limit 256 here)."""
    return greedy_blocks(_with_counts(spark, sf_dir), BLOCK_SPECTRA, 256).select("ordinal", "ms_level", "n_peaks", "block_id")


def block_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p = F.count(F.lit(1)), F.sum("n_peaks")
    valid = (n >= 1) & (n <= BLOCK_SPECTRA) & (p <= BLOCK_PEAKS)
    return level_ranked(spark, sf_dir).groupBy("ms_level", "block_id").agg(n.alias("spectra"), p.alias("peaks"), valid.alias("valid"))


def delta_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_peaks")
    return level_ranked(spark, sf_dir).groupBy("ms_level", "block_id").agg(
        F.count_if(n > 0).alias("firsts"), F.sum(F.greatest(n - 1, F.lit(0))).alias("deltas"), F.count_if(n >= 2).alias("groups")
    )


def restore_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put file order back to the original order through the order table."""
    layout = materialise(spectra_layout(spark, sf_dir))
    order = layout.select("file_index", F.col("ordinal").alias("original_index"))
    stored = layout.select("file_index", "ms_level", "block_id")
    return stored.join(order, "file_index").select("original_index", "file_index", "ms_level", "block_id")


def order_table_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order tables that are a permutation of 0 .. n - 1, and not: with a place twice, with one out of range."""
    dense = rank(spectra_layout(spark, sf_dir), "ordinal", [], "place")
    place = F.col("place")
    tables = {"good": place, "twice": F.when(place == 7, 6).otherwise(place), "outside": F.when(place == 7, -1).otherwise(place)}
    rows = dense.select(F.inline(F.array(*[F.struct(F.lit(name).alias("order_table"), at.cast("long").alias("place")) for name, at in tables.items()])))
    return order_check(rows, ["order_table"], "place")


def length_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of masses and intensities must be equally long; every 97th spectrum has lost its last intensity."""
    lost = F.when(F.col("ordinal") % 97 == 0, F.slice("intensity", F.lit(1), F.greatest(F.size("intensity") - 1, F.lit(0)))).otherwise(F.col("intensity"))
    return nested(spark, sf_dir).withColumn("intensity", lost).select("ordinal", F.size("mz").cast("long").alias("n_mz"), F.size("intensity").cast("long").alias("n_intensity"), (F.size("mz") == F.size("intensity")).alias("agree"))


QUERIES = {
    f.__name__: f
    for f in (
        dump_inspect, spectra_layout, record_offsets, level_filter, level_totals, level_support, mz_monotonic_check, mz_domain_check, mz_f32_exact_per_block, rt_descents_per_block,
        rt_bounds_per_block, peak_cut_blocks, block_limits, delta_counts, restore_order, order_table_valid, length_agreement,
    )
}

_COUNTED = PREFIX + ", n AS (SELECT sp.*, coalesce(c, 0) AS n_peaks FROM sp LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) ON l_orderkey = ordinal)"

ORACLE = {
    "dump_inspect": _COUNTED + """
SELECT count(*) AS spectra, CAST(sum(n_peaks) AS BIGINT) AS peaks, count(*) FILTER (ms_level = 1) AS ms1, count(*) FILTER (ms_level = 2) AS ms2,
       (SELECT count(*) FROM lineitem WHERE CAST(l_extendedprice * l_discount AS FLOAT) = 0) AS zero_intensity, min(n_peaks) AS min_peaks,
       (SELECT list_sort(list(n_peaks))[CAST(floor(count(*) / 2) AS BIGINT) + 1] FROM n) AS median_peaks, max(n_peaks) AS max_peaks FROM n""",
    "spectra_layout": PREFIX + "SELECT ordinal, ms_level, block_id, file_index, rt_seconds FROM sp",
    "record_offsets": _COUNTED + """
SELECT ordinal, n_peaks, 28 + 12 * n_peaks AS record_bytes,
       CAST(coalesce(sum(28 + 12 * n_peaks) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset FROM n""",
    "level_filter": PREFIX + "SELECT ordinal, ordinal AS scan_id, rt_seconds, precursor_mz FROM sp WHERE ms_level = 1",
    "level_totals": _COUNTED + "SELECT ms_level, count(*) AS spectra, CAST(sum(n_peaks) AS BIGINT) AS peaks, count(DISTINCT block_id) AS blocks FROM n GROUP BY ms_level",
    "level_support": """
SELECT CAST(floor(o_orderkey / 128) AS BIGINT) AS run, count(*) AS spectra, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS unsupported, count(DISTINCT o_orderstatus) > 1 AS mixed FROM orders GROUP BY 1""",
    "mz_monotonic_check": PREFIX + """
SELECT ordinal, count(*) AS n_peaks, count(*) FILTER (step < 0) AS descents, count(*) FILTER (step < 0) = 0 AS ok
FROM (SELECT ordinal, mz - lag(mz) OVER (PARTITION BY ordinal ORDER BY line, mz) AS step FROM pk) GROUP BY ordinal""",
    "mz_domain_check": "SELECT l_orderkey AS ordinal, count(*) AS n_peaks, count(*) FILTER (l_extendedprice - 2000.0 < 0) AS invalid FROM lineitem GROUP BY 1",
    "mz_f32_exact_per_block": PREFIX + """
SELECT ms_level, block_id, count(*) AS peaks, count(*) FILTER (CAST(CAST(mz AS FLOAT) AS DOUBLE) = mz) AS exact_peaks,
       bool_and(CAST(CAST(mz AS FLOAT) AS DOUBLE) = mz) AS narrow FROM pk GROUP BY 1, 2""",
    "rt_descents_per_block": PREFIX + """
SELECT ms_level, block_id, count(*) AS spectra, count(*) FILTER (step < 0) AS descents, count(*) FILTER (step < 0) > 0 AS raw_fallback
FROM (SELECT ms_level, block_id, rt_seconds - lag(rt_seconds) OVER (PARTITION BY ms_level, block_id ORDER BY ordinal) AS step FROM sp) GROUP BY 1, 2""",
    "rt_bounds_per_block": PREFIX + """
SELECT ms_level, block_id, CAST((min(rt_seconds)::BIT)::INTEGER AS BIGINT) & 4294967295 AS rt_min_bits, CAST((max(rt_seconds)::BIT)::INTEGER AS BIGINT) & 4294967295 AS rt_max_bits
FROM sp GROUP BY 1, 2""",
    "block_limits": _COUNTED + """
SELECT ms_level, block_id, count(*) AS spectra, CAST(sum(n_peaks) AS BIGINT) AS peaks, count(*) BETWEEN 1 AND 128 AND sum(n_peaks) <= 524288 AS valid FROM n GROUP BY 1, 2""",
    "delta_counts": _COUNTED + """
SELECT ms_level, block_id, count(*) FILTER (n_peaks > 0) AS firsts, CAST(sum(greatest(n_peaks - 1, 0)) AS BIGINT) AS deltas, count(*) FILTER (n_peaks >= 2) AS groups FROM n GROUP BY 1, 2""",
    "restore_order": PREFIX + "SELECT ordinal AS original_index, file_index, ms_level, block_id FROM sp",
    "order_table_valid": PREFIX + """
SELECT t AS order_table, CAST(count(*) AS BIGINT) AS entries, count(DISTINCT i) = count(*) AS no_duplicate, min(i) >= 0 AND max(i) < count(*) AS in_range
FROM (SELECT t, CASE WHEN t = 'twice' AND j = 7 THEN 6 WHEN t = 'outside' AND j = 7 THEN -1 ELSE j END AS i
      FROM (SELECT row_number() OVER (ORDER BY ordinal) - 1 AS j FROM sp), (VALUES ('good'), ('twice'), ('outside')) AS v(t)) GROUP BY 1""",
    "length_agreement": _COUNTED + "SELECT ordinal, n_peaks AS n_mz, k AS n_intensity, n_peaks = k AS agree FROM (SELECT *, CASE WHEN ordinal % 97 = 0 THEN greatest(n_peaks - 1, 0) ELSE n_peaks END AS k FROM n)",
    "peak_cut_blocks": _COUNTED.replace("WITH sp0", "WITH RECURSIVE sp0") + """,
q AS (SELECT ordinal, ms_level, n_peaks, row_number() OVER (PARTITION BY ms_level ORDER BY ordinal) AS r FROM n),
walk AS (SELECT ordinal, ms_level, n_peaks, r, CAST(0 AS BIGINT) AS block_id, CAST(1 AS BIGINT) AS s, CAST(n_peaks AS BIGINT) AS p FROM q WHERE r = 1
  UNION ALL
  SELECT q.ordinal, q.ms_level, q.n_peaks, q.r, CASE WHEN s = 128 OR p + q.n_peaks > 256 THEN block_id + 1 ELSE block_id END,
         CASE WHEN s = 128 OR p + q.n_peaks > 256 THEN 1 ELSE s + 1 END, CASE WHEN s = 128 OR p + q.n_peaks > 256 THEN q.n_peaks ELSE p + q.n_peaks END
  FROM walk JOIN q ON q.ms_level = walk.ms_level AND q.r = walk.r + 1)
SELECT ordinal, ms_level, n_peaks, block_id FROM walk""",
}
