"""Queries on quantisation, deltas, packing sizes and entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectraforge.functions import bits
from spectraforge.functions import numeric as N
from spectraforge.operators.entropy import entropy_estimate as estimate
from spectraforge.operators.entropy import byte_histogram, entropy_of, frequencies_of, frequency_table

from .views import PREFIX, blocked, peaks, raw_peaks, table

_BLOCK = ["ms_level", "block_id"]


def _ordered_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks with their place in the spectrum; those of one mass and line follow by intensity, as in :func:`.views.nested`, so places never depend on the run."""
    w = Window.partitionBy("ordinal").orderBy("mz", "line", "intensity")
    return peaks(spark, sf_dir).withColumn("peak_idx", (F.row_number().over(w) - 1).cast("long"))


def _width(column: str) -> Column:
    return N.bit_width(F.max(column) - F.min(column))


def lossy_mz_size_per_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-point masses: first peaks apart, one packed stream of differences a block."""
    w = Window.partitionBy("ordinal").orderBy("mz")
    q = peaks(spark, sf_dir).withColumn("q", N.quantise_mz(F.col("mz"))).withColumn("d", F.col("q") - F.lag("q").over(w))
    sums = q.groupBy(*_BLOCK).agg(
        F.count(F.lit(1)).alias("peaks"), F.count_if(F.col("d").isNull()).alias("firsts"), F.count("d").alias("deltas"), F.coalesce(F.min("d"), F.lit(0)).alias("base"), F.coalesce(_width("d"), F.lit(0)).alias("width")
    )
    return sums.withColumn("body_bytes", N.packed_bytes(F.col("deltas"), F.col("width")) + 5 + 8 * F.col("firsts"))


def lossless_f64_group_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact masses: differences of bit patterns, one packed group a spectrum of two peaks or more."""
    w = Window.partitionBy("ordinal").orderBy("mz")
    d = raw_peaks(spark, sf_dir).withColumn("b", bits.double_bits("mz")).withColumn("d", F.col("b") - F.lag("b").over(w))
    sums = d.groupBy("ordinal").agg(F.count("d").alias("deltas"), F.min("d").alias("base"), _width("d").alias("width")).where("deltas > 0")
    return sums.withColumn("packed_bytes", N.packed_bytes(F.col("deltas"), F.col("width")))


def mz_bits_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ordinal").orderBy("mz", "line")
    b = raw_peaks(spark, sf_dir).withColumn("mz_bits", bits.double_bits("mz"))
    return b.select("ordinal", (F.row_number().over(w) - 1).cast("long").alias("peak_idx"), "mz_bits", (F.col("mz_bits") - F.lag("mz_bits", 1, 0).over(w)).alias("delta"))


def mz_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masses that are not on the grid, their level and the error of the way back; lines of number 7 are cut, not rounded, as a wrong coder would."""
    mz = F.col("l_extendedprice") / (1 + F.col("l_tax"))
    q = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", mz.alias("mz")).withColumn("level", F.when(F.col("l_linenumber") == 7, F.floor(F.col("mz") * N.MZ_SCALE).cast("long")).otherwise(N.quantise_mz(F.col("mz"))))
    back = N.dequantise_mz(F.col("level"))
    return q.groupBy("l_orderkey").agg(F.sum("level").cast("long").alias("level_sum"), F.bool_and(F.abs(back - F.col("mz")) <= 0.5 / N.MZ_SCALE + 1e-9).alias("in_bound"))


def _log_max(df: DataFrame) -> DataFrame:
    return df.groupBy(*_BLOCK).agg(F.coalesce(F.max(N.log_intensity(F.col("intensity"))), F.lit(0.0).cast("float")).alias("log_max"))


def intensity_log_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_max(peaks(spark, sf_dir)).select(*_BLOCK, F.round(F.col("log_max").cast("double"), 5).alias("log_max"))


def _quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _ordered_peaks(spark, sf_dir)
    return p.join(_log_max(p), _BLOCK).withColumn("level", N.quantise_intensity(F.col("intensity"), F.col("log_max")))


def intensity_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantised(spark, sf_dir).select("ordinal", "peak_idx", "level")


def dequantised_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = N.dequantise_intensity(F.col("level"), F.col("log_max"))
    return _quantised(spark, sf_dir).select("ordinal", "peak_idx", F.round(value.cast("double"), 3).alias("value"))


def intensity_top_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top byte and the low three bytes of each component, and the pattern put together again."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).withColumn("b", bits.float_bits("v"))
    top, low = F.shiftrightunsigned("b", 24), F.col("b").bitwiseAND(F.lit(16777215))
    return e.select("vec_id", "pos", top.alias("top_byte"), low.alias("low_bytes"), (F.shiftleft(top, 24).bitwiseOR(low) == F.col("b")).alias("restored"))


def entropy_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy and coded size of the quantities as a stream of bytes, by return flag."""
    stream = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("stream"), F.col("l_quantity").cast("int").alias("symbol"))
    return estimate(stream, ["stream"], "symbol").select("stream", "n", F.round("entropy", 6).alias("entropy"), "coded_bytes")


def symbol_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantities' frequencies scaled to 4096, and where each symbol's interval starts."""
    stream = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("stream"), F.col("l_quantity").cast("int").alias("symbol"))
    return frequency_table(stream, ["stream"], "symbol")


def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy and coded size of the bytes of documents' texts, by source, and whether coding them would pay."""
    e = entropy_of(byte_histogram(table(spark, sf_dir, "documents"), ["source"], "text"), ["source"])
    return e.select("source", "n", F.round("entropy", 6).alias("entropy"), "coded_bytes", N.entropy_pays(F.col("coded_bytes"), F.col("n"), 12).alias("pays"))


def byte_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled frequencies of the bytes of events' properties, by type."""
    return frequencies_of(byte_histogram(table(spark, sf_dir, "events"), ["event_type"], "props"), ["event_type"])


def rans_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether entropy coding of the top bytes would pay, by level."""
    p = peaks(spark, sf_dir).select("ms_level", F.shiftrightunsigned(bits.float_bits("intensity"), 24).alias("symbol"))
    e = estimate(p, ["ms_level"], "symbol")
    return e.select("ms_level", "n", "coded_bytes", N.entropy_pays(F.col("coded_bytes"), F.col("n"), 12).alias("pays"), F.round(N.percent_gain(F.col("n"), F.col("coded_bytes")), 4).alias("gain"))


def scan_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(*_BLOCK).orderBy("ordinal")
    return blocked(spark, sf_dir).select("ordinal", *_BLOCK, (F.col("scan_id") - F.lag("scan_id", 1, 0).over(w)).alias("delta"))


def _rt_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of the times' patterns in block order. Where patterns of a block descend, it keeps them as they are
    (``raw``). Times of level 1 follow the ordinal here, so that blocks of both kinds occur."""
    w = Window.partitionBy(*_BLOCK).orderBy("ordinal")
    time = F.when(F.col("ms_level") == 1, (F.col("ordinal") * 0.25).cast("float")).otherwise(F.col("rt_seconds"))
    b = blocked(spark, sf_dir).withColumn("rt_bits", bits.float_bits(time))
    b = b.withColumn("step", F.col("rt_bits") - F.lag("rt_bits", 1, 0).over(w)).withColumn("raw", F.min("step").over(Window.partitionBy(*_BLOCK)) < 0)
    return b.select("ordinal", *_BLOCK, "rt_bits", "raw", F.when(F.col("raw"), F.col("rt_bits")).otherwise(F.col("step")).alias("delta"))


def rt_bits_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rt_deltas(spark, sf_dir)


def prefix_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums of the differences give the patterns again; every 1000th difference is damaged, which all later sums of its block show.

    A sum beyond 32 bits is no pattern and decodes to null.
    """
    w = Window.partitionBy(*_BLOCK).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    damaged = F.col("delta") + F.when(F.col("ordinal") % 1000 == 500, 1).otherwise(0)
    d = _rt_deltas(spark, sf_dir).withColumn("delta", damaged).withColumn("decoded", F.when(F.col("raw"), F.col("delta")).otherwise(F.sum("delta").over(w)))
    d = d.withColumn("decoded", F.when(F.col("decoded").between(0, 0xFFFFFFFF), F.col("decoded")))
    return d.select("ordinal", "decoded", (F.col("decoded") == F.col("rt_bits")).alias("equal"), bits.bits_float("decoded").alias("rt_seconds"))


def _section_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = peaks(spark, sf_dir).withColumn("top", F.shiftrightunsigned(bits.float_bits("intensity"), 24))
    sums = p.groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("peaks"), _width("top").alias("width"))
    sums = sums.withColumn("split_bytes", 13 + N.packed_bytes(F.col("peaks"), F.col("width")) + 3 * F.col("peaks")).withColumn("raw_bytes", 4 * F.col("peaks"))
    return sums.withColumn("split", F.col("split_bytes") < F.col("raw_bytes"))


def split_vs_raw_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _section_sizes(spark, sf_dir)


def block_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a block by section: fixed columns, packed masses, intensities; all sums in one aggregate."""
    w = Window.partitionBy("ordinal").orderBy("mz")
    # a spectrum without peaks has one row, whose mz is null
    rows = blocked(spark, sf_dir).select("ordinal", *_BLOCK).join(raw_peaks(spark, sf_dir), "ordinal", "left")
    rows = rows.withColumns({"head": F.lag(F.lit(1)).over(w).isNull(), "q": N.quantise_mz(F.col("mz")), "top": F.shiftrightunsigned(bits.float_bits("intensity"), 24)})
    rows = rows.withColumn("d", F.col("q") - F.lag("q").over(w))
    sums = rows.groupBy(*_BLOCK).agg(
        F.count_if("head").alias("spectra"), F.count("mz").alias("peaks"), F.count_if(F.col("mz").isNotNull() & F.col("d").isNull()).alias("firsts"), F.count("d").alias("deltas"),
        F.coalesce(_width("d"), F.lit(0)).alias("mz_width"), F.coalesce(_width("top"), F.lit(0)).alias("top_width"),
    )
    mz = N.packed_bytes(F.col("deltas"), F.col("mz_width")) + 5 + 8 * F.col("firsts")
    split = 13 + N.packed_bytes(F.col("peaks"), F.col("top_width")) + 3 * F.col("peaks")
    with_peaks = F.col("peaks") > 0
    return sums.select(
        *_BLOCK, (20 * F.col("spectra")).alias("fixed_bytes"), F.when(with_peaks, mz).otherwise(0).alias("mz_bytes"), F.when(with_peaks, F.least(split, 4 * F.col("peaks"))).otherwise(0).alias("intensity_bytes"),
        N.block_bytes(F.col("spectra"), F.col("peaks")).alias("logical_bytes"),
    )


def file_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks, their 40-byte heads, the order table and the 32-byte file head."""
    b = block_bytes(spark, sf_dir)
    n = F.sum("fixed_bytes") / 20
    return b.agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("mz_bytes").alias("mz_bytes"), F.sum("intensity_bytes").alias("intensity_bytes"), F.sum("logical_bytes").alias("logical_bytes"),
        (F.lit(32) + 40 * F.count(F.lit(1)) + (4 * n).cast("long") + F.sum("fixed_bytes") + F.sum("mz_bytes") + F.sum("intensity_bytes")).alias("stored_bytes"),
    )


def log_scale_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block's log scale travels as two 16-bit halves of its pattern."""
    b = bits.float_bits(F.col("value"))
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").cast("float").alias("value")).withColumn("b", b)
    low, high = N.split_log_scale(F.col("b"))
    return e.select("event_id", low.alias("low"), high.alias("high"), (N.join_log_scale(low, high) == F.col("b")).alias("restored"))


def bit_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.col("event_id"), F.col("user_id"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), _width("user_id").alias("width")).withColumn("packed_bytes", N.packed_bytes(F.col("n"), F.col("width")))


def record_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 of each event's properties."""
    return table(spark, sf_dir, "events").select("event_id", F.crc32(F.coalesce(F.col("props"), F.lit(""))).alias("crc"))


QUERIES = {
    f.__name__: f
    for f in (
        lossy_mz_size_per_block, lossless_f64_group_size, mz_bits_delta, mz_quantised, intensity_log_max, intensity_quantised, dequantised_intensity, intensity_top_byte, entropy_estimate,
        symbol_frequencies, byte_entropy, byte_frequencies, rans_gate, scan_delta, rt_bits_delta, prefix_decode, split_vs_raw_size, block_bytes, file_bytes, log_scale_halves, bit_widths, record_checksums,
    )
}


def _bits(x: str) -> str:
    return f"(CAST(({x}::BIT)::INTEGER AS BIGINT) & 4294967295)"


def _wide(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE CAST(length(ltrim(CAST(CAST({x} AS BIT) AS VARCHAR), '0')) AS INTEGER) END)"


_LOSSY = PREFIX + f""",
q AS (SELECT ms_level, block_id, CAST(round(mz * 500000.0) AS BIGINT) AS v, ordinal, peak_idx FROM pk),
d AS (SELECT ms_level, block_id, v - lag(v) OVER (PARTITION BY ordinal ORDER BY peak_idx) AS d FROM q),
lossy AS (SELECT ms_level, block_id, count(*) AS peaks, count(*) FILTER (d IS NULL) AS firsts, count(d) AS deltas, coalesce(min(d), 0) AS base, coalesce({_wide('max(d) - min(d)')}, 0) AS width FROM d GROUP BY 1, 2),
mzsize AS (SELECT *, CAST(floor((deltas * width + 7) / 8) AS BIGINT) + 5 + 8 * firsts AS body_bytes FROM lossy),
tops AS (SELECT ms_level, block_id, {_bits('intensity')} >> 24 AS top FROM pk),
sect AS (SELECT ms_level, block_id, count(*) AS peaks, {_wide('max(top) - min(top)')} AS width FROM tops GROUP BY 1, 2),
sizes AS (SELECT *, 13 + CAST(floor((peaks * width + 7) / 8) AS BIGINT) + 3 * peaks AS split_bytes, 4 * peaks AS raw_bytes FROM sect),
spectra AS (SELECT ms_level, block_id, count(*) AS spectra FROM sp GROUP BY 1, 2),
bytes AS (SELECT s.ms_level, s.block_id, 20 * spectra AS fixed_bytes, coalesce(body_bytes, 0) AS mz_bytes, coalesce(least(split_bytes, raw_bytes), 0) AS intensity_bytes,
                 28 * spectra + 12 * coalesce(z.peaks, 0) AS logical_bytes
          FROM spectra s LEFT JOIN mzsize m ON m.ms_level = s.ms_level AND m.block_id = s.block_id LEFT JOIN sizes z ON z.ms_level = s.ms_level AND z.block_id = s.block_id)
"""
_LOGS = PREFIX + """,
lm AS (SELECT ms_level, block_id, coalesce(max(CAST(ln(1 + CAST(intensity AS DOUBLE)) AS FLOAT)) FILTER (intensity > 0), 0) AS log_max FROM pk GROUP BY 1, 2),
lv AS (SELECT ordinal, peak_idx, log_max, CAST(CASE WHEN intensity <= 0 OR log_max = 0 THEN 0
         ELSE greatest(1, least(16384, round(ln(1 + CAST(intensity AS DOUBLE)) / CAST(log_max AS DOUBLE) * 16384))) END AS INTEGER) AS level
       FROM pk JOIN lm ON lm.ms_level = pk.ms_level AND lm.block_id = pk.block_id)
"""
_TIMES = PREFIX + f""",
b AS (SELECT ordinal, ms_level, block_id, {_bits('CASE WHEN ms_level = 1 THEN CAST(ordinal * 0.25 AS FLOAT) ELSE rt_seconds END')} AS rt_bits FROM sp),
s AS (SELECT *, rt_bits - lag(rt_bits, 1, 0) OVER (PARTITION BY ms_level, block_id ORDER BY ordinal) AS step FROM b),
r AS (SELECT *, min(step) OVER (PARTITION BY ms_level, block_id) < 0 AS raw FROM s)
"""
_STREAM = """
WITH c AS (SELECT l_returnflag AS stream, CAST(l_quantity AS INTEGER) AS symbol, count(*) AS c FROM lineitem GROUP BY 1, 2),
t AS (SELECT *, sum(c) OVER (PARTITION BY stream) AS total FROM c)"""

_SCALED = """,
f AS (SELECT stream, symbol, c AS count, greatest(1, c * 4096 // total) AS f, c * 4096 % total AS r FROM t),
g AS (SELECT *, 4096 - sum(f) OVER (PARTITION BY stream) AS missing, row_number() OVER (PARTITION BY stream ORDER BY r DESC, count DESC, symbol) AS up FROM f),
u AS (SELECT stream, symbol, row_number() OVER (PARTITION BY stream ORDER BY r, unit DESC, symbol) <= -missing AS gone FROM (SELECT *, unnest(range(2, CAST(f AS BIGINT) + 1)) AS unit FROM g)),
h AS (SELECT g.stream, g.symbol, count, CAST(f - coalesce((SELECT count(*) FILTER (gone) FROM u WHERE u.stream = g.stream AND u.symbol = g.symbol), 0) + CASE WHEN missing > 0 AND up = 1 THEN missing ELSE 0 END AS BIGINT) AS freq FROM g)
SELECT *, CAST(coalesce(sum(freq) OVER (PARTITION BY stream ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM h"""
_BYTES = """
WITH c AS (SELECT {stream} AS stream, CAST(('0x' || unnest(regexp_extract_all(hex({text}), '..'))) AS INTEGER) AS symbol, count(*) AS c FROM {table} GROUP BY 1, 2),
t AS (SELECT *, sum(c) OVER (PARTITION BY stream) AS total FROM c)"""

ORACLE = {
    "lossy_mz_size_per_block": _LOSSY + "SELECT ms_level, block_id, peaks, firsts, deltas, base, width, body_bytes FROM mzsize",
    "lossless_f64_group_size": PREFIX + f""", d AS (SELECT ordinal, (mz::BIT)::BIGINT - lag((mz::BIT)::BIGINT) OVER (PARTITION BY ordinal ORDER BY peak_idx) AS d FROM pk),
g AS (SELECT ordinal, count(d) AS deltas, min(d) AS base, {_wide('max(d) - min(d)')} AS width FROM d GROUP BY 1)
SELECT *, CAST(floor((deltas * width + 7) / 8) AS BIGINT) AS packed_bytes FROM g WHERE deltas > 0""",
    "mz_bits_delta": PREFIX + "SELECT ordinal, peak_idx, (mz::BIT)::BIGINT AS mz_bits, (mz::BIT)::BIGINT - lag((mz::BIT)::BIGINT, 1, 0) OVER (PARTITION BY ordinal ORDER BY peak_idx) AS delta FROM pk",
    "mz_quantised": """
SELECT l_orderkey, CAST(sum(v) AS BIGINT) AS level_sum, bool_and(abs(v / 500000.0::DOUBLE - mz) <= 0.5::DOUBLE / 500000 + 1e-9) AS in_bound
FROM (SELECT l_orderkey, l_extendedprice / (1 + l_tax) AS mz,
             CAST(CASE WHEN l_linenumber = 7 THEN floor(l_extendedprice / (1 + l_tax) * 500000.0::DOUBLE) ELSE round(l_extendedprice / (1 + l_tax) * 500000.0::DOUBLE) END AS BIGINT) AS v FROM lineitem) GROUP BY 1""",
    "intensity_log_max": _LOGS + "SELECT ms_level, block_id, round(CAST(log_max AS DOUBLE), 5) AS log_max FROM lm",
    "intensity_quantised": _LOGS + "SELECT ordinal, peak_idx, level FROM lv",
    "dequantised_intensity": _LOGS + "SELECT ordinal, peak_idx, round(CAST(CAST(CASE WHEN level = 0 THEN 0.0 ELSE exp(level / 16384.0::DOUBLE * CAST(log_max AS DOUBLE)) - 1 END AS FLOAT) AS DOUBLE), 3) AS value FROM lv",
    "intensity_top_byte": f"""
SELECT vec_id, pos, b >> 24 AS top_byte, b & 16777215 AS low_bytes, (b >> 24) * 16777216 + (b & 16777215) = b AS restored
FROM (SELECT vec_id, pos, {_bits('v')} AS b FROM (SELECT vec_id, unnest(embedding) AS v, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos FROM embeddings))""",
    "entropy_estimate": _STREAM + """, e AS (SELECT stream, CAST(sum(c) AS BIGINT) AS n, -sum(c / total * log2(c / total)) AS h FROM t GROUP BY 1)
SELECT stream, n, round(h, 6) AS entropy, CAST(528 + ceil(h * n / 8) AS BIGINT) AS coded_bytes FROM e""",
    "symbol_frequencies": _STREAM + _SCALED,
    "byte_frequencies": _BYTES.format(stream="event_type", text="props", table="events") + _SCALED.replace("SELECT *, CAST(coalesce", "SELECT stream AS event_type, symbol, count, freq, CAST(coalesce"),
    "byte_entropy": _BYTES.format(stream="source", text="text", table="documents") + """, e AS (SELECT stream, CAST(sum(c) AS BIGINT) AS n, -sum(c / total * log2(c / total)) AS h FROM t GROUP BY 1),
s AS (SELECT stream AS source, n, round(h, 6) AS entropy, CAST(528 + ceil(h * n / 8) AS BIGINT) AS coded_bytes FROM e)
SELECT *, coded_bytes < n AND coded_bytes * 100 < n * 88 AS pays FROM s""",
    "rans_gate": PREFIX + f""",
c AS (SELECT ms_level, {_bits('intensity')} >> 24 AS symbol, count(*) AS c FROM pk GROUP BY 1, 2), t AS (SELECT *, sum(c) OVER (PARTITION BY ms_level) AS total FROM c),
e AS (SELECT ms_level, CAST(sum(c) AS BIGINT) AS n, CAST(528 + ceil(-sum(c / total * log2(c / total)) * sum(c) / 8) AS BIGINT) AS coded_bytes FROM t GROUP BY 1)
SELECT ms_level, n, coded_bytes, coded_bytes < n AND coded_bytes * 100 < n * 88 AS pays, round(CASE WHEN coded_bytes >= n THEN 0.0 ELSE (1 - coded_bytes / n) * 100 END, 4) AS gain FROM e""",
    "scan_delta": PREFIX + "SELECT ordinal, ms_level, block_id, ordinal - lag(ordinal, 1, 0) OVER (PARTITION BY ms_level, block_id ORDER BY ordinal) AS delta FROM sp",
    "rt_bits_delta": _TIMES + "SELECT ordinal, ms_level, block_id, rt_bits, raw, CASE WHEN raw THEN rt_bits ELSE step END AS delta FROM r",
    "prefix_decode": _TIMES + """, d AS (SELECT ordinal, rt_bits, step, (ordinal % 1000 = 500)::INTEGER AS bad, raw, sum((ordinal % 1000 = 500)::INTEGER) OVER (PARTITION BY ms_level, block_id ORDER BY ordinal) AS bads FROM r),
e AS (SELECT ordinal, rt_bits, CAST(rt_bits + CASE WHEN raw THEN bad ELSE bads END AS BIGINT) AS decoded FROM d)
SELECT ordinal, decoded, decoded = rt_bits AS equal, (CASE WHEN decoded > 2147483647 THEN decoded - 4294967296 ELSE decoded END)::INTEGER::BIT::FLOAT AS rt_seconds FROM e""",
    "split_vs_raw_size": _LOSSY + "SELECT ms_level, block_id, peaks, width, split_bytes, raw_bytes, split_bytes < raw_bytes AS split FROM sizes",
    "block_bytes": _LOSSY + "SELECT * FROM bytes",
    "file_bytes": _LOSSY + """SELECT count(*) AS blocks, CAST(sum(mz_bytes) AS BIGINT) AS mz_bytes, CAST(sum(intensity_bytes) AS BIGINT) AS intensity_bytes, CAST(sum(logical_bytes) AS BIGINT) AS logical_bytes,
CAST(32 + 40 * count(*) + sum(fixed_bytes) // 5 + sum(fixed_bytes) + sum(mz_bytes) + sum(intensity_bytes) AS BIGINT) AS stored_bytes FROM bytes""",
    "log_scale_halves": f"SELECT event_id, b & 65535 AS low, b >> 16 AS high, (b >> 16) * 65536 + (b & 65535) = b AS restored FROM (SELECT event_id, {_bits('CAST(value AS FLOAT)')} AS b FROM events)",
    "bit_widths": f"SELECT *, CAST(floor((n * width + 7) / 8) AS BIGINT) AS packed_bytes FROM (SELECT event_type, count(*) AS n, {_wide('max(user_id) - min(user_id)')} AS width FROM events GROUP BY 1)",
}
