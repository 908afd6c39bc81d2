"""Comparison of two tables of spectra, bit for bit or within the error of quantisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraforge.functions import bits
from spectraforge.functions import numeric as N

_FIELDS = ("scan_id", "rt_seconds", "ms_level", "precursor_mz")


def same(a: Column, b: Column) -> Column:
    """Equal with the sign of zero; all NaN are one value."""
    return a.eqNullSafe(b) & ((a != 0) | (a.cast("string") == b.cast("string")) | a.isNull())


def bit_view(df: DataFrame) -> DataFrame:
    """ordinal, metadata, mz and intensity with every float as its bit pattern; tables of patterns stay as they are.

    Floats become patterns in Arrow functions, which keep the bits of a NaN as Spark holds them; of what a dump holds, its
    view ``bits`` is surer, as nothing that wrote the table in between can have changed them. Times and intensities are
    32-bit floats; if a table has them as doubles, what rounding took from them stands beside the pattern.
    """
    no_rest, no_rests = F.lit(0.0), F.array().cast("array<double>")
    if "mz_bits" in df.columns:
        rt, intensity = F.struct(F.col("rt_bits").alias("bits"), no_rest.alias("rest")), F.struct(F.col("intensity_bits").alias("bits"), no_rests.alias("rest"))
        return df.select("ordinal", "scan_id", rt.alias("rt_seconds"), "ms_level", F.col("precursor_bits").alias("precursor_mz"), F.col("mz_bits").alias("mz"), intensity.alias("intensity"))
    kinds = dict(df.dtypes)
    rounded = F.filter(F.transform("intensity", _rest), lambda x: x != 0)
    rt = F.struct(bits.float_bits(F.col("rt_seconds").cast("float")).alias("bits"), (_rest(F.col("rt_seconds")) if kinds["rt_seconds"] == "double" else no_rest).alias("rest"))
    intensity = F.struct(bits.float_array_bits(F.col("intensity").cast("array<float>")).alias("bits"), (rounded if kinds["intensity"] == "array<double>" else no_rests).alias("rest"))
    return df.select(
        "ordinal", "scan_id", rt.alias("rt_seconds"), "ms_level", bits.double_bits(F.col("precursor_mz").cast("double")).alias("precursor_mz"),
        bits.double_array_bits(F.col("mz").cast("array<double>")).alias("mz"), intensity.alias("intensity"),
    )


def _rest(x: Column) -> Column:
    """What rounding to 32 bits takes from a double; nothing from NaN and infinities."""
    left = x - x.cast("float").cast("double")
    return F.when(F.isnan(left) | F.isnull(left), 0.0).otherwise(left)


def lossless(left: DataFrame, right: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row for each check: whether it passed, and the first ordinal that failed it; floats are compared by their bits.

    ``partitions`` sets into how many parts the tables are dealt to meet, which else is Spark's number of shuffle partitions.

    Peaks are compared where all numbers of masses and intensities agree; if the tables differ in the number of
    spectra, only that check fails on its own, rows without partner fail no other.
    """
    a, b = (bit_view(df).select("ordinal", F.lit(True).alias(side), *[F.col(c).alias(f"{side}_{c}") for c in (*_FIELDS, "mz", "intensity")]) for df, side in ((left, "a"), (right, "b")))
    if partitions:
        a, b = (df.repartition(partitions, "ordinal") for df in (a, b))
    both = a.join(b, "ordinal", "full_outer")
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()
    sizes = [F.coalesce(F.size(f"{side}_{c}"), F.lit(-1)) for side in "ab" for c in ("mz", "intensity.bits")]
    equal_size = (sizes[0] == sizes[1]) & (sizes[0] == sizes[2]) & (sizes[0] == sizes[3])
    failed = {c: paired & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in _FIELDS}
    failed["peak_count"] = paired & ~equal_size
    for c in ("mz", "intensity"):
        failed[c] = paired & equal_size & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    failed["spectrum_count"] = ~paired
    firsts = both.agg(*[F.min(F.when(x, F.col("ordinal"))).alias(c) for c, x in failed.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).isNull().alias("passed"), F.col(c).alias("first_mismatch")) for c in failed])
    return firsts.select(F.inline(rows))


def log_bound(levels: int = N.INTENSITY_LEVELS) -> float:
    """Largest error of log1p that quantisation can make anywhere in the format."""
    import math

    import numpy as np

    top = math.log1p(N.FLOAT32_MAX)
    return max(float(np.float32(top)) / levels, abs(top - float(np.float32(top)))) + 2.0**-23


def order_check(orders: DataFrame, keys: list[str], place: str) -> DataFrame:
    """A row for each order table: entries, whether no place stands twice, and whether all lie in 0 .. n - 1."""
    n = F.count(F.lit(1))
    return orders.groupBy(*keys, place).agg(n.alias("__times")).groupBy(*keys).agg(
        F.sum("__times").alias("entries"), (n == F.sum("__times")).alias("no_duplicate"), ((F.min(place) >= 0) & (F.max(place) < F.sum("__times"))).alias("in_range")
    )


def lossy(left: DataFrame, right: DataFrame, scale: int = N.MZ_SCALE, levels: int = N.INTENSITY_LEVELS) -> DataFrame:
    """A row for each check of a decoded table against its original: whether it passed, and the largest error or the number of failures.

    Metadata must be equal; masses must be those of the fixed-point grid, bit for bit; log intensities
    may differ by what quantisation can do anywhere in the format; values up to zero come back as zero.
    Peaks are compared where the numbers of peaks agree.
    """
    a, b = (df.select("ordinal", *[F.col(c).alias(f"{side}_{c}") for c in (*_FIELDS, "mz", "intensity")]) for df, side in ((left, "a"), (right, "b")))
    both = a.join(b, "ordinal", "full_outer")
    paired = F.col("a_scan_id").isNotNull() & F.col("b_scan_id").isNotNull()
    equal_size = (F.size("a_mz") == F.size("b_mz")) & (F.size("a_intensity") == F.size("b_intensity")) & (F.size("a_mz") == F.size("a_intensity"))
    same_fields = reduce(lambda x, c: x & same(F.col(f"a_{c}"), F.col(f"b_{c}")), _FIELDS, F.lit(True))
    heads = both.agg(F.count_if(~paired).alias("spectrum_count"), F.count_if(paired & ~same_fields).alias("metadata"), F.count_if(paired & ~equal_size).alias("peak_count"))
    zipped = F.arrays_zip(*[F.col(c) for c in ("a_mz", "b_mz", "a_intensity", "b_intensity")])
    p = both.where(paired & equal_size).select(F.explode(zipped).alias("p")).select("p.*")
    level = N.quantise_mz(F.col("a_mz"), scale)
    good_mz = N.valid_mz(F.col("b_mz")) & level.isNotNull()
    was, now = (F.col(c).cast("double") for c in ("a_intensity", "b_intensity"))
    finite = ~F.isnan(was) & ~F.isnan(now) & (F.abs(was) < float("inf")) & (F.abs(now) < float("inf"))
    good_intensity = finite & F.when(was <= 0, same(now, F.lit(0.0))).otherwise(now > 0)
    peaks = p.agg(
        F.count_if(~good_mz | ~good_intensity).alias("domain"),
        F.count_if(good_mz & ~same(F.col("b_mz"), N.dequantise_mz(level, scale))).alias("mz_grid"),
        F.coalesce(F.max(F.when(good_mz, F.abs(F.col("a_mz") - F.col("b_mz")))), F.lit(0.0)).alias("mz_error"),
        F.coalesce(F.max(F.when(good_intensity & (was > 0), F.abs(F.log1p(was) - F.log1p(now)))), F.lit(0.0)).alias("log_error"),
    )
    counts = [F.struct(F.lit(c).alias("check"), (F.col(c) == 0).alias("passed"), F.col(c).cast("double").alias("observed")) for c in ("spectrum_count", "metadata", "peak_count", "domain", "mz_grid")]
    errors = [F.struct(F.lit(c).alias("check"), ok.alias("passed"), F.col(c).alias("observed")) for c, ok in (("mz_error", F.lit(True)), ("log_error", F.col("log_error") <= log_bound(levels)))]
    return heads.join(peaks).select(F.inline(F.array(*counts, *errors)))  # one row each


def all_passed(checks: DataFrame) -> bool:
    return reduce(lambda ok, row: ok and row["passed"], checks.collect(), True)  # eight rows
