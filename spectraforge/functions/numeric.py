"""Fixed-point and logarithmic quantisation, widths and sizes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats.
MZ_SCALE = 500_000
INTENSITY_LEVELS = 16_384
FLOAT32_MAX = 3.4028234663852886e38
RECORD_HEAD = 28
RANS_HEAD = 528
BLOCK_SPECTRA = 128
BLOCK_PEAKS = 524_288


def valid_mz(mz: Column) -> Column:
    """Finite, not negative and not minus zero."""
    return ~F.isnan(mz) & (mz >= 0) & (mz < float("inf")) & (mz.cast("string") != "-0.0")


def quantise_mz(mz: Column, scale: int = MZ_SCALE) -> Column:
    """round(mz * scale), half away from zero; null where the value is not allowed or does not fit."""
    scaled = F.round(mz * F.lit(float(scale)))
    return F.when(valid_mz(mz) & (scaled < 9.2233720368547748e18), scaled.cast("long"))


def quantise_mz_strict(mz: Column, scale: int = MZ_SCALE) -> Column:
    """Like :func:`quantise_mz`, but an error where that gives null for a value."""
    level = quantise_mz(mz, scale)
    return F.when(mz.isNotNull() & level.isNull(), F.raise_error(F.lit("a mass is not finite, negative or too large"))).otherwise(level)


def supported_level(ms_level: Column) -> Column:
    return F.coalesce(ms_level.isin(1, 2), F.lit(False))


def dequantise_mz(level: Column, scale: int = MZ_SCALE) -> Column:
    return level / F.lit(float(scale))


def log_intensity(intensity: Column) -> Column:
    """log1p of finite positive values as float; null for others."""
    wide = intensity.cast("double")
    return F.when(~F.isnan(wide) & (wide > 0) & (wide < float("inf")), F.log1p(wide).cast("float"))


def quantise_intensity(intensity: Column, log_max: Column, levels: int = INTENSITY_LEVELS) -> Column:
    """0 for values up to zero, else 1..levels on a log scale; null for values that are not finite."""
    wide, top = intensity.cast("double"), log_max.cast("double")
    level = F.greatest(F.lit(1.0), F.least(F.lit(float(levels)), F.round(F.log1p(wide) / top * levels)))
    finite = ~F.isnan(wide) & (F.abs(wide) < float("inf"))
    return F.when(finite & ((wide <= 0) | (top == 0)), F.lit(0)).when(finite, level.cast("int"))


def quantise_intensity_strict(intensity: Column, log_max: Column, levels: int = INTENSITY_LEVELS) -> Column:
    """Like :func:`quantise_intensity`, but an error for values that are not finite."""
    level = quantise_intensity(intensity, log_max, levels)
    return F.when(intensity.isNotNull() & level.isNull(), F.raise_error(F.lit("an intensity is not finite"))).otherwise(level)


def dequantise_intensity(level: Column, log_max: Column, levels: int = INTENSITY_LEVELS) -> Column:
    """Back to a float, saturating at the largest one."""
    value = F.expm1(level.cast("double") / levels * log_max.cast("double"))
    return F.when((level == 0) | (log_max == 0), F.lit(0.0)).otherwise(F.least(value, F.lit(FLOAT32_MAX))).cast("float")


def bit_width(value: Column) -> Column:
    """Bits needed for a value that is not negative; 0 for 0."""
    return F.when(value == 0, F.lit(0)).otherwise(F.length(F.bin(value)))


def packed_bytes(count: Column, width: Column) -> Column:
    """Bytes of ``count`` values of ``width`` bits."""
    return F.floor((count * width + 7) / 8).cast("long")


def record_bytes(n_peaks: Column) -> Column:
    """Bytes of a flat record: head, 8 a mass, 4 an intensity."""
    return F.lit(RECORD_HEAD) + F.lit(12) * n_peaks


def block_bytes(spectra: Column, peaks: Column) -> Column:
    return F.lit(RECORD_HEAD) * spectra + F.lit(12) * peaks


def entropy_bytes(entropy: Column, n: Column) -> Column:
    """Estimated bytes of an entropy-coded stream; 0 for none."""
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.lit(RANS_HEAD) + F.ceil(entropy * n / 8))


def entropy_pays(encoded: Column, raw: Column, min_gain: int) -> Column:
    """Whether the encoded form is smaller by more than ``min_gain`` percent (99 at most)."""
    return (encoded < raw) & (encoded * 100 < raw * (100 - min(min_gain, 99)))


def percent_gain(raw: Column, stored: Column) -> Column:
    return F.when((raw == 0) | (stored >= raw), F.lit(0.0)).otherwise((1 - stored / raw) * 100)


def split_log_scale(bits: Column) -> tuple[Column, Column]:
    """Low and high 16 bits of a 32-bit pattern held in a long."""
    return bits.bitwiseAND(F.lit(65535)), F.shiftrightunsigned(bits, 16).bitwiseAND(F.lit(65535))


def join_log_scale(low: Column, high: Column) -> Column:
    return F.shiftleft(high.cast("long"), 16).bitwiseOR(low.cast("long"))
