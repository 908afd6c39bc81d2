"""Bit patterns of floats and frame-of-reference packing, as Arrow functions on whole batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType


@F.arrow_udf(LongType())
def double_bits(values: pa.Array) -> pa.Array:
    """The 64 bits of a double as a long."""
    return _viewed(values, np.float64, np.int64)


@F.arrow_udf(DoubleType())
def bits_double(bits: pa.Array) -> pa.Array:
    return _viewed(bits, np.int64, np.float64)


@F.arrow_udf(LongType())
def float_bits(values: pa.Array) -> pa.Array:
    """The 32 bits of a float, unsigned, as a long."""
    return _viewed(values, np.float32, np.uint32).cast(pa.int64())


@F.arrow_udf(FloatType())
def bits_float(bits: pa.Array) -> pa.Array:
    raw = bits.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint32).view(np.float32)
    return pa.array(raw, pa.float32(), mask=np.asarray(bits.is_null()))


@F.arrow_udf(ArrayType(LongType()))
def double_array_bits(values: pa.Array) -> pa.Array:
    """The 64 bits of each double of an array as longs."""
    return _viewed_lists(values, np.float64, np.int64)


@F.arrow_udf(ArrayType(IntegerType()))
def float_array_bits(values: pa.Array) -> pa.Array:
    """The 32 bits of each float of an array as ints (those of negative floats are negative)."""
    return _viewed_lists(values, np.float32, np.int32)


def _viewed_lists(values: pa.Array, old: type, new: type) -> pa.Array:
    ends = np.cumsum(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int32)
    offsets = pa.array(np.concatenate([np.zeros(1, np.int32), ends]))
    return pa.ListArray.from_arrays(offsets, _viewed(values.flatten(), old, new), mask=values.is_null())


def _viewed(values: pa.Array, old: type, new: type) -> pa.Array:
    raw = values.fill_null(0).to_numpy(zero_copy_only=False).astype(old, copy=False)
    return pa.array(np.ascontiguousarray(raw).view(new), mask=np.asarray(values.is_null()))


def pack(values: np.ndarray) -> tuple[int, int, bytes]:
    """(base, width, bytes): differences to the least value, ``width`` bits each, low bit first."""
    values = values.astype(np.uint64)
    if not len(values):
        return 0, 0, b""
    base = int(values.min())
    width = int(int(values.max()) - base).bit_length()
    left = values - np.uint64(base)
    bits = (left[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return base, width, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(base: int, width: int, count: int, payload: bytes) -> np.ndarray:
    """Inverse of :func:`pack`; checks the length, the padding bits and the range."""
    if not 0 <= width <= 64 or len(payload) != (count * width + 7) // 8:
        raise ValueError("packed payload has the wrong length")
    bits = np.unpackbits(np.frombuffer(payload, dtype=np.uint8), bitorder="little")
    if bits[count * width :].any():
        raise ValueError("packed payload has bits in its padding")
    if not width:
        return np.full(count, base, dtype=np.uint64)
    left = (bits[: count * width].reshape(count, width).astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    if count and int(left.max()) + base >= 1 << 64:
        raise OverflowError("packed value exceeds 64 bits")
    return left + np.uint64(base)
