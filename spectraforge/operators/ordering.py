"""Ranks, running sums and order statistics of a whole table without gathering it in one task.

Rows are dealt to ranges of neighbouring keys whose splitters Spark samples, so it does not matter how the order
values lie: dense, sparse, hashed, or one value held by half of the rows (rows of one value and equal ``ties`` are
dealt by their other columns). Each range is sorted and summed up in passing by the task that holds it, and written
once to the shared folder. Only the part at the beginning of a range may have begun in an earlier one; these parts'
sums, one row a range, give the offsets.

Rows without an order value come first; which of two rows with the same value and ties comes first is not defined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from spectraforge.sources.shared import materialise

#: Buckets into which :func:`nth_value` cuts the values that are left, in each round.
BUCKETS = 4096


def running_total(df: DataFrame, value: Column, order: str, parts: list[str], name: str, ties: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before, by ``order`` and ``ties`` within ``parts``.

    A null value counts as 0, null parts are one part; a sum beyond 64 bits is an error. ``partitions`` sets the number
    of ranges, which else is Spark's number of shuffle partitions.
    """
    keys = [*parts, order, *ties]
    valued = df.withColumn("__v", F.coalesce(value.cast("long"), F.lit(0)))
    dealt_by = [*keys, F.xxhash64(*df.columns), F.monotonically_increasing_id()]
    dealt = valued.repartitionByRange(partitions, *dealt_by) if partitions else valued.repartitionByRange(*dealt_by)
    added = [StructField("__in", LongType()), StructField("__head", BooleanType()), StructField("__task", LongType()), StructField("__row", LongType())]
    summed = materialise(dealt.sortWithinPartitions(*keys).mapInArrow(_summed(parts), StructType([*dealt.schema, *added])))
    return summed.join(F.broadcast(_offsets(summed, parts)), "__task").select(  # one row a range
        *df.columns, (F.col("__in") + F.when(F.col("__head"), F.col("__before")).otherwise(0)).alias(name)
    )


def _summed(parts: list[str]):
    """Rows of a sorted range with the sum before each in its part, and whether the part is the range's first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, carry, last, head = TaskContext.get().partitionId(), 0, 0, None, True
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = b.column("__v").to_numpy().astype(np.int64)
            if abs(carry) + float(np.abs(v.astype(float)).sum()) >= 2.0**63:
                raise OverflowError("a running sum exceeds 64 bits")
            begins = np.zeros(n, bool)
            for p in parts:
                codes = b.column(p).dictionary_encode(null_encoding="encode").indices.to_numpy()
                begins[1:] |= codes[1:] != codes[:-1]
            first = tuple(b.column(p)[0].as_py() for p in parts)
            begins[0] = last is not None and first != last
            before = np.cumsum(v) - v + carry
            start = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
            inside = before - np.where(start >= 0, before[np.maximum(start, 0)], 0)
            heads = (start < 0) & head
            head, last, carry = bool(heads[-1]), tuple(b.column(p)[n - 1].as_py() for p in parts), int(inside[-1] + v[-1])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(inside), pa.array(heads), pa.array(np.full(n, task, np.int64)), pa.array(np.arange(row, row + n))], names=[*b.schema.names, "__in", "__head", "__task", "__row"]
            )
            row += n

    return run


def _offsets(summed: DataFrame, parts: list[str]) -> DataFrame:
    """For each range, the sum of its first part's rows in earlier ranges."""
    part = F.struct(*parts) if parts else F.struct(F.lit(0))
    rows = summed.select("__task", "__row", part.alias("p"), (F.col("__in") + F.col("__v")).alias("s"))
    ends = rows.groupBy("__task").agg(F.min_by("p", "__row").alias("first"), F.max_by("p", "__row").alias("last"), F.max_by("s", "__row").alias("s"))
    in_turn = Window.orderBy("__task")  # one row a range
    upto = F.sum("s").over(Window.partitionBy("last").orderBy("__task"))
    steps = ends.withColumn("upto", upto).select("__task", "first", F.lag("last").over(in_turn).alias("last_before"), F.lag("upto").over(in_turn).alias("upto_before"))
    return steps.select("__task", F.when(F.col("first").eqNullSafe(F.col("last_before")), F.col("upto_before")).otherwise(0).alias("__before"))


def rank(df: DataFrame, order: str, parts: list[str], name: str, ties: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... by ``order`` and ``ties`` within ``parts``."""
    return running_total(df, F.lit(1), order, parts, name, ties, partitions)


def nth_value(df: DataFrame, value: str, n: int, low: int, high: int) -> int:
    """The ``n``-th smallest (from 0) of a whole-number column whose values lie from ``low`` to ``high``, nulls left out.

    Each round counts the values of the interval that is left in at most ``BUCKETS`` buckets, whose counts go to the
    driver, and goes on with the one that holds the wanted value: six rounds for any 64-bit values.
    """
    v = F.col(value).cast("long")
    while low < high:
        width = -(-(high - low + 1) // BUCKETS)
        wide = "bigint" if high - low < 1 << 63 else "decimal(20,0)"
        bucket = F.call_function("div", v.cast(wide) - F.lit(low).cast(wide), F.lit(width).cast(wide)).cast("int")
        counts = sorted(df.where(v.between(low, high)).groupBy(bucket.alias("b")).count().collect())
        for at, count in counts:
            if n < count:
                break
            n -= count
        else:
            raise IndexError("there are not so many values")
        low, high = low + at * width, min(high, low + (at + 1) * width - 1)
    return low


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """One row with min_value, median_value (sorted[n / 2]) and max_value of a whole-number column; zeros for no rows."""
    n, low, high = df.agg(F.count(value), F.min(value).cast("long"), F.max(value).cast("long")).first()
    median = nth_value(df, value, n // 2, low, high) if n else 0
    return df.sparkSession.createDataFrame([(low or 0, median, high or 0)], "min_value long, median_value long, max_value long")
