"""Histograms, entropy and scaled frequencies of symbol streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from spectraforge.functions.numeric import entropy_bytes

#: Sum of the scaled frequencies of a stream.
SCALE = 4096
#: Keys whose counters a task holds before it hands them on.
HELD_KEYS = 1024
#: Bytes that are counted at once: each takes some 24 bytes of memory meanwhile.
SLICE = 1 << 20


def histogram(df: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    return df.groupBy(*keys, F.col(symbol).cast("int").alias("symbol")).agg(F.count(F.lit(1)).alias("count"))


def byte_histogram(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, symbol and count of the bytes of a binary or text column; null and empty values have none.

    A task counts whole batches into 256 counters a key; only counters that are not zero are shuffled, and summed.
    """
    slim = df.select(*keys, F.col(column).cast("binary").alias("__bytes"))
    schema = StructType([*slim.select(*keys).schema, StructField("symbol", IntegerType()), StructField("__count", LongType())])
    return slim.mapInArrow(_counted(keys, schema), schema).groupBy(*keys, "symbol").agg(F.sum("__count").alias("count"))


def _counted(keys: list[str], schema: StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []
        for b in batches:
            values, kinds = b.column(len(keys)).drop_null(), [b.column(i).type for i in range(len(keys))]
            valid = b.column(len(keys)).is_valid()
            kept = [b.column(i).filter(valid) for i in range(len(keys))]
            code = np.zeros(len(values), np.int64)
            for column in kept:
                encoded = column.dictionary_encode(null_encoding="encode")
                code = np.unique(code * len(encoded.dictionary) + encoded.indices.to_numpy(), return_inverse=True)[1]
            for row, table in zip(np.unique(code, return_index=True)[1], _tables(values, code)):
                key = tuple(column[int(row)].as_py() for column in kept)
                if key in held:
                    held[key] += table
                else:
                    held[key] = table.copy()  # a view would keep the batch's whole table
            if len(held) > HELD_KEYS:
                yield _flat(held, kinds, schema.names)
                held = {}
        if held:
            yield _flat(held, kinds, schema.names)

    return run


def _tables(values: pa.Array, code: np.ndarray) -> np.ndarray:
    """256 counters for each code, of the bytes of the values that have it; a slice of the bytes at a time, which may begin and end inside a value."""
    tables = np.zeros((code.max() + 1 if len(code) else 0, 256), np.int64)
    if not len(values):
        return tables
    offsets = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset).astype(np.int64)
    raw = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    for begin in range(offsets[0], offsets[-1], SLICE):
        end = min(begin + SLICE, offsets[-1])
        first, last = np.searchsorted(offsets, begin, "right") - 1, np.searchsorted(offsets, end, "left")
        lengths = np.diff(np.clip(offsets[first : last + 1], begin, end))
        used, own = np.unique(code[first:last], return_inverse=True)  # only the slice's own codes have counters meanwhile
        found = np.repeat(own * 256, lengths)
        found += raw[begin:end]
        tables[used] += np.bincount(found, minlength=256 * len(used)).reshape(-1, 256)
    return tables


def _flat(held: dict[tuple, np.ndarray], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    """A row for each key and byte that occurs."""
    tables = np.vstack(list(held.values()))
    row, symbol = np.nonzero(tables)
    keys = [pa.array([k[i] for k in held], kind).take(pa.array(row)) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*keys, pa.array(symbol.astype(np.int32)), pa.array(tables[row, symbol].astype(np.int64))], names=names)


def entropy_estimate(df: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """n, entropy in bits a symbol, and the estimated bytes of the coded stream."""
    return entropy_of(histogram(df, keys, symbol), keys)


def entropy_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`entropy_estimate` from a histogram."""
    share = F.col("count") / F.sum("count").over(Window.partitionBy(*keys))
    sums = counts.withColumn("__part", -share * F.log2(share)).groupBy(*keys).agg(F.sum("count").alias("n"), F.sum("__part").alias("entropy"))
    return sums.withColumn("coded_bytes", entropy_bytes(F.col("entropy"), F.col("n")))


def frequency_table(df: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """:func:`frequencies_of` a column of symbols."""
    return frequencies_of(histogram(df, keys, symbol), keys)


def frequencies_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    """From a histogram: count, freq (at least 1, summing to SCALE) and start (sum of the freqs before) of each symbol.

    What is missing goes to the symbol of the largest remainder; what is too much is taken one by
    one, each time from the symbol of the smallest remainder, and among equal ones from the one
    that has most left, down to 1 each. A stream has at most 256 symbols and SCALE + 256 units.
    """
    w = Window.partitionBy(*keys)
    f = counts.withColumn("__total", F.sum("count").over(w))
    scaled = F.col("count") * SCALE
    f = f.withColumn("__f", F.greatest(F.lit(1), F.floor(scaled / F.col("__total"))).cast("long")).withColumn("__r", scaled % F.col("__total"))
    f = f.withColumn("__missing", SCALE - F.sum("__f").over(w))
    up = F.row_number().over(w.orderBy(F.desc("__r"), F.desc("count"), "symbol"))
    # the first unit of a symbol stays; the others go in the order in which they would be taken
    units = f.withColumn("__up", up).withColumn("__unit", F.explode(F.sequence(F.lit(1), F.col("__f").cast("int"))))
    turn = F.row_number().over(w.orderBy(F.col("__unit") == 1, "__r", F.desc("__unit"), "symbol"))
    f = units.withColumn("__stays", turn > -F.col("__missing")).groupBy(*keys, "symbol", "count", "__missing", "__up").agg(F.count_if("__stays").alias("__left"))
    f = f.withColumn("freq", F.when((F.col("__missing") > 0) & (F.col("__up") == 1), F.col("__left") + F.col("__missing")).otherwise(F.col("__left")).cast("long"))
    start = F.sum("freq").over(w.orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1))
    return f.select(*keys, "symbol", "count", "freq", F.coalesce(start, F.lit(0)).cast("long").alias("start"))
