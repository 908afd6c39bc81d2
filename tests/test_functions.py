import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from spectraforge.functions import bits, ingest
from spectraforge.functions import numeric as N
from spectraforge.operators import codec, compare
from spectraforge.operators.blocks import cut_blocks, greedy_blocks
from spectraforge.operators import entropy
from spectraforge.operators.entropy import byte_histogram, frequency_table
from spectraforge.operators.ordering import nth_value, rank, running_total, upper_median


@pytest.mark.parametrize(
    "values,width",
    [([5, 4, 5, 4, 5], 1), ([100, 227, 163, 191, 150], 7), ([1000, 1255, 1000, 1020], 8), ([5000, 5512, 5000, 5256], 10), ([0, 2**63 - 1], 63), ([0, 2**64 - 1], 64)],
)
def test_pack_widths(values, width):
    base, got, payload = bits.pack(np.array(values, dtype=np.uint64))
    assert (base, got, len(payload)) == (min(values), width, (width * len(values) + 7) // 8)
    assert bits.unpack(base, got, len(values), payload).tolist() == values


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60))
def test_pack_round_trip(values):
    base, width, payload = bits.pack(np.array(values, dtype=np.uint64))
    assert bits.unpack(base, width, len(values), payload).tolist() == values


def test_unpack_rejects_bad_payloads():
    with pytest.raises(ValueError):
        bits.unpack(0, 3, 2, b"")
    with pytest.raises(ValueError):
        bits.unpack(0, 3, 2, b"\xff")
    with pytest.raises(OverflowError):
        bits.unpack(2**64 - 1, 1, 1, b"\x01")


def test_mz_quantisation(spark):
    rows = spark.createDataFrame([(1.0,), (0.0000005,), (-1.0,), (float("nan"),), (float("inf"),), (-0.0,), (1.7e308,)], "mz double")
    got = [r[0] for r in rows.select(N.quantise_mz(F.col("mz"))).collect()]
    assert got == [500000, 0, None, None, None, None, None]
    assert spark.range(1).select(N.quantise_mz(F.lit(0.49999999999999994), 1), N.quantise_mz(F.lit(2.5), 1)).first() == (0, 3)


def test_intensity_quantisation_bounds(spark):
    values = [(float(np.exp(i * 16 / 512)),) for i in range(512)] + [(0.0,), (-3.0,)]
    df = spark.createDataFrame(values, "mz double").select(F.lit(1).alias("ms_level"), F.lit(0).alias("block_id"), "mz", F.col("mz").cast("float").alias("intensity"))
    top = df.agg(F.max(N.log_intensity(F.col("intensity")))).first()[0]
    level = N.quantise_intensity(F.col("intensity"), F.lit(top).cast("float"))
    rows = df.select("intensity", level.alias("l"), N.dequantise_intensity(level, F.lit(top).cast("float")).alias("back")).collect()
    bound = (np.exp(top / N.INTENSITY_LEVELS) - 1) * 1.01
    for r in rows:
        if r.intensity <= 0:
            assert (r.l, r.back) == (0, 0.0)
        else:
            assert 1 <= r.l <= N.INTENSITY_LEVELS and abs(r.back - r.intensity) / (r.intensity + 1) <= bound


def test_bits_of_special_floats(spark):
    patterns = [0x00000001, 0x80000000, 0x7F800000, 0xFF800000, 0x3F800000]
    df = spark.createDataFrame([(p,) for p in patterns] + [(None,)], "b long").withColumn("f", bits.bits_float("b"))
    assert [r[0] for r in df.select(bits.float_bits("f")).collect()] == [*patterns, None]
    doubles = spark.createDataFrame([(1.0,), (-0.0,)], "d double").select(bits.double_bits("d").alias("b")).withColumn("d", bits.bits_double("b"))
    assert [tuple(r) for r in doubles.collect()] == [(0x3FF0000000000000, 1.0), (-(2**63), 0.0)]


def test_crc_check_value(spark):
    assert spark.range(1).select(F.crc32(F.lit("123456789"))).first()[0] == 3421780262 == zlib.crc32(b"123456789")


def test_greedy_cut_against_a_loop(spark):
    rng = np.random.default_rng(5)
    n = rng.integers(0, 9, 700)
    n[100] = 20
    df = spark.createDataFrame([(i, 1 + i % 2, int(x)) for i, x in enumerate(n)], "ordinal long, ms_level int, n_peaks long")
    got = {r.ordinal: r.block_id for r in greedy_blocks(df, 5, 20, width=16, group=4).collect()}
    assert got == {r.ordinal: r.block_id for r in cut_blocks(df, 5, 20).collect()}
    assert {r.ordinal: r.block_id for r in greedy_blocks(df, 5, 100).collect()} == {r.ordinal: r.block_id for r in cut_blocks(df, 5, 100).collect()}
    for level in (1, 2):
        block, s, p = 0, 0, 0
        for i in range(level - 1, 700, 2):
            if s and (s == 5 or p + n[i] > 20):
                block, s, p = block + 1, 0, 0
            s, p = s + 1, p + n[i]
            assert got[i] == block


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 12), min_size=1, max_size=400), st.sampled_from([1, 3, 7]), st.sampled_from([12, 20, 60]), st.sampled_from([2, 3, 16]))
def test_greedy_cut_through_trees_of_any_depth(spark, n, size, most, group):
    """Ranges of eight rows and small groups, so that tables are composed several times."""
    df = spark.createDataFrame([(i * i, 1, x) for i, x in enumerate(n)], "ordinal long, ms_level int, n_peaks long")
    got = [r.block_id for r in greedy_blocks(df, size, most, width=8, group=group).orderBy("ordinal").collect()]
    block, s, p, expected = 0, 0, 0, []
    for x in n:
        if s and (s == size or p + x > most):
            block, s, p = block + 1, 0, 0
        s, p = s + 1, p + x
        expected.append(block)
    assert got == expected


def test_a_spectrum_over_the_limit_is_an_error(spark):
    df = spark.createDataFrame([(0, 1, 3), (1, 1, 21)], "ordinal long, ms_level int, n_peaks long")
    with pytest.raises(Exception, match="more than the 20 peaks"):
        cut_blocks(df, 5, 20).collect()


def test_rank_keeps_rows_without_order_and_breaks_ties(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), (5, 3), (5, 1), (4, 9), (10**9, 0), (-7, 0)], "o long, t int")
    got = {(r.o, r.t): r.r for r in rank(df, "o", [], "r", ties=("t",), partitions=5).collect()}
    assert got == {(None, 1): 0, (None, 2): 1, (-7, 0): 2, (4, 9): 3, (5, 1): 4, (5, 3): 5, (10**9, 0): 6}
    parts = spark.createDataFrame([(1, None), (2, None), (3, 1)], "o long, k int")
    assert {r.o: r.r for r in rank(parts, "o", ["k"], "r").collect()} == {1: 0, 2: 1, 3: 0}


@pytest.mark.parametrize("kind", ["hashed", "one value", "one row", "one part", "many parts"])
def test_rank_of_any_keys_deals_rows_to_many_tasks(spark, kind):
    """Hashed 64-bit keys, one value or one row held by half of the rows, all rows in one part, a part a few rows."""
    n = F.col("id")
    half = n % 2 == 0
    order = {"hashed": F.xxhash64("id"), "one value": F.when(half, 7).otherwise(n), "one row": F.when(half, 7).otherwise(n)}.get(kind, n * 1000)
    part = F.floor(n / 5) if kind == "many parts" else F.lit(3) if kind in ("one part", "one row") else n % 3
    df = spark.range(20_000).select(order.cast("long").alias("o"), part.cast("long").alias("k"), (F.lit(0) if kind == "one row" else n).alias("t"))
    rows = rank(df, "o", ["k"], "r", ties=("t",), partitions=16).toPandas().sort_values(["k", "o", "t"], kind="stable")
    assert sorted(rows["r"][rows["k"] == 3]) == list(range((rows["k"] == 3).sum()))
    assert (rows.groupby("k")["r"].apply(lambda r: sorted(r) == list(range(len(r))))).all() and len(rows) == 20_000
    assert rows.sort_values(["k", "r"])[["k", "o", "t"]].equals(rows[["k", "o", "t"]].set_axis(rows.sort_values(["k", "r"]).index)) or kind == "one row"
    written = max(Path(spark.conf.get("spark.checkpoint.dir")).glob("files-*"), key=lambda p: p.stat().st_mtime)
    sizes = [r[0] for r in spark.read.parquet(str(written)).groupBy("__task").count().select("count").collect()]
    assert len(sizes) > 8 and max(sizes) < 4_000


def test_running_total_over_ranges_of_one_part(spark):
    df = spark.range(3_000).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 11 - 5).alias("v"), F.when(F.col("id") > 5, F.lit("x")).alias("k"))
    rows = running_total(df, F.col("v"), "id", ["k"], "s", partitions=9).toPandas().sort_values("id")
    for _, part in rows.groupby("k", dropna=False):
        v = part["v"].fillna(0)
        assert (part["s"] == v.cumsum() - v).all()
    with pytest.raises(Exception, match="64 bits"):
        running_total(df, F.lit(2**62), "id", [], "s").collect()


def test_order_statistics_equal_the_sort(spark):
    values = F.xxhash64("id")
    df = spark.range(200_000).select(values.alias("v"))
    ordered = sorted(r[0] for r in df.collect())
    for n in (0, 1, 99_999, 199_999):
        assert nth_value(df, "v", n, ordered[0], ordered[-1]) == ordered[n]
    assert nth_value(df, "v", 77, -(2**63), 2**63 - 1) == ordered[77]
    assert tuple(upper_median(df, "v").first()) == (ordered[0], ordered[100_000], ordered[-1])
    few = spark.createDataFrame([(3,), (None,), (3,), (-9,)], "v int")
    assert tuple(upper_median(few, "v").first()) == (-9, 3, 3) and tuple(upper_median(few.where("v > 5"), "v").first()) == (0, 0, 0)


def test_median_of_ten_million_distinct_values(spark):
    df = spark.range(10_000_000).select(((F.col("id") * 7_368_787) % 10_000_019).alias("v"))
    assert upper_median(df, "v").first().median_value == np.sort(np.arange(10_000_000) * 7_368_787 % 10_000_019)[5_000_000]


def one_by_one(counts):
    """Frequencies by giving and taking single units."""
    total = sum(counts.values())
    freq = {s: max(1, c * 4096 // total) for s, c in counts.items()}
    rest = {s: c * 4096 % total for s, c in counts.items()}
    while sum(freq.values()) < 4096:
        freq[max(counts, key=lambda s: (rest[s], counts[s], -s))] += 1
    while sum(freq.values()) > 4096:
        freq[min((s for s in counts if freq[s] > 1), key=lambda s: (rest[s], -freq[s], s))] -= 1
    return freq


@pytest.mark.parametrize("counts", [dict.fromkeys(range(200), 1) | {200: 49_900, 201: 49_900}, {s: 1 + s * s % 977 for s in range(256)}, {3: 5}, dict.fromkeys(range(256), 7), {0: 10**6, 1: 1, 2: 1}])
def test_frequencies_against_single_steps(spark, counts):
    rows = spark.createDataFrame(list(counts.items()), "s int, c int").select("s", F.explode(F.sequence(F.lit(1), "c")).alias("x")).select(F.lit("a").alias("stream"), "s")
    assert {r.symbol: r.freq for r in frequency_table(rows, ["stream"], "s").collect()} == one_by_one(counts)


def test_byte_histogram_equals_the_exploded_one(spark, monkeypatch):
    monkeypatch.setattr(entropy, "HELD_KEYS", 7)
    values = [b"", None, b"\x00\xff\xff", "wörd".encode(), bytes(range(256)) * 3]
    rows = [(k, None if k == 5 else f"s{k % 3}", values[(k + i) % 5]) for k in range(40) for i in range(9)]
    df = spark.createDataFrame(rows, "k int, s string, b binary").repartition(3)
    got = {(r.k, r.s, r.symbol): r["count"] for r in byte_histogram(df, ["k", "s"], "b").collect()}
    expected = {}
    for k, s, b in rows:
        for x in b or b"":
            expected[k, s, x] = expected.get((k, s, x), 0) + 1
    assert got == expected
    assert {r.symbol: r["count"] for r in byte_histogram(df, [], "b").collect()} == {x: sum((b or b"").count(x) for _, _, b in rows) for x in range(256)}
    assert byte_histogram(df.where("k < 0"), ["k"], "b").count() == 0
    assert byte_histogram(df.where("b is null"), ["k"], "b").count() == 0


def test_byte_histogram_shuffles_no_row_a_byte(spark):
    df = spark.range(0, 50_000, 1, 4).select((F.col("id") % 2).alias("k"), F.repeat(F.lit("abcdefgh"), 20).alias("t"))
    counters = entropy._counted(["k"], byte_histogram(df, ["k"], "t").schema)
    slim = df.select("k", F.col("t").cast("binary"))
    assert slim.mapInArrow(counters, "k long, symbol int, count long").count() == 4 * 2 * 8  # of 8,000,000 bytes


def test_strict_quantisation(spark):
    with pytest.raises(Exception, match="a mass is not"):
        spark.range(1).select(N.quantise_mz_strict(F.lit(-1.0))).collect()
    with pytest.raises(Exception, match="not finite"):
        spark.range(1).select(N.quantise_intensity_strict(F.lit(float("inf")).cast("float"), F.lit(1.0))).collect()
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.range(1).select(N.record_bytes(F.lit(2**62))).collect()
    assert spark.range(1).select(N.quantise_mz_strict(F.lit(None).cast("double")), N.dequantise_intensity(F.lit(0), F.lit(1.0))).first() == (None, 0.0)


def test_lossy_comparison_names_each_failure(spark):
    kind = "ordinal long, scan_id long, rt_seconds float, ms_level int, precursor_mz double, mz array<double>, intensity array<float>"
    a = spark.createDataFrame([(i, i, 1.0, 1, 0.0, [1.0, 2.0000003], [0.0, 10.0]) for i in range(4)], kind)
    good = a.withColumn("mz", F.transform("mz", lambda x: N.dequantise_mz(N.quantise_mz(x))))

    def failed(b):
        return {r["check"]: r.observed for r in compare.lossy(a, b).collect() if not r.passed}

    assert failed(good) == {}
    assert failed(good.where("ordinal < 3")) == {"spectrum_count": 1.0}
    assert failed(good.withColumn("scan_id", F.col("ordinal") % 2)) == {"metadata": 2.0}
    assert failed(good.withColumn("mz", F.slice("mz", 1, 1))) == {"peak_count": 4.0}
    assert failed(a) == {"mz_grid": 4.0}
    assert failed(good.withColumn("intensity", F.lit([0.5, -1.0]).cast("array<float>"))) == {"domain": 8.0}
    assert set(failed(good.withColumn("intensity", F.lit([0.0, 11.0]).cast("array<float>")))) == {"log_error"}



def test_rank_and_running_total(spark):
    df = spark.range(100).select((F.col("id") * 3).alias("o"), (F.col("id") % 2).alias("k"))
    got = rank(df, "o", ["k"], "r", partitions=7).orderBy("o").collect()
    assert [r.r for r in got] == [i // 2 for i in range(100)]
    sums = running_total(df, F.col("o"), "o", [], "s", partitions=7).orderBy("o").collect()
    assert [r.s for r in sums] == list(np.cumsum([0, *range(0, 297, 3)]))


def spectra(spark, rows):
    return spark.createDataFrame(rows, "ordinal long, scan_id long, rt_seconds float, ms_level int, precursor_mz double, block_id long, mz array<double>, intensity array<float>")


def test_codec_keeps_every_bit(spark):
    rows = [
        (i, 1000 + i, 1.5 + 0.2 * i, 2 if i % 2 == 0 else 1, 400.0 + i if i % 2 == 0 else 0.0, i // 7, [100 + 17 * i + 0.125 * p for p in range(0 if i % 5 == 0 else i % 4 + 1)], [float((i + 1) * (p + 1) * 11 % 1000) or 0.5 for p in range(0 if i % 5 == 0 else i % 4 + 1)])
        for i in range(40)
    ]
    rows[3][7][0] = float("inf")
    df = spectra(spark, rows)
    back = codec.decode_blocks(codec.encode_blocks(df))
    checks = compare.lossless(df, back)
    assert compare.all_passed(checks), checks.collect()


def test_codec_refuses_bad_masses_and_bad_blocks(spark):
    for mz in ([2.0, 1.0], [-1.0, 1.0], [float("nan"), 1.0]):
        with pytest.raises(Exception, match="mass"):
            codec.encode_blocks(spectra(spark, [(0, 0, 0.0, 1, 0.0, 0, mz, [1.0, 1.0])])).collect()
    good = codec.encode_blocks(spectra(spark, [(0, 0, 0.0, 1, 0.0, 0, [1.0, 2.0], [1.0, 1.0])]))
    with pytest.raises(Exception, match="checksum"):
        codec.decode_blocks(good.withColumn("rt", F.lit(b"\x00\x00\x00\x01"))).collect()


def test_lossless_comparison_names_the_first_difference(spark):
    df = spectra(spark, [(i, i, 0.0, 1, 0.0, 0, [1.0], [float(i)]) for i in range(5)])
    other = df.where("ordinal <> 4").withColumn("intensity", F.when(F.col("ordinal") >= 2, F.array(F.lit(9.0).cast("float"))).otherwise(F.col("intensity")))
    found = {r["check"]: (r.passed, r.first_mismatch) for r in compare.lossless(df, other).collect()}
    assert found["intensity"] == (False, 2) and found["spectrum_count"] == (False, 4) and found["mz"] == (True, None)


def test_ingest_errors(spark):
    with pytest.raises(Exception, match="differ in number"):
        spark.range(1).select(ingest.sorted_peaks(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).collect()
    with pytest.raises(Exception, match="scan number"):
        spark.range(1).select(ingest.scan_id(F.lit("x"), F.lit(None).cast("long"))).collect()
    assert spark.range(1).select(ingest.scan_id(F.lit("a scan=17"), F.lit(3))).first()[0] == 17


def test_byte_histogram_takes_no_memory_a_byte(monkeypatch):
    """Counting a batch of 32 MB needs a few MB besides, also within one value; slices that end inside values count every byte once."""
    schema = StructType([StructField("k", LongType()), StructField("symbol", IntegerType()), StructField("count", LongType())])
    values = [b"abcdefgh" * (1 << 20), None, b"", b"xyz" * (1 << 20), *[bytes(range(256)) * 40] * 2000]
    batch = pa.RecordBatch.from_arrays([pa.array([i % 3 for i in range(len(values))]), pa.array(values, pa.binary())], names=["k", "b"])
    tracemalloc.start()
    (got,) = entropy._counted(["k"], schema)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    expected = {}
    for i, v in enumerate(values):
        for s, n in enumerate(np.bincount(np.frombuffer(v or b"", np.uint8), minlength=256)):
            if n:
                expected[i % 3, s] = expected.get((i % 3, s), 0) + int(n)
    assert {(r["k"], r["symbol"]): r["count"] for r in got.to_pylist()} == expected
    small = batch.slice(5, 90)
    monkeypatch.setattr(entropy, "SLICE", 997)
    (cut,) = entropy._counted(["k"], schema)(iter([small]))
    assert sum(r["count"] for r in cut.to_pylist()) == sum(len(v) for v in small.column(1).to_pylist())
    assert {r["count"] for r in cut.to_pylist()} == {30 * 40}
