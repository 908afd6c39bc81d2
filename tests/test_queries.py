"""Every query with an SQL form gives the rows of that SQL on the smallest tables."""

import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from spectraforge import catalogue
from spectraforge.operators import codec, compare
from spectraforge.plans import views


def comparable(df):
    df = df[sorted(df.columns)].astype(object)
    rows = [tuple("" if x is None or x != x else round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x) for x in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    found = catalogue.queries()[name](spark, sf_dir).toPandas()
    with duckdb.connect() as con:
        for f in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        expected = con.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert comparable(found) == comparable(expected)


def test_record_checksums_against_zlib(spark, sf_dir):
    props = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props").collect()}
    assert {r.event_id: r.crc for r in catalogue.queries()["record_checksums"](spark, sf_dir).collect()} == {i: zlib.crc32((p or "").encode()) for i, p in props.items()}


def test_encoded_blocks_hold_all_spectra(spark, sf_dir):
    """Decoded, the blocks give every spectrum bit for bit."""
    back = codec.decode_blocks(codec.encode_blocks(views.nested(spark, sf_dir).join(views.blocked(spark, sf_dir).select("ordinal", "block_id"), "ordinal")))
    assert compare.all_passed(compare.lossless(views.nested(spark, sf_dir), back))
    blocks = catalogue.queries()["encoded_blocks"](spark, sf_dir)
    limits = {(r.ms_level, r.block_id) for r in catalogue.queries()["block_limits"](spark, sf_dir).collect()}
    assert {(r.ms_level, r.block_id) for r in blocks.collect()} == limits


def test_every_query_without_sql_has_a_test_of_its_own():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"record_checksums", "encoded_blocks"}


def test_statistics_of_the_smallest_tables(spark, sf_dir):
    assert tuple(catalogue.queries()["dump_inspect"](spark, sf_dir).first()) == (1500, 6000, 493, 1007, 290, 0, 4, 12)


def test_places_of_tied_peaks_do_not_depend_on_the_rows_order(spark, sf_dir, tmp_path):
    """Peaks of one mass and line follow by intensity, whatever order their rows have and however they are dealt."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey < 40")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(1).drop("l_orderkey", "l_discount", "l_linenumber", "l_extendedprice")
    ties = spark.createDataFrame([(k, 1 + i % 2, 5000.0, d / 100) for k in range(40) for i, d in enumerate((7, 3, 0, 9, 5, 1, 8, 2))], "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double").join(line)
    found = []
    for name, order in (("up", F.asc("l_discount")), ("down", F.desc("l_discount"))):
        orders.write.parquet(str(tmp_path / name / "orders.parquet"))
        ties.coalesce(1).sortWithinPartitions(order).write.parquet(str(tmp_path / name / "lineitem.parquet"))
        found.append({(r.ordinal, r.peak_idx): r.level for r in catalogue.queries()["intensity_quantised"](spark, str(tmp_path / name)).collect()})
        levels = [found[-1][7, i] for i in range(8)]
        assert levels[:4] == sorted(levels[:4]) and levels[4:] == sorted(levels[4:])
    assert found[0] == found[1]
