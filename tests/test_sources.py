"""Dump files byte by byte, damaged and empty ones, failed writes, and mzML documents written by hand."""

import base64
import struct
import time
import zlib
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual
from pyspark.sql.types import StructType

from spectraforge.operators import compare
from spectraforge.operators.ordering import rank
from spectraforge.plans import files
from spectraforge.sources import dump, mzml
from spectraforge.sources.dump import HEADER, index_dump, read_dump, read_records, scan_headers, write_dump
from spectraforge.sources.mzml import read_mzml, write_mzml
from spectraforge.sources.shared import fresh_folder, scratch, shuffles_dropped

SPECTRA = "ordinal long, scan_id long, rt_seconds float, ms_level int, precursor_mz double, mz array<double>, intensity array<float>"
ROWS = [(2, 7, 2.5, 2, 400.25, [100.0, 100.0, 250.5], [1.0, 0.0, -0.0]), (0, 5, 1.5, 1, 0.0, [], []), (1, 4294967295, -1.0, 1, 0.0, [0.0], [float("inf")])]


def record(scan_id, rt, level, precursor, mz, intensity):
    return struct.pack("<IfBxxxdIxxxx", scan_id, rt, level, precursor, len(mz)) + np.array(mz, "<f8").tobytes() + np.array(intensity, "<f4").tobytes()


EXPECTED = b"".join(record(*r[1:]) for r in sorted(ROWS))


def content(folder):
    return b"".join(f.read_bytes() for f in sorted(Path(folder).glob("*.bin")))


def spectra(spark, rows=ROWS):
    return spark.createDataFrame(rows, SPECTRA)


def test_header_takes_28_bytes():
    assert HEADER.itemsize == 28


def test_written_bytes_and_rows_read(spark, tmp_path):
    write_dump(spectra(spark), str(tmp_path / "d"), "ordinal")
    assert content(tmp_path / "d") == EXPECTED
    assert not list((tmp_path / "d").glob("_temporary*"))
    found = read_dump(spark, str(tmp_path / "d")).orderBy("part", "position").collect()
    assert [(r.scan_id, r.rt_seconds, r.ms_level, r.precursor_mz, r.n_peaks, r.mz, r.intensity) for r in found] == [(*r[1:5], len(r[5]), r[5], r[6]) for r in sorted(ROWS)]


def test_views_of_one_file(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(EXPECTED)
    path = f"file:{tmp_path}/x.bin"
    headers = read_dump(spark, path, view="headers")
    assert "mz" not in headers.columns
    assert [(r.position, r.scan_id, r.n_peaks) for r in headers.orderBy("position").collect()] == [(0, 5, 0), (1, 4294967295, 1), (2, 7, 3)]
    assert [r.scan_id for r in read_dump(spark, path, level="2").collect()] == [7]


def test_special_bit_patterns_survive(spark, tmp_path):
    bits = np.array([0x00000001, 0x80000000, 0x7FC01234, 0x7F800000, 0xFF800000], "<u4")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(record(1, 0.0, 1, 0.0, np.arange(5.0), bits.view("<f4")))
    write_dump(read_dump(spark, str(tmp_path / "a")), str(tmp_path / "b"), "position")
    assert content(tmp_path / "b") == content(tmp_path / "a")


def test_empty_dumps(spark, tmp_path):
    (tmp_path / "e.bin").write_bytes(b"")
    assert read_dump(spark, str(tmp_path / "e.bin")).count() == 0
    write_dump(spectra(spark, []), str(tmp_path / "d"), "ordinal")
    assert read_dump(spark, str(tmp_path / "d")).count() == 0


def test_indexed_files_are_read_in_ranges(spark, tmp_path):
    rows = [(i, i, float(i), 1 + i % 2, 0.0, [float(p) for p in range(i % 5)], [1.0] * (i % 5)) for i in range(60)]
    one = spectra(spark, rows).coalesce(1)

    def found(path, **options):
        df = read_dump(spark, str(path), **options)
        return df.rdd.getNumPartitions(), [tuple(r) for r in df.orderBy("part", "position").collect()]

    write_dump(one, str(tmp_path / "d"), "ordinal", split_bytes=200)
    ranges, indexed = found(tmp_path / "d")
    indexes = {f: f.read_bytes() for f in (tmp_path / "d").glob("*.idx")}
    for f in indexes:
        f.unlink()
    files, plain = found(tmp_path / "d")
    assert ranges > 2 * files and indexed == plain and len(plain) == 60
    index_dump(spark, str(tmp_path / "d"), split_bytes=200)  # the same indexes for files that have none
    assert {f: f.read_bytes() for f in (tmp_path / "d").glob("*.idx")} == indexes
    assert found(tmp_path / "d", level="2")[1] == [r for r in plain if r[4] == 2]
    with pytest.raises(Exception, match="more than 3 spectra"):
        found(tmp_path / "d", max_spectra="3")
    longer = sorted((tmp_path / "d").glob("*.bin"))[0]
    longer.write_bytes(longer.read_bytes() + record(99, 0.0, 1, 0.0, [1.0], [1.0]))  # its index is of another size
    assert len(found(tmp_path / "d")[1]) == 61
    single = tmp_path / "x.bin"
    single.write_bytes(EXPECTED)
    index_dump(spark, str(single), split_bytes=1)
    assert found(single)[0] == 3 and [r[2] for r in found(single)[1]] == [5, 4294967295, 7]
    single.write_bytes(EXPECTED[:-1])
    with pytest.raises(Exception, match="truncated record"):
        index_dump(spark, str(single))
    write_dump(one, str(tmp_path / "d"), "ordinal")  # an older dump goes with its indexes
    assert len(list((tmp_path / "d").glob("*.idx"))) == len(list((tmp_path / "d").glob("*.bin"))) and len(found(tmp_path / "d")[1]) == 60


@pytest.mark.parametrize("view", ["spectra", "headers"])
def test_every_proper_prefix_inside_a_record_fails(spark, tmp_path, view):
    whole = record(1, 0.0, 1, 0.0, [1.0, 2.0], [3.0, 4.0])
    for n in (1, 27, 28, 29, 44, len(whole) - 1):
        (tmp_path / "t.bin").write_bytes(whole + whole[:n])
        with pytest.raises(Exception, match="truncated record"):
            read_dump(spark, str(tmp_path / "t.bin"), view=view).collect()


@pytest.mark.parametrize("at", [9, 11, 24, 27])
def test_padding_must_be_zero(spark, tmp_path, at):
    damaged = bytearray(record(1, 0.0, 1, 0.0, [1.0], [3.0]))
    damaged[at] = 1
    (tmp_path / "p.bin").write_bytes(damaged)
    with pytest.raises(Exception, match="padding"):
        read_dump(spark, str(tmp_path / "p.bin")).collect()


@pytest.mark.parametrize(
    ("row", "message"),
    [
        ((3, 1, 0.0, 1, 0.0, [1.0], [1.0, 2.0]), "differ in number"),
        ((3, 1, 0.0, 1, 0.0, None, [1.0]), "nulls"),
        ((3, 1, None, 1, 0.0, [1.0], [1.0]), "nulls"),
        ((3, 1, 0.0, 1, 0.0, [None], [1.0]), "nulls"),
        ((3, -1, 0.0, 1, 0.0, [1.0], [1.0]), "32 bits"),
    ],
)
def test_a_failed_write_leaves_the_old_dump(spark, tmp_path, row, message):
    path = str(tmp_path / "d")
    write_dump(spectra(spark), path, "ordinal")
    with pytest.raises(Exception, match=message):
        write_dump(spectra(spark, [*ROWS, row]), path, "ordinal")
    assert content(path) == EXPECTED
    assert not list(Path(path).glob("_temporary*"))


def test_overwriting_replaces_the_old_dump(spark, tmp_path):
    path = str(tmp_path / "d")
    write_dump(spectra(spark), path, "ordinal")
    write_dump(spectra(spark, ROWS[1:2]), path, "ordinal")
    assert content(path) == record(*ROWS[1][1:])


class Counted:
    """A file that counts the bytes it gives."""

    read = 0

    def __init__(self, file):
        self.file = file

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def read_at(self, n, offset):
        found = self.file.read_at(n, offset)
        Counted.read += len(found)
        return found


@pytest.fixture
def counted(monkeypatch):
    plain = dump._opened
    monkeypatch.setattr(dump, "_opened", lambda system, path: Counted(plain(system, path)))
    Counted.read = 0
    return Counted


def large(folder, n=40, peaks=30_000):
    folder.mkdir()
    sizes = [peaks + i % 3 for i in range(n)]
    (folder / "a.bin").write_bytes(b"".join(record(i, float(i), 1 + (i % 10 == 3), 0.0, np.arange(k, dtype=float) + i, np.full(k, i)) for i, k in enumerate(sizes)))
    return str(folder), [28 + 12 * k for k in sizes]


def read_in_process(path, filters, **options):
    reader = dump._FilteringReader(StructType.fromDDL(dump.VIEWS[options.get("view", "spectra")]), {"path": path, **options})
    assert list(reader.pushFilters(filters)) == filters
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def test_peaks_of_filtered_records_are_not_read(spark, tmp_path, counted):
    path, lengths = large(tmp_path / "d")
    assert [r["scan_id"] for r in read_in_process(path, [])] == list(range(40))
    assert counted.read < 1.3 * sum(lengths)  # a record that a window cuts is read again
    counted.read = 0
    found = read_in_process(path, [EqualTo(("ms_level",), 2)])
    assert [r["scan_id"] for r in found] == [3, 13, 23, 33] and found[1]["mz"][:2] == [13.0, 14.0] and set(found[1]["intensity"]) == {13.0}
    assert counted.read < 0.15 * sum(lengths)
    counted.read = 0
    assert [r["scan_id"] for r in read_in_process(path, [In(("scan_id",), (5, 7, 900))])] == [5, 7] and counted.read < 0.1 * sum(lengths)
    counted.read = 0
    assert len(read_in_process(path, [], view="headers")) == 40 and counted.read < 0.02 * sum(lengths)
    index = dump._Index(lengths[0])
    index.add(np.array(lengths))
    (tmp_path / "d" / "a.bin.idx").write_bytes(index.bytes())
    counted.read = 0
    assert [r["position"] for r in read_in_process(path, [GreaterThan(("position",), 36), LessThanOrEqual(("position",), 38)])] == [37, 38]
    assert counted.read < 0.09 * sum(lengths)  # ranges of other positions are not opened
    counted.read = 0
    assert read_in_process(path, [EqualTo(("part",), "b.bin")]) == [] and counted.read == 0


def test_conditions_give_the_rows_they_give_when_tested_later(spark, tmp_path):
    rows = [(i, i * 3, float(i), 1 + i % 2, 0.0, [float(p) for p in range(i % 5)], [1.0] * (i % 5)) for i in range(60)]
    write_dump(spectra(spark, rows), str(tmp_path / "d"), "ordinal", split_bytes=200, files=3)
    every = [tuple(r) for r in read_dump(spark, str(tmp_path / "d"), ordinals="true").collect()]
    plain = spark.createDataFrame(every, read_dump(spark, str(tmp_path / "d"), ordinals="true").schema)
    some = sorted({r[1] for r in every})[1]
    for condition in ("ms_level = 2", "position in (1, 3, 99)", "ordinal > 7 and ordinal <= 31", "part = '%s' and n_peaks >= 3" % some, "scan_id < 30 or ms_level = 1", "ms_level is null", "not (ms_level = 1)", "n_peaks <=> 2", "rt_seconds > 40", "ordinal = 59", "part in ('x')"):
        pushed, expected = read_dump(spark, str(tmp_path / "d"), condition, ordinals="true"), plain.where(condition)
        assert sorted(map(str, pushed.collect())) == sorted(map(str, expected.collect())), condition
        assert pushed.where("n_peaks = 4").unionByName(pushed.where("ms_level = 1")).count() == expected.where("n_peaks = 4").unionByName(expected.where("ms_level = 1")).count()
        assert pushed.count() == expected.count()
    later = read_dump(spark, str(tmp_path / "d"))
    assert later.where("scan_id = 3").unionByName(later).count() == 61 and later.where("scan_id = 6").count() == 1 and later.count() == 60


def test_chosen_records_read_their_own_bytes_only(spark, tmp_path, counted):
    path, lengths = large(tmp_path / "d", n=300, peaks=3_000)
    headers = read_dump(spark, path, view="headers")
    assert [r.offset for r in headers.orderBy("position").collect()] == list(np.cumsum(lengths) - lengths)
    wanted = spark.createDataFrame([(7,), (200,), (299,)], "scan_id long")
    chosen = headers.join(wanted, "scan_id", "left_semi")
    found = read_records(spark, path, chosen.unionByName(chosen.where("scan_id = 7"))).orderBy("scan_id").collect()
    assert [r.scan_id for r in found] == [7, 7, 200, 299] and [r.position for r in found] == [7, 7, 200, 299]
    assert found[2].mz == [200.0 + k for k in range(3_000 + 200 % 3)] and set(found[2].intensity) == {200.0}
    batch = chosen.select("part", "position", "offset", "n_peaks").orderBy("offset").toArrow().to_batches()
    assert sum(b.num_rows for b in dump._read_chosen(path, batch)) == 3
    assert counted.read == lengths[7] + lengths[200] + lengths[299]  # 1 % of the records, 1 % of the bytes
    counted.read = 0
    near = headers.where("position between 10 and 19").select("part", "position", "offset", "n_peaks").orderBy("offset").toArrow().to_batches()
    assert [b.num_rows for b in dump._read_chosen(path, near)] == [10] and counted.read == sum(lengths[10:20])
    for column, damage, message in (("n_peaks", -1, "differs"), ("offset", 10**9, "no record")):
        with pytest.raises(Exception, match=message):
            read_records(spark, path, chosen.withColumn(column, F.col(column) + damage)).collect()
    assert read_records(spark, path, chosen.limit(0)).count() == 0


def test_dumps_of_several_files_compare_by_ordinal(spark, tmp_path):
    rows = [(i, 900 - i, float(i), 1 + i % 2, float(i % 2), [float(p) for p in range(i % 7)], [float(i)] * (i % 7)) for i in range(200)]
    for name, files, split in (("a", 2, 10**6), ("b", 7, 100)):
        write_dump(spectra(spark, rows), str(tmp_path / name), "ordinal", split_bytes=split, files=files)
    a, b = (read_dump(spark, str(tmp_path / n), ordinals="true", view="bits") for n in "ab")
    assert sorted((r.ordinal, r.scan_id) for r in b.collect()) == [(i, 900 - i) for i in range(200)]
    assert a.select("part").distinct().count() == 2 < b.select("part").distinct().count()
    assert compare.all_passed(compare.lossless(a, b))
    assert compare.all_passed(compare.lossless(spectra(spark, rows), b))  # patterns against floats
    changed = [(*r[:3], 2, *r[4:]) if r[0] == 150 else r for r in rows]
    write_dump(spectra(spark, changed), str(tmp_path / "c"), "ordinal", files=5)
    c = read_dump(spark, str(tmp_path / "c"), ordinals="true", view="bits")
    assert {r["check"]: r.first_mismatch for r in compare.lossless(a, c).collect() if not r.passed} == {"ms_level": 150}
    next((tmp_path / "c").glob("*.idx")).unlink()
    with pytest.raises(Exception, match="ordinals need an index"):
        read_dump(spark, str(tmp_path / "c"), ordinals="true").collect()


def test_patterns_of_nan_are_told_apart(spark, tmp_path):
    def view(name, pattern, mz=(1.0, 2.0)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.bin").write_bytes(record(1, 0.0, 1, 0.0, mz, np.array([pattern, 0x3F800000], "<u4").view("<f4")))
        index_dump(spark, str(tmp_path / name))
        return [read_dump(spark, str(tmp_path / name), ordinals="true", view=v) for v in ("bits", "spectra")]

    a, b, c, zero, minus = view("a", 0x7FC01234), view("b", 0x7FC00000), view("c", 0x7FC01234), view("d", 0), view("e", 0x80000000)
    assert a[0].first().intensity_bits == [0x7FC01234, 0x3F800000]
    for x, y, failed in ((a, b, ["intensity"]), (a, c, []), (zero, minus, ["intensity"])):
        for left in x:
            for right in y:
                assert [r["check"] for r in compare.lossless(left, right).collect() if not r.passed] == failed


def test_arrays_of_unequal_length_in_one_row_fail_the_peak_count(spark):
    df = spectra(spark, [(0, 1, 0.0, 1, 0.0, [1.0, 2.0], [1.0]), (1, 2, 0.0, 1, 0.0, [], [])])
    assert {r["check"]: r.first_mismatch for r in compare.lossless(df, df).collect() if not r.passed} == {"peak_count": 0}


DOCUMENT = """<?xml version="1.0" encoding="utf-8"?>
<mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList count="3">
<spectrum index="0" id="controllerType=0 scan=19" defaultArrayLength="3">
 <cvParam cvRef="MS" accession="MS:1000511" name="ms level" value="2"/>
 <scanList count="1"><scan><cvParam accession="MS:1000016" name="scan start time" value="1.5" unitName="minute"/></scan></scanList>
 <precursorList count="1"><precursor><selectedIonList count="1"><selectedIon><cvParam accession="MS:1000744" name="selected ion m/z" value="445.25"/></selectedIon></selectedIonList></precursor></precursorList>
 <binaryDataArrayList count="2">
  <binaryDataArray><cvParam accession="MS:1000523" name="64-bit float"/><cvParam accession="MS:1000576" name="no compression"/><cvParam accession="MS:1000514" name="m/z array"/><binary>{mz}</binary></binaryDataArray>
  <binaryDataArray><cvParam accession="MS:1000521" name="32-bit float"/><cvParam accession="MS:1000576" name="no compression"/><cvParam accession="MS:1000515" name="intensity array"/><binary>{intensity}</binary></binaryDataArray>
 </binaryDataArrayList>
</spectrum>
<spectrum index="8" id="merged" defaultArrayLength="0"><cvParam accession="MS:1000511" name="ms level" value="1"/></spectrum>
</spectrumList></run></mzML>"""


def test_mzml_document(spark, tmp_path):
    mz, intensity = (base64.b64encode(np.array(v, t).tobytes()).decode() for v, t in (([300.0, 100.0, 300.0], "<f8"), ([1.0, 2.0, 3.0], "<f4")))
    (tmp_path / "a.mzML").write_text(DOCUMENT.format(mz=mz, intensity=intensity))
    found = [tuple(r) for r in read_mzml(spark, str(tmp_path / "a.mzML")).orderBy("scan_id").collect()]
    assert found == [(8, 0.0, 1, 0.0, [], []), (19, 90.0, 2, 445.25, [100.0, 300.0, 300.0], [2.0, 1.0, 3.0])]


def test_mzml_arrays_of_unequal_length_fail(spark, tmp_path):
    mz, intensity = (base64.b64encode(np.array(v, t).tobytes()).decode() for v, t in (([300.0], "<f8"), ([1.0, 2.0], "<f4")))
    (tmp_path / "a.mzML").write_text(DOCUMENT.format(mz=mz, intensity=intensity))
    with pytest.raises(Exception, match="differ in number"):
        read_mzml(spark, str(tmp_path / "a.mzML")).select(F.size("mz")).collect()


def packed(values, kind, squeeze=False):
    raw = np.array(values, kind).tobytes()
    return base64.b64encode(zlib.compress(raw) if squeeze else raw).decode()


def cv(*accessions):
    return "".join(f'<cvParam cvRef="MS" accession="MS:{a}" name="x" value="{v}"/>' for a, v in ((x if isinstance(x, tuple) else (x, "")) for x in accessions))


def refs(*names):
    return "".join(f'<referenceableParamGroupRef ref="{n}"/>' for n in names)


def data(params, binary, length=""):
    return f"<binaryDataArray{length}>{params}<binary>{binary}</binary></binaryDataArray>"


def document(folder, name, body, groups=None):
    listed = "".join(f'<referenceableParamGroup id="{i}">{params}</referenceableParamGroup>' for i, params in (groups or {}).items())
    head = f'<referenceableParamGroupList count="{len(groups)}">{listed}</referenceableParamGroupList>' if groups else ""
    (folder / name).write_text(f'<?xml version="1.0"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml">{head}<run><spectrumList>{body}</spectrumList></run></mzML>')


def element(scan, n, params, arrays, inner=""):
    return f'<spectrum index="{scan}" id="scan={scan}" defaultArrayLength="{n}">{params}{inner}<binaryDataArrayList count="2">{"".join(arrays)}</binaryDataArrayList></spectrum>\n'


def test_mzml_groups_belong_to_their_document_and_own_parameters_win(spark, tmp_path):
    mz, intensity = packed([1.5, 2.5], "<f8"), packed([5.0, 6.0], "<f4")
    plain = [data(refs("a"), mz), data(refs("b"), intensity)]
    time = '<scanList><scan><cvParam accession="MS:1000016" value="2" unitName="minute"/></scan></scanList>'
    in_group = "<scanList><scan>" + refs("t") + "</scan></scanList><precursorList><precursor><selectedIonList><selectedIon>" + refs("ion") + "</selectedIon></selectedIonList></precursor></precursorList>"
    first = {"a": cv("1000523", "1000576", "1000514"), "b": cv("1000521", "1000576", "1000515"), "lv": cv(("1000511", 2)), "t": '<cvParam accession="MS:1000016" value="7" unitName="second"/>', "ion": cv(("1000744", 333.5)), "empty": '<userParam name="u"/>'}
    document(tmp_path, "1.mzML", element(1, 2, refs("lv", "empty"), plain, in_group) + element(2, 2, cv(("1000511", 1)) + refs("lv"), plain, time), first)
    # the same ids with other meanings: arrays change places, the level is 1
    second = {"a": cv("1000521", "1000576", "1000515"), "b": cv("1000523", "1000576", "1000514"), "lv": cv(("1000511", 1))}
    arrays = [data(refs("a"), intensity), data(refs("b"), mz)]
    own = [data(cv("1000574") + refs("a"), packed([5.0, 6.0], "<f4", squeeze=True)), data(refs("b"), mz)]
    document(tmp_path, "2.mzML", element(3, 2, refs("lv"), arrays) + element(4, 2, refs("lv"), own), second)
    found = [tuple(r) for r in read_mzml(spark, str(tmp_path)).orderBy("scan_id").collect()]
    assert found == [(1, 7.0, 2, 333.5, [1.5, 2.5], [5.0, 6.0]), (2, 120.0, 1, 0.0, [1.5, 2.5], [5.0, 6.0]), (3, 0.0, 1, 0.0, [1.5, 2.5], [5.0, 6.0]), (4, 0.0, 1, 0.0, [1.5, 2.5], [5.0, 6.0])]
    document(tmp_path, "3.mzML", element(5, 2, refs("ion"), arrays), second)  # in the other document only
    with pytest.raises(Exception, match="no parameter group ion"):
        read_mzml(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize(("accession", "kind"), [("1000523", "<f8"), ("1000521", "<f4"), ("1000522", "<i8"), ("1000519", "<i4")])
def test_mzml_every_known_kind_of_array(spark, tmp_path, accession, kind, squeeze):
    params = cv(accession, "1000574" if squeeze else "1000576")
    arrays = [data(params + cv("1000514"), packed([5, 6, 7], kind, squeeze)), data(params + cv("1000515"), packed([3, 2, 1], kind, squeeze))]
    other = data(cv("1002312", "1000523", "1000516"), "!!", ' arrayLength="99"')  # a charge array, not read
    document(tmp_path, "k.mzML", element(9, 3, cv(("1000511", 1)), [*arrays, other]) + element(10, 0, "", []))
    assert [(r.scan_id, r.ms_level, r.mz, r.intensity) for r in read_mzml(spark, str(tmp_path)).orderBy("scan_id").collect()] == [(9, 1, [5.0, 6.0, 7.0], [3.0, 2.0, 1.0]), (10, 0, [], [])]


@pytest.mark.parametrize(
    ("params", "length", "message"),
    [
        (cv("1000523", "1002312"), 2, "not known: MS:1002312"),
        (cv("1000523", "1000574", "1002314"), 2, "not known: MS:1002314"),
        (cv("1000520", "1000576"), 2, "not known: MS:1000520"),
        (cv("1000576"), 2, "exactly one known type: MS:1000576"),
        (cv("1000523"), 2, "exactly one known compression: MS:1000523"),
        (cv("1000523", "1000521", "1000576"), 2, "exactly one known type"),
        (cv("1000523", "1000574", "1000576"), 2, "exactly one known compression"),
        (cv("1000523", "1000576"), 3, "declared length differ in number: 2 and 3"),
        (cv("1000521", "1000576"), 2, "declared length differ in number: 4 and 2"),
    ],
)
def test_mzml_never_guesses(spark, tmp_path, params, length, message):
    good = data(cv("1000523", "1000576", "1000515"), packed([1.0] * length, "<f8"))
    document(tmp_path, "x.mzML", element(1, length, "", [data(params + cv("1000514"), packed([1.0, 2.0], "<f8")), good]))
    with pytest.raises(Exception, match=message):
        read_mzml(spark, str(tmp_path)).collect()


def test_mzml_arrays_may_have_a_length_of_their_own_and_must_be_there(spark, tmp_path):
    arrays = [data(cv("1000523", "1000576", a), packed([1.0, 2.0], "<f8"), ' arrayLength="2"') for a in ("1000514", "1000515")]
    document(tmp_path, "x.mzML", element(1, 7, "", arrays))
    assert read_mzml(spark, str(tmp_path)).first().mz == [1.0, 2.0]
    document(tmp_path, "x.mzML", element(1, 2, "", arrays[:1]))
    with pytest.raises(Exception, match="differ in number: 0 and 2"):
        read_mzml(spark, str(tmp_path)).collect()


def test_mzml_documents_with_groups_round_trip(spark, tmp_path):
    rows = [(i, i, float(i), 1 + i % 4, float(i) if i % 4 else 0.0, [1.0 + k for k in range(i % 4)], [2.0] * (i % 4)) for i in range(40)]
    write_mzml(spectra(spark, rows).repartition(3), str(tmp_path / "m"), shared=True)
    found = [tuple(r) for r in read_mzml(spark, str(tmp_path / "m")).orderBy("scan_id").collect()]
    assert [(r[0], r[2], r[3], r[4], r[5]) for r in found] == [(r[1], r[3], r[4] if r[3] > 1 else 0.0, r[5], r[6]) for r in rows]


def test_header_scan_has_a_limit_and_names_unsupported_levels(spark, tmp_path):
    write_dump(spectra(spark), str(tmp_path / "d"), "ordinal")
    assert tuple(scan_headers(spark, str(tmp_path / "d"), 3).first()) == (3, 4, 2, 1)
    assert scan_headers(spark, str(tmp_path / "d")).first().spectra == 3
    with pytest.raises(Exception, match="more than 2 spectra"):
        scan_headers(spark, str(tmp_path / "d"), 2).collect()
    write_dump(spectra(spark, [(0, 1, 0.0, 3, 0.0, [], [])]), str(tmp_path / "e"), "ordinal")
    with pytest.raises(Exception, match="unsupported level"):
        scan_headers(spark, str(tmp_path / "e")).collect()


def test_intermediate_tables_of_a_finished_run_are_deleted(spark, tmp_path):
    other = fresh_folder(spark)
    spark.range(3).write.parquet(other)
    with scratch(spark) as folder:
        ranked = rank(spark.range(1000).selectExpr("id % 7 as v", "id"), "v", [], "place")
        assert list(Path(folder).glob("files-*"))
        ranked.write.parquet(str(tmp_path / "out"))
        with scratch(spark) as inner:
            rank(spark.range(10), "id", [], "place")
            assert Path(inner).parent == Path(folder) and Path(inner).exists()
        assert not Path(inner).exists() and Path(fresh_folder(spark)).parent == Path(folder)
    assert not Path(folder).exists() and Path(fresh_folder(spark)).parent == Path(other).parent
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.max("place")).first()[0] == 999
    assert spark.read.parquet(other).count() == 3  # what others wrote stays


def test_intermediate_tables_of_a_failed_run_are_deleted(spark):
    with pytest.raises(OverflowError, match="a test"), scratch(spark) as folder:
        rank(spark.range(10), "id", [], "place")
        raise OverflowError("a test")
    assert not Path(folder).exists() and Path(fresh_folder(spark)).parent == Path(folder).parent
    with scratch(spark) as unused:
        pass
    assert not Path(unused).exists()


def test_without_a_setting_a_single_machine_has_a_folder_and_a_cluster_an_error():
    conf = SimpleNamespace(get=lambda name, default: default)
    session = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master=master, applicationId="app-1"))
    one, two = Path(fresh_folder(session("local[2]"))), Path(fresh_folder(session("local[2]")))
    assert one != two and one.parent == two.parent and one.parent.is_dir()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        fresh_folder(session("spark://host:7077"))


def _skewed(spark):
    """Spectra of which some have a hundred times the peaks of others, and some one scan number."""
    rows = [(i, i // 2, float(i), 1 + i % 2, 5.0 * (i % 2), [1.0 + k for k in range(n)], [2.0] * n) for i in range(120) for n in [300 if 40 <= i < 60 else 3]]
    return spectra(spark, rows)


@pytest.mark.parametrize("shared", [False, True])
def test_mzml_documents_are_bounded_in_bytes(spark, tmp_path, monkeypatch, shared):
    """A document is read by one task, so it must not grow with the table, nor where spectra are large."""
    monkeypatch.setattr(mzml, "DOCUMENT", 20_000)
    write_mzml(_skewed(spark), str(tmp_path / "m"), shared)
    sizes = [f.stat().st_size for f in (tmp_path / "m").glob("part-*")]
    assert len(sizes) > 10 and max(sizes) <= 20_000 + 1300 + 22 * 300 + 2000  # a spectrum and a document's head more
    found = [(r.scan_id, r.rt_seconds, len(r.mz)) for r in read_mzml(spark, str(tmp_path / "m")).collect()]
    assert sorted(found) == sorted((r.scan_id, r.rt_seconds, len(r.mz)) for r in _skewed(spark).collect())


def test_mzml_groups_are_broadcast_or_joined(spark, tmp_path, monkeypatch):
    """Spectra are not shuffled to meet the few rows of groups; beyond a size both are joined, with the same rows."""
    write_mzml(_skewed(spark), str(tmp_path / "m"), shared=True, least=4)
    assert 4 <= len(list((tmp_path / "m").glob("part-*"))) <= 6
    broadcast = read_mzml(spark, str(tmp_path / "m"))
    assert "BroadcastHashJoin" in broadcast._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(mzml, "BROADCAST", 0)
    joined = read_mzml(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, broadcast.collect()), key=str)


def test_files_of_compared_dumps_do_not_grow_with_the_table(spark, sf_dir, tmp_path, monkeypatch):
    """A task writes a file: there are more of them, not larger ones; the checks stay the same."""
    usual = [tuple(r) for r in files.dump_comparison(spark, sf_dir).orderBy("check").collect()]
    monkeypatch.setattr(files, "FILE", 10_000)
    with scratch(spark) as folder:
        found = [tuple(r) for r in files.dump_comparison(spark, sf_dir).orderBy("check").collect()]
        dumps = [sizes for d in Path(folder).glob("files-*") if (sizes := [f.stat().st_size for f in d.glob("*.bin")])]
    counts = sorted(map(len, dumps))
    assert found == usual and len(counts) == 2 and counts[0] >= 9 and counts[1] > counts[0]
    assert max(map(max, dumps)) < 2 * 10_000


def _shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()) if (name := f.getName()).startswith("shuffle_")}


@pytest.mark.parametrize("shared", [False, True])
def test_writing_mzml_leaves_little_more_than_compressed_documents(spark, sf_dir, tmp_path, shared):
    """The text of an element takes some 1,300 bytes, hundreds of times its spectrum's; neither it nor what leads to it may fill the disk."""
    rows = files.nested(spark, sf_dir)
    with scratch(spark) as folder:
        Path(folder).mkdir()
        shuffles = _shuffle_files(spark)
        write_mzml(rows, str(tmp_path / "m"), shared)
        assert not list(Path(folder).iterdir())
        for _ in range(100):  # they are deleted behind the write, by another thread
            if not (left := _shuffle_files(spark) - shuffles):
                break
            time.sleep(0.1)
        assert not left
    assert sum(f.stat().st_size for f in (tmp_path / "m").glob("part-*")) < 200 * rows.count()


def test_documents_begin_among_spectra_of_one_scan_number(spark, tmp_path, monkeypatch):
    """Their texts stay bounded too, and every spectrum stands in one document."""
    monkeypatch.setattr(mzml, "DOCUMENT", 20_000)
    rows = [(i, 7 if 10 <= i < 110 else i, float(i), 1, 0.0, [1.0] * n, [2.0] * n) for i in range(120) for n in [i % 3]]
    write_mzml(spectra(spark, rows).repartition(5), str(tmp_path / "m"), compression="none")
    sizes = [f.stat().st_size for f in (tmp_path / "m").glob("part-*")]
    assert 7 <= len(sizes) <= 9 and max(sizes) <= 20_000 + 2 * 1300
    assert sorted((r.scan_id, r.rt_seconds, len(r.mz)) for r in read_mzml(spark, str(tmp_path / "m")).collect()) == sorted((r[1], r[2], len(r[5])) for r in rows)
    write_mzml(_skewed(spark), str(tmp_path / "s"), compression="none")
    assert max(f.stat().st_size for f in (tmp_path / "s").glob("part-*")) <= 20_000 + 1300 + 22 * 300 + 2000


def test_a_plan_runs_again_after_its_shuffles_are_dropped(spark):
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    with shuffles_dropped(spark):
        first = sorted(counts.collect())
        time.sleep(2)
        assert sorted(counts.collect()) == first
    assert sorted(counts.collect()) == first
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"  # as it was
