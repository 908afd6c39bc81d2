"""Flat binary dumps of spectra as a Spark data source: ``spark.read.format("spectrumdump")``.

A dump is a folder of ``.bin`` files (or one such file); the sink writes one a partition. Records have no marks to
start from, so a file may have an index beside it (``.idx``: places of records some ``SPLIT`` bytes apart). Reading
makes one task a range of an indexed file, or one a file without an index, and goes through it in windows of bounded
size. The sink writes indexes; :func:`index_dump` makes them for other dumps. An index of another file size is not used.
A row carries the ``part`` (file name) and ``position`` it came from; rows sort into written order by both,
if the frame was range-partitioned and sorted before it was written once (``mode("overwrite")``).

Views (option ``view``): ``spectra``; ``headers``, which seeks past the peaks and returns the metadata with the byte
``offset`` of each record; ``bits``, in which all floats are their bit patterns as whole numbers, as Spark has but one NaN.
:func:`read_records` reads the records of chosen rows of ``headers`` and no others.

Filters: of the condition given to :func:`read_dump` as ``where``, comparisons of part, position, ordinal, scan_id, ms_level and
n_peaks are tested on the headers, and the peaks of records that fail are skipped unread; parts and ranges without any
such position or ordinal are not opened. Spark keeps what is pushed into a Python source with the frame that was loaded, for
all queries made from it, so conditions set on a frame later must not be pushed: two of them on one frame would mix.

Other options: ``ordinals=true`` adds ``ordinal``, the place in the whole dump, from the record counts in the indexes
(which all files must have); ``level=1`` (or 2) skips the peaks of other levels unread; ``max_spectra=N`` stops a file
with an error beyond N spectra. Truncated records and padding that is not zero are errors; an empty file has no
spectra. Null metadata, null arrays (unlike empty ones) and arrays of unequal length cannot be written.

Paths may be URIs of any file system that pyarrow opens; a path without a scheme must lie on a shared mount.
"""

from __future__ import annotations

import operator
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from spectraforge.functions.numeric import supported_level

# Fixed values of the format: a little-endian header of 28 bytes, then the masses and the intensities.
HEADER = np.dtype({
    "names": ["scan_id", "rt_seconds", "ms_level", "pad_a", "precursor_mz", "n_peaks", "pad_b"],
    "formats": ["<u4", "<f4", "u1", "V3", "<f8", "<u4", "V4"],
    "offsets": [0, 4, 8, 9, 12, 20, 24],
    "itemsize": 28,
})
MZ, INTENSITY, WORD = np.dtype("<f8"), np.dtype("<f4"), np.dtype("<u4")
PEAK = MZ.itemsize + INTENSITY.itemsize
#: All parts of a record are whole words of four bytes: so many of the header, a mass, a peak.
HEAD_WORDS, MZ_WORDS, PEAK_WORDS = 7, 2, 3

METADATA = "part string, position bigint, scan_id bigint, rt_seconds float, ms_level tinyint, precursor_mz double, n_peaks bigint"
PEAKS = "mz array<double>, intensity array<float>"
VIEWS = {
    "spectra": f"{METADATA}, {PEAKS}",
    "headers": f"{METADATA}, offset bigint",
    "bits": "part string, position bigint, scan_id bigint, rt_bits bigint, ms_level tinyint, precursor_bits bigint, n_peaks bigint, mz_bits array<bigint>, intensity_bits array<int>",
}

#: Bytes of a window, at most (a larger record is a window of its own), and of the first and those behind skipped peaks.
WINDOW, FIRST_WINDOW = 4 << 20, 1 << 12
#: Chosen records at most so many bytes apart are read together.
GAP = 1 << 16
#: Bytes between two entries of an index, at least.
SPLIT = 64 << 20
_INDEX = np.dtype([("offset", "<i8"), ("position", "<i8")])

_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_FILTERED = ("position", "ordinal", "scan_id", "ms_level", "n_peaks")


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _opened(system: fs.FileSystem, path: str) -> pa.NativeFile:
    return system.open_input_file(path)


@dataclass
class _File(InputPartition):
    """Records of a file from byte ``start`` to ``stop``: the first has number ``position``, the next range's first ``end`` (None: unknown).

    ``base`` is the ordinal of the file's first record.
    """

    path: str
    start: int
    stop: int
    position: int
    end: int | None = None
    base: int = 0


@dataclass
class _Written(WriterCommitMessage):
    temporary: str | None
    final: str
    index: bytes


class _Index:
    """Collects the entries of an index: a first record, the others at least ``split`` bytes apart, and the file's end."""

    def __init__(self, split: int):
        self.split, self.entries, self.offset, self.position = split, [(0, 0)], 0, 0

    def add(self, lengths: np.ndarray) -> None:
        """Records of these lengths follow."""
        ends = self.offset + np.cumsum(lengths, dtype=np.int64)
        begins = ends - lengths
        while (at := int(np.searchsorted(begins, self.entries[-1][0] + self.split))) < len(begins):
            self.entries.append((int(begins[at]), self.position + at))
        if len(ends):
            self.offset, self.position = int(ends[-1]), self.position + len(ends)

    def bytes(self) -> bytes:
        return np.array([*self.entries, (self.offset, self.position)], _INDEX).tobytes()


@dataclass
class _Records:
    """Records that lie in a window: its words, the first word of each, and their headers, numbers and byte offsets."""

    words: np.ndarray
    first: np.ndarray
    heads: np.ndarray
    positions: np.ndarray
    offsets: np.ndarray

    def where(self, kept: np.ndarray) -> _Records:
        return _Records(self.words, self.first[kept], self.heads[kept], self.positions[kept], self.offsets[kept])

    def _spread(self, skipped: int, width: int) -> np.ndarray:
        """The words of all records' arrays that begin ``skipped`` words a peak behind the headers, ``width`` words a peak."""
        n = self.heads["n_peaks"].astype(np.int64)
        begin = self.first + HEAD_WORDS + skipped * n
        before = width * (np.cumsum(n) - n)
        return self.words[np.repeat(begin - before, width * n) + np.arange(width * n.sum())]

    def column(self, name: str, part: str, base: int) -> pa.Array:
        if name == "part":
            return pa.repeat(part, len(self.first))
        if name in ("mz", "mz_bits", "intensity", "intensity_bits"):
            values = self._spread(0, MZ_WORDS) if name.startswith("mz") else self._spread(MZ_WORDS, PEAK_WORDS - MZ_WORDS)
            kind = {"mz": "<f8", "mz_bits": "<i8", "intensity": "<f4", "intensity_bits": "<i4"}[name]
            ends = np.cumsum(self.heads["n_peaks"], dtype=np.int64)
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values.view(kind)))
        if name in ("rt_bits", "precursor_bits"):
            source, kind = ("rt_seconds", "<u4") if name == "rt_bits" else ("precursor_mz", "<i8")
            return pa.array(np.ascontiguousarray(self.heads[source]).view(kind).astype(np.int64))
        return pa.array(self.whole(name, base) if name in ("position", "offset", "ordinal") else np.ascontiguousarray(self.heads[name])).cast(_KINDS[name])

    def whole(self, name: str, base: int) -> np.ndarray:
        """The values of a column that filters can name."""
        own = {"position": self.positions, "offset": self.offsets, "ordinal": self.positions + base}
        return own[name] if name in own else self.heads[name].astype(np.int64)


_KINDS = {"position": pa.int64(), "offset": pa.int64(), "ordinal": pa.int64(), "scan_id": pa.int64(), "rt_seconds": pa.float32(), "ms_level": pa.int8(), "precursor_mz": pa.float64(), "n_peaks": pa.int64()}


def _parsed(window: bytes, at: list[int], offset: int, position: int, path: str) -> _Records:
    """Records at byte places of a window that lies at ``offset`` of its file; the last may have its header only."""
    words = np.frombuffer(window, WORD, len(window) // WORD.itemsize)
    first = np.array(at, np.int64) // WORD.itemsize
    heads = words[first[:, None] + np.arange(HEAD_WORDS)]
    if (heads[:, 2] >> 8).any() or heads[:, 6].any():
        raise ValueError(f"padding that is not zero in {path}")
    return _Records(words, first, heads.view(HEADER)[:, 0], position + np.arange(len(first)), offset + np.array(at, np.int64))


def _windows(file: pa.NativeFile, part: _File, wanted) -> Iterator[_Records]:
    """The records of a range for which ``wanted`` is true, in windows; peaks of others are skipped where that saves reading.

    ``wanted`` maps records (whose last may lack its peaks) to a mask; None keeps all records and no peaks.
    """
    offset, position, size, needed = part.start, part.position, FIRST_WINDOW, 0
    while offset < part.stop:
        window = file.read_at(min(max(size, needed), part.stop - offset), offset)
        at, end = [], 0
        while end + HEADER.itemsize <= len(window):
            at.append(end)
            end += HEADER.itemsize + PEAK * int.from_bytes(window[end + 20 : end + 24], "little")
        if offset + end > part.stop or not at or (offset + len(window) == part.stop and end < len(window)):
            raise ValueError(f"truncated record in {part.path}")
        records = _parsed(window, at, offset, position, part.path)
        kept = np.ones(len(at), bool) if wanted is None else wanted(records)
        position += len(at)
        if end > len(window) and wanted is not None and kept[-1]:  # the last record is read again from its start
            needed, end, kept[-1] = end - at[-1], at[-1], False
            position -= 1
        elif end > 2 * len(window):  # much was skipped
            size, needed = FIRST_WINDOW, 0
        elif needed <= size:
            size, needed = min(2 * size, WINDOW), 0
        else:
            needed = 0
        yield records.where(kept)
        offset += end


def _ranges(system: fs.FileSystem, path: str, size: int, indexed: bool) -> list[_File]:
    if indexed:
        with system.open_input_file(path + ".idx") as f:
            entries = np.frombuffer(f.read(), _INDEX)
        if len(entries) > 1 and entries["offset"][-1] == size:
            offsets, positions = entries["offset"].tolist(), entries["position"].tolist()
            return [_File(path, *r) for r in zip(offsets, offsets[1:], positions, positions[1:])]
    return [_File(path, 0, size, 0)]


def _files(path: str) -> tuple[fs.FileSystem, list[tuple[str, int, bool]]]:
    """Path, size and whether there is an index, of each file of a dump."""
    system, path = _located(path)
    if (single := system.get_file_info(path)).type == fs.FileType.File:
        return system, [(path, single.size, system.get_file_info(path + ".idx").type == fs.FileType.File)]
    listed = [f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file]
    names = {f.path for f in listed}
    return system, sorted((f.path, f.size, f.path + ".idx" in names) for f in listed if f.path.endswith(".bin"))


class _DumpReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.view = options["path"], options.get("view", "spectra")
        self.limit = int(options["max_spectra"]) if "max_spectra" in options else None
        self.ordinals = options.get("ordinals", "false").lower() == "true"
        self.filters: list[tuple] = [("ms_level", operator.eq, int(options["level"]))] if "level" in options else []
        self.wanted = pa.schema([(f.name, _arrow_type(f.dataType.simpleString())) for f in schema.fields])

    def partitions(self) -> list[InputPartition]:
        system, files = _files(self.path)
        found, base = [], 0
        for f in files:
            ranges = _ranges(system, *f)
            if self.ordinals:
                if ranges[-1].end is None and f[1]:
                    raise ValueError(f"ordinals need an index of {f[0]}; index_dump makes it")
                for r in ranges:
                    r.base = base
                base += ranges[-1].end or 0
            found += [r for r in ranges if self._may_hold(r)]
        return found

    def _may_hold(self, r: _File) -> bool:
        """Whether no filter on part, position or ordinal excludes the whole range."""
        for name, test, value in self.filters:
            if name == "part" and not test(posixpath.basename(r.path), value):
                return False
            if name in ("position", "ordinal") and r.end is not None:
                first, last = (r.position + (r.base if name == "ordinal" else 0), r.end - 1 + (r.base if name == "ordinal" else 0))
                inside = any(first <= v <= last for v in value) if test is _among else first <= value <= last if test is operator.eq else test(first, value) or test(last, value)
                if not inside:
                    return False
        return True

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _File):  # a dump without files has one empty task
            return
        system, _ = _located(self.path)
        tests = [f for f in self.filters if f[0] in _FILTERED]

        def passed(records: _Records) -> np.ndarray:
            if self.limit is not None and records.positions[-1] >= self.limit:
                raise ValueError(f"more than {self.limit} spectra in {partition.path}")
            kept = np.ones(len(records.first), bool)
            for name, test, value in tests:
                kept &= test(records.whole(name, partition.base), value)
            return kept

        with _opened(system, partition.path) as file:
            for records in _windows(file, partition, None if self.view == "headers" else passed):
                if self.view == "headers":
                    records = records.where(passed(records))
                if len(records.first):
                    yield _batch(records, self.wanted, posixpath.basename(partition.path), partition.base)


class _FilteringReader(_DumpReader):
    """Spark calls ``pushFilters`` only if its setting is on, and refuses readers that have it if not."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name in (*_FILTERED, "part") and getattr(f, "value", None) is not None:
                if type(f) in _COMPARED:
                    self.filters.append((name, _COMPARED[type(f)], f.value))
                elif isinstance(f, In):
                    self.filters.append((name, _among, tuple(v for v in f.value if v is not None)))
            yield f  # Spark tests the rows that are left again


def _among(value: np.ndarray | str, values: tuple) -> np.ndarray | bool:
    return value in values if isinstance(value, str) else np.isin(value, values)


def _batch(records: _Records, wanted: pa.Schema, part: str, base: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([records.column(f.name, part, base) for f in wanted], schema=wanted)


def _arrow_type(name: str) -> pa.DataType:
    plain = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "float": pa.float32(), "tinyint": pa.int8(), "double": pa.float64()}
    return pa.list_(plain[name[6:-1]]) if name.startswith("array<") else plain[name]


def _put(system: fs.FileSystem, path: str, data: bytes) -> None:
    with system.open_output_stream(path) as sink:
        sink.write(data)


class _DumpWriter(DataSourceArrowWriter):
    """Tasks write below a temporary folder; only what the driver commits is moved into place, so retried and
    speculative attempts leave nothing, and a failed job leaves the old files as they were."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.split = int(options.get("split_bytes", SPLIT))

    def _temporary(self, path: str) -> str:
        return posixpath.join(path, f"_temporary-{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, path = _located(self.path)
        folder = self._temporary(path)
        final = f"part-{TaskContext.get().partitionId():06d}-{self.job[:8]}.bin"
        temporary, sink, index = posixpath.join(folder, uuid.uuid4().hex), None, _Index(self.split)
        try:
            for batch in iterator:
                if sink is None:
                    system.create_dir(folder, recursive=True)
                    sink = system.open_output_stream(temporary)
                data, lengths = _records(batch)
                sink.write(data)
                index.add(lengths)
        finally:
            if sink is not None:
                sink.close()
        return _Written(temporary if sink is not None else None, final, index.bytes())

    def commit(self, messages: list[_Written | None]) -> None:
        system, path = _located(self.path)
        system.create_dir(path, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.path.endswith((".bin", ".bin.idx"))]
        for m in messages:
            if m is not None and m.temporary is not None:
                _put(system, posixpath.join(path, m.final) + ".idx", m.index)
                system.move(m.temporary, posixpath.join(path, m.final))
        if self.overwrite:
            for f in old:
                system.delete_file(f)
        self._clear(system, path)

    def abort(self, messages: list[_Written | None]) -> None:
        system, path = _located(self.path)
        self._clear(system, path)

    def _clear(self, system: fs.FileSystem, path: str) -> None:
        if system.get_file_info(self._temporary(path)).type == fs.FileType.Directory:
            system.delete_dir(self._temporary(path))


def _records(batch: pa.RecordBatch) -> tuple[memoryview, np.ndarray]:
    """The bytes of a batch's records, and the length of each."""
    names = ["scan_id", "rt_seconds", "ms_level", "precursor_mz"]
    if any(batch.column(n).null_count for n in [*names, "mz", "intensity"]):
        raise ValueError("a dump has no place for nulls")
    scan_ids = batch.column("scan_id").to_numpy()
    if len(scan_ids) and (scan_ids.min() < 0 or scan_ids.max() > np.iinfo(np.uint32).max):
        raise ValueError("a scan number does not fit 32 bits")
    heads = np.zeros(batch.num_rows, HEADER)
    for n in names:
        heads[n] = batch.column(n).to_numpy(zero_copy_only=False)
    mz, intensity = batch.column("mz"), batch.column("intensity")
    heads["n_peaks"] = mz.value_lengths().to_numpy()
    if not mz.value_lengths().equals(intensity.value_lengths()):
        raise ValueError("masses and intensities differ in number")
    if mz.flatten().null_count or intensity.flatten().null_count:
        raise ValueError("a dump has no place for nulls")
    n = heads["n_peaks"].astype(np.int64)
    sizes = HEAD_WORDS + PEAK_WORDS * n
    first = np.cumsum(sizes) - sizes
    words = np.empty(sizes.sum(), WORD)
    words[first[:, None] + np.arange(HEAD_WORDS)] = heads.view(WORD).reshape(-1, HEAD_WORDS)
    before = np.cumsum(n) - n
    for values, kind, skipped, width in ((mz, MZ, 0, MZ_WORDS), (intensity, INTENSITY, MZ_WORDS, PEAK_WORDS - MZ_WORDS)):
        at = np.repeat(first + HEAD_WORDS + skipped * n - width * before, width * n) + np.arange(width * n.sum())
        words[at] = np.ascontiguousarray(values.flatten().to_numpy().astype(kind, copy=False)).view(WORD)
    return words.data, sizes * WORD.itemsize


class SpectrumDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spectrumdump"

    def schema(self) -> str:
        columns = VIEWS[self.options.get("view", "spectra")]
        return f"ordinal bigint, {columns}" if self.options.get("ordinals", "false").lower() == "true" else columns

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_FilteringReader if self.options.get("filters") == "true" else _DumpReader)(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _DumpWriter(dict(self.options), overwrite)


def read_dump(spark: SparkSession, path: str, where: Column | str | None = None, **options: str) -> DataFrame:
    """The spectra of a dump, or those for which ``where`` is true; the peaks of records that its header conditions exclude are not read."""
    spark.dataSource.register(SpectrumDump)
    source = spark.read.format("spectrumdump").options(**options)
    if where is None:
        return source.load(path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    # no later condition passes one that depends on the rows' order, so the source is given this condition only
    return source.option("filters", "true").load(path).where(where).where(F.monotonically_increasing_id() >= 0)


def read_records(spark: SparkSession, path: str, chosen: DataFrame) -> DataFrame:
    """The spectra (as in the view of that name) of chosen rows of the view ``headers``: part, position, offset and n_peaks.

    Rows are dealt to tasks by ranges of part and offset, so a file of any size is read by many. Each task reads exactly
    the bytes of its records, neighbouring ones together. A row read twice is returned twice; a record that is not as the
    row says is an error.
    """
    rows = chosen.select("part", "position", "offset", "n_peaks").repartitionByRange("part", "offset").sortWithinPartitions("part", "offset")
    return rows.mapInArrow(partial(_read_chosen, path), VIEWS["spectra"])


def _read_chosen(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wanted = pa.schema([(name, _arrow_type(kind)) for name, kind in (c.split(" ") for c in VIEWS["spectra"].split(", "))])
    system, folder = _located(path)
    single = system.get_file_info(folder).type == fs.FileType.File
    for b in batches:
        parts = b.column("part").to_pylist()
        rows = {c: b.column(c).to_numpy() for c in ("position", "offset", "n_peaks")}
        for first, last in _runs(parts, rows["offset"], rows["n_peaks"]):
            file = folder if single else posixpath.join(folder, parts[first])
            yield _batch(_chosen(system, file, {c: v[first:last] for c, v in rows.items()}), wanted, parts[first], 0)


def _runs(parts: list[str], offsets: np.ndarray, n_peaks: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last rows of records to read together: of one part, with small gaps, in a window."""
    ends = offsets + HEADER.itemsize + PEAK * n_peaks
    first = 0
    for i in range(1, len(parts) + 1):
        if i == len(parts) or parts[i] != parts[first] or offsets[i] > ends[i - 1] + GAP or ends[i] - offsets[first] > WINDOW:
            yield first, i
            first = i


def _chosen(system: fs.FileSystem, path: str, rows: dict[str, np.ndarray]) -> _Records:
    offset = int(rows["offset"][0])
    length = int((rows["offset"] + HEADER.itemsize + PEAK * rows["n_peaks"]).max()) - offset
    with _opened(system, path) as file:
        window = file.read_at(length, offset)
    if len(window) != length or (rows["offset"] % WORD.itemsize).any():
        raise ValueError(f"no record in {path} at the offset of a chosen row")
    records = _parsed(window, (rows["offset"] - offset).tolist(), offset, 0, path)
    if (records.heads["n_peaks"] != rows["n_peaks"]).any():
        raise ValueError(f"a record in {path} differs from the chosen row")
    records.positions = rows["position"]
    return records


def scan_headers(spark: SparkSession, path: str, max_spectra: int | None = None) -> DataFrame:
    """One row from the headers alone: spectra, peaks, ms1, ms2; an error beyond ``max_spectra``, or for levels but 1 and 2."""
    options = {} if max_spectra is None else {"max_spectra": str(max_spectra)}
    n, odd = F.count(F.lit(1)), F.count_if(~supported_level(F.col("ms_level")))
    totals = read_dump(spark, path, view="headers", **options).agg(
        n.alias("spectra"), F.coalesce(F.sum("n_peaks"), F.lit(0)).alias("peaks"), F.count_if(F.col("ms_level") == 1).alias("ms1"), F.count_if(F.col("ms_level") == 2).alias("ms2"), odd.alias("odd")
    )
    too_many = F.lit(False) if max_spectra is None else F.col("spectra") > max_spectra
    checked = F.when(too_many, F.raise_error(F.lit(f"more than {max_spectra} spectra"))).when(F.col("odd") > 0, F.raise_error(F.lit("unsupported level"))).otherwise(F.col("spectra"))
    return totals.select(checked.alias("spectra"), "peaks", "ms1", "ms2")


def index_dump(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> None:
    """Write an index beside each file of a dump, a task a file that reads headers only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _located(path)
        for b in batches:
            done = []
            for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                index = _Index(split_bytes)
                with _opened(system, name) as file:
                    for records in _windows(file, _File(name, 0, size, 0), None):
                        index.add(HEADER.itemsize + PEAK * records.heads["n_peaks"].astype(np.int64))
                _put(system, name + ".idx", index.bytes())
                done.append(len(index.entries))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.int64())], names=["path", "ranges"])

    _, files = _files(path)
    rows = spark.createDataFrame([(name, size) for name, size, _ in files], "path string, size long")
    rows.repartition(max(1, len(files))).mapInArrow(run, "path string, ranges long").write.format("noop").mode("overwrite").save()


def write_dump(df: DataFrame, path: str, order: str, split_bytes: int = SPLIT, files: int | None = None) -> None:
    """Write spectra in the order of a column, one file a range of it, with indexes; takes the place of an older dump.

    ``files`` sets the number of ranges, which else is Spark's number of shuffle partitions.
    """
    df.sparkSession.dataSource.register(SpectrumDump)
    ordered = (df.repartitionByRange(files, order) if files else df.repartitionByRange(order)).sortWithinPartitions(order)
    rows = ordered.select("scan_id", "rt_seconds", "ms_level", "precursor_mz", "mz", "intensity")
    rows.write.format("spectrumdump").option("split_bytes", str(split_bytes)).mode("overwrite").save(path)
