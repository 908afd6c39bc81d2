"""mzML documents as spectra, through Spark's XML reader.

One row a ``spectrum`` element. Its fields are found by the accession numbers of the public controlled vocabulary, among
its own parameters and then among those of the parameter groups it refers to. Groups belong to their document: a second
scan collects them, and they are joined to the spectra by file path. A spectrum without peaks has empty arrays; one
without level gets level 0, without time 0 seconds.

Arrays are floats or integers of 32 or 64 bits, plain or deflated. Nothing is guessed: an array of masses or intensities
without exactly one known type and one known compression, with a parameter that is neither, or of another length than the
document declares is an error, and so is a reference to a group that the document does not have. Other arrays are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType

from spectraforge.functions import ingest
from spectraforge.operators.ordering import running_total
from spectraforge.sources.shared import materialise, scratch, shuffles_dropped

#: Bytes of text of a document that :func:`write_mzml` makes, about, and of a spectrum and a peak in it (deflated peaks take less).
DOCUMENT, SPECTRUM_BYTES, PEAK_BYTES = 32 << 20, 1300, 22
#: Bytes of the parameter groups of all documents up to which they are broadcast, else joined.
BROADCAST = 32 << 20

# Accession numbers of the vocabulary.
MS_LEVEL, START_TIME, SELECTED_MZ = "MS:1000511", "MS:1000016", "MS:1000744"
MZ_ARRAY, INTENSITY_ARRAY = "MS:1000514", "MS:1000515"
FLOAT_64, FLOAT_32, INTEGER_64, INTEGER_32, ZLIB, PLAIN = "MS:1000523", "MS:1000521", "MS:1000522", "MS:1000519", "MS:1000574", "MS:1000576"

#: Numpy's names of the types of arrays.
TYPES = {FLOAT_64: "<f8", FLOAT_32: "<f4", INTEGER_64: "<i8", INTEGER_32: "<i4"}
COMPRESSIONS = (PLAIN, ZLIB)

_PARAM = "array<struct<_accession:string,_name:string,_value:string,_unitName:string>>"
_PARAMS = f"cvParam:{_PARAM},referenceableParamGroupRef:array<struct<_ref:string>>"
SCHEMA = f"""_id string, _index bigint, _defaultArrayLength bigint, {_PARAMS.replace("cvParam:", "cvParam ").replace("Ref:", "Ref ")},
scanList struct<scan:array<struct<{_PARAMS}>>>,
precursorList struct<precursor:array<struct<selectedIonList:struct<selectedIon:array<struct<{_PARAMS}>>>>>>,
binaryDataArrayList struct<binaryDataArray:array<struct<_arrayLength:bigint,{_PARAMS},binary:string>>>"""
GROUP_SCHEMA = f"_id string, cvParam {_PARAM}"


@F.arrow_udf(ArrayType(DoubleType()))
def decoded(packed: pa.Array, kind: pa.Array, compression: pa.Array, declared: pa.Array) -> pa.Array:
    """Little-endian numbers of the type and compression with these accessions; null counts as none. The declared length, if any, must be theirs."""
    found = []
    for raw, accession, squeezed, n in zip(packed.to_pylist(), kind.to_pylist(), compression.to_pylist(), declared.to_pylist()):
        raw = zlib.decompress(raw) if raw and squeezed == ZLIB else raw or b""
        numbers = np.frombuffer(raw, TYPES[accession]) if accession else np.zeros(0)
        if n is not None and n != len(numbers):
            raise ValueError(f"the values of an array and its declared length differ in number: {len(numbers)} and {n}")
        found.append(numbers.astype(np.float64))
    offsets = np.cumsum([0] + [len(v) for v in found], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*found, np.zeros(0)])))


@F.arrow_udf(BinaryType())
def encoded(values: pa.Array) -> pa.Array:
    """Deflated little-endian doubles."""
    flat, ends = values.flatten().to_numpy(zero_copy_only=False).astype("<f8"), np.cumsum(values.value_lengths().to_numpy(), dtype=np.int64)
    return pa.array([zlib.compress(part.tobytes()) for part in np.split(flat, ends[:-1])] if len(values) else [], pa.binary())


class _Params:
    """Parameters of an element: its own, then those of the groups it refers to."""

    def __init__(self, element: Column | None, groups: Column):
        cell = (lambda name: F.col(name)) if element is None else (lambda name: element[name])
        lost = lambda r: F.raise_error(F.concat(F.lit("no parameter group "), F.coalesce(r["_ref"], F.lit("without id"))))
        found = lambda r: F.coalesce(F.try_element_at(groups, r["_ref"]), lost(r))
        nothing = F.array().cast(_PARAM)
        self.own = F.coalesce(cell("cvParam"), nothing)
        self.shared = F.coalesce(F.flatten(F.transform(cell("referenceableParamGroupRef"), found)), nothing)

    def first(self, accession: str) -> Column:
        return F.try_element_at(F.filter(F.concat(self.own, self.shared), lambda p: p["_accession"] == accession), F.lit(1))

    def has(self, accession: str) -> Column:
        return F.exists(F.concat(self.own, self.shared), lambda p: p["_accession"] == accession)

    def accessions(self) -> tuple[Column, Column]:
        """Those of the own parameters, and those of the groups."""
        return tuple(F.transform(params, lambda p: F.coalesce(p["_accession"], F.lit("?"))) for params in (self.own, self.shared))


def _one_of(own: Column, shared: Column, known: tuple[str, ...], what: str) -> Column:
    """The accession among these, of the own ones if one is there; an error if there is not exactly one."""
    among = lambda accessions: F.array_distinct(F.filter(accessions, lambda a: a.isin(*known)))
    found = F.when(F.exists(own, lambda a: a.isin(*known)), among(own)).otherwise(among(shared))
    odd = F.raise_error(F.concat(F.lit(f"an array without exactly one known {what}: "), F.array_join(F.concat(own, shared), ", ")))
    return F.when(F.size(found) == 1, F.element_at(found, 1)).otherwise(odd)


def _with_array(rows: DataFrame, name: str, accession: str) -> DataFrame:
    """Adds the numbers of the first array of a kind; step by step, so that nothing is looked up twice."""
    groups, one, own, shared = F.col("groups"), F.col(f"{name}_one"), F.col(f"{name}_own"), F.col(f"{name}_shared")
    arrays = F.col("binaryDataArrayList.binaryDataArray")
    rows = rows.withColumn(f"{name}_one", F.try_element_at(F.filter(arrays, lambda a: _Params(a, groups).has(accession)), F.lit(1)))
    rows = rows.withColumns(dict(zip((f"{name}_own", f"{name}_shared"), _Params(one, groups).accessions())))
    odd = F.filter(F.concat(own, shared), lambda a: ~a.isin(*TYPES, *COMPRESSIONS, accession))
    checked = F.when(F.size(odd) > 0, F.raise_error(F.concat(F.lit("an array with parameters that are not known: "), F.array_join(odd, ", ")))).otherwise(_one_of(own, shared, tuple(TYPES), "type"))
    kinds = {f"{name}_type": F.when(one.isNotNull(), checked), f"{name}_compression": F.when(one.isNotNull(), _one_of(own, shared, COMPRESSIONS, "compression"))}
    packed, declared = F.unbase64(F.regexp_replace(one["binary"], r"\s", "")), F.coalesce(one["_arrayLength"], F.col("_defaultArrayLength"))
    return rows.withColumns(kinds).withColumn(name, decoded(packed, F.col(f"{name}_type"), F.col(f"{name}_compression"), declared))


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST").schema(schema).load(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file"))


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """scan_id, rt_seconds, ms_level, precursor_mz, mz, intensity; peaks sorted by mass, equal masses in file order."""
    group = F.struct("_id", F.coalesce("cvParam", F.array().cast(_PARAM)))
    shared = materialise(_xml(spark, path, "referenceableParamGroup", GROUP_SCHEMA).groupBy("file").agg(F.map_from_entries(F.collect_list(group)).alias("groups")))
    size = shared.agg(F.sum(F.length("file") + F.length(F.to_json("groups")))).first()[0] or 0
    raw = _xml(spark, path, "spectrum", SCHEMA).join(F.broadcast(shared) if size <= BROADCAST else shared, "file", "left")
    groups = F.col("groups")
    time = _Params(F.try_element_at(F.col("scanList.scan"), F.lit(1)), groups).first(START_TIME)
    level = F.coalesce(_Params(None, groups).first(MS_LEVEL)["_value"].cast("tinyint"), F.lit(0).cast("tinyint"))
    ions = F.try_element_at(F.col("precursorList.precursor"), F.lit(1))["selectedIonList"]["selectedIon"]
    selected = _Params(F.try_element_at(ions, F.lit(1)), groups).first(SELECTED_MZ)["_value"]
    flat = _with_array(_with_array(raw, "m", MZ_ARRAY), "i", INTENSITY_ARRAY).select(
        ingest.scan_id(F.col("_id"), F.col("_index")).alias("scan_id"),
        ingest.rt_seconds(time["_value"].cast("double"), time["_unitName"]).cast("float").alias("rt_seconds"),
        level.alias("ms_level"),
        ingest.precursor(level, F.array(selected.cast("double"))).alias("precursor_mz"),
        "m",
        "i",
    )
    peaks = flat.withColumn("p", ingest.sorted_peaks(F.col("m"), F.col("i")))
    return peaks.select("scan_id", "rt_seconds", "ms_level", "precursor_mz", F.col("p.mz").alias("mz"), F.col("p.intensity").cast("array<float>").alias("intensity"))


def _cv(accession: str, name: str, value: Column | None = None, unit: str | Column | None = None) -> Column:
    unit = F.lit(unit) if unit is None or isinstance(unit, str) else unit
    text = F.lit("") if value is None else value.cast("string")
    return F.struct(F.lit(accession).alias("_accession"), F.lit(name).alias("_name"), text.alias("_value"), unit.cast("string").alias("_unitName"))


def _data(values: str, accession: str, name: str) -> Column:
    params = F.array(_cv(FLOAT_64, "64-bit float"), _cv(ZLIB, "zlib compression"), _cv(accession, name))
    return F.struct(params.alias("cvParam"), _packed(values).alias("binary"))


def _packed(values: str) -> Column:
    return F.regexp_replace(F.base64(encoded(F.col(values).cast("array<double>"))), r"\s", "")


def _element(level: list[Column], arrays: list[Column]) -> list[Column]:
    """The parts of a ``spectrum`` element; those of its level and its arrays are given."""
    rt, first_level = F.col("rt_seconds").cast("double"), F.col("ms_level") == 1
    time = _cv(START_TIME, "scan start time", F.when(first_level, rt / 60).otherwise(rt), F.when(first_level, "minute").otherwise("second"))
    ion = F.struct(F.array(_cv(SELECTED_MZ, "selected ion m/z", F.col("precursor_mz"))).alias("cvParam"))
    precursor = F.struct(F.struct(F.array(ion).alias("selectedIon")).alias("selectedIonList"))
    return [
        F.concat(F.lit("scan="), F.col("scan_id")).alias("_id"),
        F.size("mz").alias("_defaultArrayLength"),
        *level,
        F.struct(F.array(F.struct(F.array(time).alias("cvParam"))).alias("scan")).alias("scanList"),
        F.when(F.col("ms_level") > 1, F.struct(F.array(precursor).alias("precursor"))).alias("precursorList"),
        F.struct(F.array(*arrays).alias("binaryDataArray")).alias("binaryDataArrayList"),
    ]


def write_mzml(df: DataFrame, path: str, shared: bool = False, least: int = 1, compression: str = "gzip") -> None:
    """One ``spectrum`` element a row, one document a range of scan numbers, into a new folder; arrays must be equally long.

    A document takes about ``DOCUMENT`` bytes of text whatever the number and sizes of spectra, as Spark reads one in one task;
    small tables give about ``least`` documents. The text repeats itself, so documents are compressed (``none``: they are not).
    Level 1 gives its time in minutes, other levels in seconds. Peaks stay in
    the order they have. With ``shared``, levels and kinds of arrays stand in parameter groups of the document, whose ids mean
    other groups in the next document.
    """
    with scratch(df.sparkSession), shuffles_dropped(df.sparkSession):
        ordered = _documented(df, least)
        if not shared:
            level = F.array(_cv(MS_LEVEL, "ms level", F.col("ms_level"))).alias("cvParam")
            elements = ordered.select(*_element([level], [_data("mz", MZ_ARRAY, "m/z array"), _data("intensity", INTENSITY_ARRAY, "intensity array")]))
            elements.write.format("xml").option("rootTag", "spectrumList").option("rowTag", "spectrum").option("compression", compression).save(path)
            return
        ref = lambda number: F.array(F.struct(_group_id(number, F.spark_partition_id()).alias("_ref"))).alias("referenceableParamGroupRef")
        grouped = F.col("ms_level").isin(1, 2)
        level = [F.when(~grouped, F.array(_cv(MS_LEVEL, "ms level", F.col("ms_level")))).alias("cvParam"), F.when(grouped, ref(F.col("ms_level") - 1)).alias("referenceableParamGroupRef")]
        arrays = [F.struct(ref(F.lit(n)), _packed(values).alias("binary")) for n, values in ((2, "mz"), (3, "intensity"))]
        elements = ordered.select(F.to_xml(F.struct(*_element(level, arrays)), {"rowTag": "spectrum"}).alias("value"))
        elements.mapInArrow(_documents, "value string").write.option("compression", compression).text(path)


def _documented(df: DataFrame, least: int) -> DataFrame:
    """Rows in the order of their scan numbers, a partition a document: cut by the running sum of their bytes, so that no region of large spectra makes a larger one.

    Whole rows are written once and shuffled once; the running sum takes their numbers only, and the driver the first row of each document.
    """
    rows = materialise(df.withColumn("__id", F.monotonically_increasing_id()))
    scan = F.coalesce(F.col("scan_id").cast("long"), F.lit(np.iinfo(np.int64).min))
    numbers = rows.select(scan.alias("__scan"), "__id", F.coalesce(F.size("mz"), F.lit(0)).alias("__peaks"))
    with scratch(df.sparkSession):
        placed = running_total(numbers, F.lit(SPECTRUM_BYTES).cast("long") + F.lit(PEAK_BYTES) * F.col("__peaks"), "__scan", [], "__before", ("__id",))
        last = placed.agg(F.max("__before")).first()[0] or 0
        size = max(1, min(DOCUMENT, -(-(last + 1) // least)))
        firsts = placed.groupBy(F.floor(F.col("__before") / size)).agg(F.min(F.struct("__scan", "__id")).alias("first"))
        starts = sorted(tuple(r.first) for r in firsts.collect()) or [(0, 0)]
    document = _document(starts)(scan, F.col("__id"))
    return rows.withColumn("__document", document).drop("__id").repartitionById(len(starts), F.col("__document")).sortWithinPartitions("scan_id")


def _document(starts: list[tuple[int, int]]):
    """Number of the document that holds a row, by its scan number and id and those of the documents' first rows."""
    scans, ids = np.array(starts, np.int64).T

    @F.arrow_udf(IntegerType())
    def place(scan: pa.Array, row: pa.Array) -> pa.Array:
        scan, row = scan.to_numpy(), row.to_numpy()
        begun, upto = (np.searchsorted(scans, scan, side) for side in ("left", "right"))
        for k in np.unique(begun[upto > begun]):  # documents begin among the rows of this scan number: the id decides
            here = (begun == k) & (upto > begun)
            begun[here] += np.searchsorted(ids[k : upto[here][0]], row[here], "right")
        return pa.array(begun - 1, pa.int32())

    return place


# The parameters of the groups that write_mzml makes.
_GROUPS = (
    ((MS_LEVEL, "ms level", "1"),),
    ((MS_LEVEL, "ms level", "2"),),
    ((FLOAT_64, "64-bit float", ""), (ZLIB, "zlib compression", ""), (MZ_ARRAY, "m/z array", "")),
    ((FLOAT_64, "64-bit float", ""), (ZLIB, "zlib compression", ""), (INTENSITY_ARRAY, "intensity array", "")),
)


def _group_id(number: Column, document: Column) -> Column:
    return F.concat(F.lit("group"), (number + document) % len(_GROUPS))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements of a task between the head and the end of a document; no elements, no document."""
    line = lambda text: pa.RecordBatch.from_arrays([pa.array([text])], names=["value"])
    begun = False
    for b in batches:
        if b.num_rows and not begun:
            begun, document = True, TaskContext.get().partitionId()
            param = lambda p: f'<cvParam cvRef="MS" accession="{p[0]}" name="{p[1]}" value="{p[2]}"/>'
            groups = "".join(f'<referenceableParamGroup id="group{(n + document) % len(_GROUPS)}">{"".join(map(param, g))}</referenceableParamGroup>' for n, g in enumerate(_GROUPS))
            yield line(f'<?xml version="1.0" encoding="utf-8"?><mzML><referenceableParamGroupList count="{len(_GROUPS)}">{groups}</referenceableParamGroupList><run><spectrumList>')
        yield b
    if begun:
        yield line("</spectrumList></run></mzML>")
