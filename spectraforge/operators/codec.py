"""Block rows: the spectra of a block as packed columns, encoded and decoded group by group.

A block row keeps statistics (counts, time bounds, a checksum) beside its sections, so a reader
can skip blocks by level or time without opening them. Written as Parquet it takes the place of a
file format of its own: rows are blocks, columns are sections, and Spark prunes both.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraforge.functions.bits import pack, unpack

BLOCKS = (
    "ms_level int, block_id long, spectra int, peaks int, rt_min float, rt_max float, ordinals binary, scan_ids binary, rt binary, precursors binary, counts binary, "
    "mz_firsts binary, mz_base binary, mz_width int, mz_packed binary, top_base long, top_width int, top_packed binary, low_bytes binary, crc long"
)
SPECTRA = "ordinal long, scan_id long, rt_seconds float, ms_level int, precursor_mz double, mz array<double>, intensity array<float>"
_SECTIONS = ("ordinals", "scan_ids", "rt", "precursors", "counts", "mz_firsts", "mz_base", "mz_packed", "top_packed", "low_bytes")


def _encode(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("ordinal")
    lists = rows.column("mz").combine_chunks()
    mz = lists.flatten().to_numpy().astype("<f8")
    intensity = rows.column("intensity").combine_chunks().flatten().to_numpy().astype("<f4").view("<u4")
    counts = np.diff(lists.offsets.to_numpy()).astype("<u4")
    if len(intensity) != len(mz):
        raise ValueError("masses and intensities differ in number")
    if len(mz) and (not np.isfinite(mz).all() or np.signbit(mz).any()):
        raise ValueError("a mass is not finite, negative or minus zero")
    pattern = mz.view("<u8")
    starts = np.cumsum(counts) - counts
    first = np.zeros(len(mz), dtype=bool)
    first[starts[counts > 0]] = True
    steps = np.diff(pattern, prepend=pattern[:1])[~first] if len(mz) else pattern
    if len(steps) and (mz[1:] < mz[:-1])[~first[1:]].any():
        raise ValueError("masses of a spectrum descend")
    mz_base, mz_width, mz_packed = pack(steps)
    top_base, top_width, top_packed = pack(intensity >> 24)
    rt = rows.column("rt_seconds").to_numpy().astype("<f4")
    known = rt[~np.isnan(rt)]
    block = {
        "ms_level": key[0].as_py(), "block_id": key[1].as_py(), "spectra": len(counts), "peaks": len(mz),
        "rt_min": float(known.min()) if len(known) else None, "rt_max": float(known.max()) if len(known) else None,
        "ordinals": rows.column("ordinal").to_numpy().astype("<i8").tobytes(), "scan_ids": rows.column("scan_id").to_numpy().astype("<i8").tobytes(),
        "rt": rt.tobytes(), "precursors": rows.column("precursor_mz").to_numpy().astype("<f8").tobytes(), "counts": counts.tobytes(),
        "mz_firsts": pattern[first].tobytes(), "mz_base": int(mz_base).to_bytes(8, "little"), "mz_width": mz_width, "mz_packed": mz_packed,
        "top_base": top_base, "top_width": top_width, "top_packed": top_packed, "low_bytes": (intensity & 0xFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes(),
    }
    block["crc"] = zlib.crc32(b"".join(block[s] for s in _SECTIONS))
    return pa.Table.from_pylist([block], schema=_ARROW)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.to_pylist():
            if zlib.crc32(b"".join(b[s] for s in _SECTIONS)) != b["crc"]:
                raise ValueError(f"block {b['block_id']} of level {b['ms_level']}: checksum differs")
            counts = np.frombuffer(b["counts"], "<u4").astype(np.int64)
            n, starts = int(counts.sum()), np.cumsum(counts) - counts
            first = np.zeros(n, dtype=bool)
            first[starts[counts > 0]] = True
            steps = np.zeros(n, dtype=np.uint64)
            steps[~first] = unpack(int.from_bytes(b["mz_base"], "little"), b["mz_width"], n - int(first.sum()), b["mz_packed"])
            sums = np.cumsum(steps, dtype=np.uint64)
            own = np.flatnonzero(first)
            pattern = sums - np.repeat(sums[own], counts[counts > 0]) + np.repeat(np.frombuffer(b["mz_firsts"], "<u8"), counts[counts > 0])
            low = np.zeros((n, 4), dtype=np.uint8)
            low[:, :3] = np.frombuffer(b["low_bytes"], np.uint8).reshape(n, 3)
            top = unpack(b["top_base"], b["top_width"], n, b["top_packed"]).astype(np.uint32)
            intensity = (low.view("<u4").ravel() | top << np.uint32(24)).view(np.float32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(b["ordinals"], "<i8")), pa.array(np.frombuffer(b["scan_ids"], "<i8")), pa.array(np.frombuffer(b["rt"], "<f4")),
                    pa.array(np.full(b["spectra"], b["ms_level"], dtype=np.int32)), pa.array(np.frombuffer(b["precursors"], "<f8")),
                    pa.ListArray.from_arrays(offsets, pa.array(pattern.view(np.float64))), pa.ListArray.from_arrays(offsets, pa.array(intensity)),
                ],
                names=["ordinal", "scan_id", "rt_seconds", "ms_level", "precursor_mz", "mz", "intensity"],
            )


_KINDS = {"int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "binary": pa.binary()}
_ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (column.strip().split(" ") for column in BLOCKS.split(","))])


def encode_blocks(spectra: DataFrame) -> DataFrame:
    """One row a block of spectra with ms_level, block_id and sorted peaks; a group is one block."""
    rows = spectra.select(F.col("ms_level").cast("int").alias("ms_level"), F.col("block_id").cast("long").alias("block_id"), "ordinal", "scan_id", "rt_seconds", "precursor_mz", "mz", "intensity")
    return rows.groupBy("ms_level", "block_id").applyInArrow(_encode, BLOCKS)


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """The spectra of block rows, exact to the bit."""
    return blocks.mapInArrow(_decode, SPECTRA)
