"""The exact greedy cut of spectra into blocks.

A block is full when it has ``size`` spectra, or when the next spectrum would take it over ``max_peaks`` peaks; so
where a block ends only depends on where it starts. Rows are dealt to ranges of neighbouring ranks. The effect of a
range is a short table: for each of its first ``size`` rows, taken as the start of a block, the row of the next range
that starts a block, and the number of blocks between; it comes from doubling the steps from start to next start.
The tables (``size`` pairs a range) of ``group`` neighbouring ranges compose to one, and so on in a tree until one is
left a level. Back down the tree every group tells its members where they start, and every range numbers its rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spectraforge.sources.shared import materialise

from .ordering import rank

RANGE = 1 << 16
#: Tables that are composed in one task.
GROUP = 256

_TABLE = "ms_level int, range long, exits array<int>, blocks array<long>"
_KEYS = ["ms_level", "range"]


def _ends(n_peaks: np.ndarray, size: int, max_peaks: int) -> np.ndarray:
    """For every row taken as the start of a block, the row after the block's last."""
    if len(n_peaks) and n_peaks.max() > max_peaks:
        raise ValueError(f"a spectrum has more than the {max_peaks} peaks of a block")
    upto = np.concatenate([[0], np.cumsum(n_peaks)])
    by_peaks = np.searchsorted(upto, upto[:-1] + max_peaks, side="right") - 1
    return np.minimum(by_peaks, np.arange(len(n_peaks)) + size)


def _doubled(ends: np.ndarray, own: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Steps of 1, 2, 4, ... blocks from every row, which end at rows from ``own`` on, and the blocks until there."""
    step, blocks = np.arange(len(ends) + 1), np.zeros(len(ends) + 1, np.int64)
    step[:own], blocks[:own] = ends[:own], 1
    powers = [step]
    while (step[:own] < own).any():
        blocks, step = blocks + blocks[step], step[step]
        powers.append(step)
    return powers, blocks


def _starts(powers: list[np.ndarray], entry: int, own: int) -> np.ndarray:
    """The rows before ``own`` that start a block, if ``entry`` starts one."""
    reached = np.array([entry])
    for power in powers:
        reached = np.concatenate([reached, power[reached]])
    return np.unique(reached[reached < own])


def cut_blocks(spectra: DataFrame, size: int, max_peaks: int) -> DataFrame:
    """Adds ``level_index`` (rank in the level) and ``block_id`` like :func:`greedy_blocks`; if no ``size`` spectra can reach the peak limit, ranks alone tell it."""
    ranked = rank(spectra, "ordinal", ["ms_level"], "level_index")
    most, last = ranked.agg(F.max("n_peaks"), F.max("level_index")).first()
    if (most or 0) * size > max_peaks:
        return _cut(ranked, last, size, max_peaks, RANGE, GROUP)
    return ranked.withColumn("block_id", F.floor(F.col("level_index") / size).cast("long"))


def greedy_blocks(spectra: DataFrame, size: int, max_peaks: int, width: int = RANGE, group: int = GROUP) -> DataFrame:
    """Adds ``level_index`` and ``block_id`` (from 0 in each level) to rows with ordinal, ms_level and n_peaks; a spectrum over the limit is an error."""
    if width < size:
        raise ValueError("a range must hold a block")
    ranked = rank(spectra, "ordinal", ["ms_level"], "level_index")
    return _cut(ranked, ranked.agg(F.max("level_index")).first()[0], size, max_peaks, width, group)


def _cut(ranked: DataFrame, last: int | None, size: int, max_peaks: int, width: int, group: int) -> DataFrame:
    own = ranked.withColumn("range", F.floor(F.col("level_index") / width).cast("long"))
    ahead = own.where((F.col("level_index") % width < size) & (F.col("range") > 0)).withColumn("range", F.col("range") - 1)
    ranged = own.unionByName(ahead)

    def table(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("level_index")
        n = int((rows["level_index"] // width == key[1]).sum())
        powers, blocks = _doubled(_ends(rows["n_peaks"].to_numpy(), size, max_peaks), n)
        entry = np.arange(size)
        inside = np.minimum(entry, len(rows))
        exits = np.where(entry < n, powers[-1][inside], entry) - n
        return pd.DataFrame({"ms_level": [key[0]], "range": [key[1]], "exits": [exits], "blocks": [np.where(entry < n, blocks[inside], 0)]})

    slim = ranged.select(*_KEYS, "level_index", "n_peaks")
    tree = [materialise(slim.groupBy(*_KEYS).applyInPandas(table, _TABLE))]
    ranges = (last or 0) // width + 1
    while ranges > 1:
        ranges = -(-ranges // group)
        tree.append(materialise(_grouped(tree[-1], group).groupBy("ms_level", "group").applyInPandas(_composed, _TABLE)))
    entries = tree[-1].select(*_KEYS, F.lit(0).alias("entry"), F.lit(0).cast("long").alias("first"))
    for members in reversed(tree[:-1]):
        above = entries.select("ms_level", F.col("range").alias("group"), "entry", "first")
        entries = _grouped(members, group).join(above, ["ms_level", "group"]).groupBy("ms_level", "group").applyInPandas(_entered, "ms_level int, range long, entry int, first long")

    def numbered(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("level_index")
        n = int((rows["level_index"].to_numpy() // width == key[1].as_py()).sum())
        powers, _ = _doubled(_ends(rows["n_peaks"].to_numpy(), size, max_peaks), n)
        starts = _starts(powers, rows["entry"][0].as_py(), n)
        ids = rows["first"][0].as_py() - 1 + np.searchsorted(starts, np.arange(n), side="right")
        return rows.slice(0, n).select(names).append_column("block_id", pa.array(ids, pa.int64()))

    names = ranked.columns
    wanted = StructType([*ranked.schema, StructField("block_id", LongType())])
    return ranged.join(entries, _KEYS).groupBy(*_KEYS).applyInArrow(numbered, wanted)


def _grouped(tables: DataFrame, group: int) -> DataFrame:
    return tables.withColumn("group", F.floor(F.col("range") / group).cast("long"))


def _composed(key: tuple, tables: pd.DataFrame) -> pd.DataFrame:
    """One table of neighbouring ones: every entry followed through all of them at once."""
    tables = tables.sort_values("range")
    at, blocks = np.arange(len(tables["exits"].iloc[0])), 0
    for exits, more in zip(tables["exits"], tables["blocks"]):
        at, blocks = exits[at], blocks + more[at]
    return pd.DataFrame({"ms_level": [key[0]], "range": [key[1]], "exits": [at], "blocks": [blocks]})


def _entered(key: tuple, tables: pd.DataFrame) -> pd.DataFrame:
    """Where each table of a group is entered, and the number of its first block."""
    tables = tables.sort_values("range")
    entry, first, found = int(tables["entry"].iloc[0]), int(tables["first"].iloc[0]), []
    for exits, blocks in zip(tables["exits"], tables["blocks"]):
        found.append((entry, first))
        entry, first = int(exits[entry]), first + int(blocks[entry])
    return pd.DataFrame({"ms_level": key[0], "range": tables["range"], "entry": [f[0] for f in found], "first": [f[1] for f in found]})
