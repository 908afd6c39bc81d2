"""Column functions that bring scan numbers, times, precursors and peaks into one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scan_id(identifier: Column, index: Column) -> Column:
    """The number behind ``scan=``, else the index; an error if both are missing."""
    number = F.regexp_extract(identifier, r"scan=(\d+)", 1)
    found = F.coalesce(F.when(number != "", number.try_cast("bigint")), index)
    return F.when(found.isNull(), F.raise_error(F.lit("neither a scan number nor an index"))).otherwise(found)


def rt_seconds(value: Column, unit: Column) -> Column:
    """Seconds; minutes are converted, a missing time is 0."""
    return F.coalesce(F.when(F.lower(unit).isin("minute", "minutes", "min"), value * 60).otherwise(value), F.lit(0.0))


def precursor(ms_level: Column, selected: Column) -> Column:
    """The first selected mass of a spectrum above level 1, else 0."""
    return F.when(ms_level > 1, F.coalesce(F.try_element_at(selected, F.lit(1)), F.lit(0.0))).otherwise(F.lit(0.0))


def sorted_peaks(mz: Column, intensity: Column) -> Column:
    """Array of (mz, pos, intensity) sorted by mass, equal masses by position; arrays must be equally long."""
    zipped = F.arrays_zip(mz.alias("mz"), F.sequence(F.lit(0), F.size(mz) - 1).alias("pos"), intensity.alias("intensity"))
    agreed = F.when(F.size(mz) == 0, F.slice(zipped, 1, 0)).otherwise(F.array_sort(zipped))
    return F.when(F.size(mz) != F.size(intensity), F.raise_error(F.lit("masses and intensities differ in number"))).otherwise(agreed)
