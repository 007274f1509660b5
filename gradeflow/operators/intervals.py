"""Points in intervals by equal keys: nested cells of time, twice as long from level to level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the lowest level are numbered up to this far from 0; times beyond share the last one.
FAR = 1 << 40


def cell(time: F.Column, unit: float) -> F.Column:
    """Number of the lowest cell that holds a time."""
    return F.floor(F.greatest(F.lit(float(-FAR)), F.least(F.lit(float(FAR)), time / unit))).cast("long")


def cover(spans: DataFrame, start: str, end: str, unit: float) -> DataFrame:
    """``spans`` with (_level, _cell), a row for each of the fewest nested cells that make up the cells of an interval: at most two a level.

    At a level lie the whole cells within the interval; those that no cell of the next level holds are
    its first if it is a right half and its last if it is a left one.
    """
    low, high = cell(F.col(start), unit), cell(F.col(end), unit)
    rows = spans.filter(F.col(end) >= F.col(start)).withColumn("_low", low).withColumn("_high", high)
    rows = rows.withColumn("_level", F.explode(F.expr("sequence(0, cast(ceil(log2(_high - _low + 1)) as int))")))
    first = F.expr("-shiftright(-_low, _level)")  # rounded up
    last = F.expr("shiftright(_high + 1, _level) - 1")
    rows = rows.withColumn("_first", first).withColumn("_last", last).filter("_first <= _last")
    ends = F.array(F.when(F.expr("_first & 1 = 1"), F.col("_first")), F.when(F.expr("_last & 1 = 0"), F.col("_last")))
    return rows.withColumn("_cell", F.explode(F.array_distinct(F.filter(ends, lambda c: c.isNotNull())))).drop("_low", "_high", "_first", "_last")


def within(points: DataFrame, time: F.Column, spans: DataFrame, key: str, unit: float, start: str = "start", end: str = "end") -> DataFrame:
    """Each of ``points`` with each of ``spans`` of its ``key`` whose interval, ends included, holds its time.

    Columns of ``spans`` but the key and the interval's must have names of their own. A point is looked
    up once at each level that intervals use (64 at most), so an interval of any length is a few rows.
    Null times and ends meet nothing.
    """
    covered = cover(spans.withColumnRenamed(start, "_from").withColumnRenamed(end, "_to"), "_from", "_to", unit)
    levels = sorted(r[0] for r in covered.select("_level").distinct().collect())
    asked = points.withColumn("_time", time).filter("_time is not null").withColumn("_at", cell(F.col("_time"), unit))
    asked = asked.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_cell", F.expr("shiftright(_at, _level)"))
    return asked.join(covered, [key, "_level", "_cell"]).filter("_time between _from and _to").drop("_time", "_at", "_level", "_cell", "_from", "_to")
