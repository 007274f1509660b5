"""Long groups in an order, cut into ranges that fit a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def by_length(rows: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups of at most ``most`` rows, those of longer ones if there are any). Null keys are a group."""
    counts = rows.groupBy(F.col(key).alias("_key")).count()
    long = written(counts.filter(F.col("count") > most).select("_key"), "long-groups")
    if long.isEmpty():
        return rows, None
    same = F.col(key).eqNullSafe(F.col("_key"))
    return rows.join(long, same, "left_anti"), rows.join(long, same, "left_semi")


def in_ranges(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """Written ``rows`` with ``_range``: a number that rises with (key, order), of about ``size`` rows each."""
    parts = -(-rows.count() // size)
    return written(rows.repartitionByRange(max(parts, 1), key, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def like(rows: pd.DataFrame, columns: list[str], n: int, /, **more) -> pd.DataFrame:
    """n rows with ``columns`` of a group's first row, and others."""
    first = {c: np.array([rows[c].iloc[0]] * n, object) for c in columns}
    return pd.DataFrame(first | more)


def numbered(rows: DataFrame, order: list[str], name: str, size: int) -> DataFrame:
    """``rows`` with their place in an order from 0: the place in a range of about ``size`` rows, after the sizes of the ranges before."""
    parts = max(-(-rows.count() // size), 1)
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").count().orderBy("_range").collect()  # a row a range
    before, starts = 0, []
    for r in sizes:
        starts.append((r["_range"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(starts, "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_before")
    return dealt.join(F.broadcast(starts), "_range").select(place.alias(name), *rows.columns)
