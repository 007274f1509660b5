"""Labels: ids of distinct ones, and sketches of how many there are that add up over days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import numbered


def label_map(rows: DataFrame, column: str, size: int = 1_000_000) -> DataFrame:
    """(label_id, label): the distinct values of a column, numbered from 0 in their order; nulls have none."""
    return numbered(rows.select(F.col(column).alias("label")).filter("label is not null").distinct(), ["label"], "label_id", size)


def with_label_ids(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``rows`` with ``label_id``; null where the label has none."""
    return rows.join(labels.withColumnRenamed("label", "_label"), F.col(column) == F.col("_label"), "left").drop("_label")


def label_sketches(rows: DataFrame, column: str, by: list[str], precision: int = 14) -> DataFrame:
    """(by, n, sketch): how many labels each group has, as a mergeable sketch of at most 2 ** precision bytes, to be kept in a table."""
    return rows.groupBy(*by).agg(F.count(column).alias("n"), F.hll_sketch_agg(F.col(column), F.lit(precision)).alias("sketch"))


def distinct_estimates(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, labels): sketches merged over coarser groups; the estimate is off by some 1 / sqrt(2 ** precision) of the count, exact for few labels."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*by, "n", F.hll_sketch_estimate("sketch").alias("labels"))
