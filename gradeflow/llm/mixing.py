"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations alone.

A source's target over its size is the copies that each of its documents should have. The whole
part is given to every document; for the fraction p, documents are ranked by
q = (u / (1 - u)) / (p / (1 - p)), u a hash of seed and id, and taken in that order until the words
still owed are reached. A document's own p may differ (``weight``), up to certain inclusion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small, word_count

#: Ranges of the order statistic by which words are summed before the last few are ranked one by one.
BINS = 4096
#: Sources are broadcast up to this many, joined by a shuffle beyond.
SOURCES = 100_000


def uniform(seed: str, *columns: str) -> F.Column:
    """A number in (0, 1) from 52 bits of md5, the same in any run and any SQL engine."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) for the sources of ``sizes`` (source, size).

    Sources by code point, null last, weigh ``weights``, repeating, and get ``share`` of all words.
    A target stops at ``most`` times its source's size; the excess goes to the others by weight.
    In order of size over weight the stopped sources come first, so the level at which the rest
    share follows from running sums; a source is stopped if its bound is not above the level that
    holds once all before it are stopped.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    rows = total.withColumn("w", w).withColumn("bound", most * F.col("source_size"))
    order = Window.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    owed = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    rest = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level", owed / rest).withColumn("open", F.col("bound") / F.col("w") > F.col("level"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("bound") / F.col("w"), F.col("level")))).over(everything)["level"]
    return rows.select("source", "source_size", F.when(F.col("open"), level * F.col("w")).otherwise(F.col("bound")).alias("target"))


def copies(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: str = "mix", weight: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of ``docs`` (doc_id, text, source).

    ``taken`` = copies * size words. A source's sum is within half the largest document of its
    target. Null text and empty text have size 0 and are never sampled; a null source is a source
    of its own; equal rows may be taken differently; ties in the order go by id, then size.
    ``weight``: a column of relative inclusion odds within a source (null and less than 0 as 0;
    default: all equal); documents whose chance would pass 1 are certain.
    """
    odds = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    rows = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), odds.alias("odds")).withColumn("u", uniform(seed, "doc_id", "size")), "sizes")
    scale = rows.groupBy("source").agg(F.sum("size").alias("all"), F.sum(F.col("size") * F.col("odds")).alias("weighed"))
    base = source_targets(rows, tuple(weights), share, most)
    base = base.join(scale.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    base = base.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("whole", F.floor("rate"))
    base = materialize(base.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("owed"), (F.col("rate") - F.col("whole")).alias("part"), F.when(F.col("weighed") > 0, F.col("all") / F.col("weighed")).otherwise(0.0).alias("scale")), "targets")
    few = small(base.withColumnRenamed("source", "s"), SOURCES)

    p = F.least(F.col("part") * F.col("odds") * F.col("scale"), F.lit(1.0))
    q = F.when(p >= 1, 0.0).when(p > 0, (F.col("u") / (1 - F.col("u"))) * ((1 - p) / p))
    # q / (1 + q) keeps the order and lies in [0, 1); for equal odds it is spread like u scaled by p
    order = F.coalesce(q / (1 + q), F.lit(1.0))
    ranked = rows.join(few, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("order", order).withColumn("bin", F.least(F.floor(F.col("order") * BINS), F.lit(BINS - 1)).cast("int"))
    sums = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("owed").alias("owed"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).filter("owed >= 0.5 and before <= owed and owed < before + words").select(F.col("source").alias("s"), F.col("bin").alias("cut"), "before")
    cut = small(materialize(cut, "cuts"), SOURCES)
    ranked = ranked.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # the crossing bin's documents are ranked one by one; one whose middle lies within the words owed is taken
    inside = Window.partitionBy("source").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = ranked.filter("bin = cut").withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("extra", (F.col("at") + F.col("size") / 2.0 <= F.col("owed")).cast("long"))
    far = ranked.filter("cut is null or bin <> cut").withColumn("at", F.lit(None).cast("long")).withColumn("extra", F.coalesce(F.col("bin") < F.col("cut"), F.col("owed") >= 0.5).cast("long"))
    return near.unionByName(far).withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0)).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, with its own columns; rows taken 0 times are left out.

    Copies are looked up by (doc_id, source, size); of repeated rows, each is taken as the first is. Columns
    of any name are kept; an empty table stays empty.
    """
    own = "_"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    key = ("doc_id", "source", "size")
    chosen = copies(docs, **options).groupBy(*key).agg(F.max("copies").alias("copies")).filter("copies > 0")
    chosen = small(materialize(chosen, "copies")).select(*[F.col(c).alias(own + c) for c in (*key, "copies")])
    same = F.col("doc_id").eqNullSafe(F.col(own + "doc_id")) & F.col("source").eqNullSafe(F.col(own + "source")) & (word_count(F.col("text")) == F.col(own + "size"))
    return docs.join(chosen, same).withColumn(own + "copies", F.explode(F.sequence(F.lit(1), F.col(own + "copies").cast("int")))).select(*docs.columns)


#: The op2 query in DuckDB's SQL.
MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 2.0::DOUBLE * source_size AS bound, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS k FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(bound) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
          / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM o),
t AS (
  SELECT source, source_size,
         CASE WHEN bound / w > level THEN w * (SELECT arg_min(level, k) FROM l WHERE bound / w > level) ELSE bound END AS target FROM l),
r AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0.0 END::BIGINT AS whole FROM t),
p AS (
  SELECT d.*, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS owed,
         (('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, '') || '|' || d.size::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
c AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM p)
SELECT doc_id, size, source_size, target,
       (CASE WHEN done + size / 2.0 <= owed THEN whole + 1 ELSE whole END * size)::BIGINT AS taken
FROM c
"""
