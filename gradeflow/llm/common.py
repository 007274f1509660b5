"""Shared pieces of the training-data operators: scratch tables, joins by a checked size, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words; every other byte belongs to a word.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only when its counted rows stay below this (ids of 8 bytes: 4 MB).
BROADCAST_ROWS = 500_000

#: Bytes of an Arrow batch.
BATCH_BYTES = 16 << 20

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where it is unset, a folder of our own on a local master, as in tests; elsewhere executors would each
    write to their own disk, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="gradeflow-"))
    return _own_dir[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gradeflow/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables of this application; results that still read them must be written first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/gradeflow/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if its counted rows are below ``limit``; otherwise unchanged, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows and at most ``BATCH_BYTES`` (or one row), since texts can be very long.

    The session's settings, so later jobs of the session have them too; every operator sets them before it runs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def word_count(text) -> F.Column:
    """Words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_fold(id_col, modulus: int) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the smallest node reachable, for every node but the roots themselves.

    Large-star and small-star steps (Kiveris et al., 2014). Minima are grouped with partial
    aggregation and joined back, so a node with very many edges isn't gathered in a task. Each
    round writes one table to the shared folder; the last is the one that leaves only stars.
    Null ends and loops are ignored; no edges, no rows.
    """
    kept = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        both = kept.union(kept.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = materialize(star.union(least).distinct(), "stars")
        # every edge leads down: when each node has one at most and no end has any, the ends are the smallest
        ends = kept.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(kept.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down = 1 and up = 1)").limit(1).count():
            return kept.select(F.col("u").alias("node"), F.col("v").alias("root"))
