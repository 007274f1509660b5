"""Exact top-k by inner product with vector-approximation files.

Every component is quantised to a cell of its dimension's range; the approximation file is a table of
its own with one byte a component. Blocks of queries scan it for bounds of the scores: the cells give
an upper bound, and a lower one that is below it by the same slack for all vectors of a query. A
vector whose upper bound is below the k-th lower bound is out; for the others alone exact vectors are
fetched by row, and the k best scores are certain. The few vectors with the largest components, which
would widen every cell, stay out of the file and are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path, small, small_batches
from .negatives import Best

#: Share of the vectors, by their largest component, that the approximation file holds.
NEAR = 0.999

#: Cells of a dimension, queries sent to tasks at once, bounds that a task holds at a time, candidates it holds before it drops those that are out.
CELLS, QUERIES, BOUNDS, PENDING = 256, 8192, 4_000_000, 2_000_000


def scaled(vectors: DataFrame, scale: float = 1024.0) -> DataFrame:
    """(vec_id, ints) with floor(scale * x) of each component; vectors that are null, empty or hold null or non-finite components are left out.

    Integers that no long holds stop at the largest one.
    """
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    return vectors.filter(x.isNotNull() & (F.size(x) > 0) & F.col("vec_id").isNotNull()).filter(~F.coalesce(bad, F.lit(True))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("ints"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


@dataclass
class Grid:
    """Lowest integer and width of the cells of each dimension."""

    lo: np.ndarray
    width: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame) -> Grid:
        """From the smallest and largest integer of each dimension: a row a task, then one for each dimension."""

        def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lo = hi = None
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column(0), len(batch.column(0)[0]))
                    lo, hi = (x.min(0), x.max(0)) if lo is None else (np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0)))
            if lo is not None:
                yield pa.RecordBatch.from_arrays([pa.array([lo.tolist()], pa.list_(pa.int64())), pa.array([hi.tolist()], pa.list_(pa.int64()))], names=["lo", "hi"])

        parts = rows.select("ints").mapInArrow(extremes, "lo array<long>, hi array<long>").select(F.posexplode(F.arrays_zip("lo", "hi")).alias("at", "x"))
        found = parts.groupBy("at").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi")).orderBy("at").collect()
        return cls(np.array([r["lo"] for r in found], np.int64), np.array([(r["hi"] - r["lo"]) // CELLS + 1 for r in found], np.uint64))

    def cells(self, ints: np.ndarray) -> np.ndarray:
        """A byte a component; differences are taken without sign, so that the widest range fits."""
        return ((ints.view(np.uint64) - self.lo.view(np.uint64)) // self.width).astype(np.uint8)


def approximations(rows: DataFrame, grid: Grid) -> DataFrame:
    """The written approximation file: row, vec_id, cells (a byte a component)."""
    kinds = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("cells", pa.binary())])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = grid.cells(np.ascontiguousarray(matrix(batch.column(2), len(grid.lo)), np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in code], pa.binary())], schema=kinds)

    return materialize(rows.select("row", "vec_id", "ints").mapInArrow(cells, "row long, vec_id long, cells binary"), "cells")


class Scan:
    """Candidates of a block of queries among the vectors that one task sees."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, grid: Grid, k: int):
        self.ids, self.k = ids, k
        q, lo, width = queries.astype(np.float64), grid.lo.astype(np.float64), grid.width.astype(np.float64)
        # score <= sum of q * lowest value of the cell + what positive q gain over the cell's width
        self.weight, spread = (q * width).T, np.abs(q) * (width - 1)
        self.base = (q * lo).sum(1) + np.where(q > 0, spread, 0).sum(1)
        # sums of doubles are off by less than this
        size = (np.abs(q) * (np.abs(lo) + CELLS * width)).sum(1)
        self.error = size * (4 + 2 * q.shape[1]) * 2.0**-52
        self.slack = spread.sum(1) + 2 * self.error
        self.top = np.full((k, len(ids)), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, row: np.ndarray, vec: np.ndarray, cells: np.ndarray) -> None:
        step = max(self.k, BOUNDS // max(len(self.ids), 1))
        for s in range(0, len(row), step):
            upper = cells[s : s + step].astype(np.float64) @ self.weight + self.base
            at = np.minimum(np.searchsorted(self.ids, vec[s : s + step]), len(self.ids) - 1)
            own = np.flatnonzero(self.ids[at] == vec[s : s + step])
            upper[own, at[own]] = -np.inf
            both = np.concatenate([self.top, np.partition(upper, -self.k, 0)[-self.k :] if len(upper) > self.k else upper])
            self.top = np.partition(both, -self.k, 0)[-self.k :]
            i, j = np.nonzero((upper >= self.top.min(0) - self.slack) & (upper > -np.inf))
            self.held.append((j, row[s : s + step][i], upper[i, j]))
            self.n += len(i)
            if self.n > PENDING:
                self.prune()

    def prune(self) -> None:
        j, row, upper = (np.concatenate(x) for x in zip(*self.held, strict=True))
        kept = upper >= (self.top.min(0) - self.slack)[j]
        self.held, self.n = [(j[kept], row[kept], upper[kept])], int(kept.sum())

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.prune()
            j, row, upper = self.held[0]
            for s in range(0, len(j), 100_000):
                q, r, u = j[s : s + 100_000], row[s : s + 100_000], upper[s : s + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(r), pa.array(u + self.error[q]), pa.array(u + self.error[q] - self.slack[q])], names=["query_id", "row", "upper", "lower"])


def query_blocks(asked: DataFrame, dims: int) -> Iterator[Broadcast]:
    """Broadcast (ids, vectors) of blocks of queries; only one is on the driver and in the tasks at a time."""
    blocks = -(-asked.count() // QUERIES)
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").toArrow()
        if part.num_rows:
            sent = asked.sparkSession.sparkContext.broadcast((part.column(0).to_numpy(), matrix(part.column(1).combine_chunks(), dims)))
            yield sent
            sent.destroy()


def candidates(table: DataFrame, asked: DataFrame, grid: Grid, k: int) -> DataFrame:
    """Written table (query_id, row, upper, lower) of the rows that the bounds leave, block of queries by block."""
    spark, path, dims = table.sparkSession, scratch_path(table.sparkSession, "candidates"), len(grid.lo)
    kinds = "query_id long, row long, upper double, lower double"
    spark.createDataFrame([], kinds).write.parquet(path)
    for sent in query_blocks(asked, dims):

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            state = Scan(*sent.value, grid, k)
            for batch in batches:
                if batch.num_rows:
                    cells = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, dims)
                    state.add(batch.column(0).to_numpy(), batch.column(1).to_numpy(), cells)
            yield from state.rows()

        table.mapInArrow(scan, kinds).write.mode("append").parquet(path)
    found = spark.read.schema(kinds).parquet(path)
    # each task knew its own rows alone: the k-th lower bound of all tasks leaves fewer
    order = Window.partitionBy("query_id").orderBy(F.desc("lower"), "row")
    bar = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).filter(F.col("n") == k).select("query_id", F.col("lower").alias("bar"))
    return materialize(found.join(small(materialize(bar, "bars")), "query_id", "left").filter("bar is null or upper >= bar").drop("bar"), "kept-candidates")


def best_of_far(far: DataFrame, asked: DataFrame, dims: int, k: int) -> DataFrame:
    """Written (query_id, vec_id, score): of the rows outside the file, those that may be among a query's k best, by exact scores, k a task at most."""
    spark, path = far.sparkSession, scratch_path(far.sparkSession, "far")
    kinds = "query_id long, vec_id long, score long"
    spark.createDataFrame([], kinds).write.parquet(path)
    for sent in query_blocks(asked, dims):

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, queries = sent.value
            best, step = Best(len(ids), k), max(1, BOUNDS // len(ids))
            for batch in batches:
                for s in range(0, batch.num_rows, step):
                    part = batch.slice(s, step)
                    vec = part.column(1).to_numpy()
                    best.add(matrix(part.column(2), dims) @ queries.T, vec[:, None] != ids, vec, part.column(0).to_numpy())
            of, score, vec, _ = best.held
            yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

        far.select("row", "vec_id", "ints").mapInArrow(scan, kinds).write.mode("append").parquet(path)
    return spark.read.schema(kinds).parquet(path)


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products with the other rows.

    ``vectors``: vec_id, embedding (other columns are ignored). ``is_query``: a condition on vec_id.
    Ties go to the smaller vec_id; fewer rows than k give all. Only vectors of equal length meet. A
    repeated query id is asked once, with its smallest vector; repeated other rows stay candidates
    of their own. Vectors without a usable form (see ``scaled``) or id take no part; an empty table
    gives no rows. Scores are exact as long as a long holds them, whatever the size of the
    components; beyond it they wrap around.
    """
    spark = vectors.sparkSession
    small_batches(spark, 8192)
    largest = F.array_max(F.transform("ints", lambda v: F.abs(v.cast("double"))))
    rows = materialize(scaled(vectors, scale).withColumn("row", F.monotonically_increasing_id()).withColumn("largest", largest), "ints")
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for (dims,) in rows.select(F.size("ints").alias("d")).distinct().orderBy("d").collect():
        same = rows.filter(F.size("ints") == dims)
        asked = materialize(same.filter(is_query).groupBy("vec_id").agg(F.min("ints").alias("ints")), "queries")
        bar = same.agg(F.approx_percentile("largest", F.lit(NEAR), F.lit(10_000))).first()[0]
        far, same = same.filter(F.col("largest") > bar), same.filter(F.col("largest") <= bar)
        if not far.isEmpty():
            found = found.union(best_of_far(far, asked, dims, k))
        grid = Grid.of(same)
        met = candidates(approximations(same, grid), asked, grid, k)
        exact = met.select("query_id", "row").join(asked.select(F.col("vec_id").alias("query_id"), F.col("ints").alias("q")), "query_id")
        found = found.union(scores(same.select("row", "vec_id", "ints").join(small(materialize(exact, "asked-rows"), 4_000_000 // (dims + 2)), "row"), dims))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def scores(pairs: DataFrame, dims: int) -> DataFrame:
    """(query_id, vec_id, score) of pairs (query_id, vec_id, q, ints); sums of longs that wrap around are right wherever the score fits."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, v = matrix(batch.column(2), dims), matrix(batch.column(3), dims)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((q * v).sum(1), pa.int64())], names=["query_id", "vec_id", "score"])

    return pairs.select("query_id", "vec_id", "q", "ints").mapInArrow(multiply, "query_id long, vec_id long, score long")


#: The op3 query in DuckDB's SQL.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.ints, c.ints)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.ints) = len(q.ints) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
