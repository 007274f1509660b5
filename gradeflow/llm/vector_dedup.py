"""Near-duplicate vectors by spherical-cap filters.

Filter directions are the words of a random product code: the space is cut into blocks, each with a
few random unit directions, and a filter is one direction of every block. A vector is list-decoded
to all filters whose inner product with it reaches a bound: block by block, partial words that
can't reach it any more are dropped. Vectors of a label that share a filter are compared exactly.

The bound and the code's size follow from the number of vectors, so that a filter is shared by
chance by few; a pair is counted at the smallest filter that both have. Equal vectors are one row.
A filter with very many vectors is cut into chunks, and pairs of chunks are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, small_batches
from .shingles import spanning

#: Filters a vector has on average and at least, vectors that share one by chance, most directions of a block.
PER_VECTOR, LEAST, BY_CHANCE, WORDS = 24.0, 12, 0.25, 1024
#: Vectors in a chunk of a filter, entries that a task compares.
CHUNK, CELL = 1024, 20_000
SEED = 20_240_601


def cap_bound(share: float, dims: int) -> float:
    """The inner product that a random direction reaches with a unit vector in the given share of cases."""
    x = np.linspace(-1, 1, 200_001)
    density = (1 - x * x) ** max((dims - 3) / 2, 0)
    tail = np.cumsum(density[::-1])[::-1] / density.sum()
    return float(x[np.searchsorted(-tail, -share)])


class Code:
    """The product code for vectors of ``dims`` components, the largest label having ``count`` of them."""

    def __init__(self, dims: int, count: int):
        share = min(0.05, BY_CHANCE / max(count, 1))
        # the fewer blocks the more even the lists; more of them only when a block would need too many directions
        blocks = max(1, min(dims // 4, next(b for b in range(2, 65) if (PER_VECTOR / share) ** (1 / b) <= WORDS)))
        random = np.random.default_rng([SEED, dims])
        self.turn = np.linalg.qr(random.standard_normal((dims, dims)))[0]
        self.cuts = np.array_split(np.arange(dims), blocks)
        words = int(np.ceil((PER_VECTOR / share) ** (1 / blocks)))
        self.words = [unit(random.standard_normal((words, len(c)))) / np.sqrt(blocks) for c in self.cuts]
        self.bound = cap_bound(share, dims) if dims > 2 else -1.0

    def decode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that unit vectors reach.

        For rows that reach fewer than ``LEAST`` the bound is lowered, step by step, until they do;
        vectors that are near each other then have low bounds both.
        """
        turned = vectors @ self.turn
        scores = [turned[:, c] @ w.T for c, w in zip(self.cuts, self.words, strict=True)]
        row, filter_id = self.reach(scores, np.arange(len(vectors)), self.bound)
        bound = self.bound
        while len(few := np.flatnonzero(np.bincount(row, minlength=len(vectors)) < LEAST)) and bound > -1:
            bound = max(-1.0, bound - max(0.05 * abs(self.bound), 0.01))
            kept = ~np.isin(row, few)
            more, filters = self.reach(scores, few, bound)
            row, filter_id = np.concatenate([row[kept], more]), np.concatenate([filter_id[kept], filters])
        return row, filter_id

    def reach(self, scores: list[np.ndarray], row: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of the given rows, block by block; words that can't reach the bound any more are dropped."""
        most = np.array([s.max(1) for s in scores])
        filter_id, total = np.zeros(len(row), np.int64), np.zeros(len(row))
        for b, s in enumerate(scores):
            rest, lots, grown = most[b + 1 :].sum(0), max(1, 4_000_000 // s.shape[1]), []
            for k in range(0, len(row), lots):
                r = row[k : k + lots]
                new = total[k : k + lots, None] + s[r]
                i, j = np.nonzero(new >= (bound - rest[r])[:, None])
                grown.append((r[i], filter_id[k : k + lots][i] * s.shape[1] + j, new[i, j]))
            row, filter_id, total = (np.concatenate(x) for x in zip(*grown, strict=True)) if grown else (row[:0], filter_id[:0], total[:0])
        return row, filter_id


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; large and small ones are scaled first."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, h1, h2, embedding) of the rows that can link; ``h1`` and ``h2`` are 128 bits of hashes of label and vector."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0))
    kept = kept.filter(~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda v: v != 0))
    label, doubles = F.col("label").cast("string"), x.cast("array<double>")
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.xxhash64(label, doubles).alias("h1"), F.xxhash64(F.lit(SEED), F.reverse(doubles), label).alias("h2"), x.alias("embedding"))


class Lists:
    """Sorted filter lists of rows, flat: whether two rows share a filter smaller than the one at which they meet."""

    def __init__(self, lists: list[np.ndarray], filter_id: np.ndarray):
        length = np.array([len(f) for f in lists], np.int64)
        names, self.code = np.unique(np.concatenate(lists), return_inverse=True)
        self.width, self.start = len(names), np.cumsum(length) - length
        self.keys = np.repeat(np.arange(len(lists)), length) * self.width + self.code
        own = np.arange(len(lists)) * self.width + np.searchsorted(names, filter_id)
        #: How many filters of a row are smaller than the one at which it is met.
        self.before = np.searchsorted(self.keys, own) - self.start

    def first(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of one bucket: whether they share no smaller filter."""
        n = self.before[i]
        pair = np.repeat(np.arange(len(i)), n)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + self.start[i][pair]
        key = j[pair] * self.width + self.code[at]
        found = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
        return np.bincount(pair[found], minlength=len(i)) == 0

    def shared(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The same for all pairs of two sets of rows of a bucket, as a product of their incidence."""
        parts = []
        for rows in (one, two):
            n = self.before[rows]
            row = np.repeat(np.arange(len(rows)), n)
            parts.append((row, self.code[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.start[rows][row]], len(rows)))
        common = np.intersect1d(parts[0][1], parts[1][1])
        total = np.zeros((len(one), len(two)), np.float32)
        for k in range(0, len(common), 2048):
            some, dense = common[k : k + 2048], []
            for row, code, many in parts:
                at = np.searchsorted(some, code)
                inside = some[np.minimum(at, len(some) - 1)] == code
                m = np.zeros((many, len(some)), np.float32)
                m[row[inside], at[inside]] = 1
                dense.append(m)
            total += dense[0] @ dense[1].T
        return total == 0


def compare(x: np.ndarray, lists: list[np.ndarray], filter_id: np.ndarray, bucket: np.ndarray, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of rows of one bucket, at the smallest filter that both have. side: 0 both chunks the same, else 1 or 2."""
    found_i, found_j, names = [], [], Lists(lists, filter_id)
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]) if len(order) else np.empty(0, np.int64)
    length = np.diff(np.r_[starts, len(order)])
    for many in np.unique(length[length > 1]):
        at = starts[length == many]
        if many <= 32:
            u, v = np.triu_indices(many, 1)
            rows = order[at[:, None] + np.arange(many)]
            i, j = rows[:, u].ravel(), rows[:, v].ravel()
            crossing = (side[i] == 0) | (side[i] != side[j])
            i, j = i[crossing], j[crossing]
            for k in range(0, len(i), 100_000):
                a, b = i[k : k + 100_000], j[k : k + 100_000]
                near = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
                a, b = a[near], b[near]
                first = names.first(a, b)
                found_i.append(a[first])
                found_j.append(b[first])
        else:
            for s in at:
                rows = order[s : s + many]
                one, two = (rows[side[rows] == 1], rows[side[rows] == 2]) if side[rows[0]] else (rows, rows)
                near = x[one] @ x[two].T >= cosine
                if one is two:
                    near = np.triu(near, 1)
                if near.any():
                    a, b = np.nonzero(near & names.shared(one, two))
                    found_i.append(one[a])
                    found_j.append(two[b])
    if not found_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def links(groups: DataFrame, dims: int, cosine: float) -> DataFrame:
    """Written table (gid, linked, root) from distinct vectors (gid, label, many, embedding): partial sums of linked rows, and a star of each group of links."""
    largest = groups.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    code = groups.sparkSession.sparkContext.broadcast(Code(dims, largest))
    kinds = pa.schema([("gid", pa.int64()), ("label", pa.string()), ("filter", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, filter_id = code.value.decode(unit(np.asarray(batch.column(2).flatten(), np.float64).reshape(-1, dims)))
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[row]), batch.column(1).cast(pa.string()).take(pa.array(row)), pa.array(filter_id)], schema=kinds)

    entries = materialize(groups.select("gid", "label", "embedding").mapInArrow(decode, "gid long, label string, filter long"), "filters")
    shared = entries.groupBy("label", "filter").agg(F.count("*").alias("many")).filter("many > 1")
    kept = entries.join(shared, ["label", "filter"]).withColumn("chunks", F.ceil(F.col("many") / CHUNK))
    kept = materialize(kept.withColumn("chunk", F.pmod(F.xxhash64("gid"), F.col("chunks"))), "shared-filters")
    own = kept.groupBy("gid").agg(F.sort_array(F.collect_set("filter")).alias("filters"))
    facts = groups.join(own, "gid").select("gid", "many", "embedding", "filters")
    dealt = kept.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("gid", "label", "filter", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), F.when(F.col("chunks") == 1, 0).when(F.col("chunk") == F.col("other"), 0).when(F.col("chunk") < F.col("other"), 1).otherwise(2).alias("side"))
    cells = max(16, kept.count() // CELL + 1)
    dealt = dealt.withColumn("bucket", F.xxhash64("label", "filter", "lo", "hi")).withColumn("cell", F.pmod("bucket", F.lit(cells)))

    def meet(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(rows.embedding.to_numpy()).astype(np.float64))
        i, j = compare(x, list(rows.filters), rows["filter"].to_numpy(), rows.bucket.to_numpy(), rows.side.to_numpy(), cosine)
        gid, at, code_of = np.unique(rows.gid.to_numpy(), return_index=True, return_inverse=True)
        many, i, j = rows.many.to_numpy()[at], code_of[i], code_of[j]
        linked = np.bincount(i, many[j], len(gid)) + np.bincount(j, many[i], len(gid))
        root = spanning(len(gid), i, j)
        some = linked > 0
        return pd.DataFrame({"gid": gid[some], "linked": linked[some].astype(np.int64), "root": gid[root[some]]})

    rows = dealt.join(facts, "gid").select("cell", "gid", "filter", "bucket", "side", "many", "embedding", "filters")
    return materialize(rows.groupBy("cell").applyInPandas(meet, "gid long, linked long, root long"), "vector-links")


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Rows link if their labels are equal and not null and the cosine of their vectors, in double
    precision, is at least ``cosine``; only vectors of equal length are compared. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, nor do rows without
    id or label; they are kept, and a null vec_id has a null component. Repeated rows are copies of
    each other, and an empty table gives no rows. Every link reported is verified; the share of links found is measured in the tests.
    """
    small_batches(vectors.sparkSession, 2000)
    rows = materialize(valid(vectors), "vectors")
    groups = rows.groupBy("h1", "h2").agg(F.first("label").alias("label"), F.count("*").alias("many"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    groups = materialize(groups.withColumn("gid", F.monotonically_increasing_id()), "distinct-vectors")
    found = None
    for (dims,) in groups.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect():
        part = links(groups.filter(F.size("embedding") == dims), dims, cosine)
        found = part if found is None else found.union(part)
    if found is None:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    roots = connected_components(found.select(F.col("gid").alias("a"), F.col("root").alias("b")))
    of_group = groups.select("gid", "h1", "h2", "many", "least").join(roots.withColumnRenamed("node", "gid"), "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    of_group = of_group.join(found.groupBy("gid").agg(F.sum("linked").alias("linked")), "gid", "left")
    component = of_group.groupBy("root").agg(F.min("least").alias("component_id"))
    of_group = of_group.join(component, "root").select("h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    linked = rows.select("vec_id", "h1", "h2").join(of_group, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    other = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).exceptAll(rows.select("vec_id")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(other).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: The op8 query in DuckDB's SQL.
NEAR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS peer FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.peer),
c AS (SELECT node AS vec_id, min(peer) AS component_id FROM r GROUP BY node),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
