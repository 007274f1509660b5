"""Tables of vectors: search, merging, upkeep, representatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from . import kmeans
from .ranges import by_length, like

#: Rows of a block of queries and of points, scores that a task works on at once, blocks of queries that are broadcast or held at most, blocks of points that meet one of queries in a task beyond that.
QUERY_BLOCK, POINT_BLOCK, SCORES, SENT, SHARE = 4096, 4096, 1 << 20, 4, 64


def norm(v) -> F.Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def dot(a, b) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v) -> F.Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def check_dims(points: DataFrame, column: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose vector has n components, the others)."""
    good = F.coalesce(F.size(column) == n, F.lit(False))
    return points.filter(good), points.filter(~good)


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Written blocks (same, block, ids, vecs) of at most some ``most`` rows (id, vec, same), sorted by id; vectors as doubles in bytes.

    Rows without a value of ``same`` are packed as tasks read them; otherwise those of one value are
    dealt to as many blocks as their number asks.
    """
    kinds = dict(rows.dtypes)
    schema = f"same {kinds['same']}, ids array<{kinds['id']}>, vecs binary"

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        x = np.stack(part["vec"].to_numpy()).astype(float)
        return like(part, ["same"], 1, ids=[part["id"].tolist()], vecs=[x.tobytes()])

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for s in range(0, len(batch), most):
                held.append(batch[s : s + most])
                if sum(map(len, held)) >= most:
                    yield pack(pd.concat(held))
                    held = []
        if sum(map(len, held)):
            yield pack(pd.concat(held))

    if kinds["same"] == "void":
        found = rows.withColumn("same", F.lit(0)).mapInPandas(stream, schema.replace("void", "int"))
    else:
        sizes = rows.groupBy("same").agg(F.ceil(F.count("*") / most).alias("_parts"))
        dealt = rows.join(sizes, "same").withColumn("_part", F.pmod(F.xxhash64("id", "vec"), F.col("_parts")))
        found = dealt.groupBy("same", "_part").applyInPandas(pack, schema)
    return written(found.withColumn("block", F.monotonically_increasing_id()), "blocks")


def best_rows(held: tuple, new: tuple, k: int) -> tuple:
    """(query, score, id) of the k best of each query: higher scores first, ties by id."""
    q, s, i = (np.concatenate(x) if len(held[0]) else x[1] for x in zip(held, new, strict=True))
    order = np.lexsort((i, -s, q))
    q, s, i = q[order], s[order], i[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[kept], s[kept], i[kept]


def top_k(queries: DataFrame, points: DataFrame, query_vec: str, vec: str, k: int = 5, same: str | None = None, metric: str = "cosine", places: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the k best points of each query; ties, after rounding to ``places``, by id.

    ``same``: a column that a query and its points must share. Packed blocks of queries meet packed
    blocks of points (of one value of ``same``): a few blocks of queries, counted, are broadcast;
    beyond that both sides are dealt to tasks by block of queries and share of the points. A task
    keeps k rows a query; a window takes the best of those. Null vectors and null values of ``same`` take no part.
    """
    kind, key = dict(points.dtypes)["id"], dict(queries.dtypes)["query_id"]
    of = (lambda: F.col(same)) if same else (lambda: F.lit(None))
    usable = lambda rows, column: rows.filter(F.col(column).isNotNull()).filter(F.col(same).isNotNull() if same else F.lit(True))
    asked = usable(queries, query_vec).select(F.col("query_id").alias("id"), F.col(query_vec).alias("vec"), of().alias("same"))
    given = usable(points, vec).select("id", F.col(vec).alias("vec"), of().alias("same"))
    sent = packed(asked, QUERY_BLOCK).select("same", F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    blocks = packed(given, POINT_BLOCK)
    if sent.count() <= SENT:
        pairs = blocks.join(F.broadcast(sent), "same")
    else:
        shares = F.lit(max(1, blocks.count() // SHARE) if same is None else max(1, SENT)).cast("long")
        met = blocks.join(sent.select("same", "q"), "same").withColumn("share", F.pmod(F.xxhash64("block"), shares))
        pairs = met.join(sent.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))), ["same", "q", "share"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        out = lambda x: pd.DataFrame({"query_id": x[0][x[1][0]], "id": x[1][2], "score": x[1][1]})
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, q_ids = (np.array(list(x), object) if len(x) and isinstance(x[0], str) else np.asarray(x) for x in (row.ids, row.q_ids))
                ids = ids.astype(str) if ids.dtype == object else ids
                x, q = (np.frombuffer(b).reshape(n, -1) for b, n in ((row.vecs, len(ids)), (row.q_vecs, len(q_ids))))
                if row.q not in held:
                    if len(held) >= SENT:
                        yield from map(out, held.values())
                        held.clear()
                    held[row.q] = [q_ids, (np.zeros(0, np.int64), np.zeros(0), ids[:0])]
                step = max(k, SCORES // len(q))
                for s in range(0, len(x), step):
                    scores = np.round(similarity(q, x[s : s + step], metric), places)
                    least = np.partition(scores, -k, 1)[:, -k:].min(1) if scores.shape[1] > k else np.full(len(q), -np.inf)
                    i, j = np.nonzero(scores >= least[:, None])
                    held[row.q][1] = best_rows(held[row.q][1], (i, scores[i, j], ids[s : s + step][j]), k)
        yield from map(out, held.values())

    rows = pairs.select("q", "q_ids", "q_vecs", "ids", "vecs").mapInPandas(scan, f"query_id {key}, id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def similarity(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Rows of ``q`` by rows of ``x``: cosine, dot, or the negative Euclidean distance."""
    if metric == "cosine":
        return (q / norms(q)) @ (x / norms(x)).T
    if metric == "dot":
        return q @ x.T
    return -np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1), 0))


def norms(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.where(n > 0, n, 1.0)


def hybrid(queries: DataFrame, points: DataFrame, w_a: float, w_b: float, k: int = 5, mult: int = 3, vecs=(("vec_a", "clip_vec"), ("vec_b", "desc_vec"))) -> DataFrame:
    """(query_id, id, score_a, score_b, score, rank): mult * k by each vector, a missing score as 0, the weighted sum, the best k."""
    a, b = (top_k(queries, points, q, v, k * mult).select("query_id", "id", F.col("score").alias(n)) for (q, v), n in zip(vecs, ("score_a", "score_b"), strict=True))
    both = a.join(b, ["query_id", "id"], "full").withColumn("score_a", F.coalesce("score_a", F.lit(0.0))).withColumn("score_b", F.coalesce("score_b", F.lit(0.0)))
    rows = both.withColumn("score", F.round(F.col("score_a") * w_a + F.col("score_b") * w_b, 6))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def threshold(hits: DataFrame, least: float) -> DataFrame:
    """After the cut at k."""
    return hits.filter(F.col("score") >= least)


def upsert(base: DataFrame, delta: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both, the highest version of each id."""
    rows = base.unionByName(delta, allowMissingColumns=True)
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("version")))
    return rows.withColumn("_n", newest).filter("_n = 1").drop("_n")


def patch(base: DataFrame, delta: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """``base`` with the given columns replaced where ``delta`` has them."""
    new = delta.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    rows = base.join(new, key, "left")
    for c in columns:
        rows = rows.withColumn(c, F.coalesce(f"_{c}", c))
    return rows.select(*base.columns)


def merged_maps(old, new, depth: int = 0) -> F.Column:
    """``old`` with the keys of ``new`` set, also to null; to ``depth`` more levels maps under one key are merged, not replaced. Null maps are empty."""

    def value(key, a, b):
        inner = F.when(a.isNotNull() & b.isNotNull(), merged_maps(a, b, depth - 1)).otherwise(b) if depth else b
        return F.when(F.map_contains_key(new, key), inner).otherwise(a)

    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_zip_with(old, new, value))


def patch_maps(base: DataFrame, delta: DataFrame, column: str = "payload", depth: int = 0, key: str = "id") -> DataFrame:
    """``base`` with its map ``column`` merged with those of ``delta`` (key, column, version), several for an id in the order of version.

    Ids that ``base`` lacks are ignored; rows without a patch stay; a null patch changes nothing.
    """
    # maps have no order: patches are sorted by version alone
    listed = F.array_sort(F.collect_list(F.struct("version", F.col(column).alias("_new"))), lambda a, b: F.when(a["version"] < b["version"], -1).when(a["version"] > b["version"], 1).otherwise(0))
    patches = delta.filter(F.col(column).isNotNull()).groupBy(F.col(key).alias("_key")).agg(listed.alias("_p"))
    rows = base.join(patches, F.col(key) == F.col("_key"), "left")
    merged = F.aggregate(F.coalesce("_p", F.array().cast(patches.schema["_p"].dataType)), F.col(column), lambda old, p: merged_maps(old, p["_new"], depth))
    return rows.withColumn(column, merged).select(*base.columns)


def get_by_id(points: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows with the given ids, with score -1."""
    return points.join(ids.select(key).distinct(), key, "left_semi").withColumn("score", F.lit(-1.0))


def delete_by_id(points: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return points.join(ids.select(key), key, "left_anti")


def index_rows(frames: DataFrame, vectors: DataFrame, texts: DataFrame, keys=("video_id", "frame_number")) -> DataFrame:
    """One point for each frame that has a vector and a description."""
    return frames.join(vectors, list(keys)).join(texts, list(keys))


def retrieval_stats(hits: DataFrame) -> DataFrame:
    """(query_id, n, avg_score)."""
    return hits.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"))


def retrieval_summary(hits: DataFrame, by: list[str], confidence: str, accuracy: int = 200) -> DataFrame:
    """(by, n, n_confident, avg_score, avg_confidence, sketch) of hits (score, and a confidence that may be null).

    ``sketch`` is a mergeable summary of the scores' quantiles, whose rank error is some 1.3 in a hundred
    at an accuracy of 200; kept in a table it adds up over days, see ``score_quantiles``.
    """
    c = F.col(confidence).cast("double")
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(c).alias("n_confident"), F.avg("score").alias("avg_score"), F.avg(c).alias("avg_confidence"), F.kll_sketch_agg_double(F.col("score").cast("double"), F.lit(accuracy)).alias("sketch"))


def score_quantiles(summaries: DataFrame, by: list[str], ranks: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """(by, n, quantiles): the sketches of ``retrieval_summary`` merged over coarser groups."""
    merged = summaries.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"), F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, ranks))).alias("quantiles"))


def representatives(points: DataFrame, cluster: str, vec: str) -> DataFrame:
    """(cluster, id, distance): the member nearest to the mean vector of its cluster; ties by id."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>"))))
    means = points.filter(F.col(vec).isNotNull()).groupBy(F.col(cluster).alias("cluster")).agg(mean.alias("centre"))
    gap = F.sqrt(F.aggregate(F.zip_with(F.col(vec), F.col("centre"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    rows = points.withColumnRenamed(cluster, "cluster").join(means, "cluster").withColumn("distance", F.round(gap, 6))
    best = rows.groupBy("cluster").agg(F.min(F.struct("distance", "id")).alias("b"))
    return best.select("cluster", "b.id", "b.distance")


def keyframes(points: DataFrame, k: int, vec: str = "clip_vec", seed: int = 0, rounds: int = 50, most: int = 50_000) -> DataFrame:
    """(video_id, id, timestamp, cluster): per recording, the frame nearest to each of k means, once, by time; all if there are no more than k.

    A recording is a group; those of more than ``most`` frames are worked on together in rounds over
    packs of frames, see ``kmeans``. Frames without a vector or a recording are left out.
    """

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["timestamp", "id"], ignore_index=True)
        if len(rows) <= k:
            return rows.assign(cluster=np.arange(len(rows)))[["video_id", "id", "timestamp", "cluster"]]
        x = np.stack(rows["vec"].to_numpy()).astype(float)
        picks = {i: c for c, i, _ in kmeans.nearest(x, kmeans.one_group(x, k, seed, rounds))}
        at = sorted(picks)
        return rows.loc[at].assign(cluster=[picks[i] for i in at])[["video_id", "id", "timestamp", "cluster"]]

    kinds = dict(points.dtypes)
    given = points.select("video_id", "id", "timestamp", F.col(vec).alias("vec")).filter("vec is not null and video_id is not null")
    short, long = by_length(given, "video_id", max(most, k))
    found = short.groupBy("video_id").applyInPandas(cluster, f"video_id {kinds['video_id']}, id {kinds['id']}, timestamp double, cluster long")
    return found if long is None else found.union(kmeans.long_groups(long, k, seed, rounds, min(most, 8192)))
