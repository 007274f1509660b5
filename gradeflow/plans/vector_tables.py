"""Queries over tables of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors
from . import fixtures as fx
from .registry import QUERIES, SQL, query

HITS = """h AS (SELECT q.query_id, p.id, round(list_cosine_similarity(q.vec_a, p.clip_vec), 6) AS a, round(list_cosine_similarity(q.vec_b, p.desc_vec), 6) AS b, q.video_id = p.video_id AS same FROM fx_queries q, fx_points p),
ra AS (SELECT query_id, id, a AS score, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, id)::INT AS rank FROM h),
rb AS (SELECT query_id, id, b AS score, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, id)::INT AS rank FROM h)"""


def _hits(spark, d, k=5, queries=fx.queries):
    return vectors.top_k(queries(spark, d), fx.points(spark, d), "vec_a", "clip_vec", k)


def _whole(search):
    """Registers a search under ``<name>_whole`` too, asked every row whose id is divisible by 50."""
    name = f"{search.__name__}_whole"
    QUERIES[name] = lambda spark, d: search(spark, d, fx.asked)
    SQL[name] = SQL[search.__name__].replace("WHERE id < 10", "WHERE id % 50 = 0")
    return search


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS total, 1.0 AS len2 FROM embeddings")
def l2_normalize(spark, d):
    v = vectors.l2_normalize(F.col("embedding").cast("array<double>"))
    rows = fx.table(spark, d, "embeddings").select("vec_id", v.alias("v"))
    return rows.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("len2"))


@query("SELECT len(embedding) = 64 AS good, count(*) AS n FROM embeddings GROUP BY ALL")
def vector_check(spark, d):
    good, bad = vectors.check_dims(fx.table(spark, d, "embeddings"), "embedding", 64)
    return good.select(F.lit(True).alias("good")).union(bad.select(F.lit(False))).groupBy("good").agg(F.count("*").alias("n"))


@_whole
@query(f"WITH {HITS} SELECT query_id, id, score, rank FROM ra WHERE rank <= 5")
def topk_search(spark, d, queries=fx.queries):
    return _hits(spark, d, queries=queries)


@_whole
@query(f"""WITH {HITS}, r AS (SELECT query_id, id, a AS score, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, id)::INT AS rank FROM h WHERE same)
SELECT * FROM r WHERE rank <= 5""")
def topk_search_filtered(spark, d, queries=fx.queries):
    return vectors.top_k(queries(spark, d), fx.points(spark, d), "vec_a", "clip_vec", 5, same="video_id")


@_whole
@query(f"""WITH {HITS}, j AS (SELECT query_id, id, coalesce(x.score, 0.0) AS score_a, coalesce(y.score, 0.0) AS score_b FROM (SELECT * FROM ra WHERE rank <= 15) x FULL JOIN (SELECT * FROM rb WHERE rank <= 15) y USING (query_id, id)),
s AS (SELECT *, round(score_a * 0.6::DOUBLE + score_b * 0.4::DOUBLE, 6) AS score FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s)
SELECT * FROM r WHERE rank <= 5""")
def hybrid_search(spark, d, queries=fx.queries):
    return vectors.hybrid(queries(spark, d), fx.points(spark, d), 0.6, 0.4)


@_whole
@query(f"WITH {HITS} SELECT query_id, id, score, rank FROM ra WHERE rank <= 5 AND score >= 0.3")
def score_threshold(spark, d, queries=fx.queries):
    return vectors.threshold(_hits(spark, d, queries=queries), 0.3)


@_whole
@query(f"WITH {HITS} SELECT query_id, count(*) AS n, round(avg(score), 6) AS avg_score FROM ra WHERE rank <= 5 GROUP BY query_id")
def retrieval_stats(spark, d, queries=fx.queries):
    return vectors.retrieval_stats(_hits(spark, d, queries=queries)).withColumn("avg_score", F.round("avg_score", 6))


CONFIDENT = "h AS (SELECT question_id, tool, confidence AS score, CASE WHEN k % 3 > 0 THEN k / 10 END AS sure FROM fx_outputs)"


def _confident(spark, d):
    k = F.col("k")
    return fx.outputs(spark, d).select("question_id", "tool", F.col("confidence").alias("score"), F.when(k % 3 > 0, k / 10).alias("sure"))


@query(f"WITH {CONFIDENT} SELECT question_id, count(*) AS n, count(sure) AS n_confident, round(avg(score), 6) AS avg_score, round(avg(sure), 6) AS avg_confidence FROM h GROUP BY question_id")
def retrieval_confidence(spark, d):
    rows = vectors.retrieval_summary(_confident(spark, d), ["question_id"], "sure")
    return rows.select("question_id", "n", "n_confident", F.round("avg_score", 6).alias("avg_score"), F.round("avg_confidence", 6).alias("avg_confidence"))


@query()
def retrieval_quantiles(spark, d):
    """Sketches of each (question, tool), merged by tool: approximate, so without SQL."""
    return vectors.score_quantiles(vectors.retrieval_summary(_confident(spark, d), ["question_id", "tool"], "sure"), ["tool"])


@query("""WITH u AS (SELECT id, video_id, timestamp, version FROM fx_points UNION ALL SELECT id, video_id, timestamp, version FROM fx_updates)
SELECT id, arg_max(video_id, version) AS video_id, arg_max(timestamp, version) AS timestamp, max(version) AS version FROM u GROUP BY id""")
def upsert_points(spark, d):
    base = fx.points(spark, d).select("id", "video_id", "timestamp", "version")
    return vectors.upsert(base, fx.point_updates(spark, d))


@query("SELECT p.id, p.video_id, coalesce(u.timestamp, p.timestamp) AS timestamp FROM fx_points p LEFT JOIN fx_updates u USING (id)")
def patch_payload(spark, d):
    return vectors.patch(fx.points(spark, d).select("id", "video_id", "timestamp"), fx.point_updates(spark, d), ["timestamp"])


@query("""WITH p AS (SELECT *, id % 7 = 0 AS a, id % 35 = 0 AS b, id % 11 = 0 AS c FROM fx_points)
SELECT id, concat_ws(';', 'at=' || CASE WHEN b THEN 'twice' WHEN a THEN 'once' ELSE id::VARCHAR END, CASE WHEN a AND NOT b THEN 'gone=~' WHEN b THEN 'gone=back' END, 'keep=' || video_id) AS flat,
  concat_ws(';', CASE WHEN c THEN 'new=1' END, 'old=' || CASE WHEN c THEN '2' ELSE '0' END, 'stays=0') AS deep FROM p""")
def patch_payload_maps(spark, d):
    """Payloads as maps: every seventh point has a patch, every 35th a second one; every eleventh one for a map within the map."""
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("~")))), ";")
    pair = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    points = fx.points(spark, d).select("id", pair("keep", F.col("video_id").cast("string"), "at", F.col("id").cast("string")).alias("payload"), pair("tags", pair("old", "0", "stays", "0")).alias("nested"))
    none = F.lit(None).cast("string")
    one = points.filter("id % 7 = 0").select("id", pair("at", "once", "gone", none).alias("payload"), F.lit(1).alias("version"))
    two = points.filter("id % 35 = 0").select("id", pair("at", "twice", "gone", "back").alias("payload"), F.lit(2).alias("version"))
    inner = points.filter("id % 11 = 0").select("id", pair("tags", pair("old", "2", "new", "1")).alias("nested"), F.lit(1).alias("version"))
    rows = vectors.patch_maps(vectors.patch_maps(points, two.union(one)), inner, "nested", depth=1)
    return rows.select("id", text(F.col("payload")).alias("flat"), text(F.col("nested")["tags"]).alias("deep"))


@query("SELECT id, video_id, -1.0::DOUBLE AS score FROM fx_points WHERE id IN (SELECT id FROM fx_updates)")
def get_by_id(spark, d):
    return vectors.get_by_id(fx.points(spark, d).select("id", "video_id"), fx.point_updates(spark, d))


@query("SELECT id, video_id FROM fx_points WHERE id NOT IN (SELECT id FROM fx_updates)")
def delete_by_id(spark, d):
    return vectors.delete_by_id(fx.points(spark, d).select("id", "video_id"), fx.point_updates(spark, d))


@query("SELECT video_id, frame_number, timestamp, len(clip_vec)::INT AS dims, 'frame ' || frame_number AS description FROM fx_points")
def index_rows(spark, d):
    p = fx.points(spark, d)
    key = ["video_id", "frame_number"]
    rows = vectors.index_rows(p.select(*key, "timestamp"), p.select(*key, "clip_vec"), p.select(*key, F.concat(F.lit("frame "), F.col("frame_number").cast("string")).alias("description")))
    return rows.select(*key, "timestamp", F.size("clip_vec").alias("dims"), "description")


@query("""WITH e AS (SELECT label AS cluster, vec_id AS id, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT cluster, pos, avg(x) AS m FROM e GROUP BY ALL), g AS (SELECT cluster, id, round(sqrt(sum((x - m) * (x - m))), 6) AS distance FROM e JOIN m USING (cluster, pos) GROUP BY ALL)
SELECT cluster, arg_min(id, (distance, id)) AS id, min(distance) AS distance FROM g GROUP BY cluster""")
def nearest_to_centroid(spark, d):
    return vectors.representatives(fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v")), "label", "v")


@query()
def keyframe_clusters(spark, d):
    return vectors.keyframes(fx.points(spark, d), 5)
