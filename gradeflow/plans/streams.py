"""Queries that run streams over the given tables to their end; the SQL is that of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import criteria as c
from ..sources import documents as src
from ..streaming import jobs
from . import fixtures as fx
from .registry import query


def _events(spark, d):
    return jobs.read_stream(spark, d, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


# what append mode has emitted: sessions and windows that ended by the latest time
@query("""WITH s AS (SELECT user_id AS video_id, event_id, epoch_us(ts) AS a, epoch_us(ts) + 30000000 AS b FROM events),
n AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY video_id ORDER BY a, event_id) > 600000000 THEN 1 ELSE 0 END AS new FROM s),
c AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY a, event_id) AS k FROM n)
SELECT video_id, min(a) AS start_us, max(b) AS end_us, count(*) AS n FROM c GROUP BY video_id, k HAVING max(b) + 600000000 <= (SELECT max(epoch_us(ts)) FROM events) // 1000 * 1000""")
def stream_chunks(spark, d):
    segments = _events(spark, d).select(F.col("user_id").alias("video_id"), F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 30 seconds")).alias("end"))
    rows = jobs.run(jobs.chunks(segments, 600.0), "chunks")
    return rows.select("video_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("""WITH w AS (SELECT event_type AS label, (epoch_us(ts) // 1800000000 - i) * 1800000000 AS a FROM events, range(2) r(i)),
g AS (SELECT a, label, count(*) AS k FROM w GROUP BY ALL)
SELECT a AS start_us, a + 3600000000 AS end_us, sum(k)::BIGINT AS n, arg_min(label, (-k, label)) AS label FROM g GROUP BY a HAVING a + 3600000000 <= (SELECT max(epoch_us(ts)) FROM events) // 1000 * 1000""")
def stream_clip_windows(spark, d):
    rows = jobs.run(jobs.clip_windows(_events(spark, d).select("ts", F.col("event_type").alias("label")), "1 hour", "30 minutes"), "windows")
    return rows.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", "label")


@query("SELECT event_id, user_id FROM events")
def stream_dedupe_points(spark, d):
    rows = _events(spark, d).select("event_id", "user_id", "ts", F.explode(F.array(F.lit(0), F.lit(1))).alias("replay"))
    return jobs.run(jobs.dedupe_points(rows, "event_id", "365 days"), "points").select("event_id", "user_id")


@query("""WITH l AS (SELECT user_id AS task_id, arg_max(event_type, (ts, event_id)) AS step, arg_max(value, (ts, event_id)) AS progress, max((event_type = 'error')::INT) AS e FROM events GROUP BY 1)
SELECT task_id, step, progress, step = 'purchase' AND e = 0 AS completed, e = 1 AS failed FROM l""")
def stream_latest_status(spark, d):
    events = _events(spark, d).select(F.col("user_id").alias("task_id"), "ts", F.col("event_id").alias("event_no"), F.col("event_type").alias("step"), F.col("value").alias("progress"))
    rows = jobs.latest_status(events, "purchase", "error")
    path = jobs.run_batches(rows, "status", "complete", lambda batch, i, folder: batch.write.mode("overwrite").parquet(f"{folder}/rows"))
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


@query("""RECURSIVE WITH f AS (SELECT user_id AS video_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
g AS (SELECT video_id, k, t, t AS kept, TRUE AS is_kept FROM f WHERE k = 1
  UNION ALL SELECT f.video_id, f.k, f.t, CASE WHEN f.t >= g.kept + 2000.0 THEN f.t ELSE g.kept END, f.t >= g.kept + 2000.0 FROM g JOIN f ON f.video_id = g.video_id AND f.k = g.k + 1)
SELECT video_id, round(t, 6) AS timestamp FROM g WHERE is_kept""")
def stream_sample_frames(spark, d):
    frames = _events(spark, d).select(F.col("user_id").alias("video_id"), (F.unix_micros("ts") / 1e6).alias("timestamp"))
    return jobs.run(jobs.sample_frames(frames, 0.0005, idle_seconds=86400.0), "frames").withColumn("timestamp", F.round("timestamp", 6))


@query("SELECT sum(1)::BIGINT AS n, 0::BIGINT AS late FROM events")
def stream_late_report(spark, d):
    rows = jobs.late_report(_events(spark, d), 3600.0)
    return rows.agg(F.sum("n").alias("n"), F.sum("late").alias("late"))


@query("""WITH e AS (SELECT event_id % 3 AS b, epoch_us(ts) AS t FROM events),
l AS (SELECT b, max(t) OVER (ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000000 AS bar, t FROM e)
SELECT b::BIGINT AS batch_id, count(*) AS n, count(*) FILTER (t < bar) AS late FROM l GROUP BY b""")
def stream_late_batches(spark, d):
    """The events in three deliveries, one after another into a folder that the stream goes on reading, so that most of the later two are late."""
    folder, path = jobs.shared_folder(spark, "deliveries"), jobs.shared_folder(spark, "late")
    for k in range(3):
        fx.table(spark, d, "events").filter(F.col("event_id") % 3 == k).write.mode("append").parquet(f"{folder}/events.parquet")
        rows = jobs.late_report(jobs.read_stream(spark, folder, "events.parquet"), 3600.0, path=path)
    return rows


@query("""SELECT 'actions' AS category, video_id::VARCHAR AS video_id, clip_no, label, "start", "end" FROM fx_clips""")
def src_cache_json(spark, d):
    clip = F.struct("clip_no", F.col("label").alias("action_label"), F.col("start").alias("start_time"), F.col("end").alias("end_time"))
    rows = fx.clips(spark, d).groupBy(F.col("video_id").cast("string").alias("video_id")).agg(F.transform(F.array_sort(F.collect_list(clip)), lambda x: F.struct(x["action_label"].alias("action_label"), x["start_time"].alias("start_time"), x["end_time"].alias("end_time"))).alias("clips"))
    path = jobs.shared_folder(spark, "cache")
    rows.select(F.to_json(F.create_map(F.lit("actions"), F.create_map("video_id", "clips"))).alias("value")).write.text(path)
    # a document for each recording, a line each
    found = spark.read.text(path).select(F.explode(F.from_json("value", src.CACHE)).alias("category", "videos")).select("category", F.explode("videos").alias("video_id", "clips"))
    return found.select("category", "video_id", F.posexplode("clips").alias("clip_no", "c")).select("category", "video_id", "clip_no", F.col("c.action_label").alias("label"), F.col("c.start_time").alias("start"), F.col("c.end_time").alias("end"))


@query("SELECT (doc_id % 10)::INT AS station, sum(count(*) + count(DISTINCT section) + 1) OVER (PARTITION BY doc_id % 10)::BIGINT AS n_lines FROM fx_criteria GROUP BY doc_id QUALIFY row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id) = 1")
def sink_prompt_files(spark, d):
    prompts = c.render_prompt(fx.criteria(spark, d)).withColumn("station", (F.col("doc_id") % 10).cast("int"))
    path = jobs.shared_folder(spark, "prompts")
    src.write_prompts(prompts, path)
    return spark.read.text(path).groupBy("station").agg(F.count("*").alias("n_lines"))
