"""Structured Streaming forms of the timed jobs. Each takes a streaming DataFrame; ``run`` drives one to its end."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..scratch import shared_folder


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Files called ``name`` in ``folder``, or below it, as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, which stateful processors need; the session's setting is put back."""
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def run(rows: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """All rows that a stream appends over what is there now; with the ``path`` of an earlier run, it goes on from there."""
    spark, path = rows.sparkSession, path or shared_folder(rows.sparkSession, name)
    with rocksdb(spark):
        query = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def run_batches(rows: DataFrame, name: str, mode: str, write: Callable[[DataFrame, int, str], None], path: str | None = None) -> str:
    """Drive a stream through ``write(batch, batch_id, folder)``; the folder. With the ``path`` of an earlier run, it goes on from there."""
    path = path or shared_folder(rows.sparkSession, name)
    query = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda batch, i: write(batch, i, path)).start()
    query.awaitTermination()
    return path


def chunks(segments: DataFrame, gap: float = 1.0, late: str = "0 seconds") -> DataFrame:
    """(video_id, start, end, n) of conversation chunks from segments (video_id, start, end as timestamps).

    A session per recording whose gap is each segment's length plus ``gap`` seconds. It keeps the
    largest end, where the batch job looks at the previous segment's end alone.
    """
    micros = F.unix_micros("end") - F.unix_micros("start") + int(gap * 1e6)
    rows = segments.withColumn("_gap", F.concat(micros.cast("string"), F.lit(" microseconds"))).withWatermark("start", late)
    grouped = rows.groupBy("video_id", F.session_window("start", F.col("_gap"))).agg(F.count("*").alias("n"))
    end = F.timestamp_micros(F.unix_micros("session_window.end") - int(gap * 1e6))
    return grouped.select("video_id", F.col("session_window.start").alias("start"), end.alias("end"), "n")


def clip_windows(clips: DataFrame, length: str, slide: str, late: str = "0 seconds") -> DataFrame:
    """(start, end, n, label) of sliding windows over clips (ts, label): how many, and the most frequent label, the smallest on ties."""
    rows = clips.withWatermark("ts", late).groupBy(F.window("ts", length, slide)).agg(F.count("*").alias("n"), F.mode("label", True).alias("label"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "label")


def dedupe_points(points: DataFrame, key: str, late: str) -> DataFrame:
    """The first of each key; replays within the watermark are dropped."""
    return points.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def latest_status(events: DataFrame, done: str = "completed", error: str = "failed") -> DataFrame:
    """(task_id, step, progress, completed, failed): the latest event of each task (task_id, ts, event_no, step, progress); a step ``error`` overrides."""
    last = F.struct("ts", "event_no")
    rows = events.groupBy("task_id").agg(F.max_by("step", last).alias("step"), F.max_by("progress", last).alias("progress"), F.max((F.col("step") == error).cast("int")).alias("_e"))
    return rows.select("task_id", "step", "progress", ((F.col("step") == done) & (F.col("_e") == 0)).alias("completed"), (F.col("_e") == 1).alias("failed"))


#: Seconds added to times of frames for their event time: a stream begins at the watermark 0, and drops what isn't above it.
ORIGIN = 1e9


class KeepFrames(StatefulProcessor):
    """Keeps a frame that lies at least ``step`` seconds after the last kept one; the state of a recording is that one's time."""

    def __init__(self, step: float, idle_seconds: float | None):
        self.step, self.idle = step, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, kept = (self.last.get()[0] if self.last.exists() else None), []
        for t in sorted(t for part in rows for t in part["timestamp"]):
            if last is None or t >= last + self.step:
                kept.append(t)
                last = t
        self.last.update((last,))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(int((ORIGIN + last + self.step + self.idle) * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"video_id": np.array([key[0]] * len(kept), object), "timestamp": np.array(kept, float)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def sample_frames(frames: DataFrame, rate: float, idle_seconds: float | None = None) -> DataFrame:
    """(video_id, timestamp): as the batch job, the state being the last kept time. Frames without a time are left out.

    With ``idle_seconds`` frames may come that much later than the latest of all; later ones are dropped, and a
    timer drops the state of a recording once nothing can come for it any more. Without, it is kept.
    Needs the state store of ``rocksdb``.
    """
    kind = dict(frames.dtypes)["video_id"]
    frames = frames.filter("timestamp is not null")
    if idle_seconds is not None:
        frames = frames.withColumn("_ts", F.timestamp_micros(((F.col("timestamp") + ORIGIN) * 1e6).cast("long"))).withWatermark("_ts", f"{idle_seconds} seconds")
    mode = "None" if idle_seconds is None else "EventTime"
    return frames.groupBy("video_id").transformWithStateInPandas(KeepFrames(1.0 / rate, idle_seconds), f"video_id {kind}, timestamp double", "append", mode)


def late_report(events: DataFrame, allowed_seconds: float, name: str = "late", path: str | None = None) -> DataFrame:
    """(batch_id, n, late): rows of each batch, and those older than the latest time of earlier batches less the allowed seconds.

    The rows pass once, to a table at ``path``/events with a column ``late``, and are counted as they
    pass (``observe``). The row of a batch has the latest time so far, so a batch reads the one before
    it only; a batch that is run again writes the same. With the ``path`` of an earlier run the stream goes
    on from there. Rows without a time aren't late.
    """
    spark, kinds = events.sparkSession, "batch_id long, n long, late long, latest double"

    def write(batch: DataFrame, i: int, folder: str) -> None:
        before = spark.read.schema(kinds).parquet(f"{folder}/rows/batch={i - 1}").first()["latest"] if i else None
        at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
        late = F.coalesce(at < before - allowed_seconds, F.lit(False)) if before is not None else F.lit(False)
        seen = Observation(f"late-{i}")
        rows = batch.withColumn("late", late).observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late"), F.max(at).alias("latest"))
        rows.write.mode("overwrite").parquet(f"{folder}/events/batch={i}")
        found = seen.get
        latest = max((x for x in (before, found["latest"]) if x is not None), default=None)
        spark.createDataFrame([(i, found["n"], found["late"], latest)], kinds).write.mode("overwrite").parquet(f"{folder}/rows/batch={i}")

    path = run_batches(events, name, "append", write, path)
    return spark.read.schema(kinds).option("recursiveFileLookup", True).parquet(f"{path}/rows").drop("latest")
