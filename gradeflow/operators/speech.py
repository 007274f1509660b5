"""Timed words and speaker turns: alignment, segments, conversation chunks, roles, emotions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import within

UNKNOWN = "UNKNOWN"


def assign_speakers(words: DataFrame, turns: DataFrame, bucket: float = 10.0) -> DataFrame:
    """``words`` (video_id, word_no, start, end, text, ...) with ``speaker``.

    The speaker of the first turn (by turn_no) whose [start, end] holds the word's midpoint, else
    UNKNOWN. Each distinct midpoint of a recording is looked up once, in nested cells of time, so
    that turns of any length are a few rows. Repeated rows of words are kept.
    """
    middle = F.col("start") + (F.col("end") - F.col("start")) / 2
    rows = words.withColumn("_middle", middle)
    spans = turns.select("video_id", "turn_no", F.col("speaker").alias("_speaker"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    met = within(rows.select("video_id", "_middle").distinct(), F.col("_middle"), spans, "video_id", bucket, "_start", "_end")
    first = met.groupBy("video_id", "_middle").agg(F.min(F.struct("turn_no", "_speaker")).alias("_first"))
    found = rows.join(first, ["video_id", "_middle"], "left")
    return found.select(*words.columns, F.coalesce(F.col("_first._speaker"), F.lit(UNKNOWN)).alias("speaker"))


def diarized_segments(words: DataFrame, order: tuple[str, ...] = ("start", "turn", "word_no")) -> DataFrame:
    """(video_id, seg_no, start, end, speaker, text): consecutive words of one speaker, joined by spaces; end of the last word."""
    by_time = Window.partitionBy("video_id").orderBy(*order)
    change = (~F.lag("speaker").over(by_time).eqNullSafe(F.col("speaker"))) | F.lag("video_id").over(by_time).isNull()
    rows = words.withColumn("_no", F.row_number().over(by_time)).withColumn("_new", change.cast("int"))
    rows = rows.withColumn("seg_no", (F.sum("_new").over(by_time) - 1).cast("int"))
    parts = rows.groupBy("video_id", "seg_no", "speaker").agg(F.min_by("start", "_no").alias("start"), F.max_by("end", "_no").alias("end"), F.array_sort(F.collect_list(F.struct("_no", "text"))).alias("_w"))
    return parts.select("video_id", "seg_no", "start", "end", "speaker", F.array_join(F.transform("_w", lambda w: w["text"]), " ").alias("text"))


def conversation_chunks(segments: DataFrame, gap: float = 1.0) -> DataFrame:
    """``segments`` with ``chunk_no``: a new chunk where the start lies more than ``gap`` after the previous segment's end."""
    order = Window.partitionBy("video_id").orderBy("seg_no")
    new = F.coalesce((F.col("start") - F.lag("end").over(order) > gap).cast("int"), F.lit(0))
    return segments.withColumn("_new", new).withColumn("chunk_no", F.sum("_new").over(order).cast("int")).drop("_new")


def speaker_word_counts(segments: DataFrame) -> DataFrame:
    """(video_id, speaker, n_words, first_seg) of the known speakers."""
    n = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return segments.filter(F.col("speaker") != UNKNOWN).groupBy("video_id", "speaker").agg(F.sum(n).alias("n_words"), F.min("seg_no").alias("first_seg"))


def speaker_roles(segments: DataFrame) -> DataFrame:
    """(video_id, speaker, n_words, role): most words STUDENT, then PATIENT, others UNKNOWN; ties by first appearance."""
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("n_words"), "first_seg"))
    role = F.when(rank == 1, "STUDENT").when(rank == 2, "PATIENT").otherwise(UNKNOWN)
    return speaker_word_counts(segments).select("video_id", "speaker", "n_words", role.alias("role"))


def with_roles(segments: DataFrame) -> DataFrame:
    roles = speaker_roles(segments).select("video_id", "speaker", F.col("role").alias("speaker_role"))
    return segments.join(roles, ["video_id", "speaker"], "left").withColumn("speaker_role", F.coalesce("speaker_role", F.lit(UNKNOWN)))


# Emotion codes, their names and the order in which they decide.
EMOTIONS = {"ang": "ANGRY", "hap": "HAPPY", "neu": "NEUTRAL", "sad": "SAD"}
PRIORITY = ("ang", "hap", "sad")


def emotion_name(code) -> F.Column:
    out = F.lit(None).cast("string")
    for k, v in EMOTIONS.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def chunk_emotion(segments: DataFrame) -> DataFrame:
    """(video_id, chunk_no, emotion, confidence): the student's first turn of the highest-ranking emotion; else the first neutral one; else neutral, 0.5.

    A missing score counts 0.5 for a neutral turn, else 0.
    """
    rank = F.lit(None).cast("int")
    for i, code in enumerate((*PRIORITY, "neu")):
        rank = F.when(F.col("emotion_label") == code, i).otherwise(rank)
    rank = F.when(F.col("speaker_role") == "STUDENT", rank)
    best = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("seg_no"), F.col("emotion_label"), F.col("emotion_score")))).alias("b")
    rows = segments.groupBy("video_id", "chunk_no").agg(best)
    return rows.select("video_id", "chunk_no", F.coalesce(emotion_name(F.col("b.emotion_label")), F.lit("NEUTRAL")).alias("emotion"), F.when(F.col("b").isNull(), 0.5).otherwise(F.coalesce(F.col("b.emotion_score"), F.when(F.col("b.emotion_label") == "neu", 0.5).otherwise(0.0))).alias("confidence"))


def chunk_transcript(segments: DataFrame) -> DataFrame:
    """(video_id, chunk_no, start, end, transcript): ``ROLE: text`` lines in order; start of the first, end of the last segment."""
    line = F.struct("seg_no", F.concat("speaker_role", F.lit(": "), "text").alias("line"))
    rows = segments.groupBy("video_id", "chunk_no").agg(F.min_by("start", "seg_no").alias("start"), F.max_by("end", "seg_no").alias("end"), F.array_sort(F.collect_list(line)).alias("l"))
    return rows.select("video_id", "chunk_no", "start", "end", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("transcript"))


def sample_offsets(segments: DataFrame, rate: int = 16000, least: int = 400) -> DataFrame:
    """With start_sample and end_sample (truncated) and too_short."""
    a, b = (F.col("start") * rate).cast("long"), (F.col("end") * rate).cast("long")
    return segments.withColumn("start_sample", a).withColumn("end_sample", b).withColumn("too_short", (b - a) <= least)
