"""Labelled clips of recordings: merging, durations, gaps, windows, sampling, decoding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .intervals import within
from .ranges import by_length, in_ranges, like


def merge_actions(clips: DataFrame) -> DataFrame:
    """(video_id, action_no, label, start, end): consecutive clips of one label; the first start and the last end."""
    order = Window.partitionBy("video_id").orderBy("clip_no")
    new = F.coalesce((F.lag("label").over(order) != F.col("label")).cast("int"), F.lit(0))
    rows = clips.withColumn("_new", new).withColumn("action_no", F.sum("_new").over(order).cast("int"))
    return rows.groupBy("video_id", "action_no", "label").agg(F.min_by("start", "clip_no").alias("start"), F.max_by("end", "clip_no").alias("end"))


def action_durations(actions: DataFrame) -> DataFrame:
    """(video_id, label, seconds, share) of the time of all actions of a recording."""
    rows = actions.groupBy("video_id", "label").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))
    return rows.withColumn("share", F.col("seconds") / F.sum("seconds").over(Window.partitionBy("video_id")))


def action_gaps(actions: DataFrame, first: str, then: str, within: float) -> DataFrame:
    """(video_id, action_no, gap, is_within): from the end of each ``first`` action to the start of the next ``then`` action."""
    order = Window.partitionBy("video_id").orderBy("action_no").rowsBetween(1, Window.unboundedFollowing)
    after = F.first(F.when(F.col("label") == then, F.col("start")), ignorenulls=True).over(order)
    rows = actions.withColumn("gap", after - F.col("end")).filter((F.col("label") == first) & F.col("gap").isNotNull())
    return rows.select("video_id", "action_no", "gap", (F.col("gap") <= within).alias("is_within"))


def video_metadata(videos: DataFrame) -> DataFrame:
    """``videos`` (frames, fps, width, height) with duration (frames / fps to 3 places; 0 without both), and bad_fps, bad_frames, bad_resolution: not above 0, or missing."""
    bad = lambda c: ~F.coalesce(F.col(c) > 0, F.lit(False))
    duration = F.when(~bad("frames") & ~bad("fps"), F.round(F.col("frames") / F.col("fps"), 3)).otherwise(0.0)
    return videos.withColumns({"duration": duration, "bad_fps": bad("fps"), "bad_frames": bad("frames"), "bad_resolution": bad("width") | bad("height")})


def clip_windows(videos: DataFrame, n: int = 25, stride: float = 2.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(video_id, clip_no, start, end) and the columns of ``videos`` to ``keep``: n overlapping clips of (D + (n - 1) s) / n seconds over ``duration``, rounded to 2; the last ends at D."""
    length = (F.col("duration") + (n - 1) * stride) / n
    rows = videos.select("*", length.alias("_len"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("clip_no"))
    start = F.greatest(F.lit(0.0), F.least(F.col("duration"), F.col("clip_no") * (F.col("_len") - stride)))
    end = F.when(F.col("clip_no") == n - 1, F.col("duration")).otherwise(F.least(F.col("duration"), start + F.col("_len")))
    return rows.select("video_id", "clip_no", F.round(start, 2).alias("start"), F.round(end, 2).alias("end"), *keep)


def clip_sample_times(clips: DataFrame, k: int) -> DataFrame:
    """(video_id, clip_no, i, t): midpoints of k equal parts of each clip, kept inside the recording (``duration``) and the clip; an empty clip repeats one time."""
    rows = clips.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    d, a, b = F.col("duration"), F.col("start"), F.col("end")
    inside = lambda t: F.when((t >= d) & (d > 0), d - 0.001).when(t >= d, 0.0).otherwise(t)
    flat = F.greatest(F.lit(0.0), inside(a))
    t = inside(F.greatest(F.lit(0.0), a + (F.col("i") + 0.5) * ((b - a) / k)))
    t = F.greatest(a, F.least(t, F.when(b > a, b - 1e-6).otherwise(b)))
    return rows.select("video_id", "clip_no", "i", F.when(b - a < 1e-5, flat).otherwise(t).alias("t"))


def kept_from(times: np.ndarray, last: float, step: float) -> list[float]:
    """Of sorted times those kept after ``last``: each at least ``step`` after the one before."""
    kept: list[float] = []
    at = int(np.searchsorted(times, last + step, "left"))
    while at < len(times):
        kept.append(times[at])
        at = max(at + 1, int(np.searchsorted(times, times[at] + step, "left")))
    return kept


def sample_frames(frames: DataFrame, rate: float = 1.0, most: int = 1_000_000) -> DataFrame:
    """(video_id, timestamp): the first frame, then each that lies at least 1 / rate after the last kept one. Frames without a time are left out.

    One pass over a recording's sorted times. A recording of more than ``most`` frames is cut into ranges
    of time: each gives, for any frame that can be the first kept one in it, the last one then kept;
    a walk over these few finds what each range starts from, and the ranges go on side by side.
    """
    step, kind = 1.0 / rate, dict(frames.dtypes)["video_id"]
    short, long = by_length(frames.select("video_id", F.col("timestamp").cast("double").alias("timestamp")).filter("timestamp is not null"), "video_id", most)

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        kept = kept_from(np.sort(rows["timestamp"].to_numpy()), -np.inf, step)
        return like(rows, ["video_id"], len(kept), timestamp=np.array(kept, float))

    found = short.groupBy("video_id").applyInPandas(keep, f"video_id {kind}, timestamp double")
    if long is None:
        return found
    dealt = in_ranges(long, "video_id", ["timestamp"], most)
    ends = exits(dealt, step, kind)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        out, last = [], -np.inf
        for number, part in rows.sort_values(["_range", "entry"]).groupby("_range"):
            out.append((number, last))
            first = part[part["entry"] >= last + step]
            last = float(first["exit"].iloc[0]) if len(first) else last
        numbers, lasts = zip(*out, strict=True)
        return like(rows, ["video_id"], len(out), _range=numbers, last=lasts)

    starts = ends.groupBy("video_id").applyInPandas(walk, f"video_id {kind}, _range int, last double")

    def go_on(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        kept = kept_from(np.sort(rows["timestamp"].to_numpy()), start["last"].iloc[0], step)
        return like(rows, ["video_id"], len(kept), timestamp=np.array(kept, float))

    by = ("video_id", "_range")
    return found.union(dealt.groupBy(*by).cogroup(starts.groupBy(*by)).applyInPandas(go_on, f"video_id {kind}, timestamp double"))


def exits(dealt: DataFrame, step: float, kind: str) -> DataFrame:
    """(video_id, _range, entry, exit): for each distinct time at which keeping can start in a range, the last time kept in it.

    These are its first time and those less than ``step`` after it: a time kept before the range is
    below its first, so its successor is no later than the first time ``step`` above that one.
    """

    def ends(rows: pd.DataFrame) -> pd.DataFrame:
        times = np.unique(rows["timestamp"].to_numpy())
        after = np.searchsorted(times, times + step, "left")
        after = np.where(after <= np.arange(len(times)), np.arange(len(times)) + 1, after)
        # each to its successor, then to the successor's, by doubling, as long as that lies in the range
        jump = np.where(after < len(times), after, np.arange(len(times)))
        while (further := jump[jump] != jump).any():
            jump = np.where(further, jump[jump], jump)
        entries = np.arange(min(int(np.searchsorted(times, times[0] + step, "left")) + 1, len(times)))
        return like(rows, ["video_id", "_range"], len(entries), entry=times[entries], exit=times[jump[entries]])

    return dealt.groupBy("video_id", "_range").applyInPandas(ends, f"video_id {kind}, _range int, entry double, exit double")


def sample_frames_even(frames: DataFrame, rate: float = 1.0) -> DataFrame:
    """(video_id, timestamp): the earliest frame of each 1 / rate seconds; the cheap form for evenly spaced frames."""
    return frames.groupBy("video_id", F.floor(F.col("timestamp") * rate).alias("_slot")).agg(F.min("timestamp").alias("timestamp")).drop("_slot")


def frames_to_clips(frames: DataFrame, clips: DataFrame, n: int, bucket: float = 30.0) -> DataFrame:
    """(video_id, clip_no, frame_no, i, row, col): frames whose time lies in a clip, in order, as cells of an n-wide grid. Clips may overlap and be of any length."""
    spans = clips.select("video_id", "clip_no", "start", "end")
    met = within(frames, F.col("timestamp"), spans, "video_id", bucket)
    i = F.row_number().over(Window.partitionBy("video_id", "clip_no").orderBy("timestamp", "frame_no")) - 1
    return met.withColumn("i", i).select("video_id", "clip_no", "frame_no", "i", F.floor(F.col("i") / n).cast("int").alias("row"), (F.col("i") % n).alias("col"))


def transition_matrix(labels: DataFrame, successors: DataFrame, p_self: float = 0.5, floor: float = 1e-9) -> DataFrame:
    """(from_id, to_id, p), rows summing to 1, for ``labels`` (label_id, label) and ``successors`` (label, next_label); a small table by nature.

    With others allowed, they share 1 - p_self if the label itself is allowed too, else 1 - floor;
    with none, the label keeps nearly all. Everything else has the floor.
    """
    to = labels.select(F.col("label_id").alias("to_id"), F.col("label").alias("next_label"))
    allowed = successors.join(to, "next_label").select("label", "to_id").distinct().withColumn("ok", F.lit(True))
    pairs = F.broadcast(labels).crossJoin(F.broadcast(to.select("to_id"))).join(allowed, ["label", "to_id"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    row = Window.partitionBy("label_id")
    k = F.count("*").over(row)
    same = F.col("to_id") == F.col("label_id")
    loops = F.max((same & F.col("ok")).cast("int")).over(row)
    others = F.sum((~same & F.col("ok")).cast("int")).over(row)
    own = F.when(others == 0, F.greatest(1 - (k - 1) * F.lit(floor), F.lit(floor))).when(loops == 1, F.lit(p_self)).otherwise(F.lit(floor))
    each = F.greatest(F.when(loops == 1, (1 - F.lit(p_self)) / others).otherwise((1 - F.lit(floor)) / others), F.lit(floor))
    p = F.when(same, own).when(F.col("ok"), each).otherwise(F.lit(floor))
    rows = pairs.withColumn("_p", p)
    return rows.select(F.col("label_id").alias("from_id"), "to_id", (F.col("_p") / F.sum("_p").over(row)).alias("p"))


def emission_scores(clips: DataFrame, labels: DataFrame, p_correct: float | None = 0.8) -> DataFrame:
    """(video_id, clip_no, label_id, logp). Soft: log p for the clip's own label, log((1 - p) / (K - 1)) for others; hard (None): 0 and -1e9."""
    k = F.count("*").over(Window.partitionBy())
    table = labels.withColumn("_k", k)
    same = F.coalesce(F.col("seen") == F.col("label"), F.lit(False))
    if p_correct is None:
        logp = F.when(same, 0.0).otherwise(-1e9)
    else:
        rest = (1.0 - p_correct) / (F.col("_k") - 1)
        wrong = F.when((F.col("_k") == 1) | F.lit(p_correct >= 1), -1e9).otherwise(F.log(rest))
        logp = F.when(same, F.log(F.lit(p_correct))).otherwise(wrong)
    return clips.select("video_id", "clip_no", F.col("label").alias("seen")).crossJoin(F.broadcast(table)).select("video_id", "clip_no", "label_id", logp.alias("logp"))


#: Log probabilities are decoded as whole multiples of 2 ** -20: their sums are exact in any order, and equal paths tie.
UNIT = 1 << 20


def in_units(p: np.ndarray | float) -> np.ndarray:
    return np.rint(np.log(p) * UNIT).astype(np.int64)


def best_path(emissions: np.ndarray, log_t: np.ndarray, start: np.ndarray | None = None, end: int | None = None) -> np.ndarray:
    """Most likely states; the lowest index on ties. Under a uniform prior, or after the scores ``start`` of the step before; up to ``end``, if given."""
    t, k = emissions.shape
    back = np.zeros((t, k), np.int64)
    score = emissions[0] if start is None else (start[:, None] + log_t).max(0) + emissions[0]
    for i in range(1, t):
        total = score[:, None] + log_t
        back[i] = total.argmax(0)
        score = total.max(0) + emissions[i]
    path = [int(score.argmax()) if end is None else end]
    for i in range(t - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    return np.array(path[::-1])


def path_product(emissions: np.ndarray, log_t: np.ndarray, first: bool) -> np.ndarray:
    """[state before, last state]: the best score of a way through some steps; ``first``: nothing comes before, and all rows are alike."""
    total = np.tile(emissions[0], (len(log_t), 1)) if first else log_t + emissions[0]
    for e in emissions[1:]:
        total = (total[:, :, None] + log_t).max(1) + e
    return total


def states_before(emissions: np.ndarray, log_t: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each last state, the state before the steps that its best way comes from, ties as in ``best_path``."""
    score, origin = start, np.arange(len(start))
    for e in emissions:
        total = score[:, None] + log_t
        origin = origin[total.argmax(0)]
        score = total.max(0) + e
    return origin


def viterbi_smooth(clips: DataFrame, labels: DataFrame, successors: DataFrame, p_correct: float = 0.8, p_self: float = 0.5, most: int = 200_000) -> DataFrame:
    """``clips`` (video_id, clip_no, label, start, end) with labels decoded along each recording, in the order of clip_no (then start, end, label).

    The label table and its matrix (K squared, K being the vocabulary) go to tasks as constants. A
    recording is a group; one of more than ``most`` clips is cut into ranges. Each gives the max-plus
    product of its steps (K squared numbers); a scan over the products has the scores at every border,
    from which each range tells where the ways to its last states come from; a scan backwards over
    these has the state at every border, and the ranges are decoded side by side. All sums are of whole
    numbers, so the path is that of one pass, ties included.
    """
    names = [r["label"] for r in labels.orderBy("label_id").collect()]
    ids = {n: i for i, n in enumerate(names)}
    matrix = np.zeros((len(names), len(names)))
    for r in transition_matrix(labels, successors, p_self).collect():
        matrix[r["from_id"], r["to_id"]] = r["p"]
    log_t = in_units(matrix + 1e-12)
    right, wrong = in_units(p_correct), in_units((1 - p_correct) / max(len(names) - 1, 1))
    order = ["clip_no", "start", "end", "label"]

    def scores(rows: pd.DataFrame) -> np.ndarray:
        seen = rows["label"].map(ids).to_numpy(float, na_value=-1)
        return np.where(seen[:, None] == np.arange(len(names)), right, wrong)

    def decode(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        return rows.assign(label=[names[i] for i in best_path(scores(rows), log_t)])

    rows = clips.select("video_id", "clip_no", "label", "start", "end")
    short, long = by_length(rows, "video_id", most)
    found = short.groupBy("video_id").applyInPandas(decode, rows.schema)
    if long is None:
        return found
    dealt, by, kind = in_ranges(long, "video_id", order, most), ("video_id", "_range"), dict(rows.dtypes)["video_id"]
    lowest = dealt.groupBy(F.col("video_id").alias("_video")).agg(F.min("_range").alias("_first"))
    dealt = dealt.join(lowest, F.col("video_id").eqNullSafe(F.col("_video"))).drop("_video")

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        first = bool(rows["_range"].iloc[0] == rows["_first"].iloc[0])
        return like(rows, ["video_id", "_range"], 1, m=[path_product(scores(rows), log_t, first).ravel()])

    def entries(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_range")
        score, out = np.zeros(len(names), np.int64), []
        for m in rows["m"]:
            out.append(score)
            score = (score[:, None] + np.reshape(m, (len(names), -1))).max(0)
        return rows[["video_id", "_range"]].assign(entry=out, last=int(score.argmax()))

    def origins(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        return entry.assign(origin=[states_before(scores(rows.sort_values(order)), log_t, np.asarray(entry["entry"].iloc[0]))])

    def borders(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_range")
        ends = [int(rows["last"].iloc[0])]
        for origin in rows["origin"].iloc[:0:-1]:
            ends.append(int(origin[ends[-1]]))
        return rows[["video_id", "_range", "entry"]].assign(end_state=ends[::-1])

    def go_on(rows: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        first = rows["_range"].iloc[0] == rows["_first"].iloc[0]
        path = best_path(scores(rows), log_t, None if first else np.asarray(border["entry"].iloc[0]), int(border["end_state"].iloc[0]))
        return rows.assign(label=[names[i] for i in path])[["video_id", "clip_no", "label", "start", "end"]]

    head = f"video_id {kind}, _range int"
    entry = dealt.groupBy(*by).applyInPandas(product, f"{head}, m array<long>").groupBy("video_id").applyInPandas(entries, f"{head}, entry array<long>, last int")
    entry = written(entry, "entries")
    origin = dealt.groupBy(*by).cogroup(entry.groupBy(*by)).applyInPandas(origins, f"{head}, entry array<long>, last int, origin array<long>")
    border = written(origin.groupBy("video_id").applyInPandas(borders, f"{head}, entry array<long>, end_state int"), "borders")
    return found.union(dealt.groupBy(*by).cogroup(border.groupBy(*by)).applyInPandas(go_on, rows.schema))
