"""Queries over recordings: words, turns, segments, chunks, clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import actions, labels, speech
from ..scratch import written
from . import fixtures as fx
from .registry import query

ASSIGNED = """a AS (
  SELECT w.video_id, w.turn, w.word_no, w."start", w."end", w.text, coalesce(arg_min(t.speaker, t.turn_no), 'UNKNOWN') AS speaker
  FROM fx_words w LEFT JOIN fx_speaker_turns t ON t.video_id = w.video_id AND w."start" + (w."end" - w."start") / 2 BETWEEN t."start" AND t."end" GROUP BY ALL)"""
SEGMENTS = (
    ASSIGNED
    + """, n AS (SELECT *, row_number() OVER o AS no, CASE WHEN lag(speaker) OVER o IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS new FROM a
  WINDOW o AS (PARTITION BY video_id ORDER BY "start", turn, word_no)),
m AS (SELECT *, (sum(new) OVER (PARTITION BY video_id ORDER BY no) - 1)::INT AS seg_no FROM n),
s AS (SELECT video_id, seg_no, arg_min("start", no) AS "start", arg_max("end", no) AS "end", speaker, string_agg(text, ' ' ORDER BY no) AS text FROM m GROUP BY video_id, seg_no, speaker),
c AS (SELECT *, (sum(gap) OVER (PARTITION BY video_id ORDER BY seg_no))::INT AS chunk_no FROM (
  SELECT *, CASE WHEN "start" - lag("end") OVER (PARTITION BY video_id ORDER BY seg_no) > 1.0 THEN 1 ELSE 0 END AS gap FROM s)),
q AS (SELECT video_id, speaker, sum(len(string_split(text, ' ')))::BIGINT AS n_words, min(seg_no) AS first_seg FROM s WHERE speaker <> 'UNKNOWN' GROUP BY ALL),
r AS (SELECT video_id, speaker, n_words, CASE row_number() OVER (PARTITION BY video_id ORDER BY n_words DESC, first_seg) WHEN 1 THEN 'STUDENT' WHEN 2 THEN 'PATIENT' ELSE 'UNKNOWN' END AS role FROM q),
e AS (SELECT c.*, coalesce(r.role, 'UNKNOWN') AS speaker_role, CASE c.seg_no % 4 WHEN 0 THEN 'ang' WHEN 1 THEN 'hap' WHEN 2 THEN 'neu' ELSE 'sad' END AS emotion_label, (c.seg_no % 7) / 7.0::DOUBLE AS emotion_score
  FROM c LEFT JOIN r USING (video_id, speaker))"""
)


def _words(spark, d):
    return speech.assign_speakers(fx.words(spark, d), fx.speaker_turns(spark, d))


def _chunks(spark, d):
    return speech.conversation_chunks(speech.diarized_segments(_words(spark, d)))


def _turns(spark, d):
    """Segments with roles and emotions, as a model would have labelled them."""
    label = F.element_at(F.array(*[F.lit(x) for x in ("ang", "hap", "neu", "sad")]), F.col("seg_no") % 4 + 1)
    return speech.with_roles(_chunks(spark, d)).withColumn("emotion_label", label).withColumn("emotion_score", F.col("seg_no") % 7 / 7.0)


@query(f"WITH {ASSIGNED} SELECT * FROM a")
def words_to_speakers(spark, d):
    return _words(spark, d)


@query(f"WITH {SEGMENTS} SELECT * FROM s")
def diarized_segments(spark, d):
    return speech.diarized_segments(_words(spark, d))


@query(f'WITH {SEGMENTS} SELECT video_id, seg_no, "start", "end", speaker, chunk_no FROM c')
def conversation_chunks(spark, d):
    return _chunks(spark, d).select("video_id", "seg_no", "start", "end", "speaker", "chunk_no")


@query(f"WITH {SEGMENTS} SELECT video_id, speaker, n_words FROM q")
def speaker_word_counts(spark, d):
    return speech.speaker_word_counts(speech.diarized_segments(_words(spark, d))).select("video_id", "speaker", "n_words")


@query(f"WITH {SEGMENTS} SELECT * FROM r")
def speaker_roles(spark, d):
    return speech.speaker_roles(speech.diarized_segments(_words(spark, d)))


@query(f"""WITH {SEGMENTS}, k AS (SELECT *, CASE WHEN speaker_role <> 'STUDENT' THEN NULL ELSE list_position(['ang', 'hap', 'sad', 'neu'], emotion_label) END AS k FROM e)
SELECT video_id, chunk_no, coalesce(CASE arg_min(emotion_label, k * 100000 + seg_no) WHEN 'ang' THEN 'ANGRY' WHEN 'hap' THEN 'HAPPY' WHEN 'sad' THEN 'SAD' ELSE 'NEUTRAL' END, 'NEUTRAL') AS emotion,
  coalesce(arg_min(emotion_score, k * 100000 + seg_no), 0.5) AS confidence FROM k GROUP BY video_id, chunk_no""")
def chunk_emotion(spark, d):
    return speech.chunk_emotion(_turns(spark, d))


@query(f"""WITH {SEGMENTS} SELECT video_id, chunk_no, arg_min("start", seg_no) AS "start", arg_max("end", seg_no) AS "end", string_agg(speaker_role || ': ' || text, E'\\n' ORDER BY seg_no) AS transcript FROM e GROUP BY ALL""")
def chunk_transcript(spark, d):
    return speech.chunk_transcript(_turns(spark, d))


@query(f"""WITH {SEGMENTS} SELECT video_id, seg_no, trunc("start" * 16000)::BIGINT AS start_sample, trunc("end" * 16000)::BIGINT AS end_sample,
  trunc("end" * 16000)::BIGINT - trunc("start" * 16000)::BIGINT <= 400 AS too_short FROM s""")
def sample_offsets(spark, d):
    return speech.sample_offsets(speech.diarized_segments(_words(spark, d))).select("video_id", "seg_no", "start_sample", "end_sample", "too_short")


@query(f"""WITH {SEGMENTS} SELECT video_id, seg_no, CASE emotion_label WHEN 'ang' THEN 'ANGRY' WHEN 'hap' THEN 'HAPPY' WHEN 'sad' THEN 'SAD' ELSE 'NEUTRAL' END AS emotion FROM e""")
def emotion_names(spark, d):
    return _turns(spark, d).select("video_id", "seg_no", speech.emotion_name(F.col("emotion_label")).alias("emotion"))


MERGED = """n AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY video_id ORDER BY clip_no) <> label THEN 1 ELSE 0 END AS new FROM fx_clips),
m AS (SELECT *, (sum(new) OVER (PARTITION BY video_id ORDER BY clip_no))::INT AS action_no FROM n),
a AS (SELECT video_id, action_no, label, arg_min("start", clip_no) AS "start", arg_max("end", clip_no) AS "end" FROM m GROUP BY ALL)"""


@query(f"WITH {MERGED} SELECT * FROM a")
def merge_actions(spark, d):
    return actions.merge_actions(fx.clips(spark, d))


@query(f"""WITH {MERGED}, g AS (SELECT video_id, label, sum("end" - "start") AS s FROM a GROUP BY ALL)
SELECT video_id, label, round(s, 3) AS seconds, round(s / sum(s) OVER (PARTITION BY video_id), 6) AS share FROM g""")
def action_durations(spark, d):
    rows = actions.action_durations(actions.merge_actions(fx.clips(spark, d)))
    return rows.select("video_id", "label", F.round("seconds", 3).alias("seconds"), F.round("share", 6).alias("share"))


@query(f"""WITH {MERGED}, g AS (SELECT *, first_value(CASE WHEN label = 'purchase' THEN "start" END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY action_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - "end" AS g FROM a)
SELECT video_id, action_no, round(g, 3) AS gap, g <= 3600.0 AS is_within FROM g WHERE label = 'click' AND g IS NOT NULL""")
def action_gaps(spark, d):
    rows = actions.action_gaps(actions.merge_actions(fx.clips(spark, d)), "click", "purchase", 3600.0)
    return rows.withColumn("gap", F.round("gap", 3))


WINDOWS = """v AS (SELECT id AS video_id, CASE WHEN frames > 0 AND fps > 0 THEN frames / fps ELSE 0.0 END AS duration FROM fx_videos WHERE fps > 0),
w AS (SELECT video_id, duration, i AS clip_no, greatest(0.0, least(duration, i * ((duration + 48.0) / 25 - 2.0))) AS a, (duration + 48.0) / 25 AS n FROM v, range(25) t(i)),
c AS (SELECT video_id, duration, clip_no::INT AS clip_no, round(a, 2) AS "start", round(CASE WHEN clip_no = 24 THEN duration ELSE least(duration, a + n) END, 2) AS "end" FROM w)"""


def _durations(spark, d):
    v = fx.videos(spark, d).filter("fps > 0")
    return v.select(F.col("id").alias("video_id"), F.when((F.col("frames") > 0) & (F.col("fps") > 0), F.col("frames") / F.col("fps")).otherwise(0.0).alias("duration"))


@query(f'WITH {WINDOWS} SELECT video_id, clip_no, "start", "end" FROM c')
def clip_windows(spark, d):
    return actions.clip_windows(_durations(spark, d))


@query(f"""WITH {WINDOWS}, s AS (SELECT video_id, clip_no, i::INT AS i, duration, "start" AS a, "end" AS b, "start" + (i + 0.5) * (("end" - "start") / 9) AS t FROM c, range(9) r(i))
SELECT video_id, clip_no, i, round(CASE WHEN b - a < 1e-5 THEN greatest(0.0, CASE WHEN a >= duration AND duration > 0 THEN duration - 0.001 WHEN a >= duration THEN 0.0 ELSE a END)
  ELSE greatest(a, least(CASE WHEN t >= duration AND duration > 0 THEN duration - 0.001 WHEN t >= duration THEN 0.0 ELSE t END, CASE WHEN b > a THEN b - 1e-6 ELSE b END)) END, 4) AS t FROM s""")
def clip_sample_times(spark, d):
    return actions.clip_sample_times(actions.clip_windows(_durations(spark, d), keep=("duration",)), 9).withColumn("t", F.round("t", 4))


@query("""RECURSIVE WITH f AS (SELECT video_id, timestamp, row_number() OVER (PARTITION BY video_id ORDER BY timestamp) AS k FROM fx_frames),
g AS (SELECT video_id, k, timestamp, timestamp AS kept, TRUE AS is_kept FROM f WHERE k = 1
  UNION ALL SELECT f.video_id, f.k, f.timestamp, CASE WHEN f.timestamp >= g.kept + 1.0 / 0.0005 THEN f.timestamp ELSE g.kept END, f.timestamp >= g.kept + 1.0 / 0.0005 FROM g JOIN f ON f.video_id = g.video_id AND f.k = g.k + 1)
SELECT video_id, round(timestamp, 6) AS timestamp FROM g WHERE is_kept""")
def sample_frames(spark, d):
    return actions.sample_frames(fx.frames(spark, d), 0.0005).withColumn("timestamp", F.round("timestamp", 6))


@query("SELECT video_id, round(min(timestamp), 6) AS timestamp FROM fx_frames GROUP BY video_id, floor(timestamp * 0.0005)")
def sample_frames_even(spark, d):
    return actions.sample_frames_even(fx.frames(spark, d), 0.0005).withColumn("timestamp", F.round("timestamp", 6))


@query("""WITH m AS (SELECT f.video_id, c.clip_no, f.frame_no, (row_number() OVER (PARTITION BY f.video_id, c.clip_no ORDER BY f.timestamp, f.frame_no) - 1)::INT AS i
  FROM fx_frames f JOIN fx_clips c ON c.video_id = f.video_id AND f.timestamp BETWEEN c."start" AND c."end")
SELECT *, (i // 3)::INT AS "row", i % 3 AS col FROM m""")
def frames_to_clips(spark, d):
    return actions.frames_to_clips(fx.frames(spark, d), fx.clips(spark, d), 3)


TRANSITIONS = """k AS (SELECT a.label_id AS from_id, b.label_id AS to_id, a.label, count(*) OVER (PARTITION BY a.label_id) AS k,
  EXISTS (SELECT 1 FROM fx_successors s WHERE s.label = a.label AND s.next_label = b.label) AS ok FROM fx_labels a, fx_labels b),
c AS (SELECT *, max((from_id = to_id AND ok)::INT) OVER w AS loops, sum((from_id <> to_id AND ok)::INT) OVER w AS others FROM k WINDOW w AS (PARTITION BY from_id)),
p AS (SELECT from_id, to_id, CASE WHEN from_id = to_id THEN CASE WHEN others = 0 THEN 1 - (k - 1) * 1e-9 WHEN loops = 1 THEN 0.5 ELSE 1e-9 END
  WHEN ok THEN CASE WHEN loops = 1 THEN 0.5 / others ELSE (1 - 1e-9) / others END ELSE 1e-9 END AS p FROM c)"""


@query(f"WITH {TRANSITIONS} SELECT from_id, to_id, round(p / sum(p) OVER (PARTITION BY from_id), 12) AS p FROM p")
def transition_matrix(spark, d):
    return actions.transition_matrix(fx.labels(spark, d), fx.successors(spark, d)).withColumn("p", F.round("p", 12))


@query("SELECT video_id, clip_no, label_id, round(CASE WHEN c.label = l.label THEN ln(0.8) ELSE ln(0.2 / 4) END, 9) AS logp FROM fx_clips c, fx_labels l")
def emission_matrix(spark, d):
    return actions.emission_scores(fx.clips(spark, d), fx.labels(spark, d)).withColumn("logp", F.round("logp", 9))


#: Whole multiples of 2 ** -20 as in the library; forward over the clips, then back over the best states before.
DECODED = TRANSITIONS + """, n AS (SELECT (SELECT count(*) FROM fx_labels)::INT AS k),
t AS MATERIALIZED (SELECT list(list ORDER BY to_id) AS t FROM (SELECT to_id, list(round(ln(p / total + 1e-12) * 1048576)::BIGINT ORDER BY from_id) AS list FROM (SELECT *, sum(p) OVER (PARTITION BY from_id) AS total FROM p) GROUP BY to_id)),
e AS MATERIALIZED (SELECT video_id, clip_no, list_transform(range(k), lambda j: CASE WHEN j = label_id THEN round(ln(0.8) * 1048576)::BIGINT ELSE round(ln((1 - 0.8) / (k - 1)) * 1048576)::BIGINT END) AS e
  FROM fx_clips JOIN fx_labels USING (label), n),
f AS (SELECT video_id, clip_no, e AS score, NULL::BIGINT[] AS back FROM e WHERE clip_no = 0
  UNION ALL SELECT video_id, clip_no, list_transform(best, lambda b, j: list_max(b) + e[j]), list_transform(best, lambda b: list_position(b, list_max(b)))
  FROM (SELECT e.video_id, e.clip_no, e.e, list_transform(t.t, lambda col: list_transform(col, lambda x, i: f.score[i] + x)) AS best FROM f JOIN e ON e.video_id = f.video_id AND e.clip_no = f.clip_no + 1, t)),
g AS (SELECT video_id, clip_no, list_position(score, list_max(score))::BIGINT AS state, back FROM f QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY clip_no DESC) = 1
  UNION ALL SELECT f.video_id, f.clip_no, g.back[g.state], f.back FROM g JOIN f ON f.video_id = g.video_id AND f.clip_no = g.clip_no - 1),
s AS (SELECT c.video_id, c.clip_no, l.label, c."start", c."end" FROM g JOIN fx_labels l ON l.label_id = g.state - 1 JOIN fx_clips c ON c.video_id = g.video_id AND c.clip_no = g.clip_no)"""


@query(f"RECURSIVE WITH {DECODED} SELECT * FROM s")
def viterbi_smooth(spark, d):
    return actions.viterbi_smooth(fx.clips(spark, d), fx.labels(spark, d), fx.successors(spark, d))


@query(f"""RECURSIVE WITH {DECODED}, m AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY video_id ORDER BY clip_no) <> label THEN 1 ELSE 0 END AS new FROM s),
a AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY clip_no) AS action_no FROM m)
SELECT video_id, label AS action_label, arg_min("start", clip_no) AS start_time, arg_max("end", clip_no) AS end_time FROM a GROUP BY video_id, action_no, label""")
def label_output(spark, d):
    return actions.merge_actions(viterbi_smooth(spark, d)).select("video_id", F.col("label").alias("action_label"), F.col("start").alias("start_time"), F.col("end").alias("end_time"))


@query("SELECT label_id, label FROM fx_labels")
def distinct_labels(spark, d):
    return fx.labels(spark, d)


@query("SELECT (row_number() OVER (ORDER BY p_name) - 1)::BIGINT AS label_id, p_name AS label FROM (SELECT DISTINCT p_name FROM part)")
def label_ids(spark, d):
    return labels.label_map(fx.table(spark, d, "part"), "p_name", 5000)


@query("SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, count(DISTINCT event_type) AS labels FROM events GROUP BY 1")
def label_counts_by_month(spark, d):
    """Sketches of each day's labels, kept in a table and merged by month; the count is exact for so few labels."""
    days = fx.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    kept = written(labels.label_sketches(days, "event_type", ["day"]), "sketches")
    return labels.distinct_estimates(kept.withColumn("month", F.date_format("day", "yyyy-MM")), ["month"])
