"""Recordings of any length: decoding, sampling and interval joins cut into ranges give what one pass gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeflow.operators import actions, intervals, speech

CLIPS = "video_id string, clip_no int, label string, start double, end double"


@pytest.fixture(scope="module")
def vocabulary(spark):
    names = ["a", "b", "c", "d"]
    labels = spark.createDataFrame(list(enumerate(names)), "label_id int, label string")
    nexts = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "c"), ("b", "a"), ("c", "d"), ("d", "a"), ("d", "b")], "label string, next_label string")
    return labels, nexts


def test_decoding_in_ranges_is_decoding_in_one_pass(spark, vocabulary):
    """One recording in a hundred ranges, others in one; unknown labels; many equal paths."""
    rng = random.Random(1)
    rows = [("long", i, rng.choice("abcdx"), float(i), i + 2.0) for i in range(1000)] + [("flat", i, "x", float(i), i + 1.0) for i in range(300)]
    rows += [(f"v{k}", i, rng.choice("abcd"), float(i), i + 1.0) for k in range(5) for i in range(9)] + [(None, i, rng.choice("abcd"), 0.0, 1.0) for i in range(40)]
    rng.shuffle(rows)
    clips = spark.createDataFrame(rows, CLIPS)
    plain = lambda found: sorted(map(tuple, found.collect()), key=str)
    whole = plain(actions.viterbi_smooth(clips, *vocabulary))
    assert plain(actions.viterbi_smooth(clips, *vocabulary, most=10)) == whole
    assert len(whole) == len(rows) and len({r[2] for r in whole}) > 1
    assert actions.viterbi_smooth(clips.limit(0), *vocabulary, most=10).count() == 0


def test_decoding_in_units_finds_a_best_path(spark, vocabulary):
    """The likelihood of the decoded labels is that of an exhaustive search, in plain logarithms."""
    import itertools

    rng = random.Random(2)
    p = {(r["from_id"], r["to_id"]): r["p"] for r in actions.transition_matrix(*vocabulary).collect()}
    for k in range(4):
        seen = [rng.randrange(4) for _ in range(6)]
        clips = spark.createDataFrame([("v", i, "abcd"[s], 0.0, 1.0) for i, s in enumerate(seen)], CLIPS)
        path = ["abcd".index(r["label"]) for r in actions.viterbi_smooth(clips, *vocabulary, most=2).orderBy("clip_no").collect()]
        value = lambda way: sum(np.log(0.8 if a == b else 0.2 / 3) for a, b in zip(way, seen)) + sum(np.log(p[x] + 1e-12) for x in itertools.pairwise(way))  # noqa: B023, E731
        assert abs(value(path) - max(map(value, itertools.product(range(4), repeat=6)))) < 1e-4


def test_products_are_associative_and_borders_agree():
    rng = np.random.default_rng(3)
    e, t = rng.integers(-3, 1, (30, 3)), rng.integers(-3, 1, (3, 3))
    whole = actions.path_product(e, t, True)
    parts = [actions.path_product(e[:11], t, True), actions.path_product(e[11:20], t, False), actions.path_product(e[20:], t, False)]
    joined = parts[0]
    for m in parts[1:]:
        joined = (joined[:, :, None] + m).max(1)
    assert (joined == whole).all()
    path, start = actions.best_path(e, t), parts[0][0]
    assert actions.states_before(e[11:], t, start)[path[-1]] == path[10]
    assert (actions.best_path(e[11:], t, start, path[-1]) == path[11:]).all()


def test_sampling_in_ranges_is_sampling_in_one_pass(spark):
    rng = random.Random(4)
    times = {"even": [i / 7 for i in range(600)], "bursts": [rng.randrange(40) + rng.random() / 9 for _ in range(700)], "same": [5.0] * 90, "gaps": [rng.expovariate(0.3) * i for i in range(300)], "few": [3.0, 1.0], None: [rng.uniform(0, 60) for _ in range(200)]}
    frames = spark.createDataFrame([(v, t) for v, ts in times.items() for t in [*ts, None]], "video_id string, timestamp double")
    plain = lambda found: sorted(map(tuple, found.collect()), key=str)
    for rate in (1.0, 0.3, 10.0):
        want = []
        for v, ts in times.items():
            last = None
            for t in sorted(ts):
                if last is None or t >= last + 1 / rate:
                    want.append((v, t))
                    last = t
        assert plain(actions.sample_frames(frames, rate)) == sorted(want, key=str)
        assert plain(actions.sample_frames(frames, rate, most=25)) == sorted(want, key=str)
    assert actions.sample_frames(frames.limit(0), 1.0, most=25).count() == 0


def test_cover_is_exact_and_small(spark):
    rng = random.Random(5)
    spans = [(i, float(a), float(a + rng.choice([0, 1, 5, 30, 1000, 10**9]))) for i, a in enumerate(rng.randrange(-100, 100) for _ in range(60))] + [(90, 1.0, float("inf")), (91, 5.0, 4.0), (92, None, 1.0)]
    rows = intervals.cover(spark.createDataFrame(spans, "id int, a double, b double"), "a", "b", 1.0).collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append((r["_level"], r["_cell"]))
    assert 91 not in by and 92 not in by
    for i, a, b in spans[:60]:
        assert all(sum(x[0] == level for x in by[i]) <= 2 for level, _ in by[i])
        ends = sorted((c << level, (c + 1) << level) for level, c in by[i])
        assert ends[0][0] == int(a) and ends[-1][1] == int(b) + 1 and all(x[1] == y[0] for x, y in zip(ends, ends[1:]))


def test_points_in_intervals_equal_brute_force(spark):
    rng = random.Random(6)
    turns = [(v, n, rng.choice("PQR"), a, a + rng.choice([0.0, 0.5, 8.0, 90.0, 1e9])) for v in (1, 2, None) for n in range(12) for a in [rng.uniform(-50, 300)]] + [(1, 50, "Z", 400.0, float("inf")), (1, 51, "Y", 9.0, 3.0), (2, 52, "Y", None, 3.0)]
    words = [(v, i, a, a + 0.4, "w") for v in (1, 2, 3, None) for i in range(80) for a in [rng.choice([rng.uniform(-60, 500), 8.0, 1e12])]] + [(1, 90, None, 3.0, "w")]
    words += words[:40]
    found = speech.assign_speakers(spark.createDataFrame(words, "video_id int, word_no int, start double, end double, text string"), spark.createDataFrame(turns, "video_id int, turn_no int, speaker string, start double, end double"))
    want = []
    for w in words:
        t = None if w[2] is None else w[2] + (w[3] - w[2]) / 2
        met = sorted((x[1], x[2]) for x in turns if t is not None and x[0] is not None and x[0] == w[0] and x[3] is not None and x[3] <= t <= x[4])
        want.append((*w, met[0][1] if met else "UNKNOWN"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_a_turn_with_a_wrong_end_is_a_few_rows(spark):
    turns = spark.createDataFrame([(1, 0, "A", 3.0, 1e9)], "video_id int, turn_no int, speaker string, start double, end double")
    assert intervals.cover(turns, "start", "end", 10.0).count() < 60
    frames = spark.createDataFrame([(1, 0, 2.0), (1, 1, 5.0), (1, 2, 999999999.0), (1, 3, 1e9 + 1), (1, 4, None)], "video_id int, frame_no int, timestamp double")
    clips = turns.select("video_id", F.lit(7).alias("clip_no"), "start", "end")
    assert sorted((r["frame_no"], r["i"], r["row"], r["col"]) for r in actions.frames_to_clips(frames, clips, 2).collect()) == [(1, 0, 0, 0), (2, 1, 0, 1)]
    assert actions.frames_to_clips(frames, clips.limit(0), 2).count() == 0


def test_means_of_many_recordings_at_once_are_those_of_each(spark):
    """Two long recordings in packs of a few frames, with equal vectors, and short ones beside them."""
    from gradeflow.operators import vectors

    rng = np.random.default_rng(7)
    middles = rng.standard_normal((6, 5)) * 4
    rows = [(v, f"f{i:03d}", float(rng.integers(0, 50)), (middles[rng.integers(6)] + rng.standard_normal(5) * 0.3).round(2).tolist()) for v, n in ((1, 130), (2, 90), (3, 20), (4, 3)) for i in range(n)]
    rows += [(1, f"g{i}", 7.0, rows[5][3]) for i in range(20)] + [(1, "none", 1.0, None), (None, "x", 1.0, rows[0][3])]
    points = spark.createDataFrame(rows, "video_id int, id string, timestamp double, clip_vec array<double>")
    plain = lambda found: sorted(map(tuple, found.collect()))
    whole = plain(vectors.keyframes(points, 4))
    assert plain(vectors.keyframes(points, 4, most=30)) == whole
    assert {v: sum(r[0] == v for r in whole) for v in (1, 2, 3, 4)} == {1: 4, 2: 4, 3: 4, 4: 3}
