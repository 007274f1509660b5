"""Tools, registries, payloads, sketches and rules on hand-written rows."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeflow.operators import actions, criteria, labels, rubric, tools, vectors

NEEDS = "tool string, ord int, needed string"


def walk(needs, tool):
    """Everything a tool needs, by a depth-first walk."""
    out = []

    def add(name):
        for need in needs.get(name, []):
            if need not in out:
                add(need)
                out.append(need)

    add(tool)
    return out


def closure(spark, needs):
    rows = tools.closure_of(spark.createDataFrame([(t, i, n) for t, ns in needs.items() for i, n in enumerate(ns)], NEEDS)).collect()
    return {t: [r["needed"] for r in sorted(rows, key=lambda r: r["ord"]) if r["tool"] == t] for t in {r["tool"] for r in rows}}


def test_closure_is_a_depth_first_walk(spark):
    rng = random.Random(1)
    cases = [
        {"a": ["b", "c"], "b": ["d"], "c": ["d"]},
        {f"t{i}": [f"t{i + 1}"] for i in range(20)},
        {"a": ["c", "b"], "b": ["c", "d"], "c": ["e"], "d": ["e"]},
        {f"n{i}": [f"n{j}" for j in rng.sample(range(i), min(i, 3))] for i in range(1, 14)},
    ]
    for needs in cases:
        assert closure(spark, needs) == {t: walk(needs, t) for t in needs}


def test_circles_are_named_and_nothing_needs_nothing(spark):
    with pytest.raises(ValueError, match="a, b, c"):
        closure(spark, {"a": ["b"], "b": ["c"], "c": ["a"], "x": ["a"]})
    with pytest.raises(ValueError):
        closure(spark, {"a": ["a"]})
    assert tools.closure_of(spark.createDataFrame([("a", 0, None), (None, 0, "b")], NEEDS)).count() == 0


def test_registry_reads_hits_once_a_category(spark):
    found, read = tools.Registry(), []

    @found.category("visual")
    def seen(plans):
        read.append("visual")
        return plans.select("plan_id", F.lit(3).alias("n"), F.uuid().alias("once"))

    @found.category("audio")
    def heard(plans):
        read.append("audio")
        return plans.select("plan_id", F.lit(7).alias("n"))

    rows = lambda hits: hits.select("plan_id", "n", F.col("n").alias("item_no"), F.coalesce(*[F.col(c) for c in hits.columns if c == "once"], F.col("n").cast("string")).alias("item"))
    found.tool("objects", "visual")(rows)
    found.tool("words", "audio")(rows)
    selected = spark.createDataFrame([(1, 0, "objects"), (1, 1, "words"), (1, 2, "poses"), (2, 0, "poses"), (3, 0, "gone")], "plan_id int, step int, tool string")
    assert sorted((r["plan_id"], r["tool"], r["category"], r["item_no"]) for r in found.run(selected).collect()) == [(1, "objects", "visual", 3), (1, "words", "audio", 7)]
    # a third tool, of a category that is there
    found.tool("poses", "visual")(rows)
    read.clear()
    out = found.run(selected).collect()
    assert sorted((r["plan_id"], r["step"], r["tool"]) for r in out) == [(1, 0, "objects"), (1, 1, "words"), (1, 2, "poses"), (2, 0, "poses")]
    assert read == ["visual", "audio"] and len({r["item"] for r in out if r["plan_id"] == 1 and r["category"] == "visual"}) == 1
    with pytest.raises(ValueError):
        found.tool("x", "none")
    assert tools.Registry().run(selected).count() == 0


def test_payloads_are_merged_key_by_key(spark):
    kind = "id int, payload map<string, string>"
    base = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, None), (3, {}), (4, {"a": "x"}), (5, None)], kind)
    delta = spark.createDataFrame([(1, {"b": None, "c": "3"}, 2), (1, {"b": "9", "d": "4"}, 1), (2, {"k": "v"}, 1), (3, None, 1), (9, {"z": "z"}, 1)], kind + ", version int")
    assert {r["id"]: r["payload"] for r in vectors.patch_maps(base, delta).collect()} == {1: {"a": "1", "b": None, "c": "3", "d": "4"}, 2: {"k": "v"}, 3: {}, 4: {"a": "x"}, 5: None}
    kind = "id int, payload map<string, map<string, int>>"
    base = spark.createDataFrame([(1, {"t": {"a": 1, "b": 2}, "u": {"x": 1}, "n": None})], kind)
    delta = spark.createDataFrame([(1, {"t": {"b": 3}, "u": None, "n": {"y": 2}}, 1)], kind + ", version int")
    assert vectors.patch_maps(base, delta, depth=1).first()["payload"] == {"t": {"a": 1, "b": 3}, "u": None, "n": {"y": 2}}
    assert vectors.patch_maps(base, delta).first()["payload"] == {"t": {"b": 3}, "u": None, "n": {"y": 2}}


def test_quantile_sketches_add_up(spark):
    rng = np.random.default_rng(2)
    scores = np.sort(rng.gamma(2.0, 1.0, 30000))
    hits = spark.createDataFrame([(i % 7, "d", float(s), None if i % 2 else 0.5) for i, s in enumerate(rng.permutation(scores))], "day int, query string, score double, sure double")
    kept = vectors.retrieval_summary(hits, ["query", "day"], "sure")
    assert all(r["avg_confidence"] == 0.5 and 2 * r["n_confident"] - r["n"] in (-1, 0, 1) for r in kept.collect())
    row = vectors.score_quantiles(kept, ["query"], (0.1, 0.5, 0.9)).first()
    assert row["n"] == 30000
    for rank, value in zip((0.1, 0.5, 0.9), row["quantiles"]):
        assert abs(np.searchsorted(scores, value) / 30000 - rank) < 0.03


def test_labels_have_ids_and_sketches_an_error_bound(spark):
    rows = spark.createDataFrame([(f"l{i % 900:03d}",) for i in range(3000)] + [(None,)], "name string")
    found = labels.label_map(rows, "name", size=100)
    assert [tuple(r) for r in found.orderBy("label_id").collect()] == [(i, f"l{i:03d}") for i in range(900)]
    back = labels.with_label_ids(rows, "name", found)
    assert back.count() == 3001 and back.filter("label_id is null").count() == 1
    many = spark.range(60000).select((F.col("id") % 9).alias("day"), (F.col("id") % 40000).cast("string").alias("name"))
    row = labels.distinct_estimates(labels.label_sketches(many, "name", ["day"]), []).first()
    assert row["n"] == 60000 and abs(row["labels"] / 40000 - 1) < 0.03
    assert labels.label_map(rows.limit(0), "name").count() == 0


def test_defaults_follow_the_file_name(spark):
    docs = spark.createDataFrame([(1, "Psoriasis.docx"), (2, "low BACK.pdf"), (3, "history.skin"), (4, None), (5, "rash.txt"), (6, "painful rash.x.pdf")], "doc_id int, file_name string")
    found = criteria.defaults_by_name(docs, spark.createDataFrame([(5,)], "doc_id int")).collect()
    names = {i: [r["name"] for r in sorted(found, key=lambda r: r["ord"]) if r["doc_id"] == i] for i in range(1, 7)}
    skin, back, other = ["Skin Inspection", "Lesion Assessment"], ["Back Examination", "Range of Motion Assessment"], ["Patient History", "Physical Examination", "Assessment and Plan"]
    assert names == {1: skin, 2: back, 3: other, 4: other, 5: [], 6: skin}
    assert all(len(r["examples"]) == 3 for r in found)


def test_phrases_of_items(spark):
    rows = spark.createDataFrame([(1, ["Washes HANDS", "inspects skin", "feels; explains"], None), (2, [], []), (3, ["wash"], ["a"]), (4, None, ["a", "b", "c", "d"]), (5, ["Palpate", "feel it"], ["b", "b"])], "id int, items array<string>, found array<string>")
    got = {r["id"]: r["e"] for r in rows.select("id", criteria.item_examples(F.col("items"), F.col("found")).alias("e")).collect()}
    assert got[1] == ["I'm going to wash my hands before the examination", "I'm going to inspect your skin carefully", "Let me examine the affected area", "Is it okay if I proceed with the examination?"]
    assert got[2] == list(criteria.NO_PHRASE) and got[3] == ["a", criteria.NO_PHRASE[1]] and got[4] == ["a", "b", "c"]
    assert got[5] == ["b", "I'm going to feel this area with my hands"]


def test_examples_of_named_sections_and_exams(spark):
    prompts = spark.createDataFrame([(2, ["Heart exam", "Lungs"], ["b", "c"]), (1, ["heart"], ["a", "b", "b"]), (3, ["Back"], ["z"])], "prompt_id int, names array<string>, examples array<string>")
    sections = spark.createDataFrame([("Heart",), ("He",), ("Skin",), ("",)], "section string")
    got = {r["section"]: r["examples"] for r in criteria.examples_by_name(sections, prompts).collect()}
    assert got["Heart"] == got["He"] == ["a", "b", "c"]
    assert got["Skin"] == ["Perform skin assessment", "Document findings related to skin", "Complete skin evaluation"] and len(got[""]) == 3
    rows = spark.createDataFrame([("2A", 0, "x", ["c"]), ("1A", 1, "x", ["b"]), ("1A", 0, "x", ["a", "b"]), ("1A", 2, "y", [])], "station string, ord int, exam_id string, examples array<string>")
    assert {r["exam_id"]: (r["n"], r["examples"]) for r in criteria.exam_examples(rows).collect()} == {"x": (3, ["a", "b", "b", "c"]), "y": (1, [])}


def test_points_of_rows_and_names_and_recordings(spark):
    cells = spark.createDataFrame([(1, 0, ["Skin", "0", "3", "5"]), (1, 1, ["Skin (2 points)", "7"]), (1, 2, [None, " ", ""]), (1, 3, ["Heart", None, "4 "]), (1, 4, ["Back pts", "0"]), (1, 5, ["Note: 6"])], "doc_id int, row_no int, cells array<string>")
    assert [tuple(r) for r in rubric.row_points(cells).orderBy("row_no").collect()] == [(1, 0, "Skin 0 3 5", 3), (1, 1, "Skin  7", 2), (1, 3, "Heart  4", 0), (1, 4, "Back pts 0", 0), (1, 5, "Note", 6)]
    titles = spark.createDataFrame([(1, " ab "), (2, "abc"), (3, None)], "doc_id int, title string")
    sections = spark.createDataFrame([(1, "s1", "History"), (1, "s2", " x"), (1, "s2", " x"), (2, "s3", None)], "doc_id int, section_id string, section string")
    assert sorted(map(tuple, criteria.name_violations(titles, sections).collect())) == [(1, "section_name", "s2"), (1, "title", "title"), (2, "section_name", "s3"), (3, "title", "title")]
    videos = spark.createDataFrame([(1, 100, 30.0, 640, 480), (2, 0, 30.0, 0, 480), (3, None, -1.0, 640, None)], "id int, frames int, fps double, width int, height int")
    assert [tuple(r)[5:] for r in actions.video_metadata(videos).orderBy("id").collect()] == [(3.333, False, False, False), (0.0, False, True, True), (0.0, True, True, True)]


def test_a_whole_rubric(spark):
    text = ["OSCE Assessment Rubric", "History Taking (6 points)", "- Chief complaint and history of present illness", "- Past medical history and medications", "- Social and family history", "Physical Examination (8 points)", "- Vital signs assessment", "- Systematic physical examination", "- Appropriate examination techniques", "Communication Skills (4 points)", "- Clear communication with patient", "- Empathy and professionalism", "- Explanation of findings", "Clinical Reasoning (2 points)", "- Diagnostic reasoning", "- Management planning"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "doc_id long, line_no int, text string")
    row = rubric.rubric_totals(lines).first()
    assert (row["n"], row["total"], row["title"]) == (15, 31, "OSCE Assessment Rubric")


@pytest.mark.parametrize("sent", [4, 1])
def test_search_by_blocks_equals_brute_force(spark, monkeypatch, sent):
    """Broadcast and dealt out; ids as text, equal and zero vectors, a shared column with nulls."""
    for name, value in (("SENT", sent), ("QUERY_BLOCK", 3), ("POINT_BLOCK", 7), ("SHARE", 2)):
        monkeypatch.setattr(vectors, name, value)
    rng = random.Random(3)
    pick = lambda: [rng.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(3)]
    points = [(f"p{i:02d}", rng.choice([1, 1, 1, 2, None]), pick()) for i in range(60)] + [("none", 1, None)]
    asked = [(f"q{i}", rng.choice([1, 2, 3, None]), pick()) for i in range(11)] + [("qx", 1, None)]
    p, q = spark.createDataFrame(points, "id string, v int, x array<double>"), spark.createDataFrame(asked, "query_id string, v int, y array<double>")

    def score(a, b, metric):
        a, b = np.array(a), np.array(b)
        n = lambda x: np.sqrt(x @ x) or 1.0
        return round(float({"cosine": a @ b / n(a) / n(b), "dot": a @ b, "euclid": -np.sqrt(((a - b) ** 2).sum())}[metric]), 6) + 0.0

    for same in (None, "v"):
        for metric in ("cosine", "dot", "euclid"):
            want = []
            for i, v, y in asked:
                hits = sorted((-score(y, x, metric), j) for j, w, x in points if y and x and (not same or (v is not None and v == w)))[:4]
                want += [(i, j, -s, n + 1) for n, (s, j) in enumerate(hits)]
            found = vectors.top_k(q, p, "y", "x", 4, same=same, metric=metric).select("query_id", "id", "score", "rank").collect()
            assert sorted((r[0], r[1], round(r[2], 6) + 0.0, r[3]) for r in found) == sorted((a, b, round(s, 6) + 0.0, n) for a, b, s, n in want)


def test_times_with_one_decimal(spark):
    from gradeflow.functions import text

    rows = spark.createDataFrame([(0, 12.34), (1, 12.35), (2, 0.0), (3, None), (4, float("nan")), (5, 123456.06), (6, 9.96)], "id int, s double")
    got = rows.select("id", text.one_decimal(F.col("s")).alias("x")).select("id", "x", text.from_mmss(F.col("x")).alias("y")).orderBy("id").collect()
    assert [r["x"] for r in got] == ["12.3", "12.4", "0.0", "nan", "nan", "123456.1", "10.0"]
    assert [r["y"] for r in got] == [12.3, 12.4, 0.0, None, None, 123456.1, 10.0]


def test_short_texts_within_others_and_marks_that_combine(spark):
    part = spark.createDataFrame([("a",), ("bc",), ("abcd",), ("xyz",), ("",)], "p string")
    whole = spark.createDataFrame([("abcde",), ("bc",), ("wxyz",), ("",)], "w string")
    assert sorted(map(tuple, criteria.within(part, "p", whole, "w").collect())) == [("a", "abcde"), ("abcd", "abcde"), ("bc", "abcde"), ("bc", "bc"), ("xyz", "wxyz")]
    turns = spark.createDataFrame([(1, 0, 0.0, 5.0, "La ropa cae\u0301 hoy"), (1, 1, 5.0, 6.0, "\u0915\u093f\u0924\u093e\u092c")], "video_id int, turn_no int, start double, end double, text string")
    asked = spark.createDataFrame([(7, "cae\u0301 hoy"), (8, "\u0301 hoy"), (9, "cae"), (10, "\u0915\u093f\u0924\u093e\u092c"), (11, "\u0915")], "exam_id int, example string")
    assert {r["exam_id"]: r["score"] for r in criteria.exam_match(turns, asked).collect()} == {7: 1, 8: 0, 9: 0, 10: 1, 11: 0}


def test_tables_of_an_application_can_be_released(spark):
    from gradeflow import scratch

    rows = scratch.written(spark.range(5), "five")
    file = rows.inputFiles()[0].removeprefix("file://")
    assert rows.count() == 5 and file.startswith(scratch.application_folder(spark).removeprefix("file://")) and os.path.exists(file)
    scratch.release(spark)
    assert not os.path.exists(file)
    assert scratch.written(spark.range(3), "three").count() == 3


def test_lists_of_needs_are_made_once(spark, monkeypatch):
    rows = [0]

    def written(df, name):
        kept = tools_written(df, name)
        rows[0] += kept.count() if name in ("paths", "lists") else 0
        return kept

    tools_written = tools.written
    monkeypatch.setattr(tools, "written", written)
    edges = spark.createDataFrame([(i, 0, i // 2) for i in range(2, 300)], "tool long, ord int, needed long")
    found = tools.closure_of(edges).count()
    # a list for each tool, where the pairs so far were written again in each round
    assert found == sum(i.bit_length() - 1 for i in range(2, 300)) and rows[0] <= found
