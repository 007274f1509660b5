"""Tools, evidence, model responses, grades and the catalogue of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

# The rationale of questions that need no model.
NO_TOOLS = "No evidence was provided by the automated tools to assess performance on this rubric question."
NOTHING = "Automated tools ran but found no specific evidence items relevant to this rubric question."

# How an item of each tool is shown; what stands for fields that are missing, N/A for all others.
FORMATS = {
    "audio_transcript_extractor": ('Transcript ({}s - {}s): "{}"', ["start_time", "end_time", "transcript"]),
    "keyframe_captioner": ('Caption (Timestamp: {}s): "{}"', ["timestamp", "keyframe_description"]),
    "object_detector": ("Object: '{}' (Timestamp: {}s, Conf: {}, Context: {})", ["name", "timestamp", "confidence_score", "context"]),
    "pose_analyzer": ("Pose - {} (Timestamp: {}s): '{}', Gaze: '{}'", ["person_label", "timestamp", "pose", "gaze"]),
    "scene_interaction_analyzer": ("Interaction (Timestamp: {}s): Subject='{}', Action='{}', Object='{}' (Detail: {})", ["timestamp", "subject_label", "action_predicate", "object_target_label", "target_detail"]),
    "temporal_action_segmenter": ("Action: '{}' ({}s - {}s)", ["action_label", "start_time", "end_time"]),
}
MISSING = {"transcript": "", "keyframe_description": "", "context": "", "pose": "", "gaze": "", "target_detail": "None"}


def select_tools(plans: DataFrame, tools: DataFrame) -> DataFrame:
    """(plan_id, step, tool): known names of a comma list (plan_id, tools), trimmed and unquoted, in order."""
    rows = plans.select("plan_id", F.posexplode(F.split("tools", ",")).alias("step", "tool"))
    rows = rows.withColumn("tool", F.regexp_replace(strip(F.col("tool")), "^[\"']+|[\"']+$", ""))
    return rows.join(tools.select("tool"), "tool", "left_semi").select("plan_id", "step", "tool")


def rejected_tools(plans: DataFrame, tools: DataFrame) -> DataFrame:
    rows = plans.select("plan_id", F.explode(F.split("tools", ",")).alias("tool")).withColumn("tool", F.regexp_replace(strip(F.col("tool")), "^[\"']+|[\"']+$", ""))
    return rows.join(tools.select("tool"), "tool", "left_anti").select("plan_id", "tool")


def expand_tools(selected: DataFrame, closure: DataFrame) -> DataFrame:
    """(plan_id, step, tool): each tool after those it needs, once. ``closure`` (tool, ord, needed): all needed tools in order, without itself."""
    own = selected.select("plan_id", F.col("step").alias("_s"), F.lit(1_000_000).alias("_o"), "tool")
    more = selected.join(closure, "tool").select("plan_id", F.col("step").alias("_s"), F.col("ord").alias("_o"), F.col("needed").alias("tool"))
    first = own.union(more).groupBy("plan_id", "tool").agg(F.min(F.struct("_s", "_o")).alias("at"))
    step = F.row_number().over(Window.partitionBy("plan_id").orderBy("at", "tool")) - 1
    return first.select("plan_id", step.alias("step"), "tool")


def route_tools(selected: DataFrame, tools: DataFrame) -> DataFrame:
    """With the tool's category, by which its data are retrieved once per question."""
    return selected.join(tools.select("tool", "category"), "tool")


def evidence_rows(hits: DataFrame, outputs: DataFrame, schema: str) -> DataFrame:
    """One row for each element of the JSON arrays (video_id, question_id, rank, tool, payload) that meet a hit (video_id, question_id, rank)."""
    rows = hits.join(outputs, ["video_id", "question_id", "rank"]).withColumn("_p", F.from_json("payload", f"array<struct<{schema}>>"))
    rows = rows.select("video_id", "question_id", "rank", "tool", F.posexplode("_p").alias("item_no", "_i"))
    return rows.select("video_id", "question_id", "rank", "tool", "item_no", "_i.*")


def split_cache(requests: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cached rows, requests that have none)."""
    return requests.join(cache, keys), requests.join(cache.select(*keys), keys, "left_anti")


def append_cache(cache: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return cache.unionByName(new.join(cache.select(*keys), keys, "left_anti").select(*cache.columns))


def insert_if_absent(base: DataFrame, delta: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows to insert, rows refused since their id exists)."""
    ids = base.select(key)
    return delta.join(ids, key, "left_anti"), delta.join(ids, key, "left_semi")


def cascade_delete(rows: DataFrame, removed: DataFrame, key: str = "video_id") -> DataFrame:
    return rows.join(removed.select(key), key, "left_anti")


def orphans(media: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """(key, kind): media without metadata and the reverse."""
    a, b = media.select(key), metadata.select(key)
    return a.join(b, key, "left_anti").withColumn("kind", F.lit("media")).union(b.join(a, key, "left_anti").withColumn("kind", F.lit("metadata")))


def evidence_gate(questions: DataFrame, counts: DataFrame) -> DataFrame:
    """(question_id, state, grade, rationale): grade 0 if no tool ran or all came back empty, else still to be scored. ``counts`` (question_id, tool, n_items)."""
    n = counts.groupBy("question_id").agg(F.count("*").alias("_tools"), F.sum("n_items").alias("_items"))
    rows = questions.join(n, "question_id", "left")
    none, empty = F.col("_tools").isNull(), F.coalesce(F.col("_items"), F.lit(0)) == 0
    return rows.select("question_id", F.when(none, "no_tools").when(empty, "empty").otherwise("to_score").alias("state"), F.when(none | empty, 0).alias("grade"), F.when(none, NO_TOOLS).when(empty, NOTHING).alias("rationale"))


def item_text(tool, item) -> F.Column:
    """An item (JSON text) of a tool as shown to a grader, the confidence with two decimals; unknown tools as JSON. Fields that are missing or null have a text of their own."""
    out = item
    for name, (form, fields) in FORMATS.items():
        parts, pieces = form.split("{}"), []
        for text, field in zip(parts, [*fields, None], strict=True):
            pieces.append(F.lit(text))
            if field:
                value = F.get_json_object(item, f"$.{field}")
                if field == "confidence_score":
                    value = F.coalesce(F.when(value.try_cast("double").isNotNull(), F.format_string("%.2f", value.try_cast("double"))), value)
                pieces.append(F.coalesce(value, F.lit(MISSING.get(field, "N/A"))))
        out = F.when(tool == name, F.concat(*pieces)).otherwise(out)
    return out


def evidence_text(evidence: DataFrame, cap: int = 5) -> DataFrame:
    """(question_id, tool, text) from (question_id, tool, item_no, item): the first items, then how many more there are."""
    group = Window.partitionBy("question_id", "tool")
    rows = evidence.withColumn("_n", F.count("*").over(group)).withColumn("_r", F.row_number().over(group.orderBy("item_no"))).filter(F.col("_r") <= cap)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_r", F.concat(F.lit("  - "), item_text(F.col("tool"), F.col("item"))).alias("l")))), lambda x: x["l"])
    parts = rows.groupBy("question_id", "tool").agg(lines.alias("l"), F.max("_n").alias("_n"))
    more = F.when(F.col("_n") > cap, F.concat(F.lit("\n  - ... (and "), (F.col("_n") - cap).cast("string"), F.lit(" more items not shown due to brevity)"))).otherwise("")
    return parts.select("question_id", "tool", F.concat(F.lit("Tool: "), "tool", F.lit("\n"), F.array_join("l", "\n"), more).alias("text"))


def json_span(raw) -> F.Column:
    """The first object or array in a response, without code fences and thoughts."""
    text = F.regexp_replace(F.regexp_replace(raw, "(?s)<think>.*?</think>", ""), "```(?:json)?", "")
    return F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)


def parse_json(responses: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed rows with the fields of ``schema``, rejected rows) of ``responses`` (raw, ...)."""
    kind = T.StructType.fromDDL(schema)
    kind = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    rows = responses.withColumn("_j", F.from_json(json_span(F.col("raw")), kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = F.col("_j").isNotNull() & F.col("_j._bad").isNull() & (json_span(F.col("raw")) != "")
    return rows.filter(good).select(*responses.columns, *[f"_j.{f.name}" for f in kind.fields[:-1]]), rows.filter(~F.coalesce(good, F.lit(False))).select(*responses.columns)


def validate_grades(parsed: DataFrame) -> DataFrame:
    """With is_valid and reason: a grade from 0, a rationale of 10 characters or more."""
    bad_grade, short = F.col("grade").isNull() | (F.col("grade") < 0), F.length(F.coalesce("rationale", F.lit(""))) < 10
    return parsed.withColumn("is_valid", ~(bad_grade | short)).withColumn("reason", F.when(bad_grade, "grade").when(short, "rationale"))


def reasons(raw) -> F.Column:
    """The reasons of a review (JSON): missing as none, a single one as a list of one."""
    given = F.get_json_object(raw, "$.reasons")
    return F.when(given.isNull(), F.array().cast("array<string>")).when(given.startswith("["), F.from_json(given, "array<string>")).otherwise(F.array(given))


def assemble(questions: DataFrame, tools: DataFrame, evidence: DataFrame, grades: DataFrame, reviews: DataFrame) -> DataFrame:
    """A row for each (video_id, question_id) with whatever is known of it."""
    keys = ["video_id", "question_id"]
    rows = questions
    for part in (tools, evidence, grades, reviews):
        rows = rows.join(part, keys, "left")
    return rows


def catalog_page(videos: DataFrame, skip: int, limit: int) -> DataFrame:
    """Newest first, ``limit`` (1 to 200) rows after ``skip``, with the total number."""
    total = videos.agg(F.count("*").alias("total"))
    return videos.orderBy(F.desc("created_at"), "id").offset(skip).limit(min(max(limit, 1), 200)).crossJoin(F.broadcast(total))


def by_prefix(objects: DataFrame, prefix: str, column: str = "name") -> DataFrame:
    return objects.filter(F.col(column).startswith(prefix))
