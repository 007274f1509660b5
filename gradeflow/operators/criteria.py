"""Scored criteria: other extractors, merging, defaults, prompts, validation, matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PTS, WS, exam_id, number, section_id, strip


def csv_like_criteria(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, exam_id, name, points, description, examples) of lines with three comma-separated parts or more.

    Points: third part, else second, else 1; no header lines; names over 2 characters.
    """
    parts = F.transform(F.split("text", ","), lambda x: F.regexp_replace(strip(x), "^[\"']|[\"']$", ""))
    rows = lines.withColumn("_p", parts).filter(F.size("_p") >= 3).withColumn("name", F.get("_p", F.lit(0)))
    rows = rows.filter(~F.lower("name").contains("domain") & ~F.lower("name").contains("criteria") & (F.length("name") > 2))
    at = lambda i: F.get("_p", F.lit(i))
    nonzero = lambda c: F.nullif(number(c, "^([0-9]+)"), F.lit(0))
    words = F.filter(F.transform(F.split(F.coalesce(at(4), F.lit("")), "[;|]"), strip), lambda x: x != "")
    plain = F.array(F.concat(F.lit("I'm going to assess your "), F.lower("name")))
    return rows.select("doc_id", "line_no", exam_id(F.col("name")).alias("exam_id"), "name", F.coalesce(nonzero(at(2)), nonzero(at(1)), F.lit(1)).alias("points"), F.coalesce(F.nullif(at(3), F.lit("")), at(2)).alias("description"), F.when(F.size(words) > 0, words).otherwise(plain).alias("examples"))


QUOTED = r'"([^"]+)","([^"]+)",([0-9]+),"([^"]+)","([^"]+)"'


def quoted_csv_criteria(lines: DataFrame, begin: str = "ASSESSMENT CRITERIA EXTRACTED", end: str = "=== EXTRACTED VERBALIZATION EXAMPLES ===") -> DataFrame:
    """(doc_id, line_no, name, code, points, description, items) of ``"name","code",n,"desc","i1; i2"`` lines inside the marked block."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    mark = F.when(F.col("text").contains(end), False).when(F.col("text").contains(begin), True)
    rows = lines.withColumn("_in", F.last(mark, ignorenulls=True).over(order)).filter(F.col("_in") & F.regexp_like("text", F.lit(QUOTED)))
    g = lambda i: F.regexp_extract("text", QUOTED, i)
    return rows.select("doc_id", "line_no", g(1).alias("name"), g(2).alias("code"), g(3).try_cast("int").alias("points"), g(4).alias("description"), F.transform(F.split(g(5), ";"), strip).alias("items"))


def table_criteria(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, name, points) of lines cut by pipes or tabs that name an exam: the first number of the first part that has one."""
    parts = F.filter(F.transform(F.split("text", r"[|\t]"), strip), lambda x: x != "")
    rows = lines.filter(F.regexp_like("text", F.lit(r"[|\t]"))).withColumn("_p", parts).filter(F.size("_p") >= 2)
    name = F.get(F.filter("_p", lambda x: F.regexp_like(x, F.lit("(?i)Examination|Assessment|Evaluation|Test"))), F.lit(0))
    digit = F.get(F.filter("_p", lambda x: F.regexp_like(x, F.lit("[0-9]"))), F.lit(0))
    return rows.select("doc_id", "line_no", name.alias("name"), F.coalesce(number(digit, "([0-9]+)"), F.lit(1)).alias("points")).filter("name is not null")


NAMED = rf"(?i)^(?:[0-9]+\.?{WS}*)?([A-Za-z\x20\x09-\x0D]+(?:Examination|Assessment|Evaluation|Test|Check)){WS}*[-:|\x20\x09-\x0D]+{WS}*([0-9]+){WS}*{PTS}?"


def named_criteria(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, name, points) of ``Name Examination - n points`` lines."""
    rows = lines.filter(F.regexp_like("text", F.lit(NAMED)))
    return rows.select("doc_id", "line_no", strip(F.regexp_extract("text", NAMED, 1)).alias("name"), F.coalesce(F.nullif(number("text", NAMED, 2), F.lit(0)), F.lit(1)).alias("points"))


def keyword_criteria(docs: DataFrame, rules: list[tuple[str, str, int]], defaults: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, name, points): each rule (keyword, name, points) that the text holds, once by name with the first such rule's points; the defaults if none."""
    low = F.lower("text")
    first: dict[str, list[F.Column]] = {}
    for keyword, name, points in rules:
        first.setdefault(name, []).append(F.when(low.contains(keyword), points))
    one = lambda name, points: F.struct(F.lit(name).alias("name"), points.alias("points"))
    found = F.filter(F.array(*[one(name, F.coalesce(*points)) for name, points in first.items()]), lambda x: x["points"].isNotNull())
    plain = F.array(*[one(name, F.lit(points)) for name, points in defaults])
    return docs.select("doc_id", F.explode(F.when(F.size(found) > 0, found).otherwise(plain)).alias("c")).select("doc_id", "c.name", "c.points")


def first_pattern_only(docs: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, name): the name of the first pattern that matches; documents without one are left out."""
    name = F.lit(None).cast("string")
    for pattern, said in reversed(rules):
        name = F.when(F.regexp_like(F.lower("text"), F.lit(pattern)), said).otherwise(name)
    return docs.select("doc_id", name.alias("name")).filter("name is not null")


def runs(c: str, n: int) -> F.Column:
    """Distinct runs of n characters of a text; none of a shorter one."""
    # Spark gives a function of two arguments the place as well, so n is bound here
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(n)))
    return F.array_distinct(F.filter(every, lambda g: F.length(g) == n))


def within(part: DataFrame, p: str, whole: DataFrame, w: str) -> DataFrame:
    """(p, w): the distinct texts ``p`` of ``part`` that texts ``w`` of ``whole`` hold.

    They meet on the run of three characters of ``p`` that the fewest hold; texts of one or two
    characters, where there are any, are runs themselves.
    """
    held = whole.select(w, F.explode(runs(w, 3)).alias("g"))
    often = held.groupBy("g").agg(F.count("*").alias("often"))
    rare = part.select(p, F.explode(runs(p, 3)).alias("g")).join(often, "g").groupBy(p).agg(F.min(F.struct("often", "g")).alias("r")).select(p, "r.g")
    found = held.join(rare, "g").filter(F.col(w).contains(F.col(p))).select(p, w)
    for n in (1, 2):
        short = part.filter(F.length(p) == n).select(p)
        if not short.isEmpty():
            found = found.union(whole.select(w, F.explode(runs(w, n)).alias("g")).join(short, F.col("g") == F.col(p)).select(p, w))
    return found


def best_pattern(rows: DataFrame, patterns: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, row_no, pattern_id, score): for each row (doc_id, row_no, text, n_cols) its most similar pattern (pattern_id, pattern, n_cols).

    1 if equal, 0.7 if one holds the other, else the row's words that the pattern has, repeats
    counted, over the larger number of words; 0.2 more for as many columns; 1 at most; above
    ``least``; the first pattern on ties. Distinct texts meet distinct patterns, and the best of a
    text and number of columns goes to all its rows. Candidates share one of the text's rarest words
    (so many that a text without them lacks the share of words that ``least`` needs), or one holds
    the other.
    """
    low = lambda c: F.lower(c)
    texts = rows.select(low("text").alias("t")).distinct().withColumn("tw", F.split("t", rf"{WS}+"))
    every = patterns.groupBy(low("pattern").alias("p"), F.col("n_cols").alias("pc")).agg(F.min("pattern_id").alias("pattern_id"))
    known = every.select("p").distinct().withColumn("pw", F.split("p", rf"{WS}+"))
    words = known.select("p", F.explode(F.array_distinct("pw")).alias("w"))
    usual = texts.select("t", F.size("tw").alias("n"), F.explode("tw").alias("w")).join(words.groupBy("w").agg(F.count("*").alias("often")), "w", "left")
    # a base of more than ``least`` - 0.2 leaves so many of the n words, repeats counted, without a match at most
    lacking = F.col("n") - F.greatest(F.floor(F.col("n") * (least - 0.2) + 1e-9) + 1, F.lit(1))
    rarest = F.row_number().over(Window.partitionBy("t").orderBy(F.coalesce("often", F.lit(0)), "w"))
    by_word = usual.withColumn("at", rarest).filter(F.col("at") <= lacking + 1).filter("often is not null").select("t", "w").distinct().join(words, "w").select("t", "p")
    holds = within(known.select("p"), "p", texts.select("t"), "t").select("t", "p")
    held = within(texts.select("t"), "t", known.select("p"), "p").select("t", "p")
    pairs = by_word.union(holds).union(held).distinct().join(texts, "t").join(known, "p")
    common = F.size(F.filter("tw", lambda w: F.array_contains("pw", w)))
    base = F.when(F.col("t") == F.col("p"), 1.0).when(F.col("t").contains(F.col("p")) | F.col("p").contains(F.col("t")), 0.7).otherwise(common / F.greatest(F.size("tw"), F.size("pw")))
    based = pairs.withColumn("base", base).filter(F.col("base") > least - 0.2 - 1e-6).select("t", "p", "base")
    kinds = rows.select(low("text").alias("t"), F.col("n_cols")).distinct()
    scored = kinds.join(based, "t").join(every, "p")
    score = F.round(F.least(F.col("base") + F.when(F.col("n_cols") == F.col("pc"), 0.2).otherwise(0.0), F.lit(1.0)), 6)
    scored = scored.withColumn("score", score).filter(F.col("score") > least)
    best = scored.groupBy("t", "n_cols").agg(F.min(F.struct((-F.col("score")).alias("s"), "pattern_id")).alias("b"))
    best = best.select(F.col("t").alias("bt"), F.col("n_cols").alias("bn"), "b")
    found = rows.join(best, (low("text") == F.col("bt")) & F.col("n_cols").eqNullSafe(F.col("bn")))
    return found.groupBy("doc_id", "row_no").agg(F.min("b").alias("b")).select("doc_id", "row_no", "b.pattern_id", (-F.col("b.s")).alias("score"))


def mine_examples(sections: DataFrame, corpus: DataFrame, n: int = 5, generic: tuple[str, ...] = ("I will assess this", "Let me check this", "I'm going to examine this")) -> DataFrame:
    """(section, examples): the first n distinct examples of corpus rows (section_key, ord, example) of a section's key; else generic ones."""
    first = corpus.groupBy("section_key", "example").agg(F.min("ord").alias("ord"))
    kept = first.withColumn("_r", F.row_number().over(Window.partitionBy("section_key").orderBy("ord", "example"))).filter(F.col("_r") <= n)
    rows = kept.groupBy("section_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "example"))), lambda x: x["example"]).alias("examples"))
    plain = F.array(*[F.lit(x) for x in generic])
    return sections.join(rows, F.lower("section") == F.col("section_key"), "left").select("section", F.coalesce("examples", plain).alias("examples"))


def union_extractors(*extracted: DataFrame) -> DataFrame:
    """All rows (doc_id, ord, name, points) with ``src``, the extractor's place."""
    return reduce(DataFrame.unionByName, [x.withColumn("src", F.lit(i)) for i, x in enumerate(extracted)])


def dedupe_criteria(*extracted: DataFrame) -> DataFrame:
    """The first of each name, in lower case, of a document by extractor and order."""
    rank = F.row_number().over(Window.partitionBy("doc_id", F.lower("name")).orderBy("src", "ord"))
    return union_extractors(*extracted).withColumn("_r", rank).filter("_r = 1").drop("_r")


def merge_items(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items (doc_id, section, description, points, examples) of two analyses, matched on lower-cased section and description.

    The longer list of examples, the second's points only where the first has 0.
    """
    key = lambda x, p: x.select(F.col("doc_id").alias("d"), F.lower("section").alias("s"), F.lower("description").alias("i"), *[F.col(c).alias(f"{p}_{c}") for c in ("section", "description", "points", "examples")])
    rows = key(a, "a").join(key(b, "b"), ["d", "s", "i"], "full")
    examples = F.when(F.coalesce(F.size("b_examples"), F.lit(0)) > F.coalesce(F.size("a_examples"), F.lit(0)), F.col("b_examples")).otherwise(F.coalesce("a_examples", "b_examples"))
    points = F.when(F.coalesce("a_points", F.lit(0)) == 0, F.coalesce("b_points", "a_points")).otherwise(F.col("a_points"))
    return rows.select(F.col("d").alias("doc_id"), F.coalesce("a_section", "b_section").alias("section"), F.coalesce("a_description", "b_description").alias("description"), points.alias("points"), examples.alias("examples"))


def merge_sections(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, section, max_points) of two analyses: sections are the same if their names are but for case, the first's name and the larger points stay."""
    return merge_section_rows(a.withColumn("_src", F.lit(0)).unionByName(b.withColumn("_src", F.lit(1))))


def merge_section_rows(rows: DataFrame) -> DataFrame:
    """``merge_sections`` of rows (doc_id, section, max_points, _src) that tell their analysis, 0 or 1."""
    rows = rows.groupBy("doc_id", F.lower("section").alias("_k")).agg(F.min(F.struct("_src", "section")).alias("_s"), F.max("max_points").alias("max_points"))
    return rows.select("doc_id", F.col("_s.section").alias("section"), "max_points")


def merge_totals(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, total_points) of two analyses: the larger, a missing one counting 0."""
    both = a.select("doc_id", "total_points").union(b.select("doc_id", "total_points"))
    return both.groupBy("doc_id").agg(F.max(F.coalesce("total_points", F.lit(0))).alias("total_points"))


def sections_to_criteria(sections: DataFrame) -> DataFrame:
    """(doc_id, id, name, description, max_points, section) from sections (doc_id, section, max_points, items array of description and points).

    A section without items is one criterion, else each item is; points 0 or missing count 1.
    """
    sid = section_id(F.col("section"))
    one = lambda p: F.coalesce(F.nullif(p, F.lit(0)), F.lit(1))
    rows = sections.withColumn("_sid", sid).select("*", F.posexplode_outer("items").alias("_at", "_item"))
    alone = F.col("_item").isNull()
    return rows.select("doc_id", F.when(alone, F.col("_sid")).otherwise(F.concat("_sid", F.lit("_"), (F.col("_at") + 1).cast("string"))).alias("id"), F.when(alone, F.col("section")).otherwise(F.concat("section", F.lit(": "), "_item.description")).alias("name"), F.when(alone, F.concat(F.lit("Assessment of "), "section")).otherwise(F.col("_item.description")).alias("description"), F.when(alone, one(F.col("max_points"))).otherwise(one(F.col("_item.points"))).alias("max_points"), "section")


def with_defaults(docs: DataFrame, criteria: DataFrame, defaults: list[tuple[str, int]]) -> DataFrame:
    """``criteria`` (doc_id, name, points), and for documents without any the defaults."""
    empty = docs.select("doc_id").join(criteria.select("doc_id"), "doc_id", "left_anti")
    plain = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("points")) for n, p in defaults]))
    return criteria.select("doc_id", "name", "points").union(empty.select("doc_id", plain.alias("c")).select("doc_id", "c.name", "c.points"))


# Criteria of documents that have none, by words in the file's name; the first list whose word it holds, else the last.
DEFAULTS = [
    (("psoriasis", "rash", "skin"), [
        ("Skin_Inspection", "Skin Inspection", 3, ("I'm going to inspect your skin closely", "I'm looking for any rashes or abnormalities", "Let me examine the affected area")),
        ("Lesion_Assessment", "Lesion Assessment", 2, ("I'm going to examine this lesion", "Let me look at the characteristics of this rash", "I need to assess the distribution")),
    ]),
    (("back", "pain"), [
        ("Back_Examination", "Back Examination", 4, ("I'm going to examine your back", "Let me check your spine", "I'm going to assess your back pain")),
        ("Range_of_Motion", "Range of Motion Assessment", 3, ("Can you bend forward for me?", "Try to touch your toes", "Bend to the side")),
    ]),
    ((), [
        ("Patient_History", "Patient History", 5, ("Can you tell me about your symptoms?", "When did this start?", "What brings you in today?")),
        ("Physical_Examination", "Physical Examination", 4, ("I'm going to examine you now", "Let me check your vital signs", "I need to perform a physical exam")),
        ("Assessment_and_Plan", "Assessment and Plan", 3, ("Based on my examination", "I think the most likely diagnosis is", "Here's what I recommend")),
    ]),
]


def defaults_by_name(docs: DataFrame, criteria: DataFrame) -> DataFrame:
    """(doc_id, ord, exam_id, name, max_points, examples) for documents (doc_id, file_name) without ``criteria`` (doc_id): the list for their file's name, its extension left out; a null name gets the last."""
    name = F.lower(F.regexp_replace(F.coalesce("file_name", F.lit("")), r"\.[^.]+$", ""))
    listed = lambda rows: F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(e).alias("exam_id"), F.lit(n).alias("name"), F.lit(p).alias("max_points"), F.array(*map(F.lit, x)).alias("examples")) for i, (e, n, p, x) in enumerate(rows)])
    chosen = listed(DEFAULTS[-1][1])
    for words, rows in reversed(DEFAULTS[:-1]):
        chosen = F.when(reduce(lambda a, b: a | b, [name.contains(w) for w in words]), listed(rows)).otherwise(chosen)
    empty = docs.join(criteria.select("doc_id"), "doc_id", "left_anti")
    return empty.select("doc_id", F.explode(chosen).alias("c")).select("doc_id", "c.*")


# Phrases for an item that holds all the words of one of the lists; phrases that stand for missing ones.
ITEM_PHRASES = [
    ([("wash", "hands")], ("I'm going to wash my hands before the examination",)),
    ([("inspect", "skin")], ("I'm going to inspect your skin carefully", "Let me examine the affected area")),
    ([("introduce",)], ("Hello, I'm Dr. Smith and I'll be examining you today",)),
    ([("consent",), ("explain",)], ("Is it okay if I proceed with the examination?",)),
    ([("palpat",), ("feel",)], ("I'm going to feel this area with my hands",)),
    ([("listen",), ("auscult",)], ("I'm going to listen to your heart and lungs",)),
]
NO_PHRASE = ("I'm going to perform this examination now", "Please let me know if you feel any discomfort")


def item_examples(items, found, first: int = 3, most: int = 4) -> F.Column:
    """Example phrases of a list of items: the first few ``found`` in the text, then those of each item in order, distinct, at most four, and two at least."""

    def phrases(item):
        text = F.lower(item)
        has = lambda words: reduce(lambda a, b: a & b, [text.contains(w) for w in words])
        none = F.array().cast("array<string>")
        return F.concat(*[F.when(reduce(lambda a, b: a | b, map(has, lists)), F.array(*map(F.lit, out))).otherwise(none) for lists, out in ITEM_PHRASES])

    given = F.slice(F.coalesce(found, F.array().cast("array<string>")), 1, first)
    all_ = F.array_distinct(F.concat(given, F.flatten(F.transform(F.coalesce(items, F.array().cast("array<string>")), phrases))))
    fill = F.when(F.size(all_) == 0, F.array(*map(F.lit, NO_PHRASE))).when(F.size(all_) == 1, F.array_append(all_, F.lit(NO_PHRASE[1]))).otherwise(all_)
    return F.slice(fill, 1, most)


def examples_by_name(sections: DataFrame, prompts: DataFrame, n: int = 5) -> DataFrame:
    """(section, examples): of every prompt (prompt_id, names array, examples array) one of whose names starts with the section, but for case, all examples: the first n distinct ones in the order of prompts; else three phrases with the section's name.

    Sections meet names by their first three letters; empty ones meet none.
    """
    return examples_by_rows(sections, prompts.select("prompt_id", F.explode("names").alias("name")), prompts.select("prompt_id", F.posexplode("examples").alias("ord", "example")), n)


def examples_by_rows(sections: DataFrame, names: DataFrame, examples: DataFrame, n: int = 5) -> DataFrame:
    """``examples_by_name`` of prompts in rows: names (prompt_id, name) and examples (prompt_id, ord, example), so that no row holds a prompt."""
    s = F.lower("section")
    heads = F.array_distinct(F.array(*[F.lower(F.substring("name", 1, k)) for k in (1, 2, 3)]))
    names = names.distinct().withColumn("_head", F.explode(heads))
    asked = sections.select("section").filter("section <> ''").distinct().withColumn("_head", F.substring(s, 1, 3))
    met = asked.join(names, "_head").filter(F.startswith(F.lower("name"), s)).select("section", "prompt_id").distinct()
    # a prompt's repeats go before its examples meet sections
    once = examples.groupBy("prompt_id", "example").agg(F.min("ord").alias("_at"))
    first = met.join(once, "prompt_id").groupBy("section", "example").agg(F.min(F.struct("prompt_id", "_at")).alias("_first"))
    kept = first.withColumn("_r", F.row_number().over(Window.partitionBy("section").orderBy("_first"))).filter(F.col("_r") <= n)
    found = kept.groupBy("section").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "example"))), lambda x: x["example"]).alias("examples"))
    # The phrases
    plain = F.array(F.concat(F.lit("Perform "), s, F.lit(" assessment")), F.concat(F.lit("Document findings related to "), s), F.concat(F.lit("Complete "), s, F.lit(" evaluation")))
    return sections.join(found, "section", "left").select("section", F.coalesce("examples", plain).alias("examples"))


def exam_examples(criteria: DataFrame) -> DataFrame:
    """(exam_id, n, examples): all examples of an exam across stations, in the order of station and ord, repeats kept."""
    # sort_array and a field of all structs: array_sort and transform call a lambda for each comparison and element
    rows = criteria.groupBy("exam_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("station", "ord", "examples"))).alias("_e"))
    return rows.select("exam_id", "n", F.flatten("_e.examples").alias("examples"))


def section_examples(section, name) -> F.Column:
    """Two example phrases by section and name."""
    s, n = F.lower(section), F.lower(name)
    pair = lambda a, b: F.array(*[F.concat(*x) if isinstance(x, tuple) else F.lit(x) for x in (a, b)])
    # The phrases.
    history = F.when(n.contains("chief") | n.contains("complaint"), pair("What brings you in today?", "Can you tell me your main concern?")).when(n.contains("present") | n.contains("illness"), pair("When did this start?", "How has it changed over time?")).otherwise(pair((F.lit("Tell me about your "), n), (F.lit("I'd like to ask about your "), n)))
    physical = F.when(n.contains("vital") | n.contains("signs"), pair("I'm going to check your vital signs", "Let me take your blood pressure")).otherwise(pair((F.lit("I'm going to examine your "), n), "Let me check this area"))
    return F.when(s.contains("history"), history).when(s.contains("physical") | s.contains("examination"), physical).otherwise(pair((F.lit("I'm assessing "), n), (F.lit("Let me evaluate "), n)))


def normalize_criteria(rows: DataFrame) -> DataFrame:
    """Edited criteria (doc_id, name, points as text, examples): name trimmed and required, points int or 1, a phrase if there is no example."""
    name = strip(F.col("name"))
    rows = rows.withColumn("name", name).filter(F.coalesce(F.col("name") != "", F.lit(False)))
    examples = F.when(F.coalesce(F.size("examples"), F.lit(0)) > 0, F.col("examples")).otherwise(F.array(F.concat(F.lit("Assessing "), F.lower("name"))))
    return rows.withColumn("points", F.coalesce(F.col("points").try_cast("int"), F.lit(1))).withColumn("examples", examples)


def score_bands(criteria: DataFrame) -> DataFrame:
    """With excellent, good, satisfactory, needs_improvement, unsatisfactory and minutes."""
    p = F.col("max_points")
    share = lambda x: F.floor(p * F.lit(x)).cast("int")
    return criteria.withColumns({"excellent": p, "good": share(0.8), "satisfactory": share(0.6), "needs_improvement": share(0.3), "unsatisfactory": F.lit(0), "minutes": p * 2})


def response_schema(criteria: DataFrame) -> DataFrame:
    """(doc_id, schema_json): an object with an integer score from 0 to the maximum for each criterion, all required."""
    field = F.struct("ord", exam_id(F.col("name")).alias("id"), F.struct(F.lit("integer").alias("type"), F.lit(0).alias("minimum"), F.col("max_points").alias("maximum")).alias("s"))
    rows = criteria.groupBy("doc_id").agg(F.array_sort(F.collect_list(field)).alias("f"))
    names = F.array_distinct(F.transform("f", lambda x: x["id"]))
    # equal names are one property, the first
    first = F.transform(names, lambda n: F.struct(n.alias("k"), F.get(F.filter("f", lambda x: x["id"] == n), F.lit(0))["s"].alias("v")))
    return rows.select("doc_id", F.to_json(F.struct(F.lit("object").alias("type"), F.map_from_entries(first).alias("properties"), names.alias("required"))).alias("schema_json"))


def render_prompt(criteria: DataFrame) -> DataFrame:
    """(doc_id, prompt, n, total): the criteria by section in order of first appearance, with counts and points."""
    by_section = Window.partitionBy("doc_id", "section")
    rows = criteria.withColumn("_first", F.min("ord").over(by_section))
    line = F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.col("max_points").cast("string"), F.lit(")"))
    head = F.when(F.col("ord") == F.col("_first"), F.concat(F.lit("## "), F.col("section"), F.lit("\n"))).otherwise(F.lit(""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_first", "ord", F.concat(head, line).alias("l")))), lambda x: x["l"]), "\n")
    parts = rows.groupBy("doc_id").agg(text.alias("body"), F.count("*").alias("n"), F.sum("max_points").alias("total"))
    top = F.concat(F.lit("criteria: "), F.col("n").cast("string"), F.lit(", points: "), F.col("total").cast("string"), F.lit("\n"))
    return parts.select("doc_id", F.concat(top, "body").alias("prompt"), "n", "total")


def name_violations(titles: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, rule, key): titles (doc_id, title) and section names (doc_id, section_id, section) of under 3 characters without the white space around them; missing ones too."""
    short = lambda c: F.length(strip(F.coalesce(c, F.lit("")))) < 3
    found = titles.filter(short(F.col("title"))).select("doc_id", F.lit("title").alias("rule"), F.lit("title").alias("key"))
    return found.union(sections.filter(short(F.col("section"))).select("doc_id", F.lit("section_name"), F.col("section_id").cast("string")).distinct())


def violations(rubrics: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc_id, rule, key) of items (doc_id, section_id, item_id, description, points) and stated totals (doc_id, total_points).

    Ids of sections and items are letters, digits and ``_``; descriptions have 3 characters at least.
    """
    bad = lambda rows, rule, key: rows.select("doc_id", F.lit(rule).alias("rule"), key.cast("string").alias("key"))
    item, d = F.col("item_id"), rubrics
    same = lambda keys: d.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    found = [
        bad(d.filter(~F.regexp_like("item_id", F.lit("^[A-Za-z0-9_]+$"))), "id", item),
        bad(d.filter(~F.regexp_like("section_id", F.lit("^[A-Za-z0-9_]+$"))).select("doc_id", "section_id").distinct(), "section_id", F.col("section_id")),
        bad(d.filter(F.length(strip(F.coalesce("description", F.lit("")))) < 3), "short", item),
        bad(d.filter(F.col("points") < 0), "negative", item),
        bad(same(["doc_id", "section_id", "item_id"]), "duplicate_in_section", item),
        bad(same(["doc_id", "item_id"]), "duplicate_in_rubric", item),
        bad(d.groupBy("doc_id").agg(F.sum("points").alias("_s")).join(totals, "doc_id").filter(F.abs(F.col("_s") - F.col("total_points")) > 0.01), "total", F.lit("total")),
        bad(totals.join(d.select("doc_id"), "doc_id", "left_anti"), "empty", F.lit("sections")),
    ]
    return reduce(DataFrame.union, found)


def lookup(items: DataFrame, keys: DataFrame) -> DataFrame:
    """The items with the given (doc_id, name)."""
    return items.join(keys.distinct(), ["doc_id", "name"], "left_semi")


def lookup_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sum("max_points").alias("points"))


#: What separates the words of a statement: everything but letters and digits; most words of a run that turns and examples meet on.
MARK, RUN = r"[^\p{L}\p{M}\p{N}]+", 4


def word_runs(c: str, n: int) -> F.Column:
    """The runs of n words of an array of words, joined by a space; none of a shorter one."""
    every = F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1)))
    return F.when(F.size(c) >= n, F.transform(every, lambda i: F.array_join(F.slice(F.col(c), i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def exam_match(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """(video_id, exam_id, statement, start_time, end_time, score) for every recording and exam.

    The first turn (video_id, turn_no, start, end, text) that holds an example (exam_id, example) of
    the exam, else ``No exam was performed``; case, marks and white space don't count. An example is
    a run of whole words, so turns and examples meet on runs of as many words as an example has, up to
    ``RUN``; of longer ones on the first ``RUN``, and their texts are compared. Only keys and runs are shuffled, and
    texts are fetched for the first turns found. Null and wordless examples match nothing.
    """
    norm = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), MARK, " "), F.lit(" "))
    words = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    # an example may start or end with marks: one space at either end
    asked = examples.select("exam_id", F.regexp_replace(norm("example"), " +", " ").alias("e")).filter("e <> ' '").distinct()
    asked = asked.select("exam_id", "e", words("e").alias("_w")).select("exam_id", "e", F.size("_w").alias("n"), F.array_join(F.slice("_w", 1, RUN), " ").alias("run"))
    lengths = sorted({min(r["n"], RUN) for r in asked.select(F.least("n", F.lit(RUN)).alias("n")).distinct().collect()})
    said = turns.select("video_id", "turn_no", words(norm("text")).alias("w"))
    runs_of = F.array_distinct(F.concat(*[word_runs("w", n) for n in lengths])) if lengths else F.array().cast("array<string>")
    said = said.select("video_id", "turn_no", F.explode(runs_of).alias("run"))
    short, long = asked.filter(F.col("n") <= RUN).select("exam_id", "run"), asked.filter(F.col("n") > RUN)
    met = said.join(short, "run").groupBy("video_id", "exam_id").agg(F.min("turn_no").alias("turn_no"))
    if RUN in lengths and not long.isEmpty():
        texts = turns.select("video_id", "turn_no", F.regexp_replace(norm("text"), " +", " ").alias("t"))
        some = said.join(long.select("exam_id", "e", "run"), "run").join(texts, ["video_id", "turn_no"]).filter(F.col("t").contains(F.col("e")))
        met = met.union(some.select("video_id", "exam_id", "turn_no")).groupBy("video_id", "exam_id").agg(F.min("turn_no").alias("turn_no"))
    texts = turns.select("video_id", "turn_no", "start", "end", "text")
    first = met.join(texts, ["video_id", "turn_no"]).groupBy("video_id", "exam_id").agg(F.min(F.struct("turn_no", "text", "start", "end")).alias("h"))
    # every recording with every exam is the result itself; the exams are a short list
    every = turns.select("video_id").distinct().crossJoin(examples.select("exam_id").distinct())
    rows = every.join(first, ["video_id", "exam_id"], "left")
    return rows.select("video_id", "exam_id", F.coalesce("h.text", F.lit("No exam was performed")).alias("statement"), F.coalesce(F.col("h.start").cast("string"), F.lit("nan")).alias("start_time"), F.coalesce(F.col("h.end").cast("string"), F.lit("nan")).alias("end_time"), F.col("h").isNotNull().cast("int").alias("score"))


def exam_span(matches: DataFrame) -> DataFrame:
    """(video_id, start, end, n) from the first start to the last end of the detected exams; nulls if there are none."""
    hit = F.col("score") == 1
    return matches.groupBy("video_id").agg(F.min(F.when(hit, F.col("start_time").try_cast("double"))).alias("start"), F.max(F.when(hit, F.col("end_time").try_cast("double"))).alias("end"), F.sum("score").alias("n"))


def band_scores(counts: DataFrame, bands: list[tuple[int, int | None, int]]) -> DataFrame:
    """``counts`` (n) with the score of the first band (lo, hi, score) that holds n; hi None is open."""
    score = F.lit(None).cast("int")
    for lo, hi, s in reversed(bands):
        inside = F.col("n") >= lo if hi is None else F.col("n").between(lo, hi)
        score = F.when(inside, s).otherwise(score)
    return counts.withColumn("score", score)


def score_breakdown(scores: DataFrame) -> DataFrame:
    """(doc_id, domain, points, n): each domain, and the document's total with a null domain."""
    rows = scores.rollup("doc_id", "domain").agg(F.sum("points").alias("points"), F.count("*").alias("n"), F.grouping_id().alias("_g"))
    return rows.filter("_g < 3").drop("_g")


def domain_points(scores: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(doc_id, a column for each group): points of its domains, 0 without."""
    return scores.groupBy("doc_id").agg(*[F.coalesce(F.sum(F.when(F.col("domain").isin(names), F.col("points"))), F.lit(0)).alias(g) for g, names in groups.items()])


def score_rollup(scores: DataFrame, dims: list[str], mode: str = "rollup") -> DataFrame:
    """(dims, earned, possible, pct, level) over a rollup or cube of the dimensions."""
    rows = (scores.cube if mode == "cube" else scores.rollup)(*dims).agg(F.sum("earned").alias("earned"), F.sum("possible").alias("possible"), F.grouping_id().alias("level"))
    return rows.withColumn("pct", F.round(100 * F.col("earned") / F.col("possible"), 4))
