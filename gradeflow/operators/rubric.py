"""Rubric lines and cells to sections, items and scored criteria."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PTS, WS, digits_only, exam_id, first_of, number, points_in, render_item, section_points, strip, without_points

# Buckets by keywords in a line, as plain substrings, in order.
BUCKETS = [
    ("history", ["history", "hpi", "ht", "chief concern", "pmh", "medications", "allergies", "family history", "social history"]),
    ("physical", ["physical", "exam", "pe", "vitals", "inspection", "palpation", "auscultation"]),
    ("diagnostic", ["diagnosis", "diagnostic", "da", "dr", "assessment", "reasoning"]),
    ("management", ["management", "treatment", "plan", "m |"]),
]
CAPS = {"history": 10, "physical": 15, "diagnostic": 8, "management": 8}
# Names of sections, in the order in which they are looked for.
SECTIONS = ["History Taking", "Physical Exam", "Physical Examination", "Diagnostic Accuracy", "Diagnostic Reasoning", "Diagnostic Accuracy/Reasoning/Justification", "Management", "Patient Management", "Communication Skills", "Professional Behavior", "Documentation"]
# Forms of section headers, tried in order.
HEADERS = [
    r"(?i)^([A-Za-z0-9_\x20\x09-\x0D]+(?:Taking|Exam|Examination|Assessment|Evaluation|Accuracy|Reasoning|Management|Skills?))[\x20\x09-\x0D]*[:|-]?[\x20\x09-\x0D]*([0-9]+)?[\x20\x09-\x0D]*(?:points?|pts?)?",
    r"(?i)^(?:[0-9]+\.?[\x20\x09-\x0D]*)?([A-Za-z0-9_\x20\x09-\x0D]+)[\x20\x09-\x0D]*\(([0-9]+)[\x20\x09-\x0D]*(?:points?|pts?)?\)",
    r"(?i)^([A-Za-z0-9_\x20\x09-\x0D]+)[\x20\x09-\x0D]*-[\x20\x09-\x0D]*(?:Max[\x20\x09-\x0D]*)?([0-9]+)[\x20\x09-\x0D]*(?:points?|pts?)?",
]
BULLET = r"^(?:[•·▪▫◦‣⁃*-]|[0-9]+\.)"


def bucket_lines(lines: DataFrame, buckets=BUCKETS) -> DataFrame:
    """With ``bucket``: the first whose keywords the lower-cased text holds, else other."""
    return lines.withColumn("bucket", first_of(F.lower("text"), buckets, "other"))


def top_items(bucketed: DataFrame, caps=CAPS) -> DataFrame:
    """(doc_id, bucket, item_no, rendered): the first lines of each bucket, up to its cap."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "bucket").orderBy("line_no"))
    cap = F.lit(0)
    for name, n in caps.items():
        cap = F.when(F.col("bucket") == name, n).otherwise(cap)
    return bucketed.withColumn("item_no", rank).filter(F.col("item_no") <= cap).select("doc_id", "bucket", "item_no", render_item(F.col("text")).alias("rendered"))


def station_key(lines: DataFrame) -> DataFrame:
    """(doc_id, value): the first ``station x`` among the first 10 lines, in capitals; 1A without one."""
    found = F.regexp_extract(F.lower("text"), rf"station{WS}*([a-z0-9_]+)", 1)
    best = F.min(F.when((F.col("line_no") < 10) & (found != ""), F.struct("line_no", found.alias("k"))))
    return lines.groupBy("doc_id").agg(best.alias("b")).select("doc_id", F.coalesce(F.upper("b.k"), F.lit("1A")).alias("value"))


def doc_title(lines: DataFrame) -> DataFrame:
    """(doc_id, value): the first of the first 3 lines over 10 characters that starts with no digit or bullet; else the id."""
    good = (F.col("line_no") < 3) & (F.length("text") > 10) & ~F.regexp_like("text", F.lit(rf"^{WS}*[0-9*•-]"))
    return lines.groupBy("doc_id").agg(F.min(F.when(good, F.struct("line_no", "text"))).alias("b")).select("doc_id", F.coalesce("b.text", F.col("doc_id").cast("string")).alias("value"))


def line_points(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, description, points): the points in the text, taken out of it; 0 without."""
    return lines.select("doc_id", "line_no", without_points(F.col("text")).alias("description"), F.coalesce(points_in(F.col("text")), F.lit(0)).alias("points"))


def row_points(cells: DataFrame) -> DataFrame:
    """(doc_id, row_no, description, points) of rows that aren't blank: points in the joined cells, taken out of the text; else those of the first all-digit cell that isn't 0; else 0."""
    nonzero = lambda x: F.coalesce(F.regexp_like(x, F.lit("^[0-9]+$")) & (x.try_cast("int") != 0), F.lit(False))
    rows = cells.select("doc_id", "row_no", "cells", strip(F.array_join("cells", " ", "")).alias("_text")).filter("_text <> ''")
    # each step is a column of its own, so that none is worked out again wherever it is used
    rows = rows.withColumns({"_in": points_in(F.col("_text")), "_own": F.get(F.filter("cells", nonzero), F.lit(0)).try_cast("int"), "description": without_points(F.col("_text"))})
    return rows.select("doc_id", "row_no", "description", F.coalesce(F.when(F.col("_in") != 0, F.col("_in")), "_own", F.lit(0)).alias("points"))


def items_from_cells(cells: DataFrame) -> DataFrame:
    """(doc_id, row_no, description, points): first other cell over 2 characters and first all-digit cell, else points in the text."""
    # each step is a column of its own, so that none is worked out again wherever it is used
    rows = cells.select("doc_id", "row_no", F.filter(F.transform("cells", strip), lambda x: F.coalesce(x != "", F.lit(False))).alias("_kept"))
    rows = rows.withColumn("_digits", F.get(digits_only("_kept"), F.lit(0)))
    rows = rows.withColumns({"_at": F.array_position("_kept", F.col("_digits")) - 1, "_own": F.coalesce(F.col("_digits").try_cast("int"), F.lit(0))})
    other = F.filter("_kept", lambda x, i: (F.length(x) > 2) & F.coalesce(i != F.col("_at"), F.lit(True)))
    rows = rows.select("doc_id", "row_no", "_own", F.coalesce(F.get(other, F.lit(0)), F.lit("")).alias("_main"))
    text = F.regexp_replace(F.regexp_replace("_main", rf"^[•·▪▫◦‣⁃-]{WS}*", ""), rf"^[0-9]+\.{WS}*", "")
    text = strip(F.regexp_replace(text, rf"(?i){WS}*[0-9]+{WS}*{PTS}?{WS}*$", ""))
    points = F.when(F.col("_own") != 0, F.col("_own")).otherwise(F.coalesce(number("_main", rf"(?i)([0-9]+){WS}*{PTS}"), F.col("_own")))
    return rows.select("doc_id", "row_no", text.alias("description"), points.alias("points"))


def cell_section_points(cells: DataFrame) -> DataFrame:
    return cells.select("doc_id", "row_no", section_points(F.array_join("cells", " ", ""), F.col("cells")).alias("points"))


def proximity_points(docs: DataFrame, names: DataFrame, radius: int = 100) -> DataFrame:
    """(doc_id, name, points): points within ``radius`` characters of a name's first place; 1 if there are none. ``names`` (doc_id, name)."""
    rows = docs.join(names, "doc_id")
    at = F.instr(F.lower("text"), F.lower("name"))
    near = F.substring(F.col("text"), F.greatest(F.lit(1), at - radius), F.when(at - radius < 1, at - 1).otherwise(F.lit(radius)) + F.length("name") + radius)
    found = F.coalesce(number(near, rf"(?i)([0-9]+){WS}*{PTS}"), number(near, rf"(?i){PTS}{WS}*[:=]{WS}*([0-9]+)"), number(near, rf"(?i)max(?:imum)?{WS}*[:=]?{WS}*([0-9]+)"), F.lit(1))
    return rows.select("doc_id", "name", F.when(at == 0, 1).otherwise(found).alias("points"))


def domain_scores(cells: DataFrame, span: int = 9) -> DataFrame:
    """(doc_id, domain, category, possible_points) from the ``span`` rows after the first that names domain and score or points.

    Second cell: domain, no-break space as space; fifth: all-digit points; the last of equal names counts.
    """
    low = F.lower(F.array_join("cells", " | ", ""))
    head = cells.filter(low.contains("domain") & (low.contains("score") | low.contains("points"))).groupBy("doc_id").agg(F.min("row_no").alias("_head"))
    rows = cells.join(head, "doc_id").filter(F.col("row_no").between(F.col("_head") + 1, F.col("_head") + span))
    domain, points = strip(F.replace(F.get("cells", F.lit(1)), F.lit(" "), F.lit(" "))), F.get("cells", F.lit(4))
    rows = rows.select("doc_id", "row_no", domain.alias("domain"), points.alias("p")).filter(F.regexp_like("p", F.lit("^[0-9]+$")) & (F.col("domain") != ""))
    return rows.groupBy("doc_id", "domain").agg(F.max_by("p", "row_no").try_cast("int").alias("possible_points")).select("doc_id", "domain", strip(F.regexp_replace("domain", r"(?s)\(.*$", "")).alias("category"), "possible_points")


def headers(lines: DataFrame, known=SECTIONS) -> DataFrame:
    """With ``section`` and ``max_points`` for lines that are headers: a known name in the text, else one of three forms."""
    text, low = F.col("text"), F.lower("text")
    name, points = F.lit(None).cast("string"), F.lit(None).cast("int")
    for form in reversed(HEADERS):
        hit = F.regexp_like(text, F.lit(form))
        name = F.when(hit, strip(F.regexp_extract(text, form, 1))).otherwise(name)
        points = F.when(hit, number(text, form, 2)).otherwise(points)
    anywhere = number(text, "([0-9]+)")
    for section in reversed(known):
        hit = low.contains(section.lower())
        name, points = F.when(hit, section).otherwise(name), F.when(hit, anywhere).otherwise(points)
    return lines.withColumn("section", name).withColumn("max_points", points)


def assign_sections(lines: DataFrame, known=SECTIONS) -> DataFrame:
    """(doc_id, line_no, text, section_no, section): list items under the latest header above; lines before any are dropped."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    # list items aren't looked through for headers
    rows = lines.withColumn("_listed", F.regexp_like("text", F.lit(BULLET))).withColumn("_text", F.col("text"))
    rows = headers(rows.withColumn("text", F.when(~F.col("_listed"), F.col("text"))), known).withColumn("text", F.col("_text")).withColumn("_head", F.col("section"))
    rows = rows.withColumn("section_no", F.sum(F.col("_head").isNotNull().cast("int")).over(order).cast("int")).withColumn("section", F.last("_head", ignorenulls=True).over(order))
    rows = rows.withColumn("section_points", F.last(F.when(F.col("_head").isNotNull(), F.coalesce("max_points", F.lit(0))), ignorenulls=True).over(order))
    return rows.filter(F.col("_listed") & F.col("section").isNotNull()).select("doc_id", "line_no", "text", "section_no", "section", "section_points")


def section_totals(items: DataFrame) -> DataFrame:
    """(doc_id, section_no, section, points, total): a section's own points, else its items' sum; the document's total."""
    rows = items.groupBy("doc_id", "section_no", "section").agg(F.max("section_points").alias("own"), F.sum(F.coalesce(points_in(F.col("text")), F.lit(0))).alias("summed"))
    rows = rows.withColumn("points", F.when(F.col("own") > 0, F.col("own").cast("long")).otherwise(F.col("summed")))
    return rows.select("doc_id", "section_no", "section", "points", F.sum("points").over(Window.partitionBy("doc_id")).alias("total"))


def line_kind(cells: DataFrame) -> DataFrame:
    """(doc_id, row_no, kind, section): header, item or neither, and the latest header."""
    kept = F.filter("cells", lambda x: F.coalesce(x != "", F.lit(False)))
    rows = cells.withColumn("_t", strip(F.array_join(kept, " ")))
    like = lambda p: F.regexp_like("_t", F.lit(p))
    head = like(r"^[A-Z][A-Z\x20\x09-\x0D]+$") | like(rf"^[0-9]+\.{WS}*[A-Z]") | like("^[A-Z].*:$") | ((F.length("_t") < 50) & (F.size("cells") <= 3))
    item = like(r"^[•·▪▫◦‣⁃-]") | like(r"^[0-9]+\.") | like(rf"(?i)^[A-Za-z0-9_]+.*[0-9]+{WS}*{PTS}") | (F.size(digits_only("cells")) > 0)
    kind = F.when(F.col("_t") == "", "neither").when(head, "header").when(item, "item").otherwise("neither")
    order = Window.partitionBy("doc_id").orderBy("row_no")
    rows = rows.withColumn("kind", kind).withColumn("section", F.last(F.when(F.col("kind") == "header", F.col("_t")), ignorenulls=True).over(order))
    return rows.select("doc_id", "row_no", F.when((F.col("kind") == "item") & F.col("section").isNull(), "neither").otherwise(F.col("kind")).alias("kind"), "section")


TITLE = rf"(?i)^([A-Za-z\x20\x09-\x0D]+){WS}*\(([0-9]+){WS}*points?\)"
NUMBERED = r"^[0-9]+[.)]"


def parse_rubric(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, section, name, points): ``Name (n points)`` headers and the listed items below them, both as criteria."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    pattern = rf"(?i)\(([0-9]+){WS}*points?\)"
    # each step is a column of its own, so that none is worked out again wherever it is used; all come before the window
    rows = lines.withColumn("_text", strip(F.col("text")))
    rows = rows.withColumn("_head", F.regexp_like("_text", F.lit(TITLE)))
    listed = ~F.col("_head") & (F.regexp_like("_text", F.lit("^[-•]")) | F.regexp_like("_text", F.lit(NUMBERED)))
    rows = rows.withColumns({"_title": F.when(F.col("_head"), strip(F.regexp_extract("_text", TITLE, 1))), "_item": F.when(listed, strip(F.regexp_replace("_text", rf"^[-•0-9.)]{WS}*", "")))})
    # only the first bracket with points is taken out
    name = F.when(F.regexp_like("_item", F.lit(pattern)), strip(F.regexp_replace("_item", rf"(?is)^(.*?)\([0-9]+{WS}*points?\)", "$1"))).otherwise(F.col("_item"))
    rows = rows.withColumns({"_name": name, "points": F.when(F.col("_head"), number("_text", TITLE, 2)).otherwise(F.coalesce(number("_item", pattern), F.lit(1)))})
    rows = rows.withColumn("section", F.last("_title", ignorenulls=True).over(order))
    kept = F.col("_head") | (F.col("section").isNotNull() & (F.length("_name") > 3))
    return rows.filter(kept).select("doc_id", "line_no", "section", F.when(F.col("_head"), F.col("section")).otherwise(F.col("_name")).alias("name"), "points")


def rubric_totals(lines: DataFrame) -> DataFrame:
    """(doc_id, title, n, total) of the parsed criteria."""
    rows = parse_rubric(lines).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("points").alias("total"))
    return rows.join(doc_title(lines).withColumnRenamed("value", "title"), "doc_id")


def match_categories(docs: DataFrame, categories: list[tuple[str, list[str], int]]) -> DataFrame:
    """(doc_id, category, default_points): every category of which the lower-cased text matches a pattern. A few categories; no join."""
    low = F.lower("text")
    found = [F.when(F.regexp_like(low, F.lit("|".join(patterns))), F.struct(F.lit(name).alias("category"), F.lit(points).alias("default_points"))) for name, patterns, points in categories]
    rows = docs.select("doc_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("c"))
    return rows.select("doc_id", "c.category", "c.default_points")


SUB_EXAMS = [
    (rf"(?i)^{WS}*[0-9]+[.)]{WS}*(.+?)(?:{WS}*\(([0-9]+){WS}*points?\))?$", 2),
    (rf"(?i)^{WS}*[-•]{WS}*(.+?)(?:{WS}*\(([0-9]+){WS}*points?\))?$", 2),
    (rf"(?i)^{WS}*(.+?):{WS}*(.+?)(?:{WS}*\(([0-9]+){WS}*points?\))?$", 3),
]


def sub_exams(lines: DataFrame, category: str, defaults: list[str], look: int = 9) -> DataFrame:
    """(doc_id, line_no, form, exam_id, name, points, examples): listed or ``a: b`` lines as items of a category.

    Examples come from ``example`` or ``verbalization`` lines among the next ``look``, up to the next
    numbered one; else the category's first three.
    """
    ahead = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(1, look)
    # a line's own examples are read once, not again for each of the lines before it
    said = F.lower("text").contains("example") | F.lower("text").contains("verbalization")
    cut = F.split(F.regexp_replace("text", r"(?i)^.*?(?:example|verbalization)[s:]*[\x20\x09-\x0D]*", ""), "[,;]")
    own = F.filter(F.transform(cut, lambda x: F.regexp_replace(strip(x), "^[\"']|[\"']$", "")), lambda x: x != "")
    line = F.struct(F.coalesce(F.regexp_like("text", F.lit(rf"^{WS}*[0-9]+[.)]")), F.lit(False)).alias("stop"), F.when(said, own).alias("words"))
    # null lines are no lines
    rows = lines.withColumn("_line", F.when(F.col("text").isNotNull(), line)).withColumn("_next", F.collect_list("_line").over(ahead))
    rows = rows.withColumn("_stop", F.array_position(F.transform("_next", lambda x: x["stop"]), True))
    rows = rows.withColumn("_next", F.when(F.col("_stop") > 0, F.slice("_next", F.lit(1), F.col("_stop") - 1)).otherwise(F.col("_next")))
    rows = rows.withColumn("_words", F.flatten(F.filter(F.transform("_next", lambda x: x["words"]), lambda x: x.isNotNull())))
    words = F.col("_words")
    rows = rows.withColumn("examples", F.when(F.size(words) > 0, words).otherwise(F.array(*[F.lit(x) for x in defaults[:3]])))
    forms = [F.when(F.regexp_like("text", F.lit(p)), F.struct(F.lit(i).alias("form"), strip(F.regexp_extract("text", p, 1)).alias("name"), F.coalesce(number("text", p, g), F.lit(1)).alias("points"))) for i, (p, g) in enumerate(SUB_EXAMS)]
    rows = rows.select("doc_id", "line_no", "examples", F.explode(F.filter(F.array(*forms), lambda x: x.isNotNull())).alias("m"))
    own = F.lower("m.name").contains(category.lower()) & (F.length("m.name") < 50)
    return rows.filter(~own).select("doc_id", "line_no", "m.form", exam_id(F.col("m.name")).alias("exam_id"), "m.name", F.greatest("m.points", F.lit(1)).alias("points"), "examples")
