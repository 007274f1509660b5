"""Queries over criteria, evidence, grades and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import criteria as c
from ..operators import evidence as e
from ..operators import tools
from ..sources import documents as src
from . import fixtures as fx
from .registry import query


def _joined(rows, column="examples", by="|"):
    return rows.withColumn(column, F.array_join(column, by))


@query("""SELECT doc_id, ord AS line_no, regexp_replace(name, ' ', '_', 'g') AS exam_id, name, max_points AS points, 'about ' || name AS description, name || '|' || section AS examples FROM fx_criteria""")
def csv_like_criteria(spark, d):
    line = F.concat_ws(",", "name", F.lit("x"), F.col("max_points").cast("string"), F.concat(F.lit("about "), "name"), F.concat("name", F.lit("; "), "section"))
    return _joined(c.csv_like_criteria(fx.criteria(spark, d).select("doc_id", F.col("ord").alias("line_no"), line.alias("text"))))


@query("""SELECT doc_id, ord AS line_no, name, section AS code, max_points AS points, 'about ' || name AS description, name || '|' || section AS items FROM fx_criteria WHERE ord > 1""")
def quoted_csv_criteria(spark, d):
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    line = F.concat_ws(",", q(F.col("name")), q(F.col("section")), F.col("max_points").cast("string"), q(F.concat(F.lit("about "), "name")), q(F.concat("name", F.lit("; "), "section")))
    rows = fx.criteria(spark, d).select("doc_id", F.col("ord").alias("line_no"), F.when(F.col("ord") == 1, "ASSESSMENT CRITERIA EXTRACTED").otherwise(line).alias("text"))
    return _joined(c.quoted_csv_criteria(rows), "items")


@query("SELECT doc_id, ord AS line_no, name || ' Test' AS name, max_points AS points FROM fx_criteria")
def table_criteria(spark, d):
    line = F.concat_ws(" | ", F.concat("name", F.lit(" Test")), "section", F.concat(F.lit("Row "), F.col("max_points").cast("string")))
    return c.table_criteria(fx.criteria(spark, d).select("doc_id", F.col("ord").alias("line_no"), line.alias("text")))


@query("SELECT doc_id, ord AS line_no, name || ' Examination' AS name, max_points AS points FROM fx_criteria")
def named_criteria(spark, d):
    line = F.concat(F.col("ord").cast("string"), F.lit(". "), "name", F.lit(" Examination - "), F.col("max_points").cast("string"), F.lit(" points"))
    return c.named_criteria(fx.criteria(spark, d).select("doc_id", F.col("ord").alias("line_no"), line.alias("text")))


@query("""WITH r AS (SELECT * FROM (VALUES (1, 'the', 'Article', 2), (2, 'und', 'Joint', 1), (3, 'der', 'Joint', 3), (4, 'que', 'That', 4)) t(o, k, name, p)),
h AS (SELECT doc_id, name, arg_min(p, o) AS points FROM documents, r WHERE contains(lower(text), k) GROUP BY ALL)
SELECT * FROM h UNION ALL SELECT doc_id, 'General', 5 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h)""")
def keyword_criteria(spark, d):
    return c.keyword_criteria(fx.table(spark, d, "documents"), [("the", "Article", 2), ("und", "Joint", 1), ("der", "Joint", 3), ("que", "That", 4)], [("General", 5)])


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'the.{0,9}of') THEN 'a' WHEN regexp_matches(lower(text), 'und.{0,9}der') THEN 'b' ELSE 'c' END AS name FROM documents
WHERE regexp_matches(lower(text), 'the.{0,9}of|und.{0,9}der|que')""")
def first_pattern_only(spark, d):
    return c.first_pattern_only(fx.table(spark, d, "documents"), [("the.{0,9}of", "a"), ("und.{0,9}der", "b"), ("que", "c")])


@query("""WITH p AS (SELECT p_partkey AS pattern_id, p_name || ' ' || lower(p_type) AS p, string_split(p_name || ' ' || lower(p_type), ' ') AS pw, p_partkey % 4 + 1 AS pc FROM part WHERE p_partkey < 40),
r AS (SELECT DISTINCT name AS t, max_points AS n FROM fx_criteria),
s AS (SELECT t, n, pattern_id, round(least(1.0::DOUBLE, CASE WHEN t = p THEN 1.0 WHEN contains(t, p) OR contains(p, t) THEN 0.7 ELSE len(list_filter(string_split(t, ' '), lambda w: list_contains(pw, w)))::DOUBLE / greatest(len(string_split(t, ' ')), len(pw)) END::DOUBLE
  + CASE WHEN n = pc THEN 0.2 ELSE 0.0 END::DOUBLE), 6) AS score FROM r, p),
b AS (SELECT t, n, pattern_id, score, row_number() OVER (PARTITION BY t, n ORDER BY score DESC, pattern_id) AS k FROM s WHERE score > 0.5)
SELECT doc_id, ord AS row_no, pattern_id, score FROM fx_criteria JOIN b ON t = name AND n = max_points AND k = 1""")
def best_pattern_match(spark, d):
    return _patterns(spark, d, fx.table(spark, d, "part").filter("p_partkey < 40"))


@query()
def best_pattern_match_whole(spark, d):
    """Against all parts."""
    return _patterns(spark, d, fx.table(spark, d, "part"))


def _patterns(spark, d, part):
    patterns = part.select(F.col("p_partkey").alias("pattern_id"), F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("pattern"), (F.col("p_partkey") % 4 + 1).alias("n_cols"))
    rows = fx.criteria(spark, d).select("doc_id", F.col("ord").alias("row_no"), F.col("name").alias("text"), F.col("max_points").alias("n_cols"))
    return c.best_pattern(rows, patterns)


@query("""WITH f AS (SELECT lower(p_brand) AS k, p_name, min(p_partkey) AS ord FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord, p_name) AS n FROM f),
s AS (SELECT DISTINCT p_brand AS section FROM part UNION SELECT 'Other')
SELECT section, coalesce((SELECT string_agg(p_name, '|' ORDER BY n) FROM r WHERE k = lower(section) AND n <= 5), 'one|two|three') AS examples FROM s""")
def mine_examples(spark, d):
    part = fx.table(spark, d, "part")
    sections = part.select(F.col("p_brand").alias("section")).distinct().union(spark.createDataFrame([("Other",)], "section string"))
    corpus = part.select(F.lower("p_brand").alias("section_key"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("example"))
    return _joined(c.mine_examples(sections, corpus, 5, ("one", "two", "three")))


def _three(spark, d):
    rows = fx.criteria(spark, d).select("doc_id", "ord", "name", F.col("max_points").alias("points"))
    return rows.filter("points % 2 = 0"), rows.filter("points % 3 = 0"), rows


UNIONED = "u AS (SELECT doc_id, ord, name, max_points AS points, 0 AS src FROM fx_criteria WHERE max_points % 2 = 0 UNION ALL SELECT doc_id, ord, name, max_points, 1 FROM fx_criteria WHERE max_points % 3 = 0 UNION ALL SELECT doc_id, ord, name, max_points, 2 FROM fx_criteria)"


@query(f"WITH {UNIONED} SELECT * FROM u")
def union_extractors(spark, d):
    return c.union_extractors(*_three(spark, d))


@query(f"WITH {UNIONED}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY src, ord) AS k FROM u) SELECT doc_id, ord, name, points, src FROM r WHERE k = 1")
def dedupe_criteria(spark, d):
    return c.dedupe_criteria(*_three(spark, d))


@query("""WITH x AS (SELECT doc_id, section, name, min(max_points) AS p FROM fx_criteria WHERE ord % 2 = 0 GROUP BY ALL), y AS (SELECT doc_id, section, name, max(max_points) AS p FROM fx_criteria WHERE ord % 3 = 0 GROUP BY ALL),
m AS (SELECT doc_id, section, name AS description, x.p AS xp, y.p AS yp FROM (SELECT *, CASE WHEN p < 3 THEN 0 ELSE p END AS q FROM x) x FULL JOIN y USING (doc_id, section, name))
SELECT doc_id, section, description, CASE WHEN coalesce(CASE WHEN xp < 3 THEN 0 ELSE xp END, 0) = 0 THEN coalesce(yp, CASE WHEN xp < 3 THEN 0 ELSE xp END) ELSE xp END AS points,
  CASE WHEN yp IS NOT NULL THEN 'a|b' ELSE 'a' END AS examples FROM m""")
def merge_analyses(spark, d):
    rows = fx.criteria(spark, d).withColumnRenamed("name", "description")
    a = rows.filter("ord % 2 = 0").groupBy("doc_id", "section", "description").agg(F.min("max_points").alias("points"))
    a = a.withColumn("points", F.when(F.col("points") < 3, 0).otherwise(F.col("points"))).withColumn("examples", F.array(F.lit("a")))
    b = rows.filter("ord % 3 = 0").groupBy("doc_id", "section", "description").agg(F.max("max_points").alias("points")).withColumn("examples", F.array(F.lit("a"), F.lit("b")))
    return _joined(c.merge_items(a, b))


@query("""WITH s AS (SELECT doc_id, section, 0 AS src, sum(max_points)::INT AS max_points FROM fx_criteria WHERE ord % 2 = 0 GROUP BY ALL UNION ALL SELECT doc_id, upper(section), 1, max(max_points) FROM fx_criteria GROUP BY ALL)
SELECT doc_id, arg_min(section, src) AS section, max(max_points) AS max_points FROM s GROUP BY doc_id, lower(section)""")
def merge_analyses_sections(spark, d):
    """Both analyses come from one pass: sums of the even items, largest points of all."""
    even = F.col("ord") % 2 == 0
    rows = fx.criteria(spark, d).groupBy("doc_id", "section").agg(F.sum(F.when(even, F.col("max_points"))).cast("int").alias("_sum"), F.max(even).alias("_even"), F.max("max_points").alias("_max"))
    row = lambda src, section, points: F.struct(F.lit(src).alias("_src"), section.alias("section"), F.col(points).alias("max_points"))
    first, second = row(0, F.col("section"), "_sum"), row(1, F.upper("section"), "_max")
    return c.merge_section_rows(rows.select("doc_id", F.inline(F.when(F.col("_even"), F.array(first, second)).otherwise(F.array(second)))))


@query("""WITH i AS (SELECT doc_id, section, max_points, name, row_number() OVER (PARTITION BY doc_id, section ORDER BY ord) AS k FROM fx_criteria WHERE section <> 'Management'),
s AS (SELECT doc_id, section, count(*)::INT AS n FROM fx_criteria WHERE section = 'Management' GROUP BY ALL)
SELECT doc_id, replace(section, ' ', '_') || '_' || k AS id, section || ': ' || name AS name, name AS description, max_points, section FROM i
UNION ALL SELECT doc_id, section, section, 'Assessment of ' || section, n, section FROM s""")
def sections_to_criteria(spark, d):
    item = F.when(F.col("section") != "Management", F.struct("ord", F.col("name").alias("description"), F.col("max_points").alias("points")))
    rows = fx.criteria(spark, d).groupBy("doc_id", "section").agg(F.count("*").cast("int").alias("max_points"), F.array_sort(F.collect_list(item)).alias("items"))
    return c.sections_to_criteria(rows)


@query("""WITH c AS (SELECT doc_id, name, max_points AS points FROM fx_criteria WHERE doc_id % 3 > 0), d AS (SELECT DISTINCT doc_id FROM fx_criteria)
SELECT * FROM c UNION ALL SELECT doc_id, n, p FROM d, (VALUES ('History', 5), ('Exam', 15)) t(n, p) WHERE doc_id NOT IN (SELECT doc_id FROM c)""")
def default_criteria(spark, d):
    rows = fx.criteria(spark, d).withColumn("points", F.col("max_points"))
    return c.with_defaults(rows.select("doc_id").distinct(), rows.filter("doc_id % 3 > 0"), [("History", 5), ("Exam", 15)])


@query("""WITH f AS (SELECT DISTINCT doc_id, ['skin check.docx', 'Back_Pain.PDF', 'pain.skin', 'station.txt'][(doc_id % 4 + 1)::INT] AS name FROM fx_criteria WHERE doc_id % 3 = 0),
t AS (SELECT * FROM (VALUES (0, 0, 'Skin_Inspection', 'Skin Inspection', 3, 'I''m looking for any rashes or abnormalities'), (0, 1, 'Lesion_Assessment', 'Lesion Assessment', 2, 'Let me look at the characteristics of this rash'),
  (1, 0, 'Back_Examination', 'Back Examination', 4, 'Let me check your spine'), (1, 1, 'Range_of_Motion', 'Range of Motion Assessment', 3, 'Try to touch your toes'),
  (2, 0, 'Patient_History', 'Patient History', 5, 'When did this start?'), (2, 1, 'Physical_Examination', 'Physical Examination', 4, 'Let me check your vital signs'), (2, 2, 'Assessment_and_Plan', 'Assessment and Plan', 3, 'I think the most likely diagnosis is')) t(k, ord, exam_id, name, max_points, second))
SELECT doc_id, ord, exam_id, t.name, max_points, second, 3 AS n FROM f JOIN t ON k = CASE WHEN f.name LIKE 'skin%' THEN 0 WHEN f.name = 'Back_Pain.PDF' OR f.name = 'pain.skin' THEN 1 ELSE 2 END""")
def default_criteria_by_name(spark, d):
    """Documents without criteria get those for their file's name, its extension apart."""
    rows = fx.criteria(spark, d)
    name = F.get(F.array(*map(F.lit, ("skin check.docx", "Back_Pain.PDF", "pain.skin", "station.txt"))), (F.col("doc_id") % 4).cast("int"))
    found = c.defaults_by_name(rows.select("doc_id").distinct().withColumn("file_name", name), rows.filter("doc_id % 3 > 0"))
    return found.select("doc_id", "ord", "exam_id", "name", "max_points", F.get("examples", F.lit(1)).alias("second"), F.size("examples").alias("n"))


_ACTIONS = ("Wash your hands", "Inspects the skin", "Introduces oneself", "Explain the consent", "Palpation", "Auscultation: listen", "")


@query("""WITH i AS (SELECT doc_id, ord, ['Wash your hands', 'Inspects the skin', 'Introduces oneself', 'Explain the consent', 'Palpation', 'Auscultation: listen', ''][(doc_id + ord) % 7 + 1] AS item, name FROM fx_criteria),
p AS (SELECT * FROM (VALUES ('Wash your hands', 0, 'I''m going to wash my hands before the examination'), ('Inspects the skin', 0, 'I''m going to inspect your skin carefully'), ('Inspects the skin', 1, 'Let me examine the affected area'), ('Introduces oneself', 0, 'Hello, I''m Dr. Smith and I''ll be examining you today'),
  ('Explain the consent', 0, 'Is it okay if I proceed with the examination?'), ('Palpation', 0, 'I''m going to feel this area with my hands'), ('Auscultation: listen', 0, 'I''m going to listen to your heart and lungs')) p(item, k, phrase)),
g AS (SELECT doc_id, -1 AS ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k, name AS phrase FROM i WHERE doc_id % 3 = 0 QUALIFY k <= 3 UNION ALL SELECT doc_id, ord, k, phrase FROM i JOIN p USING (item)),
d AS (SELECT doc_id, phrase, min((ord, k)) AS pos FROM g GROUP BY ALL), r AS (SELECT doc_id, phrase, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM d),
a AS (SELECT doc_id, string_agg(phrase, '|' ORDER BY pos) AS x, any_value(n) AS n FROM r WHERE r <= 4 GROUP BY doc_id)
SELECT doc_id, CASE WHEN n IS NULL THEN 'I''m going to perform this examination now|Please let me know if you feel any discomfort' WHEN n = 1 THEN x || '|Please let me know if you feel any discomfort' ELSE x END AS examples FROM (SELECT DISTINCT doc_id FROM i) LEFT JOIN a USING (doc_id)""")
def item_examples(spark, d):
    """Phrases for the items of a document; every third has phrases of its own."""
    item = F.get(F.array(*map(F.lit, _ACTIONS)), ((F.col("doc_id") + F.col("ord")) % 7).cast("int"))
    listed = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("ord", x.alias("x")))), lambda y: y["x"])
    rows = fx.criteria(spark, d).groupBy("doc_id").agg(listed(item).alias("items"), listed(F.col("name")).alias("found"))
    found = F.when(F.col("doc_id") % 3 == 0, F.col("found"))
    return rows.select("doc_id", F.array_join(c.item_examples(F.col("items"), found), "|").alias("examples"))


@query("""WITH s AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS section FROM part UNION SELECT 'Other'), q AS (SELECT p_brand, min(p_partkey) AS prompt_id FROM part GROUP BY p_brand),
m AS (SELECT DISTINCT section, p_brand FROM s JOIN part ON starts_with(lower(p_type), lower(section))), x AS (SELECT p_brand, p_partkey AS k, p_name FROM part),
f AS (SELECT section, p_name, min((prompt_id, k)) AS pos FROM m JOIN q USING (p_brand) JOIN x USING (p_brand) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY pos) AS r FROM f)
SELECT section, coalesce((SELECT string_agg(p_name, '|' ORDER BY r) FROM r WHERE r.section = s.section AND r <= 5), 'Perform ' || lower(section) || ' assessment|Document findings related to ' || lower(section) || '|Complete ' || lower(section) || ' evaluation') AS examples FROM s""")
def examples_by_name(spark, d):
    """A brand's parts are a prompt: their types its names, their own names its examples; sections are the first words of types."""
    part = fx.table(spark, d, "part")
    ids = part.groupBy("p_brand").agg(F.min("p_partkey").alias("prompt_id"))
    names = part.select("p_brand", F.col("p_type").alias("name")).distinct().join(ids, "p_brand")
    examples = part.groupBy("p_brand", F.col("p_name").alias("example")).agg(F.min("p_partkey").alias("ord")).join(ids, "p_brand")
    sections = part.select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("section")).distinct().union(spark.createDataFrame([("Other",)], "section string"))
    return _joined(c.examples_by_rows(sections, names, examples))


@query("""SELECT name AS exam_id, count(*) AS n, md5(string_agg(name || '|' || section, '|' ORDER BY doc_id % 10, doc_id, ord)) AS digest FROM fx_criteria GROUP BY name""")
def exam_examples(spark, d):
    rows = fx.criteria(spark, d).select(F.col("name").alias("exam_id"), F.struct(F.col("doc_id") % 10, "doc_id").alias("station"), "ord", "examples")
    return c.exam_examples(rows).select("exam_id", "n", F.md5(F.array_join("examples", "|")).alias("digest"))


@query("""WITH t AS (SELECT DISTINCT doc_id, ['OK', ' x  ', 'Title', NULL][(doc_id % 4 + 1)::INT] AS title FROM fx_criteria), s AS (SELECT DISTINCT doc_id, section, CASE WHEN doc_id % 5 = 0 THEN ' ' || section[1:2] || ' ' ELSE section END AS name FROM fx_criteria)
SELECT doc_id, 'title' AS rule, 'title' AS key FROM t WHERE length(trim(coalesce(title, ''))) < 3 UNION ALL SELECT doc_id, 'section_name', section FROM s WHERE length(trim(name)) < 3""")
def short_names(spark, d):
    rows = fx.criteria(spark, d)
    title = F.get(F.array(F.lit("OK"), F.lit(" x  "), F.lit("Title"), F.lit(None)), (F.col("doc_id") % 4).cast("int"))
    name = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" "), F.substring("section", 1, 2), F.lit(" "))).otherwise(F.col("section"))
    return c.name_violations(rows.select("doc_id").distinct().withColumn("title", title), rows.select("doc_id", F.col("section").alias("section_id"), name.alias("section")))


@query("""SELECT doc_id, ord, CASE WHEN section LIKE 'History%' THEN 'Tell me about your ' || name || '|I''d like to ask about your ' || name WHEN section LIKE 'Physical%' THEN 'I''m going to examine your ' || name || '|Let me check this area'
  ELSE 'I''m assessing ' || name || '|Let me evaluate ' || name END AS examples FROM fx_criteria""")
def section_examples(spark, d):
    return fx.criteria(spark, d).select("doc_id", "ord", F.array_join(c.section_examples(F.col("section"), F.col("name")), "|").alias("examples"))


@query("""SELECT doc_id, ord, name, CASE WHEN max_points % 3 = 0 THEN 1 ELSE max_points END AS points, CASE WHEN ord % 2 = 0 THEN 'Assessing ' || lower(name) ELSE name || '|' || section END AS examples FROM fx_criteria WHERE ord % 5 > 0""")
def normalize_criteria(spark, d):
    rows = fx.criteria(spark, d).select("doc_id", "ord", F.when(F.col("ord") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "name")).alias("name"), F.when(F.col("max_points") % 3 == 0, "many").otherwise(F.col("max_points").cast("string")).alias("points"), F.when(F.col("ord") % 2 > 0, F.col("examples")).alias("examples"))
    return _joined(c.normalize_criteria(rows))


@query("""SELECT doc_id, ord, max_points AS excellent, floor(max_points * 0.8::DOUBLE)::INT AS good, floor(max_points * 0.6::DOUBLE)::INT AS satisfactory, floor(max_points * 0.3::DOUBLE)::INT AS needs_improvement, 0 AS unsatisfactory, max_points * 2 AS minutes FROM fx_criteria""")
def score_bands(spark, d):
    return c.score_bands(fx.criteria(spark, d)).select("doc_id", "ord", "excellent", "good", "satisfactory", "needs_improvement", "unsatisfactory", "minutes")


@query("""WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(name, '[^a-zA-Z0-9\\x20\\x09-\\x0D]', '', 'g'), '[\\x20\\x09-\\x0D]+', '_', 'g') AS id, ord, max_points FROM fx_criteria),
u AS (SELECT doc_id, id, min(ord) AS ord, arg_min(max_points, ord) AS m FROM f GROUP BY ALL)
SELECT doc_id, '{"type":"object","properties":{' || string_agg('"' || id || '":{"type":"integer","minimum":0,"maximum":' || m || '}', ',' ORDER BY ord) || '},"required":[' || string_agg('"' || id || '"', ',' ORDER BY ord) || ']}' AS schema_json FROM u GROUP BY doc_id""")
def response_schema_json(spark, d):
    return c.response_schema(fx.criteria(spark, d))


@query("""WITH f AS (SELECT *, min(ord) OVER (PARTITION BY doc_id, section) AS first FROM fx_criteria),
l AS (SELECT *, CASE WHEN ord = first THEN '## ' || section || E'\\n' ELSE '' END || '- ' || name || ' (' || max_points || ')' AS line FROM f)
SELECT doc_id, 'criteria: ' || count(*) || ', points: ' || sum(max_points) || E'\\n' || string_agg(line, E'\\n' ORDER BY first, ord) AS prompt, count(*) AS n, sum(max_points)::BIGINT AS total FROM l GROUP BY doc_id""")
def render_prompt(spark, d):
    return c.render_prompt(fx.criteria(spark, d))


@query("""WITH i AS (SELECT doc_id, section, CASE WHEN ord % 7 = 0 THEN 'x' ELSE name END AS item, name, CASE WHEN ord % 11 = 0 THEN -1 ELSE max_points END AS p FROM fx_criteria)
SELECT doc_id, 'id' AS rule, item AS key FROM i WHERE contains(item, ' ') UNION ALL SELECT doc_id, 'negative', item FROM i WHERE p < 0
UNION ALL SELECT doc_id, 'duplicate_in_section', item FROM i GROUP BY doc_id, section, item HAVING count(*) > 1 UNION ALL SELECT doc_id, 'duplicate_in_rubric', item FROM i GROUP BY doc_id, item HAVING count(*) > 1
UNION ALL SELECT DISTINCT doc_id, 'section_id', section FROM i WHERE contains(section, ' ')
UNION ALL SELECT doc_id, 'total', 'total' FROM i GROUP BY doc_id HAVING sum(p) <> 20 UNION ALL SELECT -1, 'empty', 'sections'""")
def validate_rubrics(spark, d):
    rows = fx.criteria(spark, d).select("doc_id", F.col("section").alias("section_id"), F.when(F.col("ord") % 7 == 0, "x").otherwise(F.col("name")).alias("item_id"), F.col("name").alias("description"), F.when(F.col("ord") % 11 == 0, -1).otherwise(F.col("max_points")).alias("points"))
    totals = rows.select("doc_id").distinct().withColumn("total_points", F.lit(20)).union(spark.createDataFrame([(-1, 20)], "doc_id long, total_points int"))
    return c.violations(rows, totals)


@query("SELECT doc_id, count(*) AS n_items, sum(max_points)::BIGINT AS points FROM fx_criteria WHERE (doc_id, name) IN (SELECT doc_id, name FROM fx_criteria WHERE ord = 2) GROUP BY doc_id")
def rubric_lookup(spark, d):
    rows = fx.criteria(spark, d)
    return c.lookup_totals(c.lookup(rows, rows.filter("ord = 2").select("doc_id", "name")))


@query("SELECT l_orderkey AS doc_id, l_returnflag AS domain, sum(l_linenumber)::BIGINT AS points, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_orderkey, l_returnflag), (l_orderkey))")
def score_breakdown(spark, d):
    return c.score_breakdown(_domain_scores(spark, d))


def _domain_scores(spark, d):
    return fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("domain"), F.col("l_linenumber").alias("points"))


@query("SELECT l_orderkey AS doc_id, coalesce(sum(l_linenumber) FILTER (l_returnflag = 'R'), 0)::BIGINT AS history, coalesce(sum(l_linenumber) FILTER (l_returnflag <> 'R'), 0)::BIGINT AS diagnostic FROM lineitem GROUP BY 1")
def domain_points(spark, d):
    return c.domain_points(_domain_scores(spark, d), {"history": ["R"], "diagnostic": ["A", "N"]})


@query("""SELECT station, domain, sum(earned) AS earned, sum(possible) AS possible, grouping(station, domain)::BIGINT AS level, round(100 * sum(earned) / sum(possible), 4) AS pct FROM fx_scores GROUP BY ROLLUP (station, domain)""")
def score_rollup(spark, d):
    return c.score_rollup(fx.scores(spark, d), ["station", "domain"])


@query("""SELECT station, domain, sum(earned) AS earned, sum(possible) AS possible, grouping(station, domain)::BIGINT AS level, round(100 * sum(earned) / sum(possible), 4) AS pct FROM fx_scores GROUP BY CUBE (station, domain)""")
def score_cube(spark, d):
    return c.score_rollup(fx.scores(spark, d), ["station", "domain"], "cube")


def _examples(spark, d):
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0), 1, 3)
    rows = fx.table(spark, d, "conversations").filter("turn = 0")
    return rows.select((F.col("conv_id") % 5).alias("exam_id"), F.array_join(words, " ").alias("example"))


EXAMS = """x AS (SELECT DISTINCT conv_id % 5 AS exam_id, regexp_replace(' ' || regexp_replace(lower(array_to_string(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')[1:3], ' ')), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ', ' +', ' ', 'g') AS e FROM conversations WHERE turn = 0),
h AS (SELECT t.video_id, x.exam_id, t.turn_no, t.text, t."start", t."end" FROM fx_speaker_turns t JOIN x ON contains(' ' || regexp_replace(lower(t.text), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ', x.e) WHERE trim(x.e) <> ''),
f AS (SELECT video_id, exam_id, arg_min(text, turn_no) AS text, arg_min("start", turn_no) AS "start", arg_min("end", turn_no) AS "end" FROM h GROUP BY ALL),
m AS (SELECT v.video_id, k.exam_id, coalesce(f.text, 'No exam was performed') AS statement, coalesce(f."start"::VARCHAR, 'nan') AS start_time, coalesce(f."end"::VARCHAR, 'nan') AS end_time, (f.video_id IS NOT NULL)::INT AS score
  FROM (SELECT DISTINCT video_id FROM fx_speaker_turns) v CROSS JOIN (SELECT DISTINCT exam_id FROM x) k LEFT JOIN f ON f.video_id = v.video_id AND f.exam_id = k.exam_id)"""


@query(f"WITH {EXAMS} SELECT * FROM m")
def exam_match(spark, d):
    return c.exam_match(fx.speaker_turns(spark, d), _examples(spark, d))


@query(f"""WITH {EXAMS} SELECT video_id, min(CASE WHEN score = 1 THEN start_time::DOUBLE END) AS "start", max(CASE WHEN score = 1 THEN end_time::DOUBLE END) AS "end", sum(score)::BIGINT AS n FROM m GROUP BY video_id""")
def exam_span(spark, d):
    return c.exam_span(exam_match(spark, d))


@query(f"WITH {EXAMS} SELECT video_id, sum(score)::BIGINT AS n, CASE WHEN sum(score) >= 3 THEN 0 WHEN sum(score) >= 1 THEN 1 ELSE 2 END AS score FROM m GROUP BY video_id")
def count_band_score(spark, d):
    return c.band_scores(c.exam_span(exam_match(spark, d)).select("video_id", "n"), [(3, None, 0), (1, 2, 1), (0, 0, 2)])


GRADES = """g AS (SELECT response_id, question_id, event_id % 7 - 1 AS grade, repeat('seen ', (event_id % 4)::INT) AS rationale FROM (SELECT event_id, event_id AS response_id, user_id AS question_id FROM events WHERE event_id % 10 <> 9))"""


@query(f"WITH {GRADES} SELECT response_id, question_id, TRUE AS parsed, grade::INT AS grade, rationale FROM g UNION ALL SELECT event_id, user_id, FALSE, NULL, NULL FROM events WHERE event_id % 10 = 9")
def llm_json_parse(spark, d):
    good, bad = e.parse_json(fx.responses(spark, d), "grade int, rationale string")
    a = good.select("response_id", "question_id", F.lit(True).alias("parsed"), "grade", "rationale")
    return a.union(bad.select("response_id", "question_id", F.lit(False), F.lit(None).cast("int"), F.lit(None).cast("string")))


@query(f"WITH {GRADES} SELECT response_id, NOT (grade < 0 OR length(rationale) < 10) AS is_valid, CASE WHEN grade < 0 THEN 'grade' WHEN length(rationale) < 10 THEN 'rationale' END AS reason FROM g")
def grade_validate(spark, d):
    good, _ = e.parse_json(fx.responses(spark, d), "grade int, rationale string")
    return e.validate_grades(good).select("response_id", "is_valid", "reason")


def _tools(spark):
    return spark.createDataFrame([("click", "visual"), ("view", "audio"), ("purchase", "temporal"), ("error", "visual")], "tool string, category string")


def _plans(spark, d):
    names = F.array_join(F.transform(F.array_sort(F.collect_set("event_type")), lambda x: F.concat(F.lit(' "'), x, F.lit('" '))), ",")
    return fx.table(spark, d, "events").groupBy(F.col("user_id").alias("plan_id")).agg(names.alias("tools"))


SELECTED = """t AS (SELECT * FROM (VALUES ('click', 'visual'), ('view', 'audio'), ('purchase', 'temporal'), ('error', 'visual')) t(tool, category)),
p AS (SELECT plan_id, (row_number() OVER (PARTITION BY plan_id ORDER BY tool) - 1)::INT AS step, tool FROM (SELECT DISTINCT user_id AS plan_id, event_type AS tool FROM events)),
s AS (SELECT * FROM p WHERE tool IN (SELECT tool FROM t))"""


@query(f"WITH {SELECTED} SELECT * FROM s")
def tool_selection(spark, d):
    return e.select_tools(_plans(spark, d), _tools(spark))


@query(f"""WITH {SELECTED}, c AS (SELECT * FROM (VALUES ('purchase', 0, 'load'), ('purchase', 1, 'view'), ('view', 0, 'load')) t(tool, ord, needed)),
u AS (SELECT plan_id, step AS s, 1000000 AS o, tool FROM s UNION ALL SELECT plan_id, step, ord, needed FROM s JOIN c USING (tool)), f AS (SELECT plan_id, tool, min((s, o)) AS pos FROM u GROUP BY ALL)
SELECT plan_id, (row_number() OVER (PARTITION BY plan_id ORDER BY pos, tool) - 1)::INT AS step, tool FROM f""")
def tool_dependencies(spark, d):
    closure = spark.createDataFrame([("purchase", 0, "load"), ("purchase", 1, "view"), ("view", 0, "load")], "tool string, ord int, needed string")
    return e.expand_tools(e.select_tools(_plans(spark, d), _tools(spark)), closure)


@query("""RECURSIVE WITH n AS (SELECT p_partkey AS tool, 0 AS ord, p_partkey // 3 AS needed FROM part WHERE p_partkey // 3 > 0 UNION ALL SELECT p_partkey, 1, p_partkey // 4 FROM part WHERE p_partkey // 4 > 0),
w AS (SELECT tool, needed, [ord] AS path FROM n UNION ALL SELECT w.tool, n.needed, list_append(path, n.ord) FROM w JOIN n ON n.tool = w.needed),
b AS (SELECT tool, needed, min(path) AS path FROM w GROUP BY ALL)
SELECT tool, (row_number() OVER (PARTITION BY tool ORDER BY list_append(path, 2147483647)) - 1)::INT AS ord, needed FROM b""")
def tool_closure(spark, d):
    """Parts as tools: each needs the one at a third of its number, then the one at a quarter."""
    part = F.col("p_partkey")
    both = F.posexplode(F.array(F.floor(part / 3), F.floor(part / 4))).alias("ord", "needed")
    return tools.closure_of(fx.table(spark, d, "part").select(part.alias("tool"), both).filter("needed > 0"))


def registry(spark, d) -> tools.Registry:
    """Two categories over the events: what was seen of a plan's user, and when."""
    found = tools.Registry()
    text = lambda c: F.col(c).cast("string").alias("item")

    @found.category("visual")
    def seen(plans):
        return fx.outputs(spark, d).withColumnRenamed("question_id", "plan_id").join(plans, "plan_id", "left_semi")

    @found.category("temporal")
    def timed(plans):
        return fx.clips(spark, d).withColumnRenamed("video_id", "plan_id").join(plans, "plan_id", "left_semi")

    found.tool("click", "visual")(lambda hits: hits.filter("tool = 'click'").select("plan_id", "item_no", text("k")))
    found.tool("error", "visual")(lambda hits: hits.filter("tool = 'error' and item_no <= 2").select("plan_id", "item_no", text("k")))
    found.tool("purchase", "temporal")(lambda hits: hits.filter("label = 'purchase'").select("plan_id", F.col("clip_no").alias("item_no"), text("label")))
    return found


@query(f"""WITH {SELECTED}, h AS (SELECT question_id AS plan_id, tool, item_no, k::VARCHAR AS item FROM fx_outputs WHERE tool = 'click' OR tool = 'error' AND item_no <= 2
  UNION ALL SELECT video_id, label, clip_no, label FROM fx_clips WHERE label = 'purchase')
SELECT plan_id, step, tool, category, item_no, item FROM s JOIN t USING (tool) JOIN h USING (plan_id, tool)""")
def tool_evidence(spark, d):
    return registry(spark, d).run(e.select_tools(_plans(spark, d), _tools(spark)))


@query(f"WITH {SELECTED} SELECT plan_id, step, tool, category FROM s JOIN t USING (tool)")
def tool_routing(spark, d):
    return e.route_tools(e.select_tools(_plans(spark, d), _tools(spark)), _tools(spark)).select("plan_id", "step", "tool", "category")


@query("SELECT video_id, question_id, item_no AS rank, tool, i::INT AS item_no, k, round(confidence + i, 6) AS confidence FROM fx_outputs, range(2) r(i) WHERE item_no <= 5")
def evidence_explode_join(spark, d):
    rows = fx.outputs(spark, d)
    one = lambda i: F.struct("k", F.round(F.col("confidence") + i, 6).alias("confidence"))
    outputs = rows.select("video_id", "question_id", F.col("item_no").alias("rank"), "tool", F.to_json(F.array(one(0), one(1))).alias("payload"))
    hits = rows.select("video_id", "question_id", F.col("item_no").alias("rank")).filter("rank <= 5").distinct()
    return e.evidence_rows(hits, outputs, "k: int, confidence: double")


@query("""SELECT question_id, tool, 'Tool: ' || tool || E'\\n' || string_agg('  - ' || '{"k":' || k || '}', E'\\n' ORDER BY item_no) || CASE WHEN any_value(n) > 5 THEN E'\\n  - ... (and ' || (any_value(n) - 5) || ' more items not shown due to brevity)' ELSE '' END AS text
FROM (SELECT *, count(*) OVER (PARTITION BY question_id, tool) AS n FROM fx_outputs) WHERE item_no <= 5 GROUP BY question_id, tool""")
def evidence_text(spark, d):
    return e.evidence_text(fx.outputs(spark, d).select("question_id", "tool", "item_no", F.to_json(F.struct("k")).alias("item")))


_TOOLS = ("audio_transcript_extractor", "keyframe_captioner", "object_detector", "pose_analyzer", "scene_interaction_analyzer", "temporal_action_segmenter", "other")


@query("""WITH i AS (SELECT question_id, tool AS kind, item_no, k, question_id % 7 AS t, count(*) OVER (PARTITION BY question_id, tool) AS n FROM fx_outputs),
l AS (SELECT *, ['audio_transcript_extractor', 'keyframe_captioner', 'object_detector', 'pose_analyzer', 'scene_interaction_analyzer', 'temporal_action_segmenter', 'other'][t + 1] || '_' AS u,
  CASE t WHEN 0 THEN 'Transcript (' || k || 's - N/As): "' || kind || '"' WHEN 1 THEN 'Caption (Timestamp: ' || k || 's): ""' WHEN 2 THEN 'Object: ''N/A'' (Timestamp: ' || k || 's, Conf: ' || k || '.00, Context: )'
  WHEN 3 THEN 'Pose - N/A (Timestamp: ' || k || 's): ' || repeat(chr(39), 2) || ', Gaze: ' || repeat(chr(39), 2) WHEN 4 THEN 'Interaction (Timestamp: ' || k || 's): Subject=''N/A'', Action=''N/A'', Object=''N/A'' (Detail: None)' WHEN 5 THEN 'Action: ''N/A'' (' || k || 's - N/As)'
  ELSE '{"start_time":' || k || ',"timestamp":' || k || ',"confidence_score":' || k || ',"transcript":"' || kind || '"}' END AS line FROM i)
SELECT question_id, kind, 'Tool: ' || rtrim(u, '_') || E'\\n' || string_agg('  - ' || line, E'\\n' ORDER BY item_no) || CASE WHEN any_value(n) > 5 THEN E'\\n  - ... (and ' || (any_value(n) - 5) || ' more items not shown due to brevity)' ELSE '' END AS text
FROM l WHERE item_no <= 5 GROUP BY question_id, kind, u""")
def evidence_text_forms(spark, d):
    """Items in each tool's own form, fields missing; one tool for a question, its kinds apart."""
    k = F.col("k")
    item = F.to_json(F.struct(k.alias("start_time"), k.alias("timestamp"), k.alias("confidence_score"), F.col("tool").alias("transcript")))
    name = F.get(F.array(*map(F.lit, _TOOLS)), (F.col("question_id") % 7).cast("int"))
    rows = fx.outputs(spark, d).select(F.struct("question_id", F.col("tool").alias("kind")).alias("question_id"), name.alias("tool"), "item_no", item.alias("item"))
    return e.evidence_text(rows).select("question_id.question_id", "question_id.kind", "text")


COUNTS = "c AS (SELECT question_id, tool, sum(CASE WHEN question_id % 5 = 0 THEN 0 ELSE 1 END) AS n FROM fx_outputs WHERE question_id % 7 > 0 GROUP BY 1, 2)"


@query(f"""WITH {COUNTS}, q AS (SELECT DISTINCT question_id FROM fx_outputs), n AS (SELECT question_id, sum(n) AS n FROM c GROUP BY 1)
SELECT question_id, CASE WHEN n IS NULL THEN 'no_tools' WHEN n = 0 THEN 'empty' ELSE 'to_score' END AS state, CASE WHEN coalesce(n, 0) = 0 THEN 0 END AS grade FROM q LEFT JOIN n USING (question_id)""")
def evidence_gate(spark, d):
    rows = fx.outputs(spark, d)
    counts = rows.filter("question_id % 7 > 0").groupBy("question_id", "tool").agg(F.count("*").alias("n")).select("question_id", "tool", F.when(F.col("question_id") % 5 == 0, 0).otherwise(F.col("n")).alias("n_items"))
    return e.evidence_gate(rows.select("question_id").distinct(), counts).select("question_id", "state", "grade")


@query("""WITH q AS (SELECT DISTINCT video_id, question_id FROM fx_outputs), t AS (SELECT video_id, question_id, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools, count(*) AS n_items FROM fx_outputs WHERE question_id % 2 = 0 GROUP BY ALL)
SELECT video_id, question_id, tools, n_items, CASE WHEN question_id % 3 = 0 THEN (question_id % 5)::INT END AS grade, CASE WHEN question_id % 4 = 0 THEN TRUE END AS flagged FROM q LEFT JOIN t USING (video_id, question_id)""")
def assemble_assessment(spark, d):
    rows, keys = fx.outputs(spark, d), ["video_id", "question_id"]
    q = rows.select(*keys).distinct()
    tools = rows.filter("question_id % 2 = 0").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"))
    items = rows.filter("question_id % 2 = 0").groupBy(*keys).agg(F.count("*").alias("n_items"))
    return e.assemble(q, tools, items, q.filter("question_id % 3 = 0").withColumn("grade", (F.col("question_id") % 5).cast("int")), q.filter("question_id % 4 = 0").withColumn("flagged", F.lit(True)))


@query("SELECT video_id, video_id % 2 = 0 AS hit, count(*) AS n FROM fx_clips GROUP BY ALL")
def cache_hit_miss(spark, d):
    rows = fx.clips(spark, d)
    hits, misses = e.split_cache(rows.select("video_id", "clip_no"), rows.filter("video_id % 2 = 0").select("video_id").distinct(), ["video_id"])
    return hits.select("video_id", F.lit(True).alias("hit")).union(misses.select("video_id", F.lit(False))).groupBy("video_id", "hit").agg(F.count("*").alias("n"))


@query("SELECT id + 10000 AS id, id + 10000 >= (SELECT count(*) FROM fx_videos) AS inserted FROM fx_videos")
def insert_if_absent(spark, d):
    base = fx.videos(spark, d).select("id")
    new, refused = e.insert_if_absent(base, base.select((F.col("id") + 10000).alias("id")))
    return new.withColumn("inserted", F.lit(True)).union(refused.withColumn("inserted", F.lit(False)))


@query("SELECT id, video_id FROM fx_points WHERE video_id NOT IN (1, 4)")
def cascade_delete(spark, d):
    return e.cascade_delete(fx.points(spark, d).select("id", "video_id"), spark.createDataFrame([(1,), (4,)], "video_id int"))


@query("SELECT id, CASE WHEN id < 100 THEN 'media' ELSE 'metadata' END AS kind FROM fx_points WHERE id < 100 OR id >= 400")
def orphan_metadata(spark, d):
    ids = fx.points(spark, d).select("id")
    return e.orphans(ids.filter("id < 400"), ids.filter("id >= 100"), "id")


@query("SELECT id, created_at, frames, fps, (SELECT count(*) FROM fx_videos) AS total FROM fx_videos ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def catalog_page(spark, d):
    return e.catalog_page(fx.videos(spark, d), 40, 20)


@query("SELECT url FROM pages WHERE url LIKE 'https://www.%'")
def list_by_prefix(spark, d):
    return e.by_prefix(fx.table(spark, d, "pages").select("url"), "https://www.", "url")


@query("SELECT doc_id, ord, section, name, max_points FROM fx_criteria")
def sink_json_rows(spark, d):
    rows = src.json_rows(fx.criteria(spark, d).select("doc_id", "ord", "section", "name", "max_points"), "doc_id")
    return rows.select(F.from_json("json", "doc_id long, ord int, section string, name string, max_points int").alias("r")).select("r.*")
