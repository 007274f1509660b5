"""Queries over documents, rubric lines and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import actions, rubric
from ..sources import documents as src
from . import fixtures as fx
from .registry import query

TRIM = r"regexp_replace({}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"


def trim(x: str) -> str:
    return TRIM.format(x)


def _lines(spark, d):
    return src.text_lines(fx.table(spark, d, "documents"))


@query("SELECT doc_id, line_no, text FROM fx_lines")
def src_text_lines(spark, d):
    return _lines(spark, d)


@query("SELECT p_partkey, 'p_name: ' || p_name || ' | p_brand: ' || p_brand || ' | p_size: ' || p_size AS text FROM part")
def src_csv_labelled_rows(spark, d):
    return src.labelled_rows(fx.table(spark, d, "part"), ["p_name", "p_brand", "p_size"], "p_partkey")


@query("SELECT doc_id, row_no, array_to_string(list_filter(cells, lambda x: x IS NOT NULL AND x <> ''), ' | ') AS text FROM fx_cells")
def src_table_joined_rows(spark, d):
    return src.joined_rows(fx.cells(spark, d))


@query("SELECT doc_id, E'Sheet: Sheet1\\n' || string_agg(array_to_string(list_transform(cells, lambda x: coalesce(x, '')), E'\\t'), E'\\n' ORDER BY row_no) AS text FROM fx_cells GROUP BY doc_id")
def src_sheet_tab_rows(spark, d):
    return src.sheet_text(fx.cells(spark, d))


@query("""WITH l AS (SELECT doc_id, (line_no // 40)::INT AS page, line_no, CASE WHEN line_no % 4 = 3 THEN '' ELSE text END AS line FROM fx_lines),
r AS (SELECT *, sum((line = '')::INT) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS run FROM l),
p AS (SELECT doc_id, page, run, string_agg(line, ' ' ORDER BY line_no) AS text FROM r WHERE line <> '' GROUP BY ALL)
SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY run) - 1)::INT AS par_no, text FROM p""")
def src_paragraphs(spark, d):
    rows = _lines(spark, d).select("doc_id", F.floor(F.col("line_no") / 40).cast("int").alias("page"), "line_no", F.when(F.col("line_no") % 4 == 3, "").otherwise(F.col("text")).alias("line"))
    return src.paragraphs(rows)


@query("""WITH n AS (SELECT p_brand AS station, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT AS exam_no FROM part)
SELECT station, exam_no, replace(p_name, ' ', '_') AS exam_id, 'Did the doctor do ' || p_name || '?' AS question, 'say ' || p_name || '|now ' || p_name AS examples FROM n""")
def src_prompt_corpus(spark, d):
    rows = src.parse_prompts(_prompts(spark, d))
    return rows.withColumn("examples", F.array_join("examples", "|"))


def _prompts(spark, d):
    """A prompt document for each brand, an exam for each part."""
    from pyspark.sql import Window

    no = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    line = F.concat(F.lit("  "), no.cast("string"), F.lit(": "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(": Did the doctor do "), F.col("p_name"), F.lit("?\n   - say "), F.col("p_name"), F.lit("\n   - now "), F.col("p_name"))
    rows = fx.table(spark, d, "part").select(F.col("p_brand").alias("station"), no.alias("no"), line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("station").agg(F.concat(F.lit("key: x\nuser_message:\n"), text).alias("text"))


@query("SELECT url AS path, lower(regexp_extract(url, '\\.([^.]+)$', 1)) AS ext, lower(regexp_extract(url, '\\.([^.]+)$', 1)) IN ('html', 'txt') AS ok FROM pages")
def src_extension_filter(spark, d):
    return src.allowed_files(fx.table(spark, d, "pages").select(F.col("url").alias("path")), ["html", "txt"])


@query(f"""WITH e AS (SELECT doc_id, 'a' AS engine, left(text, 60) AS text FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, 'b', text FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (engine = 'a' AND length({trim("text")}) > 50) DESC, length({trim("text")}) DESC, engine) AS k FROM e)
SELECT doc_id, engine, text FROM r WHERE k = 1""")
def src_best_text(spark, d):
    docs = fx.table(spark, d, "documents")
    a = docs.filter("doc_id % 3 > 0").select("doc_id", F.lit("a").alias("engine"), F.substring("text", 1, 60).alias("text"))
    return src.best_text(a.union(docs.select("doc_id", F.lit("b"), "text")), "a")


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_name || ' (' || p_brand || ')', '[^a-zA-Z0-9\\x20\\x09-\\x0D]', '', 'g'), '[\\x20\\x09-\\x0D]+', '_', 'g') AS exam_id FROM part")
def exam_id_slug(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", t.exam_id(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("exam_id"))


@query("SELECT doc_id, ord, regexp_replace(regexp_replace(section, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g') || '_' || ord AS item_id FROM fx_criteria")
def section_id_slug(spark, d):
    return fx.criteria(spark, d).select("doc_id", "ord", F.concat(t.section_id(F.col("section")), F.lit("_"), F.col("ord").cast("string")).alias("item_id"))


@query(f"""SELECT doc_id, line_no, {trim("regexp_replace(regexp_replace(regexp_replace('3. ' || replace(replace(text, '(', ''), ')', ''), '^[0-9]+[.][ ]*', ''), '[ ]*[:|-][ ]*$', ''), '(?i)[ ]*[0-9]+[ ]*(?:points?|pts?)?[ ]*$', '')")} AS name FROM fx_rubric_lines""")
def clean_section_name(spark, d):
    bare = F.concat(F.lit("3. "), F.translate("text", "()", ""))
    return fx.rubric_lines(spark, d).select("doc_id", "line_no", t.clean_section_name(bare).alias("name"))


@query(f"""WITH s AS (SELECT doc_id, line_no, {trim("replace(text, '" + '"' + "', '''')")} AS x FROM fx_lines) SELECT doc_id, line_no, CASE WHEN length(x) > 100 THEN left(x, 100) || '...' ELSE x END AS rendered FROM s""")
def render_item(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", t.render_item(F.col("text")).alias("rendered"))


@query("""WITH l AS (SELECT doc_id, line_no, CASE WHEN line_no = 3 THEN 'Station ' || doc_id || 'b now' ELSE text END AS text FROM fx_rubric_lines),
f AS (SELECT doc_id, line_no, regexp_extract(lower(text), 'station[\\x20\\x09-\\x0D]*([a-z0-9_]+)', 1) AS k FROM l)
SELECT doc_id, coalesce(upper(arg_min(k, line_no) FILTER (line_no < 10 AND k <> '')), '1A') AS value FROM f GROUP BY doc_id""")
def station_key(spark, d):
    rows = fx.rubric_lines(spark, d)
    return rubric.station_key(rows.withColumn("text", F.when(F.col("line_no") == 3, F.concat(F.lit("Station "), F.col("doc_id").cast("string"), F.lit("b now"))).otherwise(F.col("text"))))


@query("SELECT doc_id, coalesce(arg_min(text, line_no) FILTER (line_no < 3 AND length(text) > 10 AND NOT regexp_matches(text, '^[\\x20\\x09-\\x0D]*[0-9*•-]')), doc_id::VARCHAR) AS value FROM fx_lines GROUP BY doc_id")
def doc_title(spark, d):
    return rubric.doc_title(_lines(spark, d))


@query(f"""SELECT doc_id, line_no, regexp_extract(text, '(?i)\\(([0-9]+) points', 1)::INT AS points, {trim("regexp_replace(text, '(?i)\\([0-9]+ points?\\)', '')")} AS description FROM fx_rubric_lines""")
def points_cascade(spark, d):
    return rubric.line_points(fx.rubric_lines(spark, d))


@query("""WITH t AS (SELECT *, trim(array_to_string(list_transform(cells, lambda x: coalesce(x, '')), ' ')) AS text FROM fx_cells)
SELECT doc_id, row_no, text AS description, CASE WHEN row_no = 0 THEN 0 ELSE cells[5]::INT END AS points FROM t""")
def points_of_rows(spark, d):
    return rubric.row_points(fx.cells(spark, d))


@query("""SELECT doc_id, row_no, CASE WHEN row_no = 0 THEN 'Domain' ELSE cells[2] END AS description, coalesce(CASE WHEN row_no > 0 THEN cells[5]::INT END, 0) AS points FROM fx_cells""")
def item_from_row(spark, d):
    return rubric.items_from_cells(fx.cells(spark, d))


@query("SELECT doc_id, row_no, coalesce(CASE WHEN row_no > 0 THEN cells[5]::INT END, 0) AS points FROM fx_cells")
def section_points(spark, d):
    return rubric.cell_section_points(fx.cells(spark, d))


@query("""WITH x AS (SELECT doc_id, string_agg(text, E'\\n' ORDER BY line_no) AS text FROM fx_rubric_lines GROUP BY doc_id),
n AS (SELECT DISTINCT doc_id, section AS name FROM fx_items), p AS (SELECT *, instr(lower(text), lower(name)) AS k FROM x JOIN n USING (doc_id)),
s AS (SELECT doc_id, name, substr(text, greatest(1, k - 100), (CASE WHEN k - 100 < 1 THEN k - 1 ELSE 100 END) + length(name) + 100) AS near FROM p)
SELECT doc_id, name, coalesce(nullif(regexp_extract(near, '(?i)([0-9]+)[\\x20\\x09-\\x0D]*(?:points?|pts?)', 1), '')::INT, 1) AS points FROM s""")
def proximity_points(spark, d):
    rows = fx.rubric_lines(spark, d)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return rubric.proximity_points(rows.groupBy("doc_id").agg(text.alias("text")), fx.items(spark, d).select("doc_id", F.col("section").alias("name")).distinct())


@query("""SELECT url, regexp_extract(url, '://([^/?#]*)', 1) AS bucket, substr(split_part(url, '://', 2), instr(split_part(url, '://', 2) || '/', '/') + 1) AS object FROM pages""")
def object_path_split(spark, d):
    bucket, rest = t.object_path(F.regexp_replace("url", "^.*?://", ""))
    return fx.table(spark, d, "pages").select("url", bucket.alias("bucket"), F.coalesce(rest, F.lit("")).alias("object"))


@query("""SELECT page_id, regexp_replace(replace(regexp_replace(u, '([.][^./]+)$', ''), ' ', '_'), '[^A-Za-z0-9_.-]', '', 'g') || regexp_replace(regexp_extract(u, '([.][^./]+)$', 1), '[^A-Za-z0-9.]', '', 'g') AS name FROM (SELECT page_id, 'my file ' || url AS u FROM pages)""")
def file_name_clean(spark, d):
    return fx.table(spark, d, "pages").select("page_id", t.file_name(F.concat(F.lit("my file "), "url")).alias("name"))


@query("""WITH n AS (SELECT p_brand AS station, string_agg(p_name, ', ' ORDER BY p_partkey) AS u FROM part GROUP BY ALL)
SELECT station, 'Station ' || station || ': ' || CASE WHEN length(u) > 200 THEN left(u, 200) || '...' ELSE u END AS question FROM n""")
def question_from_prompt(spark, d):
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), ", ")
    rows = fx.table(spark, d, "part").groupBy(F.col("p_brand").alias("station")).agg(joined.alias("u"))
    return rows.select("station", t.question_text(F.col("station"), F.col("u"), F.lit("")).alias("question"))


@query("""SELECT p_partkey, abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)) AS hash FROM part""")
def content_hash32(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", t.content_hash(F.col("p_name")).alias("hash"))


@query("""SELECT page_id, CASE WHEN regexp_matches(u, 'internal|medicine|general') THEN 'internal_medicine' WHEN regexp_matches(u, 'surgery|surgical|operative') THEN 'surgery' WHEN regexp_matches(u, 'pediatric|child|infant') THEN 'pediatrics'
  WHEN regexp_matches(u, 'psych|mental|behavioral') THEN 'psychiatry' WHEN regexp_matches(u, 'emergency|trauma|urgent') THEN 'emergency' WHEN regexp_matches(u, 'cardiac|heart|cardio') THEN 'cardiology'
  WHEN regexp_matches(u, 'derm|skin|rash|psoriasis') THEN 'dermatology' WHEN regexp_matches(u, 'neuro|brain|nerve') THEN 'neurology' WHEN regexp_matches(u, 'ortho|bone|joint|back') THEN 'orthopedics' WHEN regexp_matches(u, 'family|primary|general') THEN 'family_medicine' ELSE 'general_medicine' END AS category
FROM (SELECT page_id, lower(html) AS u FROM pages)""")
def name_category(spark, d):
    return fx.table(spark, d, "pages").select("page_id", t.first_of(F.lower("html"), t.SPECIALTIES, "general_medicine").alias("category"))


@query("""SELECT p_partkey, floor(CASE p_size % 3 WHEN 0 THEN least(5, greatest(1, floor(2.0::DOUBLE + p_size * 0.5::DOUBLE))) WHEN 1 THEN least(10, greatest(1, floor(3.0::DOUBLE + p_size * 0.8::DOUBLE))) ELSE least(50, greatest(2, floor(5.0::DOUBLE + p_size * 2.0::DOUBLE))) END
  * CASE WHEN p_size % 2 = 0 THEN 1.5::DOUBLE ELSE 2.5::DOUBLE END)::BIGINT AS points FROM part""")
def adaptive_points(spark, d):
    system = F.when(F.col("p_size") % 3 == 0, "scale_1_5").when(F.col("p_size") % 3 == 1, "scale_1_10").otherwise("points_system")
    level = F.when(F.col("p_size") % 2 == 0, "intermediate").otherwise("expert")
    return fx.table(spark, d, "part").select("p_partkey", t.adaptive_points(system, F.col("p_size"), level).cast("long").alias("points"))


@query("""SELECT video_id, clip_no, lpad((floor("start")::BIGINT // 60)::VARCHAR, 2, '0') || ':' || lpad((floor("start")::BIGINT % 60)::VARCHAR, 2, '0') AS mmss,
  floor("start")::DOUBLE AS seconds FROM fx_clips WHERE "start" < 6000""")
def time_text(spark, d):
    return _times(fx.clips(spark, d).filter("start < 6000"))


@query("""SELECT video_id, clip_no, format('{:02d}:{:02d}', floor("start")::BIGINT // 60, floor("start")::BIGINT % 60) AS mmss, floor("start")::DOUBLE AS seconds FROM fx_clips""")
def time_text_whole(spark, d):
    """Clips of any start: from 100 minutes the minutes have more than two digits."""
    return _times(fx.clips(spark, d))


def _times(clips):
    rows = clips.select("video_id", "clip_no", t.to_mmss(F.col("start")).alias("mmss"))
    return rows.withColumn("seconds", t.from_mmss(F.col("mmss")))


@query("""WITH s AS (SELECT video_id, clip_no, CASE WHEN clip_no % 9 > 0 THEN round("start" + (clip_no % 8) * 0.05, 2) END AS s FROM fx_clips)
SELECT video_id, clip_no, coalesce(round(s::DECIMAL(30, 9), 1)::DECIMAL(30, 1)::VARCHAR, 'nan') AS text, round(s::DECIMAL(30, 9), 1)::DOUBLE AS seconds FROM s""")
def time_decimals(spark, d):
    """Starts of clips in text with one decimal, and read back; every ninth has none."""
    seconds = F.when(F.col("clip_no") % 9 > 0, F.round(F.col("start") + F.col("clip_no") % 8 * 0.05, 2))
    rows = fx.clips(spark, d).select("video_id", "clip_no", t.one_decimal(seconds).alias("text"))
    return rows.withColumn("seconds", t.from_mmss(F.col("text")))


@query("""SELECT id, CASE WHEN frames > 0 AND fps > 0 THEN round(frames / fps, 3) ELSE 0.0 END AS duration, fps <= 0 AS bad_fps, frames <= 0 AS bad_frames, id % 5 = 0 OR id % 7 = 0 AS bad_resolution FROM fx_videos""")
def video_flags(spark, d):
    """Widths and heights from the id; every fifth and seventh has none."""
    sized = fx.videos(spark, d).withColumn("width", F.nullif(F.col("id") % 5, F.lit(0)) * 320).withColumn("height", F.col("id") % 7 * 240)
    return actions.video_metadata(sized).select("id", "duration", "bad_fps", "bad_frames", "bad_resolution")


@query("""SELECT id, CASE WHEN frames > 0 AND fps > 0 THEN round(frames / fps, 3) ELSE 0.0 END AS duration, fps <= 0 AS bad_fps, frames <= 0 AS bad_frames FROM fx_videos""")
def video_metadata(spark, d):
    good = (F.col("frames") > 0) & (F.col("fps") > 0)
    return fx.videos(spark, d).select("id", F.when(good, F.round(F.col("frames") / F.col("fps"), 3)).otherwise(0.0).alias("duration"), (F.col("fps") <= 0).alias("bad_fps"), (F.col("frames") <= 0).alias("bad_frames"))


KEYS = [("alpha", ["the", "thth"]), ("beta", ["der", "ein"]), ("gamma", ["que", "ción"])]
BUCKETED = "b AS (SELECT *, CASE WHEN regexp_matches(lower(text), 'the|thth') THEN 'alpha' WHEN regexp_matches(lower(text), 'der|ein') THEN 'beta' WHEN regexp_matches(lower(text), 'que|ción') THEN 'gamma' ELSE 'other' END AS bucket FROM fx_lines)"


@query(f"WITH {BUCKETED} SELECT doc_id, line_no, bucket FROM b")
def bucket_lines(spark, d):
    return rubric.bucket_lines(_lines(spark, d), KEYS).select("doc_id", "line_no", "bucket")


@query(f"""WITH {BUCKETED}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, bucket ORDER BY line_no)::INT AS item_no, {trim("replace(text, '" + '"' + "', '''')")} AS x FROM b)
SELECT doc_id, bucket, item_no, CASE WHEN length(x) > 100 THEN left(x, 100) || '...' ELSE x END AS rendered FROM r WHERE item_no <= CASE bucket WHEN 'alpha' THEN 10 WHEN 'beta' THEN 15 WHEN 'gamma' THEN 8 ELSE 0 END""")
def bucket_top_items(spark, d):
    return rubric.top_items(rubric.bucket_lines(_lines(spark, d), KEYS), {"alpha": 10, "beta": 15, "gamma": 8})


@query("""SELECT doc_id, cells[2] AS domain, cells[2] AS category, arg_max(cells[5]::INT, row_no) AS possible_points FROM fx_cells WHERE row_no BETWEEN 1 AND 9 GROUP BY ALL""")
def domain_score_table(spark, d):
    return rubric.domain_scores(fx.cells(spark, d))


HEADS = """h AS (SELECT *, CASE WHEN text LIKE '- %' THEN NULL WHEN contains(text, 'History Taking') THEN 'History Taking' WHEN contains(text, 'Physical Exam') THEN 'Physical Exam' ELSE 'Management' END AS head,
  CASE WHEN text LIKE '- %' THEN NULL ELSE regexp_extract(text, '([0-9]+)', 1)::INT END AS pts FROM fx_rubric_lines),
a AS (SELECT *, (count(head) OVER w)::INT AS section_no, last_value(head IGNORE NULLS) OVER w AS section, last_value(pts IGNORE NULLS) OVER w AS section_points FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""


@query(f"WITH {HEADS} SELECT doc_id, line_no, head AS section, pts AS max_points FROM h WHERE head IS NOT NULL")
def detect_header(spark, d):
    return rubric.headers(fx.rubric_lines(spark, d).filter("text not like '- %'")).select("doc_id", "line_no", "section", "max_points")


@query(f"WITH {HEADS} SELECT doc_id, line_no, text, section_no, section, section_points FROM a WHERE head IS NULL")
def assign_sections(spark, d):
    return rubric.assign_sections(fx.rubric_lines(spark, d))


@query(f"""WITH {HEADS}, s AS (SELECT doc_id, section_no, section, max(section_points)::BIGINT AS points FROM a WHERE head IS NULL GROUP BY ALL) SELECT *, (sum(points) OVER (PARTITION BY doc_id))::BIGINT AS total FROM s""")
def section_totals(spark, d):
    return rubric.section_totals(rubric.assign_sections(fx.rubric_lines(spark, d)))


@query("""SELECT doc_id, row_no, CASE WHEN row_no > 0 THEN 'item' ELSE 'header' END AS kind, 'Domain Score:' AS section FROM fx_cells""")
def header_item_heuristics(spark, d):
    cells = fx.cells(spark, d)
    return rubric.line_kind(cells.withColumn("cells", F.when(F.col("row_no") == 0, F.array(F.lit("Domain Score:"))).otherwise(F.col("cells"))))


PARSED = """p AS (SELECT doc_id, line_no, last_value(CASE WHEN text NOT LIKE '- %' THEN regexp_extract(text, '^(.*) [(]', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section,
  CASE WHEN text LIKE '- %' THEN regexp_extract(text, '^- (.*) [(]', 1) ELSE regexp_extract(text, '^(.*) [(]', 1) END AS name, regexp_extract(text, '[(]([0-9]+) points', 1)::INT AS points FROM fx_rubric_lines)"""


@query(f"WITH {PARSED} SELECT * FROM p WHERE length(name) > 3")
def parse_rubric_text(spark, d):
    return rubric.parse_rubric(fx.rubric_lines(spark, d))


@query(f"""WITH {PARSED}, s AS (SELECT doc_id, count(*) AS n, sum(points)::BIGINT AS total FROM p WHERE length(name) > 3 GROUP BY doc_id)
SELECT doc_id, arg_min(l.text, l.line_no) FILTER (l.line_no < 3 AND length(l.text) > 10 AND l.text NOT LIKE '- %') AS title, any_value(n) AS n, any_value(total) AS total FROM s JOIN fx_rubric_lines l USING (doc_id) GROUP BY doc_id""")
def rubric_totals(spark, d):
    return rubric.rubric_totals(fx.rubric_lines(spark, d)).select("doc_id", "title", "n", "total")


CATEGORIES = [("Articles", ["the.{0,5}of", "und.{0,5}der"], 3), ("Verbs", ["est", "ist"], 2), ("Questions", [r"\?"], 4)]


@query("""WITH c AS (SELECT * FROM (VALUES ('Articles', 'the.{0,5}of|und.{0,5}der', 3), ('Verbs', 'est|ist', 2), ('Questions', '[?]', 4)) t(category, p, default_points))
SELECT doc_id, category, default_points FROM documents, c WHERE regexp_matches(lower(text), p)""")
def match_categories(spark, d):
    return rubric.match_categories(fx.table(spark, d, "documents"), CATEGORIES)


@query("""WITH l AS (SELECT doc_id, line_no, CASE WHEN line_no % 5 = 4 THEN 'Example: see ' || doc_id || '; hear' WHEN line_no % 5 = 1 THEN line_no || '. ' || substr(text, 3) ELSE text END AS text FROM fx_rubric_lines),
m AS (SELECT doc_id, line_no, 0 AS form, regexp_extract(text, '^[0-9]+[.] (.+?) [(]', 1) AS name, regexp_extract(text, '[(]([0-9]+) points', 1)::INT AS points FROM l WHERE regexp_matches(text, '^[0-9]+[.]')
  UNION ALL SELECT doc_id, line_no, 1, regexp_extract(text, '^- (.+?) [(]', 1), regexp_extract(text, '[(]([0-9]+) points', 1)::INT FROM l WHERE text LIKE '- %'
  UNION ALL SELECT doc_id, line_no, 2, 'Example', 1 FROM l WHERE text LIKE 'Example%'),
e AS (SELECT m.*, (SELECT min(n.line_no) FROM l n WHERE n.doc_id = m.doc_id AND n.line_no > m.line_no AND n.line_no <= m.line_no + 9 AND regexp_matches(n.text, '^[0-9]+[.]')) AS stop FROM m),
x AS (SELECT e.*, (SELECT string_agg('see ' || l.doc_id || '|hear', '|') FROM l WHERE l.doc_id = e.doc_id AND l.line_no > e.line_no AND l.line_no <= e.line_no + 9 AND l.line_no < coalesce(e.stop, 1000000) AND l.text LIKE 'Example%') AS said FROM e)
SELECT doc_id, line_no, form, regexp_replace(name, ' ', '_', 'g') AS exam_id, name, points, coalesce(said, 'one|two') AS examples FROM x""")
def sub_exams(spark, d):
    text = F.when(F.col("line_no") % 5 == 4, F.concat(F.lit("Example: see "), F.col("doc_id").cast("string"), F.lit("; hear")))
    text = text.when(F.col("line_no") % 5 == 1, F.concat(F.col("line_no").cast("string"), F.lit(". "), F.expr("substr(text, 3)"))).otherwise(F.col("text"))
    return rubric.sub_exams(fx.rubric_lines(spark, d).withColumn("text", text), "Nothing", ["one", "two"]).withColumn("examples", F.array_join("examples", "|"))
