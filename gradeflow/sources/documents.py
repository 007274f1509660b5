"""Documents as rows: lines, paragraphs, table rows, prompt corpora, caches; and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import WS, extension, strip


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of files: UTF-8, or Latin-1 where that fails."""
    files = spark.read.format("binaryFile").load(path)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("doc_id"), F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("text"))


def text_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, text) of the trimmed lines that aren't empty, numbered from 0."""
    rows = docs.select("doc_id", F.filter(F.transform(F.split("text", "\n"), strip), lambda x: x != "").alias("lines"))
    return rows.select("doc_id", F.posexplode("lines").alias("line_no", "text"))


def labelled_rows(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, text): ``column: value`` of the columns with a value, joined by `` | ``; rows without any are dropped."""
    parts = []
    for c in columns:
        v = F.col(c).cast("string")
        parts.append(F.when(strip(v) != "", F.concat(F.lit(f"{c}: "), v)))
    return rows.select(key, F.concat_ws(" | ", *parts).alias("text")).filter("text <> ''")


def joined_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, row_no, text): cells with content joined by `` | ``."""
    kept = F.filter("cells", lambda x: F.coalesce(strip(x) != "", F.lit(False)))
    return cells.select("doc_id", "row_no", F.array_join(kept, " | ").alias("text")).filter("text <> ''")


def sheet_text(cells: DataFrame, sheet: str = "Sheet1") -> DataFrame:
    """(doc_id, text): a ``Sheet:`` line, then the rows in order, cells joined by tabs, null as empty."""
    line = F.array_join("cells", "\t", "")
    rows = cells.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_no", line.alias("line")))).alias("l"))
    return rows.select("doc_id", F.concat(F.lit(f"Sheet: {sheet}\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, page, par_no, text): lines joined by spaces; an empty line or the page's end closes a paragraph."""
    order = Window.partitionBy("doc_id", "page").orderBy("line_no")
    blank = strip(F.coalesce("line", F.lit(""))) == ""
    rows = lines.withColumn("_blank", blank).withColumn("_run", F.sum(F.col("_blank").cast("int")).over(order)).filter("not _blank")
    parts = rows.groupBy("doc_id", "page", "_run").agg(F.array_sort(F.collect_list(F.struct("line_no", strip(F.col("line")).alias("t")))).alias("l"))
    no = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("_run")) - 1
    return parts.select("doc_id", "page", no.alias("par_no"), F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("text"))


EXAM = r"^[\x20\x09]*([0-9]+):[\x20\x09]*([A-Za-z_]+):[\x20\x09]*(.+)"


def parse_prompts(docs: DataFrame) -> DataFrame:
    """(station, exam_no, exam_id, question, examples): ``n: Id: question`` lines, and the ``-`` lines below each."""
    lines = docs.select("station", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("no", F.regexp_extract("line", EXAM, 1).try_cast("int"))
    order = Window.partitionBy("station").orderBy("line_no")
    lines = lines.withColumn("_at", F.last(F.when(F.col("no").isNotNull(), F.col("line_no")), ignorenulls=True).over(order)).filter("_at is not null")
    said = F.when(F.regexp_like("line", F.lit(rf"^{WS}*-")), F.struct("line_no", strip(F.regexp_replace("line", rf"^{WS}*-", "")).alias("t")))
    head = F.max(F.when(F.col("no").isNotNull(), F.struct("no", F.regexp_extract("line", EXAM, 2).alias("id"), strip(F.regexp_extract("line", EXAM, 3)).alias("q"))))
    rows = lines.groupBy("station", "_at").agg(head.alias("h"), F.array_sort(F.collect_list(said)).alias("e"))
    return rows.select("station", F.col("h.no").alias("exam_no"), F.col("h.id").alias("exam_id"), F.col("h.q").alias("question"), F.transform("e", lambda x: x["t"]).alias("examples"))


CACHE = "map<string, map<string, array<struct<action_label: string, start_time: double, end_time: double>>>>"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(category, video_id, clip_no, label, start, end) of JSON documents category -> recording -> clips."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", CACHE)).alias("category", "videos"))
    rows = rows.select("category", F.explode("videos").alias("video_id", "clips"))
    return rows.select("category", "video_id", F.posexplode("clips").alias("clip_no", "c")).select("category", "video_id", "clip_no", F.col("c.action_label").alias("label"), F.col("c.start_time").alias("start"), F.col("c.end_time").alias("end"))


def allowed_files(files: DataFrame, allowed: list[str]) -> DataFrame:
    """``files`` (path) with ext, after the last dot in lower case, and ok."""
    return files.withColumn("ext", extension(F.col("path"))).withColumn("ok", F.col("ext").isin(allowed))


def best_text(texts: DataFrame, primary: str, least: int = 50) -> DataFrame:
    """(doc_id, engine, text): the primary engine's text if it is longer than ``least`` when trimmed, else the longest; ties by engine."""
    n = F.length(strip(F.coalesce("text", F.lit(""))))
    good = (F.col("engine") == primary) & (n > least)
    best = F.min(F.struct((~good).alias("a"), (-n).alias("b"), F.col("engine"), F.col("text"))).alias("x")
    return texts.groupBy("doc_id").agg(best).select("doc_id", "x.engine", "x.text")


def write_prompts(prompts: DataFrame, path: str) -> None:
    """A folder of text for each station."""
    prompts.select("station", F.col("prompt").alias("value")).write.partitionBy("station").mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def json_rows(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns])).alias("json"))
