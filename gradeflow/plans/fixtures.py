"""Adapters: the given tables in the shapes that the jobs take. ``fixture_sql`` has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _elapsed() -> F.Column:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return micros / 1e6 - F.min(micros).over(Window.partitionBy("user_id")) / 1e6


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    start = F.round(_elapsed(), 2)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), no.alias("clip_no"), F.col("event_type").alias("label"), start.alias("start"), (start + 30.0).alias("end"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("label")).distinct()
    return names.select((F.row_number().over(Window.orderBy("label")) - 1).alias("label_id"), "label")


def successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = labels(spark, sf_dir), labels(spark, sf_dir).select(F.col("label_id").alias("next_id"), F.col("label").alias("next_label"))
    to = a.select("label", F.explode(F.array_distinct(F.array((F.col("label_id") + 1) % 5, F.lit(0)))).alias("next_id"))
    return to.join(b, "next_id").select("label", "next_label")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_no"), _elapsed().alias("timestamp"))


def speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("turn_no"), F.col("role").alias("speaker"), (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 8).alias("end"), "text")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), "turn", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("word_no", "text"))
    start = F.col("turn") * 10.0 + F.col("word_no") * 0.5
    return rows.select("video_id", "turn", "word_no", start.alias("start"), (start + 0.4).alias("end"), "text")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second vector is the next row's: an equi-join on the rank, not a window over all rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("clip_vec"))
    after = rows.select(F.col("vec_id").alias("next_id"), F.col("clip_vec").alias("desc_vec"))
    # one row, for the last vector
    first = rows.orderBy("vec_id").limit(1).select(F.col("clip_vec").alias("first_vec"))
    linked = rows.join(after, F.col("next_id") == F.col("vec_id") + 1, "left").crossJoin(F.broadcast(first))
    return linked.select(F.col("vec_id").alias("id"), F.col("label").alias("video_id"), F.col("vec_id").alias("frame_number"), F.col("vec_id").cast("double").alias("timestamp"), "clip_vec", F.coalesce("desc_vec", "first_vec").alias("desc_vec"), F.lit(1).alias("version"))


def queries(spark: SparkSession, sf_dir: str, which: str = "id < 10") -> DataFrame:
    return points(spark, sf_dir).filter(which).select(F.col("id").alias("query_id"), "video_id", F.col("clip_vec").alias("vec_a"), F.col("desc_vec").alias("vec_b"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row as a query whose id is divisible by 50: their number grows with the table."""
    return queries(spark, sf_dir, "id % 50 = 0")


def point_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).filter("id % 7 = 0 or id % 11 = 0")
    return rows.select(F.when(F.col("id") % 7 == 0, F.col("id")).otherwise(F.col("id") + 1000000).alias("id"), "video_id", (F.col("timestamp") + 1000).alias("timestamp"), F.lit(2).alias("version"))


#: Rows of lineitem that one task takes at most, or about: tasks get more with the table, not larger.
TASK_ROWS = 400_000


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    lines = table(spark, sf_dir, "lineitem")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // TASK_ROWS))
    rows = lines.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).repartition(tasks, "l_orderkey").withColumn("flag_no", flag)
    order = Window.partitionBy("l_orderkey").orderBy("flag_no", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    section = F.when(F.col("flag_no") == 0, "History Taking").when(F.col("flag_no") == 1, "Physical Examination").otherwise("Management")
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).alias("item_no"), "flag_no", section.alias("section"), "p_name", "p_brand", "l_returnflag", "l_linenumber", F.concat("p_name", F.lit(" ("), F.col("l_linenumber").cast("string"), F.lit(" points)")).alias("text"))


def rubric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section's first item brings its header along: the items are read and dealt once."""
    of_section = Window.partitionBy("doc_id", "flag_no")
    place = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("flag_no"))
    rows = items(spark, sf_dir).withColumns({"_place": place, "_n": F.count("*").over(of_section), "_first": F.min("item_no").over(of_section)})
    line = lambda before, text: F.struct((F.col("item_no") + F.col("_place") - before).alias("line_no"), text.alias("text"))
    head = line(2, F.concat("section", F.lit(" ("), (F.col("_n") * 2).cast("string"), F.lit(" points)")))
    item = line(1, F.concat(F.lit("- "), "text"))
    return rows.select("doc_id", F.inline(F.when(F.col("item_no") == F.col("_first"), F.array(head, item)).otherwise(F.array(item))))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's first item brings its header along: the items are read and dealt once."""
    row = lambda no, cells: F.struct(no.alias("row_no"), F.array(*cells).alias("cells"))
    body = row(F.col("item_no"), (F.lit(None).cast("string"), "p_name", "p_brand", "l_returnflag", F.col("l_linenumber").cast("string")))
    head = row(F.lit(0), [F.lit(x) for x in ("", "Domain", "", "", "Score")])
    return items(spark, sf_dir).select("doc_id", F.inline(F.when(F.col("item_no") == 1, F.array(head, body)).otherwise(F.array(body))))


def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("doc_id", F.col("item_no").alias("ord"), "section", F.col("p_name").alias("name"), F.col("l_linenumber").alias("max_points"), F.array("p_name", "section").alias("examples"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("student"), (F.col("l_orderkey") % 10).cast("int").alias("station"), F.col("l_returnflag").alias("domain"), F.least("l_quantity", F.lit(10.0)).alias("earned"), F.lit(10.0).alias("possible"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.floor("o_totalprice").alias("frames"), (F.col("o_custkey") % 3 * 15).cast("double").alias("fps"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.concat(F.lit('```json\n{"grade": '), (F.col("event_id") % 7 - 1).cast("string"), F.lit(', "rationale": "'), F.repeat(F.lit("seen "), (F.col("event_id") % 4).cast("int")), F.lit('"}\n```'))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("response_id"), F.col("user_id").alias("question_id"), F.when(F.col("event_id") % 10 == 9, "no json here").otherwise(good).alias("raw"))


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).cast("int").alias("video_id"), F.col("user_id").alias("question_id"), F.col("event_type").alias("tool"), no.alias("item_no"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.round(F.col("value") / 1000, 6).alias("confidence"))
