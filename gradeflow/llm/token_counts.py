"""Token counts through a digest cache: texts are counted once for each content and tokenizer version."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, small_batches
from .tokenizing import counter, read_file

CACHE = "version string, digest binary, n_tokens long"


def content() -> F.Column:
    """Normalised content: null as empty. Anything further could change counts."""
    return F.coalesce(F.col("text"), F.lit(""))


def cached(spark, path: str, version: str) -> DataFrame:
    """Stored counts of a tokenizer version, a row for each digest; none where nothing is stored yet."""
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except AnalysisException:
        rows = spark.createDataFrame([], CACHE)
    return rows.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_misses(docs: DataFrame, tokenizer: str, cache: str) -> str:
    """Encode the distinct contents of ``docs`` that the cache lacks, append them to it, return the version.

    Copies are dropped before texts are shuffled and again after. Two jobs that run at once may
    both append a digest; readers take it once.
    """
    spark, model = docs.sparkSession, read_file(tokenizer)
    version, kind = hashlib.sha256(model).hexdigest(), "model" if tokenizer.endswith(".model") else "json"
    small_batches(spark)
    texts = docs.select(F.unhex(F.sha2(content(), 256)).alias("digest"), content().alias("text"))
    misses = texts.dropDuplicates(["digest"]).join(cached(spark, cache, version), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = counter(model, kind)
        for batch in batches:
            n = library.counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(n), pa.string()), batch.column(0), pa.array(n, pa.int64())], names=["version", "digest", "n_tokens"])

    misses.select("digest", "text").mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    return version


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text), counted by its whole text.

    Null and empty texts have 0 bytes and the library's count of an empty text. Rows with null or
    repeated ids are kept as they are; other columns are ignored. ``cache``: path of the stored
    counts, kept for later calls; by default one in the scratch folder, for this call alone.
    """
    spark = docs.sparkSession
    cache = cache or scratch_path(spark, "token-cache")
    version = count_misses(docs, tokenizer, cache)
    sizes = docs.select("doc_id", F.octet_length(content()).cast("long").alias("n_bytes"), F.unhex(F.sha2(content(), 256)).alias("digest"))
    counted = sizes.join(cached(spark, cache, version), "digest", "left")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
