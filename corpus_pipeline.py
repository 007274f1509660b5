"""A corpus pipeline: toxic and poor documents go, one of each group of near copies stays, sources are mixed, sequences packed.

Each stage works on all rows that its predecessor kept and, but for the last, returns the columns of
``documents``. Stages that learn take their labels from ``sf_dir`` and their texts from their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradeflow.llm import ngram_join, quality, toxicity
from gradeflow.llm.common import materialize
from gradeflow.llm.mixing import mix
from gradeflow.llm.packing import pack_documents

#: No SQL expresses the learnt stages; the tests hold each stage against a plain version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the toxic documents; null and empty texts stay, as do all without labels of both classes."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the poor documents; null texts are scored as empty ones; all stay without labels of both classes."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies; rows without words or id stay, of rows that repeat an id one does."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is a source of its own, texts without words are left out."""
    return mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences; null texts are packed as empty ones, repeated rows each."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near copies", drop_near_copies), ("mix", mix_sources), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
