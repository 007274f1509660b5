"""The queries of the training-data operators, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality as quality_model
from . import toxicity as toxicity_model
from .bpe import round_trip_digests
from .mixing import MIX_SQL, copies
from .ngram_join import JACCARD_SQL, jaccard_components
from .negatives import NEGATIVES_SQL, hard_negatives
from .packing import pack_documents
from .resampling import RESAMPLE_SQL, resample
from .token_counts import token_counts
from .topk import TOP_K_SQL, top_k
from .url_filter import fit, judge, labelled_urls
from .vector_dedup import NEAR_SQL, near_vectors
from .warc import WARC_SQL, round_trip

#: (host, path, verdict) of op4.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 2048 tokens. Odd rows as in ``pack_documents``."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150 % of all words takes of each document. Odd rows as in ``copies``."""
    return copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all vectors for every hundredth one. Odd rows as in ``top_k``."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url, by rule or by model. Null urls have an empty host and path."""
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, fit(labelled_urls(spark)))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and component. Odd rows as in ``jaccard_components``."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality. Odd rows as in ``quality``."""
    return quality_model.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens; null texts count as empty, repeated ones are encoded once, an empty table gives no rows."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component at a cosine of 0.98 within its label. Odd rows as in ``near_vectors``."""
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back; null pages are empty payloads, an empty table gives no rows."""
    return round_trip(table(spark, sf_dir, "pages"), 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity. Odd rows as in ``toxicity``."""
    return toxicity_model.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five in a hundred documents drawn towards the distribution of the benchmark's texts; every document's weight and score."""
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of five positives of every hundredth vector; every seventh row takes the next label first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0, 5, 5, 80)


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: counts and digests of the ids and of the text."""
    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_source_mixing,
        op3_exact_top_k,
        op4_url_filter,
        op5_ngram_jaccard,
        op6_quality,
        op7_token_counts,
        op8_vector_near_dedup,
        op9_warc_archive,
        op10_toxicity,
        op11_target_resampling,
        op12_hard_negatives,
        op13_bpe_round_trip,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_source_mixing": MIX_SQL,
    "op3_exact_top_k": TOP_K_SQL,
    "op5_ngram_jaccard": JACCARD_SQL,
    "op8_vector_near_dedup": NEAR_SQL,
    "op9_warc_archive": WARC_SQL,
    "op11_target_resampling": RESAMPLE_SQL,
    "op12_hard_negatives": NEGATIVES_SQL,
}
