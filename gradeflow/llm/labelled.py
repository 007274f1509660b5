"""Bounded labelled samples for the classifiers, and scores with calibrated probabilities."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_fold

#: Longest text, in bytes, that a training sample takes, and bytes of either class in all; scoring has no such bounds.
SAMPLE_TEXT, SAMPLE_BYTES = 60_000, 8 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """Up to ``rows`` documents and ``SAMPLE_BYTES`` of either class of ``label``, as (doc_id, text, label).

    Only rows of which crc32(doc_id as text) mod ``modulus`` is not ``held_out`` are looked at. The
    sample is the first by md5 of the id, so it is the same in any run. Null labels, ids and texts
    are left out, as are texts above ``SAMPLE_TEXT``, which others replace. At most 4 * ``rows``
    labels are broadcast.
    """
    kept = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    kept = kept.filter(crc32_fold("doc_id", modulus) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.md5(F.col("doc_id").cast("string"))
    parts = [kept.filter(F.col("label") == c).orderBy(order, "doc_id").limit(2 * rows) for c in (0, 1)]
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_TEXT)
    met = texts.join(F.broadcast(parts[0].union(parts[1])), "doc_id")
    first = Window.partitionBy("label").orderBy(order, "doc_id", "text")
    met = met.withColumn("_n", F.row_number().over(first)).withColumn("_bytes", F.sum(F.octet_length("text")).over(first))
    return met.filter((F.col("_n") <= rows) & (F.col("_bytes") <= SAMPLE_BYTES)).select("doc_id", "text", "label")


def learnt(sample: DataFrame, make: Callable[[list, np.ndarray], Any]) -> Any:
    """``make(texts, labels)`` of a ``labelled_sample`` ordered by doc_id and text; none if a class has no rows.

    It runs in one task, as the sample is bounded; the driver gets what was learnt, neither texts nor what learning holds meanwhile.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
        if len({*y}) == 2:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(make(texts, np.array(y)))], pa.binary())], names=["model"])

    found = sample.repartition(1).sortWithinPartitions("doc_id", "text").select("text", "label").mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on held-back rows, by a grid in the logarithm."""
    grid = np.exp(np.linspace(-2, 3, 101))
    loss = [-np.log(np.clip(np.where(y > 0, sigmoid(logits / t), 1 - sigmoid(logits / t)), 1e-9, 1)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
