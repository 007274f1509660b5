"""Quality classifier: random-indexing word vectors, pooled, and a small calibrated network in numpy.

Every word (hashed to a bucket) has a sparse ternary index vector; its context vector sums the index
vectors of its neighbours over the whole corpus. A document is the mean of its words' normalised
context vectors and index vectors, frequent words weighing less, with the length of that mean and
how far it exceeds that of unrelated words. Two layers, fitted on a bounded labelled sample, give a
logit; a temperature found on held-back rows calibrates it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_fold, small_batches
from .labelled import labelled_sample, learnt, sigmoid, temperature

#: Buckets of words, components of a vector, nonzero components of an index vector, neighbours on either side.
BUCKETS, DIMS, NONZERO, REACH = 1 << 15, 64, 4, 2
#: Share of all words at which a word weighs half.
COMMON = 1e-3
#: Words that a task gathers before it counts contexts; slices of the table that are summed apart; tables that a step of the sum adds; buckets whose vectors are made at once.
CHUNK, SLICES, FAN, BLOCK = 1_000_000, 64, 128, 2048
#: Labelled documents of either class, hidden units, steps, rows of a step.
SAMPLE, HIDDEN, EPOCHS, BATCH = 3000, 32, 40, 64
SEED = 11

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\w\s\x80-\xff]+|_+")


def index_table() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the nonzero components of each bucket's index vector."""
    random = np.random.default_rng(SEED)
    at = np.concatenate([np.argsort(random.random((BLOCK, DIMS)), axis=1)[:, :NONZERO].copy() for _ in range(0, BUCKETS, BLOCK)])
    return at, random.choice([-1, 1], (BUCKETS, NONZERO)).astype(np.int64)


def word_ids(text: bytes) -> np.ndarray:
    """Buckets of the words of a text: runs of letters and digits, and runs of other marks."""
    return np.fromiter(map(zlib.crc32, TOKEN.findall(text)), np.int64) % BUCKETS


def context_sums(docs: DataFrame) -> np.ndarray:
    """Of each bucket the summed index vectors of its neighbours and, last, its count, over all texts of ``docs``: a fixed 8 MB, whatever the corpus.

    Tasks send sums of slices of the table; these are added in a tree over the tasks, ``FAN`` at a time.
    """
    size = BUCKETS // SLICES * (DIMS + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sign = index_table()
        table, held, n = np.zeros((BUCKETS, DIMS + 1)), [], 0

        def add() -> None:
            ids = np.concatenate(held)
            sums = np.zeros(BUCKETS * DIMS)
            for reach in range(1, REACH + 1):
                a, b = ids[:-reach], ids[reach:]
                whole = (a >= 0) & (b >= 0)
                a, b = a[whole], b[whole]
                for x, y in ((a, b), (b, a)):
                    for k in range(NONZERO):
                        sums += np.bincount(x * DIMS + at[y, k], sign[y, k], len(sums))
            table[:, :DIMS] += sums.reshape(BUCKETS, DIMS)
            table[:, DIMS] += np.bincount(ids[ids >= 0], minlength=BUCKETS)

        gap = np.full(REACH, -1)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                ids = word_ids(text) if text else gap
                held += [ids, gap]
                n += len(ids)
                if n >= CHUNK:
                    add()
                    held, n = [], 0
        if n:
            add()
        part = TaskContext.get().partitionId()
        sums = [x.tobytes() for x in table.astype(np.float32).reshape(SLICES, size)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int32()), pa.array(sums, pa.binary())], names=["slice", "part", "sums"])

    def total(parts: pd.DataFrame) -> pd.DataFrame:
        added = np.zeros(size)
        for x in parts["sums"]:
            added += np.frombuffer(x, np.float32)
        return pd.DataFrame({"slice": parts["slice"].iloc[:1], "part": parts["part"].iloc[:1] // FAN, "sums": [added.astype(np.float32).tobytes()]})

    kinds = "slice int, part int, sums binary"
    rows = docs.select("text").mapInArrow(count, kinds)
    for key in (F.floor(F.col("part") / FAN), F.floor(F.col("part") / FAN), F.lit(0)):
        rows = rows.groupBy("slice", key.alias("next")).applyInPandas(total, kinds)
    found = {r["slice"]: np.frombuffer(r["sums"], np.float32) for r in rows.collect()}
    return np.concatenate([found.get(i, np.zeros(size, np.float32)) for i in range(SLICES)]).reshape(BUCKETS, DIMS + 1)


class Pooler:
    """Features of a document from its words' vectors: their weighted mean, its length, and how far it exceeds that of unrelated words."""

    width = 2 * DIMS + 4

    def __init__(self, sums: np.ndarray):
        at, sign = index_table()
        self.vectors = np.zeros((BUCKETS, 2 * DIMS), np.float32)
        np.put_along_axis(self.vectors[:, DIMS:], at, (sign / np.sqrt(NONZERO)).astype(np.float32), 1)
        for k in range(0, BUCKETS, BLOCK):
            part = sums[k : k + BLOCK, :DIMS]
            self.vectors[k : k + BLOCK, :DIMS] = part / np.maximum(np.sqrt((part.astype(np.float64) ** 2).sum(1, keepdims=True)), 1e-9)
        share = sums[:, DIMS] / max(float(sums[:, DIMS].sum(dtype=np.float64)), 1.0)
        self.weight = (COMMON / (COMMON + share)).astype(np.float32)

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Zeros for a text without words."""
        out = np.zeros(self.width, np.float32)
        ids, n = np.unique(word_ids(text or b""), return_counts=True)
        if len(ids):
            weight = n * self.weight[ids]
            whole = weight @ self.vectors[ids]
            out[: 2 * DIMS] = 4 * whole / weight.sum()
            for k, part in enumerate((slice(DIMS), slice(DIMS, None))):
                length = float((whole[part] ** 2).sum())
                out[2 * DIMS + k] = np.sqrt(length) / weight.sum()
                # vectors are of length 1: unrelated words would give the sum of the squared weights of all words
                out[2 * DIMS + 2 + k] = np.log(length / float(weight @ self.weight[ids]) + 1e-6)
        return out


class Network:
    """tanh layer and logit, by Adam on standardised features, classes weighed alike; calibrated by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        random = np.random.default_rng(SEED)
        back = random.random(len(y)) < 0.2
        if len({*y[~back]}) < 2 or len({*y[back]}) < 2:
            back[:] = False
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-3
        z, t = self.scale(x[~back]), y[~back].astype(np.float64)
        self.p = [random.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), random.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        share = np.clip(t.mean(), 0.01, 0.99)
        weight = np.where(t > 0, 0.5 / share, 0.5 / (1 - share))
        m, v, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(EPOCHS):
            order = random.permutation(len(t))
            for k in range(0, len(t), BATCH):
                rows = order[k : k + BATCH]
                step += 1
                for i, g in enumerate(self.gradient(z[rows], t[rows], weight[rows])):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.p[i] -= 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if back.any():
            self.temperature = temperature(self.logits(x[back]), y[back])

    def scale(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def gradient(self, z: np.ndarray, t: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        h = np.tanh(z @ self.p[0] + self.p[1])
        d = weight * (sigmoid(h @ self.p[2] + self.p[3]) - t) / len(t)
        back = np.outer(d, self.p[2]) * (1 - h * h)
        return [z.T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ d + 1e-4 * self.p[2], np.array([d.sum()])]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.scale(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> tuple[np.ndarray, Network | None]:
    """Sums of contexts over all ``docs`` and the network of a labelled sample; no network if a class has no rows."""
    small_batches(docs.sparkSession)
    sums = context_sums(docs)
    sent = docs.sparkSession.sparkContext.broadcast(sums)

    def network(texts: list[bytes], y: np.ndarray) -> Network:
        return Network(np.stack(list(map(Pooler(sent.value), texts))), y)

    sample = labelled_sample(docs, labels, "quality", modulus, held_out, SAMPLE)
    found = learnt(sample.withColumn("text", F.col("text").cast("binary")), network)
    sent.destroy()
    return sums, found


def scores(docs: DataFrame, model: tuple[np.ndarray, Network | None], schema, make) -> DataFrame:
    """``make(batch, scores)`` of every batch of ``docs``; null text as empty. 0.5 without a network."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, network = sent.value
        pool = Pooler(sums)
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
                yield make(batch, network(np.stack([pool(t) for t in texts])) if network else np.full(len(texts), 0.5))

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: tuple[np.ndarray, Network | None]) -> DataFrame:
    """(doc_id, score) of every row, by its whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scores(rows, model, "doc_id long, score double", lambda b, p: pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"]))


def keep_good(docs: DataFrame, model: tuple[np.ndarray, Network | None], threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, that score at least ``threshold``.

    Null and empty texts are scored as empty, repeated rows stay or go together, other columns are kept
    as they are; an empty table stays empty. Without a network all stay at a threshold up to 0.5.
    """
    return scores(docs, model, docs.schema, lambda b, p: b.filter(pa.array(p >= threshold)))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text; others are ignored).

    Labels (doc_id, quality) are learnt only from ids of which crc32 mod ``modulus`` is not
    ``held_out``. Null and empty texts are scored as empty, very long ones whole; repeated rows score
    alike; a null doc_id counts as an empty one for the fold; an empty table gives no rows. Without
    labels of both classes all score 0.5.
    """
    scored = score(docs, fit(docs, labels, modulus, held_out))
    return scored.select("doc_id", (crc32_fold("doc_id", modulus) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
