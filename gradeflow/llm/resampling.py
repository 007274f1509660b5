"""Importance resampling towards a target distribution over hashed n-grams.

Features are runs of one to three words, each counted in the bucket of its CRC-32. Frequent words and
pairs of them (the head) are broadcast with their exact CRC states: the CRC of a run of head words
follows from the states by table look-ups in whole blocks. A feature with any other word takes its CRC
directly. Both give the same buckets, so the head decides how fast, never what; totals are exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Words of the head and their longest, pairs of the head, slots of their table.
WORDS, LETTERS, PAIRS, SLOTS = 1 << 17, 32, 1 << 17, 1 << 20
#: Words worked on at once, bytes of a text cut at once, counts that a task keeps.
BLOCK, SLICE, KEPT = 1 << 17, 1 << 20, 400_000
#: Rows of a range that are ranked in one task.
RANGE = 1_000_000

# Bytes of words after A-Z are lowered (digits, a-z and all of other alphabets), and the others
WORD, GAP = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def cut(text: bytes) -> Iterator[bytes]:
    """A text in parts that end between words."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + SLICE) if at + SLICE < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def blocks(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], np.ndarray, int]]:
    """(words, number of the text of each, how many of them the block before had as its last two)."""
    words, runs, known = [], [], 0
    for i, text in enumerate(texts):
        for part in cut(text.lower()) if text else ():
            found = WORD.findall(part)
            for s in range(0, len(found), BLOCK):
                new = found[s : s + BLOCK]
                words += new
                runs.append((i, len(new)))
                if len(words) >= BLOCK:
                    of = np.repeat(*np.array(runs).T)
                    yield words, of, known
                    words, known = words[-2:], min(2, len(words))
                    runs = [(int(x), 1) for x in of[-2:]]
    if len(words) > known:
        yield words, np.repeat(*np.array(runs).T), known


@lru_cache(maxsize=1)
def shifts() -> np.ndarray:
    """CRC-32 states moved over 0 to LETTERS + 1 zero bytes: [bytes, byte of the state, its value]."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    out = [np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]]
    for _ in range(LETTERS + 1):
        out.append((out[-1] >> 8) ^ table[out[-1] & 255])
    return np.stack(out)


@dataclass
class Head:
    """Frequent words and pairs of them with their CRC states."""

    ids: dict[bytes, int]
    alone: np.ndarray
    spaced: np.ndarray
    length: np.ndarray
    keys: np.ndarray
    states: np.ndarray

    @classmethod
    def of(cls, words: list[bytes], pairs: np.ndarray) -> Head:
        """``pairs``: places of two words each, the most frequent first. Two pairs of one slot: the first stays, the other takes the way of all."""
        alone = np.array([crc32(w) for w in words], np.uint32)
        spaced = np.array([crc32(b" " + w) for w in words], np.uint32)
        head = cls({w: i for i, w in enumerate(words)}, alone, spaced, np.array([len(w) + 1 for w in words], np.int64), np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.uint32))
        if len(pairs):
            a, b = pairs[::-1].T
            key = a * WORDS + b
            at = cls.slot(key)
            head.keys[at] = key
            found = head.keys[at] == key
            head.states[at[found]] = head.after(alone[a], b)[found]
        return head

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def after(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after a space and a word of the head more."""
        t, n = shifts(), self.length[word]
        return t[n, 0, state & 255] ^ t[n, 1, (state >> 8) & 255] ^ t[n, 2, (state >> 16) & 255] ^ t[n, 3, state >> 24] ^ self.spaced[word]

    def crcs(self, words: list[bytes], of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of one, two and three words: (places of their last words, their CRC-32)."""
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        head = np.ones(len(words), bool)
        state = np.zeros(len(words), np.uint32)
        for n in range(3):
            there = np.arange(n, len(words))[of[n:] == of[: len(of) - n]]
            head[1:] = head[:-1] if n else head[1:]
            head[:n] = False
            head &= ids >= 0
            quick, slow = there[head[there]], there[~head[there]]
            crc = np.zeros(len(words), np.uint32)
            if n == 0:
                crc[quick] = self.alone[ids[quick]]
            else:
                before = state[quick - 1]
                if n == 1:
                    key = ids[quick - 1] * WORDS + ids[quick]
                    at = self.slot(key)
                    known = self.keys[at] == key
                    crc[quick[known]] = self.states[at[known]]
                    quick, before = quick[~known], before[~known]
                crc[quick] = self.after(before, ids[quick])
            crc[slow] = [crc32(b" ".join(words[i - n : i + 1])) for i in slow.tolist()]
            state = crc
            yield there, crc[there]


def frequent(texts: DataFrame) -> Head:
    """The head of all texts: the words and pairs of the largest counts.

    Tasks keep the counts of what repeats in a block of words, at most ``KEPT`` of them at a time, so
    counts are lower bounds, and the head, two bounded lists, is all that the driver gets.
    """
    kinds = pa.schema([("first", pa.binary()), ("second", pa.binary()), ("n", pa.int64())])

    def rows(counts: Counter) -> pa.RecordBatch:
        pairs = [(*k, n) if isinstance(k, tuple) else (k, None, n) for k, n in counts.items()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*pairs, strict=True), kinds.types, strict=True)], schema=kinds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter = Counter()
        for batch in batches:
            for words, of, known in blocks(batch.column(0).to_pylist()):
                found = {w: n for w, n in Counter(words[known:]).items() if n > 1 and len(w) <= LETTERS}
                names = list(found)
                at = np.fromiter(map({w: i for i, w in enumerate(names)}.get, words, repeat(-1)), np.int64, len(words))
                both = (at[1:] >= 0) & (at[:-1] >= 0) & (of[1:] == of[:-1])
                codes, n = np.unique((at[:-1] * len(names) + at[1:])[both], return_counts=True)
                pairs = [(names[c // len(names)], names[c % len(names)], k) for c, k in zip(codes[n > 2].tolist(), n[n > 2].tolist(), strict=True)]
                kept.update(found)
                kept.update({(a, b): k for a, b, k in pairs})
                if len(kept) > KEPT:
                    yield rows(kept)
                    kept.clear()
        if kept:
            yield rows(kept)

    spark = texts.sparkSession
    counted = texts.mapInArrow(count, "first binary, second binary, n long").groupBy("first", "second").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "frequent")
    top = lambda rows, n: rows.orderBy(F.desc("n"), "first", "second").limit(n).toArrow()
    words = top(counted.filter("second is null"), WORDS).column(0).to_pylist()
    place = {w: i for i, w in enumerate(words)}
    pairs = top(counted.filter("second is not null"), PAIRS)
    both = [(place[a], place[b]) for a, b in zip(pairs.column(0).to_pylist(), pairs.column(1).to_pylist(), strict=True) if a in place and b in place]
    return Head.of(words, np.array(both, np.int64).reshape(-1, 2))


def texts_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("text").cast("binary").alias("text"))


def bucket_totals(rows: DataFrame, head, buckets: int) -> DataFrame:
    """(bucket, n): how often features of all texts fall into each bucket. ``head``: a broadcast ``Head``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for words, of, known in blocks(batch.column(0).to_pylist()):
                for last, crc in head.value.crcs(words, of):
                    total += np.bincount(crc[last >= known] % buckets, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "n"])

    return texts_of(rows).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(spark: SparkSession, source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket, from (bucket, n) of either side: 1000 times the log of the ratio of their smoothed shares, rounded down."""
    source, target = materialize(source, "source-buckets"), materialize(target, "target-buckets")
    total = lambda rows: rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    s_all, t_all = float(total(source) + buckets), float(total(target) + buckets)
    rows = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = rows.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    ratio = (F.col("t") + 1) * F.lit(s_all) / ((F.col("s") + 1) * F.lit(t_all))
    return rows.select("bucket", F.floor(1000.0 * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, head, gains, buckets: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of gains over each text's features. ``gains``: a broadcast array of a long a bucket."""
    kinds = [("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            found = np.zeros((3, size), np.int64)
            for words, of, known in blocks(batch.column(1).to_pylist()):
                found[0] += np.bincount(of[known:], minlength=size)
                for last, crc in head.value.crcs(words, of):
                    new = last >= known
                    text, gain = of[last[new]], gains.value[crc[new] % buckets]
                    found[1] += np.bincount(text, minlength=size)
                    # sums of doubles are exact here: whole numbers below 2 ** 53
                    found[2] += np.bincount(text, weights=gain, minlength=size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], names=["doc_id", *(n for n, _ in kinds)])

    given = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def first_ranks(rows: DataFrame, order: list, n: int, count: int) -> DataFrame:
    """``rows`` (``count`` of them) with ``rank``, 1 to n in an order, null from there on.

    Rows are dealt to ranges of the order and written; a row's rank is its place in its range after
    the sizes of the ranges before, so that no task sorts more than a range.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // RANGE + 1)
    dealt = materialize(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").count().orderBy("_range").collect()  # a row a range
    before = np.cumsum([0, *(r["count"] for r in sizes)]).tolist()
    wanted = [(r["_range"], b) for r, b in zip(sizes, before, strict=False) if b < n]
    starts = spark.createDataFrame(wanted, "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    near = dealt.join(F.broadcast(starts), "_range").withColumn("rank", place)
    far = dealt.join(F.broadcast(starts), "_range", "left_anti").withColumn("rank", F.lit(None).cast("long"))
    return near.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank").cast("long"))).drop("_range", "_before").unionByName(far.drop("_range"))


def noise(seed: int) -> F.Column:
    """A Gumbel variate of each doc_id, in thousandths, rounded down; the same at every run."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text).

    ``percent`` of those with at least ``least_words`` words are drawn towards the distribution of
    ``target`` (text): the largest sums of weight and noise, ties to the smaller doc_id; rank counts
    them from 1, others have none. Null and empty texts have no features and weight 0. A null doc_id
    has no noise and so no score or rank. Repeated rows are rows like others. An empty target or an
    empty table of documents is a distribution of no features; other columns are left out. Long
    texts are cut between words and never held in words as a whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    head = spark.sparkContext.broadcast(frequent(texts_of(docs)))
    found = bucket_gains(spark, bucket_totals(docs, head, buckets), bucket_totals(target, head, buckets), buckets)
    gains = spark.sparkContext.broadcast(np.array([r["gain"] for r in found.orderBy("bucket").collect()], np.int64))  # a row a bucket
    rows = weights(docs, head, gains, buckets).withColumn("score", F.col("weight") + noise(seed))
    rows = materialize(rows, "weights")
    asked = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    count = rows.filter(asked).count()
    ranked = first_ranks(rows.filter(asked), [F.desc("score"), F.asc("doc_id")], percent * count // 100, count)
    return ranked.unionByName(rows.filter(~asked).withColumn("rank", F.lit(None).cast("long")))


#: The op11 query in DuckDB's SQL: a CRC is linear, so that of a feature is the exclusive or of what each byte gives at its distance from the end, and of its length.
RESAMPLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, -row_number() OVER () AS r FROM benchmark),
f AS (SELECT r, array_to_string(w[i:i + n - 1], ' ') AS f FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT r, w FROM d UNION ALL SELECT r, w FROM b)), (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(w)),
c AS (SELECT f, sum((r > 0)::INT)::BIGINT AS s, sum((r < 0)::INT)::BIGINT AS t FROM f GROUP BY f),
h AS MATERIALIZED (SELECT f, s, t, hex(encode(f)) AS x FROM c),
bits AS (SELECT b, 0 AS k, b AS v FROM (SELECT unnest(range(256)) AS b) UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT b, v FROM bits WHERE k = 8),
longest AS (SELECT max(len(x) // 2) AS n FROM h),
step AS (SELECT 0 AS d, b, v FROM tab UNION ALL SELECT d + 1, step.b, xor(step.v >> 8, tab.v) FROM step JOIN tab ON tab.b = step.v & 255 WHERE d < (SELECT n FROM longest)),
zero AS (SELECT 0 AS n, 4294967295::BIGINT AS v UNION ALL SELECT n + 1, xor(zero.v >> 8, tab.v) FROM zero JOIN tab ON tab.b = zero.v & 255 WHERE n < (SELECT n FROM longest)),
bytes AS (SELECT f, len(x) // 2 - i AS d, (strpos('0123456789ABCDEF', x[2 * i - 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i]) - 1 AS b FROM (SELECT f, x, unnest(range(1, len(x) // 2 + 1)) AS i FROM h)),
crc AS (SELECT f, bit_xor(step.v) AS v FROM bytes JOIN step USING (d, b) GROUP BY f),
k AS MATERIALIZED (SELECT h.f, s, t, xor(xor(crc.v, zero.v), 4294967295) % 10000 AS bucket FROM h JOIN crc ON crc.f = h.f JOIN zero ON zero.n = len(h.x) // 2),
total AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM k),
gain AS (SELECT bucket, floor(1000.0::DOUBLE * ln((sum(k.t) + 1)::DOUBLE * (any_value(total.s) + 10000) / ((sum(k.s) + 1)::DOUBLE * (any_value(total.t) + 10000))))::BIGINT AS gain FROM k, total GROUP BY bucket),
weight AS (SELECT r, count(*)::BIGINT AS n, sum(gain)::BIGINT AS w FROM f JOIN k ON k.f = f.f JOIN gain USING (bucket) WHERE r > 0 GROUP BY r),
score AS (SELECT doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight.w, 0) AS weight,
    (coalesce(weight.w, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT) AS score
  FROM d LEFT JOIN weight USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id) AS rank, sum((n_words >= 20 AND score IS NOT NULL)::INT) OVER () AS n FROM score)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND score IS NOT NULL AND rank <= 5 * n // 100 THEN rank END AS rank FROM ranked
"""
