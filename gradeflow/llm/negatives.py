"""Hard negatives of anchors, by exact scores from residues.

Whole-number components are taken modulo a few primes, small enough that a product of float32 matrices
of residues is exact; as many primes as the largest possible score asks. Chinese remaindering gives
the signed scores back. Packed blocks of anchors meet packed blocks of all rows, once for the
positives of each anchor and once for the negatives in the window of each positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small, small_batches

#: Rows of a packed block, scores worked on at once, blocks of anchors that are broadcast or held in lists at most (2 MB each at 64 components), blocks of rows that meet one of anchors in a task beyond that.
ROWS, SCORES, SENT, SHARE = 4096, 1 << 17, 8, 64
#: Residues of this many dimensions are multiplied at once; primes stay below twice LARGEST.
DEPTH, LARGEST = 64, 511


def primes(bound: int) -> list[int]:
    """Primes, the largest first, whose product exceeds twice ``bound``: signed scores up to it are told apart."""
    found, product, p = [], 1, 2 * LARGEST + 1
    while product <= 2 * bound + 1:
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            found.append(p)
            product *= p
        p -= 1
    return found


def residues(ints: np.ndarray, p: int) -> np.ndarray:
    """Of whole numbers, those nearest to 0, so that DEPTH products of two add up below 2 ** 24."""
    r = (ints % p).astype(np.float32)
    r[r > p // 2] -= p
    return r


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Doubles that hold whole numbers, in place, modulo an odd p; those nearest to 0."""
    part = np.rint(x * (1.0 / p))
    part *= p
    x -= part
    return x


class Scores:
    """Exact scores of rows by anchors, within ``bound`` of 0; as 64-bit integers, beyond which they wrap around."""

    def __init__(self, anchors: np.ndarray, bound: int):
        self.primes = primes(bound)
        self.anchors = [residues(anchors, p).T for p in self.primes]

    def of(self, rows: np.ndarray) -> np.ndarray:
        digits: list[np.ndarray] = []
        value, weight = np.zeros((len(rows), self.anchors[0].shape[1]), np.int64), 1
        for p, anchors in zip(self.primes, self.anchors, strict=True):
            mine, rest = residues(rows, p), 0
            for d in range(0, rows.shape[1], DEPTH):
                rest = centred(rest + (mine[:, d : d + DEPTH] @ anchors[d : d + DEPTH]).astype(np.float64), p)
            # what the digits so far leave, divided by the primes before: digits around 0 give signed numbers
            for q, digit in zip(self.primes, digits, strict=False):
                rest = centred((rest - digit) * pow(q, -1, p), p)
            digits.append(rest)
            value += rest.astype(np.int64) * np.int64(wrapped(weight))
            weight *= p
        return value


def wrapped(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


class Best:
    """The k best rows of each of n lists so far: higher scores first, ties by id and then by place."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.held = np.zeros((4, 0), np.int64)
        self.bar = np.full(n, np.iinfo(np.int64).min)

    def add(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        """``scores`` and ``allowed``: rows by lists."""
        open_ = allowed & (scores >= self.bar)
        if open_.sum() > 4 * self.k * self.n:
            masked = np.where(open_, scores, np.iinfo(np.int64).min)
            open_ &= scores >= np.partition(masked, -self.k, 0)[-self.k]
        i, j = np.nonzero(open_)
        self.merge(np.stack([j, scores[i, j], ids[i], places[i]]))

    def merge(self, new: np.ndarray) -> None:
        """``new``: list, score, id, place."""
        rows = np.concatenate([self.held, new], 1)
        rows = rows[:, np.lexsort((rows[3], rows[2], ~rows[1], rows[0]))]
        start = np.searchsorted(rows[0], rows[0], "left")
        rank = np.arange(rows.shape[1]) - start
        self.held = rows[:, rank < self.k]
        last = rows[:, rank == self.k - 1]
        self.bar[last[0]] = last[1]


def usable(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, label, ints) with floor(scale * x) of each component; rows with a null id, label, vector or component, or a non-finite or no component, are left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    given = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0)).filter(~F.coalesce(bad, F.lit(True)))
    return given.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("ints"))


#: Columns of a packed block besides its dimensions: 64-bit integers as bytes.
PACKED = ("vec_id", "row", "label", "ints", "more")


def packed(rows: DataFrame, parts: int) -> DataFrame:
    """Written blocks (dims, block, and PACKED as bytes) of at most ROWS rows; ``more``, an array of longs, may be missing."""
    kinds = pa.schema([("dims", pa.int32()), *((n, pa.binary()) for n in PACKED)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}

        def block(dims: int, part: pa.Table) -> pa.RecordBatch:
            flat = [c.flatten() if pa.types.is_list(c.type) else c for c in (part.column(n).combine_chunks() for n in PACKED)]
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), *(pa.array([c.to_numpy().astype(np.int64).tobytes()]) for c in flat)], schema=kinds)

        for batch in batches:
            given = pa.Table.from_batches([batch])
            size = batch.column("ints").value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(size).tolist():
                new = given.filter(pa.array(size == dims))
                held[dims] = pa.concat_tables([held[dims], new]) if dims in held else new
                while held[dims].num_rows >= ROWS:
                    yield block(dims, held[dims][:ROWS])
                    held[dims] = held[dims][ROWS:]
        for dims, rest in held.items():
            if rest.num_rows:
                yield block(dims, rest)

    more = F.col("more") if "more" in rows.columns else F.array().cast("array<long>").alias("more")
    found = rows.repartition(parts, "row").select("vec_id", "row", "label", "ints", more).mapInArrow(pack, "dims int, " + ", ".join(f"{n} binary" for n in PACKED))
    return materialize(found.withColumn("block", F.monotonically_increasing_id()), "packed")


def meet(blocks: DataFrame, anchors: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work`` over every block of rows with every block of anchors of as many dimensions.

    A few blocks of anchors (counted) are broadcast to the rows; otherwise both sides are dealt out
    by (block of anchors, share of the rows), some SHARE blocks of rows to a key.
    """
    sent = anchors.select("dims", F.col("block").alias("a"), *[F.col(n).alias(f"a_{n}") for n in PACKED])
    if anchors.count() <= SENT:
        pairs = blocks.join(F.broadcast(sent), "dims")
    else:
        shares = F.lit(max(1, blocks.count() // SHARE)).cast("long")
        met = blocks.join(small(sent.select("dims", "a")), "dims").withColumn("share", F.pmod(F.xxhash64("block"), shares))
        pairs = met.join(sent.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))), ["dims", "a", "share"])
    return pairs.select("a", "dims", *PACKED, *[f"a_{n}" for n in PACKED]).mapInArrow(work, schema)


def block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray], dict[str, np.ndarray], Iterator[tuple[slice, np.ndarray]]]]:
    """(block of anchors, its arrays, arrays of the rows, (slice of the rows, their exact scores) one after another)."""
    for batch in batches:
        for i in range(batch.num_rows):
            cell = lambda name: batch.column(name)[i].as_py()  # noqa: E731, B023
            dims = cell("dims")
            rows, anchors = ({n: np.frombuffer(cell(f"{mark}{n}"), np.int64) for n in PACKED} for mark in ("", "a_"))
            q, v = anchors["ints"].reshape(-1, dims), rows["ints"].reshape(-1, dims)
            scores = Scores(q, dims * largest(q) * largest(v))
            step = max(1, SCORES // len(q))
            yield cell("a"), anchors, rows, ((s, scores.of(v[s])) for s in (slice(k, k + step) for k in range(0, len(v), step)))


def largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min()))


def in_lists(work: Callable, out: Callable, k: int) -> Callable:
    """A task: ``work`` adds every pair of blocks to the lists of its block of anchors, ``out`` gives their rows; lists of SENT blocks are held at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for a, anchors, rows, scored in block_pairs(batches):
            if a not in held:
                if len(held) >= SENT:
                    for x in held.values():
                        yield out(*x)
                    held.clear()
                held[a] = anchors, [Best(len(anchors["vec_id"]), k) for _ in range(max(1, len(anchors["more"]) // len(anchors["vec_id"])))]
            for s, scores in scored:
                work(held[a][1], anchors, {n: rows[n][s] for n in ("vec_id", "row", "label")}, scores)
        for x in held.values():
            yield out(*x)

    return run


def positives(blocks: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(anchor_id, no, positive_id, positive_score): the first k other rows of an anchor's label, numbered from 0."""

    def work(lists: list[Best], anchors: dict, rows: dict, scores: np.ndarray) -> None:
        allowed = (rows["label"][:, None] == anchors["label"]) & (rows["vec_id"][:, None] != anchors["vec_id"])
        lists[0].add(scores, allowed, rows["vec_id"], rows["row"])

    def out(anchors: dict, lists: list[Best]) -> pa.RecordBatch:
        of, score, vec, row = lists[0].held
        return pa.RecordBatch.from_arrays([pa.array(anchors["vec_id"][of]), pa.array(vec), pa.array(row), pa.array(score)], names=["anchor_id", "positive_id", "row", "positive_score"])

    found = meet(blocks, anchors, in_lists(work, out, k), "anchor_id long, positive_id long, row long, positive_score long")
    no = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id", "row")) - 1
    return found.withColumn("no", no).filter(F.col("no") < k).select("anchor_id", "no", "positive_id", "positive_score")


def negatives(blocks: DataFrame, anchors: DataFrame, k: int, percent: int) -> DataFrame:
    """(anchor_id, no, rank, negative_id, negative_score): for every positive score in ``more`` of the anchors, the first k rows of other labels from ``percent`` of it up to itself."""

    def work(lists: list[Best], anchors: dict, rows: dict, scores: np.ndarray) -> None:
        other = rows["label"][:, None] != anchors["label"]
        bars = anchors["more"].reshape(len(anchors["vec_id"]), -1, 3)
        for no, best in enumerate(lists[: bars.shape[1]]):
            there, low, high = bars[:, no].T
            best.add(scores, other & (scores >= low) & (scores <= high) & (there > 0), rows["vec_id"], rows["row"])

    def out(anchors: dict, lists: list[Best]) -> pa.RecordBatch:
        of, score, vec, row = np.concatenate([b.held for b in lists], 1)
        no = np.repeat(np.arange(len(lists)), [b.held.shape[1] for b in lists])
        columns = [anchors["vec_id"][of], no.astype(np.int32), vec, row, score]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["anchor_id", "no", "negative_id", "row", "negative_score"])

    found = meet(blocks, anchors, in_lists(work, out, k), "anchor_id long, no int, negative_id long, row long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "no").orderBy(F.desc("negative_score"), "negative_id", "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("anchor_id", "no", "rank", "negative_id", "negative_score")


def hard_negatives(vectors: DataFrame, is_anchor, n_positives: int = 5, n_negatives: int = 5, percent: int = 80, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``vectors`` (vec_id, label, embedding).

    Scores are exact inner products of floor(scale * x). ``is_anchor``: a condition on vec_id. An
    anchor's positives are its first other rows of its label; a positive's negatives the first rows of
    other labels whose score is at least ``percent`` in a hundred of the positive's and at most that.
    Higher scores come first, ties by the smaller vec_id. Rows that ``usable`` leaves out take no part;
    only vectors of equal length meet. A repeated anchor id is one anchor, by its smallest label and
    vector; rows of its id are no positives; other repeated rows count each. No positives or
    negatives, or an empty table, give no rows. Other columns are left out. Scores that a long
    doesn't hold wrap around.
    """
    spark = vectors.sparkSession
    small_batches(spark, ROWS)
    rows = materialize(usable(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "whole")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // (ROWS * SHARE) + 1)
    first = rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "ints", "row")).alias("x")).select("vec_id", "x.*")
    first = materialize(first, "anchors")
    of_anchors = first.count() // ROWS + 1
    blocks = packed(rows, parts)
    small_batches(spark, 8)  # a row is a pair of blocks
    pos = materialize(positives(blocks, packed(first, of_anchors), n_positives), "positives")
    # whole numbers: the least one not below percent / 100 of the score is the score less that part of it, rounded down
    share = (100 - percent) / 100
    score = F.col("positive_score")
    low = score - F.floor(score.cast("decimal(38, 0)") * F.lit(share).cast("decimal(3, 2)")).cast("long")
    bars = pos.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("no", low.alias("low"), score.alias("high")))).alias("bars"))
    at = lambda i: F.get("bars", F.lit(i))
    more = F.array(*[c for i in range(n_positives) for c in (F.when(at(i).isNull(), 0).otherwise(1).cast("long"), F.coalesce(at(i)["low"], F.lit(0)), F.coalesce(at(i)["high"], F.lit(0)))])
    small_batches(spark, ROWS)
    asked = packed(first.join(bars.select(F.col("anchor_id").alias("vec_id"), more.alias("more")), "vec_id"), of_anchors)
    small_batches(spark, 8)
    found = negatives(blocks, asked, n_negatives, percent)
    return found.join(pos, ["anchor_id", "no"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The op12 query in DuckDB's SQL.
NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS ints FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, ints) = 1),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, list_inner_product(a.ints, v.ints)::BIGINT AS score
  FROM a JOIN v ON len(v.ints) = len(a.ints)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS no
  FROM s WHERE same AND vec_id <> anchor_id QUALIFY no <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, no ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 100 * score BETWEEN 80 * positive_score AND 100 * positive_score
QUALIFY rank <= 5
"""
