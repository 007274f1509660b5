"""Best-fit packing of tokenized documents into sequences of a fixed length.

Lengths are integers up to the capacity, so the packing is decided on their histogram (at most
``capacity`` rows, however many documents there are): items over a third of the capacity are
matched greedily, two in a bin at most; smaller ones best-fit what remains. The plan says which
ranks of each length go to which bins; documents take their rank from counts by (length, salt).
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .tokenizing import byte_bpe, read_file

#: Id that ends a document.
END = 0
#: Groups into which the items of one length are dealt before they are ranked.
SALTS = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, pattern: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document, null text as empty.

    A document is its ids and a closing 0. Only longer ones than ``capacity`` are cut; then the
    first piece takes the remainder and the others are full.
    """
    small_batches(docs.sparkSession)
    spec = read_file(tokenizer).decode()
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(kinds)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(spec, pattern)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = bpe.encode(text or "") + END.to_bytes(4, "little")
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc, piece, a, b - a, zlib.crc32(part), part)[: len(kinds)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for _, t in kinds], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(encode, PIECES + ", ids binary" * with_ids)


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, last rank + 1, first bin, offset) and the number of bins.

    The items of ranks r0 <= r < r1 of a length go to the bins first + r - r0, at the offset. Bins
    of the same filling are kept as one group (gap -> [first bin, count]), so the work depends on
    the capacity and not on the number of items.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    taken = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    bins = 0

    def put(size: int, count: int, first: int, offset: int) -> None:
        runs.append((size, taken[size], taken[size] + count, first, offset))
        taken[size] += count
        left[size] -= count

    def leave(gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            gaps.setdefault(gap, []).append((first, count))

    large = sorted(s for s in left if 3 * s > capacity)
    for size in reversed(large):
        while left[size] > 0:
            fits = [s for s in large[: bisect.bisect_right(large, min(size, capacity - size))] if left[s] > 0]
            mate = fits[-1] if fits else None
            if mate is None or (mate == size and left[size] == 1 and len(fits) == 1):
                count = left[size]
                put(size, count, bins, 0)
                leave(capacity - size, bins, count)
            else:
                if mate == size and left[size] == 1:
                    mate = fits[-2]
                count = left[size] // 2 if mate == size else min(left[size], left[mate])
                put(size, count, bins, 0)
                put(mate, count, bins, size)
                leave(capacity - size - mate, bins, count)
            bins += count
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size] > 0:
            gap = min((g for g in gaps if g >= size), default=None)
            if gap is None:
                each = capacity // size
                full, rest = divmod(left[size], each)
                for i in range(each if full else 0):
                    put(size, full, bins, i * size)
                leave(capacity - each * size, bins, full)
                bins += full
                for i in range(rest):
                    put(size, 1, bins, i * size)
                leave(capacity - rest * size, bins, int(rest > 0))
                bins += rest > 0
                continue
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            used = min(count, left[size])
            put(size, used, first, capacity - gap)
            leave(gap - size, first, used)
            leave(gap, first + used, count - used)
    return runs, bins


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (a written table with doc_id, piece, length) with ``sequence_id`` and ``offset``.

    Every piece is placed once, gapless from 0 in its sequence. Lengths must lie in 1..capacity.
    Equal rows get different places. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    counts = materialize(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs, _ = plan_bins(histogram, capacity)
    by_size: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for run in runs:
        by_size.setdefault(run[0], []).append(run)
    tables = spark.sparkContext.broadcast({s: np.array(sorted(x), np.int64) for s, x in by_size.items()})

    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_row", F.row_number().over(within)).join(starts, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    names = pieces.columns
    kinds = pieces.schema.simpleString()[len("struct<") : -1].split(",")
    out = ", ".join(k.replace(":", " ", 1) for k in [*kinds, "sequence_id:bigint", "offset:bigint"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = tables.value
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            where, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                at, runs_of = np.flatnonzero(size == s), plan[int(s)]
                run = runs_of[np.searchsorted(runs_of[:, 1], rank[at], "right") - 1]
                where[at], offset[at] = run[:, 3] + rank[at] - run[:, 1], run[:, 4]
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(where), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(place, out)


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = 2048) -> DataFrame:
    """Pack every document (doc_id, text; other columns are ignored) into sequences of ``capacity`` ids.

    Null and empty texts are a single closing id; a null doc_id is kept as null; repeated rows are
    packed as often as they occur; ties between equal lengths are broken by doc_id and piece.
    """
    return pack(materialize(token_pieces(docs, tokenizer, pattern, capacity), "pieces"), capacity)


def fill(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary) from packed pieces that carry ``ids``: a sequence's pieces joined by offset."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (s, x) -> concat(s, x.ids))").alias("ids"))
