"""Documents linked by the Jaccard similarity of their word shingles: a blocked sparse matrix product.

The incidence matrix (documents by shingles) is cut into blocks of shingles. Within a block, every
shingle's documents give pairs, and overlap counts are accumulated; counts of all blocks are added
and pairs below a bound from their sizes are discarded. Survivors are verified on whole sets.

What keeps it linear:
* Exact copies (equal sets) are one row of the matrix.
* Only a document's prefix enters: in one order of all shingles, two sets with Jaccard >= t share
  one of their first n - ceil(t n) + 1. The order is by hash, with shingles that are frequent in
  some part of the corpus last, by frequency; any order is exact.
* Near copies that share a minimum hash are verified first, against one centre. In the product, only
  pairs of different groups count, so that a group of thousands of near copies isn't paired up.
* A shingle that a crowd shares yields no pairs at all: its documents are named as members of the
  crowd of their largest group, and crowds are multiplied on whole sets, chunk by chunk; only links
  of that group's members with others, and of others among themselves, are left to look for.
* If c prefix entries are common to sets of sizes m <= n, the overlap is at most c + ceil(t n) - 1;
  a link needs t / (1 + t) (m + n).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, small, small_batches
from .shingles import Shingler, digest, linked, spanning

#: Shingles that a task gathers before it counts them, and the count from which one is reported as frequent.
CHUNK, FREQUENT = 3_000_000, 4
#: Frequent shingles that are ordered last; the others keep their place by hash.
KNOWN = 200_000
#: Entries of the incidence matrix in a block; partners and shingles verified in a task at a time.
BLOCK, PARTNERS, PARTNER_SHINGLES = 1_000_000, 200, 400_000
#: Minimum hashes by which near copies are grouped first: some for all, then the rest for those that are in no common group yet.
MINIMA, FIRST = 8, 2
#: Pairs that a block holds before it adds up equal ones; documents of a shingle from which they are compared by whole sets.
PENDING, CROWD = 2_000_000, 64
#: Documents on a side of a task that compares whole sets; shingles multiplied at a time.
SIDE, COLUMNS = 768, 4096


def as_bytes(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def document_sets(docs: DataFrame) -> DataFrame:
    """Written table of (doc_id, n, digest) for every row, and (hash, seen) of shingles frequent in a part of the corpus."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("hash", pa.int64()), ("seen", pa.int64())])

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        h, c = h[c >= FREQUENT].view(np.int64), c[c >= FREQUENT]
        none = [pa.nulls(len(h), t) for t in (pa.int64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([*none, pa.array(h), pa.array(c)], schema=kinds)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, n_held = Shingler(), [], 0
        for batch in batches:
            sets = [shingles(t) for t in as_bytes(batch, "text")]
            n = len(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=kinds)
            for s in sets:
                held.append(s)
                n_held += len(s)
                if n_held >= CHUNK:
                    yield frequent(held)
                    held, n_held = [], 0
        if n_held:
            yield frequent(held)

    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, n long, digest binary, hash long, seen long"), "sets")


def prefixes(docs: DataFrame, known: np.ndarray, percent: int) -> DataFrame:
    """Written table with a row for each distinct set: its smallest doc_id, n, minimum hashes and prefix (64-bit hashes)."""
    frequent = docs.sparkSession.sparkContext.broadcast((np.sort(known), np.argsort(known)))
    kinds = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("minima", pa.list_(pa.int64())), ("prefix", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, (sorted_known, rank) = Shingler(), frequent.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch, "text"), strict=True):
                s = shingles(text)
                n = len(s)
                if not n or doc is None:
                    continue
                p = n - (percent * n + 99) // 100 + 1
                if len(sorted_known):
                    at = np.minimum(np.searchsorted(sorted_known, s), len(sorted_known) - 1)
                    is_known = sorted_known[at] == s
                    late = s[is_known][np.argsort(rank[at[is_known]])]
                    prefix = np.concatenate([s[~is_known][:p], late])[:p]
                else:
                    prefix = s[:p]
                parts = np.searchsorted(s, np.arange(MINIMA, dtype=np.uint64) * np.uint64(2**64 // MINIMA))
                minima = [int(s[i % n].view(np.int64)) for i in parts]
                rows.append((doc, digest(s), n, minima, prefix.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, digest binary, n long, minima array<long>, prefix binary")
    one = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("minima").alias("minima"), F.first("prefix").alias("prefix"))
    return materialize(one, "prefixes")


def near_centres(reps: DataFrame, groups: DataFrame | None, percent: int) -> DataFrame:
    """(a, b): the distinct sets that share a minimum hash, each with the smallest id among them, if sizes allow a link.

    Without ``groups``, by the first minima; with them, by the others, and only across groups.
    """
    keys = reps.select("rep", "n", F.posexplode("minima").alias("at", "key")).filter(F.col("at") < FIRST if groups is None else F.col("at") >= FIRST)
    if groups is None:
        keys = keys.withColumn("grp", F.col("rep"))
    else:
        keys = keys.join(groups.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("grp", F.coalesce("root", "rep"))
    centres = keys.groupBy("at", "key").agg(F.min(F.struct("rep", "n", "grp")).alias("c"), F.count("*").alias("many")).filter("many > 1").select("at", "key", F.col("c.rep").alias("a"), F.col("c.n").alias("na"), F.col("c.grp").alias("ga"))
    pairs = keys.join(centres, ["at", "key"]).filter("grp <> ga").filter(f"100 * least(n, na) >= {percent} * greatest(n, na)")
    return pairs.groupBy("a", F.col("rep").alias("b")).agg(F.first("na").alias("na"), F.first("n").alias("nb"))


def block_counts(reps: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Written table (a, b, c, na, nb): pairs of different groups with the overlap of their prefixes in a block; c = -1: document b is in crowd a."""
    entries = reps.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    blocks = max(16, entries // 8 // BLOCK + 1)
    rows = reps.select("rep", "n", "prefix").join(groups.select(F.col("node").alias("rep"), "root"), "rep", "left").select("rep", "n", F.coalesce("root", "rep").alias("grp"), "prefix")
    kinds = pa.schema([("block", pa.int64()), ("hash", pa.binary()), ("doc", pa.binary()), ("n", pa.binary()), ("grp", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            h = np.frombuffer(b"".join(texts), np.uint64)
            each = np.array([len(t) // 8 for t in texts], np.int64)
            doc, n, grp = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), each) for i in range(3))
            block = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(24)) % np.uint64(blocks)
            order = np.argsort(block, kind="stable")
            block, h, doc, n, grp = (x[order] for x in (block, h, doc, n, grp))
            ends = np.flatnonzero(np.diff(block)) + 1
            cells = [(int(block[a]), h[a:b].tobytes(), doc[a:b].tobytes(), n[a:b].tobytes(), grp[a:b].tobytes()) for a, b in zip([0, *ends], [*ends, len(h)], strict=True) if b > a]
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*cells, strict=True), kinds, strict=True)], schema=kinds)

    def multiply(parts_of_block: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = pd.concat(parts_of_block)
        h, doc, n, grp = (np.frombuffer(b"".join(cells[c]), t) for c, t in (("hash", np.uint64), ("doc", np.int64), ("n", np.int64), ("grp", np.int64)))
        ids, first, code = np.unique(doc, return_index=True, return_inverse=True)
        size, group = n[first], grp[first]
        order = np.lexsort((size[code], h))
        h, code = h[order], code[order]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
        length = np.diff(np.r_[starts, len(h)])
        held, n_held = [], 0
        crowds: dict[int, list[np.ndarray]] = {}

        def add_up(keys: list[np.ndarray]) -> pd.DataFrame:
            key, c = np.unique(np.concatenate(keys), return_counts=True)
            i, j = key // len(ids), key % len(ids)
            a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            return pd.DataFrame({"a": a, "b": b, "c": c, "na": np.where(ids[i] == a, size[i], size[j]), "nb": np.where(ids[i] == a, size[j], size[i])})

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for many in np.unique(length[length > 1]):
                at = starts[length == many]
                if many <= CROWD:
                    x, y = np.triu_indices(many, 1)
                    step = max(1, PENDING // len(x))
                    for k in range(0, len(at), step):
                        rows = code[at[k : k + step, None] + np.arange(many)]
                        yield rows[:, x].ravel(), rows[:, y].ravel()
                else:
                    for s in at:
                        row = code[s : s + many]
                        kinds_of, of = np.unique(group[row], return_inverse=True)
                        if len(kinds_of) > 1:
                            crowds.setdefault(int(kinds_of[np.bincount(of).argmax()]), []).append(row)

        for i, j in parts():
            fit = (group[i] != group[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
            i, j = i[fit], j[fit]
            held.append(np.minimum(i, j) * len(ids) + np.maximum(i, j))
            n_held += len(i)
            if n_held > PENDING:
                yield add_up(held)
                held, n_held = [], 0
        if n_held:
            yield add_up(held)
        for crowd, members in crowds.items():
            some = np.unique(np.concatenate(members))
            yield pd.DataFrame({"a": crowd, "b": ids[some], "c": -1, "na": 0, "nb": size[some]})

    cells = rows.mapInArrow(cut, "block long, hash binary, doc binary, n binary, grp binary")
    return materialize(cells.groupBy("block").applyInPandas(multiply, "a long, b long, c long, na long, nb long"), "block-counts")


def bounded_pairs(counts: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb) of which the prefixes' accumulated overlap reaches the bound from their sizes."""
    total = counts.filter("c > 0").groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    # overlap >= percent / (100 + percent) * (na + nb), at most c + ceil(t max(na, nb)) - 1
    need = F.ceil((percent * (F.col("na") + F.col("nb"))) / F.lit(100.0 + percent) - 1e-9)
    rest = F.floor((percent * F.greatest("na", "nb") + 99) / F.lit(100.0)) - 1
    return total.filter(F.col("c") + rest >= need).select("a", "b", "na", "nb")


def texts_of(docs: DataFrame, reps: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """(doc_id, text as bytes) of the ids; of rows that repeat an id (if there are any), the one whose set stands for it."""
    ids = small(ids)
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi")
    if not repeated:
        return texts.select("doc_id", F.col("text").cast("binary").alias("text"))
    shape = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("found", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            content = as_bytes(batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary()), pa.array([digest(shingles(t)) for t in content], pa.binary())], schema=shape)

    chosen = reps.select(F.col("rep").alias("doc_id"), "digest").join(ids, "doc_id", "left_semi")
    found = texts.mapInArrow(sets, "doc_id long, text binary, found binary").join(chosen, "doc_id").filter("found = digest")
    return found.groupBy("doc_id").agg(F.first("text").alias("text"))


def crowd_links(docs: DataFrame, reps: DataFrame, counts: DataFrame, groups: DataFrame, percent: int, repeated: bool) -> DataFrame:
    """Written table (a, b): links within crowds that join different groups, as stars.

    A crowd's largest group and its other documents are cut into chunks; every chunk of others is
    multiplied with every other chunk, whole sets by whole sets.
    """
    members = counts.filter("c < 0").select(F.col("a").alias("crowd"), F.col("b").alias("doc_id")).distinct()
    members = members.join(groups.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("grp", F.coalesce("root", "doc_id")).drop("root")
    members = materialize(members, "crowds")
    sizes = members.groupBy("crowd", "grp").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("crowd").agg(F.max_by("grp", F.struct("n", "grp")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"))
    sizes = sizes.select("crowd", "main", F.ceil(F.col("n_main") / SIDE).alias("mains"), F.ceil((F.col("n_all") - F.col("n_main")) / SIDE).alias("others")).filter("others > 0")
    rows = members.join(sizes, "crowd").withColumn("is_main", F.col("grp") == F.col("main"))
    salt = F.xxhash64("doc_id")
    rows = rows.withColumn("chunk", F.when(F.col("is_main"), F.col("others") + F.pmod(salt, F.col("mains"))).otherwise(F.pmod(salt, F.col("others"))))
    partner = F.when(F.col("is_main"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    rows = rows.withColumn("partner", F.explode(partner)).select("crowd", F.least("chunk", "partner").alias("lo"), F.greatest("chunk", "partner").alias("hi"), "doc_id", F.col("chunk").alias("own"))
    ids = members.select("doc_id").distinct()

    def multiply(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        shingles, lo = Shingler(), int(key[1])
        sets = [shingles(t) for t in group.text]
        doc, n = group.doc_id.to_numpy(), np.array([len(s) for s in sets])
        left = np.flatnonzero(group.own.to_numpy() == lo)
        right = left if key[1] == key[2] else np.flatnonzero(group.own.to_numpy() != lo)
        row = np.repeat(np.arange(len(sets)), n)
        _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # only shingles that two documents have can be common
        new = np.cumsum(seen > 1) - 1
        row, column = row[seen[column] > 1], new[column[seen[column] > 1]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(left), len(right)), np.float32)
        for start in range(0, int(new[-1]) + 1 if len(new) else 0, COLUMNS):
            a, b = np.searchsorted(column, [start, start + COLUMNS])
            part = np.zeros((len(sets), COLUMNS), np.float32)
            part[row[a:b], column[a:b] - start] = 1
            both += part[left] @ part[right].T
        i, j = np.nonzero((100 * both >= percent * (n[left][:, None] + n[right] - both)) & (both > 0))
        i, j = left[i], right[j]
        root = spanning(len(sets), i[i != j], j[i != j])
        linked = np.flatnonzero(root != np.arange(len(sets)))
        return pd.DataFrame({"a": doc[root[linked]], "b": doc[linked]})

    placed = rows.join(texts_of(docs, reps, ids, repeated), "doc_id")
    return materialize(placed.groupBy("crowd", "lo", "hi").applyInPandas(multiply, "a long, b long"), "crowd-links")


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, percent: int, repeated: bool) -> DataFrame:
    """The ``pairs`` (a, b, na, nb: a written table) that link, by whole sets.

    Texts are fetched for the ids in pairs alone. Partners of an ``a`` are dealt in lots of a few
    hundred, each lot with the text of ``a``, so that a document with very many partners is spread.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = texts_of(docs, reps, ids, repeated)
    lots = pairs.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / PARTNERS), F.ceil(F.sum("nb") / PARTNER_SHINGLES)).alias("lots"))
    dealt = pairs.join(lots, "a").withColumn("lot", F.pmod(F.xxhash64("b"), F.col("lots")))
    partners = dealt.select("a", "lot", F.col("b").alias("doc_id"))
    centres = dealt.select("a", "lot", F.col("a").alias("doc_id")).distinct()
    rows = partners.union(centres).join(texts, "doc_id")

    def check(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        shingles, a = Shingler(), key[0]
        centre = shingles(group.text[group.doc_id == a].iloc[0])
        found = [b for b, t in zip(group.doc_id, group.text, strict=True) if b != a and linked(centre, shingles(t), percent)]
        return pd.DataFrame({"a": np.full(len(found), a, np.int64), "b": np.array(found, np.int64)})

    return materialize(rows.groupBy("a", "lot").applyInPandas(check, "a long, b long"), "links")


def jaccard_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text; others are ignored).

    Null texts and texts without words have no shingles and link with nothing. A row with a null
    doc_id links with nothing and has a null component. Repeated rows get the same answer; of rows
    that repeat an id with other texts, the one with the smallest set digest stands for the id, and
    all of them get that id's component.
    """
    spark = docs.sparkSession
    small_batches(spark)
    table = document_sets(docs)
    top = table.filter("hash is not null").groupBy("hash").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "hash").limit(KNOWN)
    known = top.toArrow().column(0).to_numpy()[::-1].astype(np.int64).view(np.uint64)
    rows = table.filter("hash is null").select("doc_id", "n", "digest")
    repeated = bool(rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count())
    reps = prefixes(docs, known, percent)
    near, groups = None, None
    for _ in ("first minima", "other minima"):
        found = verified(docs, reps, materialize(near_centres(reps, groups, percent), "near-pairs"), percent, repeated)
        near = found if near is None else near.union(found)
        groups = connected_components(near)
    counts = block_counts(reps, groups, percent)
    pairs = materialize(bounded_pairs(counts, percent), "block-pairs")
    links = near.union(verified(docs, reps, pairs, percent, repeated)).union(crowd_links(docs, reps, counts, groups, percent, repeated))
    roots = connected_components(links)
    one = rows.filter("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("digest"))
    of_set = one.groupBy("digest").agg(F.min("doc_id").alias("rep")).join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("component_id"))
    named = one.join(of_set, "digest").select("doc_id", "component_id")
    return rows.join(named, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, with all columns, that stay when of each component only its smallest doc_id does.

    Rows without an id stay. Of rows that repeat an id, the first by all columns does.
    """
    named = materialize(jaccard_components(docs, percent), "components")
    gone = small(materialize(named.filter("doc_id <> component_id").select("doc_id").distinct(), "gone"))
    stay = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = materialize(named.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if not twice.limit(1).count():
        return stay
    once = stay.join(small(twice), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return stay.join(small(twice), "doc_id", "left_anti").select(*docs.columns).union(once.select(*docs.columns))


#: The op5 query in DuckDB's SQL.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
r AS (SELECT doc_id AS node, doc_id AS peer FROM w UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.peer)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(peer) AS component_id FROM r GROUP BY node) c USING (doc_id)
"""
