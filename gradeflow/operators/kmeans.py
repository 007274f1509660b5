"""k-means of many groups at once, for groups that no single task holds.

Rows are packed by ranges of their order. The means of every group are a written table; each round joins
it with the packs, which give partial sums for every (group, cluster), and writes the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .ranges import in_ranges, like

#: Bytes of a table of means that is broadcast to the packs at most.
SENT = 32 << 20


def gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres; a centre at a time, so that no third dimension is held."""
    return np.stack([((x - c) ** 2).sum(1) for c in centres], 1)


def first_pick(n: int, seed: int) -> int:
    return int(np.random.default_rng(seed).integers(n))


def one_group(x: np.ndarray, k: int, seed: int, rounds: int) -> np.ndarray:
    """Centres of rows in an order: one drawn, then each time the row farthest from all, then rounds of means until they stay."""
    centres = x[[first_pick(len(x), seed)]]
    near = gaps(x, centres)[:, 0]
    while len(centres) < k:
        centres = np.vstack([centres, x[near.argmax()]])
        near = np.minimum(near, gaps(x, centres[-1:])[:, 0])
    for _ in range(rounds):
        own = gaps(x, centres).argmin(1)
        new = np.stack([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> list[tuple[int, int, float]]:
    """(cluster, place of the first of its rows that are nearest to its centre, that distance) of clusters that have rows."""
    gap = gaps(x, centres)
    own = gap.argmin(1)
    found = [(c, int(np.where(own == c, gap[:, c], np.inf).argmin())) for c in range(len(centres)) if (own == c).any()]
    return [(c, i, float(gap[i, c])) for c, i in found]


def long_groups(points: DataFrame, k: int, seed: int, rounds: int, size: int) -> DataFrame:
    """(video_id, id, timestamp, cluster) as ``one_group`` and ``nearest`` give it, for points (video_id, id, timestamp, vec) of groups of more than k rows."""
    kinds = dict(points.dtypes)
    key, head = f"video_id {kinds['video_id']}", ["video_id", "_range"]
    rows = in_ranges(points, "video_id", ["timestamp", "id"], size)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["timestamp", "id"])
        x = np.stack(rows["vec"].to_numpy()).astype(float)
        return like(rows, head, 1, ids=[rows["id"].tolist()], times=[rows["timestamp"].tolist()], n=[len(x)], x=[x.tobytes()])

    packs = written(rows.groupBy(*head).applyInPandas(pack, f"{key}, _range int, ids array<{kinds['id']}>, times array<double>, n long, x binary"), "packs")

    def matrix(data: bytes, n: int) -> np.ndarray:
        return np.frombuffer(data).reshape(n, -1)

    def over(centres: DataFrame, work, schema: str) -> DataFrame:
        """``work``(pack, its rows, the centres of its group) over all packs of groups in ``centres``."""
        size = centres.agg(F.coalesce(F.sum(F.length("c")), F.lit(0))).first()[0]
        sent = centres.select("video_id", "c", "m")
        met = packs.join(F.broadcast(sent) if size <= SENT else sent, "video_id")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in range(len(batch)):
                    p = batch.iloc[i : i + 1]
                    yield work(p, matrix(p["x"].iloc[0], p["n"].iloc[0]), matrix(p["c"].iloc[0], p["m"].iloc[0]))

        return met.mapInPandas(run, schema)

    def place(sizes: pd.DataFrame) -> pd.DataFrame:
        sizes = sizes.sort_values("_range")
        at = first_pick(int(sizes["n"].sum()), seed)
        before = sizes["n"].cumsum() - sizes["n"]
        mine = sizes[(before <= at) & (at < before + sizes["n"])]
        return like(mine, head, 1, at=[at - int(before[mine.index[0]])])

    places = packs.select(*head, "n").groupBy("video_id").applyInPandas(place, f"{key}, _range int, at long")

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                p = batch.iloc[i : i + 1]
                yield like(p, ["video_id"], 1, c=[matrix(p["x"].iloc[0], p["n"].iloc[0])[p["at"].iloc[0]].tobytes()], m=[1])

    centres = written(packs.join(places, head).mapInPandas(drawn, f"{key}, c binary, m long"), "centres")

    def far(p: pd.DataFrame, x: np.ndarray, c: np.ndarray) -> pd.DataFrame:
        near = gaps(x, c).min(1)
        i = int(near.argmax())
        return like(p, head, 1, gap=[float(near[i])], far=[x[i].tobytes()])

    for _ in range(k - 1):
        found = over(centres, far, f"{key}, _range int, gap double, far binary")
        best = found.groupBy("video_id").agg(F.min_by("far", F.struct(-F.col("gap"), "_range")).alias("far"))
        centres = written(centres.join(best, "video_id").select("video_id", F.concat("c", "far").alias("c"), (F.col("m") + 1).alias("m")), "centres")

    def partial(p: pd.DataFrame, x: np.ndarray, c: np.ndarray) -> pd.DataFrame:
        own = gaps(x, c).argmin(1)
        met = np.unique(own)
        return like(p, head, len(met), cluster=met, sum=[x[own == j].sum(0).tobytes() for j in met], n=[int((own == j).sum()) for j in met])

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_range")
        total = np.sum([np.frombuffer(s) for s in rows["sum"]], 0) / rows["n"].sum()
        return like(rows, ["video_id", "cluster"], 1, mean=[total.tobytes()])

    def moved(old: pd.DataFrame, means: pd.DataFrame) -> pd.DataFrame:
        before = matrix(old["c"].iloc[0], old["m"].iloc[0])
        after = before.copy()
        for j, m in zip(means["cluster"], means["mean"], strict=True):
            after[j] = np.frombuffer(m)
        still = np.allclose(after, before)
        return like(old, ["video_id"], 1, c=[(before if still else after).tobytes()], m=[len(before)], still=[bool(still)])

    centres = centres.withColumn("still", F.lit(False))
    for _ in range(rounds):
        moving = centres.filter("not still")
        sums = over(moving, partial, f"{key}, _range int, cluster int, sum binary, n long")
        means = sums.groupBy("video_id", "cluster").applyInPandas(mean, f"{key}, cluster int, mean binary")
        new = moving.groupBy("video_id").cogroup(means.groupBy("video_id")).applyInPandas(moved, f"{key}, c binary, m long, still boolean")
        centres = written(centres.filter("still").unionByName(new), "centres")
        if centres.filter("not still").isEmpty():
            break

    def picks(p: pd.DataFrame, x: np.ndarray, c: np.ndarray) -> pd.DataFrame:
        found = nearest(x, c)
        ids, times = p["ids"].iloc[0], p["times"].iloc[0]
        clusters, at, gap = zip(*found, strict=True)
        return like(p, head, len(found), cluster=clusters, gap=gap, id=[ids[i] for i in at], timestamp=[times[i] for i in at])

    found = over(centres, picks, f"{key}, _range int, cluster long, gap double, id {kinds['id']}, timestamp double")
    best = found.groupBy("video_id", "cluster").agg(F.min(F.struct("gap", "_range", "id", "timestamp")).alias("b"))
    return best.select("video_id", "b.id", "b.timestamp", "cluster")
