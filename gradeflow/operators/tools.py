"""Tools: what each needs, transitively, and a registry that runs the selected ones category by category."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .evidence import route_tools

def closure_of(needs: DataFrame) -> DataFrame:
    """(tool, ord, needed): everything that each tool needs, directly or through others, once, in the order of a depth-first walk: needs before what needs them.

    ``needs`` (tool, ord, needed) are the direct ones; null ones and repeats are ignored, equal places go by
    the needed tool. Round by round come the tools whose needs are settled: such a tool's list is those of its needs, each with
    the need after it, one after another, of repeats the first. So a list is made once, from the lists of the
    direct needs only. A tool that needs itself is an error.
    """
    left = edges = written(needs.filter("tool is not null and needed is not null").groupBy("tool", "needed").agg(F.min("ord").cast("int").alias("ord")), "needs")
    none, lists = F.array().cast(f"array<{dict(edges.dtypes)['needed']}>"), []
    while not left.isEmpty():
        waiting = left.select("tool").distinct()
        blocked = left.join(waiting.withColumnRenamed("tool", "needed"), "needed", "left_semi").select("tool").distinct()
        ready = written(waiting.join(blocked, "tool", "left_anti"), "ready")
        if ready.isEmpty():
            raise ValueError(f"tools that need themselves: {', '.join(circle(left))}")
        mine = left.join(ready, "tool", "left_semi").withColumn("_list", F.array("needed"))
        if lists:
            below = reduce(DataFrame.union, lists).select(F.col("tool").alias("needed"), F.col("list").alias("_below"))
            mine = mine.join(below, "needed", "left").withColumn("_list", F.array_append(F.coalesce("_below", none), F.col("needed")))
        parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "needed", "_list"))), lambda x: x["_list"])
        lists.append(written(mine.groupBy("tool").agg(F.array_distinct(F.flatten(parts)).alias("list")), "lists"))
        left = written(left.join(ready, "tool", "left_anti"), "left")
    if not lists:
        return edges.select("tool", "ord", "needed")
    return reduce(DataFrame.union, lists).select("tool", F.posexplode("list").alias("ord", "needed"))


def circle(edges: DataFrame) -> list[str]:
    """Up to five tools of the shortest circles of ``edges`` (tool, needed), of which there is one."""
    known = edges.select(F.col("tool").alias("root"), F.col("needed").alias("node"))
    while True:
        found = sorted(str(r["root"]) for r in known.filter("root = node").limit(5).collect())
        if found:
            return found
        known = written(known.join(edges, F.col("node") == F.col("tool")).select("root", F.col("needed").alias("node")).distinct(), "circles")


class Registry:
    """Tools by category. A category's function gives the hits (plan_id, ...) of plans (plan_id); a tool's function makes rows (plan_id, item_no, item) of its category's hits."""

    def __init__(self) -> None:
        self.retrieve: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.work: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {}

    def category(self, name: str) -> Callable:
        def put(f: Callable[[DataFrame], DataFrame]) -> Callable:
            self.retrieve[name] = f
            return f

        return put

    def tool(self, name: str, category: str) -> Callable:
        if category not in self.retrieve:
            raise ValueError(f"no category {category}")

        def put(f: Callable[[DataFrame], DataFrame]) -> Callable:
            self.work[name] = category, f
            return f

        return put

    def run(self, selected: DataFrame) -> DataFrame:
        """(plan_id, step, tool, category, item_no, item) for selected tools (plan_id, step, tool).

        One plan a category: its hits are retrieved once for each of its plans, written, and read by
        each of its tools. Tools that aren't registered give nothing.
        """
        spark = selected.sparkSession
        names = spark.createDataFrame([(t, c) for t, (c, _) in self.work.items()], "tool string, category string")
        routed = written(route_tools(selected, names).select("plan_id", "step", "tool", "category"), "routed")
        parts = [routed.limit(0).select("*", F.lit(None).cast("int").alias("item_no"), F.lit(None).cast("string").alias("item"))]
        for category, retrieve in self.retrieve.items():
            mine = routed.filter(F.col("category") == category)
            hits = written(retrieve(mine.select("plan_id").distinct()), "hits")
            for tool, (of, work) in self.work.items():
                if of == category:
                    parts.append(mine.filter(F.col("tool") == tool).join(work(hits).select("plan_id", "item_no", "item"), "plan_id").select("plan_id", "step", "tool", "category", "item_no", "item"))
        return reduce(DataFrame.unionByName, parts)
