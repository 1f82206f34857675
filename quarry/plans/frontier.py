"""Iterative traversals as joins of a frontier with the edges.

Each level is one equi-join, an anti-join with what has been reached, and one
written table in the shared checkpoint folder, so lineage stays short and a lost
executor costs a read. The job that writes a level also counts it; nothing else
comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .shared import dropped, written

MAX_DEPTH = 25


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder."""
    return written(df, "level")


def counted(df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
    """The same, with its number of rows (of those for which `what` holds), by one job."""
    seen = Observation()
    out = checkpointed(df.observe(seen, (F.count(F.lit(1)) if what is None else F.count_if(what)).alias("n")))
    return out, seen.get["n"]


def reach(seeds: DataFrame, edges: DataFrame, *, max_depth: int | None = MAX_DEPTH) -> DataFrame:
    """node, depth of all that the seeds reach along (src, dst), first-reached depth; seeds have depth 0.

    `seeds` has a column node. Without max_depth it runs until nothing is new.
    """
    steps = edges.select("src", "dst").distinct().persist()
    seen = checkpointed(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front, depth, levels = seen.select("node"), 0, [seen]
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = front.join(steps, front["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct()
        new, n = counted(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not n:
            break
        seen = seen.unionByName(new)
        levels.append(new)
        if depth % 8 == 0:
            seen = checkpointed(seen)
            dropped(*levels[:-1])
            levels = [new, seen]
        front = new.select("node")
    steps.unpersist()
    return seen
