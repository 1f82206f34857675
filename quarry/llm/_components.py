"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import dropped, join_heavy, written

#: Rounds after which something must be wrong: each round about halves the longest path.
ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of the links (a, b).

    Alternating large-star and small-star steps: first each node links its larger
    neighbours to its smallest neighbour, then its smaller ones and itself. The
    neighbours of a node are never gathered; the smallest is an aggregate that is
    joined back, and the links of a star's centre are not dealt to one task. Each
    round is a written table, and how its joins are done follows from its rows.
    """
    now = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    state, n = None, now.count()
    for _ in range(ROUNDS):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_heavy(both, least, ["u"], "n", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_heavy(large, low, ["u"], "n", large.count()).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, now = now, written(small.filter("u <> v").distinct(), "links")
        dropped(before, large)
        was, state = state, now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        n = state["n"]
        if state == was or not n:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    found = written(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "components")
    dropped(now)
    return found
