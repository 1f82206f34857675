"""Circular dependencies: strongly connected components and a shortest ring in each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.model import Graph
from quarry.plans.frontier import checkpointed, counted
from quarry.plans.shared import dropped


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose ends both have an edge in and an edge out, again and again: the rest is in no ring."""
    now, n = counted(edges)
    while n:
        both = now.select(F.col("src").alias("v")).distinct().join(now.select(F.col("dst").alias("v")).distinct(), "v", "left_semi")
        nxt = now.join(both.withColumnRenamed("v", "src"), "src", "left_semi").join(both.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst")
        before = now
        now, m = counted(nxt)
        dropped(before)
        if m == n:
            break
        n = m
    return now


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of a component of two or more.

    Colouring: after trimming, the smallest label spreads forward until it settles;
    whoever reaches its colour's root within the colour is in the root's component,
    and leaves. What reaches a node's colour reaches the node, so each round also
    takes the colour of the colour, and a chain of n nodes settles in some log n
    rounds. Each round takes a component per colour, so rounds are few where
    components are.
    """
    work = checkpointed(edges.filter("src <> dst").select("src", "dst").distinct())
    out = None
    while True:
        work = _trimmed(work)
        if work.isEmpty():
            break
        colour = checkpointed(work.select(F.col("src").alias("v")).unionByName(work.select(F.col("dst").alias("v"))).distinct().withColumn("c", F.col("v")))
        while True:  # the smallest node that reaches v
            step = work.join(colour.withColumnsRenamed({"v": "src", "c": "cc"}), "src").groupBy(F.col("dst").alias("v")).agg(F.min("cc").alias("m"))
            further = colour.select(F.col("v").alias("c"), F.col("c").alias("cc"))
            joined = colour.join(step, "v", "left").join(further, "c", "left").select("v", F.col("c").alias("was"), F.least("c", "m", "cc").alias("c"))
            nxt, moved = counted(joined, F.col("c") < F.col("was"))
            colour = nxt.select("v", "c")
            if not moved:
                break
        inner = work.join(colour.withColumnsRenamed({"v": "src", "c": "c1"}), "src").join(colour.withColumnsRenamed({"v": "dst", "c": "c2"}), "dst").filter("c1 = c2").select(F.col("dst").alias("from"), F.col("src").alias("to"), F.col("c1").alias("c"))
        inner = checkpointed(inner)
        got = checkpointed(colour.filter("v = c"))
        front = got
        while True:  # backwards from each root within its colour
            new = front.withColumnRenamed("v", "from").join(inner, ["from", "c"]).select(F.col("to").alias("v"), "c").distinct().join(got, ["v", "c"], "left_anti")
            front, n = counted(new)
            if not n:
                break
            got = checkpointed(got.unionByName(front))
        out = got if out is None else out.unionByName(got)
        work = checkpointed(work.join(got.select(F.col("v").alias("src")), "src", "left_anti").join(got.select(F.col("v").alias("dst")), "dst", "left_anti"))
    if out is None:
        return edges.sparkSession.createDataFrame([], "node string, component string")
    big = out.groupBy("c").agg(F.count("*").alias("n"), F.min("v").alias("component")).filter("n > 1")
    return out.join(big, "c").select(F.col("v").alias("node"), "component")


def shortest_rings(edges: DataFrame, components: DataFrame) -> DataFrame:
    """component, length, ring: per component the shortest ring through its smallest node, the lexicographically smallest of several.

    Paths grow from all smallest nodes at once; per (component, node) only the
    smallest path of the fewest steps is kept, so what a level holds is bounded
    by the nodes.
    """
    inner = edges.filter("src <> dst").select("src", "dst").distinct()
    inner = inner.join(components.withColumnsRenamed({"node": "src"}), "src").join(components.withColumnsRenamed({"node": "dst", "component": "c2"}), "dst").filter("component = c2").select("component", "src", "dst")
    inner = checkpointed(inner)
    front = checkpointed(components.select("component").distinct().select("component", F.col("component").alias("node"), F.array("component").alias("path")))
    seen, done = front.select("component", "node"), None
    while True:
        step = front.withColumnRenamed("node", "src").join(inner, ["component", "src"]).select("component", F.col("dst").alias("node"), "path")
        closing = step.filter("node = component").groupBy("component").agg(F.min("path").alias("ring"))
        closing = checkpointed(closing)
        done = closing if done is None else done.unionByName(closing)
        new = step.join(done.select("component"), "component", "left_anti").join(seen, ["component", "node"], "left_anti").groupBy("component", "node").agg(F.min("path").alias("p"))
        front, n = counted(new.select("component", "node", F.concat("p", F.array("node")).alias("path")))
        if not n:
            break
        seen = checkpointed(seen.unionByName(front.select("component", "node")))
    return done.select("component", F.size("ring").alias("length"), F.array_join("ring", ",").alias("ring"))


def find_cycles(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """component, size, length, ring; with weights also min_weight and total_weight of the ring's hops.

    Self-loops make no cycle; `self_loops` lists them.
    """
    plain = edges.select("src", "dst")
    comps = checkpointed(strong_components(plain))
    sizes = comps.groupBy("component").agg(F.count("*").alias("size"))
    rings = shortest_rings(plain, comps).join(sizes, "component").select("component", "size", "length", "ring")
    if weight is None:
        return rings
    nodes = F.split("ring", ",")
    hops = rings.select("component", F.explode(F.transform(F.sequence(F.lit(0), F.size(nodes) - 1), lambda k: F.struct(F.get(nodes, k).alias("src"), F.get(nodes, (k + 1) % F.size(nodes)).alias("dst")))).alias("h")).select("component", "h.src", "h.dst")
    w = edges.groupBy("src", "dst").agg(F.max(weight).alias("w"))
    summed = hops.join(w, ["src", "dst"]).groupBy("component").agg(F.min("w").alias("min_weight"), F.sum("w").alias("total_weight"))
    return rings.join(summed, "component")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src = dst").select(F.col("src").alias("node")).distinct()


def file_cycles(g: Graph) -> DataFrame:
    return find_cycles(g.of("IMPORTS").filter(F.col("dst").startswith("file:")).select("src", "dst"))


def domain_cycles(g: Graph) -> DataFrame:
    return find_cycles(g.of("DEPENDS_ON").select("src", "dst", "weight"), "weight")
