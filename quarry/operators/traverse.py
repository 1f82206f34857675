"""Transitive closures, shortest paths and change impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.model import Graph, file_id
from quarry.plans.frontier import MAX_DEPTH, checkpointed, reach

from .lookup import cross_refs


def reversed_imports(g: Graph) -> DataFrame:
    return g.of("IMPORTS").filter(F.col("dst").startswith("file:")).select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def transitive_importers(g: Graph, seeds: DataFrame, max_depth: int | None = MAX_DEPTH) -> DataFrame:
    """node, depth of all files that import a seed (column node), directly or not; the seeds are not among them."""
    return reach(seeds, reversed_imports(g), max_depth=max_depth).filter("depth > 0")


def impact_of(g: Graph, file: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The same of one file, with whether the cap of depth was met."""
    seeds = g.edges.sparkSession.createDataFrame([(file,)], "node string")
    found = transitive_importers(g, seeds, max_depth)
    top = found.agg((F.coalesce(F.max("depth"), F.lit(0)) >= max_depth).alias("depth_cap_reached"))  # one row
    return found.crossJoin(F.broadcast(top))


def affected_files(g: Graph, changed: DataFrame) -> DataFrame:
    """node: the changed files and all that import them, to any depth."""
    return reach(changed, reversed_imports(g), max_depth=None).select("node")


def shortest_path(edges: DataFrame, start: str, goal: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """hop, node of the shortest directed path; of several the lexicographically smallest. No rows if there is none.

    First the goal's distances backwards; then one walk from the start, by the
    smallest next node that is one closer. Both are joins per level.
    """
    spark = edges.sparkSession
    back = reach(spark.createDataFrame([(goal,)], "node string"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), max_depth=max_depth)
    far = back.filter(F.col("node") == start).select("depth").first()
    if far is None:
        return spark.createDataFrame([], "hop int, node string")
    path = [start]  # at most max_depth + 1 nodes
    for left in range(far["depth"] - 1, -1, -1):
        step = edges.filter(F.col("src") == path[-1]).select(F.col("dst").alias("node")).join(back.filter(F.col("depth") == left), "node", "left_semi")
        path.append(step.agg(F.min("node")).first()[0])
    return spark.createDataFrame(list(enumerate(path)), "hop int, node string")


def known_and_unknown(g: Graph, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (path) that are files of the graph, with their ids as node, and the others."""
    ids = paths.select("path", file_id(F.col("path")).alias("node"))
    of = g.files.select(F.col("id").alias("node"))
    return ids.join(of, "node", "left_semi"), ids.join(of, "node", "left_anti")


def build_impact(g: Graph, changed: DataFrame, max_depth: int = MAX_DEPTH) -> dict[str, DataFrame]:
    """Sections of an impact answer for changed paths (column path)."""
    known, unknown = known_and_unknown(g, changed)
    radius = checkpointed(transitive_importers(g, known, max_depth))
    touched = known.select("node").unionByName(radius.select("node")).distinct()
    of = g.of("BELONGS_TO").select(F.col("src").alias("node"), F.col("dst").alias("domain"))
    domains = touched.join(of, "node").groupBy("domain").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "domain")
    exported = g.symbols.filter("exported").select(F.col("id").alias("sym"), file_id(F.col("path")).alias("node"))
    refs = cross_refs(g).groupBy(F.col("dst").alias("sym")).agg(F.count_distinct("src").alias("refs"))
    risky = exported.join(known.select("node"), "node", "left_semi").join(refs, "sym").select("sym", "refs").orderBy(F.desc("refs"), "sym")
    tests = touched.join(g.files.filter("kind = 'test'").select(F.col("id").alias("node")), "node", "left_semi").orderBy("node")
    return {"known": known.select("path"), "unknown": unknown.select("path"), "radius": radius, "domains": domains, "risky_exports": risky, "tests": tests}


def entry_reachable(reexports: DataFrame, declared: DataFrame, entries: DataFrame, max_hops: int | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """sym, entry, hops: symbols that entry points expose through re-exports.

    `reexports` has path, target, kind (named, star or namespace), exported,
    declared; `declared` path, name, sym; `entries` path; `aliases` path, exported,
    declared of local export lists. A state is (entry, file, wanted name), where *
    wants all. A name that a file declares itself, or has as an alias of what it
    declares, hides what it re-exports under that name. A namespace that is wanted
    exposes all of its target. Of several entries the first in order counts, then the fewest hops.
    Without max_hops it runs until no state is new.
    """
    local = checkpointed(declared.select("path", "name", "sym"))  # once, not once a level
    reexports = checkpointed(reexports.select("path", "target", "kind", "exported", "declared"))
    named, star, space = (reexports.filter(F.col("kind") == k) for k in ("named", "star", "namespace"))
    if aliases is not None:
        aliases = checkpointed(aliases.select("path", F.col("exported").alias("want"), F.col("declared").alias("meant")))

    def meant(states: DataFrame) -> DataFrame:
        """With name, what the wanted name is declared as."""
        if aliases is None:
            return states.withColumn("name", F.col("want"))
        return states.join(aliases, ["path", "want"], "left").withColumn("name", F.coalesce("meant", "want")).drop("meant")

    state = checkpointed(entries.select(F.col("path").alias("entry"), "path").distinct().withColumn("want", F.lit("*")).withColumn("hops", F.lit(0)))
    seen = state
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        front = meant(state).join(local.select("path", "name"), ["path", "name"], "left_anti").select("entry", "path", "want")
        asked = (F.col("want") == "*") | (F.col("want") == F.col("exported"))
        n = front.join(named, "path").filter(asked).select("entry", F.col("target").alias("path"), F.col("declared").alias("want"))
        s = front.join(star, "path").select("entry", F.col("target").alias("path"), "want")
        a = front.join(space, "path").filter(asked).select("entry", F.col("target").alias("path"), F.lit("*").alias("want"))
        new = n.unionByName(s).unionByName(a).distinct().join(seen.select("entry", "path", "want"), ["entry", "path", "want"], "left_anti").withColumn("hops", F.lit(hop))
        state = checkpointed(new.select("entry", "path", "want", "hops"))
        if not state.limit(1).count():
            break
        seen = seen.unionByName(state)
        if hop % 8 == 0:
            seen = checkpointed(seen)
    hit = meant(seen).withColumnRenamed("name", "own").join(local, "path").filter((F.col("want") == "*") | (F.col("own") == F.col("name")))
    return hit.groupBy("sym").agg(F.min(F.struct("entry", "hops")).alias("m")).select("sym", F.col("m.entry").alias("entry"), F.col("m.hops").alias("hops"))
