"""Aggregations over the graph: counts, rankings, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.model import SEMANTIC, Graph, tail

from .lookup import cross_refs, dead_exports, orphan_files


def merge_nodes(rows: DataFrame) -> DataFrame:
    """One row per id from rows (id, layer, labels, properties map): labels united, of each property the latest layer's value.

    A property that a later layer has as an explicit null is null; one that it
    lacks keeps the earlier value. Labels are sorted and joined by commas,
    properties come as (id, labels, key, value) rows with a null key for none.
    """
    labels = rows.select("id", F.explode_outer("labels").alias("l")).groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("l")), ",").alias("labels"))
    props = rows.select("id", "layer", F.explode("properties").alias("key", "value")).groupBy("id", "key").agg(F.max_by(F.struct("value"), "layer").alias("v"))
    return labels.join(props.select("id", "key", F.col("v.value").alias("value")), "id", "left")


def first_edges(rows: DataFrame) -> DataFrame:
    """The first edge of each (type, src, dst) by (layer, ord)."""
    others = [c for c in rows.columns if c not in ("type", "src", "dst", "layer", "ord")]
    best = rows.groupBy("type", "src", "dst").agg(F.min_by(F.struct(*others) if others else F.struct(F.lit(1).alias("one")), F.struct("layer", "ord")).alias("e"))
    return best.select("type", "src", "dst", *[F.col(f"e.{c}").alias(c) for c in others])


def import_counts(resolved: DataFrame) -> DataFrame:
    """kind, n over distinct (file, specifier) of resolved specifiers."""
    return resolved.select("file", "specifier", "kind").distinct().groupBy("kind").agg(F.count("*").alias("n"))


def resolution_rate(resolved: DataFrame) -> DataFrame:
    """internal / (internal + unresolved), 1 without either; externals do not count."""
    d = resolved.select("file", "specifier", "kind").distinct()
    inner, bad = F.count_if(F.col("kind") == "internal"), F.count_if(F.col("kind") == "unresolved")
    return d.agg(F.round(F.coalesce(F.try_divide(inner, inner + bad), F.lit(1.0)), 6).alias("rate"))


def domain_weights(g: Graph) -> DataFrame:
    """Imports that cross domains, per ordered pair."""
    of = g.of("BELONGS_TO").select(F.col("src").alias("f"), F.col("dst").alias("d"))
    x, y = of.withColumnsRenamed({"f": "src", "d": "a"}), of.withColumnsRenamed({"f": "dst", "d": "b"})
    return g.of("IMPORTS").select("src", "dst").join(x, "src").join(y, "dst").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def domain_crossings(g: Graph) -> DataFrame:
    """All pairs by weight, with the total weight beside each."""
    pairs = g.of("DEPENDS_ON").select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    total = pairs.agg(F.sum("weight").alias("total"))  # one row
    return pairs.crossJoin(F.broadcast(total)).orderBy(F.desc("weight"), "a", "b")


def domain_dependencies(g: Graph, domain: str) -> DataFrame:
    e = g.of("DEPENDS_ON")
    out = e.filter(F.col("src") == domain).select(F.lit("out").alias("dir"), F.col("dst").alias("other"), "weight")
    return out.unionByName(e.filter(F.col("dst") == domain).select(F.lit("in").alias("dir"), F.col("src").alias("other"), "weight"))


def package_ranking(g: Graph) -> DataFrame:
    imp = g.of("IMPORTS").filter(F.col("dst").startswith("pkg:"))
    return imp.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("files")).orderBy(F.desc("files"), "id")


def packages_for_files(g: Graph, files: DataFrame) -> DataFrame:
    """Files of a set (column id) per external package."""
    imp = g.of("IMPORTS").filter(F.col("dst").startswith("pkg:")).join(files.select(F.col("id").alias("src")), "src", "left_semi")
    return imp.groupBy(tail(F.col("dst")).alias("package")).agg(F.count_distinct("src").alias("files"))


def domain_facts(g: Graph) -> DataFrame:
    """Per domain its files, what it depends on and what depends on it; domains without files too."""
    files = g.of("BELONGS_TO").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("files"))
    out = g.of("DEPENDS_ON").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deps"))
    into = g.of("DEPENDS_ON").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("dependents"))
    joined = g.domains.select("id", "name", "kind").join(files, "id", "left").join(out, "id", "left").join(into, "id", "left")
    return joined.fillna(0, ["files", "deps", "dependents"])


def dead_export_counts(g: Graph) -> DataFrame:
    dead = dead_exports(g, include_entry_points=True).agg(F.count_if(~F.col("held_back")).alias("dead"), F.count_if("held_back").alias("held_back"))
    total = g.symbols.agg(F.count_if("exported").alias("exported"))
    entries = g.files.agg(F.count_if("entry_point").alias("entry_points"))
    return total.crossJoin(dead).crossJoin(entries).withColumn("precise", F.lit("references" in g.layers))  # a row each


def language_histogram(g: Graph) -> DataFrame:
    return g.files.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")


def top_dirs(g: Graph, depth: int = 2) -> DataFrame:
    """Files per leading folders."""
    return g.files.groupBy(F.substring_index("path", "/", depth).alias("dir")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dir")


def biggest_importers(g: Graph) -> DataFrame:
    outside = F.col("dst").startswith("pkg:")
    return g.of("IMPORTS").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.count_if(~outside).alias("internal"), F.count_if(outside).alias("external")).orderBy(F.desc("n"), "id")


def domain_top_files(g: Graph, domain: str, limit: int = 10) -> DataFrame:
    """Files of a domain by distinct importers."""
    members = g.of("BELONGS_TO").filter(F.col("dst") == domain).select(F.col("src").alias("id"))
    n = g.of("IMPORTS").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("importers"))
    return members.join(n, "id").orderBy(F.desc("importers"), "id").limit(limit)


def reference_counts(g: Graph) -> DataFrame:
    """Counts of the references layer, dead ones on base ids (without the ordinals of repeated names)."""
    base = F.regexp_replace("dst", r"~\d+$", "")
    refs = g.of("REFERENCES").agg(F.count_distinct("src").alias("files"), F.count_distinct("dst").alias("symbols"))
    crossed = cross_refs(g).select(base.alias("id")).distinct()
    dead = g.symbols.filter("exported").select(F.regexp_replace("id", r"~\d+$", "").alias("id")).distinct().join(crossed, "id", "left_anti").agg(F.count("*").alias("dead"))
    return refs.crossJoin(dead)  # a row each


def label_counts(g: Graph) -> DataFrame:
    """Nodes per label, and the semantic edges, under the label `edges`."""
    edges = g.of(*SEMANTIC).agg(F.count("*").alias("n")).select(F.lit("edges").alias("label"), "n")
    return g.nodes().groupBy("label").agg(F.count("*").alias("n")).unionByName(edges)


def inventory_counts(g: Graph) -> DataFrame:
    """Files, folders above them, and bytes."""
    from quarry.functions.paths import dir_prefixes

    dirs = g.files.select(F.explode(dir_prefixes(F.col("path"))).alias("d")).agg((F.count_distinct("d") + 1).alias("directories"))
    return g.files.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes")).crossJoin(dirs)  # a row each


def product_map(g: Graph) -> DataFrame:
    """Dependencies between product domains."""
    p = g.domains.filter("kind = 'product'").select("id")
    e = g.of("DEPENDS_ON").join(p.withColumnRenamed("id", "src"), "src", "left_semi").join(p.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.select("src", "dst", "weight").orderBy(F.desc("weight"), "src", "dst")


def most_used_symbols(g: Graph, limit: int = 20) -> DataFrame:
    """By all referencing files, the symbol's own one too."""
    return g.of("REFERENCES").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("files")).orderBy(F.desc("files"), "id").limit(limit)


def most_connected_symbols(g: Graph, limit: int = 20) -> DataFrame:
    u = g.of("USES")
    ends = u.select(F.col("src").alias("id")).unionByName(u.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(limit)


HOOK, COMPONENT = "^use[A-Z]", "^[A-Z][a-z]"  # fixed values


def hooks_and_components(g: Graph) -> DataFrame:
    """what (hook or component), id, name of exported symbols that are named as one."""
    what = F.when(F.col("name").rlike(HOOK), "hook").when(F.col("name").rlike(COMPONENT), "component")
    return g.symbols.filter("exported").select(what.alias("what"), "id", "name").filter("what is not null")


def biggest_domains(g: Graph, limit: int = 10) -> DataFrame:
    return g.of("BELONGS_TO").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "id").limit(limit)


def most_depended_packages(g: Graph, limit: int = 20) -> DataFrame:
    return package_ranking(g).select("id", "files").orderBy(F.desc("files"), "id").limit(limit)


def text_estimate(texts: DataFrame, prompt: str = "text", output_tokens: int = 200) -> DataFrame:
    """What describing all texts would take: items, input tokens, output tokens."""
    from quarry.functions.paths import estimate_tokens

    return texts.agg(F.count("*").alias("items"), F.sum(estimate_tokens(F.col(prompt))).alias("input_tokens"), (F.count("*") * output_tokens).alias("output_tokens"))


def ranked_targets(g: Graph, top: int = 5) -> DataFrame:
    """kind, id, rank, position: per kind the most depended-on domains, imported files and referenced symbols."""
    from .windows import top_per_group

    d = g.of("DEPENDS_ON").groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("score")).select(F.lit("domain").alias("kind"), "id", "score")
    f = g.of("IMPORTS").filter(F.col("dst").startswith("file:")).groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("score")).select(F.lit("file").alias("kind"), "id", "score")
    s = cross_refs(g).groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("score")).select(F.lit("symbol").alias("kind"), "id", "score")
    return top_per_group(d.unionByName(f).unionByName(s), ["kind"], [F.desc("score"), F.asc("id")], top)


def overlay_diagnostics(g: Graph, roots: list[str]) -> DataFrame:
    """Whether configured source roots exist, and whether imports exist without any domain dependency."""
    hit = F.lit(False)
    for r in roots:
        hit = hit | F.col("path").startswith(r.rstrip("/") + "/")
    files = g.files.agg(F.count_if(hit).alias("under_roots"))
    inner = g.of("IMPORTS").agg(F.count_if(F.col("dst").startswith("file:")).alias("internal"))
    deps = g.of("DEPENDS_ON").agg(F.count("*").alias("depends"))
    one = files.crossJoin(inner).crossJoin(deps)  # a row each
    return one.select((F.col("under_roots") == 0).alias("no_root"), ((F.col("internal") > 0) & (F.col("depends") == 0)).alias("no_dependency"))


def health(g: Graph, sample: int = 20) -> DataFrame:
    """Dead exports and orphans: totals, and a sorted sample of each."""
    dead = dead_exports(g).select(F.lit("dead").alias("what"), "id")
    orphan = orphan_files(g).select(F.lit("orphan").alias("what"), "id")
    both = dead.unionByName(orphan)
    totals = both.groupBy("what").agg(F.count("*").alias("total"))  # two rows
    from .windows import top_per_group

    return top_per_group(both, ["what"], [F.asc("id")], sample).join(F.broadcast(totals), "what")
