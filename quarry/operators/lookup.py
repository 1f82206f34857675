"""Lookups of nodes and their neighbours: filters and equi-joins, totally ordered where they rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import is_entry_like, is_linkable, is_test_path, norm_posix
from quarry.model import Graph, domain_id, file_id, kind_of_id, tail


def find_node(g: Graph, query: str, limit: int = 50) -> DataFrame:
    """Nodes whose id, path or name contains the query, case aside; `total` is counted before the limit."""
    if not query:
        raise ValueError("an empty query finds nothing")
    q = query.lower()
    hit = F.lower("id").contains(q) | F.lower(F.coalesce("path", F.lit(""))).contains(q) | F.lower(F.coalesce("name", F.lit(""))).contains(q)
    found = g.nodes().filter(hit)
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("id").limit(limit).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)  # one row


def node_info(g: Graph, node: str) -> DataFrame:
    """Edges of a node by direction and type: how many, and the sorted other ends."""
    out = g.edges.filter(F.col("src") == node).select(F.lit("out").alias("dir"), "type", F.col("dst").alias("other"))
    into = g.edges.filter(F.col("dst") == node).select(F.lit("in").alias("dir"), "type", F.col("src").alias("other"))
    return out.unionByName(into).groupBy("dir", "type").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("other")), ",").alias("others"))


def resolve_node_id(g: Graph, names: DataFrame) -> DataFrame:
    """name -> id: the id itself, else the file of that path, else the domain of that name."""
    options = names.select("name", F.posexplode(F.array(F.col("name"), file_id(norm_posix(F.col("name"))), domain_id(F.col("name")))).alias("rank", "id"))
    hit = options.join(g.nodes().select("id").distinct(), "id")
    best = hit.groupBy("name").agg(F.min_by("id", "rank").alias("id"))
    return names.join(best, "name", "left")


def brief_nodes(g: Graph) -> DataFrame:
    """id, label, title of every node: its path, else its name, else its id."""
    return g.nodes().select("id", "label", F.coalesce("path", "name", "id").alias("title"))


def symbols_of_file(g: Graph, file: str) -> DataFrame:
    """Symbols that a file declares, by line, then id."""
    declared = g.of("DECLARES").filter(F.col("src") == file).select(F.col("dst").alias("id"))
    return g.symbols.join(declared, "id", "left_semi").select("id", "name", "kind", "exported", "line").orderBy("line", "id")


def list_symbols(g: Graph, file: str) -> DataFrame:
    """The same, by id."""
    return symbols_of_file(g, file).orderBy("id")


def orphan_files(g: Graph) -> DataFrame:
    """Linkable files that no file imports, that are neither tests nor like entry points."""
    keep = is_linkable(F.col("path")) & ~is_test_path(F.col("path")) & (F.col("kind") != "test") & ~is_entry_like(F.col("path"))
    return g.files.filter(keep).select("id", "path").join(g.of("IMPORTS").select(F.col("dst").alias("id")), "id", "left_anti")


def dynamic_import_totals(g: Graph) -> DataFrame:
    n = F.coalesce("dynamic_imports", F.lit(0))
    return g.files.agg(F.coalesce(F.sum(n), F.lit(0)).alias("imports"), F.count_if(n > 0).alias("files"))


def neighbors(g: Graph, seeds: DataFrame, direction: str = "both", *types: str) -> DataFrame:
    """seed, type, dir, other for seeds (column id). A self-loop is there twice for `both`."""
    edges = g.of(*types) if types else g.edges
    out = edges.join(seeds, F.col("src") == F.col("id")).select(F.col("id").alias("seed"), "type", F.lit("out").alias("dir"), F.col("dst").alias("other"))
    into = edges.join(seeds, F.col("dst") == F.col("id")).select(F.col("id").alias("seed"), "type", F.lit("in").alias("dir"), F.col("src").alias("other"))
    return {"out": out, "in": into}.get(direction, out.unionByName(into))


def imports_of(g: Graph, file: str) -> DataFrame:
    return g.of("IMPORTS").filter(F.col("src") == file).select("dst", "kind", "specifier").orderBy("dst")


def direct_importers(g: Graph, target: str) -> DataFrame:
    return g.of("IMPORTS").filter(F.col("dst") == target).select("src").distinct().orderBy("src")


def imports_split(g: Graph) -> DataFrame:
    """Per importing file: its internal paths and the names of its external packages, sorted."""
    joined = g.of("IMPORTS").join(g.packages.select(F.col("id").alias("dst"), F.col("name").alias("package")), "dst", "left")
    outside = F.col("dst").startswith("pkg:")
    name = F.coalesce("package", tail(F.col("dst")))
    return joined.groupBy("src").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(~outside, tail(F.col("dst"))))), ",").alias("internal"), F.array_join(F.sort_array(F.collect_set(F.when(outside, name))), ",").alias("external")
    )


def domain_of_file(g: Graph) -> DataFrame:
    """id, domain (its name, else the tail of its id; null without one); the smallest of several."""
    first = g.of("BELONGS_TO").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("dst"))
    named = first.join(g.domains.select(F.col("id").alias("dst"), F.col("name").alias("_name")), "dst", "left").select("id", F.coalesce("_name", tail(F.col("dst"))).alias("domain"))
    return g.files.select("id").join(named, "id", "left")


def files_of_domain(g: Graph, domain: str) -> DataFrame:
    return g.of("BELONGS_TO").filter(F.col("dst") == domain).select(F.col("src").alias("id")).orderBy("id")


def cross_refs(g: Graph, include_same_file: bool = False) -> DataFrame:
    refs = g.of("REFERENCES")
    return refs if include_same_file else refs.filter(~F.coalesce("same_file", F.lit(False)))


def referencing_files(g: Graph, include_same_file: bool = False) -> DataFrame:
    """Per referenced symbol: how many files, and which."""
    return cross_refs(g, include_same_file).groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n"), F.array_join(F.sort_array(F.collect_set("src")), ",").alias("files"))


def dead_exports(g: Graph, *, include_entry_points: bool = False) -> DataFrame:
    """Exported symbols that no other file references: id, path, held_back.

    Those declared or exposed by an entry point are held back unless asked for.
    Without a references layer a symbol is dead if it has no edge but its
    declaration.
    """
    exported = g.symbols.filter("exported").select("id", "path")
    if "references" in g.layers:
        used = cross_refs(g).select(F.col("dst").alias("id"))
    else:
        used = g.edges.filter("type <> 'DECLARES'").select(F.col("dst").alias("id"))
    dead = exported.join(used, "id", "left_anti")
    entries = g.files.filter("entry_point").select(F.col("id").alias("src"))
    declared = g.of("DECLARES").join(entries, "src", "left_semi").select(F.col("dst").alias("id"))
    held = declared.unionByName(g.of("EXPOSES").select(F.col("dst").alias("id"))).distinct().withColumn("held_back", F.lit(True))
    marked = dead.join(held, "id", "left").withColumn("held_back", F.coalesce("held_back", F.lit(False)))
    return marked if include_entry_points else marked.filter("not held_back")


def paths_declaring(g: Graph, names: DataFrame) -> DataFrame:
    """name, path of every symbol of these names; the path out of the id where it is missing."""
    path = F.coalesce("path", F.regexp_extract("id", r"^sym:(.*)#[^#]*$", 1))
    return g.symbols.join(names, "name", "left_semi").select("name", path.alias("path")).distinct()


def path_matches(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """target, path, tier: the exact path (0), else all paths that end in whole segments of the target (1).

    Suffixes are equi-joined: each path is exploded into its own suffixes, so the
    work grows with the paths' depth and not with the number of targets.
    """
    segments = F.split("path", "/")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.array_join(F.slice(segments, k, F.size(segments)), "/")))
    suffixes = paths.select("path", suffix.alias("target"))
    hit = suffixes.join(targets, "target").withColumn("tier", F.when(F.col("path") == F.col("target"), 0).otherwise(1))
    best = hit.groupBy("target").agg(F.min("tier").alias("best"))
    return hit.join(best, "target").filter("tier = best").select("target", "path", "tier").distinct()


def resolve_targets(g: Graph, targets: DataFrame) -> DataFrame:
    """target, tier, id: by id, exact path, domain, path suffix, symbol name; the first tier that has any. Several are ambiguous."""
    t = targets.select("target").distinct()
    by_id = g.nodes().select("id").join(t, F.col("id") == F.col("target")).select("target", F.lit(0).alias("tier"), "id")
    paths = path_matches(g.files.select("path"), t)
    exact = paths.filter("tier = 0").select("target", F.lit(1).alias("tier"), file_id(F.col("path")).alias("id"))
    by_name = g.domains.join(t, F.col("name") == F.col("target")).select("target", F.lit(2).alias("tier"), "id")
    domain = by_name.unionByName(g.domains.join(t.withColumn("id", domain_id(F.col("target"))), "id").select("target", F.lit(2).alias("tier"), "id"))
    suffix = paths.filter("tier = 1").select("target", F.lit(3).alias("tier"), file_id(F.col("path")).alias("id"))
    symbol = g.symbols.join(t, F.col("name") == F.col("target")).select("target", F.lit(4).alias("tier"), "id")
    every = by_id.unionByName(exact).unionByName(domain).unionByName(suffix).unionByName(symbol).distinct()
    first = every.groupBy("target").agg(F.min("tier").alias("first"))
    hits = every.join(first, "target").filter("tier = first").select("target", "tier", "id")
    return t.join(hits, "target", "left")


def file_targets(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """target, status, n: found, ambiguous, not-found, or unsupported for one file that is no JS or TS source."""
    hits = path_matches(paths, targets).groupBy("target").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    source = F.col("path").rlike(r"\.[mc]?[jt]sx?$")
    status = F.when(F.col("n").isNull(), "not-found").when(F.col("n") > 1, "ambiguous").when(source, "found").otherwise("unsupported")
    return targets.join(hits, "target", "left").select("target", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


def describe_targets(g: Graph, targets: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Descriptions of resolved targets: status described, none, ambiguous or not-found."""
    found = resolve_targets(g, targets).groupBy("target").agg(F.count("id").alias("n"), F.min("id").alias("id"))
    joined = found.join(descriptions.select(F.col("target_id").alias("id"), "text"), "id", "left")
    status = F.when(F.col("n") == 0, "not-found").when(F.col("n") > 1, "ambiguous").when(F.col("text").isNull(), "none").otherwise("described")
    return joined.select("target", status.alias("status"), F.when(F.col("n") == 1, F.col("text")).alias("text"))


def suggestions(g: Graph, target: str, limit: int = 8) -> DataFrame:
    """Near misses: ids that contain the target, case aside."""
    return g.nodes().filter(F.lower("id").contains(target.lower())).select("id").orderBy("id").limit(limit)


def exported_symbols(g: Graph) -> DataFrame:
    """Exported symbols with their cross-file references."""
    n = cross_refs(g).groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("refs"))
    return g.symbols.filter("exported").select("id", "path").join(n, "id", "left").select("id", "path", F.coalesce("refs", F.lit(0)).alias("refs"))


def reference_records(g: Graph) -> DataFrame:
    """Cached edges as records; exposures are not among them."""
    return g.of("REFERENCES").select(tail(F.col("src")).alias("from_path"), F.col("dst").alias("sym_id"), "same_file")


def minimal_symbols(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Name and path of every edge's target, out of its id where the node is missing."""
    wanted = edges.select(F.col("dst").alias("id")).distinct()
    path = F.coalesce("path", F.regexp_extract("id", r"^sym:(.*)#[^#]*$", 1))
    name = F.coalesce("name", F.regexp_extract("id", r"#([^#]*)$", 1))
    return wanted.join(symbols.select("id", "path", "name"), "id", "left").select("id", name.alias("name"), path.alias("path"))


def file_hashes(files: DataFrame, texts: DataFrame) -> DataFrame:
    """id, sha256 of files: what the inventory has, else the hash of the text (path, text); null without both."""
    made = texts.select("path", F.sha2("text", 256).alias("made"))
    return files.select("id", "path", "sha256").join(made, "path", "left").select("id", F.coalesce("sha256", "made").alias("sha256"))


def file_briefs(g: Graph) -> DataFrame:
    """Per file its kind, symbols, exported symbols, importers, imports and domain."""
    n = lambda df, key, name: df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))
    links = g.of("IMPORTS").select("src", "dst").distinct()
    declared = g.symbols.groupBy(file_id(F.col("path")).alias("id")).agg(F.count("*").alias("symbols"), F.count_if("exported").alias("exported"))
    out = g.files.select("id", "kind").join(declared, "id", "left").join(n(links, "dst", "importers"), "id", "left").join(n(links, "src", "imports"), "id", "left")
    return out.join(g.of("BELONGS_TO").select(F.col("src").alias("id"), F.col("dst").alias("domain")), "id", "left").fillna(0, ["symbols", "exported", "importers", "imports"])


def symbol_briefs(g: Graph) -> DataFrame:
    """Per symbol its kind, the files that reference it, own references, symbols that use it, and its domain."""
    same = F.coalesce("same_file", F.lit(False))
    refs = g.of("REFERENCES").groupBy(F.col("dst").alias("id")).agg(F.count_distinct(F.when(~same, F.col("src"))).alias("referencing_files"), F.count_distinct(F.when(same, F.col("src"))).alias("own_references"))
    users = g.of("USES").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("users"))
    domain = g.of("BELONGS_TO").select(F.col("src").alias("file"), F.col("dst").alias("domain"))
    out = g.symbols.select("id", "name", "kind", "exported", file_id(F.col("path")).alias("file")).join(refs, "id", "left").join(users, "id", "left").join(domain, "file", "left").drop("file")
    return out.fillna(0, ["referencing_files", "own_references", "users"])
