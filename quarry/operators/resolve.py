"""Specifiers to files: candidate joins, longest prefixes, and the order in which stages claim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import dir_name, is_relative, kebab, package_name, resolve_path

# A runtime extension and what its source may have, in order; then what a bare path may have.
RUNTIME = {".mjs": (".mts", ".d.mts", ".mjs"), ".cjs": (".cts", ".d.cts", ".cjs"), ".jsx": (".tsx", ".d.ts", ".jsx"), ".js": (".ts", ".tsx", ".d.ts", ".js", ".jsx")}
EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".d.ts", ".d.mts", ".d.cts", ".js", ".jsx", ".mjs", ".cjs")


def candidates(base):
    """Paths that a base may stand for, best first: its sources by runtime extension, or itself, with an extension, as a folder's index."""
    plain = F.array(base, *[F.concat(base, F.lit(e)) for e in EXTENSIONS], *[F.concat(base, F.lit(f"/index{e}")) for e in EXTENSIONS])
    out = F.when(F.lit(False), plain)
    for ext, sources in RUNTIME.items():
        bare = F.left(base, F.length(base) - len(ext))
        out = out.when(F.lower(base).endswith(ext), F.array(*[F.concat(bare, F.lit(e)) for e in sources]))
    return out.otherwise(plain)


def match_source(bases: DataFrame, files: DataFrame) -> DataFrame:
    """base -> path of the first candidate that is a file (column path); bases without one are left out."""
    options = bases.select("base").distinct().select("base", F.posexplode(candidates(F.col("base"))).alias("pos", "path"))
    return options.join(files.select("path"), "path").groupBy("base").agg(F.min_by("path", "pos").alias("path"))


def alias_substitutions(specifiers: DataFrame, patterns: DataFrame) -> DataFrame:
    """specifier, base, ord: the substitutions of the best matching pattern, in order.

    `patterns` has pattern, ord and targets (array) and is configuration of a few
    rows, so it is sent to all tasks. An exact pattern scores its length and one,
    one with * the length before it; of equals the first in order wins.
    """
    p = patterns.select("pattern", "ord", "targets").withColumn("head", F.substring_index("pattern", "*", 1)).withColumn("wild", F.col("pattern").contains("*"))
    p = p.withColumn("rest", F.when(F.col("wild"), F.expr("substring(pattern, length(head) + 2)")).otherwise(""))
    fits = F.when(F.col("wild"), F.col("specifier").startswith(F.col("head")) & F.col("specifier").endswith(F.col("rest")) & (F.length("specifier") >= F.length("head") + F.length("rest"))).otherwise(F.col("specifier") == F.col("pattern"))
    score = F.when(F.col("wild"), F.length("head")).otherwise(F.length("pattern") + 1)
    hit = specifiers.select("specifier").distinct().join(F.broadcast(p), fits)
    best = hit.groupBy("specifier").agg(F.max_by(F.struct("head", "rest", "wild", "targets"), F.struct(score, -F.col("ord"))).alias("b"))
    star = F.expr("substring(specifier, length(b.head) + 1, length(specifier) - length(b.head) - length(b.rest))")
    return best.select("specifier", star.alias("star"), F.posexplode("b.targets").alias("ord", "t")).select("specifier", F.replace("t", F.lit("*"), "star").alias("base"), "ord")


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path, root: the longest root (column root) that a path is under; null without one.

    A path's own prefixes are joined with the roots, so any number of roots is an
    equi-join.
    """
    parts = F.split("path", "/")
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    hit = paths.select("path", prefix.alias("root")).filter("root <> path").join(roots.select("root").distinct(), "root")
    best = hit.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.select("path").join(best, "path", "left")


def segment_after_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path, segment: the first segment under the longest root, null for none."""
    return longest_prefix(paths, roots).select("path", F.expr("split(substring(path, length(root) + 2), '/')[0]").alias("segment"))


def assign_domains(paths: DataFrame, roots: DataFrame, aliases: DataFrame, buckets: DataFrame, known: DataFrame) -> DataFrame:
    """path -> domain: an alias of its segment, else the segment in kebab case if known, else the first bucket (prefix, domain, ord) it is under, else unassigned."""
    seg = segment_after_root(paths, roots)
    a = aliases.select(F.col("alias").alias("segment"), F.col("domain").alias("by_alias"))
    k = known.select(F.col("domain").alias("by_name"))
    parts = F.split("path", "/")
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    b = paths.select("path", prefix.alias("prefix")).join(buckets, "prefix").groupBy("path").agg(F.min_by("domain", "ord").alias("by_bucket"))
    joined = seg.join(a, "segment", "left").join(k, kebab(F.col("segment")) == F.col("by_name"), "left").join(b, "path", "left")
    return joined.select("path", F.coalesce("by_alias", "by_name", "by_bucket", F.lit("unassigned")).alias("domain"))


def match_generated(bases: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """base -> source path of a built file, within the nearest package (column root) that holds it."""
    from quarry.functions.paths import source_variants

    owned = longest_prefix(bases.select(F.col("base").alias("path")).distinct(), packages).filter("root is not null").select(F.col("path").alias("base"), "root")
    inside = owned.select("base", "root", F.posexplode(source_variants(F.col("base"), F.col("root"))).alias("pos", "full")).filter("pos > 0")
    options = inside.select("base", "pos", "full")
    hit = match_source(options.select(F.col("full").alias("base")), files).withColumnRenamed("base", "full")
    return options.join(hit, "full").groupBy("base").agg(F.min_by("path", "pos").alias("path"))


def _package_bases(specs: DataFrame, workspaces: DataFrame) -> DataFrame:
    """file, specifier, ord, base: where specifiers of workspace packages may lead, by the manifests' targets, then in the usual places."""
    from quarry.sources.workspaces import alias_targets

    known = workspaces.select("name", "dir", *[(F.col(c) if c in workspaces.columns else F.lit(None).cast(t)).alias(c) for c, t in (("entries", "array<string>"), ("subpaths", "map<string,array<string>>"))])
    known = known.withColumn("entries", F.coalesce("entries", F.array().cast("array<string>")))
    targets = alias_targets(known)
    rows = specs.join(known.select(F.col("name").alias("package"), "dir"), "package")
    exact = rows.join(targets.withColumnRenamed("pattern", "specifier"), "specifier").select("file", "specifier", "ord", "base")
    sub = F.expr("substring(specifier, length(package) + 2)")
    deep = rows.filter(sub != "").join(targets.filter(~F.col("pattern").endswith("/*")).select(F.col("pattern").alias("specifier")).distinct(), "specifier", "left_anti")
    wild = deep.select("file", "specifier", F.posexplode(F.array(F.concat("dir", F.lit("/src/"), sub), F.concat("dir", F.lit("/"), sub))).alias("ord", "base"))
    return exact.unionByName(wild)


def resolve_specifiers(specs: DataFrame, files: DataFrame, patterns: DataFrame, workspaces: DataFrame, packages: DataFrame) -> DataFrame:
    """file, specifier, kind, target of every (file, specifier).

    The first stage that claims a specifier decides, found or not: relative,
    alias, absolute (never found), workspace package, external. `workspaces` has
    name and dir, and entries, subpaths if the manifests are known.
    """
    s = specs.select("file", "specifier").distinct()
    rel = s.filter(is_relative(F.col("specifier"))).withColumn("base", resolve_path(F.when(dir_name(F.col("file")) == ".", "").otherwise(dir_name(F.col("file"))), F.col("specifier")))
    direct = match_source(rel, files)
    built = match_generated(rel.join(direct, "base", "left_anti"), files, packages)
    rel_out = rel.join(direct.unionByName(built), "base", "left").select("file", "specifier", F.when(F.col("path").isNull(), "unresolved").otherwise("internal").alias("kind"), F.col("path").alias("target"))

    rest = s.filter(~is_relative(F.col("specifier")))
    subs = alias_substitutions(rest, patterns)
    found = subs.join(match_source(subs, files), "base", "left").groupBy("specifier").agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.col("ord"))).alias("path"))
    al_out = rest.join(found, "specifier").select("file", "specifier", F.when(F.col("path").isNull(), "unresolved").otherwise("internal").alias("kind"), F.col("path").alias("target"))
    rest = rest.join(found.select("specifier"), "specifier", "left_anti")

    absolute = rest.filter(F.col("specifier").startswith("/"))
    ab_out = absolute.select("file", "specifier", F.lit("unresolved").alias("kind"), F.lit(None).cast("string").alias("target"))
    rest = rest.filter(~F.col("specifier").startswith("/")).withColumn("package", package_name(F.col("specifier")))
    bases = _package_bases(rest, workspaces)
    ws_hit = bases.join(match_source(bases, files), "base", "left").groupBy("file", "specifier").agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.col("ord"))).alias("path"))
    ws_out = ws_hit.select("file", "specifier", F.when(F.col("path").isNull(), "unresolved").otherwise("internal").alias("kind"), F.col("path").alias("target"))
    ex = rest.join(workspaces.select(F.col("name").alias("package")), "package", "left_anti")
    ex_out = ex.select("file", "specifier", F.lit("external").alias("kind"), F.concat(F.lit("pkg:"), "package").alias("target"))
    return rel_out.unionByName(al_out).unionByName(ab_out).unionByName(ws_out).unionByName(ex_out)


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: ** spans folders, * and ? stay within one."""
    import re

    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif glob[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + re.escape(glob[k]), k + 1
    return f"^{out}$"


def entry_points(files: DataFrame, globs: list[str], targets: DataFrame) -> DataFrame:
    """path, reason: files of configured globs first, then what manifests point to (base, reason); the first reason stays."""
    hits = None
    for k, g in enumerate(globs):
        h = files.filter(F.col("path").rlike(glob_pattern(g))).select("path", F.lit(k).alias("prio"), F.lit(f"config:{g}").alias("reason"))
        hits = h if hits is None else hits.unionByName(h)
    m = targets.join(match_source(targets, files), "base").select("path", F.lit(len(globs)).alias("prio"), "reason")
    every = m if hits is None else hits.unionByName(m)
    return every.groupBy("path").agg(F.min(F.struct("prio", "reason")).alias("m")).select("path", F.col("m.reason").alias("reason"))
