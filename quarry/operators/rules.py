"""Architecture rules: verdict rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.model import Graph

from .lookup import dead_exports
from .windows import top_per_group


def forbidden_dependencies(g: Graph, rules: DataFrame) -> DataFrame:
    """src, dst, a, b of imports that break a rule (from, to); * stands for any domain. `rules` is a short list by hand."""
    of = g.of("BELONGS_TO").select(F.col("src").alias("f"), F.col("dst").alias("d"))
    crossing = g.of("IMPORTS").select("src", "dst").join(of.withColumnsRenamed({"f": "src", "d": "a"}), "src").join(of.withColumnsRenamed({"f": "dst", "d": "b"}), "dst").filter("a <> b")
    r = rules.select(F.col("from").alias("rf"), F.col("to").alias("rt"))
    hit = ((F.col("rf") == "*") | (F.col("rf") == F.col("a"))) & ((F.col("rt") == "*") | (F.col("rt") == F.col("b")))
    pairs = crossing.select("a", "b").distinct().join(F.broadcast(r), hit, "left_semi")
    return crossing.join(pairs, ["a", "b"], "left_semi").select("src", "dst", "a", "b")


def evaluate(g: Graph, *, forbidden: DataFrame | None = None, max_dead_exports: int | None = None, max_domain_pairs: int | None = None, min_resolution: float | None = None, resolution: DataFrame | None = None, no_cycles: DataFrame | None = None) -> DataFrame:
    """rule, ok, total per configured rule; no rows without rules. A missing resolution rate fails its rule."""
    out: list[DataFrame] = []
    if forbidden is not None:
        out.append(forbidden_dependencies(g, forbidden).agg(F.count("*").alias("total")).select(F.lit("forbidden").alias("rule"), (F.col("total") == 0).alias("ok"), "total"))
    if max_dead_exports is not None:
        out.append(dead_exports(g).agg(F.count("*").alias("total")).select(F.lit("dead_exports").alias("rule"), (F.col("total") <= max_dead_exports).alias("ok"), "total"))
    if max_domain_pairs is not None:
        out.append(g.of("DEPENDS_ON").agg(F.count("*").alias("total")).select(F.lit("domain_pairs").alias("rule"), (F.col("total") <= max_domain_pairs).alias("ok"), "total"))
    if min_resolution is not None and resolution is not None:
        out.append(resolution.select(F.lit("resolution").alias("rule"), F.coalesce(F.col("rate") >= min_resolution, F.lit(False)).alias("ok"), F.lit(0).cast("long").alias("total")))
    if no_cycles is not None:
        out.append(no_cycles.agg(F.count("*").alias("total")).select(F.lit("no_cycles").alias("rule"), (F.col("total") == 0).alias("ok"), "total"))
    if not out:
        return g.edges.sparkSession.createDataFrame([], "rule string, ok boolean, total long")
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def offenders(g: Graph, *, forbidden: DataFrame | None = None, dead: bool = False, pairs: bool = False, cycles: DataFrame | None = None, most: int = 20) -> DataFrame:
    """rule, offender, position, total: what breaks each rule, the first `most` in order, and how many there are."""
    parts: list[DataFrame] = []
    arrow = lambda a, b: F.concat(a, F.lit(" -> "), b).alias("offender")
    if forbidden is not None:
        parts.append(forbidden_dependencies(g, forbidden).select(F.lit("forbidden").alias("rule"), arrow(F.col("src"), F.col("dst"))))
    if dead:
        parts.append(dead_exports(g).select(F.lit("dead_exports").alias("rule"), F.col("id").alias("offender")))
    if pairs:
        parts.append(g.of("DEPENDS_ON").select(F.lit("domain_pairs").alias("rule"), arrow(F.col("src"), F.col("dst"))))
    if cycles is not None:
        parts.append(cycles.select(F.lit("no_cycles").alias("rule"), F.col("ring").alias("offender")))
    if not parts:
        return g.edges.sparkSession.createDataFrame([], "rule string, offender string, position int, total long")
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    totals = rows.groupBy("rule").agg(F.count("*").alias("total"))  # a row per rule
    return top_per_group(rows, ["rule"], [F.asc("offender")], most).join(F.broadcast(totals), "rule")


def check(g: Graph, rules: dict, *, forbidden: DataFrame | None = None, resolution: DataFrame | None = None, cycles: DataFrame | None = None, most: int = 20) -> dict:
    """The whole answer: configured, ok, problems, and per rule ok, total, detail and the first offenders.

    `rules` has the limits by name (see PREREQUISITES). Without rules nothing is
    configured and nothing fails; unknown rules and missing layers are problems.
    """
    unknown = unknown_rules(set(rules))
    if not rules:
        return {"configured": False, "ok": True, "rules": [], "problems": []}
    missing = missing_prerequisites(set(rules), g.layers)
    usable = {r for r in rules if r not in unknown and r not in missing}
    verdicts = evaluate(
        g, forbidden=forbidden if "forbidden" in usable else None, max_dead_exports=rules["dead_exports"] if "dead_exports" in usable else None, max_domain_pairs=rules["domain_pairs"] if "domain_pairs" in usable else None,
        min_resolution=rules["resolution"] if "resolution" in usable else None, resolution=resolution, no_cycles=cycles if "no_cycles" in usable else None,
    )
    bad = offenders(g, forbidden=forbidden if "forbidden" in usable else None, dead="dead_exports" in usable, pairs="domain_pairs" in usable, cycles=cycles if "no_cycles" in usable else None, most=most)
    listed: dict[str, list[str]] = {}
    for r in bad.orderBy("rule", "position").collect():  # `most` a rule
        listed.setdefault(r["rule"], []).append(r["offender"])
    out = []
    for v in sorted(verdicts.collect(), key=lambda v: v["rule"]):
        limit = rules.get(v["rule"])
        detail = f"{v['total']} found" + (f", {limit} allowed" if isinstance(limit, (int, float)) and not isinstance(limit, bool) else "")
        out.append({"rule": v["rule"], "ok": v["ok"], "total": v["total"], "detail": detail, "offenders": [] if v["ok"] else listed.get(v["rule"], [])})
    problems = [f"unknown rule: {r}" for r in unknown] + [f"{r} needs layers: {', '.join(sorted(m))}" for r, m in sorted(missing.items())]
    return {"configured": True, "ok": not problems and all(r["ok"] for r in out), "rules": out, "problems": problems}


#: Layers that each rule needs.
PREREQUISITES = {"forbidden": {"imports", "domains"}, "dead_exports": {"symbols", "references"}, "domain_pairs": {"domains"}, "resolution": {"imports"}, "no_cycles": {"imports"}}


def missing_prerequisites(rules: set[str], layers: frozenset[str]) -> dict[str, set[str]]:
    return {r: PREREQUISITES[r] - layers for r in rules if r in PREREQUISITES and PREREQUISITES[r] - layers}


def unknown_rules(rules: set[str]) -> list[str]:
    return sorted(rules - PREREQUISITES.keys())
