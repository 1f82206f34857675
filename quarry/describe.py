"""Descriptions: what could be described, with its facts; prompts; and the run that asks a provider.

Targets and facts are DataFrames. Only targets without a fresh description come
to the driver, one prompt at a time, since a provider is asked from there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .model import Graph, file_id, tail
from .operators import lookup
from .operators.answer import estimate
from .operators.incremental import content_hash

FACTS = 8
OUTPUT_TOKENS = 200
SCOPES = {"domains": ("domain",), "files": ("file",), "symbols": ("symbol",), "all": ("domain", "file", "symbol")}


def _firsts(rows: DataFrame, key: str, value, order: list, name: str, most: int = FACTS) -> DataFrame:
    """key and, as `name`, the first `most` values in order."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    ranked = rows.withColumn("k", k).filter(F.col("k") <= most)
    return ranked.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", value.alias("v")))), lambda x: x["v"]).alias(name))


def file_facts(g: Graph) -> DataFrame:
    """id, name, rank, facts, sources of every file."""
    links = g.of("IMPORTS").select("src", "dst").distinct()
    inner, outer = links.filter(F.col("dst").startswith("file:")), links.filter(F.col("dst").startswith("pkg:"))
    n = inner.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("rank"))
    exports = lookup.exported_symbols(g).select(file_id(F.col("path")).alias("file"), F.regexp_extract("id", r"#([^#]*)$", 1).alias("name"), "refs")
    parts = [
        _firsts(inner, "src", tail(F.col("dst")), ["dst"], "internal").withColumnRenamed("src", "id"),
        _firsts(outer, "src", tail(F.col("dst")), ["dst"], "external").withColumnRenamed("src", "id"),
        _firsts(inner, "dst", tail(F.col("src")), ["src"], "importers").withColumnRenamed("dst", "id"),
        _firsts(exports, "file", F.struct("name", "refs"), [F.desc("refs"), "name"], "exports").withColumnRenamed("file", "id"),
        lookup.domain_of_file(g),
        n,
    ]
    out = g.files.select("id", F.col("path").alias("name"), "language", F.col("kind").alias("fileKind"), "sha256")
    for p in parts:
        out = out.join(p, "id", "left")
    empty = F.array().cast("array<string>")
    facts = F.struct(
        F.col("name").alias("path"), "language", "fileKind", "domain", F.struct(F.coalesce("internal", empty).alias("internal"), F.coalesce("external", empty).alias("external")).alias("imports"),
        F.struct(F.coalesce("rank", F.lit(0)).alias("count"), F.coalesce("importers", empty).alias("files")).alias("importedBy"), F.coalesce("exports", F.array().cast("array<struct<name:string,refs:bigint>>")).alias("exports"),
    )
    return out.select("id", "name", F.coalesce("rank", F.lit(0)).alias("rank"), facts.alias("facts"), F.array(F.struct(F.col("name").alias("path"), "sha256")).alias("sources"))


def domain_facts(g: Graph) -> DataFrame:
    """The same of every domain; its sources are all its files."""
    belongs = g.of("BELONGS_TO").select(F.col("src").alias("file"), F.col("dst").alias("id"))
    depends = g.of("DEPENDS_ON").select("src", "dst", "weight")
    weighed = lambda end, other, name: _firsts(depends, end, F.struct(tail(F.col(other)).alias("name"), F.col("weight").alias("n")), [F.desc("weight"), other], name).withColumnRenamed(end, "id")
    links = g.of("IMPORTS").select("src", "dst").distinct()
    packages = links.filter(F.col("dst").startswith("pkg:")).join(belongs, F.col("src") == F.col("file")).groupBy("id", "dst").agg(F.count("*").alias("n"))
    files = links.join(belongs, F.col("dst") == F.col("file")).groupBy("id", "file").agg(F.count("*").alias("n"))
    exports = lookup.exported_symbols(g).select(file_id(F.col("path")).alias("file"), F.regexp_extract("id", r"#([^#]*)$", 1).alias("name"), "refs").join(belongs, "file")
    pair = lambda c: F.struct(tail(F.col(c)).alias("name"), "n")
    parts = [
        weighed("src", "dst", "dependsOn"), weighed("dst", "src", "dependedOnBy"), _firsts(packages, "id", pair("dst"), [F.desc("n"), "dst"], "packages"), _firsts(files, "id", pair("file"), [F.desc("n"), "file"], "topFiles"),
        _firsts(exports, "id", F.struct("name", "refs"), [F.desc("refs"), "name"], "exports"),
        belongs.join(g.files.select(F.col("id").alias("file"), "path", "sha256"), "file").groupBy("id").agg(F.count("*").alias("rank"), F.sort_array(F.collect_list(F.struct("path", "sha256"))).alias("sources")),
    ]
    out = g.domains.select("id", "name", F.col("kind").alias("domainKind"))
    for p in parts:
        out = out.join(p, "id", "left")
    facts = F.struct("name", "domainKind", F.coalesce("rank", F.lit(0)).alias("files"), "dependsOn", "dependedOnBy", "packages", "topFiles", "exports")
    return out.select("id", "name", F.coalesce("rank", F.lit(0)).alias("rank"), facts.alias("facts"), "sources")


def symbol_facts(g: Graph) -> DataFrame:
    """The same of every symbol; its source is its file."""
    refs = lookup.cross_refs(g).select(F.col("dst").alias("id"), "src").distinct()
    uses = g.of("USES").select("src", "dst").distinct()
    short = lambda c: F.regexp_extract(c, r"#([^#]*)$", 1)
    parts = [
        refs.groupBy("id").agg(F.count("*").alias("rank")), _firsts(refs, "id", tail(F.col("src")), ["src"], "files"),
        _firsts(uses.select(F.col("src").alias("id"), short("dst").alias("n")).distinct(), "id", F.col("n"), ["n"], "uses"), _firsts(uses.select(F.col("dst").alias("id"), short("src").alias("n")).distinct(), "id", F.col("n"), ["n"], "usedBy"),
    ]
    out = g.symbols.select("id", "path", "name", F.col("kind").alias("symbolKind"), "line", "exported")
    for p in parts:
        out = out.join(p, "id", "left")
    out = out.join(lookup.domain_of_file(g).select(F.col("id").alias("of"), "domain"), file_id(F.col("path")) == F.col("of"), "left").join(g.files.select("path", "sha256"), "path", "left")
    empty = F.array().cast("array<string>")
    facts = F.struct("name", "symbolKind", "path", "line", "exported", "domain", F.struct(F.coalesce("rank", F.lit(0)).alias("count"), F.coalesce("files", empty).alias("files")).alias("referencedBy"), F.coalesce("uses", empty).alias("uses"), F.coalesce("usedBy", empty).alias("usedBy"))
    return out.select("id", "name", F.coalesce("rank", F.lit(0)).alias("rank"), facts.alias("facts"), F.array(F.struct("path", "sha256")).alias("sources"))


def targets(g: Graph, scope: str = "domains", top: int | None = None) -> DataFrame:
    """kind, id, name, rank, position, facts (JSON), content_hash of all that the scope selects, the first `top` of each kind.

    The hash is of kind, id, facts and the hashes of the sources, so it changes
    when what a description would be made of does.
    """
    makers = {"domain": domain_facts, "file": file_facts, "symbol": symbol_facts}
    out = None
    for kind in SCOPES[scope]:
        rows = makers[kind](g)
        if top:  # the limit is taken in every task first, so the window has `top` rows
            rows = rows.orderBy(F.desc("rank"), "id").limit(top).withColumn("position", F.row_number().over(Window.orderBy(F.desc("rank"), "id")))
        else:
            rows = rows.withColumn("position", F.lit(None).cast("int"))
        whole = F.struct(F.lit(kind).alias("kind"), "id", "facts", "sources")
        shape = rows.select(whole.alias("x")).schema["x"].dataType
        rows = rows.select(F.lit(kind).alias("kind"), "id", "name", "rank", "position", F.to_json("facts").alias("facts"), content_hash(whole, shape).alias("content_hash"))
        out = rows if out is None else out.unionByName(rows)
    return out


INSTRUCTION = """Describe one part of a code base for those who work on it.
Say in one or two sentences of plain prose what it is for and what depends on it.
Use only the facts below; if they do not show a purpose, say that they do not.
Answer with the description alone."""


def prompt(kind: str, name: str, facts: str, outline: str = "") -> str:
    """Facts as lines, lists joined, and the outline if there is one; never a body."""
    def said(v: object) -> str:
        if isinstance(v, dict):
            return ", ".join(f"{k} {said(x)}" for k, x in v.items())
        if isinstance(v, list):
            return ", ".join(said(x) for x in v) or "none"
        return "unknown" if v is None else str(v)

    lines = [INSTRUCTION, "", f"{kind}: {name}", *(f"{k}: {said(v)}" for k, v in json.loads(facts).items())]
    return "\n".join(lines + (["", outline] if outline else []))


def tidy(text: str) -> str:
    flat = " ".join((text or "").split())
    if not flat:
        raise ValueError("an empty description")
    return flat


@dataclass
class Provider:
    """Who is asked: a callable from prompt to text, and how answers are labelled. Nothing here opens a connection."""

    ask: Callable[[str], str]
    model: str = "unknown"
    name: str = "callable"
    #: dollars for a million tokens in and out, if known
    prices: tuple[float, float] | None = None


@dataclass
class Run:
    rows: list[dict] = field(default_factory=list)
    failures: list[dict] = field(default_factory=list)
    tokens: int = 0
    stopped_by: str | None = None
    remaining: int = 0


def price(prompts: Iterable[str], provider: Provider) -> dict:
    """items, input and output tokens, and dollars (null without prices)."""
    sizes = [estimate(p) for p in prompts]
    into, out = sum(sizes), OUTPUT_TOKENS * len(sizes)
    dollars = None if provider.prices is None else round((into * provider.prices[0] + out * provider.prices[1]) / 1e6, 6)
    return {"items": len(sizes), "input_tokens": into, "output_tokens": out, "dollars": dollars}


def run(pending: Iterable[dict], provider: Provider, *, budget_items: int | None = None, budget_tokens: int | None = None, now: str | None = None) -> Run:
    """Ask for each target (kind, id, name, facts, content_hash, outline) in turn. A failure costs its own target alone; a budget stops before it would be passed."""
    done, now = Run(), now or datetime.now(UTC).isoformat()
    pending = list(pending)
    for k, t in enumerate(pending):
        asked = prompt(t["kind"], t["name"], t["facts"], t.get("outline", ""))
        cost = estimate(asked) + OUTPUT_TOKENS
        if budget_items is not None and len(done.rows) >= budget_items:
            done.stopped_by = "items"
        elif budget_tokens is not None and done.tokens + cost > budget_tokens:
            done.stopped_by = "tokens"
        if done.stopped_by:
            done.remaining = len(pending) - k
            break
        try:
            text = tidy(provider.ask(asked))
        except Exception as e:
            done.failures.append({"targetId": t["id"], "error": str(e)})
            continue
        done.tokens += cost
        done.rows.append({"targetId": t["id"], "kind": t["kind"], "contentHash": t["content_hash"], "text": text, "model": provider.model, "provider": provider.name, "generatedAt": now})
    return done


def stale(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Targets without a description (targetId, contentHash) that is of their present hash."""
    fresh = cached.select(F.col("targetId").alias("id"), F.col("contentHash").alias("content_hash"))
    return wanted.join(fresh, ["id", "content_hash"], "left_anti")


def merged(cached: DataFrame, done: DataFrame, g: Graph) -> DataFrame:
    """Cached descriptions with those of a run in place of older ones; what is no longer in the graph goes."""
    from .operators.incremental import upsert

    return upsert(cached, done.select(*cached.columns), "targetId", g.nodes().select(F.col("id").alias("targetId")))
