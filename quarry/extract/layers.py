"""Layers of the graph from source texts: (path, text) in, rows out, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.windows import ordinal_ids
from quarry.plans.frontier import checkpointed, counted

from . import modules


def _per_file(sources: DataFrame, make: Callable[[str, str], Iterable[tuple]], ddl: str, schema: pa.Schema) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [r for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in make(path, text or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return sources.select("path", "text").mapInArrow(run, ddl)


S, L, B = pa.string(), pa.int64(), pa.bool_()


def specifier_rows(sources: DataFrame) -> DataFrame:
    """path, ord, specifier."""
    return _per_file(sources, lambda p, t: [(p, k, s) for k, s in enumerate(modules.specifiers(t))], "path string, ord long, specifier string", pa.schema([("path", S), ("ord", L), ("specifier", S)]))


def symbol_rows(sources: DataFrame) -> DataFrame:
    """path, name, kind, exported, line, end_line, ord, id."""
    rows = _per_file(
        sources,
        lambda p, t: [(p, s.name, s.kind, s.exported, s.line, s.end_line, s.ordinal) for s in modules.symbols(t)],
        "path string, name string, kind string, exported boolean, line long, end_line long, ord long",
        pa.schema([("path", S), ("name", S), ("kind", S), ("exported", B), ("line", L), ("end_line", L), ("ord", L)]),
    )
    return ordinal_ids(rows)


def import_rows(sources: DataFrame) -> DataFrame:
    """path, specifier, local, name."""
    return _per_file(sources, lambda p, t: [(p, i.specifier, i.local, i.name) for i in modules.imports(t)], "path string, specifier string, local string, name string", pa.schema([("path", S), ("specifier", S), ("local", S), ("name", S)]))


def reexport_rows(sources: DataFrame) -> DataFrame:
    """path, specifier, kind, exported, declared."""
    return _per_file(sources, lambda p, t: [(p, r.specifier, r.kind, r.exported, r.declared) for r in modules.reexports(t)], "path string, specifier string, kind string, exported string, declared string", pa.schema([("path", S), ("specifier", S), ("kind", S), ("exported", S), ("declared", S)]))


def alias_rows(sources: DataFrame) -> DataFrame:
    """path, exported, declared of local export aliases."""
    return _per_file(sources, lambda p, t: [(p, a, b) for a, b in modules.export_aliases(t).items()], "path string, exported string, declared string", pa.schema([("path", S), ("exported", S), ("declared", S)]))


def computed_import_rows(sources: DataFrame) -> DataFrame:
    """path, dynamic_imports of files that have any; texts without the word are not parsed."""
    hint = sources.filter(F.col("text").rlike(r"\bimport\s*\("))
    return _per_file(hint, lambda p, t: [(p, n)] if (n := modules.computed_imports(t)) else [], "path string, dynamic_imports long", pa.schema([("path", S), ("dynamic_imports", L)]))


def use_rows(sources: DataFrame) -> DataFrame:
    """path, name, line of identifier uses."""
    return _per_file(sources, lambda p, t: [(p, n, k) for n, k in modules.uses(t)], "path string, name string, line long", pa.schema([("path", S), ("name", S), ("line", L)]))


def outline_rows(sources: DataFrame) -> DataFrame:
    keys = ("name", "kind", "exported", "signature", "line", "end_line", "doc")
    return _per_file(
        sources,
        lambda p, t: [(p, *(o[k] for k in keys)) for o in modules.outline(t)],
        "path string, name string, kind string, exported boolean, signature string, line long, end_line long, doc string",
        pa.schema([("path", S), ("name", S), ("kind", S), ("exported", B), ("signature", S), ("line", L), ("end_line", L), ("doc", S)]),
    )


def member_use_rows(sources: DataFrame) -> DataFrame:
    """path, name, member, line of property accesses."""
    return _per_file(sources, lambda p, t: [(p, a, b, k) for a, b, k in modules.member_uses(t)], "path string, name string, member string, line long", pa.schema([("path", S), ("name", S), ("member", S), ("line", L)]))


def exported_names(states: DataFrame, sources: DataFrame, resolved: DataFrame, base: DataFrame) -> DataFrame:
    """What names of modules mean, wherever re-exports lead: state columns with `id`, the declared symbol.

    A state is (target, want, rest): a module, the name wanted of it, and what is
    wanted of that name if it is a namespace. A name that a module declares, or
    lists under another name, is found there; else it goes on through named, star
    and namespace re-exports, until no state is new.
    """
    keys = ["target", "want", "rest"]
    aliases = alias_rows(sources).select(F.col("path").alias("target"), F.col("exported").alias("want"), "declared")
    declared = base.select(F.col("path").alias("target"), F.col("name").alias("own"), "id")
    onward = checkpointed(reexport_rows(sources).join(resolved.select("path", "specifier", F.col("target").alias("next")), ["path", "specifier"]).select(F.col("path").alias("target"), "kind", "exported", "declared", "next"))
    asked = checkpointed(states.select(*keys).distinct().withColumn("t0", F.col("target")).withColumn("w0", F.col("want")).withColumn("r0", F.col("rest")))
    seen, front = asked, asked
    found = None
    while True:
        named = front.join(aliases, ["target", "want"], "left").withColumn("own", F.coalesce("declared", "want")).drop("declared")
        hit = checkpointed(named.join(declared, ["target", "own"], "left").select(*front.columns, "id"))
        done = hit.filter("id is not null").select("t0", "w0", "r0", "id")
        found = done if found is None else found.unionByName(done)
        step = hit.filter("id is null").drop("id").join(onward, "target")
        plain = step.filter("kind = 'named' and exported = want or kind = 'star' and want <> 'default'")
        plain = plain.select(F.col("next").alias("target"), F.when(F.col("kind") == "named", F.col("declared")).otherwise(F.col("want")).alias("want"), "rest", "t0", "w0", "r0")
        inner = step.filter("kind = 'namespace' and exported = want and rest is not null").select(F.col("next").alias("target"), F.col("rest").alias("want"), F.lit(None).cast("string").alias("rest"), "t0", "w0", "r0")
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in seen.columns]
        front, n = counted(plain.unionByName(inner).distinct().alias("n").join(seen.alias("s"), reduce(and_, same), "left_anti"))
        if not n:
            return found.distinct()
        seen = seen.unionByName(front)


def references(sources: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """src path, id, same_file, line: lexical references to known symbols.

    A used name is the file's own symbol, or what its import table says it is in
    the file that the specifier resolves to (path, specifier, target), through
    that file's lists and re-exports. `ns.x` is x of what ns was imported from.
    """
    used = use_rows(sources).distinct()
    base = checkpointed(symbols.filter(~F.col("id").rlike(r"~\d+$")).select("path", "name", "id"))
    own = used.join(base, ["path", "name"]).select(F.col("path").alias("src"), "id", F.lit(True).alias("same_file"), "line")
    bound = checkpointed(import_rows(sources).filter("local <> ''").join(resolved.select("path", "specifier", "target"), ["path", "specifier"]).select("path", F.col("local").alias("name"), "target", F.col("name").alias("exported")))
    none = F.lit(None).cast("string")
    plain = used.join(bound.filter("exported <> '*'"), ["path", "name"]).select("path", "line", "target", F.col("exported").alias("want"), none.alias("rest"))
    parts = member_use_rows(sources).distinct().join(bound, ["path", "name"])
    parts = parts.select("path", "line", "target", F.when(F.col("exported") == "*", F.col("member")).otherwise(F.col("exported")).alias("want"), F.when(F.col("exported") != "*", F.col("member")).alias("rest"))
    states = checkpointed(plain.unionByName(parts).distinct())
    meant = exported_names(states, sources, resolved, base)
    far = states.join(meant, (F.col("target") == F.col("t0")) & (F.col("want") == F.col("w0")) & F.col("rest").eqNullSafe(F.col("r0")))
    return own.unionByName(far.select(F.col("path").alias("src"), "id", F.lit(False).alias("same_file"), "line")).distinct()


def usages(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """src symbol, dst symbol: references by the top-level symbol around their line; module-level and self uses go."""
    around = symbols.select(F.col("path").alias("src"), F.col("id").alias("user"), F.col("line").alias("b"), "end_line")
    hit = refs.join(around, "src").filter("line between b and end_line and user <> id")
    inner = hit.groupBy("src", "id", "line").agg(F.max_by("user", F.struct("b", "user")).alias("user"))
    return inner.select(F.col("user").alias("src"), F.col("id").alias("dst")).distinct()
