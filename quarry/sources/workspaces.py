"""Packages of a monorepo, from the manifests among its files.

Declarations (the root manifest, the pnpm file) are a few lines and are read by
the driver; the manifests of packages are parsed where their texts are, and which
of them a declaration takes in is a filter over their folders.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.paths import dir_name, source_variants

# Fixed value: conditions of an exports entry, what is nearest to sources first.
CONDITIONS = "source development types import module default require node".split()
UNSEEN = ("node_modules", ".git")


def tolerant_json(text: str | None) -> dict | None:
    """An object of JSON with comments and trailing commas, as settings files have them; null for anything else."""
    def keep(m: re.Match) -> str:
        return m[0] if m[0].startswith('"') else " "

    bare = re.sub(r'"(?:[^"\\\n]|\\.)*"|//[^\n]*|/\*.*?(?:\*/|\Z)', keep, (text or "").lstrip("\ufeff"), flags=re.S)
    bare = re.sub(r'"(?:[^"\\\n]|\\.)*"|,(?=\s*[}\]])', keep, bare)
    try:
        out = json.loads(bare)
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


def clean_target(value: object) -> str | None:
    """A manifest's target without ./ before it and slashes behind; null for what is no path."""
    if not isinstance(value, str):
        return None
    bare = re.sub(r"^\./", "", re.sub(r"/+$", "", value.replace("\\", "/")))
    return None if bare in ("", ".") else bare


def _targets(value: object) -> Iterator[str]:
    if isinstance(value, str):
        target = clean_target(value)
        if target:
            yield target
    elif isinstance(value, dict):
        rank = {c: k for k, c in enumerate(CONDITIONS)}
        for key in sorted(value, key=lambda c: (rank.get(c, len(rank)), c if c not in rank else "")):
            yield from _targets(value[key])


def condition_targets(value: object) -> list[str]:
    """All targets below an exports value, by the order of conditions, other conditions by name; each once."""
    return list(dict.fromkeys(_targets(value)))


def split_exports(exports: object) -> tuple[list[str], dict[str, list[str]]]:
    """Targets of the package itself, and of its named subpaths."""
    by_path = isinstance(exports, dict) and any(k == "." or k.startswith("./") for k in exports)
    if not by_path:
        return condition_targets(exports), {}
    subpaths = {k[2:]: t for k, v in exports.items() if k.startswith("./") and (t := condition_targets(v))}
    return condition_targets(exports.get(".")), subpaths


def bin_targets(value: object) -> list[str]:
    """Targets of commands, by the commands' names; each once."""
    named = [value] if isinstance(value, str) else [value[k] for k in sorted(value)] if isinstance(value, dict) else []
    return list(dict.fromkeys(t for v in named if (t := clean_target(v))))


def yaml_scalar(raw: str) -> str:
    """Without its quotes, or without the comment behind it."""
    s = raw.strip()
    quoted = re.match(r"(['\"])(.*?)(?:\1|\Z)", s, re.S)
    return quoted[2] if quoted else s.split("#")[0].strip()


def pnpm_patterns(text: str | None) -> list[str]:
    """The list under `packages:`, in either form; it ends at the next key."""
    lines = iter(re.split(r"\r?\n", text or ""))
    for line in lines:
        head = re.match(r"packages\s*:(.*)$", line)
        if not head:
            continue
        rest = head[1].strip()
        if flow := re.fullmatch(r"\[(.*)\]", rest):
            return [s for part in flow[1].split(",") if (s := yaml_scalar(part))]
        if not rest or rest.startswith("#"):
            break
    out = []
    for line in lines:
        item = re.match(r"\s*-\s*(.*)$", line)
        if item:
            out += [s] if (s := yaml_scalar(item[1])) else []
        elif line.strip() and not line.strip().startswith("#"):
            break
    return out


def manifest_patterns(text: str | None) -> list[str]:
    """The `workspaces` of a root manifest, in either form."""
    declared = (tolerant_json(text) or {}).get("workspaces")
    declared = declared.get("packages") if isinstance(declared, dict) else declared
    return [p for p in declared if isinstance(p, str)] if isinstance(declared, list) else []


def folder_pattern(pattern: str) -> str | None:
    """Which folders a workspace pattern means, as a regular expression: * stays within a segment, ** spans any number of them."""
    parts = [s for s in re.sub(r"^\./", "", pattern.replace("\\", "/")).split("/") if s]
    if not parts:
        return None
    out = ""
    for s in parts:
        out += "(?:/[^/]+)*" if s == "**" else "/" + "[^/]*".join(re.escape(x) for x in s.split("*"))
    return f"^{out}$"


def manifest(text: str | None, folder: str) -> dict | None:
    """name, entries, subpaths and bin of one manifest, paths from the root; null if it is no object."""
    made = tolerant_json(text)
    if made is None:
        return None
    entries, subpaths = split_exports(made.get("exports"))
    entries = list(dict.fromkeys([*entries, *(t for k in ("module", "main") if (t := clean_target(made.get(k))))]))
    under = lambda t: t if folder == "." else f"{folder}/{t}"
    name = made.get("name")
    return {"name": name if isinstance(name, str) and name else None, "entries": [under(t) for t in entries], "subpaths": {k: [under(t) for t in v] for k, v in subpaths.items()}, "bin": [under(t) for t in bin_targets(made.get("bin"))]}


PACKAGE = "name string, dir string, entries array<string>, subpaths map<string,array<string>>, bin array<string>"


def manifests(found: DataFrame) -> DataFrame:
    """name, dir, entries, subpaths, bin of every readable manifest among files (path, text)."""
    texts = pa.list_(pa.string())
    schema = pa.schema([("name", pa.string()), ("dir", pa.string()), ("entries", texts), ("subpaths", pa.map_(pa.string(), texts)), ("bin", texts)])

    def run(batches):
        for batch in batches:
            rows = [(m["name"], d, m["entries"], list(m["subpaths"].items()), m["bin"]) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (m := manifest(t, d))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    unseen = F.exists(F.split("path", "/"), lambda s: s.isin(*UNSEEN))
    rows = found.filter(F.col("path").rlike(r"(^|/)package\.json$") & ~unseen)
    return rows.select(dir_name(F.col("path")).alias("dir"), "text").mapInArrow(run, PACKAGE)


def discover(found: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """The packages that the declarations at the root take in, and those of `linked` (name, dir) that no declaration names.

    Of one name the first folder counts. What a pattern with ! names is out,
    wherever it stands. Without a declaration there are only linked packages.
    """
    declared = {r["path"]: r["text"] for r in found.filter(F.col("path").isin("package.json", "pnpm-workspace.yaml")).select("path", "text").collect()}  # two rows at most
    patterns = manifest_patterns(declared.get("package.json")) + pnpm_patterns(declared.get("pnpm-workspace.yaml"))
    wanted = [p for x in patterns if not x.startswith("!") and (p := folder_pattern(x))]
    unwanted = [p for x in patterns if x.startswith("!") and (p := folder_pattern(x[1:]))]
    every = manifests(found)
    at = F.concat(F.lit("/"), "dir")
    hit = lambda ps: F.lit(False) if not ps else at.rlike("|".join(ps))
    taken = every.filter("name is not null and dir <> '.'").filter(hit(wanted) & ~hit(unwanted))
    taken = taken.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("dir"))).filter("k = 1").drop("k")
    if linked is None:
        return taken
    more = linked.join(taken.select("name"), "name", "left_anti").join(every.drop("name"), "dir")
    return taken.unionByName(more.select(*taken.columns))


def links(root: str) -> list[tuple[str, str]]:
    """(name, folder) of packages that links in node_modules folders lead to within the root; the link's name counts."""
    real, out = os.path.realpath(root), {}
    for folder, names, _ in os.walk(root):
        if "node_modules" in names:
            base = Path(folder, "node_modules")
            entries = [e for e in sorted(base.iterdir()) if not e.name.startswith(".")]
            scoped = [x for e in entries if e.name.startswith("@") and e.is_dir() and not e.is_symlink() for x in sorted(e.iterdir())]
            for e in entries + scoped:
                target = os.path.relpath(os.path.realpath(e), real)
                if e.is_symlink() and e.exists() and target != "." and not target.startswith(".."):
                    out.setdefault(e.relative_to(base).as_posix(), Path(target).as_posix())
        names[:] = sorted(n for n in names if n not in UNSEEN)
    return sorted(out.items())


def alias_targets(packages: DataFrame) -> DataFrame:
    """pattern, ord, base: for each package's name, its named subpaths and name/*, where their sources may be, best first.

    A manifest's target comes first, then what it may have been built from, then
    the usual places.
    """
    d, sub = F.col("dir"), F.col("sub")
    built = lambda ts: F.flatten(F.transform(ts, lambda t: source_variants(t, d)))
    at = lambda tail: F.concat(d, F.lit(tail))
    usual = F.array(at("/src/index"), at("/index"), at("/src"), d)
    own = packages.select(F.col("name").alias("pattern"), F.when(F.size("entries") > 0, F.concat(built(F.col("entries")), F.array(d))).otherwise(usual).alias("bases"))
    named = packages.select("name", "dir", F.explode("subpaths").alias("sub", "targets"))
    inner = named.select(F.concat("name", F.lit("/"), "sub").alias("pattern"), F.concat(built(F.col("targets")), F.array(F.concat(d, F.lit("/src/"), sub), F.concat(d, F.lit("/"), sub))).alias("bases"))
    wild = packages.select(F.concat("name", F.lit("/*")).alias("pattern"), F.array(at("/src/*"), at("/*")).alias("bases"))
    rows = own.unionByName(inner).unionByName(wild)
    return rows.select("pattern", F.posexplode(F.array_distinct("bases")).alias("ord", "base"))


def nearest_settings(found: DataFrame) -> DataFrame:
    """dir, base_url, paths of every readable tsconfig or jsconfig that has any, for `longest_prefix`; a tsconfig hides a jsconfig beside it."""
    schema = pa.schema([("dir", pa.string()), ("base_url", pa.string()), ("paths", pa.map_(pa.string(), pa.list_(pa.string())))])

    def run(batches):
        for batch in batches:
            rows = []
            for folder, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                options = (tolerant_json(text) or {}).get("compilerOptions")
                if isinstance(options, dict) and ("baseUrl" in options or "paths" in options):
                    given = options.get("paths") if isinstance(options.get("paths"), dict) else {}
                    base = posixpath.normpath(posixpath.join(folder, str(options.get("baseUrl") or ".")))
                    rows.append((folder, base, [(k, [t for t in v if isinstance(t, str)]) for k, v in given.items() if isinstance(v, list)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    name = F.substring_index("path", "/", -1)
    rows = found.filter(name.isin("tsconfig.json", "jsconfig.json")).groupBy(dir_name(F.col("path")).alias("dir")).agg(F.max_by("text", name).alias("text"))
    return rows.mapInArrow(run, "dir string, base_url string, paths map<string,array<string>>")
