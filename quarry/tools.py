"""The graph's questions by name, with limits and totals, as JSON-ready answers; a JSON-RPC loop and a command line over them.

An answer collects rows that the plan has already limited; totals are counted on
the executors.
"""

from __future__ import annotations

import argparse
import json
import re
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import answers
from .extract import modules
from .model import Graph
from .operators import aggregates as ag
from .operators import cycles, lookup, traverse, windows
from .operators import rules as rules_
from .sources import tree

LIMIT = 50


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _capped(df: DataFrame, order: list, limit: int) -> dict:
    rows = _rows(windows.capped(df, order, limit))
    total = rows[0]["total"] if rows else 0
    return {"items": [{k: v for k, v in r.items() if k not in ("total", "truncated")} for r in rows], "total": total, "returned": len(rows), "truncated": total > len(rows)}


class Tools:
    def __init__(self, graph: Graph, root: str | None = None, descriptions: DataFrame | None = None):
        """`root` is the folder of the sources, `descriptions` has target_id and text."""
        self.g = graph.cached_edges()
        self.root, self.descriptions = root, descriptions
        self.by_name: dict[str, tuple[str, Callable[..., dict]]] = {
            n: ((f.__doc__ or "").strip().split("\n")[0], f)
            for n, f in {
                "find_node": self.find_node, "node_info": self.node_info, "imports_of": self.imports_of, "imported_by": self.imported_by, "impact_of": self.impact_of, "path_between": self.path_between, "list_symbols": self.list_symbols,
                "who_references": self.who_references, "dead_exports": self.dead_exports, "domain_of": self.domain_of, "domain_dependencies": self.domain_dependencies, "domain_crossings": self.domain_crossings, "cycles": self.cycles,
                "brief": self.brief, "impact": self.impact, "orphans": self.orphans, "stats": self.stats, "outline": self.outline, "show": self.show, "describe": self.describe, "check": self.check,
            }.items()
        }

    def _id(self, name: str) -> str | None:
        spark = self.g.edges.sparkSession
        row = lookup.resolve_node_id(self.g, spark.createDataFrame([(name,)], "name string")).first()
        return row["id"] if row else None

    def _with(self, name: str, make: Callable[[str], dict]) -> dict:
        node = self._id(name)
        return {"found": False, "query": name, "suggestions": [r["id"] for r in _rows(lookup.suggestions(self.g, name))]} if node is None else {"found": True, "id": node, **make(node)}

    def find_node(self, query: str, limit: int = LIMIT) -> dict:
        """Nodes whose id, path or name contains a text."""
        if not query:
            return {"error": "query is empty"}
        rows = _rows(lookup.find_node(self.g, query, limit))
        total = rows[0]["total"] if rows else 0
        return {"items": [{k: r[k] for k in ("id", "label", "path", "name")} for r in rows], "total": total, "returned": len(rows), "truncated": total > len(rows)}

    def node_info(self, id: str) -> dict:
        """A node's edges by type and direction."""
        return self._with(id, lambda n: {"edges": _rows(lookup.node_info(self.g, n))})

    def imports_of(self, file: str, limit: int = LIMIT) -> dict:
        """What a file imports."""
        return self._with(file, lambda n: _capped(lookup.imports_of(self.g, n), ["dst"], limit))

    def imported_by(self, file: str, limit: int = LIMIT) -> dict:
        """Files that import a file."""
        return self._with(file, lambda n: _capped(lookup.direct_importers(self.g, n), ["src"], limit))

    def impact_of(self, file: str, max_depth: int = 25, limit: int = LIMIT) -> dict:
        """Files that import a file, directly or not."""
        return self._with(file, lambda n: _capped(traverse.impact_of(self.g, n, max_depth), ["depth", "node"], limit))

    def path_between(self, source: str, target: str, max_depth: int = 25) -> dict:
        """The shortest directed path between two nodes."""
        a, b = self._id(source), self._id(target)
        if a is None or b is None:
            return {"found": False, "unknown": [x for x, y in ((source, a), (target, b)) if y is None]}
        path = [r["node"] for r in traverse.shortest_path(self.g.edges.select("src", "dst"), a, b, max_depth).orderBy("hop").collect()]
        return {"found": True, "path": path or None, "length": len(path) - 1 if path else None}

    def list_symbols(self, file: str, limit: int = LIMIT) -> dict:
        """Symbols that a file declares."""
        return self._with(file, lambda n: _capped(lookup.list_symbols(self.g, n), ["id"], limit))

    def who_references(self, symbol: str, include_same_file: bool = False, limit: int = LIMIT) -> dict:
        """Files that reference a symbol."""
        return self._with(symbol, lambda n: _capped(lookup.cross_refs(self.g, include_same_file).filter(F.col("dst") == n).select("src").distinct(), ["src"], limit))

    def dead_exports(self, limit: int = LIMIT, include_entry_points: bool = False) -> dict:
        """Exported symbols that no other file references."""
        return _capped(lookup.dead_exports(self.g, include_entry_points=include_entry_points), ["id"], limit) | {"precise": "references" in self.g.layers}

    def domain_of(self, file: str) -> dict:
        """A file's domain."""
        return self._with(file, lambda n: {"domain": (lookup.domain_of_file(self.g).filter(F.col("id") == n).first() or {"domain": None})["domain"]})

    def domain_dependencies(self, domain: str) -> dict:
        """What a domain depends on, and what on it."""
        return self._with(domain, lambda n: {"edges": _rows(ag.domain_dependencies(self.g, n).orderBy("dir", F.desc("weight"), "other"))})

    def domain_crossings(self, limit: int = LIMIT) -> dict:
        """Pairs of domains by imports that cross them."""
        return _capped(ag.domain_crossings(self.g).withColumnRenamed("total", "total_weight"), [F.desc("weight"), "a", "b"], limit)

    def cycles(self, scope: str = "both", limit: int = 20) -> dict:
        """Circular dependencies of files or domains."""
        out = {}
        if scope in ("both", "file"):
            out["files"] = _capped(cycles.file_cycles(self.g), ["length", "ring"], limit)
        if scope in ("both", "domain"):
            out["domains"] = _capped(cycles.domain_cycles(self.g), ["length", "ring"], limit)
        return out

    def brief(self, target: str, limit: int = 10) -> dict:
        """What one should know of a file, domain or symbol."""
        spark = self.g.edges.sparkSession
        hits = [r for r in _rows(lookup.resolve_targets(self.g, spark.createDataFrame([(target,)], "target string")).orderBy("id")) if r["id"]]
        if len(hits) != 1:
            return {"found": bool(hits), "ambiguous": [h["id"] for h in hits[:8]], "suggestions": [] if hits else [r["id"] for r in _rows(lookup.suggestions(self.g, target))]}
        node = hits[0]["id"]
        out = {"found": True, "id": node, "edges": _rows(lookup.node_info(self.g, node).drop("others").orderBy("dir", "type"))}
        if node.startswith("file:"):
            out |= {"importers": _capped(lookup.direct_importers(self.g, node), ["src"], limit), "symbols": _capped(lookup.symbols_of_file(self.g, node), ["line", "id"], limit), "domain": self.domain_of(node)["domain"]}
        elif node.startswith("domain:"):
            out |= {"dependencies": self.domain_dependencies(node)["edges"], "top_files": _rows(ag.domain_top_files(self.g, node, limit)), "packages": _capped(ag.packages_for_files(self.g, lookup.files_of_domain(self.g, node)), [F.desc("files"), "package"], limit)}
        elif node.startswith("sym:"):
            out |= {"referenced_by": self.who_references(node, limit=limit)}
        return out

    def impact(self, files: list[str], max_depth: int = 25, limit: int = 20) -> dict:
        """What a change of some files touches."""
        spark = self.g.edges.sparkSession
        s = traverse.build_impact(self.g, spark.createDataFrame([(f,) for f in files], "path string"), max_depth)
        order = {"known": ["path"], "unknown": ["path"], "radius": ["depth", "node"], "domains": [F.desc("files"), "domain"], "risky_exports": [F.desc("refs"), "sym"], "tests": ["node"]}
        return {k: _capped(s[k], order[k], limit) for k in order}

    def orphans(self, limit: int = LIMIT) -> dict:
        """Files that nothing imports."""
        return _capped(lookup.orphan_files(self.g), ["id"], limit)

    def stats(self) -> dict:
        """Nodes by label, and edges."""
        return {r["label"]: r["n"] for r in ag.label_counts(self.g).collect()}

    def _read(self, path: str) -> str | None:
        real = tree.safe_path(self.root, path) if self.root else None
        if real is None:
            return None
        with open(real, encoding="utf-8", errors="replace") as f:
            return f.read()

    def _sources(self) -> list[str]:
        return [p for p, folder in tree.walk(self.root) if not folder and re.search(r"\.([mc]?[jt]s|[jt]sx)$", p, re.I)] if self.root else []

    def outline(self, target: str, limit: int = 100) -> dict:
        """A file's skeleton: imports, declarations, members, without bodies."""
        files = self._sources()
        hits = [f for f in files if f == target] or [f for f in files if f.endswith("/" + target)]
        if len(hits) != 1:
            near = [f for f in files if target.lower() in f.lower()][:8]
            return {"kind": "ambiguous", "target": target, "total": len(hits), "candidates": hits[:8]} if hits else {"kind": "not-found", "target": target, "candidates": near}
        return modules.outline_payload(hits[0], self._read(hits[0]), limit)

    def show(self, symbol: str, context: int = 0) -> dict:
        """The source of one symbol."""
        if not symbol or not self.root:
            return {"kind": "not-found", "symbol": symbol, "error": "no symbol" if self.root else "no root to read sources from", "candidates": [], "lookup": "none"}
        name = re.sub(r"~\d+$", "", symbol).rpartition("#")[2]
        spark = self.g.edges.sparkSession
        known = [r["path"] for r in lookup.paths_declaring(self.g, spark.createDataFrame([(name,)], "name string")).orderBy("path").collect()]
        if known:
            found = modules.show_payload(symbol, known, self._read, context)
            if found["kind"] != "not-found":
                return found | {"lookup": "graph"}
        return modules.show_payload(symbol, self._sources(), self._read, context) | {"lookup": "scan"}  # the graph may be old

    def describe(self, target: str) -> dict:
        """What has been written about a file, domain or symbol."""
        spark = self.g.edges.sparkSession
        none = spark.createDataFrame([], "target_id string, text string")
        return lookup.describe_targets(self.g, spark.createDataFrame([(target,)], "target string"), self.descriptions if self.descriptions is not None else none).first().asDict()

    def check(self, rules: dict | None = None, forbidden: list | None = None) -> dict:
        """Whether the graph keeps the rules, and what breaks them."""
        spark = self.g.edges.sparkSession
        pairs = spark.createDataFrame([tuple(x) for x in forbidden], "from string, to string") if forbidden else None
        given = dict(rules or {}) | ({"forbidden": True} if forbidden else {})
        return rules_.check(self.g, given, forbidden=pairs, cycles=cycles.file_cycles(self.g) if "no_cycles" in given else None)

    def text(self, name: str, arguments: dict, max_tokens: int | None = None, compress: bool = False, mode: str = "text") -> dict:
        """A tool's answer as it is printed, cut and compressed as asked."""
        payload = self.by_name[name][1](**arguments)
        return answers.fit_answer(payload, name if name in answers.TEXTS else "list", mode=mode, compress=compress, max_tokens=max_tokens)

    def call(self, name: str, arguments: dict, max_tokens: int | None = None) -> dict:
        if name not in self.by_name:
            raise KeyError(name)
        arguments = dict(arguments)
        max_tokens, compress = arguments.pop("maxTokens", max_tokens), bool(arguments.pop("compressPaths", False))
        return self.text(name, arguments, max_tokens, compress, "json")["payload"]


def handle(message: dict, tools: Tools) -> dict | None:
    """One JSON-RPC request; notifications get no answer."""
    number, method, params = message.get("id"), message.get("method"), message.get("params") or {}

    def error(code: int, text: str) -> dict:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": text}}

    if message.get("jsonrpc") != "2.0" or not isinstance(method, str):
        return error(-32600, "invalid request")
    if "id" not in message:
        return None
    if method == "initialize":
        result = {"serverInfo": {"name": "quarry", "version": "1"}, "capabilities": {"tools": {}}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "description": d} for n, (d, _) in tools.by_name.items()]}
    elif method == "tools/call":
        try:
            text = json.dumps(tools.call(params.get("name", ""), params.get("arguments") or {}), separators=(",", ":"))
        except KeyError:
            return error(-32602, f"no tool {params.get('name')!r}")
        except TypeError as e:
            return error(-32602, str(e))
        except Exception as e:  # the loop outlives a failed question
            return error(-32603, str(e)[:300])
        result = {"content": [{"type": "text", "text": text}]}
    else:
        return error(-32601, f"no method {method!r}")
    return {"jsonrpc": "2.0", "id": number, "result": result}


def serve(tools: Tools, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
        else:
            reply = handle(message if isinstance(message, dict) else {}, tools)
        if reply is not None:
            sink.write(json.dumps(reply, separators=(",", ":")) + "\n")
            sink.flush()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m quarry.tools", description="Questions over a catalog graph.")
    parser.add_argument("tool", help="a tool's name, or `serve`, or `list`")
    parser.add_argument("arguments", nargs="*", help="name=value")
    parser.add_argument("--tables", required=True, help="folder of the catalog's Parquet tables")
    parser.add_argument("--max-tokens", type=int)
    parser.add_argument("--root", help="folder of the sources, for outline and show")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--compress-paths", action="store_true")
    a = parser.parse_args(argv)
    from pyspark.sql import SparkSession

    from .sources.catalog import catalog_graph

    tools = Tools(catalog_graph(SparkSession.builder.getOrCreate(), a.tables), a.root)
    if a.tool == "serve":
        serve(tools)
        return 0
    if a.tool == "list":
        print("\n".join(f"{n}: {d}" for n, (d, _) in tools.by_name.items()))
        return 0
    if a.tool not in tools.by_name:
        print(f"no tool {a.tool}", file=sys.stderr)
        return 2
    values = {}
    for x in a.arguments:
        k, _, v = x.partition("=")
        try:
            values[k] = json.loads(v)
        except ValueError:
            values[k] = v
    done = tools.text(a.tool, values, a.max_tokens, a.compress_paths, "json" if a.json else "text")
    print(done["text"])
    return 1 if a.tool == "check" and not done["payload"]["ok"] else 0


if __name__ == "__main__":
    sys.exit(main())
