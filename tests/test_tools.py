"""Answers, texts, the JSON-RPC loop, settings and pages on a small graph."""

import io
import json

import pytest

from quarry import answers, config, render, tools
from quarry.extract import modules
from quarry.model import DOMAIN, EDGE, FILE, PACKAGE, SYMBOL, Graph


#: An observatory: who imports whom, and what is declared where. night.ts is an entry point.
IMPORTS = {"sky/night.ts": ["sky/stars.ts", "optics/lens.ts"], "sky/stars.ts": ["maths/angle.ts"], "optics/lens.ts": ["maths/angle.ts", "optics/glass.ts"], "optics/glass.ts": [], "maths/angle.ts": [], "sky/stars.test.ts": ["sky/stars.ts"], "lone/dust.ts": []}
SYMBOLS = {"sky/night.ts": [("observe", True)], "sky/stars.ts": [("brightest", True), ("sortByLight", False)], "optics/lens.ts": [("focus", True)], "maths/angle.ts": [("radians", True), ("degrees", True)]}
REFERENCES = [("sky/night.ts", "sky/stars.ts#brightest", False), ("sky/stars.ts", "maths/angle.ts#radians", False), ("optics/lens.ts", "maths/angle.ts#radians", False), ("maths/angle.ts", "maths/angle.ts#degrees", True)]


@pytest.fixture(scope="module")
def small(spark):
    domain = lambda p: p.split("/")[0]
    files = [(f"file:{p}", p, p.split("/")[-1], ".ts", "TypeScript", "test" if ".test." in p else "code", 10, None, p == "sky/night.ts", None) for p in IMPORTS]
    symbols = [(f"sym:{p}#{n}", p, n, "function", x, 1 + 4 * k) for p, names in SYMBOLS.items() for k, (n, x) in enumerate(names)]
    edge = lambda kind, a, b, how=None, spec=None, same=None, weight=None: (kind, a, b, how, spec, same, None, weight)
    edges = [edge("IMPORTS", f"file:{a}", f"file:{b}", "internal", b) for a, bs in IMPORTS.items() for b in bs]
    edges += [edge("IMPORTS", "file:optics/glass.ts", "pkg:silica", "external", "silica")]
    edges += [edge("DECLARES", f"file:{x[1]}", x[0]) for x in symbols] + [edge("REFERENCES", f"file:{a}", f"sym:{b}", same=same) for a, b, same in REFERENCES]
    edges += [edge("BELONGS_TO", f"file:{p}", f"domain:{domain(p)}") for p in IMPORTS]
    crossing = {}
    for a, bs in IMPORTS.items():
        for b in bs:
            if domain(a) != domain(b):
                crossing[domain(a), domain(b)] = crossing.get((domain(a), domain(b)), 0) + 1
    edges += [edge("DEPENDS_ON", f"domain:{a}", f"domain:{b}", weight=n) for (a, b), n in crossing.items()]
    make = spark.createDataFrame
    domains = sorted({domain(p) for p in IMPORTS})
    return Graph(make(files, FILE), make(symbols, SYMBOL), make([("pkg:silica", "silica", None)], PACKAGE), make([(f"domain:{d}", d, "product") for d in domains], DOMAIN), make(edges, EDGE))


def test_answers(small):
    t = tools.Tools(small)
    assert [x["id"] for x in t.dead_exports()["items"]] == ["sym:maths/angle.ts#degrees", "sym:optics/lens.ts#focus"]  # what the entry point declares is held back
    assert [x["id"] for x in t.dead_exports(include_entry_points=True)["items"]][-1] == "sym:sky/night.ts#observe"
    reached = t.impact_of("maths/angle.ts")["items"]
    assert [(x["depth"], x["node"]) for x in reached] == [(1, "file:optics/lens.ts"), (1, "file:sky/stars.ts"), (2, "file:sky/night.ts"), (2, "file:sky/stars.test.ts")]
    assert {x["depth_cap_reached"] for x in t.impact_of("maths/angle.ts", max_depth=1)["items"]} == {True}
    assert t.path_between("sky/night.ts", "maths/angle.ts")["path"] == ["file:sky/night.ts", "file:optics/lens.ts", "file:maths/angle.ts"]
    assert t.path_between("maths/angle.ts", "sky/night.ts")["path"] is None
    assert t.brief("angle.ts")["id"] == "file:maths/angle.ts" and not t.brief("comet")["found"] and t.brief("sky")["id"] == "domain:sky"
    assert t.find_node("")["error"] and t.find_node("sky", 1)["truncated"]
    changed = t.impact(["maths/angle.ts", "gone.ts"])
    assert changed["unknown"]["items"] == [{"path": "gone.ts"}] and changed["tests"]["items"] == [{"node": "file:sky/stars.test.ts"}]
    assert [x["id"] for x in t.orphans()["items"]] == ["file:lone/dust.ts", "file:sky/night.ts"]


def test_rpc(small):
    call = lambda n, name, **kw: json.dumps({"jsonrpc": "2.0", "id": n, "method": "tools/call", "params": {"name": name, "arguments": kw}})
    lines = ["", "{", json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/list"}), json.dumps({"jsonrpc": "2.0", "method": "ping"}), call(2, "domain_of", file="optics/glass.ts"), json.dumps({"jsonrpc": "2.0", "id": 3, "method": "nope"}), call(4, "x"), json.dumps({"id": 5})]
    sink = io.StringIO()
    tools.serve(tools.Tools(small), io.StringIO("\n".join(lines)), sink)
    out = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [x.get("error", {}).get("code") for x in out] == [-32700, None, None, -32601, -32602, -32600]
    assert json.loads(out[2]["result"]["content"][0]["text"])["domain"] == "optics"
    names = {x["name"] for x in out[1]["result"]["tools"]}
    assert {"outline", "show", "describe", "brief", "impact", "cycles"} <= names


def test_texts_and_budgets(small):
    t = tools.Tools(small)
    whole = t.text("impact", {"files": ["maths/angle.ts", "gone.ts"]})
    assert "files that import them (4):" in whole["text"] and "not in the graph (1):" in whole["text"] and not whole["omitted"]
    cut = t.text("impact", {"files": ["maths/angle.ts", "gone.ts"]}, max_tokens=whole["tokens"] - 12)
    assert cut["tokens"] <= whole["tokens"] - 12 and cut["omitted"] and "cut to fit" in cut["text"] and not cut["overBudget"]
    assert t.text("impact", {"files": ["maths/angle.ts"]}, max_tokens=1)["overBudget"]
    as_json = t.text("brief", {"target": "maths/angle.ts"}, max_tokens=90, mode="json")
    assert json.loads(as_json["text"]) == as_json["payload"] and as_json["payload"]["budget"]["omitted"] and as_json["tokens"] <= 90
    assert t.text("brief", {"target": "comet"})["text"].startswith("no match for")
    assert t.text("check", {})["text"] == "no rules are configured"
    failed = t.text("check", {"rules": {"dead_exports": 1, "domain_pairs": 9, "speed": 3}, "forbidden": [["domain:sky", "domain:optics"]]})
    assert not failed["payload"]["ok"] and "FAIL dead_exports: 2 found, 1 allowed" in failed["text"] and "file:sky/night.ts -> file:optics/lens.ts" in failed["text"] and "unknown rule: speed" in failed["text"]
    assert "cycles of files (0):" in t.text("cycles", {})["text"]
    long = {"items": [{"path": f"packages/observatory/src/part{k}.ts"} for k in range(9)] + [{"path": "x.ts"}], "total": 10}
    small_ = answers.fit_answer(long, "list", compress=True)
    assert answers.restored(small_["payload"], "path") == sorted(r["path"] for r in long["items"]) and small_["tokens"] < answers.fit_answer(long, "list")["tokens"]


SOURCE = """import { a } from './a';
const z = require("zed");
/** A lamp.
 * More. */
export class Lamp<T> extends Thing {
  #hot = 1;
  static count = 0;
  private secret() { return 1 }
  constructor(readonly watts: number) { super() }
  get bright(): boolean { return this.watts > 40 }
  async glow<U>(x: U): Promise<U> {
    return x;
  }
  name?: string;
}
export function over(x: string): string;
export function over(x: any) { return x }
export * from './b';
"""


def test_outline_and_show(small, tmp_path):
    (tmp_path / "optics").mkdir()
    (tmp_path / "optics/lamp.ts").write_text(SOURCE)
    (tmp_path / "optics/lens.ts").write_text("// bends\nexport const focus = 1;\n")
    t = tools.Tools(small, str(tmp_path))
    p = t.outline("lamp.ts")
    assert p["imports"] == {"count": 2, "list": ["./a", "zed"], "truncated": False} and p["parseErrors"] == 0
    lamp = next(d for d in p["declarations"]["list"] if d["name"] == "Lamp")
    assert lamp["doc"] == "A lamp." and [(m["name"], m["kind"]) for m in lamp["members"]["list"]] == [("count", "property"), ("constructor", "constructor"), ("bright", "getter"), ("glow", "method"), ("name", "property")]
    assert p["declarations"]["list"][-1]["signature"] == "* from ./b" and t.outline("lamp.ts", 1)["declarations"]["truncated"]
    text = t.text("outline", {"target": "lamp.ts"})["text"]
    assert "export class export class Lamp" in text or "Lamp<T> extends Thing" in text
    assert t.outline("none.ts")["kind"] == "not-found" and modules.outline_payload("x.ts", "function f( {")["parseErrors"] == 2
    one = t.show("Lamp")
    assert (one["startLine"], one["endLine"], one["lookup"]) == (3, 15, "scan") and one["source"].startswith("/** A lamp.")
    assert t.show("focus")["lookup"] == "graph" and t.show("lens.ts#focus")["declarationLine"] == 2 and t.show("over")["kind"] == "symbol"
    assert t.show("Lam")["candidates"][0]["name"] == "Lamp" and t.show("")["kind"] == "not-found"
    assert "3  /** A lamp." in t.text("show", {"symbol": "Lamp"})["text"]
    known = small.edges.sparkSession.createDataFrame([("file:optics/lens.ts", "Bends light.")], "target_id string, text string")
    assert tools.Tools(small, None, known).text("describe", {"target": "lens.ts"})["text"] == "Bends light."
    assert t.describe("optics/glass.ts")["status"] == "none" and t.describe("comet")["status"] == "not-found"


def test_config():
    with pytest.raises(config.ConfigError, match="did you mean 'src_roots'"):
        config.load_config({"src_root": ["a"]})
    with pytest.raises(config.ConfigError):
        config.load_config({"limit": 0})
    a, b = config.load_config({"src_roots": ["lib"]}), config.load_config({"src_roots": ["lib"], "limit": 3})
    assert config.build_hash(a) == config.build_hash(b) != config.build_hash(config.EngineConfig())


def test_pages(small):
    assert render.merge_generated("mine", "x") is None
    once = render.merge_generated("head\n" + render.BEGIN + "\nold\n" + render.END + "\ntail", "new")
    assert once.startswith("head") and "old" not in once and once.endswith("tail")
    out = render.pages(small)
    assert "domains/maths" in out and "| silica |" not in out["index"] and "pkg:silica" in out["dependencies"]
