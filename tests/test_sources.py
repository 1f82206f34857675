"""Extraction, trees, JSON lines, answers, freshness and streams."""

import json
import re
import subprocess

from pyspark.sql import functions as F

from quarry.extract import layers, modules
from quarry.functions import paths as fp
from quarry.operators import answer, incremental, resolve
from quarry.sources import jsonl, tree, workspaces
from quarry.streaming import changes

SOURCE = """import a, {b as c, type D} from "./x"; import * as ns from '../y';
import "side";
/** Does foo.
 * more */
export function foo(x) { return c(x) }
const {p, q: r, ...rest} = ns.z, [s1] = [1];
export const big = () => { const inner = 1; return inner / 2 };
export default class extends foo {}
export { r as rr, p };
export * from "./star"; export { k as kk } from './named'; export * as space from "./space";
const re = /import("x")/g; const dyn = import(`./lit`); import(big); require('req'); // import "comment"
"""


def test_extraction():
    assert modules.specifiers(SOURCE) == ["./x", "../y", "side", "./star", "./named", "./space", "./lit", "req"]
    assert modules.computed_imports(SOURCE) == 1
    got = {(s.name, s.kind, s.exported) for s in modules.symbols(SOURCE)}
    assert got >= {("foo", "function", True), ("p", "variable", True), ("r", "variable", True), ("rest", "variable", False), ("s1", "variable", False), ("big", "variable", True), ("default", "class", True)}
    assert "inner" not in {s.name for s in modules.symbols(SOURCE)}
    assert [(r.kind, r.exported, r.declared) for r in modules.reexports(SOURCE)] == [("star", "*", "*"), ("named", "kk", "k"), ("namespace", "space", "*")]
    assert modules.export_aliases(SOURCE) == {"rr": "r"}
    assert modules.outline(SOURCE)[0]["doc"] == "Does foo."


def test_layers(spark):
    files = [("lib.ts", "export function f() {}\nexport { f as g }\n"), ("use.ts", "import { g } from './lib'\nexport function h() {\n  return g()\n}\n"), ("none.ts", None)]
    src = spark.createDataFrame(files, "path string, text string")
    symbols = layers.symbol_rows(src).persist()
    resolved = spark.createDataFrame([("use.ts", "./lib", "lib.ts")], "path string, specifier string, target string")
    refs = layers.references(src, resolved, symbols)
    cross = {(r["src"], r["id"]) for r in refs.filter("not same_file").collect()}
    assert cross == {("use.ts", "sym:lib.ts#f")}
    assert {(r["src"], r["dst"]) for r in layers.usages(refs, symbols).collect()} == {("sym:use.ts#h", "sym:lib.ts#f")}


def test_references_through_reexports(spark):
    """Barrels, renamed and starred names, namespaces, chains and rings of files."""
    files = [
        ("lib.ts", "export function f() {}\nexport const g = 1;\nexport default class {}\n"), ("mid.ts", "export { f as ff, default as Base } from './lib';\nexport * from './ring';\n"), ("ring.ts", "export * from './mid';\nexport const own = 2;\n"),
        ("top.ts", "export * from './mid';\nexport * as box from './lib';\n"), ("a.ts", "import { ff, own, Base } from './top';\nff(own, Base);\n"), ("b.ts", "import * as all from './top';\nall.ff(); all.own; all.missing;\n"), ("c.ts", "import { box } from './top';\nbox.g; box.f();\n"),
    ]
    src = spark.createDataFrame(files, "path string, text string")
    resolved = spark.createDataFrame([(p, f"./{t}", f"{t}.ts") for p, _ in files for t in ("lib", "mid", "ring", "top")], "path string, specifier string, target string")
    refs = layers.references(src, resolved, layers.symbol_rows(src)).filter("not same_file").select("src", "id").distinct()
    got = {}
    for r in refs.collect():
        got.setdefault(r["src"], set()).add(r["id"])
    assert got["a.ts"] == {"sym:lib.ts#f", "sym:ring.ts#own", "sym:lib.ts#default"}
    assert got["b.ts"] == {"sym:lib.ts#f", "sym:ring.ts#own"}
    assert got["c.ts"] == {"sym:lib.ts#g", "sym:lib.ts#f"}


def test_tree(spark, tmp_path):
    for path, text in {"src/a.ts": "x", "src/util/index.ts": "yy", "node_modules/m/i.js": "n", ".env.production": "s", ".env.sample": "e", "id_rsa": "k", "k.log": "l", ".gitignore": "*.log\n", "README.md": "#"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = tree.files(spark, str(tmp_path))
    rows = {r["path"]: r for r in tree.inventory(found).collect()}
    assert sorted(rows) == [".env.sample", ".gitignore", "README.md", "src/a.ts", "src/util/index.ts"]
    assert rows["src/a.ts"]["kind"] == "code" and rows["README.md"]["kind"] == "doc" and rows["src/a.ts"]["language"] == "TypeScript"
    dirs, edges = tree.directories(found)
    assert {r["path"] for r in dirs.collect()} == {".", "src", "src/util"} and edges.count() == 2 + 5
    assert tree.safe_path(str(tmp_path), "src/a.ts") and tree.safe_path(str(tmp_path), "../x") is None
    assert tree.revision(str(tmp_path))["revision"] == "no-revision"


def test_changed_files(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a").write_text("1\n2\n3\n")
    (tmp_path / "b").write_text("b")
    run("add", ".")
    run("commit", "-qm", "x")
    (tmp_path / "a").write_text("changed")
    (tmp_path / "b").unlink()
    (tmp_path / "n").mkdir()
    (tmp_path / "n/c").write_text("c")
    assert tree.changed_files(str(tmp_path), "HEAD") == {"added": ["n/c"], "deleted": ["b"], "modified": ["a"]}


def test_ignore_rules():
    i = tree.Ignore(["*.log", "/build", "!keep.log", "docs/", "a/**/z.ts"])
    cases = {("q/x.log", False): True, ("keep.log", False): False, ("build", True): True, ("q/build", True): False, ("docs", True): True, ("docs", False): False, ("a/b/c/z.ts", False): True, ("a/z.ts", False): True}
    assert {k: i.match(*k) for k in cases} == cases


def test_jsonl_layers(spark, tmp_path):
    for layer, nodes, edges in [
        ("inventory", [{"id": "file:a", "labels": ["File"], "properties": {"kind": "code", "size": "1"}}], [{"id": "e", "type": "T", "from": "x", "to": "y", "properties": {"v": "first"}}]),
        ("symbols", [{"id": "file:a", "labels": ["Late"], "properties": {"kind": "test"}}], [{"id": "e", "type": "T", "from": "x", "to": "y", "properties": {"v": "second"}}]),
    ]:
        (tmp_path / layer).mkdir()
        (tmp_path / layer / "nodes.jsonl").write_text("\n".join(map(json.dumps, nodes)) + "\n\n")
        (tmp_path / layer / "edges.jsonl").write_text("\n".join(map(json.dumps, edges)))
    nodes, edges, found = jsonl.load_layers(spark, str(tmp_path))
    assert found == ["inventory", "symbols"] and edges.count() == 1
    assert {(r["labels"], r["key"], r["value"]) for r in nodes.collect()} == {("File,Late", "kind", "test"), ("File,Late", "size", "1")}
    empty = jsonl.load_layers(spark, str(tmp_path / "nowhere"))
    assert empty[0].count() == 0 and empty[1].count() == 0
    lines = [r["value"] for r in jsonl.to_lines(spark.createDataFrame([("b", 1), ("a", 2)], "id string, b int")).collect()]
    assert lines == ['{"b":2,"id":"a"}', '{"b":1,"id":"b"}']


def test_descriptions(spark, tmp_path):
    row = {"targetId": "t", "contentHash": "h", "text": "old"}
    (tmp_path / "d.jsonl").write_text("\n".join([json.dumps(row), "{broken", json.dumps(row | {"text": "new"}), json.dumps({"targetId": "u"})]))
    assert [(r["targetId"], r["text"]) for r in jsonl.read_descriptions(spark, str(tmp_path / "d.jsonl")).collect()] == [("t", "new")]


def test_answers():
    paths = ["packages/core/src/a.ts", "packages/core/src/b.ts", "packages/core/src/c.ts", "x.ts"]
    groups, rest = answer.compress_paths(paths)
    assert groups == [("packages/core/src/", ["a.ts", "b.ts", "c.ts"])] and answer.expand_groups(groups, rest) == sorted(paths)
    payload = {"a": 1, "list": [f"item {k}" for k in range(100)], "more": ["x"] * 50}
    cut = answer.fit_payload(payload, {"list": 2, "more": 1}, 150)
    assert answer.estimate(json.dumps(cut)) <= 150 and cut["more"] == ["x"] * 50 and 0 < len(cut["list"]) < 100
    assert answer.fit_payload(payload, {"list": 1, "more": 2}, 1)["overBudget"]
    assert answer.estimate("😀a") == 1


def test_scalar_functions(spark):
    one = spark.range(1)
    cases = {
        fp.kebab: {"FooBar": "foo-bar", "graph_builder": "graph-builder", "MyHTTPServer": "my-http-server", "___": "unassigned", "": "unassigned"},
        fp.norm_posix: {"a\\b\\": "a/b", "": ".", "x/": "x"},
        fp.package_name: {"@acme/ui/button": "@acme/ui", "lodash/fp": "lodash", "react": "react"},
        fp.extension: {"a.d.ts": ".d.ts", ".env": "", "App.test.tsx": ".tsx", "x.PNG": ".png", "a.tar.gz": ".tar.gz", "Makefile": "", "a.": "."},
        fp.base_symbol_id: {"sym:a/b.ts#x#f~2": "sym:a/b.ts#x#f"},
        fp.symbol_path: {"sym:a/b.ts#x#f~2": "a/b.ts#x"},
        fp.kind: {"yarn.lock": "lockfile", "a/b.test.ts": "test", "logo.svg": "asset", "vite.config.ts": "config", "x.config.js": "code", "a.ts": "code", "n.md": "doc", "a.css": "code", "a.txt": "code", "a.json": "code", "tests/a.py": "test", "tests/a.json": "code", "a.unknown": "code"},
        fp.language: {"a/Dockerfile": "Dockerfile", "dockerfile.dev": "Dockerfile", "x.xz": "Binary", "a.scss": "CSS", "a.mm": "Objective-C++", "zzz": "Unknown"},
        fp.slug: {"Álpha Beta.v2": "lpha-Beta.v2", "***": "domain"},
        fp.is_entry_like: {"run.ts": True, "a/worker.ts": True, "a/b.d.ts": True, "a/b.ts": False, "a/x.config.mjs": True},
        fp.should_skip: {"a/vendor/x.go": False, "a/out/x.js": False, "a/x.pem": False, "a/x-key.pem": True, "a/.venv/x.py": True, "p.egg-info/x": True, "a/x.p8": True, "_netrc": True, "credentials": False, "dist": False, ".env.example": False},
    }
    for f, table in cases.items():
        for given, wanted in table.items():
            assert one.select(f(F.lit(given)).alias("x")).first()["x"] == wanted, (f, given)


def test_staleness(spark):
    base = dict(cached=True, layers_complete=True, snapshots_match=True, build_complete=True, context_stored="c", context_now="c", vcs_known=True, cache_revision="snapshot:p:r", head_revision="r", dirty=False)
    rows = [base, base | {"cached": False}, base | {"context_stored": None}, base | {"cache_revision": "snapshot:p:no-revision"}, base | {"head_revision": "q", "dirty": True}]
    schema = "cached boolean, layers_complete boolean, snapshots_match boolean, build_complete boolean, context_stored string, context_now string, vcs_known boolean, cache_revision string, head_revision string, dirty boolean"
    got = incremental.staleness(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).collect()
    assert [(r["reason"], r["stale"]) for r in got] == [("up-to-date", False), ("no-cache", True), ("build-context-missing", True), ("vcs-unknown", None), ("revision-changed", True)]


def test_stream_of_changes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "path string, sha256 string, version long"
    spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {}
    current = lambda: spark.createDataFrame([("b", "0"), ("z", "9")], "path string, sha256 string")
    q = changes.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), current, lambda df, n: seen.update({r["path"]: r["change"] for r in df.collect()}), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert seen == {"a": "added", "b": "modified"}


def test_manifests():
    assert workspaces.tolerant_json('{"a": "x // y", /* c */ "b": [1, 2,],\n// d\n}') == {"a": "x // y", "b": [1, 2]} and workspaces.tolerant_json("[1]") is None and workspaces.tolerant_json("{") is None
    assert workspaces.condition_targets({"require": "./r.js", "zed": "z.js", "types": {"import": "./t.d.ts", "source": "./s.ts"}, "alpha": "a.js", "default": "./r.js"}) == ["s.ts", "t.d.ts", "r.js", "a.js", "z.js"]
    assert workspaces.split_exports({".": "./i.js", "./sub": {"import": "./sub.js"}, "./null": None}) == (["i.js"], {"sub": ["sub.js"]})
    assert workspaces.split_exports("./x.js") == (["x.js"], {}) and workspaces.split_exports(["a"]) == ([], {})
    assert workspaces.bin_targets({"b": "./b.js", "a": "./a.js", "c": 3}) == ["a.js", "b.js"] and workspaces.bin_targets("./c") == ["c"]
    assert workspaces.pnpm_patterns("x: 1\npackages:\n  - 'a/*' # c\n\n  # d\n  - \"!a/b\"\n  - c # e\nother:\n  - no") == ["a/*", "!a/b", "c"]
    assert workspaces.pnpm_patterns("packages: [a, 'b c', ]") == ["a", "b c"] and workspaces.pnpm_patterns(None) == []
    hits = lambda p, d: bool(re.search(workspaces.folder_pattern(p), "/" + d))
    assert hits("packages/*", "packages/a") and not hits("packages/*", "packages/a/b") and hits("packages/**", "packages/a/b") and hits("./x", "x") and hits("a/**/c", "a/c") and hits("pre-*/q", "pre-1/q")


def test_workspace_packages(spark, tmp_path):
    files = {
        "package.json": '{"name": "root", "workspaces": {"packages": ["packages/*", "!packages/old"]}}', "pnpm-workspace.yaml": "packages:\n  - tools/**\n",
        "packages/ui/package.json": '{"name": "@w/ui", "exports": {".": {"import": "./dist/index.js"}, "./theme": "./dist/theme.js"}, "main": "./dist/index.cjs"}', "packages/ui/src/index.ts": "", "packages/ui/src/theme.tsx": "", "packages/ui/src/deep/x.ts": "",
        "packages/old/package.json": '{"name": "old"}', "packages/bare/package.json": '{"name": "bare", "bin": "./cli.js"}', "packages/bare/index.ts": "", "tools/a/b/package.json": '{"name": "deep"}', "tools/zz/package.json": '{"name": "bare"}',
        "broken/package.json": "{", "node_modules/m/package.json": '{"name": "m"}', "app.ts": "",
    }
    found = spark.createDataFrame(list(files.items()), "path string, text string")
    got = {r["name"]: r for r in workspaces.discover(found, spark.createDataFrame([("linked", "packages/old"), ("bare", "packages/old")], "name string, dir string")).collect()}
    assert {n: r["dir"] for n, r in got.items()} == {"@w/ui": "packages/ui", "bare": "packages/bare", "deep": "tools/a/b", "linked": "packages/old"}
    assert got["@w/ui"]["entries"] == ["packages/ui/dist/index.js", "packages/ui/dist/index.cjs"] and got["bare"]["bin"] == ["packages/bare/cli.js"]
    specs = [("@w/ui", "packages/ui/src/index.ts"), ("@w/ui/theme", "packages/ui/src/theme.tsx"), ("@w/ui/deep/x", "packages/ui/src/deep/x.ts"), ("bare", "packages/bare/index.ts"), ("bare/none", None), ("react", "pkg:react")]
    none = spark.createDataFrame([], "pattern string, ord int, targets array<string>")
    rows = resolve.resolve_specifiers(spark.createDataFrame([("app.ts", s) for s, _ in specs], "file string, specifier string"), found.select("path"), none, workspaces.discover(found), spark.createDataFrame([("packages/ui",)], "root string")).collect()
    assert {r["specifier"]: r["target"] for r in rows} == dict(specs)
    aliases = {}
    for r in workspaces.alias_targets(workspaces.discover(found)).orderBy("pattern", "ord").collect():
        aliases.setdefault(r["pattern"], []).append(r["base"])
    assert aliases["@w/ui/theme"] == ["packages/ui/dist/theme.js", "packages/ui/src/theme", "packages/ui/theme"] and aliases["bare/*"] == ["packages/bare/src/*", "packages/bare/*"]
    (tmp_path / "packages/a").mkdir(parents=True)
    (tmp_path / "node_modules/@s").mkdir(parents=True)
    (tmp_path / "node_modules/@s/a").symlink_to(tmp_path / "packages/a")
    (tmp_path / "node_modules/out").symlink_to("/tmp")
    assert workspaces.links(str(tmp_path)) == [("@s/a", "packages/a")]


def test_settings_files(spark):
    files = [("tsconfig.json", '{"compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["*"], "bad": 3}}}'), ("a/jsconfig.json", '{"compilerOptions": {"baseUrl": "."}}'), ("a/tsconfig.json", "{}"), ("b/jsconfig.json", '{"compilerOptions": {"paths": {"x": ["y"]}}}')]
    got = {r["dir"]: (r["base_url"], dict(r["paths"])) for r in workspaces.nearest_settings(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {".": ("src", {"@/*": ["*"]}), "b": ("b", {"x": ["y"]})}
