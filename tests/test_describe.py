"""Targets and their hashes, runs with budgets and failures, stamps, pages in two languages, files over HTTP."""

import json
import urllib.error
import urllib.request
from threading import Thread

import pytest

from quarry import answers, describe, render, stamps
from quarry.operators.windows import unique_slugs
from quarry.sources import jsonl

from .test_tools import small  # noqa: F401


def test_targets(small):  # noqa: F811
    rows = {r["id"]: r for r in describe.targets(small, "all").collect()}
    assert len(rows) == 4 + 7 + 6
    facts = json.loads(rows["file:maths/angle.ts"]["facts"])
    assert facts["importedBy"] == {"count": 2, "files": ["optics/lens.ts", "sky/stars.ts"]} and facts["exports"] == [{"name": "radians", "refs": 2}, {"name": "degrees", "refs": 0}] and facts["domain"] == "maths"
    assert json.loads(rows["domain:sky"]["facts"])["dependsOn"] == [{"name": "maths", "n": 1}, {"name": "optics", "n": 1}] and rows["domain:sky"]["rank"] == 3
    assert json.loads(rows["sym:maths/angle.ts#radians"]["facts"])["referencedBy"]["count"] == 2
    top = describe.targets(small, "files", 2).orderBy("position").collect()
    assert [r["id"] for r in top] == ["file:maths/angle.ts", "file:sky/stars.ts"]
    spark = small.edges.sparkSession
    cached = spark.createDataFrame([(top[0]["id"], top[0]["content_hash"], "old"), (top[1]["id"], "other", "old"), ("file:gone.ts", "h", "old")], "targetId string, contentHash string, text string")
    assert [r["id"] for r in describe.stale(describe.targets(small, "files", 2), cached).collect()] == ["file:sky/stars.ts"]
    done = spark.createDataFrame([(top[1]["id"], top[1]["content_hash"], "new")], "targetId string, contentHash string, text string")
    assert {r["targetId"]: r["text"] for r in describe.merged(cached, done, small).collect()} == {top[0]["id"]: "old", top[1]["id"]: "new"}


def test_runs():
    pending = [{"kind": "file", "id": f"file:{k}", "name": str(k), "facts": json.dumps({"path": str(k), "imports": {"internal": []}}), "content_hash": "h"} for k in range(5)]
    asked = []

    def ask(text):
        asked.append(text)
        if "file: 1\n" in text:
            raise RuntimeError("no answer")
        return "  It is\n a file. "

    provider = describe.Provider(ask, "m", prices=(1.0, 2.0))
    done = describe.run(pending, provider, now="t")
    assert [r["targetId"] for r in done.rows] == ["file:0", "file:2", "file:3", "file:4"] and done.rows[0]["text"] == "It is a file." and done.failures == [{"targetId": "file:1", "error": "no answer"}]
    assert "imports: internal none" in asked[0] and done.stopped_by is None
    few = describe.run(pending, provider, budget_items=2)
    assert (len(few.rows), few.stopped_by, few.remaining) == (2, "items", 2)
    tight = describe.run(pending, provider, budget_tokens=done.tokens // 4)
    assert (len(tight.rows), tight.stopped_by, tight.remaining) == (1, "tokens", 4) or (len(tight.rows), tight.stopped_by) == (1, "tokens")
    assert describe.run(pending[:1], describe.Provider(lambda _: " ")).failures
    cost = describe.price(asked[:2], provider)
    assert cost["items"] == 2 and cost["output_tokens"] == 400 and cost["dollars"] == pytest.approx((cost["input_tokens"] + 800) / 1e6) and describe.price([], describe.Provider(ask))["dollars"] is None


def test_stamps(tmp_path):
    cache = str(tmp_path / "c")
    assert stamps.read_stamp(cache) is None
    made = stamps.build(cache, "/r", {"a": lambda: None, "b": lambda: None}, {"a": "1", "b": "2"})
    assert made["complete"] and stamps.read_stamp(cache)["contexts"] == {"a": "1", "b": "2"}

    def fail():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        stamps.build(cache, "/r", {"a": fail}, {"a": "3"})
    assert stamps.read_stamp(cache) == {"version": "1", "root": "/r", "complete": False, "contexts": {"b": "2"}}
    (tmp_path / "c/build.json").write_text("{")
    assert stamps.read_stamp(cache) is None
    shared, made = stamps.SharedOnce(), []
    for key in (1, 1, 2):
        shared.get(key, lambda: made.append(key) or key)  # noqa: B023
    assert made == [1, 2]


def test_static_server(tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "root/a.txt").write_text("inside")
    (tmp_path / "out.txt").write_text("outside")
    (tmp_path / "root/link").symlink_to(tmp_path / "out.txt")
    server = stamps.static_server(str(tmp_path / "root"))
    Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        assert urllib.request.urlopen(f"{at}/a.txt").read() == b"inside"
        for path in ("/link", "/../out.txt", "/%2e%2e/out.txt"):
            with pytest.raises(urllib.error.HTTPError):
                urllib.request.urlopen(at + path)
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(urllib.request.Request(f"{at}/a.txt", method="PUT"))
    finally:
        server.shutdown()
        server.server_close()


def test_flags_and_languages(small):  # noqa: F811
    assert answers.resolve_compress({"no_compress_paths": True, "compress_paths": True}, True) is False and answers.resolve_compress({}, True) and not answers.resolve_compress({}, None)
    assert answers.resolve_max_tokens({"max_tokens": "12"}, 5) == 12 and answers.resolve_max_tokens({}, 5) == 5 and answers.resolve_max_tokens({}) is None
    for bad in (0, -1, "x", True, 1.5):
        with pytest.raises(ValueError):
            answers.resolve_max_tokens({"max_tokens": bad})
    assert render.translator("ru")("Overview") == "Обзор" and render.translator("xx")("Hi {n}", n=1) == "Hi 1"
    page = render.domain_page(small, "domain:maths", "ru")
    assert "## Файлы" in page and "| file:maths/angle.ts | 2 |" in page and "radians" in page and "degrees" not in page
    assert "| sky |" in render.agents_page(small)
    spark = small.edges.sparkSession
    assert "[sky](domains/sky.md): Looks up." in render.described(spark.createDataFrame([("domain:sky", "Looks up.")], "targetId string, text string"), small)


def test_page_names_are_free(spark):
    """A number that a name has by itself is not given out again."""
    names = ["a b", "a-b", "a-b-2", "a!b", "z", "***", "domain"]
    got = {r["name"]: r["slug"] for r in unique_slugs(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    used, want = set(), {}
    for n in sorted(names):
        slug = {"***": "domain"}.get(n, n.replace(" ", "-").replace("!", "-"))
        free = next(x for x in [slug, *(f"{slug}-{k}" for k in range(2, 9))] if x not in used)
        used.add(free)
        want[n] = free
    assert got == want and len(set(got.values())) == len(names)


def test_json_keys_are_ordered_at_any_depth(spark):
    df = spark.sql("select 'x' as id, named_struct('b', 1, 'a', array(named_struct('d', 2, 'c', 3))) as value, map('z', '1', 'y', '2') as m, cast(null as struct<q:int>) as none")
    assert [r["value"] for r in jsonl.to_lines(df).collect()] == ['{"id":"x","m":{"y":"2","z":"1"},"value":{"a":[{"c":3,"d":2}],"b":1}}']
