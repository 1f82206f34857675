"""Every catalog query against its SQL in DuckDB, on the smallest tables."""

import re

import duckdb
import pytest

from quarry import catalog_queries as cq
from quarry.model import Graph

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    """The graph once, as written tables: what the projection itself costs is not tested a hundred times."""
    folder = tmp_path_factory.mktemp("graph")
    made = cq.catalog_graph(spark, SF)
    parts = {}
    for name in ("files", "symbols", "packages", "domains", "edges"):
        getattr(made, name).write.parquet(f"{folder}/{name}")
        parts[name] = spark.read.parquet(f"{folder}/{name}")
    return Graph(**parts)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(cq.SQL))
def test_query_matches_sql(name, spark, graph, duck, monkeypatch):
    monkeypatch.setattr(cq, "catalog_graph", lambda *_: graph)
    df = cq.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    answer = duck.execute(cq.SQL[name])
    theirs = [d[0] for d in answer.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in answer.fetchall())


def test_path_compression(spark, graph, monkeypatch):
    """Each domain's paths against a plain loop: the folder that saves most, again and again."""
    monkeypatch.setattr(cq, "catalog_graph", lambda *_: graph)
    got = {}
    for r in cq.QUERIES["R13_path_compression"](spark, SF).collect():
        got.setdefault(r["key"], set()).add((r["prefix"], r["rest"]))
    paths = {}
    for r in graph.of("BELONGS_TO").collect():
        paths.setdefault(r["dst"], set()).add(r["src"][5:])
    assert got.keys() == paths.keys() and set(cq.QUERIES) - set(cq.SQL) == {"R13_path_compression"}
    for key, left in paths.items():
        want = set()
        while True:
            folders = {p[: k + 1] for p in left for k, c in enumerate(p) if c == "/"}
            saving = lambda d: (sum(p.startswith(d) for p in left) - 1) * len(d) - 24  # noqa: B023, E731
            good = [d for d in folders if sum(p.startswith(d) for p in left) >= 3 and len(d) >= 4 and saving(d) > 0]
            if not good:
                break
            best = sorted(good, key=lambda d: (-saving(d), -len(d), d))[0]
            want |= {(best, p[len(best) :]) for p in left if p.startswith(best)}
            left = {p for p in left if not p.startswith(best)}
        assert got[key] == want | {("", p) for p in left}


def test_projection_counts(graph):
    assert graph.files.count() == 200
    assert graph.symbols.count() == 1905
    assert graph.of("IMPORTS").filter("kind = 'internal'").count() == 189
    assert graph.of("REFERENCES").count() == 994


def test_whole_texts(spark):
    """Slugs and fragments against plain Python over whole texts."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in cq.QUERIES["F13_F26_text"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        flat = re.sub(r"\s+", " ", t, flags=re.ASCII).strip(" ")
        assert got[k]["slug"] == (re.sub("[^A-Za-z0-9_.-]+", "-", t).strip("-") or "domain")
        assert got[k]["fragment"] == (flat if len(flat) <= 80 else flat[:79] + "…")
    assert max(len(r["slug"]) for r in got.values()) > 40


def test_lines_of_every_text(spark, tmp_path):
    """Texts that are empty, short, null or begin with marks and blanks have rows too."""
    texts = {1: "", 2: None, 3: "one", 4: "a\nb", 5: "\n\n  // x  y */\nz", 6: "/**", 7: "é\nb\nc\nd\ne", 8: " * " + "w" * 70}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda name: {r[0]: r[1] for r in cq.QUERIES[name](spark, str(tmp_path)).select("doc_id", "part" if name.startswith("P15") else "line").collect()}
    assert rows("P15_slice_lines") == {1: "", 2: None, 3: "", 4: "b", 5: "\n  // x  y */\nz", 6: "", 7: "b\nc\nd", 8: ""}
    assert rows("P16_first_doc_line") == {1: "", 2: "", 3: "one", 4: "a", 5: "x y", 6: "", 7: "é", 8: "w" * 59 + "…"}
    for name in ("P15_slice_lines", "P16_first_doc_line"):
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        assert dict(con.execute(cq.SQL[name]).fetchall()) == rows(name)
