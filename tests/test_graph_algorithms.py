"""Traversals and cycles against plain Python on seeded random graphs, and on small fixtures."""

import random

import pytest

from quarry.operators import cycles, traverse
from quarry.plans.frontier import reach


def random_edges(seed, n=30, m=55):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(n):02}", f"n{r.randrange(n):02}") for _ in range(m)})


def bfs(edges, starts, cap=None):
    seen, front, d = {s: 0 for s in starts}, set(starts), 0
    while front and (cap is None or d < cap):
        d += 1
        front = {b for a, b in edges if a in front and b not in seen}
        seen |= dict.fromkeys(front, d)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_and_components(spark, seed):
    edges = random_edges(seed)
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r["node"]: r["depth"] for r in reach(spark.createDataFrame([("n00",), ("n07",)], "node string"), df, max_depth=3).collect()}
    assert got == bfs(edges, ["n00", "n07"], 3)
    nodes = {x for e in edges for x in e}
    far = {v: set(bfs(edges, [v])) for v in nodes}
    mutual = {v: {w for w in far[v] if v in far[w]} for v in nodes}
    expected = {v: min(s) for v, s in mutual.items() if len(s) > 1}
    assert {r["node"]: r["component"] for r in cycles.strong_components(df).collect()} == expected


def test_shortest_path_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e")], "src string, dst string")
    assert [r["node"] for r in traverse.shortest_path(df, "a", "e").orderBy("hop").collect()] == ["a", "b", "d", "e"]
    assert traverse.shortest_path(df, "e", "a").count() == 0


@pytest.mark.parametrize(
    "edges, rings, loops",
    [
        ("ab bc ca", ["a,b,c"], []),
        ("ab bc ac", [], []),
        ("ab ba xy yz zx bx", ["a,b", "x,y,z"], []),
        ("aa bc cb", ["b,c"], ["a"]),
        ("pq qr rp mn nm", ["m,n", "p,q,r"], []),
    ],
)
def test_cycle_fixtures(spark, edges, rings, loops):
    df = spark.createDataFrame([tuple(e) for e in edges.split()], "src string, dst string")
    assert sorted(r["ring"] for r in cycles.find_cycles(df).collect()) == rings
    assert [r["node"] for r in cycles.self_loops(df).collect()] == loops


def test_cycle_weights(spark):
    df = spark.createDataFrame([("ui", "server", 200), ("server", "ui", 1)], "src string, dst string, weight long")
    row = cycles.find_cycles(df, "weight").first()
    assert (row["ring"], row["min_weight"], row["total_weight"]) == ("server,ui", 1, 201)


def test_reexports(spark):
    re = [("index.ts", "a.ts", "star", "*", "*"), ("index.ts", "b.ts", "named", "out", "inner"), ("a.ts", "c.ts", "star", "*", "*")]
    declared = [("a.ts", "x", "sym:a.ts#x"), ("b.ts", "inner", "sym:b.ts#inner"), ("b.ts", "hidden", "sym:b.ts#hidden"), ("c.ts", "deep", "sym:c.ts#deep")]
    out = traverse.entry_reachable(
        spark.createDataFrame(re, "path string, target string, kind string, exported string, declared string"), spark.createDataFrame(declared, "path string, name string, sym string"), spark.createDataFrame([("index.ts",)], "path string")
    )
    assert {r["sym"]: r["hops"] for r in out.collect()} == {"sym:a.ts#x": 1, "sym:b.ts#inner": 1, "sym:c.ts#deep": 2}


@pytest.mark.parametrize("length", [5, 30])
def test_reexport_chains_of_any_length(spark, length):
    chain = [(f"f{k}.ts", f"f{k + 1}.ts", "star", "*", "*") for k in range(length)] + [(f"f{length}.ts", "f0.ts", "star", "*", "*")]
    declared = [(f"f{length}.ts", "deep", f"sym:f{length}.ts#deep")]
    out = traverse.entry_reachable(
        spark.createDataFrame(chain, "path string, target string, kind string, exported string, declared string"), spark.createDataFrame(declared, "path string, name string, sym string"), spark.createDataFrame([("f0.ts",)], "path string")
    )
    assert [(r["sym"], r["entry"], r["hops"]) for r in out.collect()] == [(f"sym:f{length}.ts#deep", "f0.ts", length)]


def test_reexports_of_the_catalog_at_any_depth(spark):
    """The registered query against a plain walk over the same edges."""
    from quarry import catalog_queries as cq

    sf = "/root/testdata/sf0.001"
    g = cq.catalog_graph(spark, sf)
    after = {}
    for r in g.of("IMPORTS").filter("kind = 'internal'").select("src", "dst").collect():
        after.setdefault(r["src"], set()).add(r["dst"])
    names = {}
    for r in g.symbols.filter("exported").select("path", "id").collect():
        names.setdefault("file:" + r["path"], []).append(r["id"])
    expected = {}
    for entry in sorted(r["path"] for r in g.files.filter("entry_point").select("path").collect()):
        front, far, hops = {"file:" + entry}, {}, 0
        while front:
            far |= dict.fromkeys(front, hops)
            front, hops = {d for f in front for d in after.get(f, ())} - far.keys(), hops + 1
        for f, h in far.items():
            for sym in names.get(f, ()):
                expected.setdefault(sym, (entry, h))
    assert max(h for _, h in expected.values()) > 3
    got = {r["sym"]: (r["entry"], r["hops"]) for r in cq.QUERIES["R8_entry_reachable"](spark, sf).collect()}
    assert got == expected


def test_reexported_namespaces_and_aliases(spark):
    re = [
        ("index.ts", "space.ts", "namespace", "ns", "*"), ("space.ts", "deep.ts", "star", "*", "*"),
        ("index.ts", "mid.ts", "named", "wanted", "inner"), ("mid.ts", "all.ts", "namespace", "inner", "*"), ("mid.ts", "never.ts", "namespace", "other", "*"),
        ("index.ts", "own.ts", "named", "default", "default"), ("own.ts", "behind.ts", "star", "*", "*"), ("own.ts", "behind.ts", "named", "default", "default"),
    ]
    declared = [(p, n, f"sym:{p}#{n}") for p, n in [("space.ts", "a"), ("deep.ts", "b"), ("all.ts", "c"), ("never.ts", "d"), ("own.ts", "real"), ("own.ts", "hidden"), ("behind.ts", "default"), ("behind.ts", "real")]]
    out = traverse.entry_reachable(
        spark.createDataFrame(re, "path string, target string, kind string, exported string, declared string"), spark.createDataFrame(declared, "path string, name string, sym string"), spark.createDataFrame([("index.ts",)], "path string"),
        aliases=spark.createDataFrame([("own.ts", "default", "real")], "path string, exported string, declared string"),
    )
    assert {r["sym"]: r["hops"] for r in out.collect()} == {"sym:space.ts#a": 1, "sym:deep.ts#b": 2, "sym:all.ts#c": 2, "sym:own.ts#real": 1}
