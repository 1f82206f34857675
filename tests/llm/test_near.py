"""Groups of similar word-shingle sets against brute force, and caller columns that no operator may touch."""

import random

import numpy as np
import pytest

from quarry.llm import line_dedup, pu_quality, simhash, suffix_dedup

from .test_documents import WORD


def brute_groups(rows, words=5, similarity=0.8):
    """Smallest doc_id of each document's group, by all pairs."""
    sets = []
    for d, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((d, {" ".join(w)} if len(w) <= words else {" ".join(w[k : k + words]) for k in range(len(w) - words + 1)}))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if min(len(x), len(y)) >= similarity * max(len(x), len(y)) and len(x & y) >= similarity * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in root}


def copies(seed):
    """Clusters of texts with more and more words changed, a crowd among them, and texts that share a passage only."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    out = []
    passage = [word() for _ in range(60)]
    for size, n in ((1, 3), (4, 4), (7, 8), (12, 8), (30, 10), (120, 12), (400, 6), (90, 90)):
        base = [word() for _ in range(size)]
        for _ in range(n):
            w = list(base)
            for _ in range(r.randrange(0, 2 + size // 40)):
                w[r.randrange(size)] = word()
            out.append(" ".join(w[r.randrange(0, 1 + size // 30) :]))
    out += [" ".join([*(word() for _ in range(40)), *passage, *(word() for _ in range(r.randrange(60)))]) for _ in range(30)]
    out += [" ".join(passage), "", None, "  ", "\n", out[5], out[5].upper(), out[40]]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(simhash, "FANOUT", 16)
    rows = copies(seed)
    want = brute_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["node"]: x["root"] for x in simhash.similar_groups(df).collect()}
    assert {d: got.get(d, d) for d, _ in rows} == want
    assert sorted(x["doc_id"] for x in simhash.representatives(df).collect()) == sorted(set(want.values()))


def test_groups_of_documents(documents):
    rows = [(x["doc_id"], x["text"]) for x in documents.collect()]
    want = brute_groups(rows)
    assert sorted(x["doc_id"] for x in simhash.representatives(documents).collect()) == sorted(set(want.values()))


def test_close_sets_share_a_block():
    r = np.random.default_rng(3)
    for _ in range(1500):
        a = r.integers(0, 1 << 63, int(r.integers(1, 500))).astype(np.uint64)
        b = np.concatenate([a[int(len(a) * r.uniform(0, 0.2)) :], r.integers(0, 1 << 63, int(len(a) * r.uniform(0, 0.2))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if simhash.jaccard(a, b) >= 0.8:
            assert len(np.intersect1d(simhash.block_keys(a), simhash.block_keys(b)))


def test_groups_of_odd_rows(odd, empty, spark):
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    ids = sorted((x["doc_id"] for x in kept.collect()), key=repr)
    # 1 to 4 have no words; 6 (three rows, one in upper case) and 7 have equal ones, 8 one shingle more; 11 and 15 have equal ones
    assert ids == sorted([1, 5, 6, 6, 6, 9, 10, 11, 12, 13, 14, None, None], key=repr)
    assert simhash.representatives(empty).count() == 0


def test_caller_columns_keep_their_values(spark, documents):
    """Columns named like everything that the operators use inside stay as they are."""
    names = ["covered", "_th", "th", "_key", "key", "_lines", "lines", "row", "was", "of", "doc", "N_LINES", "n_removed", "_k", "k", "_new", "new", "_doc", "_doc2", "w", "_keep", "node", "root", "fp", "score", "Predicted", "a", "b", "n", "begin", "block", "k.at"]
    rows = [(d, t, *(f"{c}-{d}" for c in names)) for d, t in documents.limit(60).select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    labels = spark.createDataFrame([(r[0], k % 2, 0) for k, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    done = {
        "lines": line_dedup.dedup_lines(docs),
        "suffix": suffix_dedup.dedup_text(docs),
        "near": simhash.representatives(docs),
        "quality": pu_quality.accepted(docs, labels),
        "scores": pu_quality.score(docs, pu_quality.train(docs, labels)),
    }
    for what, df in done.items():
        assert df.columns[: len(docs.columns)] == docs.columns, what
        for r in df.collect():
            assert all(r[c] == f"{c}-{r['doc_id']}" for c in names), what
    assert done["lines"].columns[-2:] == ["n_lines_", "n_removed_"] and done["scores"].columns[-2:] == ["score_", "predicted_"]
