"""Groups of similar sets where many texts are alike: no link is lost, and pairs do not grow with the square of a crowd."""

import random

import numpy as np

from quarry.llm import simhash

from .test_near import brute_groups


def variants(seed, n, size=90, changed=3):
    """Texts of one base that each differ in other words, mostly too much to be linked; a third has a copy of its own with one word more."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base, out = [word() for _ in range(size)], []
    for k in range(n):
        w = list(base)
        for at in r.sample(range(size), changed):
            w[at] = word()
        out += [" ".join(w)] + ([" ".join([*w, word()])] if k % 3 == 0 else [])
    r.shuffle(out)
    return list(enumerate(out))


def grouped(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {x["node"]: x["root"] for x in simhash.similar_groups(df).collect()}
    return {d: found.get(d, d) for d, _ in rows}


def test_crowds_make_few_pairs(spark, monkeypatch):
    rows = variants(5, 300)
    pairs, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda texts, marks, found, *more: pairs.append(found.count()) or verified(texts, marks, found, *more))
    assert grouped(spark, rows) == brute_groups(rows)
    assert sum(pairs) <= 4 * len(rows)


def test_small_places(spark, monkeypatch):
    """All texts of several crowds in place, a few in each place."""
    monkeypatch.setattr(simhash, "CROWD_OF_TEXTS", 1)
    monkeypatch.setattr(simhash, "TEXTS_IN_PLACE", 3, raising=False)
    rows = [t for seed in (1, 2) for _, t in variants(seed, 40)]
    rows = list(enumerate([*rows, "", None, "one two", rows[3].upper(), rows[50]]))
    assert grouped(spark, rows) == brute_groups(rows)


def test_far_fingerprints_are_linked(spark):
    """Similar sets whose fingerprints differ in more bits than first pairs may."""
    r, rows = np.random.default_rng(7), []
    for _ in range(30_000):
        w = ["%x" % x for x in r.integers(0, 1 << 30, 9)]
        x, y = " ".join(w), " ".join(w[:8])
        if (simhash.majority(simhash.shingle_set(x, 5)) ^ simhash.majority(simhash.shingle_set(y, 5))).bit_count() > 22:
            rows += [x, y]
    assert len(rows) >= 4
    rows = list(enumerate(rows))
    want = brute_groups(rows)
    assert len(set(want.values())) == len(rows) // 2
    assert grouped(spark, rows) == want
