"""Extraction, rules, dedup and the classifier: against brute force, fixtures and held-out labels."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quarry.llm import host_paths, line_dedup, pu_quality, quality_ledger, simhash, suffix_dedup
from quarry.llm._components import components
from quarry.llm.suffix_sort import sorted_suffixes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def duck(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    con.execute("create table d as select cast(doc_id as bigint) as doc_id, text from documents; drop view documents; alter table d rename to documents")
    return con.execute(sql)


# HTML ------------------------------------------------------------------------

PAGE = """<html><body class="home header-x"><header><h1>Site</h1></header><div id="wrap"><div class="content post-12"><p>Main text one &eacute; &lt;b&gt; long enough to count as a paragraph, with a <a href=x>link</a>.
</p><div class="sidebar">side</div><ul><li>item a<li>item b</ul><form><p>subscribe</p></form><section class="comments"><p>a reader comment</p></section>tail <b>text</b></div></div>
<div class="cookie-notice">We use cookies</div><aside>x</aside><script>var a = "<p>no</p>";</script><!-- <p>no</p> --></body></html>"""


def test_html_blocks():
    assert host_paths.extract(PAGE) == "Main text one é <b> long enough to count as a paragraph, with a link.\nitem a\nitem b\ntail text"
    for page in (None, "", "   ", "<html></html>", "<nav>only a menu</nav>", "<p", "<!-- open", "<script>x", "<p class=it's>", "<a href=\"x y"):
        assert host_paths.extract(page) == ""
    assert host_paths.extract("plain &amp; simple\n text") == "plain & simple text"
    assert host_paths.host_of("https://u@WWW.a.com:80/x") == "www.a.com" and host_paths.host_of(None) == ""


def test_host_consensus(spark):
    short = "<html><body><div class=main><p>short</p></div><div class=extra><p>" + "not the article but long on this page " * 9 + "</p></div></body></html>"
    usual = "<html><body><div class=main><p>" + "an article of some length " * 9 + "</p></div><div class=extra><p>few</p></div></body></html>"
    rows = [(k, "http://h.org/x", usual) for k in range(5)] + [(5, "http://h.org/y", short), (6, "http://other.org/", short), (7, None, None), (7, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in host_paths.main_text(pages).collect()}
    assert got[5] == "short" and got[6].startswith("not the article") and got[7] == "" and got[0].startswith("an article")
    assert host_paths.main_text(pages).count() == 9 and host_paths.main_text(pages.limit(0)).count() == 0


def test_salted_host_join(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    whole = sorted(map(tuple, host_paths.main_text(pages).collect()))
    monkeypatch.setattr(host_paths, "BROADCAST_HOSTS", 0)
    assert sorted(map(tuple, host_paths.main_text(pages).collect())) == whole
    for (_, _, text, n), r in zip(whole, pages.orderBy("page_id").collect()):
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        assert n == len(text) and len(text) > 0.5 * len(re.sub("<[^>]*>", "", body))


# rules and lines ---------------------------------------------------------------


def test_rules_match_sql(odd, empty, documents):
    for docs in (odd, documents):
        got = quality_ledger.verdicts(docs)
        answer = duck(quality_ledger.SQL, docs)
        names = [d[0] for d in answer.description]
        assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == sorted(answer.fetchall(), key=repr)
    assert quality_ledger.verdicts(empty).count() == 0


def test_repeat_words_by_hand(spark):
    eight = "a b c d e f g h"
    rows = [(1, eight + " x " + eight), (2, eight), (3, " ".join(["z"] * 12)), (4, eight + " " + eight + " " + eight)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_ledger.measurements(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 16, 2: 0, 3: 12, 4: 24}


def test_policies_and_ablation(documents):
    book = quality_ledger.ledger(documents).persist()
    rows = book.collect()
    for p in (quality_ledger.STANDARD, quality_ledger.BASE_POLICY):
        assert quality_ledger.apply_policy(book, p).filter("kept").count() == sum(not r["failed"] & p.mask for r in rows)
        for a in quality_ledger.ablation(book, p).collect():
            bit = quality_ledger.BIT[a["rule"]]
            masks = [r["failed"] & p.mask for r in rows]
            assert (a["rejected"], a["rejected_alone"], a["kept"]) == (sum(bool(m & bit) for m in masks), sum(m == bit for m in masks), sum(not m for m in masks))


def brute_lines(docs):
    """Rows of one id and text are one document; others follow by id."""
    seen, out = set(), {}
    for d, t in sorted({(d, t) for d, t in docs}, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = (t or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out[d, t] = None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup(odd, empty, documents, spark):
    extra = spark.createDataFrame([(20, "1\n2\n3\n1\n2\n3\n4"), (21, "9\n1\n2\n3"), (22, "a\na\na\na\na"), (None, "9\n1\n2\n3"), (20, "1\n2\n3\n1\n2\n3\n4"), (23, "\n\n\n\n")], "doc_id long, text string")
    for docs in (documents.select("doc_id", "text"), extra):
        expected = brute_lines([tuple(r) for r in docs.collect()])
        got = line_dedup.dedup_lines(docs.withColumnRenamed("text", "text"))
        want = sorted(((r["doc_id"], hashlib.sha256((expected[r["doc_id"], r["text"]] or "").encode()).hexdigest()) for r in docs.collect()), key=repr)
        have = sorted(((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in got.collect()), key=repr)
        assert have == want
    done = line_dedup.dedup_lines(odd)
    assert done.count() == odd.count() and set(odd.columns) < set(done.columns)
    assert done.filter("doc_id = 1").first()["text"] is None
    assert line_dedup.dedup_lines(empty).count() == 0
    answer = sorted(duck(line_dedup.SQL, documents).fetchall())
    names = ["doc_id", "n_lines", "n_removed", "kept_sha256"]
    assert sorted(tuple(r[c] for c in names) for r in line_dedup.digests(documents).collect()) == answer


# SimHash -----------------------------------------------------------------------


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [] if not w else [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash(odd, empty, documents):
    for docs in (odd, documents):
        rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()]
        roots = brute_roots({f for _, f in rows})
        least = {}
        for d, f in rows:
            if d is not None:
                least[roots[f]] = min(d, least.get(roots[f], d))
        expected = sorted(((d, f"{f:016x}", least.get(roots[f])) for d, f in rows), key=repr)
        assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr) == expected
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns


@pytest.mark.parametrize("crowd", [1, 4, 64])
def test_links_of_crowds(spark, monkeypatch, crowd):
    """However many fingerprints share a key, components are those of all pairs."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r = random.Random(crowd)
    fps = set()
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(25):
            y = x
            for _ in range(r.randrange(5)):
                y ^= 1 << r.randrange(64)
            fps.add(y)
            x = y if r.random() < 0.3 else x
    fps |= {0, (1 << 64) - 1, 7, 15}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = components(simhash.links(df))
    group = {r["node"]: r["root"] for r in got.collect()}
    roots = brute_roots(fps)
    sets = {}
    for f in fps:
        sets.setdefault(roots[f], set()).add(signed(f))
    have = {}
    for f in fps:
        have.setdefault(group.get(signed(f), signed(f)), set()).add(signed(f))
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, have.values()))


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {v: v for p in pairs for v in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: find(v) for p in pairs if p[0] != p[1] for v in p}


# suffixes ------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=12), min_size=1, max_size=12), st.integers(1, 3))
def test_suffix_sort(texts, groups):
    group = np.sort(np.arange(len(texts)) % groups)
    raw = "".join(texts).encode() or b"x"
    sizes = np.array([len(t) for t in texts])
    order, common = sorted_suffixes(np.frombuffer(raw, np.uint8), np.cumsum(sizes) - sizes, sizes, group)
    assert [(group[i], texts[i]) for i in order] == sorted((group[i], t) for i, t in enumerate(texts))
    for p, q, c in zip(order, order[1:], common[1:]):
        n = next((k for k, (x, y) in enumerate(zip(texts[p], texts[q])) if x != y), min(len(texts[p]), len(texts[q])))
        assert c == (n if group[p] == group[q] else -1)


def brute_removals(rows, length=100):
    """Documents of one id are not earlier than each other."""
    first = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    key = lambda d: (d is not None, d or 0)
    for d, raw in raws:
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            first.setdefault(w, set()).add((key(d), s, raw))
    best = {w: min((k for k, _, _ in v)) for w, v in first.items()}
    out = []
    for d, raw in raws:
        cover = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if best[w] < key(d) or any(k == key(d) and r == raw and x < s for k, x, r in first[w]):
                cover[s : s + length] = b"\1" * length
        spans = sum(1 for i, c in enumerate(cover) if c and (not i or not cover[i - 1]))
        out.append((d, len(raw), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(raw, cover) if not c)).hexdigest()))
    return sorted(out, key=repr)


def passages(seed, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9)))
    shared = [" ".join(word() for _ in range(r.randrange(10, 60))) for _ in range(4)]
    docs = []
    for d in range(n):
        parts = [" ".join(word() for _ in range(r.randrange(5, 40))) for _ in range(3)]
        for s in shared:
            if r.random() < 0.6:
                cut = r.randrange(len(s) // 2)
                parts.insert(r.randrange(len(parts)), s[cut:] if r.random() < 0.5 else s)
        docs.append((d, " ".join(parts)))
    docs += [(n, docs[0][1]), (n + 1, docs[0][1][:-5] + "!"), (n + 2, "ab" * 400), (n + 3, "x" * 99), (n + 4, "y" * 100), (n + 5, "y" * 101)]
    return docs


@pytest.mark.parametrize("seed, kinds, chunk, length, gram", [(1, 1000, 2 << 20, 100, 32), (2, 2, 2 << 20, 100, 32), (3, 1000, 700, 150, 16), (4, 5, 300, 60, 8), (5, 3, 4 << 20, 300, 20)])
def test_removals(spark, monkeypatch, seed, kinds, chunk, length, gram):
    """Also where a k-gram's rows are split over blocks, and texts over chunks, and with other lengths."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 60)
    docs = passages(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in suffix_dedup.removals(df, kinds=kinds, length=length, gram=gram).collect()), key=repr)
    assert got == brute_removals(docs, length) and sum(r[2] for r in got) > 0


def test_ids_that_repeat_with_other_texts(spark):
    """Texts of one id are not earlier than each other, but each is earlier than its own later part."""
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    p, q = word(140), word(120)
    docs = [(1, p + word(30) + p), (1, word(10) + p + word(40) + p + q), (2, q + p), (None, q), (2, q + p), (3, None), (1, p)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for kinds in (1000, 2):
        assert sorted((tuple(x) for x in suffix_dedup.removals(df, kinds=kinds).collect()), key=repr) == brute_removals(docs)


def test_rows_that_met_by_accident_stay_apart():
    """Rows of one group whose bytes differ are no repeats; equal ones are, at each place of the k-gram."""
    texts = [b"x" * 40 + b"same" * 20, b"y" * 40 + b"same" * 20, b"x" * 40 + b"same" * 20, b"other bytes" * 11]
    at = suffix_dedup.pack_place(np.zeros(4, np.int64), np.full(4, 40), np.array([len(t) for t in texts]))
    exists, repeated = suffix_dedup.repeats_in_block(np.zeros(4, np.int64), np.arange(4), np.zeros(4, np.int64), at, texts, 100, 32)
    assert (repeated[2] == exists[2]).all() and exists[2].sum() == 21 and not repeated[[0, 1, 3]].any()


def test_removals_of_odd_rows(odd, empty):
    plain = odd.select("doc_id", "text")
    got = sorted((tuple(r) for r in suffix_dedup.removals(odd).collect()), key=repr)
    assert got == brute_removals([tuple(r) for r in plain.collect()])
    assert suffix_dedup.removals(empty).count() == 0
    done = suffix_dedup.dedup_text(odd)
    assert done.columns == odd.columns and done.count() == odd.count()


def test_cut_keeps_whole_characters():
    raw = "aéb".encode()
    assert suffix_dedup.cut(raw, [(2, 4)]) == "aé" and suffix_dedup.cut(raw, [(0, 2)]) == "éb" and suffix_dedup.cut(raw, [(0, 4)]) == ""


# classifier -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def fitted(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return docs, labels, pu_quality.train(docs, labels)


def test_bad_labels_are_not_read(fitted):
    """The fit is the same without the labels that are not good, and the prior is near their share."""
    docs, labels, model = fitted
    again = pu_quality.train(docs, labels.withColumn("quality", F.when(F.col("quality") == 1, 1)))
    assert np.array_equal(again.weights, model.weights) and again.prior == model.prior
    assert abs(model.prior - labels.filter("quality = 1").count() / labels.count()) < 0.08


def test_disorder_and_gibberish_score_low(fitted):
    docs, labels, model = fitted
    r = random.Random(4)
    good = [x["text"] for x in docs.join(labels.filter("quality = 1"), "doc_id").filter(pu_quality.held_out() & (F.length("text") > 300)).select("text").collect()]
    shuffled = [" ".join(r.sample(t.split(), len(t.split()))) for t in good]
    gibberish = [" ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(80)) for _ in good]
    scores = [model.scores(pu_quality.measures(x, model.grams)) for x in (good, shuffled, gibberish)]
    assert (scores[0] >= 0.3).mean() >= 0.97 and (scores[1] < 0.3).mean() >= 0.75 and (scores[2] < 0.3).all()


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_class_prior_of_mixtures(share):
    """Of classes that overlap a little; no label of the mixture is seen."""
    r = np.random.default_rng(int(share * 100))
    n = len(pu_quality.MEASURES)
    positive, good = r.normal(1, 1, (2000, n)), r.normal(1, 1, (int(3000 * share), n))
    bad = r.normal(1, 1, (3000 - len(good), n))
    bad[:, :4] -= 3
    assert abs(pu_quality.class_prior(positive, r.permutation(np.concatenate([good, bad]))) - share) < 0.06


def test_classifier_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = pu_quality.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    right = [int(r["score"] >= 0.3) == r["quality"] == r["predicted"] for r in held]
    assert len(held) > 40 and sum(right) / len(right) >= 0.97
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_risk_never_goes_negative():
    r = np.random.default_rng(0)
    positive = r.normal(1, 1, (300, len(pu_quality.MEASURES)))
    other = np.concatenate([r.normal(1, 1, (400, len(pu_quality.MEASURES))), r.normal(-1, 1, (400, len(pu_quality.MEASURES)))])
    m = pu_quality.fit(positive, other, 0.5)
    s = m.scores(other)
    assert (s[:400] >= 0.5).mean() > 0.9 and (s[400:] < 0.5).mean() > 0.9
    assert np.array_equal(pu_quality.fit(positive, other, 0.5).weights, m.weights)


def test_classifier_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(6, 1, 0), (6, None, 0), (5, 0, 0), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    out = pu_quality.classify(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert pu_quality.classify(empty, labels).count() == 0
    assert pu_quality.classify(odd, labels.limit(0)).count() == odd.count()
    assert pu_quality.accepted(odd, labels).columns == odd.columns
