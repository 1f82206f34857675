"""The pipeline's stages on the smallest tables, each against what its operator must do to its own input."""

import corpus_pipeline
import pytest

from quarry.llm import pu_quality

from .test_codecs import check_packed
from .test_documents import SF, brute_lines, brute_removals
from .test_near import brute_groups


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave, as rows."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs.collect(), after.collect(), docs.columns, after.columns)
        docs = after
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    for name in list(stages)[:-1]:
        assert stages[name][3] == ["doc_id", "text", "lang", "source", "n_chars"]
        assert all(r["n_chars"] == len(r["text"]) for r in stages[name][1])


def test_quality_stage(stages, spark):
    """The documents that stay are those that the model scores so, whose labels are nearly all good."""
    before, after, *_ = stages["quality_classifier"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = pu_quality.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    scores = model.scores(pu_quality.measures([r["text"] for r in before], model.grams))
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r, s in zip(before, scores) if s >= 0.3)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    kept = {r["doc_id"] for r in after}
    wrong = [d for d, q in quality.items() if (d in kept) != (q == 1)]
    assert len(wrong) <= 0.05 * len(quality) and len(kept) < len(before) and pu_quality.THRESHOLD == 0.3


def test_line_stage(stages):
    before, after, *_ = stages["line_dedup"]
    expected = brute_lines([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"]: r["text"] for r in after} == {d: t for (d, _), t in expected.items()}


def test_near_stage(stages):
    before, after, *_ = stages["simhash_near_dedup"]
    groups = brute_groups([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(set(groups.values()))


def test_suffix_stage(stages):
    before, after, *_ = stages["suffix_array_dedup"]
    removed = {d: (n, gone) for d, n, gone, _, _ in brute_removals([(r["doc_id"], r["text"]) for r in before])}
    assert len(after) == len(before)
    for r in after:
        n, gone = removed[r["doc_id"]]
        assert n - gone <= len(r["text"].encode()) <= n - gone + 6 * (gone > 0) + 3 * gone // 100


def test_packing_stage(stages, spark):
    """Every id of every document in its place, and no more sequences than the bound and one."""
    before, after, *_ = stages["best_fit_packing"]
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string")
    n, total = check_packed(docs, after)
    assert n <= -(-total // 2048) + 1
    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.run is not None


def test_run_is_the_stages(stages, spark):
    """`run` gives what the stages give one after another."""
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages["best_fit_packing"][1]))
