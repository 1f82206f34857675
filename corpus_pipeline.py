"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import line_dedup, packing, pu_quality, simhash, suffix_dedup
from quarry.llm._shared import table, written
from quarry.llm.queries import WORD_FILE
from quarry.plans.shipping import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    It is fitted on `labels` and on `docs` outside of them; a null or empty text
    is scored like any other; repeated rows are each judged alike. No labels, or
    an empty table, reject nothing.
    """
    return pu_quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; documents stay, also with nothing left.

    A null text stays null; rows that repeat whole get the same result; n_chars
    follows the text; an empty table gives none.
    """
    done = line_dedup.dedup_lines(docs)
    return done.select(*[(F.char_length("text").cast("long") if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id.

    Near copies share four fifths of their five-word shingles, on whole texts, or
    are connected by such. Documents without words are copies of each other; rows
    of a null doc_id stay; an empty table gives none.
    """
    ship(spark)
    return simhash.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of later repeats of 100 bytes go; documents stay, also with nothing left.

    Characters of which only some bytes repeat stay whole; n_chars follows the
    text; nulls, repeated rows and empty tables are as in `suffix_dedup.removals`.
    """
    ship(spark)
    return suffix_dedup.dedup_text(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences; a null or empty text is its end id alone, an empty table has no pieces."""
    ship(spark)
    return packing.packed_documents(docs, WORD_FILE, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_windows),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier is fitted, so no SQL gives these rows; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
