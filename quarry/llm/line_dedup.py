"""Line dedup by overlapping windows of three lines.

Each three consecutive lines of a document are hashed; of equal windows anywhere
in the corpus the first, by doc_id and line, stays, and the lines that a later
one covers are removed. Overlapping windows merge by the union of their lines.

Only DataFrame functions. A window is two 64-bit hashes; windows are aggregated
per hash before and after their shuffle, and only those that occur twice are
joined back. Text is dealt once, by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh

LINES = 3


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), at (first line, from 0) and two hashes of every window."""
    lines = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines"))
    three = ", ".join(f"get(lines, i + {k})" for k in range(LINES))
    hashed = F.expr(f"transform(sequence(0, size(lines) - {LINES}), i -> struct(i as at, xxhash64({three}) as a, xxhash64(1, {three}) as b))")
    return lines.filter(F.size("lines") >= LINES).select("doc_id", "th", F.explode(hashed).alias("w")).select("doc_id", "th", "w.at", "w.a", "w.b")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, th and the covered lines, in an array, of documents with later occurrences."""
    w = windows(docs)
    place = F.struct("doc_id", "th", "at")
    first = w.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("a", "b", "first")
    later = w.join(first, ["a", "b"]).filter(place != F.col("first"))
    covered = F.expr(f"array_distinct(flatten(transform(at, x -> sequence(x, x + {LINES - 1}))))")
    return later.groupBy("doc_id", "th").agg(F.collect_set("at").alias("at")).select("doc_id", "th", covered.alias("covered"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of `docs`, with the remaining text, and n_lines, n_removed.

    Lines are parted by \\n alone. A text of fewer than three lines has no window
    and stays; a null text stays null, with no lines; an empty text is one empty
    line. Rows that repeat both doc_id and text are one document: all get the
    same result. Rows of one doc_id with other texts follow each other by the
    hash of their texts. A null doc_id counts as the smallest. An empty table
    gives none. Further columns stay as they are, whatever their names: where
    `docs` has an n_lines or n_removed of its own (in any case of letters), the
    count beside it gets an underscore behind its name.
    """
    names = docs.columns
    gone = repeated(docs).select(F.col("doc_id").alias("doc"), "th", "covered")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("row"), F.col("doc_id").cast("long").alias("of"), F.col("text").alias("was"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    joined = rows.join(gone, (F.col("key") == F.col("th")) & F.col("of").eqNullSafe(F.col("doc")), "left").withColumn("lines", F.split("was", "\n", -1))
    keep = "array_join(transform(array_except(sequence(0, size(lines) - 1), covered), i -> get(lines, i)), '\\n')"
    left = F.when(F.col("covered").isNull(), F.col("was")).otherwise(F.expr(keep))
    n_lines = F.when(F.col("was").isNull(), 0).otherwise(F.size("lines")).cast("long").alias(fresh("n_lines", names))
    n_removed = F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long").alias(fresh("n_removed", names))
    return joined.select(*[(left if c == "text" else F.col("row").getField(c)).alias(c) for c in names], n_lines, n_removed)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the hash of what is left of each document."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select(F.col("doc_id").cast("long"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Of the documents with the text that is left, as a table `deduped` (doc_id, n_lines, n_removed, kept).
SQL_STEPS = """
lines as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as i, len(l) as n from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from {source})),
three as (select doc_id, i, case when i + 2 <= n then list(line) over (partition by doc_id order by i rows between current row and 2 following) end as win from lines),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by win order by doc_id, i) as k from three where win is not null) where k > 1),
covered as (select distinct doc_id, i + k as i from later, range(3) t(k)),
deduped as (select l.doc_id, count(*) as n_lines, count(c.i) as n_removed, coalesce(string_agg(case when c.i is null then line end, chr(10) order by l.i), '') as kept
  from lines l left join covered c on l.doc_id = c.doc_id and l.i = c.i group by l.doc_id)
"""
SQL = "with " + SQL_STEPS.format(source="documents") + "select doc_id, n_lines, n_removed, sha256(kept) as kept_sha256 from deduped"
