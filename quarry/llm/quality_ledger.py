"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document; the ledger keeps the measurements and
one integer whose bit k says that rule k failed. A policy is a version name with
a mask of rules, so a new policy, or what leaving a rule out would change, needs
no text: it is a bitwise operation on the ledger.

Only DataFrame functions: all arrays stay within one row, nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
#: Bits in order. A rule's text is a condition of failure over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 6 * n_lines"),
    ("long_words", "word_chars > 14 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("shouting", "4 * n_shouts > n_words"),
    ("echoes", "2 * n_echoes > n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]


@dataclass(frozen=True)
class Policy:
    version: str
    mask: int


def policy(version: str, *rules: str) -> Policy:
    return Policy(version, sum(BIT[r] for r in rules))


BASE_POLICY = policy("base", "few_words", "repeated_words")
STANDARD = policy("standard-1", *BIT)


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text.

    Words are runs of anything but ASCII white space. A null text has none; an
    empty line is no line of `n_lines`, and of equal lines all but the first are
    duplicates. A word within any window of eight words that the text has twice
    counts as repeated, the first window's included. `n_shouts` counts words that
    end in two exclamation marks, `n_echoes` words equal to the word before. Repeated rows each give a row, a null doc_id is
    kept, an empty table gives none, further columns are not read.
    """
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    cut = text.select(
        "doc_id",
        F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')").alias("words"),
        F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        F.expr("char_length(text) - char_length(regexp_replace(text, '[#*$%&|<>]', ''))").alias("n_symbols"),
    )
    hashed = cut.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.expr("aggregate(words, 0L, (n, w) -> n + char_length(w))").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("cast(size(filter(words, w -> w like '%!!')) as long)").alias("n_shouts"),
        F.expr("transform(words, w -> xxhash64(w))").alias("h"),
    )
    inner = ", ".join(f"get(h, i + {k})" for k in range(WINDOW))
    windows = hashed.withColumn("win", F.expr(f"if(size(h) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({inner})))")).withColumn("n_echoes", F.expr("cast(size(filter(h, (x, i) -> x = get(h, i - 1))) as long)")).drop("h")
    # a text without an equal pair of windows, as most are, needs no sorting
    ordered = windows.withColumn("s", F.expr("if(size(array_distinct(win)) = size(win), null, array_sort(transform(win, (v, i) -> struct(v as v, i as i))))")).drop("win")
    twice = ordered.withColumn("p", F.expr("array_sort(transform(filter(s, (x, k) -> get(s, k - 1).v <=> x.v or get(s, k + 1).v <=> x.v), x -> x.i))")).drop("s")
    covered = f"coalesce(aggregate(transform(p, (x, k) -> least({WINDOW}, coalesce(get(p, k + 1) - x, {WINDOW}))), 0L, (n, x) -> n + x), 0L)"
    return twice.withColumn("n_repeat_words", F.expr(covered)).drop("p")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and `failed`, the bits of all rules that failed."""
    bits: Column = F.lit(0).cast("long")
    for name, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measurements(docs).withColumn("failed", bits)


def apply_policy(book: DataFrame, chosen: Policy = STANDARD) -> DataFrame:
    """Add `policy` and `kept`: no rule of the policy failed."""
    return book.withColumn("policy", F.lit(chosen.version)).withColumn("kept", F.col("failed").bitwiseAND(F.lit(chosen.mask)) == 0)


def ablation(book: DataFrame, chosen: Policy = STANDARD) -> DataFrame:
    """Per rule of the policy: documents that it rejects, that it alone rejects (kept if the rule is left out), and that stay.

    One aggregation over masks: the ledger is first grouped by its bits, of which
    there are at most 2 to the number of rules.
    """
    masks = book.groupBy(F.col("failed").bitwiseAND(F.lit(chosen.mask)).alias("m")).agg(F.count("*").alias("n"))
    named = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if bit & chosen.mask])
    return (
        masks.select(F.explode(named).alias("r"), "m", "n")
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("m").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("rejected"),
            F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("rejected_alone"),
            F.sum(F.when(F.col("m") == 0, F.col("n")).otherwise(0)).alias("kept"),
        )
    )


def verdicts(docs: DataFrame, chosen: Policy = STANDARD) -> DataFrame:
    book = apply_policy(ledger(docs), chosen)
    base_failed = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & F.col("kept")).alias("kept"), "failed")


SQL = r"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
words as (select r, unnest(w) as w, generate_subscripts(w, 1) as i from (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from docs)),
per as (select r, count(*) as n_words, sum(length(w)) as word_chars, count(*) filter (w like '%!!') as n_shouts from words group by r),
win as (select r, i, case when count(*) over eight = 8 then list(w) over eight end as win from words window eight as (partition by r order by i rows between current row and 7 following)),
twice as (select r, i, count(*) over (partition by r, win) as n from win where win is not null),
echoes as (select r, count(*) as n_echoes from (select r, w = lag(w) over (partition by r order by i) as e from words) where e group by r),
covered as (select distinct r, i + k as i from twice, range(8) t(k) where n > 1),
rep as (select r, count(*) as n_repeat_words from covered group by r),
lines as (select r, unnest(string_split(text, chr(10))) as l from docs),
per_lines as (select r, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from lines where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
book as (select doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_shouts, 0) as n_shouts, coalesce(n_echoes, 0) as n_echoes
  from docs left join per using (r) left join rep using (r) left join per_lines using (r) left join echoes using (r)),
bits as (select *, cast(1 * cast(n_words < 20 as int) + 2 * cast(100 * n_repeat_words > 30 * n_words as int) + 4 * cast(10 * n_symbols > n_words as int) + 8 * cast(10 * n_dup_lines > 6 * n_lines as int)
  + 16 * cast(word_chars > 14 * n_words as int) + 32 * cast(word_chars < 2 * n_words as int) + 64 * cast(4 * n_shouts > n_words as int) + 128 * cast(2 * n_echoes > n_words as int) as bigint) as failed from book)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, (failed & 3) <> 0 as base_failed, failed = 0 as kept, failed from bits
"""
