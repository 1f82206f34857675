"""Ordinals, first and last rows, islands and top-n per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal_ids(declared: DataFrame) -> DataFrame:
    """id of each (path, name, ord): the second of a name in a file gets ~2, and so on."""
    k = F.row_number().over(Window.partitionBy("path", "name").orderBy("ord"))
    base = F.concat(F.lit("sym:"), "path", F.lit("#"), "name")
    return declared.withColumn("id", F.when(k == 1, base).otherwise(F.concat(base, F.lit("~"), k.cast("string"))))


def first_specifiers(rows: DataFrame) -> DataFrame:
    """Of several specifiers from one file to one target the first in order."""
    return rows.groupBy("src", "dst").agg(F.min("specifier").alias("specifier"))


def derived_kinds(rows: DataFrame) -> DataFrame:
    """domain -> the kind of its last path in order."""
    return rows.groupBy("domain").agg(F.max_by("kind", F.struct("path", "kind")).alias("kind"))


def merge_adjacent(hits: DataFrame, gap: int = 2) -> DataFrame:
    """Fold rows (name, begin, stop) of a name that begin at most `gap` lines after all before have ended."""
    w = Window.partitionBy("name").orderBy("begin", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("_new", F.when(F.col("begin") - before <= gap, 0).otherwise(1))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("name", "_island").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"), F.count("*").alias("parts")).drop("_island")


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their position. Spark ranks within tasks before the shuffle."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("position") <= n)


def capped(rows: DataFrame, order: list, limit: int | None) -> DataFrame:
    """The first rows with `total`, counted before the cut, and `truncated`. A limit that is not positive cuts nothing."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    out = rows.orderBy(*order)
    if limit and limit > 0:
        out = out.limit(limit)
    out = out.crossJoin(F.broadcast(total))
    return out.withColumn("truncated", F.col("total") > limit if limit and limit > 0 else F.lit(False))


def with_more(rows: DataFrame, order: list, limit: int = 10) -> DataFrame:
    """The first rows and how many stay hidden."""
    return capped(rows, order, limit).withColumn("hidden", F.greatest(F.col("total") - limit, F.lit(0))).drop("total", "truncated")


def unique_slugs(names: DataFrame) -> DataFrame:
    """name -> slug. A slug that is taken gets the first free number from 2, in the order of names.

    Names in order: what `x` got as x-2 is not free for a name that is x-2 itself.
    So one task goes through the names of a family (slugs alike but for a number
    at their end), which is a few names of pages.
    """
    import pandas as pd

    from quarry.functions.paths import slug

    def one(group: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        group = group.sort_values("name", kind="stable")
        out = []
        for s in group["slug"]:
            k, free = 2, s
            while free in used:
                free, k = f"{s}-{k}", k + 1
            used.add(free)
            out.append(free)
        return group.assign(slug=out)[["name", "slug"]]

    slugs = names.select("name", slug(F.col("name")).alias("slug")).withColumn("family", F.regexp_replace("slug", r"(-\d+)+$", ""))
    return slugs.groupBy("family").applyInPandas(one, "name string, slug string")
