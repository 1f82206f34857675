"""Snapshots, freshness and incremental recomputation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from quarry.functions.paths import revision_of


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, deleted, modified) between two snapshots of (path, sha256)."""
    o, n = old.select("path", F.col("sha256").alias("h0"), F.lit(True).alias("_in0")), new.select("path", F.col("sha256").alias("h1"), F.lit(True).alias("_in1"))
    both = o.join(n, "path", "full")
    change = F.when(F.col("_in0").isNull(), "added").when(F.col("_in1").isNull(), "deleted").when(~F.col("h0").eqNullSafe(F.col("h1")), "modified")
    return both.select("path", change.alias("change")).filter("change is not null")


def disjoint_buckets(added: DataFrame, deleted: DataFrame, modified: DataFrame) -> DataFrame:
    """path, change with each path in one bucket: added wins, then deleted."""
    d = deleted.join(added, "path", "left_anti")
    m = modified.join(added, "path", "left_anti").join(deleted, "path", "left_anti")
    tag = lambda df, name: df.select("path").distinct().withColumn("change", F.lit(name))
    return tag(added, "added").unionByName(tag(d, "deleted")).unionByName(tag(m, "modified"))


def kept_and_fresh(cached: DataFrame, affected: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached edges outside the affected files (column node), and the fresh ones."""
    return cached.join(affected.select(F.col("node").alias("src")), "src", "left_anti").unionByName(fresh).distinct()


def incremental_layer(cached: DataFrame, affected: DataFrame, extract: Callable[[DataFrame], DataFrame], sources: DataFrame) -> DataFrame:
    """A layer's edges, extracted anew for affected sources only; equal to extracting all."""
    again = sources.join(affected.select(F.col("node").alias("id")), "id", "left_semi")
    alive = cached.join(sources.select(F.col("id").alias("src")), "src", "left_semi")
    return kept_and_fresh(alive, affected, extract(again))


#: Reasons in their order; the first whose condition holds is the verdict.
def staleness(state: DataFrame) -> DataFrame:
    """reason and stale (null: unknown) of each row of cache states.

    Columns: cached, layers_complete, snapshots_match, build_complete,
    context_stored, context_now, vcs_known, cache_revision, head_revision, dirty.
    """
    steps: list[tuple[str, Column, bool | None]] = [
        ("no-cache", ~F.col("cached"), True),
        ("incomplete-cache", ~F.col("layers_complete"), True),
        ("layer-snapshot-mismatch", ~F.col("snapshots_match"), True),
        ("build-incomplete", ~F.col("build_complete"), True),
        ("build-context-missing", F.col("context_now").isNotNull() & F.col("context_stored").isNull(), True),
        ("build-context-changed", F.col("context_now").isNotNull() & (F.col("context_now") != F.col("context_stored")), True),
        ("vcs-unknown", ~F.col("vcs_known") | revision_of(F.col("cache_revision")).isNull(), None),
        ("revision-changed", revision_of(F.col("cache_revision")) != F.col("head_revision"), True),
        ("working-tree-changed", F.col("dirty"), True),
    ]
    reason, stale = F.when(F.lit(False), ""), F.when(F.lit(False), F.lit(True))
    for name, when, verdict in steps:
        reason = reason.when(when, name)
        stale = stale.when(when, F.lit(verdict))
    return state.withColumn("reason", reason.otherwise("up-to-date")).withColumn("stale", stale.otherwise(F.lit(False)))


def last_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key its last row in order."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def upsert(existing: DataFrame, rows: DataFrame, key: str, keep: DataFrame | None = None) -> DataFrame:
    """Rows in place of existing ones of their key; with `keep` (column key) others go."""
    out = existing.join(rows.select(key), key, "left_anti").unionByName(rows)
    return out if keep is None else out.join(keep, key, "left_semi")


def fresh_rows(cached: DataFrame, targets: DataFrame) -> DataFrame:
    """id, fresh: whether a cached row with the target's content hash exists."""
    c = cached.select("id", F.col("content_hash").alias("h"))
    return targets.join(c, "id", "left").select("id", F.col("content_hash").eqNullSafe(F.col("h")).alias("fresh"))


def merge_layers(layers: list[DataFrame]) -> DataFrame:
    """Rows of all layers with their rank, whatever columns each has."""
    out = layers[0].withColumn("layer", F.lit(0))
    for k, x in enumerate(layers[1:], 1):
        out = out.unionByName(x.withColumn("layer", F.lit(k)), allowMissingColumns=True)
    return out


def sorted_struct(value: Column, kind: DataType) -> Column:
    """The same value with the fields of all structs in alphabetical order, at any depth."""
    if isinstance(kind, StructType):
        return F.when(value.isNull(), F.lit(None)).otherwise(_sorted_fields(value, kind))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: sorted_struct(x, kind.elementType))
    if isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(value, lambda _, v: sorted_struct(v, kind.valueType))), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)))
    return value


def _sorted_fields(value: Column, kind: StructType) -> Column:
    return F.struct(*[sorted_struct(value.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])


def content_hash(value: Column, kind: DataType) -> Column:
    """SHA-256 of the value as JSON with ordered keys, so that the order of fields says nothing."""
    return F.sha2(F.to_json(sorted_struct(value, kind)), 256)
