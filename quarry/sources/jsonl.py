"""Layers as JSON lines: nodes and edges with schemas, merged on load."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.model import LAYERS
from quarry.operators.aggregates import first_edges, merge_nodes
from quarry.operators.incremental import last_rows

NODE = "id string, labels array<string>, properties map<string,string>"
EDGE = "id string, type string, `from` string, `to` string, properties map<string,string>"
DESCRIPTION = "targetId string, kind string, contentHash string, text string, model string, provider string, generatedAt string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def line_order() -> Column:
    """Orders rows of a text source as their lines: by file, split, and place within the split.

    Spark packs splits into tasks by size, so the running number alone follows no
    file; within a split it does.
    """
    return F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_layers(spark: SparkSession, cache: str, layers: tuple[str, ...] = LAYERS) -> tuple[DataFrame, DataFrame, list[str]]:
    """Merged nodes (id, labels, key, value), edges (type, src, dst), and the layers that were there; none is a valid empty graph."""
    found = [x for x in layers if _exists(spark, f"{cache}/{x}")]
    nodes = [read_jsonl(spark, f"{cache}/{x}/nodes.jsonl", NODE).withColumn("layer", F.lit(k)) for k, x in enumerate(found) if _exists(spark, f"{cache}/{x}/nodes.jsonl")]
    edges = [read_jsonl(spark, f"{cache}/{x}/edges.jsonl", EDGE).withColumn("layer", F.lit(k)).withColumn("ord", line_order()) for k, x in enumerate(found) if _exists(spark, f"{cache}/{x}/edges.jsonl")]
    n = reduce(DataFrame.unionByName, nodes) if nodes else spark.createDataFrame([], NODE + ", layer int")
    e = reduce(DataFrame.unionByName, edges) if edges else spark.createDataFrame([], EDGE + ", layer int, ord struct<f:string,b:long,k:long>")
    e = e.select("type", F.col("from").alias("src"), F.col("to").alias("dst"), "layer", "ord")
    return merge_nodes(n), first_edges(e), found


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Malformed and unusable rows are dropped, the last row of a target stays (files are read in order of their lines)."""
    rows = spark.read.schema(DESCRIPTION).option("mode", "DROPMALFORMED").json(path).filter("targetId is not null and text is not null and contentHash is not null")
    return last_rows(rows.withColumn("_ord", line_order()), "targetId", "_ord")


def to_lines(df: DataFrame, key: str = "id") -> DataFrame:
    """One JSON text per row, the keys of all objects in alphabetical order, rows in order of the key."""
    from quarry.operators.incremental import sorted_struct

    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return df.orderBy(key).select(F.to_json(F.struct(*[sorted_struct(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields])).alias("value"))


def write_jsonl(df: DataFrame, path: str, key: str = "id") -> None:
    """Through Spark's commit protocol: readers see all of it or nothing. Parts keep the rows' order."""
    to_lines(df, key).write.mode("overwrite").text(path)
