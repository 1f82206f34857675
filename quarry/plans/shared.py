"""Tables and folders that the driver and the executors share, and joins whose broadcasts have a counted bound."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one side up to which it is sent to every executor.
BROADCAST_ROWS = 50_000
#: A key is heavy if it has more than this part of all rows, so there are fewer heavy keys than this.
HEAVY_PARTS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: what ``spark.checkpoint.dir`` names.

    Where that is unset a temporary folder is made, but only for a local master;
    on a cluster a folder of one machine would lose rows, so that raises.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if not current:
        wanted = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not wanted and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="quarry-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it again.

    This cuts the lineage: a lost executor costs a read of the files, never a
    new run of what made them. It is computed once, where an eager checkpoint is
    computed twice, and its size is known to the joins that read it.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables that `written` made, once nothing reads them any more; others are left alone."""
    for df in tables:
        path = getattr(df, "written_to", None)
        if path:
            context = df.sparkSession.sparkContext
            there = context._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(context._jsc.hadoopConfiguration()).delete(there, True)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """The side of a join that has `rows` rows: broadcast up to BROADCAST_ROWS, else dealt out and merged. No estimate decides."""
    return df.hint("broadcast" if rows <= BROADCAST_ROWS else "merge")


def join_heavy(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of `left` with `right`, which has each key once and, as `weight`, how many rows `left` has of it; `total` is their sum.

    Keys with more than total / HEAVY_PARTS rows are fewer than HEAVY_PARTS, so
    these are broadcast and their rows stay where they are; no task gets more
    than that part of the others. `weight` is not among the columns returned.
    """
    if total <= BROADCAST_ROWS:
        return left.join(right.drop(weight).hint("broadcast"), keys)
    bound = max(total // HEAVY_PARTS, 1_000)
    heavy = right.filter(F.col(weight) > bound).drop(weight)
    light = right.filter(F.col(weight) <= bound).drop(weight)
    rest = left.join(heavy.select(*keys).hint("broadcast"), keys, "left_anti")
    return left.join(heavy.hint("broadcast"), keys).unionByName(rest.join(light.hint("merge"), keys))


def fresh(name: str, taken: list[str]) -> str:
    """`name`, with underscores behind it until no column has it, whatever the case of its letters."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name
