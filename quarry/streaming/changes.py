"""Structured Streaming around the batch-incremental operators.

A stream of (path, sha256, text) versions of files is folded into snapshots:
each micro-batch is compared with the files' table, and only what changed, with
all that imports it, goes on to `rebuild`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.incremental import snapshot_diff


def latest(batch: DataFrame) -> DataFrame:
    """Of several versions of a file in a batch the last by `version`."""
    others = [c for c in batch.columns if c != "path"]
    return batch.groupBy("path").agg(F.max_by(F.struct(*others), "version").alias("r")).select("path", *[F.col(f"r.{c}").alias(c) for c in others])


def follow(stream: DataFrame, current: Callable[[], DataFrame], rebuild: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start the query. `current` gives the snapshot (path, sha256), `rebuild` gets (path, change) of each batch with its number, at least once."""

    def step(batch: DataFrame, number: int) -> None:
        new = latest(batch)
        old = current().join(new.select("path"), "path", "left_semi")
        rebuild(snapshot_diff(old, new.filter("sha256 is not null")), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
