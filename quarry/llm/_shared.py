"""Helpers that several training-data operators need."""

from __future__ import annotations

import ctypes
import gc
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.plans.shared import BROADCAST_ROWS, dropped, fresh, join_heavy, scratch, shared_dir, sized, written  # noqa: F401
from quarry.plans.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Drop the token tables that this Python worker keeps for another operator's tasks.

    Workers live on between stages; a task that needs no tokenizer gives their
    memory back, to the system too, before it begins.
    """
    held = False
    for module, name in (("quarry.llm.word_tokens", "word_tokens"), ("quarry.llm.sentencepiece_codec", "piece_codec")):
        if module in sys.modules:
            cache = getattr(sys.modules[module], name)
            held |= cache.cache_info().currsize > 0
            cache.cache_clear()
    if held:
        trim()


def trim() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
