"""Best-fit packing with certified bin counts.

Whole documents are tokenised where they are read; only lengths move. Pieces that
fill a sequence are sequences. The others are dealt to partitions of a bounded
number of pieces, and each is packed by best-fit decreasing. Dual feasible
functions give a lower bound of each partition's bins: where the count meets it,
no packing of that partition is better. Partitions with a gap put their pieces
together, deal them anew and are packed again; a round's result is kept if it
needs fewer bins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._ragged import groups
from ._shared import written
from .arrow_sequences import with_end
from .word_tokens import word_tokens

CAPACITY = 2048
#: Pieces of one partition, about; it bounds what a task holds.
PER_PARTITION = 100_000
ROUNDS = 2


def pieces(docs: DataFrame, tokenizer_path: str, *, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of at most `capacity` tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        coder = word_tokens(tokenizer_path)
        for batch in batches:
            for begin, end in groups(batch.column(1)):
                part = batch.slice(begin, end - begin)
                ids, bounds = with_end(*coder.encode(part.column(1)), end_id)
                sizes = np.diff(bounds)
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(len(n)), n)
                number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = number * capacity
                length = np.minimum(capacity, sizes[row] - start)
                at = bounds[:-1][row] + start
                crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins.

    Open bins stand by what they have left, one stack per amount; a bit set of
    the amounts in use gives the tightest that fits in a few machine words.
    """
    order = np.argsort(-lengths, kind="stable")
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    in_use, opened = 0, 0
    for k, n in zip(order.tolist(), lengths[order].tolist()):
        fits = in_use >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = stacks[left].pop()
            if not stacks[left]:
                in_use ^= 1 << left
        else:
            left, b = capacity, opened
            opened += 1
        bins[k], offsets[k] = b, capacity - left
        left -= n
        if left:
            if not stacks[left]:
                in_use |= 1 << left
            stacks[left].append(b)
    return bins, offsets, opened


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of the dual feasible functions' bounds of the number of bins.

    The identity; for each threshold t up to half the capacity the one that
    rounds pieces over capacity - t up to a whole bin and drops those under t;
    for small k the one of rounded fractions with denominator k.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    number, amount = np.cumsum(counts), np.cumsum(counts * size)
    best = -(-int(amount[-1]) // capacity)
    t = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - t]
    middle = amount[capacity - t] - amount[t - 1]
    best = max(best, int(np.max(large + -(-middle // capacity))))
    for k in range(1, 21):
        scaled = size * (k + 1)
        whole = scaled % capacity == 0
        f = np.where(whole, size * k, scaled // capacity * capacity)  # in units of capacity * k
        best = max(best, -(-int(counts @ f) // (capacity * k)))
    return best


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, lot long, bin long, offset long, bins long, bound long"


def _pack(items: DataFrame, lots: int, seed: int, capacity: int) -> DataFrame:
    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        lengths = group["length"].to_numpy()
        group["bin"], group["offset"], n = best_fit_decreasing(lengths, capacity)
        group["bins"], group["bound"] = n, lower_bound(lengths, capacity)
        return group

    # the pieces' own numbers also part rows that repeat, so that no partition grows with one document
    dealt = items.withColumn("lot", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece", "start", "length", "ids_crc32", "copy"), F.lit(lots)).cast("long"))
    return dealt.select("doc_id", "piece", "start", "length", "ids_crc32", "lot").groupBy("lot").applyInPandas(one, PACKED)


def pack(items: DataFrame, *, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """Add sequence_id and offset to `pieces`.

    Defined results: pieces of repeated rows are pieces of their own; a null
    doc_id is kept; no pieces give no sequences.
    """
    items = written(items.withColumn("copy", F.monotonically_increasing_id()), "pieces")
    full = items.filter(F.col("length") >= capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("copy")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.filter(F.col("length") < capacity)
    lots = max(1, -(-rest.count() // per_partition))
    done = written(_pack(rest, lots, 0, capacity), "packed")
    first = 0  # bins of a round get numbers of their own
    out = [full]
    for k in range(1, rounds + 1):
        stand = done.groupBy("lot").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"), F.count("*").alias("n"))
        gap = stand.filter("bins > bound")
        found = gap.agg(F.count("*").alias("lots"), F.sum("n").alias("n"), F.sum("bins").alias("bins")).first()
        if found["lots"] < 2:
            break
        mark = F.broadcast(gap.select("lot", F.lit(True).alias("open")))  # a row per partition of some 100,000 pieces
        marked = done.join(mark, "lot", "left")
        open_items = marked.filter("open").withColumn("copy", F.hash("bin", "lot").cast("long"))
        again = written(_pack(open_items, max(1, -(-found["n"] // per_partition)), k, capacity), "packed")
        if again.groupBy("lot").agg(F.first("bins").alias("bins")).agg(F.sum("bins")).first()[0] >= found["bins"]:
            break
        out.append(_numbered(marked.filter("open is null"), first))
        done, first = again, first + (1 << 30)
    out.append(_numbered(done, first))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def _numbered(packed: DataFrame, first: int) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", ((F.col("lot") + F.lit(first)) * F.lit(1 << 28) + F.col("bin")).alias("sequence_id"), "offset")


def packed_documents(docs: DataFrame, tokenizer_path: str, *, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places. A null or empty text is its end id alone."""
    return pack(pieces(docs, tokenizer_path, end_id=end_id, capacity=capacity), capacity=capacity)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences, tokens and the bound of all tokens together, in one row."""
    one = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    return one.agg(F.count("*").alias("sequences"), F.sum("used").alias("tokens"), F.ceil(F.sum("used") / capacity).alias("bound"))


def sequences(packed: DataFrame) -> DataFrame:
    """Pieces of each sequence in order of their offsets."""
    w = Window.partitionBy("sequence_id").orderBy("offset")
    return packed.withColumn("position", F.row_number().over(w) - 1)
