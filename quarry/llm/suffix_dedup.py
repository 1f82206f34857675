"""Removal of repeated byte strings, by sorted suffixes.

A byte goes if a string of `length` bytes over it starts earlier somewhere in the
corpus. Sorting every suffix of a corpus moves many times its size, so suffixes
are sorted only where repeats can be, and every repeat is found by that sort:

1. Each window of `length` bytes picks the smallest hash of its k-grams. Windows
   that share their pick are one row: hash of the k-gram, place. Equal windows
   pick alike, so repeats meet under one k-gram. Rows of one batch that are the
   same bytes, compared as bytes, are one row from the start.
2. Rows of a k-gram come together; a row alone has no repeat. The others are
   numbered into blocks of bounded size.
3. The bytes around those k-grams are fetched from their documents. In each block
   they are sorted as suffixes to the right of the k-gram and to the left, and for
   each offset the windows that agree on both sides are told from the two sorted
   orders. Later ones are repeats.
4. A k-gram with more rows than a block holds has several blocks. The windows that
   are first in theirs meet by a hash, and those with a partner are sorted again,
   as suffixes, in groups that each hold the first window of all.

The sort verifies the bytes of all neighbours, so hashes only decide what meets.
Intervals go back to their documents, where they are merged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ragged import groups
from ._shared import join_heavy, release, shuffle_partitions, sized, written
from .suffix_sort import Hashed, sorted_suffixes

LENGTH = 100
GRAM = 32
#: Rows of one k-gram in a block; rows that are sorted together.
KINDS = 1_000
BLOCK = 16_000
#: Bits of a row's length, and of the k-gram's place in it.
SIZE_BITS = 12
SIZE = (1 << SIZE_BITS) - 1
#: Bytes that are hashed together; positions in them take PLACE_BITS.
CHUNK = 512 << 10
PLACE_BITS = 23
NULL_ID = -(1 << 63)


def pack_place(start, left, size):
    """A row's place in one number: first byte, bytes before the k-gram, bytes in all."""
    return (start << 2 * SIZE_BITS) | (left << SIZE_BITS) | size


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def picks(data: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """Runs of windows with one pick: document, first window, last window, picked place, hash of the k-gram."""
    h = _mixed(Hashed(data).windows(gram))
    width = length - gram + 1
    if len(h) < width:
        return (np.zeros(0, np.int64),) * 4 + (h[:0],)
    low = np.uint64((1 << PLACE_BITS) - 1)
    keyed = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes
    padded = np.full(-(-len(keyed) // width) * width, np.uint64((1 << 64) - 1))
    padded[: len(keyed)] = keyed
    table = padded.reshape(-1, width)
    to_end = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    from_begin = np.minimum.accumulate(table, axis=1).ravel()
    place = (np.minimum(to_end[: len(h) - width + 1], from_begin[width - 1 : len(h)]) & low).astype(np.int64)
    first = np.arange(len(place))
    doc = np.searchsorted(bounds, first, side="right") - 1
    inside = first + length <= bounds[doc + 1]
    first, doc, place = first[inside], doc[inside], place[inside]
    if not len(first):
        return first, first, first, first, h[:0]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([first[new[1:] - 1], first[-1:]])
    return doc[new], first[new], last, place[new], h[place[new]]


def _slices(batch: pa.RecordBatch):
    """Rows of a batch with about a chunk of text each."""
    for begin, end in groups(batch.column(2), 2 * CHUNK):
        yield batch.slice(begin, end - begin)


def _chunks(texts: list[bytes], length: int):
    """Texts in groups of about CHUNK bytes; a longer one in parts that overlap so that each window is whole in one."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for k, t in enumerate(texts):
        if len(t) < length:
            continue
        for at in range(0, len(t) - length + 1, CHUNK):
            part = t if len(t) <= CHUNK + length else t[at : at + CHUNK + length - 1]
            if held and size + len(part) > 2 * CHUNK:
                yield held
                held, size = [], 0
            held.append((k, at, part))
            size += len(part)
            if part is t:
                break
    if held:
        yield held


def candidate_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """a, g, doc, k, at: step 1. A row with a negative `at` is an interval that repeats rows of its own batch."""
    from xxhash import xxh3_64_intdigest

    schema = pa.schema([("a", pa.int64()), ("g", pa.int64()), ("doc", pa.int64()), ("k", pa.int64()), ("at", pa.int64())])

    def run(batches):
        release()
        for batch in (part for whole in batches for part in _slices(whole)):
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [t.encode("utf-8") for t in batch.column(2).to_pylist()]
            for chunk in _chunks(texts, length):
                raw = b"".join(p for _, _, p in chunk)
                bounds = np.concatenate([[0], np.cumsum([len(p) for _, _, p in chunk])])
                part, first, last, place, a = picks(np.frombuffer(raw, np.uint8), bounds, length, gram)
                if not len(part):
                    continue
                row = np.array([k for k, _, _ in chunk])[part]
                shift = np.array([at for _, at, _ in chunk])[part] - bounds[part]
                g = np.array([xxh3_64_intdigest(raw[b:e]) for b, e in zip(first.tolist(), (last + length).tolist())], np.uint64)
                doc, k, start, stop = ids[row], keys[row], first + shift, last + length + shift
                order = np.lexsort((start, k, doc, g, a))
                same = np.zeros(len(order), bool)
                p, q = order[:-1], order[1:]
                # rows of one id and another text are not earlier than each other; leave those to the sort
                alike = np.flatnonzero((a[p] == a[q]) & (g[p] == g[q]) & ~((doc[p] == doc[q]) & (k[p] != k[q])))
                p, q = p[alike], q[alike]
                width = (last + length - first).tolist()
                same[q] = [raw[x : x + width[i]] == raw[y : y + width[j]] for i, j, x, y in zip(p.tolist(), q.tolist(), first[p].tolist(), first[q].tolist())]
                at = pack_place(start, place + shift - start, stop - start)
                keep = ~same
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[keep].view(np.int64), g[keep].view(np.int64), doc[keep], k[keep], at[keep])], schema=schema)
                gone = np.flatnonzero(same)
                if len(gone):
                    new = np.concatenate([[True], (np.diff(gone) != 1) | (row[gone[1:]] != row[gone[:-1]]) | (start[gone[1:]] > stop[gone[:-1]])])
                    heads = gone[np.flatnonzero(new)]
                    tails = gone[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(gone) - 1]])]
                    b, e = start[heads], stop[tails]
                    spread = _mixed((doc[heads] * 1_000_003 + b).view(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (spread, np.zeros(len(b), np.int64), doc[heads], k[heads], -1 - ((b << 32) | e))], schema=schema)

    return docs.select("doc", "k", "text").mapInArrow(run, "a long, g long, doc long, k long, at long")


FOUND = "doc long, k long, begin long, stop long, a long, block long, at long"


def found_rows(rows: DataFrame, kinds: int) -> DataFrame:
    """Step 2: intervals (block null), and the rows of each k-gram that has two or more, numbered into blocks.

    One pass over rows in order; between batches only the last row and its number
    within its k-gram are kept, whatever the number of rows of one k-gram.
    """
    names = ("doc", "k", "begin", "stop", "a", "block", "at")
    schema = pa.schema([(c, pa.int64()) for c in names])

    def out(n, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[c]) if c in columns else pa.nulls(n, pa.int64()) for c in names], schema=schema)

    def run(batches):
        last = None  # a, number within the k-gram, and the row itself
        for batch in batches:
            a, _, doc, k, at = (batch.column(c).to_numpy() for c in range(5))
            ready = at < 0
            if ready.any():
                code = -1 - at[ready]
                yield out(len(code), doc=doc[ready], k=k[ready], begin=code >> 32, stop=code & 0xFFFFFFFF)
                a, doc, k, at = (x[~ready] for x in (a, doc, k, at))
            n = len(a)
            if not n:
                continue
            follows = last is not None and last[0] == a[0]
            head = np.concatenate([[not follows], a[1:] != a[:-1]])
            begin = np.maximum.accumulate(np.where(head, np.arange(n), -1))
            number = np.where(begin >= 0, np.arange(n) - begin, np.arange(n) + (last[1] + 1 if follows else 0))
            if follows and not last[1]:  # it waited for a second row
                yield out(1, doc=[last[2]], k=[last[3]], a=[last[0]], block=[0], at=[last[4]])
            shared = ~head | np.concatenate([~head[1:], [False]])
            if shared.any():
                yield out(int(shared.sum()), doc=doc[shared], k=k[shared], a=a[shared], block=number[shared] // kinds, at=at[shared])
            # a head at the batch's end waits; any other last row is out
            last = (int(a[-1]), int(number[-1]), int(doc[-1]), int(k[-1]), int(at[-1]))

    return rows.mapInArrow(run, FOUND)


def contexts(docs: DataFrame, picked: DataFrame, keys: list[str]) -> DataFrame:
    """Step 3, first half: the bytes of each chosen row. Both sides are sorted, so neither has to fit in memory."""
    schema = pa.schema([("a", pa.int64()), ("block", pa.int64()), ("split", pa.bool_()), ("doc", pa.int64()), ("k", pa.int64()), ("at", pa.int64()), ("bytes", pa.binary())])
    lists = picked.groupBy(*keys).agg(F.collect_list(F.struct("a", "block", "split", "at")).alias("w"))
    joined = docs.join(lists.hint("merge"), keys).select("doc", "k", "text", "w")

    def run(batches):
        for batch in batches:
            for begin, end in groups(batch.column(2), 2 * CHUNK):
                part = batch.slice(begin, end - begin)
                wanted = part.column(3)
                n = np.diff(wanted.offsets.to_numpy())
                a, block, split, at = (wanted.flatten().field(c) for c in range(4))
                raws = [t.encode("utf-8") for t in part.column(2).to_pylist()]
                row = np.repeat(np.arange(len(raws)), n)
                places = at.to_numpy()
                first, size = places >> 2 * SIZE_BITS, places & SIZE
                found = [raws[r][b : b + z] for r, b, z in zip(row.tolist(), first.tolist(), size.tolist())]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([a, block, split, part.column(0).take(take), part.column(1).take(take), at, pa.array(found, pa.binary())], schema=schema)

    return joined.mapInArrow(run, "a long, block long, split boolean, doc long, k long, at long, bytes binary")


def repeats_in_block(group: np.ndarray, doc: np.ndarray, key: np.ndarray, at: np.ndarray, contexts_: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row and offset of the k-gram in a window: whether the window exists, and whether it starts earlier elsewhere in its group. Rows come ordered by group."""
    n = len(group)
    offsets = length - gram + 1
    size = np.array([len(c) for c in contexts_], np.int64)
    raw = np.frombuffer(b"".join(contexts_), np.uint8)
    begin = np.cumsum(size) - size
    left = (at >> SIZE_BITS) & SIZE
    right = np.minimum(size - left, length)
    order_r, common_r = sorted_suffixes(raw, begin + left, right, group)
    back = raw[::-1].copy()  # what stands left of the k-gram, read leftwards
    order_l, common_l = sorted_suffixes(back, len(raw) - (begin + left), left, group)
    exists, repeated = np.zeros((n, offsets), bool), np.zeros((n, offsets), bool)
    run_r, run_l = np.empty(n, np.int64), np.empty(n, np.int64)
    place = (at >> 2 * SIZE_BITS) + left
    for d in range(offsets):
        active = (left >= d) & (size - left >= length - d)
        exists[:, d] = active
        if np.count_nonzero(active) < 2:
            continue
        run_r[order_r] = np.cumsum(common_r < length - d)
        run_l[order_l] = np.cumsum(common_l < d)
        rows = np.flatnonzero(active)
        together = run_r[rows] * (n + 1) + run_l[rows]
        by = np.lexsort((place[rows], key[rows], doc[rows], together))
        t, i = together[by], rows[by]
        head = np.concatenate([[True], t[1:] != t[:-1]])
        lead = i[np.maximum.accumulate(np.where(head, np.arange(len(i)), 0))]
        before = np.concatenate([i[:1], i[:-1]])
        # earlier: a smaller id, or an earlier start in the same text
        repeated[i, d] = ~head & ((doc[i] > doc[lead]) | ((doc[i] == doc[before]) & (key[i] == key[before]) & (place[i] > place[before])))
    return exists, repeated


def block_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Step 3, second half: intervals of repeats, and of k-grams in several blocks the windows that are first in theirs (with hashes)."""
    schema = pa.schema([("doc", pa.int64()), ("k", pa.int64()), ("begin", pa.int64()), ("stop", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def settle(block: list[pa.RecordBatch]):
        t = pa.Table.from_batches(block)
        a, part, doc, k, at = (t.column(c).to_numpy() for c in ("a", "block", "doc", "k", "at"))
        split = t.column("split").to_numpy()
        texts = t.column("bytes").to_pylist()
        group = np.cumsum(np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1])]))
        exists, repeated = repeats_in_block(group, doc, k, at, texts, length, gram)
        # windows of a row ascend as offsets descend; runs of them are intervals
        flags = np.zeros((len(a), repeated.shape[1] + 2), np.int8)
        flags[:, 1:-1] = repeated[:, ::-1]
        step = np.diff(flags, axis=1)
        r, b = np.nonzero(step == 1)
        _, e = np.nonzero(step == -1)
        origin = (at >> 2 * SIZE_BITS) + ((at >> SIZE_BITS) & SIZE) - (repeated.shape[1] - 1)
        none = pa.nulls(len(r), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(k[r]), pa.array(origin[r] + b), pa.array(origin[r] + e - 1 + length), none, none], schema=schema)
        r, d = np.nonzero(exists & ~repeated & split[:, None])
        if len(r):
            within = ((at[r] >> SIZE_BITS) & SIZE) - d
            begin = (at[r] >> 2 * SIZE_BITS) + within
            digest = np.frombuffer(b"".join(hashlib.blake2b(texts[i][w : w + length], digest_size=16).digest() for i, w in zip(r.tolist(), within.tolist())), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(k[r]), pa.array(begin), pa.array(begin + length), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())], schema=schema)

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            a, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = 0
            # what is sorted together ends where a k-gram's block does
            ends = np.flatnonzero(np.concatenate([(a[1:] != a[:-1]) | (part[1:] != part[:-1]), [False]])) + 1
            if held and (held[-1].column(0)[-1].as_py() != a[0] or held[-1].column(1)[-1].as_py() != part[0]):
                if n >= BLOCK:
                    yield from settle(held)
                    held, n = [], 0
            for e in ends.tolist():
                if n + e - at >= BLOCK:
                    held.append(batch.slice(at, e - at))
                    yield from settle(held)
                    held, n, at = [], 0, e
            if at < batch.num_rows:
                held.append(batch.slice(at))
                n += batch.num_rows - at
        if held:
            yield from settle(held)

    return rows.mapInArrow(run, "doc long, k long, begin long, stop long, h1 long, h2 long")


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc (a null id is the smallest), k (tells texts of one id apart, zero if ids do not repeat), text; and what tells documents apart.

    A constant among the keys of a join would be optimised away on one side and
    deal the texts a second time.
    """
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    repeats = plain.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    k = F.xxhash64("text") if repeats else F.lit(0).cast("long")
    return plain.select("doc", k.alias("k"), "text"), ["doc", "k"] if repeats else ["doc"]


def intervals(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, kinds: int = KINDS) -> tuple[DataFrame, list[str], DataFrame]:
    """The keyed documents, their keys, and (doc, k, begin, stop) of all repeats, which may overlap."""
    if not 8 <= gram <= length <= 2000:
        raise ValueError("8 <= gram <= length <= 2000")
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    keyed, keys = _keyed(docs)
    rows = candidate_rows(keyed, length, gram).repartition(n, "a").sortWithinPartitions("a", "g", "doc", "k", "at")
    found = written(found_rows(rows, kinds), "suffix-found")
    done = found.filter("block is null").select("doc", "k", "begin", "stop")
    picked = found.filter("block is not null").select("a", "block", "doc", "k", "at")
    split = written(picked.filter("block > 0").select("a").distinct(), "suffix-split")
    crowds = split.count()
    if crowds:
        picked = picked.join(sized(split.withColumn("split", F.lit(True)), crowds), "a", "left").withColumn("split", F.coalesce("split", F.lit(False)))
    else:
        picked = picked.withColumn("split", F.lit(False))
    settled = written(_sorted_blocks(keyed, picked, keys, length, gram), "suffix-blocks")
    done = done.unionByName(settled.filter("h1 is null").select("doc", "k", "begin", "stop"))
    if not crowds:
        return keyed, keys, done
    again = _first_windows(settled.filter("h1 is not null").select("h1", "h2", "doc", "k", "begin"), length, kinds)
    return keyed, keys, done.unionByName(_sorted_blocks(keyed, again, keys, length, gram).select("doc", "k", "begin", "stop"))


def _sorted_blocks(keyed: DataFrame, picked: DataFrame, keys: list[str], length: int, gram: int) -> DataFrame:
    """Step 3 of the rows a, block, split, doc, k, at."""
    n = shuffle_partitions(keyed.sparkSession)
    near = contexts(keyed, picked, keys).repartition(n, "a", "block").sortWithinPartitions("a", "block", "doc", "k", "at")
    return block_rows(near, length, gram)


def _first_windows(firsts: DataFrame, length: int, kinds: int) -> DataFrame:
    """Step 4: windows that are first in their blocks and have a partner in another, as rows to be sorted.

    A hash brings partners together. They are dealt into groups of about `kinds`,
    each with the first window of all in it, so none grows with their number.
    """
    place = F.struct("doc", "k", "begin")
    least = firsts.groupBy("h1", "h2").agg(F.min(place).alias("least"), F.count("*").alias("n")).filter("n > 1")
    least = written(least.withColumn("weight", F.col("n")), "suffix-firsts")
    met = join_heavy(firsts, least, ["h1", "h2"], "weight", firsts.count())
    blocks = F.ceil(F.col("n") / kinds)
    met = met.filter(place != F.col("least")).select("h1", F.pmod(F.xxhash64("doc", "k"), blocks).alias("block"), "doc", "k", "begin")
    heads = least.select("h1", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("block"), "least.*")
    # the groups' numbers are negative: (a, block) of step 3 has others
    at = F.shiftleft(F.col("begin"), 2 * SIZE_BITS).bitwiseOR(F.lit(length))
    return met.unionByName(heads).select(F.col("h1").alias("a"), (-1 - F.col("block")).alias("block"), F.lit(False).alias("split"), "doc", "k", at.alias("at"))


def merged(begin: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """The union of intervals; touching ones are one."""
    if not len(begin):
        return []
    order = np.argsort(begin, kind="stable")
    b, e = begin[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.concatenate([[True], b[1:] > e[:-1]]))
    return list(zip(b[new].tolist(), e[np.concatenate([new[1:] - 1, [len(b) - 1]])].tolist()))


def _with_intervals(docs: DataFrame, **options) -> DataFrame:
    """doc, k, text, w: the intervals of each document."""
    keyed, keys, found = intervals(docs, **options)
    lists = found.groupBy(*keys).agg(F.collect_set(F.struct("begin", "stop")).alias("w"))
    return keyed.join(lists.hint("merge"), keys, "left").select("doc", "k", "text", "w")


def _spans(wanted) -> list[tuple[int, int]]:
    return merged(np.array([w["begin"] for w in wanted], np.int64), np.array([w["stop"] for w in wanted], np.int64)) if wanted else []


def removals(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Null texts count as empty; a text shorter than `length` keeps all. A null
    doc_id is the smallest. Documents that share a doc_id are not earlier than
    each other; rows that repeat whole get the same result. An empty table gives
    none; further columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            for first, end in groups(batch.column(1)):
                part = batch.slice(first, end - first)
                rows = []
                for doc, text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw, spans, digest, last = text.encode("utf-8"), _spans(wanted), hashlib.sha256(), 0
                    for b, e in spans:
                        digest.update(raw[last:b])
                        last = e
                    digest.update(raw[last:])
                    rows.append((None if doc == NULL_ID else doc, len(raw), sum(e - b for b, e in spans), len(spans), digest.hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return _with_intervals(docs, **options).select("doc", "text", "w").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """What spans leave of a text. A character of which only some bytes are in a span stays."""
    out, last = [], 0
    for b, e in spans:
        while b < e and raw[b] & 0xC0 == 0x80:
            b += 1
        while e > b and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if b < e:
            out.append(raw[last:b])
            last = e
    out.append(raw[last:])
    return b"".join(out).decode("utf-8")


def dedup_text(docs: DataFrame, **options) -> DataFrame:
    """The documents, with all columns, without their repeats; n_chars follows the text where it is a column.

    A document of which nothing is left stays with an empty text; a null text
    without repeats stays null. Null ids, repeated rows and empty tables are as in
    `removals`. Further columns stay as they are, whatever their names.
    """
    def run(batches):
        for batch in batches:
            for first, end in groups(batch.column(2)):
                part = batch.slice(first, end - first)
                texts = [cut(t.encode("utf-8"), _spans(w)) for t, w in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc", "k", "new"])

    changed = _with_intervals(docs, **options).filter("w is not null").mapInArrow(run, "doc long, k long, new string").distinct()
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("of"), F.col("text").alias("was"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")
    )
    same = (F.col("of") == F.col("doc")) & ((F.col("k") == 0) | (F.col("k") == F.col("key")))
    text = F.coalesce("new", "was")
    columns = [(text if c == "text" else F.char_length(text).cast("long") if c == "n_chars" else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return whole.join(changed, same, "left").select(*columns)
