"""SimHash near-dedup with pigeonhole blocks.

A fingerprint has 64 bits, the majorities of its shingles' hashes. Two of them at
most three bits apart agree on at least three of six blocks, so pairs are looked
for among fingerprints that share three blocks: twenty keys of about 32 bits.
Keys that wide stay selective as the corpus grows; two blocks of four would not.

Documents with one fingerprint are one node from the start. A key with few
fingerprints is joined with itself and the pairs are verified. A cluster of
slightly different copies can put any number of fingerprints on one key; there
the fingerprints are linked without making pairs: x and y are at most three bits
apart exactly if some value is at most one bit from x and at most two from y, so
all y around a value are linked to the smallest x around it.

Components come from alternating star contraction over written tables.

Few differing bits are a narrow rule: texts that share four fifths of their
five-word shingles mostly differ in more than three. For a similarity of sets
(`similar_groups`) the shingles are dealt into blocks by their hashes, and each
block has a fingerprint of its own. Two sets that are similar enough differ in
fewer shingles than there are blocks, so by the same pigeonhole they share a
block; of texts that do, a pair each is verified by the similarity of their whole
texts. Texts that then share a block with one of another group are compared by
their rarest shingles, of which similar sets have one in common without fail.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._components import components
from ._ragged import groups
from ._shared import BROADCAST_ROWS, dropped, join_heavy, release, sized, written

WORDS = 3
DISTANCE = 3
#: Of the similarity of sets.
STAGE_WORDS = 5
SIMILARITY = 0.8
#: First bits and widths of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
SHARED = len(BLOCKS) - DISTANCE
MASKS = tuple(sum(((1 << w) - 1) << b for b, w in chosen) for chosen in combinations(BLOCKS, SHARED))
#: A key with more fingerprints is linked without pairs.
CROWD = 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Of a whole text, in order and with repeats. The whole sequence is the only shingle of a text with fewer words; none has none."""
    from xxhash import xxh64_intdigest

    # bytes.split() parts at 0x20 and 0x09-0x0D, as the word pattern does
    parts = (text or "").encode("utf-8").translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join
    if len(parts) <= words:
        return np.array([xxh64_intdigest(joined(parts), 42)], np.uint64)
    if words == 3:
        shingles = (b"%b %b %b" % t for t in zip(parts, parts[1:], parts[2:]))
    else:
        shingles = map(joined, zip(*(parts[k:] for k in range(words))))
    return np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(parts) - words + 1)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Of a whole text; zero without words."""
    h = shingle_hashes(text, words)
    return majority(h) if len(h) else 0


def majority(h: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, words: int = WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        release()
        for batch in batches:
            for begin, end in groups(batch.column(1)):
                part = batch.slice(begin, end - begin)
                fps = np.array([fingerprint(t, words) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) with a < b among distinct fingerprints, enough to connect all that are near.

    Every link is of two fingerprints at most three bits apart, or of two that
    are both that near to a third.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(MASKS)]))
    keyed = fps.select("fp", keys.alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("weight", F.col("n"))
    shared = written(join_heavy(keyed, sizes, ["t", "key"], "weight", len(MASKS) * fps.count()), "simhash-keys")
    few = shared.filter(F.col("n") <= CROWD).select("t", "key", "fp")
    other = few.select("t", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = few.withColumnRenamed("fp", "a").join(sized(other, other.count()), ["t", "key"]).filter((F.col("a") < F.col("b")) & near).select("a", "b")
    crowd = shared.filter(F.col("n") > CROWD).select("fp").distinct()
    return pairs.distinct().unionByName(_crowded(crowd))


def _crowded(fps: DataFrame) -> DataFrame:
    """Links among fingerprints of crowded keys by the values around them."""
    one = np.array([0, *(1 << i for i in range(64))], np.uint64)
    two = np.array([(1 << i) | (1 << j) for i, j in combinations(range(64), 2)], np.uint64)

    def around(values: np.ndarray):
        def run(batches):
            for batch in batches:
                x = batch.column(0).to_numpy()
                for at in range(0, len(x), 256):
                    part = x[at : at + 256].view(np.uint64)
                    v = (part[:, None] ^ values[None, :]).ravel().view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(np.repeat(x[at : at + 256], len(values)))], names=["v", "fp"])

        return run

    close = fps.mapInArrow(around(one), "v long, fp long").groupBy("v").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count("*").alias("n"))
    # what one bit away has nobody else stands only for its own fingerprint
    wide = fps.mapInArrow(around(np.concatenate([one, two])), "v long, fp long")
    # a value has at most 2081 fingerprints around it, so no key of this join is heavy
    found = wide.join(close.hint("merge"), "v").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).filter("a <> b")
    return found.distinct()


def near_components(docs: DataFrame, *, words: int = WORDS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every document.

    Null and empty texts have fingerprint zero, which links like any other; equal
    fingerprints link; a null doc_id is never the smallest unless its component
    has no other; repeated rows each give a row; an empty table gives none.
    """
    made = written(fingerprints(docs, words=words), "fingerprints")
    nodes = written(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    roots = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")  # of nodes with links
    rooted = nodes.join(sized(roots, roots.count()), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "simhash-roots")
    count = rooted.count()
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("weight"))
    by_fp = join_heavy(rooted, least, ["root"], "weight", count).select("fp", "component_id", "n")
    return join_heavy(made, by_fp, ["fp"], "n", made.count())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hexadecimal, component_id."""
    return near_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, *, words: int = STAGE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of `similar_groups`, that of the smallest doc_id, with all its columns.

    Rows that share this doc_id all stay, as do rows of null doc_id. The caller's
    columns may have any names.
    """
    found = similar_groups(docs, words=words, similarity=similarity)
    gone = written(found.filter("node <> root").select("node").distinct(), "near-copies")
    dropped(found)
    return docs.join(sized(gone, gone.count()), docs["doc_id"].cast("long") == gone["node"], "left_anti")


# similarity of sets ------------------------------------------------------------


def _classes(least: int = 1 << 40) -> list[int]:
    """Upper bounds of the classes of set sizes: each half as large again as the one before."""
    out = [1]
    while out[-1] < least:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


CLASSES = np.array(_classes(), np.int64)
#: Sets of a class up to this size are dealt into blocks three times.
SMALL = 100


def block_keys(shingles: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Keys of a set of distinct shingle hashes; sets of at least that Jaccard similarity share one.

    Two sets of at most U elements each differ in at most 2U (1 - s) / (1 + s)
    elements if they are that similar. Dealt into one block more than that, some
    block has none of them, and its fingerprint is the same in both. (That block
    could be an empty one; small sets, where this can happen, are dealt three
    times. Large sets are dealt into half as many blocks: of those, several are
    left alone, and none with a probability under 0.001.) A set has the keys of
    its own class of sizes and of the classes of all larger sets that can be as
    similar.
    """
    n = len(shingles)
    out = []
    first, last = int(np.searchsorted(CLASSES, n)), int(np.searchsorted(CLASSES, int(n / similarity + 1e-9)))
    for c, deal in ((c, deal) for c in range(first, last + 1) for deal in range(3 if CLASSES[c] <= SMALL else 1)):
        m = int(2 * int(CLASSES[c]) * (1 - similarity) / (1 + similarity) + 1e-9) + 1
        m = m if CLASSES[c] <= SMALL else -(-m // 2)
        seed = np.uint64((c * 0x2545F4914F6CDD1D + deal * 0xA0761D6478BD642F) & (1 << 64) - 1)
        mixed = (shingles ^ (shingles >> np.uint64(31)) ^ seed) * np.uint64(0x9E3779B97F4A7C15)
        block = ((mixed >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        order = np.argsort(block, kind="stable")
        block, held = block[order], shingles[order]
        heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        sizes = np.diff(np.append(heads, n))
        fp = np.empty(len(heads), np.uint64)
        for at in range(0, len(heads), 1 << 14):  # the bits of a long text are not unfolded all at once
            h, k = heads[at : at + (1 << 14)], sizes[at : at + (1 << 14)]
            bits = np.unpackbits(held[h[0] : h[-1] + k[-1]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, h - h[0], axis=0, dtype=np.int32)
            fp[at : at + len(h)] = np.packbits(2 * ones > k[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        key = (fp ^ (block[heads] * np.uint64(0xD6E8FEB86659FD93)) ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
        out.append(key ^ (key >> np.uint64(29)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct shingle hashes, ascending; a text without words has one element, the same for all."""
    h = np.unique(shingle_hashes(text, words))
    return h if len(h) else np.zeros(1, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


#: Texts of one rare element up to which their pairs are rows; more are compared in place.
CROWD_OF_TEXTS = 32
#: Places that a crowd is dealt to, with this many of its texts in each while there are fewer.
PLACES, TEXTS_IN_PLACE = 64, 32
#: Bits in which fingerprints of first pairs differ at most; no bound for the rest. A similarity of 0.8 gives 9.7 on average, with a deviation of 2.9.
SET_DISTANCE = 22
#: Pairs of one text that are verified in one place; a text in more pairs is sent out that much more often.
FANOUT = 256

MADE = "doc long, th long, fp long, n long, keys array<long>"


def _made(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc, th, fingerprint, number of shingles and block keys of every text."""
    schema = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        release()
        for batch in batches:
            for begin, end in groups(batch.column(2), 2 << 20):  # its keys take as much memory again
                part = batch.slice(begin, end - begin)
                found, fps, sizes = [], [], []
                for t in part.column(2).to_pylist():
                    h = shingle_set(t, words)
                    found.append(block_keys(h, similarity).view(np.int64))
                    fps.append(majority(h))
                    sizes.append(len(h))
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), keys], schema=schema)

    return written(texts.mapInArrow(run, MADE), "block-keys")


def _first_pairs(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """One pair (a, b) of each row, with that first row of its keys, in an order by hash, that it shares most of them with; and the keys of more than one row, with their numbers of rows n."""
    first = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("doc").alias("o"), "doc")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    first = written(first.select("key", F.col("f.doc").alias("b"), "n"), "block-firsts")
    met = join_heavy(rows, first, ["key"], "n", total).filter("doc <> b")
    return written(_nearest(met), "near-pairs"), first


def _nearest(met: DataFrame) -> DataFrame:
    """Pairs (a, b), one of each doc: with the b that it met most often."""
    best = met.groupBy("doc", "b").agg(F.count("*").alias("s")).groupBy("doc").agg(F.max(F.struct("s", F.xxhash64("doc", "b").alias("o"), "b")).alias("f"))
    return best.select(F.greatest("doc", "f.b").alias("a"), F.least("doc", "f.b").alias("b")).distinct()


def _equal(marks: DataFrame, copied: DataFrame) -> DataFrame:
    """Links (a, b) of equal texts to the smallest doc of theirs; `copied` has it, as least, and the number of rows w of each th."""
    return join_heavy(marks.select("doc", "th"), copied, ["th"], "w", marks.count()).filter("doc > least").select(F.col("doc").alias("a"), F.col("least").alias("b"))


def _open(rows: DataFrame, total: int, shared: DataFrame, roots: DataFrame, reps: DataFrame) -> DataFrame:
    """doc and root of the texts with a key that texts of another group have too."""
    held = join_heavy(rows, shared.withColumn("weight", F.col("n")), ["key"], "weight", total)
    held = held.join(sized(reps, reps.count()), "doc").join(sized(roots.withColumnRenamed("node", "doc"), roots.count()), "doc", "left").select("key", "doc", F.coalesce("root", "doc").alias("root"))
    held = written(held, "block-rows")
    mixed = held.groupBy("key").agg(F.count("*").alias("weight"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key", "weight")
    found = written(join_heavy(held, mixed, ["key"], "weight", held.count()).select("doc", "root").distinct(), "near-open")
    dropped(held)
    return found


def _prefixes(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """key, doc, n, pos: the first elements of each text's set, of n, by how many texts have them, then by value; only elements that several texts have.

    Any two sets that are similar enough have an element in common among their
    first n - ceil(n s) + 1. The rare come first, so few texts share one of these
    unless they are much alike.
    """
    schema = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("key", pa.int64())])

    def run(batches):
        release()
        for batch in batches:
            for begin, end in groups(batch.column(2), 2 << 20):
                part = batch.slice(begin, end - begin)
                sets = [shingle_set(t, words).view(np.int64) for t in part.column(2).to_pylist()]
                sizes = np.array([len(x) for x in sets], np.int64)
                columns = [np.repeat(part.column(k).to_numpy(), sizes) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, np.repeat(sizes, sizes), np.concatenate(sets))], schema=schema)

    rows = written(texts.mapInArrow(run, "doc long, th long, n long, key long"), "near-elements")
    often = rows.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1").withColumn("weight", F.col("often"))
    often = written(often, "near-often")
    common = join_heavy(rows, often, ["key"], "weight", rows.count())
    text = Window.partitionBy("doc", "th")
    pos = F.col("n") - F.count("*").over(text) + F.row_number().over(text.orderBy("often", "key")) - 1
    found = written(common.withColumn("pos", pos).filter(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9)).select("key", "doc", "n", "pos"), "near-prefixes")
    dropped(rows, often)
    return found


def _fits(similarity: float):
    """Whether two rows of one key, of different groups, can be similar if the key is the first element that they share."""
    size = F.least("n", "m") >= F.greatest("n", "m") * similarity - 1e-9
    return size & (F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at")) >= (F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - 1e-9) & (F.col("root") != F.col("other"))


def _all_pairs(held: DataFrame, total: int, similarity: float) -> DataFrame:
    """Every pair (a, b) that fits and is not of one crowd, of keys of few rows."""
    other = held.select("key", F.col("doc").alias("b"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("root").alias("other"), F.col("crowd").alias("others"))
    apart = (F.col("doc") > F.col("b")) & ~F.coalesce(F.col("crowd") == F.col("others"), F.lit(False))
    return held.join(sized(other, total), "key").filter(_fits(similarity) & apart).select(F.col("doc").alias("a"), "b").distinct()


def _compared(texts: DataFrame, crowds: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect all similar texts of a crowd; `crowds` has doc, root, crowd.

    A crowd's texts are dealt to places, and all of the crowd pass by each, as
    sets. Pairs are compared there and are never rows: numbers of common elements
    come from the elements' lists of texts, and a link leaves a place only if it
    connects two groups that the place has not seen connected yet.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def sets(batches):
        release()
        for batch in batches:
            for begin, end in groups(batch.column(1), 2 << 20):
                part = batch.slice(begin, end - begin)
                made = pa.array([shingle_set(t, words).tobytes() for t in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), made], names=["doc", "elements"])

    def compare(batches):
        release()
        at, mine, index, over = None, [], None, {}

        def find(x):
            while over.get(x, x) != x:
                over[x] = x = over.get(over[x], over[x])
            return x

        for batch in batches:
            out = []
            for row, (crowd, place, passes, doc, root) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:5]))):
                if at != (crowd, place):
                    at, mine, index, over = (crowd, place), [], None, {}
                elements = np.frombuffer(batch.column(5)[row].as_buffer(), np.uint64)
                if not passes:
                    mine.append((doc, root, elements.copy()))
                    continue
                if not mine:
                    continue
                if index is None:  # the place's own texts come first
                    sizes = np.array([len(x) for *_, x in mine])
                    held = np.concatenate([x for *_, x in mine])
                    order = np.argsort(held, kind="stable")
                    index = held[order], np.repeat(np.arange(len(mine)), sizes)[order], sizes
                held, who, sizes = index
                low, many = np.searchsorted(held, elements), np.searchsorted(held, elements, "right")
                many = many - low
                spots = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
                both = np.bincount(who[spots], minlength=len(mine))
                for k in np.flatnonzero(both >= (similarity - 1e-12) * (sizes + len(elements) - both)):
                    u, v = find(root), find(mine[k][1])
                    if u != v:
                        over[max(u, v)] = min(u, v)
                        out.append((doc, mine[k][0]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=schema)

    size = crowds.groupBy("crowd").agg(F.least(F.ceil(F.count("*") / TEXTS_IN_PLACE), F.lit(PLACES)).cast("int").alias("places"), F.count("*").alias("w"))
    count = crowds.count()
    dealt = join_heavy(crowds, written(size, "near-crowds"), ["crowd"], "w", count)
    held = written(texts.select("doc", "text").mapInArrow(sets, "doc long, elements binary").join(sized(dealt, count), "doc"), "near-sets")
    own = held.withColumn("place", F.pmod(F.xxhash64("doc"), "places").cast("int")).withColumn("passes", F.lit(False))
    by = held.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1))).withColumn("passes", F.lit(True))
    met = own.unionByName(by).select("crowd", "place", "passes", "doc", "root", "elements").repartition("crowd", "place").sortWithinPartitions("crowd", "place", "passes")
    return met.mapInArrow(compare, "a long, b long")


def _further_links(texts: DataFrame, marks: DataFrame, open_: DataFrame, words: int, similarity: float) -> list[DataFrame]:
    """Verified links (a, b), enough to connect all similar texts of `open_` (doc, root) that its roots do not connect yet."""
    count = open_.count()
    if not count:
        return []
    texts = texts.join(sized(open_.select("doc"), count), "doc", "left_semi").select("doc", "th", "text")
    prefixes = _prefixes(texts, words, similarity)
    held = written(prefixes.join(sized(open_, count), "doc"), "near-held")
    mixed = held.groupBy("key").agg(F.count("*").alias("c"), F.min("doc").alias("least"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    mixed = written(mixed.select("key", "c", "least", F.col("c").alias("weight")), "near-mixed")
    every, held = held, written(join_heavy(held, mixed, ["key"], "weight", held.count()), "near-held")
    crowds = components(held.filter(F.col("c") > CROWD_OF_TEXTS).select(F.col("doc").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("doc"), F.col("root").alias("crowd"))
    crowds = written(open_.join(sized(crowds, crowds.count()), "doc"), "near-crowds")
    few = held.filter(F.col("c") <= CROWD_OF_TEXTS).select("key", "doc", "n", "pos", "root").join(sized(crowds.select("doc", "crowd"), crowds.count()), "doc", "left")
    few = written(few, "near-few")
    pairs = written(_all_pairs(few, few.count(), similarity), "near-pairs")
    out = [written(_verified(texts, marks, pairs, words, similarity, 64), "near-links"), written(_compared(texts, crowds, words, similarity), "near-links")]
    dropped(prefixes, every, held, mixed, crowds, few, pairs)
    return out


def similar_groups(docs: DataFrame, *, words: int = STAGE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """node (doc_id), root (the smallest doc_id of its group) of every document in a group of two or more.

    A group is connected by links between texts whose sets of shingles of `words`
    words have a Jaccard similarity of `similarity` or more. Texts with equal
    words are linked, so are all without words (null, empty, white space); a text
    with fewer words has its whole sequence as its only shingle. Rows of a null
    doc_id take no part; rows that share a doc_id are one node. No links, or an
    empty table, give no rows; further columns are not read.

    Each link is verified on whole texts. Equal texts are linked as such. Others
    meet through shared block keys: first each meets one other. Those that still
    share a key with a text of another group meet through the rare elements of
    their sets, which every two similar sets share: in pairs where few have an
    element, else each crowd is compared in place.
    """
    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc", F.xxhash64("text").alias("th"), "text")
    made = _made(texts, words, similarity)
    marks = written(made.select("doc", "th", "fp", "n"), "near-marks")
    rows = made.select(F.explode("keys").alias("key"), "doc")
    total = made.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    if not total:
        return marks.select(F.col("doc").alias("node"), F.col("doc").alias("root")).limit(0)
    copied = written(marks.groupBy("th").agg(F.min("doc").alias("least"), F.count("*").alias("w")), "near-texts")
    pairs, first = _first_pairs(rows, total)
    links = written(_equal(marks, copied).unionByName(_verified(texts, marks, pairs, words, similarity)), "near-links")
    reps = written(copied.select(F.col("least").alias("doc")).distinct(), "near-texts")
    roots = components(links)
    open_ = _open(rows, total, first.select("key", "n"), roots, reps)
    dropped(made, first, pairs, copied, reps, roots)
    further = _further_links(texts, marks, open_, words, similarity)
    found = components(reduce(DataFrame.unionByName, further, links))
    dropped(marks, links, open_, *further)
    return found


def _verified(texts: DataFrame, marks: DataFrame, pairs: DataFrame, words: int, similarity: float, bits: int = SET_DISTANCE) -> DataFrame:
    """The pairs (a, b) that are similar enough: equal, or of like size, with fingerprints that differ in `bits` bits at most, and then similar as whole texts.

    A text in many pairs goes to several tasks, each with FANOUT pairs about.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    n, m = pairs.count(), marks.count()
    a, b = (marks.select(F.col("doc").alias(x), F.col("th").alias(f"t{x}"), F.col("fp").alias(f"f{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    weight = pairs.groupBy("b").agg(F.count("*").alias("w"))
    marked = pairs.join(sized(a, m), "a")
    marked = marked.join(sized(b, m), "b") if m <= BROADCAST_ROWS else join_heavy(marked, b.join(weight.hint("merge"), "b"), ["b"], "w", n)
    near = (F.col("ta") == F.col("tb")) | (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= bits) & (F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-9)
    marked = written(marked.filter(near).select("a", "ta", "b", "tb"), "near-marked")
    equal, open_ = marked.filter("ta = tb").select("a", "b"), marked.filter("ta <> tb")
    texts = texts.dropDuplicates(["doc", "th"]) if texts.groupBy("doc", "th").count().filter("count > 1").limit(1).count() else texts
    spread = written(open_.groupBy("b", "tb").agg(F.count("*").alias("w")).withColumn("copies", F.ceil(F.col("w") / FANOUT).cast("int")), "near-spread")
    dealt = join_heavy(open_, spread, ["b", "tb"], "w", open_.count()).withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int")).drop("copies")
    many = spread.select("b", "tb", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    wanted = written(open_.select(F.col("a").alias("doc")).union(open_.select("b")).distinct(), "near-wanted")
    texts = texts.join(sized(wanted, wanted.count()), "doc", "left_semi")
    second = texts.select(F.col("doc").alias("b"), F.col("th").alias("tb"), F.col("text").alias("y")).join(sized(many, many.count()), ["b", "tb"])
    first = texts.select(F.col("doc").alias("a"), F.col("th").alias("ta"), F.col("text").alias("x")).join(sized(dealt, open_.count()), ["a", "ta"])
    joined = first.join(second.hint("merge"), ["b", "tb", "copy"]).select("a", "b", "x", "y")

    def run(batches):
        release()
        held, kept = None, np.zeros(0, np.uint64)
        for batch in batches:
            for begin, end in groups(batch.column(2)):
                part = batch.slice(begin, end - begin)
                keep = []
                for k in range(part.num_rows):
                    y = part.column(3)[k].as_py()
                    if y != held:  # pairs of one text come one after another
                        held, kept = y, shingle_set(y, words)
                    keep.append(jaccard(shingle_set(part.column(2)[k].as_py(), words), kept) >= similarity - 1e-12)
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], schema=schema)

    return equal.unionByName(joined.mapInArrow(run, "a long, b long"))
