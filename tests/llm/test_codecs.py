"""Tokenizers, sequence files, media and packing: against the libraries, round trips and bounds."""

import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import arrow_sequences, ogg, packing, sentencepiece_codec, word_tokens
from quarry.llm._shared import scratch

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
HF = Tokenizer.from_file(WORDS)
ALPHABET = st.text(st.sampled_from(list("aeinrst THE.,'\n\t▁<|>0é😀ß\x00\x85　")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET | st.text(max_size=30), max_size=5))
def test_agenda_is_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    codec = sentencepiece_codec.piece_codec(PIECES)
    got = codec.texts(pa.array(texts, pa.string()))
    assert codec.differences == 0
    assert [x.tolist() for x in got] == [LIBRARY.encode(t) for t in texts]


def test_long_agenda_is_the_short_one():
    c = sentencepiece_codec.piece_codec(PIECES)
    for s in ("▁internationalization", "▁aaaaaaaaaaaaaaab", "▁thethethethe"):
        assert c._short(s) == c._long(s)


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET | st.text(max_size=30), max_size=5))
def test_word_ids_are_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = word_tokens.encoded(texts, WORDS)
    assert [x.tolist() for x in got] == [HF.encode(t, add_special_tokens=False).ids for t in texts]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sentencepiece_rows(odd, empty, documents):
    for docs in (odd, documents.limit(40)):
        expected = []
        for r in docs.collect():
            ids = LIBRARY.encode(r["text"] or "")
            expected.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
        assert rows(sentencepiece_codec.encode_decode(docs, PIECES)) == sorted(expected, key=repr)
    count = odd.sparkSession.sparkContext.accumulator(0)
    sentencepiece_codec.encode_decode(odd, PIECES, differences=count).collect()
    assert count.value == 0
    assert sentencepiece_codec.encode_decode(empty, PIECES).count() == 0


def test_a_difference_is_counted_and_the_library_is_right():
    codec = sentencepiece_codec.PieceCodec(PIECES)
    codec.agenda = lambda segment: [7]
    assert [x.tolist() for x in codec.texts(pa.array(["a strange text", " two  spaces "]))] == [LIBRARY.encode("a strange text"), LIBRARY.encode(" two  spaces ")]
    assert codec.differences == 4


def test_sequence_files(odd, empty, spark):
    got = arrow_sequences.sequence_store(odd, WORDS, end_id=2)
    expected = {}
    for r in odd.collect():
        ids = np.array(HF.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        expected.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(ids.tobytes())))
    got_rows = got.orderBy("start").collect()
    assert [r["start"] for r in got_rows] == np.cumsum([0] + [r["n_tokens"] for r in got_rows])[:-1].tolist()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got_rows]
    assert ids == sorted(ids)
    for d in expected:
        assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got_rows if r["doc_id"] == d) == sorted(expected[d])
    assert arrow_sequences.sequence_store(empty, WORDS, end_id=2).count() == 0


def test_sequences_are_equal_length_and_masked(odd, spark):
    out = scratch(spark, "seq")
    manifest = arrow_sequences.write_sequences(odd, WORDS, out, end_id=2, length=64, rows=8)
    for m in manifest.collect():
        reader = arrow_sequences.ShardReader(out, m["name"])
        n = -(-m["n_tokens"] // 64)
        masks = [reader.sequence(k)[1] for k in range(n)]
        assert all(len(reader.sequence(k)[0]) == 64 for k in range(n)) and sum(x.sum() for x in masks) == m["n_tokens"]
        flat = np.concatenate([reader.sequence(k)[0] for k in range(n)])[: m["n_tokens"]]
        assert np.array_equal(flat, np.concatenate(list(reader.tokens(0, m["n_tokens"]))))
        reader.close()


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=1500), min_size=1, max_size=4), st.integers(0, 70_000))
def test_ogg_round_trip(packets, big):
    streams = [(7, [(p, k) for k, p in enumerate(packets)]), (9, [(b"head", 0), (bytes(big), big)])]
    media = ogg.write_stream(streams)
    back = ogg.read_stream(media)
    assert {s: [p.data for p in x.packets] for s, x in back.items()} == {s: [d for d, _ in ps] for s, ps in streams}
    assert ogg.page_checksum(media[:100]) == slow_crc(media[:100])


def test_ogg_times_come_from_granules():
    """Two streams; a page without the granule that its packets need, or with another, is refused."""
    payload = bytes(range(256)) * 700
    media = ogg.store_samples(payload)
    streams = ogg.read_stream(media)
    assert len(streams) == 2 and ogg.load_samples(media)[1] == [min(k + ogg.SAMPLES, len(payload)) / ogg.RATE for k in range(0, len(payload), ogg.SAMPLES)]
    (a, x), (b, y) = ((s, [(p.data, 0) for p in v.packets]) for s, v in streams.items())
    ends = [0] + [min(k + ogg.SAMPLES, len(payload)) for k in range(0, len(payload), ogg.SAMPLES)]
    timed = lambda packets, shift: [(d, e + shift * (k == len(ends) - 1)) for k, ((d, _), e) in enumerate(zip(packets, ends))]
    assert ogg.load_samples(ogg.write_stream([(a, timed(x, 0)), (b, timed(y, 0))]))[0] == payload
    for wrong in ([(a, timed(x, 7)), (b, timed(y, 0))], [(a, timed(x, 0)), (b, timed(y, 7))], [(a, timed(x, 0))], [(a, timed(x, 0)), (b, timed(y, 0)[:-1])], [(a, timed(x, 0)), (b, [*timed(y, 0)[:-1], (b"abc", ends[-1])])]):
        with pytest.raises(ValueError):
            ogg.load_samples(ogg.write_stream(wrong))


def test_ogg_damage():
    media = bytearray(ogg.store_samples(bytes(range(256)) * 40))
    samples, times = ogg.load_samples(bytes(media))
    assert samples == bytes(range(256)) * 40 and times[-1] == len(samples) / ogg.RATE
    for at in (5, 30, 60, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            ogg.load_samples(bytes(broken))
    with pytest.raises(ValueError):
        ogg.load_samples(bytes(media[:-3]))


def test_media_rows(odd, empty):
    out = ogg.media_features(ogg.to_media(odd)).collect()
    assert len(out) == odd.count()
    by = {(r["n_bytes"], r["payload_sha256"]): (r["media_sha256"], r["feature"]) for r in out}
    for r in out:
        assert r["payload_bytes"] % 64 == 0 and r["payload_bytes"] >= 64 and by[r["n_bytes"], r["payload_sha256"]] == (r["media_sha256"], r["feature"])
    expected = []
    for r in odd.collect():
        raw = (r["text"] or "").encode()
        n, raw = len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media, x = ogg.store_samples(raw), np.frombuffer(raw, np.uint8).astype(float)
        want = {"seconds": round(len(raw) / 8000, 6), "packets": -(-len(raw) // 4096), "mean": round(x.mean(), 6), "deviation": round(x.std(), 6), "crossings": sum((p >= 128) != (q >= 128) for p, q in zip(raw, raw[1:]))}
        want["quarters"] = [round(sum(k * 64 <= p < k * 64 + 64 for p in raw) / len(raw), 6) for k in range(4)]
        expected.append((r["doc_id"], n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(media), hashlib.sha256(media).hexdigest(), want))
    have = [(*(r[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")), json.loads(r["feature"])) for r in out]
    for got, want in zip(sorted(have, key=repr), sorted(expected, key=repr)):
        assert got[:7] == want[:7] and all(got[7][k] == pytest.approx(want[7][k], abs=2e-6) for k in want[7])
    assert ogg.media_features(ogg.to_media(empty)).count() == 0


def best_possible(lengths, capacity):
    """Exact number of bins of a few pieces, by search."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, bins[:i] + [bins[i] + lengths[k]] + bins[i + 1 :])
        place(k + 1, bins + [lengths[k]])

    place(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bounds_and_fit(lengths):
    x = np.array(sorted(lengths, reverse=True))
    bins, offsets, n = packing.best_fit_decreasing(x, 20)
    exact = best_possible(x.tolist(), 20)
    assert packing.lower_bound(x, 20) <= exact <= n
    used = {}
    for b, o, k in sorted(zip(bins, offsets, x)):
        assert used.get(b, 0) == o
        used[b] = o + k
    assert max(used.values()) <= 20 and len(used) == n


def check_packed(docs, packed):
    expected = {}
    for r in docs.collect():
        ids = np.array(HF.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            key = (r["doc_id"], p // 2048, p, len(part), zlib.crc32(part.tobytes()))
            expected[key] = expected.get(key, 0) + 1
    got, by = {}, {}
    for r in packed:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        got[key] = got.get(key, 0) + 1
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == expected
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048
    return len(by), sum(r["length"] for r in packed)


def test_packing(odd, empty, documents):
    n, total = check_packed(documents, packing.packed_documents(documents, WORDS, end_id=0).collect())
    assert n <= -(-total // 2048) + 1
    check_packed(odd, packing.packed_documents(odd, WORDS, end_id=0).collect())
    assert packing.packed_documents(empty, WORDS, end_id=0).count() == 0


def test_packing_repacks_partitions_with_gaps(spark):
    rows = [(k, 0, 0, 1024 if k % 2 else 1500, k) for k in range(60)]
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(items, per_partition=7).collect()
    assert len(packed) == 60 and len({r["doc_id"] for r in packed}) == 60
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append(r["length"])
    assert max(sum(b) for b in bins.values()) <= 2048 and 45 <= len(bins) <= 52
    one = packing.certificate(spark.createDataFrame(packed)).first()
    assert one["sequences"] == len(bins) and one["bound"] <= one["sequences"]
    assert packing.sequences(spark.createDataFrame(packed)).agg(F.max("position")).first()[0] >= 1
