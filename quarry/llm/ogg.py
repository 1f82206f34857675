"""Media columns: Ogg.

`write_stream` makes a physical stream of one or more logical ones, `read_stream`
parses it: page checksums are verified, packets are put together from lacing
values across pages, logical streams are told apart by serial number, and each
packet gets a timestamp from the granule positions of its pages. A stored text is
two logical streams, of samples and of levels, with their pages in turn.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ragged import groups

RATE = 8000
BLOCK = 64
SAMPLES = 4096
HEAD = struct.Struct("<4sBBqIIIB")
#: Of samples as a packet: name of the mapping, version, channels, bits, rate.
PCM = struct.Struct("<8sBBHI")
MAGIC, LEVELS = b"PCM8raw ", b"PCM8lev "
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC of a page whose checksum field is zero: polynomial 0x04c11db7, most significant bit first, no inversion.

    zlib has the same polynomial with the least significant bit first; mirrored
    bytes in and a mirrored result out give this one.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


@dataclass
class Packet:
    data: bytes
    granule: int  # of the packet's end if it is the last that ends on a page, else -1


@dataclass
class Logical:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    ended: bool = False


class Pages:
    """Writes the pages of one logical stream."""

    def __init__(self, serial: int):
        self.serial, self.number = serial, 0

    def page(self, lacing: bytes, body: bytes, granule: int, kind: int) -> bytes:
        head = HEAD.pack(b"OggS", 0, kind, granule, self.serial, self.number, 0, len(lacing)) + lacing
        self.number += 1
        crc = page_checksum(head + body)
        return head[:22] + struct.pack("<I", crc) + head[26:] + body

    def pages(self, packets: list[tuple[bytes, int]]) -> list[bytes]:
        """Packets with the granule position at which each ends. The first one has a page alone, as formats ask."""
        out, lacing, body, granule, open_packet = [], bytearray(), bytearray(), -1, False
        for k, (data, end) in enumerate(packets):
            at, laces = 0, len(data) // 255 + 1
            while laces:
                n = min(255 - len(lacing), laces)
                take = min(255 * n, len(data) - at)
                done = n == laces
                lacing += b"\xff" * (n - 1) + bytes([len(data) % 255]) if done else b"\xff" * n
                body += data[at : at + take]
                at, laces = at + take, laces - n
                if done:
                    granule = end
                last = done and k == len(packets) - 1
                if len(lacing) == 255 or last or done and not k:
                    kind = open_packet | 2 * (not self.number) | 4 * last
                    out.append(self.page(bytes(lacing), bytes(body), granule, kind))
                    lacing, body, granule, open_packet = bytearray(), bytearray(), -1, not done
        return out


def write_stream(streams: list[tuple[int, list[tuple[bytes, int]]]]) -> bytes:
    """Streams as (serial, packets with their end granules). First pages come first, then pages turn by turn."""
    if len({s for s, _ in streams}) != len(streams):
        raise ValueError("serial numbers repeat")
    pages = [Pages(serial).pages(packets) for serial, packets in streams]
    out = [p[0] for p in pages if p]
    for k in range(1, max(map(len, pages), default=0)):
        out += [p[k] for p in pages if k < len(p)]
    return b"".join(out)


def read_stream(media: bytes) -> dict[int, Logical]:
    """Logical streams by serial number. Raises ValueError for a damaged or incomplete stream."""
    at, found, partial, expected = 0, {}, {}, {}
    view = memoryview(media)
    while at < len(media):
        if len(media) - at < HEAD.size:
            raise ValueError("a page header is cut off")
        magic, version, kind, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        lacing = media[at + 27 : at + 27 + n]
        body_at = at + 27 + n
        end = body_at + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise ValueError("a page is cut off")
        if page_checksum(b"".join((view[at : at + 22], bytes(4), view[at + 26 : end]))) != crc:
            raise ValueError(f"page {number} of stream {serial}: checksum")
        if bool(kind & 2) != (serial not in found):
            raise ValueError(f"stream {serial} begins twice or not at all")
        stream = found.setdefault(serial, Logical(serial))
        if stream.ended or number != expected.get(serial, 0):
            raise ValueError(f"stream {serial}: page {number} is out of order")
        expected[serial] = number + 1
        if bool(kind & 1) != (serial in partial):
            raise ValueError(f"stream {serial}: page {number} continues nothing, or fails to continue")
        held = partial.pop(serial, [])
        first, start, size = len(stream.packets), body_at, 0
        for v in lacing:
            size += v
            if v < 255:
                held.append(view[start : start + size])
                stream.packets.append(Packet(b"".join(held), -1))
                held, start, size = [], start + size, 0
        if size or lacing and lacing[-1] == 255:
            held.append(view[start : start + size])
            partial[serial] = held
        if len(stream.packets) > first:
            stream.packets[-1].granule = granule  # a page's position is that of the last packet that ends on it
        stream.ended = bool(kind & 4)
        at = end
    if partial or any(not s.ended for s in found.values()):
        raise ValueError("a stream does not end")
    return found


def levels(payload: bytes, at: int) -> bytes:
    """Lowest, highest and rounded mean sample of the packet that begins at `at`."""
    part = np.frombuffer(payload, np.uint8, min(SAMPLES, len(payload) - at), at)
    return bytes((int(part.min()), int(part.max()), int(part.mean() + 0.5)))


def store_samples(payload: bytes) -> bytes:
    """Samples of 8 bits, one channel, losslessly, and beside them a stream with the levels of each packet of samples.

    Both streams count samples in their granule positions. Serial numbers follow
    from the samples, so equal payloads are stored alike.
    """
    ends = [(k, min(k + SAMPLES, len(payload))) for k in range(0, len(payload), SAMPLES)]
    samples = [(PCM.pack(MAGIC, 1, 1, 8, RATE), 0)] + [(payload[k:end], end) for k, end in ends]
    beside = [(PCM.pack(LEVELS, 1, 3, 8, RATE), 0)] + [(levels(payload, k), end) for k, end in ends]
    serial = zlib.crc32(payload)
    return write_stream([(serial, samples), ((serial + 1) & 0xFFFFFFFF, beside)])


def positions(packets: list[Packet], units: Callable[[int, Packet], int]) -> list[int]:
    """Granule position at which each packet ends.

    A page tells that of the last packet that ends on it; those of the packets
    before it on the page follow by counting back their units. Raises ValueError
    if the first of them would not begin where the page before ended.
    """
    out, held, before = [], [], 0
    for k, p in enumerate(packets):
        held.append((k, p))
        if p.granule < 0:
            continue
        ends, at = [], p.granule
        for j, q in reversed(held):
            ends.append(at)
            at -= units(j, q)
        if at != before:
            raise ValueError("granule positions and packets disagree")
        out += reversed(ends)
        held, before = [], p.granule
    if held:
        raise ValueError("packets without a granule position")
    return out


def load_samples(media: bytes) -> tuple[bytes, list[float]]:
    """The samples of a stored payload and the second at which each packet ends, from the granule positions.

    The logical streams are told apart by their first packets. Raises ValueError
    if one is missing or damaged, or if the two disagree on times or levels.
    """
    by_kind = {}
    for stream in read_stream(media).values():
        head, *rest = stream.packets
        if len(head.data) != PCM.size or head.granule != 0:
            raise ValueError(f"stream {stream.serial} does not say what it holds")
        kind, version, _, bits, rate = PCM.unpack(head.data)
        if version != 1 or bits != 8 or not rate or kind in by_kind:
            raise ValueError(f"stream {stream.serial} is of an unknown kind")
        by_kind[kind] = (rest, rate)
    if set(by_kind) != {MAGIC, LEVELS}:
        raise ValueError("no stream of samples, or none of levels")
    (packets, rate), (beside, _) = by_kind[MAGIC], by_kind[LEVELS]
    ends = positions(packets, lambda _, p: len(p.data))
    if len(beside) != len(packets) or positions(beside, lambda k, _: len(packets[k].data)) != ends:
        raise ValueError("the streams end at different times")
    samples = b"".join(p.data for p in packets)
    if any(q.data != levels(samples, end - len(p.data)) for p, q, end in zip(packets, beside, ends)):
        raise ValueError("samples and levels disagree")
    return samples, [end / rate for end in ends]


def feature(samples: bytes, times: list[float]) -> str:
    """Duration, packets, mean, deviation, crossings of the middle and the share of each quarter of the range."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    total, values = len(x), np.arange(256)
    mean = float(counts @ values) / total
    var = float(counts @ (values * values)) / total - mean * mean
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    quarters = [round(float(q) / total, 6) for q in counts.reshape(4, 64).sum(axis=1)]
    return json.dumps({"seconds": round(times[-1], 6), "packets": len(times), "mean": round(mean, 6), "deviation": round(max(var, 0.0) ** 0.5, 6), "crossings": crossings, "quarters": quarters})


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column of every whole text.

    Null and empty texts are 64 zero samples; repeated rows each give a row; an
    empty table gives none; further columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for batch in batches:
            for begin, end in groups(batch.column(1)):
                part = batch.slice(begin, end - begin)
                made = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([store_samples(p) for _, p in made], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """Read the media column back and compute features of the samples."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    schema = pa.schema(fields)

    def run(batches):
        for batch in batches:
            for begin, end in groups(batch.column(2)):
                part = batch.slice(begin, end - begin)
                rows = []
                for m in part.column(2):
                    stored = m.as_py()
                    samples, times = load_samples(stored)
                    rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples, times)))
                columns = [pa.array(c, f[1]) for c, f in zip(zip(*rows), fields[2:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)
