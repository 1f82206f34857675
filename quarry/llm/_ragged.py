"""Ids of whole texts from a bounded table of what their pieces encode to.

A batch of texts is cut at spaces and its distinct pieces are numbered by Arrow,
so Python sees each distinct piece of a batch once and a new one once per worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded together, unless one text is longer.
GROUP_BYTES = 6 << 20


def groups(texts: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `most` bytes of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > most:
            yield begin, k
            begin, held = k, 0
        held += int(n)
    if begin < len(sizes):
        yield begin, len(sizes)


class PieceTable:
    #: Entries at most; then the table starts anew. Longer pieces are encoded each time.
    ENTRIES = 900_000
    LENGTH = 48

    def __init__(self):
        self.known: dict[str, bytes] = {}

    def new(self, missing: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of pieces that the table lacks."""
        raise NotImplementedError

    def _blank(self, data: np.ndarray) -> None:
        """Turn the bytes that part pieces as a space does into spaces."""

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another, and where each text's ids begin (one more entry than texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n, offsets = len(texts), np.frombuffer(texts.buffers()[1], dtype="<i8", count=len(texts) + texts.offset + 1)[texts.offset :]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].copy() if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self._blank(data)
        texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data))
        cut = pc.split_pattern(texts, " ")
        numbered = cut.flatten().dictionary_encode()
        index = numbered.indices.to_numpy()
        coded = self.lookup(numbered.dictionary.to_pylist())
        lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) >> 2
        flat = np.frombuffer(b"".join(coded), dtype="<u4")
        begins = np.cumsum(lengths) - lengths
        each = lengths[index]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(begins[index] - (ends - each), each) + np.arange(total)] if total else np.zeros(0, "<u4")
        bounds = np.concatenate([[0], ends])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return ids, bounds

    def lookup(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > self.ENTRIES:
            self.known = {}
        out = list(map(self.known.get, pieces))
        at = [k for k, x in enumerate(out) if x is None]
        if at:
            missing = [pieces[k] for k in at]
            for k, w, b in zip(at, missing, self.new(missing)):
                out[k] = b
                if len(w) <= self.LENGTH:
                    self.known[w] = b
        return out
