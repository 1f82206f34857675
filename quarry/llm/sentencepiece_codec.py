"""SentencePiece encoding and decoding for merge-type vocabularies.

Method: a score-ordered agenda of adjacent symbol pairs. Each segment starts as
single characters; the agenda holds the adjacent pairs whose concatenation is a
piece, best score first and leftmost first among equals; the head is merged if
both its symbols are still there, and the two new neighbours enter. Characters
without a piece fall back to their UTF-8 bytes.

No piece of such a vocabulary has the space mark after another character, so no
merge crosses the start of a run of space marks: runs with the characters behind
them are encoded alone, and equal ones once per worker. Every result of the
agenda is checked against the sentencepiece library within its Arrow batch; should
the two differ, the library's ids are taken and the case is counted.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from heapq import heapify, heappop, heappush
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ragged import PieceTable, groups

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")
RUN = re.compile(r"[^\W\d_]+|[\W\d_]+")
#: Up to this many symbols the agenda is a plain array of scores, beyond it a heap.
SHORT = 40


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class PieceCodec(PieceTable):
    """`encode(texts)` gives the ids of an Arrow array of texts, `decode` the texts of ids."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.library = p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, scored, self.bytes = {}, {}, {}
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (p.is_control(i) or p.is_unknown(i)):
                self.ids[piece] = i
                if len(piece) > 1:
                    scored[piece] = p.get_score(i)
        self.unknown = p.unk_id()
        if any(SPACE in piece.lstrip(SPACE) for piece in scored):
            raise ValueError("a piece has a space mark after another character: segments are not independent")
        # equal scores share a rank, so that the leftmost of them comes first
        ranks = {s: k for k, s in enumerate(sorted(set(scored.values()), reverse=True))}
        self.rank = {piece: ranks[s] for piece, s in scored.items()}
        #: neighbours within some piece; between others nothing merges
        self.inside = {piece[k : k + 2] for piece in scored for k in range(len(piece) - 1)}
        self.runs: dict[str, bytes] = {}
        #: Pieces and texts of which the library gave other ids than the agenda; its ids are taken.
        self.differences = 0

    def symbols(self, segment: str) -> list[str]:
        """What is left of a segment's characters after all merges."""
        return self._short(segment) if len(segment) <= SHORT else self._long(segment)

    def _short(self, segment: str) -> list[str]:
        get, out = self.rank.get, list(segment)
        agenda = [get(a + b, inf) for a, b in zip(segment, segment[1:])]
        while agenda and (best := min(agenda)) is not inf:
            k = agenda.index(best)
            merged = out[k] + out[k + 1]
            out[k : k + 2] = [merged]
            del agenda[k]
            if k:
                agenda[k - 1] = get(out[k - 1] + merged, inf)
            if k < len(agenda):
                agenda[k] = get(merged + out[k + 1], inf)
        return out

    def _long(self, segment: str) -> list[str]:
        rank, out = self.rank, list(segment)
        n = len(out)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := out[i] + out[i + 1]) in rank]
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if not out[i] or j >= n or out[i] + out[j] != pair:
                continue  # one of the two has been merged since
            out[i], out[j] = pair, ""
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (p := pair + out[j]) in rank:
                    heappush(heap, (rank[p], i, p))
            h = before[i]
            if h >= 0 and (p := out[h] + pair) in rank:
                heappush(heap, (rank[p], h, p))
        return [s for s in out if s]

    def agenda(self, segment: str) -> list[int]:
        """Ids of one segment."""
        out, ids = [], self.ids
        for s in self.symbols(segment):
            if (i := ids.get(s)) is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode("utf-8")]
            else:
                out.append(self.unknown)
        return out

    def _segment(self, segment: str) -> bytes:
        """By runs of letters and of other characters, as far as no piece spans their meeting point."""
        runs = RUN.findall(segment[1:])
        if not runs:
            return packed(self.agenda(segment))
        runs[0] = SPACE + runs[0]
        held, out = runs[0], []
        for r in runs[1:]:
            if held[-1] + r[0] in self.inside:
                held += r
            else:
                out.append(held)
                held = r
        out.append(held)
        known = self.runs
        for k, r in enumerate(out):
            b = known.get(r)
            if b is None:
                b = packed(self.agenda(r))
                if len(r) <= self.LENGTH:
                    known[r] = b
            out[k] = b
        return b"".join(out)

    def new(self, missing: list[str]) -> list[bytes]:
        """Of pieces between spaces; their space mark is not in them. All are checked against the library."""
        if len(self.runs) > self.ENTRIES:
            self.runs = {}
        out = [self._segment(SPACE + w) for w in missing]
        for k, (w, theirs) in enumerate(zip(missing, self.library.encode(missing, num_threads=1))):
            if w and out[k] != packed(theirs):  # the library gives nothing for an empty text
                out[k] = packed(theirs)
                self.differences += 1
        return out

    def whole(self, text: str) -> np.ndarray:
        """Of one text with runs of spaces or with space marks of its own, checked as a whole."""
        if not text:
            return np.zeros(0, "<u4")
        ids = [i for seg in SEGMENT.findall(SPACE + text.replace(" ", SPACE)) for i in self.agenda(seg)]
        theirs = self.library.encode(text)
        self.differences += ids != theirs
        return np.array(theirs, "<u4")

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, f"  |^ | $|{SPACE}"), pc.equal(texts, ""))
        ids, bounds = self.encode(pc.if_else(odd, "", texts))
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            out[k] = self.whole(texts[k].as_py())
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


@functools.lru_cache(maxsize=2)
def piece_codec(path: str) -> PieceCodec:
    return PieceCodec(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, model_path: str, *, with_ids: bool = False, with_text: bool = False, differences=None) -> DataFrame:
    """Encode every whole text, then decode the ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and on request
    `ids array<int>` and `decoded string`. `differences`, a Spark accumulator, adds
    up the cases in which the agenda and the library differed.

    Defined results: a null or empty text has no ids, and decodes to the empty
    text; rows that repeat, also whole rows, each give a row; a null doc_id stays
    null; an empty table gives no rows; further columns are not read, whatever
    their names. A long text, also one without a space, is encoded whole.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = SCHEMA
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        ddl += ", ids array<int>"
    if with_text:
        fields.append(("decoded", pa.string()))
        ddl += ", decoded string"
    schema = pa.schema(fields)

    def run(batches):
        codec = piece_codec(model_path)
        before = codec.differences
        for batch in batches:
            for begin, end in groups(batch.column(1)):
                part = batch.slice(begin, end - begin)
                ids = [x.tolist() for x in codec.texts(part.column(1))]
                decoded = codec.decode(ids)
                columns = [
                    part.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                ]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                if with_text:
                    columns.append(pa.array(decoded, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        if differences is not None and codec.differences > before:
            differences.add(codec.differences - before)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, ddl)
