"""Token ids of whole texts, as the `tokenizers` library gives them.

A text is cut at ASCII white space, which the tokenizer drops and no rule of it
crosses. What the library returned for a piece is kept in a bounded table of the
worker, so a frequent word is encoded once per worker and not once per use.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
import regex

from ._ragged import PieceTable

# The split pattern of the tokenizer file, for lower-case text.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Letters below this code point lower-case one by one, whatever stands beside them, and are already composed.
SIMPLE_BELOW = "ɐ"
#: White space that the libraries' patterns see differently, a letter whose lower case is two characters, and what may begin a special token.
ODD = regex.compile("[\x1c-\x1f\x85\xa0İ]|<\\|")


class WordTokens(PieceTable):
    """`encode(texts)` gives the ids of an Arrow array of texts.

    A null text counts as empty; it and white space alone have no ids.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix") or ""
        split = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        normal = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.ends = {i for piece, i in spec["model"]["vocab"].items() if suffix and piece.endswith(suffix)}
        if not suffix or [x["pattern"].get("Regex") for x in split] != [SPLIT.pattern] or normal != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: its rules are not known to leave pieces between white space independent")
        self.words: dict[str, bytes] = {}

    def _blank(self, data: np.ndarray) -> None:
        data[(data == 9) | (data == 10) | (data == 13)] = 32

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def new(self, missing: list[str]) -> list[bytes]:
        if len(self.words) > self.ENTRIES:
            self.words = {}
        words, whole, parts = self.words, [], []
        for w in missing:
            if (w.isascii() or max(w) < SIMPLE_BELOW) and not ODD.search(w):
                parts.append(SPLIT.findall(w.lower()))
            else:
                parts.append(None)
                whole.append(w)
        fresh = list({p for ps in parts if ps for p in ps if p not in words})
        coded = dict(zip(fresh, self._words(fresh)))
        words.update((p, b) for p, b in coded.items() if len(p) <= self.LENGTH)
        by_library = iter(self.library(whole) if whole else [])
        return [next(by_library) if ps is None else b"".join([words[p] if p in words else coded[p] for p in ps]) for ps in parts]

    def _words(self, fresh: list[str]) -> list[bytes]:
        """Of pieces that the split pattern leaves whole: joined by spaces, told apart by the ids that end a word."""
        out: list[bytes] = []
        for at in range(0, len(fresh), 512):
            part = fresh[at : at + 512]
            ids = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids
            stops = [k + 1 for k, i in enumerate(ids) if i in self.ends]
            if len(stops) != len(part) or stops[-1] != len(ids):
                out += self.library(part)
                continue
            data, begin = np.array(ids, "<u4").tobytes(), 0
            for stop in stops:
                out.append(data[begin : 4 * stop])
                begin = 4 * stop
        return out


@functools.lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One per worker and file."""
    return WordTokens(path)


def encoded(texts: pa.Array, path: str) -> list[np.ndarray]:
    """Ids of a few texts (tests and small inputs)."""
    ids, bounds = word_tokens(path).encode(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    return [ids[a:b] for a, b in zip(bounds, bounds[1:])]
