"""Shaping of answers: budgets, path compression, near misses."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest(keys: DataFrame, key: str, known: DataFrame, name: str, most: int = 3) -> DataFrame:
    """key -> the known name of the smallest edit distance of at most `most`, the first of equals; both are short lists of settings."""
    d = F.levenshtein(F.lower(key), F.lower(name))
    hit = keys.join(F.broadcast(known), d <= most).groupBy(key).agg(F.min_by(name, F.struct(d, name)).alias("nearest"))
    return keys.join(hit, key, "left")


OVERHEAD, LEAST, SHORTEST = 24, 3, 4  # fixed values: cost of a group, its fewest paths, the shortest prefix


def compress_paths(paths: list[str]) -> tuple[list[tuple[str, list[str]]], list[str]]:
    """Groups of (prefix, rest) and the paths that stay. Takes the folder that saves most, again and again; of equals the longer, then the smaller."""
    left, groups = list(dict.fromkeys(paths)), []
    while True:
        counts: Counter[str] = Counter()
        for p in left:
            at = p.find("/")
            while at >= 0:
                counts[p[: at + 1]] += 1
                at = p.find("/", at + 1)
        options = [((n - 1) * len(d) - OVERHEAD, len(d), d) for d, n in counts.items() if n >= LEAST and len(d) >= SHORTEST]
        options = [o for o in options if o[0] > 0]
        if not options:
            return groups, left
        prefix = min(options, key=lambda o: (-o[0], -o[1], o[2]))[2]
        groups.append((prefix, [p[len(prefix) :] for p in left if p.startswith(prefix)]))
        left = [p for p in left if not p.startswith(prefix)]


def compressed_rows(paths: DataFrame) -> DataFrame:
    """key, prefix, rest of each (key, path): `compress_paths` of every key's distinct paths; the prefix is empty where a path stays.

    An answer's paths are one key; each is compressed on its own, and in memory,
    as an answer is.
    """
    import pandas as pd

    def one(group: pd.DataFrame) -> pd.DataFrame:
        groups, left = compress_paths(sorted(group["path"]))
        rows = [(group["key"].iloc[0], d, p) for d, ps in groups for p in ps] + [(group["key"].iloc[0], "", p) for p in left]
        return pd.DataFrame(rows, columns=["key", "prefix", "rest"])

    return paths.select("key", "path").distinct().groupBy("key").applyInPandas(one, "key string, prefix string, rest string")


def expand_groups(groups: list[tuple[str, list[str]]], rest: list[str]) -> list[str]:
    return sorted([d + p for d, ps in groups for p in ps] + rest)


def estimate(text: str) -> int:
    return -(-len(text.encode("utf-16-le")) // 2 // 4) if text else 0


def fit_payload(payload: dict, sections: dict[str, int], max_tokens: int, render: Callable[[dict], str] = json.dumps) -> dict:
    """Drop list sections by rank (highest first, then name) until the rendered payload fits; the last one dropped gets back its longest prefix that does.

    `omitted` counts what each section lost; `overBudget` says that even the
    payload without sections is too long.
    """
    out = {k: (list(v) if k in sections else v) for k, v in payload.items()}
    if estimate(render(out)) <= max_tokens:
        return out
    omitted: dict[str, int] = {}
    for name in sorted((s for s in sections if s in out), key=lambda s: (-sections[s], s)):
        whole = out[name]
        out[name], omitted[name] = [], len(whole)
        out["omitted"] = omitted
        if estimate(render(out)) <= max_tokens:
            low, high = 0, len(whole)
            while low < high:
                mid = (low + high + 1) // 2
                out[name], omitted[name] = whole[:mid], len(whole) - mid
                if estimate(render(out)) <= max_tokens:
                    low = mid
                else:
                    high = mid - 1
            out[name], omitted[name] = whole[:low], len(whole) - low
            if not omitted[name]:
                del omitted[name]
            return out
    out["overBudget"] = True
    return out


def envelope(payload: dict, tool: str, version: int = 1) -> dict:
    return {"schemaVersion": version, "tool": tool, **payload}
