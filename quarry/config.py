"""Settings: strict keys with near misses named, defaults, and the hash that tells builds apart."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class EngineConfig:
    project_name: str = "project"
    cache_dir: str = ".graph"
    ignore_file: str = ".gitignore"
    src_roots: tuple[str, ...] = ("src",)
    paths: dict[str, list[str]] = field(default_factory=dict)  # alias patterns, in order
    entry_points: tuple[str, ...] = ()
    domains: dict[str, str] = field(default_factory=dict)  # domain -> kind
    aliases: dict[str, str] = field(default_factory=dict)  # segment -> domain
    buckets: dict[str, str] = field(default_factory=dict)  # path prefix -> domain, in order
    rules: dict[str, object] = field(default_factory=dict)
    limit: int = 20
    max_depth: int = 25
    max_tokens: int | None = None
    compress_paths: bool = False


#: Settings that change no layer.
NOT_BUILT = ("cache_dir", "rules", "limit", "max_depth", "max_tokens", "compress_paths")


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def nearest_name(key: str, known: list[str], most: int = 3) -> str | None:
    """The first of the nearest known names within `most` edits."""
    options = [(distance(key.lower(), k.lower()), n, k) for n, k in enumerate(known)]
    best = min(options, default=(most + 1, 0, None))
    return best[2] if best[0] <= most else None


def load_config(given: dict) -> EngineConfig:
    known = {f.name: f for f in fields(EngineConfig)}
    problems = []
    for k, v in given.items():
        if k not in known:
            near = nearest_name(k, list(known))
            problems.append(f"unknown key {k!r}" + (f", did you mean {near!r}?" if near else ""))
            continue
        default = getattr(EngineConfig(), k)
        wanted = (list, tuple) if isinstance(default, tuple) else (int, type(None)) if k == "max_tokens" else type(default)
        if not isinstance(v, wanted) or isinstance(v, bool) is not isinstance(default, bool):
            problems.append(f"{k}: {type(v).__name__} is not what it takes")
        elif k in ("limit", "max_depth", "max_tokens") and v is not None and v <= 0:
            problems.append(f"{k}: a positive integer is needed")
    if unassigned := {d for d in given.get("aliases", {}).values() if given.get("domains") and d not in given["domains"]}:
        given = given | {"aliases": {s: ("unassigned" if d in unassigned else d) for s, d in given["aliases"].items()}}
    if problems:
        raise ConfigError("; ".join(problems))
    return EngineConfig(**{k: tuple(v) if isinstance(v, list) and isinstance(getattr(EngineConfig(), k), tuple) else v for k, v in given.items()})


def build_hash(cfg: EngineConfig, version: str = "1") -> str:
    """Of all settings that change a layer, keys sorted."""
    rest = {k: v for k, v in asdict(cfg).items() if k not in NOT_BUILT}
    return hashlib.sha256(json.dumps([version, rest], sort_keys=True).encode()).hexdigest()
