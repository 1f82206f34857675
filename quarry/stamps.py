"""Sidecars of a cache: whether its last build was finished, and on what settings. And files of it over HTTP."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable
from functools import partial
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

STAMP = "build.json"


def read_stamp(cache: str) -> dict | None:
    """Null if it is missing or cannot be read."""
    try:
        made = json.loads(Path(cache, STAMP).read_text())
    except (OSError, ValueError):
        return None
    return made if isinstance(made, dict) else None


def write_stamp(cache: str, stamp: dict) -> None:
    """Through a file beside it, so readers see the old one or the new one."""
    os.makedirs(cache, exist_ok=True)
    at, path = tempfile.mkstemp(dir=cache)
    with os.fdopen(at, "w") as f:
        json.dump(stamp, f, sort_keys=True)
    os.replace(path, Path(cache, STAMP))


def build(cache: str, root: str, layers: dict[str, Callable[[], object]], contexts: dict[str, str], version: str = "1") -> dict:
    """Run each layer and stamp the cache.

    The stamp says that it is unfinished before anything is touched, so a build
    that is cut short never looks whole. A layer's context is noted once it is
    done; those of layers that are not run now stay, if the root is the same.
    """
    before = read_stamp(cache) or {}
    known = dict(before.get("contexts", {})) if before.get("root") == root else {}
    stamp = {"version": version, "root": root, "complete": False, "contexts": known}
    write_stamp(cache, stamp)
    for name, make in layers.items():
        known.pop(name, None)
        write_stamp(cache, stamp)
        make()
        known[name] = contexts[name]
        write_stamp(cache, stamp)
    stamp["complete"] = True
    write_stamp(cache, stamp)
    return stamp


class SharedOnce:
    """One value, made anew when its key changes: two layers that need the same parsed sources share them."""

    def __init__(self):
        self.key, self.value = None, None

    def get(self, key: object, make: Callable[[], object]) -> object:
        if key != self.key or self.value is None:
            self.key, self.value = key, make()
        return self.value


class _Below(SimpleHTTPRequestHandler):
    def translate_path(self, path: str) -> str:
        real, root = os.path.realpath(super().translate_path(path)), os.path.realpath(self.directory)
        return real if real == root or real.startswith(root + os.sep) else os.path.join(root, ".outside-of-the-root")

    def log_message(self, *_: object) -> None:
        pass


def static_server(root: str, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Files below a folder, read only; links out of it are not followed. The caller runs and closes it."""
    return ThreadingHTTPServer((host, port), partial(_Below, directory=root))
