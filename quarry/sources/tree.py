"""Source trees: an inventory of files, with ignore rules, hashes and revision."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths as fp
from quarry.model import directory_id, edge_id, file_id


class Ignore:
    """Rules of ignore files: later ones win, ! takes back, a slash binds to the root, a trailing one means folders only."""

    def __init__(self, lines: list[str]):
        self.rules = []
        for raw in lines:
            line = raw.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            folder = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            body = self._pattern(line.lstrip("/"))
            self.rules.append((re.compile(("^" if anchored else "(?:^|.*/)") + body + "$"), folder, keep))

    @staticmethod
    def _pattern(glob: str) -> str:
        out, k = "", 0
        while k < len(glob):
            if glob.startswith("**/", k):
                out, k = out + "(?:.*/)?", k + 3
            elif glob.startswith("**", k):
                out, k = out + ".*", k + 2
            elif glob[k] == "*":
                out, k = out + "[^/]*", k + 1
            elif glob[k] == "?":
                out, k = out + "[^/]", k + 1
            elif glob[k] == "[" and "]" in glob[k + 1 :]:
                end = glob.index("]", k + 1)
                out, k = out + "[" + glob[k + 1 : end].replace("!", "^", 1) + "]", end + 1
            else:
                out, k = out + re.escape(glob[k]), k + 1
        return out

    def match(self, path: str, folder: bool) -> bool:
        hit = False
        for pattern, only_folder, keep in self.rules:
            if (folder or not only_folder) and pattern.match(path):
                hit = not keep
        return hit


def ignore_of(root: str, names: tuple[str, ...] = (".gitignore", ".kgignore")) -> Ignore:
    lines: list[str] = []
    for n in names:
        p = Path(root, n)
        if p.is_file():
            lines += p.read_text(errors="replace").splitlines()
    return Ignore(lines)


def skipped(name: str, path: str, folder: bool, ignore: Ignore) -> bool:
    """Skipped folders, system files, credentials, dotenv files but samples, and what the ignore files say."""
    low = name.lower()
    if folder and (name in fp.SKIPPED_DIRS or name.endswith(".egg-info")):
        return True
    dotenv = (name == ".env" or name.startswith(".env.")) and not low.endswith((".sample", ".example"))
    return name == ".DS_Store" or name in fp.SECRET_NAMES or low.endswith(tuple(fp.SECRET_SUFFIXES)) or dotenv or ignore.match(path, folder)


def walk(root: str, ignore: Ignore | None = None) -> list[tuple[str, bool]]:
    """(path, is folder) below the root, entries by name; links are not followed, unreadable folders are empty."""
    ignore = ignore or ignore_of(root)
    out: list[tuple[str, bool]] = []

    def visit(folder: str) -> None:
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            is_dir = e.is_dir(follow_symlinks=False)
            if skipped(e.name, path, is_dir, ignore):
                continue
            out.append((path, is_dir))
            if is_dir:
                visit(path)

    visit("")
    return out


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, text, size_bytes, sha256 of the files that the rules leave.

    The executors read the bytes, so the root must be a path that they see too.
    Spark's own file sources pass over names that begin with a dot; this reads
    them. A file that cannot be read has a null text and hash.
    """
    listed = [(p,) for p, d in walk(root) if not d and not os.path.islink(os.path.join(root, p))]
    base = os.path.realpath(root)
    schema = pa.schema([("path", pa.string()), ("text", pa.string()), ("size_bytes", pa.int64()), ("sha256", pa.string())])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    raw = Path(base, path).read_bytes()
                    row = [raw.decode("utf-8", "replace"), len(raw), hashlib.sha256(raw).hexdigest()]
                except OSError:
                    row = [None, None, None]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([path, *row], schema)], schema=schema)

    paths = spark.createDataFrame(listed, "path string").repartition(max(1, len(listed) // 500 + 1))
    return paths.mapInArrow(run, "path string, text string, size_bytes long, sha256 string")


def inventory(found: DataFrame) -> DataFrame:
    """File rows: classification beside path, size and hash."""
    p = F.col("path")
    c = fp.classify(p)
    return found.select(file_id(p).alias("id"), "path", fp.base_name(p).alias("name"), *[c[x].alias(x) for x in ("extension", "language", "kind", "trust", "isBinary", "isGenerated")], "size_bytes", "sha256")


def source_files(found: DataFrame) -> DataFrame:
    """The files that imports can lead to and are worth reading, in order."""
    return found.filter(fp.is_linkable(F.col("path"))).orderBy("path")


def snapshot(found: DataFrame, project: str, vcs: dict) -> tuple[DataFrame, DataFrame]:
    """The project and the snapshot as nodes (id, label, name), and CAPTURES edges (src, dst) to all files, with the project's to the snapshot."""
    spark = found.sparkSession
    root, taken = f"project:{project}", f"snapshot:{project}:{vcs['revision']}"
    nodes = spark.createDataFrame([(root, "Project", project), (taken, "Snapshot", vcs["revision"])], "id string, label string, name string")
    edges = found.select(F.lit(taken).alias("src"), file_id(F.col("path")).alias("dst"))
    return nodes, spark.createDataFrame([(root, taken)], "src string, dst string").unionByName(edges)


def directories(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Directory rows (id, path, depth), and CONTAINS edges (id, src, dst)."""
    above = found.select(F.explode(fp.dir_prefixes(F.col("path"))).alias("d")).select(F.regexp_replace("d", "/$", "").alias("path")).distinct()
    dirs = above.select(directory_id(F.col("path")).alias("id"), "path", F.size(F.split("path", "/")).alias("depth")).unionByName(found.limit(1).select(F.lit("dir:.").alias("id"), F.lit(".").alias("path"), F.lit(0).alias("depth")))
    inner = above.select(directory_id(fp.dir_name(F.col("path"))).alias("src"), directory_id(F.col("path")).alias("dst"))
    leaf = found.select(directory_id(fp.dir_name(F.col("path"))).alias("src"), file_id(F.col("path")).alias("dst"))
    edges = inner.unionByName(leaf)
    return dirs, edges.select(edge_id(F.col("src"), F.lit("CONTAINS"), F.col("dst")).alias("id"), "src", "dst")


def git(root: str, *args: str) -> str | None:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    return done.stdout.rstrip("\n") if done.returncode == 0 else None


def revision(root: str) -> dict:
    """type, revision, branch, dirty; type none outside of a repository."""
    head = git(root, "rev-parse", "HEAD")
    if head is None:
        return {"type": "none", "revision": "no-revision", "branch": None, "dirty": False}
    return {"type": "git", "revision": head, "branch": git(root, "rev-parse", "--abbrev-ref", "HEAD"), "dirty": bool(git(root, "status", "--porcelain"))}


def changed_files(root: str, since: str) -> dict[str, list[str]]:
    """added, deleted, modified since a revision; renames delete and add, copies add, untracked files are added one by one."""
    out: dict[str, set[str]] = {"added": set(), "deleted": set(), "modified": set()}
    for line in (git(root, "diff", "--name-status", since) or "").splitlines():
        code, *names = line.split("\t")
        if code[0] == "R":
            out["deleted"].add(names[0])
            out["added"].add(names[1])
        elif code[0] == "C":
            out["added"].add(names[1])
        else:
            out[{"A": "added", "D": "deleted"}.get(code[0], "modified")].add(names[0])
    out["added"] |= set((git(root, "ls-files", "--others", "--exclude-standard") or "").splitlines())
    out["deleted"] -= out["added"]
    out["modified"] -= out["added"] | out["deleted"]
    return {k: sorted(v) for k, v in out.items()}


def relevant_changes(root: str, ignored: tuple[str, ...] = ()) -> bool:
    """Whether the working tree differs from its revision outside of paths (files or folders) that tools write."""
    for line in (git(root, "status", "--porcelain", "--untracked-files=all") or "").splitlines():
        path = line[3:].split(" -> ")[-1].strip('"')
        if not any(path == x or path.startswith(x.rstrip("/") + "/") for x in ignored):
            return True
    return False


def safe_path(root: str, path: str) -> str | None:
    """The real file of a path within the root; null outside of it, for links and for what is no regular file."""
    full = os.path.join(os.path.realpath(root), path)
    real = os.path.realpath(full)
    inside = os.path.commonpath([os.path.realpath(root), real]) == os.path.realpath(root)
    return full if inside and real == os.path.normpath(full) and os.path.isfile(full) else None
