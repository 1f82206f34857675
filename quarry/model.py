"""Row types of the property graph, and how ids are made.

Typed tables per label plus one table of edges; the generic node view with a JSON
of properties is derived. An edge is unique per (type, src, dst).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType


def _fields(**types) -> StructType:
    return StructType([StructField(n, t()) for n, t in types.items()])


FILE = _fields(id=StringType, path=StringType, name=StringType, extension=StringType, language=StringType, kind=StringType, size_bytes=LongType, sha256=StringType, entry_point=BooleanType, dynamic_imports=LongType)
SYMBOL = _fields(id=StringType, path=StringType, name=StringType, kind=StringType, exported=BooleanType, line=LongType)
PACKAGE = _fields(id=StringType, name=StringType, scope=StringType)
DOMAIN = _fields(id=StringType, name=StringType, kind=StringType)
EDGE = _fields(type=StringType, src=StringType, dst=StringType, kind=StringType, specifier=StringType, same_file=BooleanType, hops=LongType, weight=LongType)

#: Merge order of layers; a later one's properties override.
LAYERS = ("inventory", "imports", "symbols", "references", "usages", "domains")
SEMANTIC = ("IMPORTS", "DECLARES", "REFERENCES", "USES", "BELONGS_TO", "DEPENDS_ON")


def file_id(path: Column | str) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_id(path, name) -> Column:
    return F.concat(F.lit("sym:"), path, F.lit("#"), name)


def package_id(name) -> Column:
    return F.concat(F.lit("pkg:"), name)


def domain_id(name) -> Column:
    return F.concat(F.lit("domain:"), name)


def directory_id(path) -> Column:
    return F.concat(F.lit("dir:"), path)


def edge_id(src, kind, dst) -> Column:
    return F.concat(F.lit("edge:"), src, F.lit(":"), kind, F.lit(":"), dst)


def kind_of_id(node: Column) -> Column:
    """Label by an id's prefix; null for others."""
    prefixes = {"file": "File", "dir": "Directory", "pkg": "Package", "sym": "Symbol", "domain": "Domain", "project": "Project", "snapshot": "Snapshot"}
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for p, label in prefixes.items():
        out = out.when(node.startswith(f"{p}:"), F.lit(label))
    return out


def tail(node: Column) -> Column:
    """An id without its prefix."""
    return F.regexp_replace(node, "^[a-z]+:", "")


@dataclass(frozen=True)
class Graph:
    files: DataFrame
    symbols: DataFrame
    packages: DataFrame
    domains: DataFrame
    edges: DataFrame
    #: which layers were found
    layers: frozenset[str] = frozenset(LAYERS)

    def of(self, *types: str) -> DataFrame:
        return self.edges.filter(F.col("type").isin(*types))

    def nodes(self) -> DataFrame:
        """id, label, path, name: what lookups need of every node."""
        none = F.lit(None).cast("string")
        parts = [
            self.files.select("id", F.lit("File").alias("label"), "path", "name"),
            self.symbols.select("id", F.lit("Symbol").alias("label"), "path", "name"),
            self.packages.select("id", F.lit("Package").alias("label"), none.alias("path"), "name"),
            self.domains.select("id", F.lit("Domain").alias("label"), none.alias("path"), "name"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def cached_edges(self) -> Graph:
        return replace(self, edges=self.edges.persist())
