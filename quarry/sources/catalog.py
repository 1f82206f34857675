"""Relational tables as a property graph.

Parts are files, brands domains, suppliers packages; what follows in an order
imports, references or uses what stands before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.model import DOMAIN, EDGE, FILE, PACKAGE, SYMBOL, Graph, domain_id, file_id, package_id, symbol_id
from quarry.plans.shared import scratch, written
from quarry.plans.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _typed(df: DataFrame, schema) -> DataFrame:
    """The schema's columns, null where `df` lacks them."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def successions(lineitem: DataFrame) -> DataFrame:
    """Order lines with the part and supplier of the next line; the long sort key makes it total."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return lineitem.select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", F.lead("l_partkey").over(w).alias("np"), F.lead("l_suppkey").over(w).alias("ns"))


_stored: dict[tuple[str, str], Graph] = {}


def catalog_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the tables, as they were when it was first asked for in this application.

    It is written once, the edges by type, and every query reads these tables:
    one that asks for a type of edges reads no others, and none goes back to the
    order lines.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored or not _there(_stored[key]):
        g = projected(spark, sf_dir)
        tables = {name: written(getattr(g, name), f"graph-{name}") for name in ("files", "symbols", "packages", "domains")}
        path = scratch(spark, "graph-edges")
        g.edges.write.partitionBy("type").parquet(path)
        edges = spark.read.schema(g.edges.schema).parquet(path).select(*g.edges.columns)
        _stored[key] = Graph(**tables, edges=edges)
    return _stored[key]


def _there(g: Graph) -> bool:
    """Whether the written tables are still in the shared folder."""
    context = g.files.sparkSession.sparkContext
    for df in (g.files, g.symbols, g.packages, g.domains, g.edges):
        for name in df.inputFiles()[:1]:
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            if not path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path):
                return False
    return True


def projected(spark: SparkSession, sf_dir: str) -> Graph:
    ship(spark)
    part, supplier, lineitem = (table(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    brand = F.lower(F.regexp_replace("p_brand", "#", "-"))
    paths = part.select("p_partkey", F.concat(F.lit("src/"), brand, F.lit("/"), F.lower("p_type"), F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"), "p_brand", "p_type", "p_size")
    files = paths.select(
        file_id(F.col("path")).alias("id"),
        "path",
        F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("name"),
        F.lit(".ts").alias("extension"),
        F.col("p_type").alias("language"),
        F.when(F.col("p_size") <= 5, "test").when(F.col("p_size") >= 46, "asset").otherwise("code").alias("kind"),
        (F.col("p_size") * 100).alias("size_bytes"),
        F.sha2("path", 256).alias("sha256"),
        (F.col("p_partkey") % 97 == 0).alias("entry_point"),
        F.when(F.col("p_partkey") % 41 == 0, F.col("p_partkey") % 3 + 1).alias("dynamic_imports"),
    )
    of_part = paths.select("p_partkey", "path")
    name_of = lambda k: F.concat(F.lit("s"), F.col(k).cast("string"))
    names = supplier.select("s_suppkey", package_id(F.col("s_name")).alias("pkg"))

    s = written(successions(lineitem), "successions")
    inner = s.filter("np is not null and l_quantity >= 49").select(F.col("l_partkey").alias("a"), F.col("np").alias("b")).distinct()
    outer = s.filter("l_returnflag = 'A' and l_quantity >= 49").select(F.col("l_partkey").alias("a"), "l_suppkey").distinct()
    declared = lineitem.select("l_partkey", "l_suppkey").distinct()
    refs = s.filter("np is not null and l_quantity >= 40").select(F.col("l_partkey").alias("a"), F.col("np").alias("b"), "ns").distinct()
    uses = s.filter("np is not null and l_quantity >= 45").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("k"), F.col("np").alias("b"), "ns").distinct()
    pa, pb = of_part.select(F.col("p_partkey").alias("a"), F.col("path").alias("pa")), of_part.select(F.col("p_partkey").alias("b"), F.col("path").alias("pb"))

    symbols = declared.join(of_part, declared["l_partkey"] == of_part["p_partkey"]).select(
        symbol_id(F.col("path"), name_of("l_suppkey")).alias("id"),
        "path",
        name_of("l_suppkey").alias("name"),
        F.element_at(F.array(*map(F.lit, ("function", "class", "variable"))), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("kind"),
        (F.col("l_suppkey") % 2 == 0).alias("exported"),
        F.col("l_suppkey").alias("line"),
    )
    symbols = written(symbols, "symbols")
    imports = inner.join(pa, "a").join(pb, "b").select(F.lit("IMPORTS").alias("type"), file_id(F.col("pa")).alias("src"), file_id(F.col("pb")).alias("dst"), F.lit("internal").alias("kind"), F.concat(F.lit("/"), "pb").alias("specifier"))
    external = outer.join(pa, "a").join(names, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.lit("IMPORTS").alias("type"), file_id(F.col("pa")).alias("src"), F.col("pkg").alias("dst"), F.lit("external").alias("kind"), F.regexp_replace("pkg", "^pkg:", "").alias("specifier")
    )
    declares = symbols.select(F.lit("DECLARES").alias("type"), file_id(F.col("path")).alias("src"), F.col("id").alias("dst"), "kind")
    references = refs.join(pa, "a").join(pb, "b").select(F.lit("REFERENCES").alias("type"), file_id(F.col("pa")).alias("src"), symbol_id(F.col("pb"), name_of("ns")).alias("dst"), (F.col("a") == F.col("b")).alias("same_file"))
    used = uses.join(pa, "a").join(pb, "b").select(F.lit("USES").alias("type"), symbol_id(F.col("pa"), name_of("k")).alias("src"), symbol_id(F.col("pb"), name_of("ns")).alias("dst"))
    belongs = paths.select(F.lit("BELONGS_TO").alias("type"), file_id(F.col("path")).alias("src"), domain_id(brand).alias("dst"))
    domain_of = paths.select(file_id(F.col("path")).alias("f"), domain_id(brand).alias("d"))
    depends = (
        imports.join(domain_of.withColumnsRenamed({"f": "src", "d": "da"}), "src")
        .join(domain_of.withColumnsRenamed({"f": "dst", "d": "db"}), "dst")
        .filter("da <> db")
        .groupBy("da", "db")
        .agg(F.count("*").alias("weight"))
        .select(F.lit("DEPENDS_ON").alias("type"), F.col("da").alias("src"), F.col("db").alias("dst"), "weight")
    )
    exposes = (
        files.filter("entry_point")
        .select(F.col("id").alias("src"))
        .join(imports.select("src", F.col("dst").alias("mid")), "src")
        .join(declares.select(F.col("src").alias("mid"), F.col("dst").alias("sym")), "mid")
        .join(symbols.filter("exported").select(F.col("id").alias("sym")), "sym")
        .select(F.lit("EXPOSES").alias("type"), "src", F.col("sym").alias("dst"), F.lit(1).alias("hops"))
    )
    edges = None
    for e in (imports, external, declares, references, used, belongs, depends, exposes):
        e = _typed(e, EDGE)
        edges = e if edges is None else edges.unionByName(e)
    packages = supplier.select(package_id(F.col("s_name")).alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("scope"))
    domains = part.select("p_brand").distinct().select(domain_id(brand).alias("id"), F.col("p_brand").alias("name"), F.when(F.col("p_brand").endswith("5"), "infra").otherwise("product").alias("kind"))
    return Graph(_typed(files, FILE), _typed(symbols, SYMBOL), _typed(packages, PACKAGE), _typed(domains, DOMAIN), edges)


#: The same graph in DuckDB, as leading tables of a `with` clause: file, symbol, package, domain, edge.
GRAPH_SQL = """
seq as (select l_partkey, l_suppkey, l_quantity, l_returnflag, lead(l_partkey) over w as np, lead(l_suppkey) over w as ns from lineitem
  window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)),
pt as (select p_partkey, lower(replace(p_brand, '#', '-')) as brand, p_brand, p_type, p_size, 'src/' || lower(replace(p_brand, '#', '-')) || '/' || lower(p_type) || '/p' || p_partkey || '.ts' as path from part),
file as (select 'file:' || path as id, path, 'p' || p_partkey || '.ts' as name, '.ts' as extension, p_type as language, case when p_size <= 5 then 'test' when p_size >= 46 then 'asset' else 'code' end as kind,
  cast(p_size * 100 as bigint) as size_bytes, sha256(path) as sha256, p_partkey % 97 = 0 as entry_point, case when p_partkey % 41 = 0 then p_partkey % 3 + 1 end as dynamic_imports from pt),
symbol as (select 'sym:' || path || '#s' || l_suppkey as id, path, 's' || l_suppkey as name, case l_suppkey % 3 when 0 then 'function' when 1 then 'class' else 'variable' end as kind, l_suppkey % 2 = 0 as exported, l_suppkey as line
  from (select distinct l_partkey, l_suppkey from lineitem) join pt on l_partkey = p_partkey),
package as (select 'pkg:' || s_name as id, s_name as name, cast(null as varchar) as scope from supplier),
domain as (select distinct 'domain:' || brand as id, p_brand as name, case when p_brand like '%5' then 'infra' else 'product' end as kind from pt),
internal as (select distinct 'file:' || a.path as src, 'file:' || b.path as dst, '/' || b.path as specifier from seq join pt a on l_partkey = a.p_partkey join pt b on np = b.p_partkey where l_quantity >= 49),
external as (select distinct 'file:' || path as src, 'pkg:' || s_name as dst, s_name as specifier from seq join pt on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey where l_returnflag = 'A' and l_quantity >= 49),
refs as (select distinct 'file:' || a.path as src, 'sym:' || b.path || '#s' || ns as dst, l_partkey = np as same_file from seq join pt a on l_partkey = a.p_partkey join pt b on np = b.p_partkey where l_quantity >= 40),
uses as (select distinct 'sym:' || a.path || '#s' || l_suppkey as src, 'sym:' || b.path || '#s' || ns as dst from seq join pt a on l_partkey = a.p_partkey join pt b on np = b.p_partkey where l_quantity >= 45),
belongs as (select 'file:' || path as src, 'domain:' || brand as dst from pt),
depends as (select x.dst as src, y.dst as dst, count(*) as weight from internal i join belongs x on i.src = x.src join belongs y on i.dst = y.src where x.dst <> y.dst group by all),
exposes as (select i.src, s.id as dst from internal i join file f on i.src = f.id and f.entry_point join symbol s on i.dst = 'file:' || s.path and s.exported),
edge as (select 'IMPORTS' as type, src, dst, 'internal' as kind, specifier, cast(null as boolean) as same_file, cast(null as bigint) as hops, cast(null as bigint) as weight from internal
  union all select 'IMPORTS', src, dst, 'external', specifier, null, null, null from external
  union all select 'DECLARES', 'file:' || path, id, kind, null, null, null, null from symbol
  union all select 'REFERENCES', src, dst, null, null, same_file, null, null from refs
  union all select 'USES', src, dst, null, null, null, null, null from uses
  union all select 'BELONGS_TO', src, dst, null, null, null, null, null from belongs
  union all select 'DEPENDS_ON', src, dst, null, null, null, null, weight from depends
  union all select 'EXPOSES', src, dst, null, null, null, 1, null from exposes),
node as (select id, 'File' as label, path, name from file union all select id, 'Symbol', path, name from symbol union all select id, 'Package', null, name from package union all select id, 'Domain', null, name from domain)
"""
