"""Queries over the driver's tables: each graph operator on the catalog graph, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import layers
from .functions import paths as fp
from .model import Graph, edge_id, file_id, kind_of_id, tail
from .operators import aggregates as ag
from .operators import cycles as cy
from .operators import incremental as inc
from .operators import lookup as lo
from .operators import resolve as rs
from .operators import rules as ru
from .operators import traverse as tr
from .operators import windows as wi
from .sources.catalog import GRAPH_SQL, catalog_graph, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def graph_query(name: str, sql: str | None = None, recursive: bool = False):
    """Register a function of a graph; the SQL sees the graph's tables."""

    def add(f: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(catalog_graph(spark, sf_dir))
        if sql:
            SQL[name] = f"with {'recursive ' if recursive else ''}{GRAPH_SQL.strip()} {sql.strip()}"
        return f

    return add


def table_query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql.strip()
        return f

    return add


HUB = "(select dst from internal group by dst order by count(*) desc, dst limit 1)"


def hub(g: Graph) -> str:
    """The file that most files import."""
    n = g.of("IMPORTS").filter(F.col("kind") == "internal").groupBy("dst").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "dst").first()["dst"]


def top_domain(g: Graph) -> str:
    return g.of("BELONGS_TO").agg(F.min("dst")).first()[0]


TOP = "(select min(dst) from belongs)"
NOT_SAME = "not coalesce(same_file, false)"
DEAD = f"""
, crossed as (select distinct dst as id from refs where not same_file),
held as (select 'sym:' || s.path || '#' || s.name as id from symbol s join file f on f.path = s.path and f.entry_point union select dst from exposes),
dead as (select id, path, id in (select id from held) as held_back from symbol where exported and id not in (select id from crossed))
"""

# lookups and joins ---------------------------------------------------------


@graph_query("P1_find_node", "select id, label, path, name, (select count(*) from node where lower(id) like '%/p12%') as total, (select count(*) from node where lower(id) like '%/p12%') > 50 as truncated from (select * from node where lower(id) like '%/p12%' order by id limit 50)")
def _(g):
    return lo.find_node(g, "/P12", 50)


@graph_query("P2_node_info", f"""select dir, type, count(*) as n, string_agg(other, ',' order by other) as others from (select 'out' as dir, type, dst as other from edge where src = {HUB} union all select 'in', type, src from edge where dst = {HUB}) group by all""")
def _(g):
    return lo.node_info(g, hub(g))


@graph_query("P3_resolve_node_id", """select name, (select min(id) from node where id = x.name or id = 'file:' || x.name or id = 'domain:' || x.name) as id from (select path as name from file union all select substr(dst, 8) from (select distinct dst from belongs) union all select 'no-such' ) x""")
def _(g):
    names = g.files.select(F.col("path").alias("name")).unionByName(g.of("BELONGS_TO").select(tail(F.col("dst")).alias("name")).distinct())
    return lo.resolve_node_id(g, names.unionByName(g.files.limit(1).select(F.lit("no-such").alias("name"))))


@graph_query("P17_list_symbols", f"select id, name, kind, exported, line from symbol where 'file:' || path = {HUB}")
def _(g):
    return lo.list_symbols(g, hub(g))


@graph_query("P18_symbols_of_file", f"select id, name, kind, exported, line from symbol where 'file:' || path = {HUB}")
def _(g):
    return lo.symbols_of_file(g, hub(g))


@graph_query("P19_orphan_files", "select id, path from file where kind <> 'test' and id not in (select dst from internal)")
def _(g):
    return lo.orphan_files(g)


@graph_query("P20_brief_nodes", "select id, label, coalesce(path, name, id) as title from node")
def _(g):
    return lo.brief_nodes(g)


@graph_query("P21_dynamic_imports", "select cast(coalesce(sum(dynamic_imports), 0) as bigint) as imports, count(*) filter (dynamic_imports > 0) as files from file")
def _(g):
    return lo.dynamic_import_totals(g)


@graph_query("P22_file_targets", """, t as (select name as target from file union select path from file where kind = 'test' union select 'nowhere.ts' union select '1.ts'),
m as (select target, count(*) as n, max(cast(path = target as int)) as exact from t join file on path = target or ends_with(path, '/' || target) group by target)
select t.target, case when n is null then 'not-found' when exact = 0 and n > 1 then 'ambiguous' else 'found' end as status, case when exact = 1 then 1 else coalesce(n, 0) end as n from t left join m using (target)""")
def _(g):
    extra = g.files.limit(1).select(F.explode(F.array(F.lit("nowhere.ts"), F.lit("1.ts"))).alias("target"))
    t = g.files.select(F.col("name").alias("target")).unionByName(g.files.filter("kind = 'test'").select(F.col("path").alias("target"))).unionByName(extra).distinct()
    return lo.file_targets(g.files.select("path"), t)


@graph_query("J1_neighbors", f", seed as (select src as id from internal where dst = {HUB}) select id as seed, type, 'out' as dir, dst as other from edge join seed on src = id union all select id, type, 'in', src from edge join seed on dst = id")
def _(g):
    return lo.neighbors(g, g.of("IMPORTS").filter(F.col("dst") == hub(g)).select(F.col("src").alias("id")).distinct())


@graph_query("J2_imports_of", f"select dst, kind, specifier from edge where type = 'IMPORTS' and src = {HUB}")
def _(g):
    return lo.imports_of(g, hub(g))


@graph_query("J3_imported_by", f"select distinct src from internal where dst = {HUB}")
def _(g):
    return lo.direct_importers(g, hub(g))


@graph_query("J4_imports_split", """select src, coalesce(string_agg(substr(dst, 6), ',' order by dst) filter (dst like 'file:%'), '') as internal, coalesce(string_agg(substr(dst, 5), ',' order by dst) filter (dst like 'pkg:%'), '') as external from edge where type = 'IMPORTS' group by src""")
def _(g):
    return lo.imports_split(g)


@graph_query("J5_domain_of_file", "select f.id, d.name as domain from file f left join belongs b on b.src = f.id left join domain d on d.id = b.dst")
def _(g):
    return lo.domain_of_file(g)


@graph_query("J6_referencing_files", "select dst as id, count(distinct src) as n, string_agg(distinct src, ',' order by src) as files from refs where not same_file group by dst")
def _(g):
    return lo.referencing_files(g)


@graph_query("J7_dead_exports", DEAD + "select id, path, held_back from dead where not held_back")
def _(g):
    return lo.dead_exports(g)


@graph_query("J7_dead_exports_all", DEAD + "select id, path, held_back from dead")
def _(g):
    return lo.dead_exports(g, include_entry_points=True)


ALIASES = [("@src/*", 0, ["src/*", "lib/*"]), ("@brand/*.ts", 1, ["src/*.ts"]), ("@src/brand-11/*", 2, ["src/brand-11/*"]), ("exact", 3, ["src/exact.ts"])]


def _patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "pattern string, ord int, targets array<string>")


@graph_query("J8_alias_substitutions", """, spec as (select '@src/' || substr(path, 5) as s from file union all select '@brand/' || substr(path, 5) from file where kind = 'test' union all select 'exact'),
pat as (select * from (values ('@src/*', 0, ['src/*', 'lib/*']), ('@brand/*.ts', 1, ['src/*.ts']), ('@src/brand-11/*', 2, ['src/brand-11/*']), ('exact', 3, ['src/exact.ts'])) t(pattern, ord, targets)),
cut as (select *, split_part(pattern, '*', 1) as head, contains(pattern, '*') as wild, case when contains(pattern, '*') then split_part(pattern, '*', 2) else '' end as rest from pat),
hit as (select *, row_number() over (partition by s order by case when wild then length(head) else length(pattern) + 1 end desc, ord) as k from spec join cut on case when wild then starts_with(s, head) and ends_with(s, rest) and length(s) >= length(head) + length(rest) else s = pattern end)
select s as specifier, replace(t, '*', substr(s, length(head) + 1, length(s) - length(head) - length(rest))) as base, cast(i - 1 as int) as ord from (select *, unnest(targets) as t, generate_subscripts(targets, 1) as i from hit where k = 1)""")
def _(g):
    s = g.files.select(F.concat(F.lit("@src/"), F.expr("substring(path, 5)")).alias("specifier"))
    s = s.unionByName(g.files.filter("kind = 'test'").select(F.concat(F.lit("@brand/"), F.expr("substring(path, 5)")).alias("specifier"))).unionByName(g.files.limit(1).select(F.lit("exact").alias("specifier")))
    return rs.alias_substitutions(s, _patterns(g.edges.sparkSession))


@graph_query("J9_segment_after_root", "select path, case when path like 'src/brand-11/%' then split_part(substr(path, 14), '/', 1) else split_part(substr(path, 5), '/', 1) end as segment from file")
def _(g):
    roots = g.edges.sparkSession.createDataFrame([("src",), ("src/brand-11",)], "root string")
    return rs.segment_after_root(g.files, roots)


@graph_query("J10_assign_domain", """select path, case when split_part(path, '/', 2) = 'brand-11' then 'eleven' when split_part(path, '/', 2) in ('brand-12', 'brand-13') then split_part(path, '/', 2) when path like 'src/brand-14/%' then 'fourteen' else 'unassigned' end as domain from file""")
def _(g):
    spark = g.edges.sparkSession
    roots, aliases = spark.createDataFrame([("src",)], "root string"), spark.createDataFrame([("brand-11", "eleven")], "alias string, domain string")
    buckets, known = spark.createDataFrame([("src/brand-14", "fourteen", 0), ("src/brand-14", "later", 1)], "prefix string, domain string, ord int"), spark.createDataFrame([("brand-12",), ("brand-13",)], "domain string")
    return rs.assign_domains(g.files, roots, aliases, buckets, known)


@graph_query("J11_match_source", ", base as (select regexp_replace(path, '\\.ts$', '') as base, path from file where kind = 'code' union all select regexp_replace(path, '\\.ts$', '.js'), path from file where kind = 'test') select base, path from base")
def _(g):
    a = g.files.filter("kind = 'code'").select(F.regexp_replace("path", r"\.ts$", "").alias("base"))
    b = g.files.filter("kind = 'test'").select(F.regexp_replace("path", r"\.ts$", ".js").alias("base"))
    return rs.match_source(a.unionByName(b), g.files)


@graph_query("J13_resolve_specifiers", """, spec as (select path as file, './' || name as specifier, path as target, 'internal' as kind from file union all select path, '../missing/' || name, null, 'unresolved' from file where kind = 'test'
 union all select path, '@src/' || substr(path, 5), path, 'internal' from file where kind = 'code' and path not like 'src/brand-11/%' union all select path, '@src/nothing', null, 'unresolved' from file where kind = 'asset'
 union all select path, '/' || path, null, 'unresolved' from file where kind = 'asset' union all select path, '@acme/ui/button', 'pkg:@acme/ui', 'external' from file where kind = 'test' union all select path, 'work', null, 'unresolved' from file where kind = 'test')
select file, specifier, kind, target from spec""")
def _(g):
    spark, f = g.edges.sparkSession, g.files
    rows = lambda cond, spec: f.filter(cond).select(F.col("path").alias("file"), spec.alias("specifier"))
    specs = rows("true", F.concat(F.lit("./"), "name")).unionByName(rows("kind = 'test'", F.concat(F.lit("../missing/"), "name"))).unionByName(rows("kind = 'code' and path not like 'src/brand-11/%'", F.concat(F.lit("@src/"), F.expr("substring(path, 5)"))))
    specs = specs.unionByName(rows("kind = 'asset'", F.lit("@src/nothing"))).unionByName(rows("kind = 'asset'", F.concat(F.lit("/"), "path"))).unionByName(rows("kind = 'test'", F.lit("@acme/ui/button"))).unionByName(rows("kind = 'test'", F.lit("work")))
    ws = spark.createDataFrame([("work", "packages/work")], "name string, dir string")
    return rs.resolve_specifiers(specs, f, _patterns(spark), ws, spark.createDataFrame([("packages/work",)], "root string"))


@graph_query("J14_path_matches", """, t as (select name as target from file union select path from file), m as (select target, path, case when path = target then 0 else 1 end as tier from t join file on path = target or ends_with(path, '/' || target))
select target, path, tier from (select *, min(tier) over (partition by target) as b from m) where tier = b""")
def _(g):
    t = g.files.select(F.col("name").alias("target")).unionByName(g.files.select(F.col("path").alias("target"))).distinct()
    return lo.path_matches(g.files.select("path"), t)


@graph_query("J15_resolve_targets", """, t as (select id as target from file where kind = 'test' union select path from file where kind = 'test' union select name from file where kind = 'test' union select name from domain union select 's1' union select 'nothing'),
m as (select target, 0 as tier, id from t join node on id = target union select target, 1, id from t join file on path = target union select target, 2, id from t join domain on name = target or id = 'domain:' || target
 union select target, 3, id from t join file on ends_with(path, '/' || target) union select target, 4, id from t join symbol on name = target),
b as (select target, tier, id from (select *, min(tier) over (partition by target) as first from m) where tier = first)
select t.target, tier, id from t left join b using (target)""")
def _(g):
    f = g.files.filter("kind = 'test'")
    t = f.select(F.col("id").alias("target"))
    for x in (f.select("path"), f.select("name"), g.domains.select("name"), f.limit(1).select(F.lit("s1")), f.limit(1).select(F.lit("nothing"))):
        t = t.union(x)
    return lo.resolve_targets(g, t)


RULES = [("domain:brand-11", "*"), ("*", "domain:brand-12"), ("domain:brand-21", "domain:brand-31")]


@graph_query("J16_forbidden_dependencies", """select i.src, i.dst, x.dst as a, y.dst as b from internal i join belongs x on i.src = x.src join belongs y on i.dst = y.src where x.dst <> y.dst and (x.dst = 'domain:brand-11' or y.dst = 'domain:brand-12' or x.dst = 'domain:brand-21' and y.dst = 'domain:brand-31')""")
def _(g):
    return ru.forbidden_dependencies(g, g.edges.sparkSession.createDataFrame(RULES, "from string, to string"))


@graph_query("J17_G5_domain_weights", "select src as a, dst as b, weight from depends")
def _(g):
    return ag.domain_weights(g)


@graph_query("J18_paths_declaring", "select distinct name, path from symbol where name in ('s1', 's7')")
def _(g):
    return lo.paths_declaring(g, g.edges.sparkSession.createDataFrame([("s1",), ("s7",)], "name string"))


@graph_query("J19_fresh_rows", "select id, kind <> 'test' as fresh from file where kind <> 'asset' union all select id, false from file where kind = 'asset'")
def _(g):
    cached = g.files.filter("kind <> 'asset'").select("id", F.when(F.col("kind") == "test", "old").otherwise(F.col("sha256")).alias("content_hash"))
    return inc.fresh_rows(cached, g.files.select("id", F.col("sha256").alias("content_hash")))


@graph_query("J20_entry_points", """select path, case when regexp_matches(path, '^src/brand-1[^/]*/[^/]*/p1[^/]*\\.ts$') then 'config:src/brand-1*/*/p1*.ts' when regexp_matches(path, '^src/(.*/)?p2[^/]\\.ts$') then 'config:src/**/p2?.ts' else 'main' end as reason from file
where regexp_matches(path, '^src/brand-1[^/]*/[^/]*/p1[^/]*\\.ts$') or regexp_matches(path, '^src/(.*/)?p2[^/]\\.ts$') or entry_point""")
def _(g):
    targets = g.files.filter("entry_point").select(F.regexp_replace("path", r"\.ts$", "").alias("base"), F.lit("main").alias("reason"))
    return rs.entry_points(g.files, ["src/brand-1*/*/p1*.ts", "src/**/p2?.ts"], targets)


@graph_query("J21_describe", """, t as (select path as target from file where kind = 'test' union all select path from file where kind = 'asset' union all select 's1' union all select 'nothing')
select target, case when target = 'nothing' then 'not-found' when target = 's1' then case (select count(*) from symbol where name = 's1') when 0 then 'not-found' when 1 then 'none' else 'ambiguous' end when f.kind = 'test' then 'described' else 'none' end as status, case when f.kind = 'test' then 'about ' || f.name end as text from t left join file f on f.path = t.target""")
def _(g):
    d = g.files.filter("kind = 'test'").select(F.col("id").alias("target_id"), F.concat(F.lit("about "), "name").alias("text"))
    f = g.files.filter("kind in ('test', 'asset')").select(F.col("path").alias("target"))
    return lo.describe_targets(g, f.union(g.files.limit(1).select(F.explode(F.array(F.lit("s1"), F.lit("nothing"))))), d)


# aggregates -----------------------------------------------------------------


@graph_query("G1_merge_nodes", """, r as (select id, 0 as layer, 'size' as key, cast(size_bytes as varchar) as value from file union all select id, 0, 'kind', kind from file union all select id, 1, 'kind', null from file where kind = 'test' union all select id, 2, 'kind', 'late' from file where kind = 'asset'),
best as (select id, key, value from (select *, row_number() over (partition by id, key order by layer desc) as k from r) where k = 1)
select b.id, case when f.kind = 'asset' then 'Asset,File' else 'File' end as labels, key, value from best b join file f using (id)""")
def _(g):
    m = lambda *kv: F.create_map(*kv)
    f = g.files
    a = f.select("id", F.lit(0).alias("layer"), F.array(F.lit("File")).alias("labels"), m(F.lit("size"), F.col("size_bytes").cast("string"), F.lit("kind"), F.col("kind")).alias("properties"))
    b = f.filter("kind = 'test'").select("id", F.lit(1).alias("layer"), F.array(F.lit("File")).alias("labels"), m(F.lit("kind"), F.lit(None).cast("string")).alias("properties"))
    c = f.filter("kind = 'asset'").select("id", F.lit(2).alias("layer"), F.array(F.lit("Asset")).alias("labels"), m(F.lit("kind"), F.lit("late")).alias("properties"))
    return ag.merge_nodes(a.unionByName(b).unionByName(c))


@table_query("G2_first_edges", """select 'T' as type, l_partkey as src, l_suppkey as dst, l_quantity as quantity from (select *, row_number() over (partition by l_partkey, l_suppkey order by l_linenumber, l_orderkey, l_quantity) as k from lineitem) where k = 1""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.lit("T").alias("type"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_linenumber").alias("layer"), F.struct("l_orderkey", "l_quantity").alias("ord"), F.col("l_quantity").alias("quantity"))
    return ag.first_edges(rows)


RESOLVED = "(select src as file, specifier, kind from edge where type = 'IMPORTS' union all select id, 'missing', 'unresolved' from file where kind = 'test')"


def _resolved(g: Graph) -> DataFrame:
    return g.of("IMPORTS").select(F.col("src").alias("file"), "specifier", "kind").unionByName(g.files.filter("kind = 'test'").select(F.col("id").alias("file"), F.lit("missing").alias("specifier"), F.lit("unresolved").alias("kind")))


@graph_query("G3_import_counts", f"select kind, count(*) as n from (select distinct * from {RESOLVED}) group by kind")
def _(g):
    return ag.import_counts(_resolved(g))


@graph_query("G4_G25_resolution_rate", f"select round(count(*) filter (kind = 'internal') / count(*) filter (kind <> 'external'), 6) as rate from (select distinct * from {RESOLVED})")
def _(g):
    return ag.resolution_rate(_resolved(g))


@graph_query("G6_domain_crossings", "select src as a, dst as b, weight, cast((select sum(weight) from depends) as bigint) as total from depends")
def _(g):
    return ag.domain_crossings(g)


@graph_query("G7_domain_dependencies", f"select 'out' as dir, dst as other, weight from depends where src = {TOP} union all select 'in', src, weight from depends where dst = {TOP}")
def _(g):
    return ag.domain_dependencies(g, top_domain(g))


@graph_query("G8_package_ranking", "select dst as id, count(distinct src) as files from external group by dst")
def _(g):
    return ag.package_ranking(g)


@graph_query("G9_packages_for_files", f"select substr(e.dst, 5) as package, count(distinct e.src) as files from external e join belongs b on b.src = e.src and b.dst = {TOP} group by 1")
def _(g):
    return ag.packages_for_files(g, lo.files_of_domain(g, top_domain(g)))


@graph_query("G10_cross_file_refs", "select dst as id, count(distinct src) as refs from refs where not same_file group by dst")
def _(g):
    return lo.cross_refs(g).groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("refs"))


@graph_query("G11_domain_facts", """select id, name, kind, (select count(*) from belongs where dst = d.id) as files, (select count(*) from depends where src = d.id) as deps, (select count(*) from depends where dst = d.id) as dependents from domain d""")
def _(g):
    return ag.domain_facts(g)


@graph_query("G12_dead_export_counts", DEAD + "select (select count(*) from symbol where exported) as exported, count(*) filter (not held_back) as dead, count(*) filter (held_back) as held_back, (select count(*) from file where entry_point) as entry_points, true as precise from dead")
def _(g):
    return ag.dead_export_counts(g)


@graph_query("G13_language_histogram", "select language, count(*) as n from file group by all")
def _(g):
    return ag.language_histogram(g)


@graph_query("G13_top_dirs", "select 'src/' || split_part(path, '/', 2) as dir, count(*) as n from file group by all")
def _(g):
    return ag.top_dirs(g)


@graph_query("G14_biggest_importers", "select src as id, count(*) as n, count(*) filter (kind = 'internal') as internal, count(*) filter (kind = 'external') as external from edge where type = 'IMPORTS' group by src")
def _(g):
    return ag.biggest_importers(g)


@graph_query("G15_domain_top_files", f"select b.src as id, count(distinct i.src) as importers from belongs b join internal i on i.dst = b.src where b.dst = {TOP} group by b.src order by importers desc, id limit 10")
def _(g):
    return ag.domain_top_files(g, top_domain(g))


@graph_query("G16_reference_counts", "select count(distinct src) as files, count(distinct dst) as symbols, (select count(*) from symbol where exported and id not in (select dst from refs where not same_file)) as dead from refs")
def _(g):
    return ag.reference_counts(g)


@graph_query("G17_inventory_counts", "select count(*) as files, cast(sum(size_bytes) as bigint) as bytes, 2 + count(distinct split_part(path, '/', 2)) + count(distinct split_part(path, '/', 2) || '/' || split_part(path, '/', 3)) as directories from file")
def _(g):
    return ag.inventory_counts(g)


@graph_query("G18_product_map", "select src, dst, weight from depends where src in (select id from domain where kind = 'product') and dst in (select id from domain where kind = 'product')")
def _(g):
    return ag.product_map(g)


@graph_query("G18_most_used_symbols", "select dst as id, count(distinct src) as files from refs group by dst order by files desc, id limit 20")
def _(g):
    return ag.most_used_symbols(g)


@graph_query("G18_most_connected_symbols", "select id, count(*) as degree from (select src as id from uses union all select dst from uses) group by id order by degree desc, id limit 20")
def _(g):
    return ag.most_connected_symbols(g)


NAMED = "(select id, path, case line % 4 when 0 then 'use' || upper(substr(name, 1, 1)) || substr(name, 2) when 1 then 'View' || name when 2 then 'USER' || name else 'user' || name end as name, exported from symbol)"


@graph_query("G18_hooks_components", f"select case when regexp_matches(name, '^use[A-Z]') then 'hook' else 'component' end as what, id, name from {NAMED} where exported and (regexp_matches(name, '^use[A-Z]') or regexp_matches(name, '^[A-Z][a-z]'))")
def _(g):
    k = F.col("line") % 4
    name = F.when(k == 0, F.concat(F.lit("use"), F.initcap("name"))).when(k == 1, F.concat(F.lit("View"), "name")).when(k == 2, F.concat(F.lit("USER"), "name")).otherwise(F.concat(F.lit("user"), "name"))
    return ag.hooks_and_components(replace(g, symbols=g.symbols.withColumn("name", name)))


@graph_query("G18_biggest_domains", "select dst as id, count(*) as files from belongs group by dst order by files desc, id limit 10")
def _(g):
    return ag.biggest_domains(g)


@graph_query("G18_depended_packages", "select dst as id, count(distinct src) as files from external group by dst order by files desc, id limit 20")
def _(g):
    return ag.most_depended_packages(g)


@graph_query("G19_label_counts", "select label, count(*) as n from node group by label union all select 'edges', count(*) from edge where type <> 'EXPOSES'")
def _(g):
    return ag.label_counts(g)


@graph_query("G20_evaluate_check", DEAD + """, forb as (select count(*) as total from internal i join belongs x on i.src = x.src join belongs y on i.dst = y.src where x.dst <> y.dst and (x.dst = 'domain:brand-11' or y.dst = 'domain:brand-12' or x.dst = 'domain:brand-21' and y.dst = 'domain:brand-31'))
select 'forbidden' as rule, total = 0 as ok, total from forb union all select 'dead_exports', count(*) <= 100000, count(*) from dead where not held_back union all select 'domain_pairs', count(*) <= 300, count(*) from depends""")
def _(g):
    return ru.evaluate(g, forbidden=g.edges.sparkSession.createDataFrame(RULES, "from string, to string"), max_dead_exports=100_000, max_domain_pairs=300)


@graph_query("G20_offenders", DEAD + """, o as (select 'forbidden' as rule, i.src || ' -> ' || i.dst as offender from internal i join belongs x on i.src = x.src join belongs y on i.dst = y.src where x.dst <> y.dst and (x.dst = 'domain:brand-11' or y.dst = 'domain:brand-12' or x.dst = 'domain:brand-21' and y.dst = 'domain:brand-31')
union all select 'dead_exports', id from dead where not held_back union all select 'domain_pairs', src || ' -> ' || dst from depends)
select rule, offender, cast(position as int) as position, total from (select *, row_number() over (partition by rule order by offender) as position, count(*) over (partition by rule) as total from o) where position <= 20""")
def _(g):
    return ru.offenders(g, forbidden=g.edges.sparkSession.createDataFrame(RULES, "from string, to string"), dead=True, pairs=True)


@table_query("G22_F11_estimate", "select count(*) as items, cast(sum(ceil(length(text) / 4.0)) as bigint) as input_tokens, count(*) * 200 as output_tokens from conversations")
def _(spark, d):
    return ag.text_estimate(table(spark, d, "conversations"))


@graph_query("G23_W5_ranked_targets", """, r as (select 'domain' as kind, dst as id, cast(sum(weight) as bigint) as score from depends group by dst union all select 'file', dst, count(distinct src) from internal group by dst union all select 'symbol', dst, count(distinct src) from refs where not same_file group by dst)
select kind, id, score, cast(position as int) as position from (select *, row_number() over (partition by kind order by score desc, id) as position from r) where position <= 5""")
def _(g):
    return ag.ranked_targets(g)


@graph_query("G23_file_facts", """, i as (select distinct src, dst from internal), x as (select distinct src, dst from external), top as (select dst as id, list(substr(src, 6) order by src)[1:8] as importers, count(*) as rank from i group by dst),
inn as (select src as id, list(substr(dst, 6) order by dst)[1:8] as internal from i group by src), ext as (select src as id, list(substr(dst, 5) order by dst)[1:8] as external from x group by src),
ex as (select 'file:' || path as id, list(name || ':' || refs order by refs desc, name)[1:8] as exports from (select path, name, coalesce(n, 0) as refs from symbol left join (select dst as id, count(distinct src) as n from refs where not same_file group by dst) using (id) where exported) group by path)
select f.id, coalesce(rank, 0) as rank, f.kind as file_kind, d.name as domain, coalesce(array_to_string(importers, ','), '') as importers, coalesce(array_to_string(internal, ','), '') as internal, coalesce(array_to_string(external, ','), '') as external, coalesce(array_to_string(exports, ','), '') as exports
from file f left join belongs b on b.src = f.id left join domain d on d.id = b.dst left join top on top.id = f.id left join inn on inn.id = f.id left join ext on ext.id = f.id left join ex on ex.id = f.id""")
def _(g):
    from . import describe

    f = F.col("facts")
    exports = F.transform(f["exports"], lambda e: F.concat(e["name"], F.lit(":"), e["refs"].cast("string")))
    return describe.file_facts(g).select("id", "rank", f["fileKind"].alias("file_kind"), f["domain"].alias("domain"), F.array_join(f["importedBy"]["files"], ",").alias("importers"), F.array_join(f["imports"]["internal"], ",").alias("internal"), F.array_join(f["imports"]["external"], ",").alias("external"), F.array_join(exports, ",").alias("exports"))


@graph_query("G24_overlay_diagnostics", "select (select count(*) from file where path like 'lib/%') = 0 as no_root, (select count(*) from internal) > 0 and (select count(*) from depends) = 0 as no_dependency")
def _(g):
    return ag.overlay_diagnostics(g, ["lib"])


@graph_query("H2_files_of_domain", f"select src as id from belongs where dst = {TOP}")
def _(g):
    return lo.files_of_domain(g, top_domain(g))


@graph_query("H3_exported_symbols", "select id, path, coalesce(n, 0) as refs from symbol left join (select dst as id, count(distinct src) as n from refs where not same_file group by dst) using (id) where exported")
def _(g):
    return lo.exported_symbols(g)


@graph_query("H5_minimal_symbols", "select distinct dst as id, regexp_extract(dst, '#([^#]*)$', 1) as name, regexp_extract(dst, '^sym:(.*)#[^#]*$', 1) as path from refs")
def _(g):
    return lo.minimal_symbols(g.of("REFERENCES"), g.symbols.filter("exported"))


@graph_query("H6_reference_records", "select substr(src, 6) as from_path, dst as sym_id, same_file from refs")
def _(g):
    return lo.reference_records(g)


@graph_query("H19_health", DEAD + """, both_ as (select 'dead' as what, id from dead where not held_back union all select 'orphan', id from file where kind <> 'test' and id not in (select dst from internal))
select what, id, cast(position as int) as position, total from (select *, row_number() over (partition by what order by id) as position, count(*) over (partition by what) as total from both_) where position <= 20""")
def _(g):
    return ag.health(g)


# windows, limits, sets ------------------------------------------------------


@table_query("W1_ordinal_ids", """select 'sym:' || l_orderkey || '#' || l_returnflag || case when k > 1 then '~' || k else '' end as id, o from (select l_orderkey, l_returnflag, o, row_number() over (partition by l_orderkey, l_returnflag order by o) as k from
(select l_orderkey, l_returnflag, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as o from lineitem))""")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_returnflag").alias("name"), F.row_number().over(w).cast("long").alias("ord"))
    return wi.ordinal_ids(rows).select("id", F.col("ord").alias("o"))


@graph_query("W2_first_specifiers", "select src, dst, min(specifier) as specifier from edge where type = 'IMPORTS' group by all")
def _(g):
    return wi.first_specifiers(g.of("IMPORTS"))


@graph_query("W3_derived_kinds", "select split_part(path, '/', 2) as domain, arg_max(kind, path) as kind from file group by 1")
def _(g):
    return wi.derived_kinds(g.files.select(F.element_at(F.split("path", "/"), 2).alias("domain"), "path", "kind"))


@table_query("W4_merge_adjacent", """with h as (select user_id as name, event_id as b, event_id + cast(floor(value) as bigint) % 50 as e from events),
m as (select *, case when b - max(e) over (partition by name order by b, e rows between unbounded preceding and 1 preceding) <= 2 then 0 else 1 end as n from h),
i as (select *, sum(n) over (partition by name order by b, e rows unbounded preceding) as g from m)
select name, min(b) as "begin", max(e) as stop, count(*) as parts from i group by name, g""")
def _(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").alias("name"), F.col("event_id").alias("begin"), (F.col("event_id") + F.floor("value") % 50).alias("stop"))
    return wi.merge_adjacent(ev)


@graph_query("L1_capped", "select id, n, (select count(*) from (select distinct dst from internal)) as total, (select count(*) from (select distinct dst from internal)) > 10 as truncated from (select dst as id, count(*) as n from internal group by dst order by n desc, id limit 10)")
def _(g):
    n = g.of("IMPORTS").filter("kind = 'internal'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return wi.capped(n, [F.desc("n"), "id"], 10)


@graph_query("L4_with_more", "select id, files, greatest((select count(distinct dst) from external) - 10, 0) as hidden from (select dst as id, count(distinct src) as files from external group by dst order by files desc, id limit 10)")
def _(g):
    return wi.with_more(ag.package_ranking(g), [F.desc("files"), "id"], 10)


@graph_query("L7_suggestions", "select id from node where lower(id) like '%/p11%' order by id limit 8")
def _(g):
    return lo.suggestions(g, "/P11")


@graph_query("L8_max_files", "select path from file order by path limit 100")
def _(g):
    return g.files.select("path").orderBy("path").limit(100)


@graph_query("U1_merge_layers", "select id, 0 as layer, kind from file union all select id, 1, kind from symbol")
def _(g):
    return inc.merge_layers([g.files.select("id", "kind"), g.symbols.select("id", "kind")]).select("id", "layer", "kind")


@graph_query("U3_known_unknown", "select path as p, true as known from file where kind = 'test' union all select path || 'x', false from file where kind = 'asset'")
def _(g):
    p = g.files.filter("kind = 'test'").select("path").union(g.files.filter("kind = 'asset'").select(F.concat("path", F.lit("x"))))
    known, unknown = tr.known_and_unknown(g, p)
    return known.select(F.col("path").alias("p"), F.lit(True).alias("known")).union(unknown.select("path", F.lit(False)))


@graph_query("U5_disjoint_buckets", "select path, case when kind = 'test' then 'added' when size_bytes < 2000 then 'deleted' else 'modified' end as change from file where kind = 'test' or size_bytes < 2000 or size_bytes < 3000")
def _(g):
    f = g.files
    return inc.disjoint_buckets(f.filter("kind = 'test'"), f.filter("size_bytes < 2000"), f.filter("size_bytes < 3000"))


@graph_query("U6_I1_incremental", "select src, dst from internal")
def _(g):
    """The cache holds edges that are gone, edges of a file that is gone, and none of what affected files import now; their modules are read again. The result is the layer of now."""
    full = g.of("IMPORTS").filter("kind = 'internal'").select("src", "dst")
    affected = g.files.filter("kind = 'test'").select(F.col("id").alias("node"))
    marked = full.join(affected.select(F.col("node").alias("src"), F.lit(True).alias("old")), "src", "left")
    cached = marked.select("src", F.when(F.col("old"), F.concat("dst", F.lit("-before"))).otherwise(F.col("dst")).alias("dst")).union(full.limit(5).select(F.concat("src", F.lit("-deleted")), "dst"))
    sources = _sources(g).select(file_id(F.col("path")).alias("id"), "path", "text")

    def extract(again: DataFrame) -> DataFrame:
        found = layers.specifier_rows(again.join(sources, "id").select("path", "text")).filter(F.col("specifier").startswith("/"))
        return found.select(file_id(F.col("path")).alias("src"), file_id(F.expr("substring(specifier, 2)")).alias("dst"))

    return inc.incremental_layer(cached, affected, extract, g.files.select("id"))


@graph_query("S7_snapshot_diff", "select path, case when kind = 'test' then 'added' when kind = 'asset' then 'deleted' else 'modified' end as change from file where kind in ('test', 'asset') or entry_point")
def _(g):
    old = g.files.filter("kind <> 'test'").select("path", "sha256")
    new = g.files.filter("kind <> 'asset'").select("path", F.when(F.col("entry_point"), "new").otherwise(F.col("sha256")).alias("sha256"))
    return inc.snapshot_diff(old, new)


@table_query("S9_last_rows", "select user_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def _(spark, d):
    return inc.last_rows(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@table_query("S15_upsert", "select c_custkey, case when c_custkey % 2 = 0 then 'new' else c_mktsegment end as text from customer where c_custkey % 3 > 0")
def _(spark, d):
    c = table(spark, d, "customer")
    return inc.upsert(c.select("c_custkey", F.col("c_mktsegment").alias("text")), c.filter("c_custkey % 2 = 0").select("c_custkey", F.lit("new").alias("text")), "c_custkey", c.filter("c_custkey % 3 > 0").select("c_custkey"))


@graph_query("S10_inventory_sources", "select path from file where kind in ('code', 'test')")
def _(g):
    return g.files.filter(fp.is_linkable(F.col("path")) & F.col("kind").isin("code", "test")).select("path")


@graph_query("S13_S14_load_graph", "select type, count(*) as n, count(distinct src) as sources, count(distinct dst) as targets from (select distinct type, src, dst from edge) group by type union all select 'nodes', count(*), 0, 0 from file")
def _(g):
    """Layers written as JSON lines and loaded again: files twice, with other properties, and edges twice."""
    from .plans.shared import scratch
    from .sources.jsonl import load_layers, write_jsonl

    spark = g.edges.sparkSession
    cache = scratch(spark, "layers")
    nodes = g.files.select("id", F.array(F.lit("File")).alias("labels"), F.create_map(F.lit("path"), F.col("path"), F.lit("size"), F.col("size_bytes").cast("string")).alias("properties"))
    edges = g.edges.select(edge_id(F.col("src"), F.col("type"), F.col("dst")).alias("id"), "type", F.col("src").alias("from"), F.col("dst").alias("to"), F.create_map(F.lit("kind"), F.col("kind")).alias("properties"))
    write_jsonl(nodes, f"{cache}/inventory/nodes.jsonl")
    write_jsonl(edges.filter("type = 'IMPORTS'"), f"{cache}/imports/edges.jsonl")
    write_jsonl(edges, f"{cache}/references/edges.jsonl")
    write_jsonl(nodes.withColumn("properties", F.create_map(F.lit("size"), F.lit("0"))), f"{cache}/imports/nodes.jsonl")
    n, e, found = load_layers(spark, cache)
    counts = e.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))
    zero = F.lit(0).cast("long")
    return counts.unionByName(n.select("id").distinct().agg(F.count("*").alias("n")).select(F.lit("nodes").alias("type"), "n", zero.alias("sources"), zero.alias("targets")))


@graph_query("S20_nearest_config", "select path, case when path like 'src/brand-11/%' then 'src/brand-11' else 'src' end as root from file")
def _(g):
    return rs.longest_prefix(g.files, g.edges.sparkSession.createDataFrame([("src",), ("src/brand-11",), ("lib",)], "root string"))


# traversals -----------------------------------------------------------------

RADIUS = f"r(id, d) as (select {HUB}, 0 union select i.src, d + 1 from r join internal i on i.dst = r.id where d < 25)"


@graph_query("R1_impact_of", f", {RADIUS}, n as (select id as node, cast(min(d) as int) as depth from r where id <> {HUB} group by id) select node, depth, (select coalesce(max(depth), 0) >= 25 from n) as depth_cap_reached from n", True)
def _(g):
    return tr.impact_of(g, hub(g))


TEN = "(select dst from internal group by dst order by count(*) desc, dst limit 10)"


def _ten(g: Graph) -> DataFrame:
    n = g.of("IMPORTS").filter("kind = 'internal'").groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(10)
    return n.select(F.col("dst").alias("node"))


@graph_query("R2_transitive_importers", f", r(id, d) as (select dst, 0 from {TEN} union select i.src, d + 1 from r join internal i on i.dst = r.id where d < 25) select id as node, cast(min(d) as int) as depth from r group by id having min(d) > 0", True)
def _(g):
    return tr.transitive_importers(g, _ten(g))


@graph_query("R3_path_between", f""", back(id, d) as (select {HUB}, 0 union select i.src, d + 1 from back join internal i on i.dst = back.id where d < 25), dist as (select id, min(d) as d from back group by id),
start as (select id, d from dist order by d desc, id limit 1), walk(id, hop) as (select id, 0 from start union all select (select min(i.dst) from internal i join dist t on t.id = i.dst where i.src = w.id and t.d = (select d from start) - w.hop - 1), hop + 1 from walk w where hop < (select d from start))
select cast(hop as int) as hop, id as node from walk""", True)
def _(g):
    inner = g.of("IMPORTS").filter("kind = 'internal'").select("src", "dst")
    goal = hub(g)
    far = tr.transitive_importers(g, g.edges.sparkSession.createDataFrame([(goal,)], "node string")).orderBy(F.desc("depth"), "node").first()
    return tr.shortest_path(inner, far["node"], goal)


MUTUAL = """, e as (select src, dst from internal where src <> dst), reach_(a, b) as (select src, dst from e union select a, dst from reach_ join e on b = src),
comp as (select x.a as node, min(x.b) as component from reach_ x join reach_ y on x.a = y.b and x.b = y.a group by x.a having count(distinct x.b) > 1)"""


@graph_query("R4_strong_components", MUTUAL + " select node, component from comp", True)
def _(g):
    return cy.strong_components(g.of("IMPORTS").filter("kind = 'internal'").select("src", "dst"))


RINGS = """, ce as (select c.component, e.src, e.dst from e join comp c on c.node = e.src join comp d on d.node = e.dst and d.component = c.component),
paths(component, node, path) as (select distinct component, component, [component] from comp union all select p.component, ce.dst, list_append(path, ce.dst) from paths p join ce on ce.component = p.component and ce.src = p.node where (len(path) = 1 or p.node <> p.component) and (ce.dst = p.component or not list_contains(path, ce.dst))),
rings as (select component, path[:-2] as ring from paths where len(path) > 1 and node = component),
best as (select component, ring from (select *, row_number() over (partition by component order by len(ring), ring) as k from rings) where k = 1)"""


@graph_query("R5_R6_file_cycles", MUTUAL + RINGS + " select component, (select count(*) from comp c where c.component = b.component) as size, cast(len(ring) as int) as length, array_to_string(ring, ',') as ring from best b", True)
def _(g):
    return cy.file_cycles(g)


@graph_query("R7_domain_cycles", """, e as (select src, dst, weight from depends), reach_(a, b) as (select src, dst from e union select a, dst from reach_ join e on b = src),
comp as (select x.a as node, min(x.b) as component from reach_ x join reach_ y on x.a = y.b and x.b = y.a group by x.a having count(distinct x.b) > 1),
two as (select c.component, [c.component, o.dst] as ring, o.weight as w1, i.weight as w2, row_number() over (partition by c.component order by o.dst) as k from (select distinct component from comp) c join e o on o.src = c.component join e i on i.src = o.dst and i.dst = c.component)
select component, (select count(*) from comp c where c.component = two.component) as size, 2 as length, array_to_string(ring, ',') as ring, least(w1, w2) as min_weight, w1 + w2 as total_weight from two where k = 1""", True)
def _(g):
    return cy.domain_cycles(g)


@graph_query("R6_self_loops", "select distinct src as node from internal where src = dst")
def _(g):
    return cy.self_loops(g.of("IMPORTS").filter("kind = 'internal'"))


def _entry_reachable(g: Graph, max_hops: int | None) -> DataFrame:
    re_ = g.of("IMPORTS").filter("kind = 'internal'").select(tail(F.col("src")).alias("path"), tail(F.col("dst")).alias("target"), F.lit("star").alias("kind"), F.lit(None).cast("string").alias("exported"), F.lit(None).cast("string").alias("declared"))
    declared = g.symbols.filter("exported").select("path", "name", F.col("id").alias("sym"))
    return tr.entry_reachable(re_, declared, g.files.filter("entry_point").select("path"), max_hops)


@graph_query("R8_entry_reachable", """, st(entry, path, hops) using key (entry, path) as (select path, path, 0 from file where entry_point union select st.entry, substr(i.dst, 6), min(st.hops) + 1 from st join internal i on i.src = 'file:' || st.path where not exists (select 1 from recurring.st r where r.entry = st.entry and r.path = substr(i.dst, 6)) group by 1, 2)
select 'sym:' || s.path || '#' || s.name as sym, min(entry) as entry, cast(arg_min(hops, (entry, hops)) as int) as hops from st join symbol s on s.path = st.path and s.exported group by 1""", True)
def _(g):
    """The same with every chain followed to its end."""
    return _entry_reachable(g, None)


@graph_query("R9_affected_files", f", r(id) as (select dst from {TEN} union select i.src from r join internal i on i.dst = r.id) select id as node from r", True)
def _(g):
    return tr.affected_files(g, _ten(g))


IMPACT = f", r(id, d) as (select dst, 0 from {TEN} union select i.src, d + 1 from r join internal i on i.dst = r.id where d < 25), touched as (select distinct id from r)"


def _impact(section: str):
    return lambda g: tr.build_impact(g, _ten(g).select(tail(F.col("node")).alias("path")))[section]


graph_query("R10_impact_domains", IMPACT + " select b.dst as domain, count(*) as files from touched t join belongs b on b.src = t.id group by 1", True)(_impact("domains"))
graph_query("R10_impact_risky_exports", f", t as (select dst as id from {TEN}) select s.id as sym, count(distinct r.src) as refs from symbol s join t on t.id = 'file:' || s.path join refs r on r.dst = s.id and not r.same_file where s.exported group by 1")(_impact("risky_exports"))
graph_query("R10_impact_tests", IMPACT + " select id as node from touched where id in (select id from file where kind = 'test')", True)(_impact("tests"))


# scalar functions -----------------------------------------------------------

@table_query("F1_F3_ids", "select 'file:' || url as file_id, regexp_extract(rtrim(url, '/'), '[^/]*$') as base, 'edge:' || 'file:' || url || ':IMPORTS:pkg:x' as edge_id, page_id from pages")
def _(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", file_id(F.col("url")).alias("file_id"), fp.base_name(F.col("url")).alias("base"), edge_id(file_id(F.col("url")), F.lit("IMPORTS"), F.lit("pkg:x")).alias("edge_id"))


@table_query("F4_kebab", """select p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(p_name, '([A-Z]+)([A-Z][a-z])', '\\1-\\2', 'g'), '([a-z0-9])([A-Z])', '\\1-\\2', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unassigned') as kebab from part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", fp.kebab(F.col("p_name")).alias("kebab"))


@table_query("F5_F6_specifiers", """select page_id, i, s, case when s like '@%/%' then regexp_extract(s, '^(@[^/]+/[^/]+)', 1) else split_part(s, '/', 1) end as package, case when s like '@%/%' then split_part(s, '/', 1) end as scope, regexp_matches(s, '^\\.\\.?(/|$)') as relative
from (select page_id, i, case i when 0 then '@s' || page_id || '/ui/button' when 1 then 'lodash/' || page_id when 2 then './x' || page_id else '..' end as s from pages, range(4) t(i))""")
def _(spark, d):
    p = table(spark, d, "pages").select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("i"))
    i, k = F.col("i"), F.col("page_id").cast("string")
    s = F.when(i == 0, F.concat(F.lit("@s"), k, F.lit("/ui/button"))).when(i == 1, F.concat(F.lit("lodash/"), k)).when(i == 2, F.concat(F.lit("./x"), k)).otherwise("..")
    p = p.withColumn("s", s)
    return p.select("page_id", "i", "s", fp.package_name(F.col("s")).alias("package"), fp.package_scope(fp.package_name(F.col("s"))).alias("scope"), fp.is_relative(F.col("s")).alias("relative"))


@graph_query("F7_resolve_path", "select path, regexp_extract(path, '^(.*)/[^/]*/[^/]*$', 1) || '/x.ts' as up, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/y.ts' as here from file")
def _(g):
    d = fp.dir_name(F.col("path"))
    return g.files.select("path", fp.resolve_path(d, F.lit("../x.ts")).alias("up"), fp.resolve_path(d, F.lit("./z/../y.ts")).alias("here"))


@graph_query("F9_F10_F16_symbols", "select id, id as base, path as of_path, name || '@' || path as short, path as ref_path, name as ref_name from symbol")
def _(g):
    again = F.concat("id", F.lit("~2"))
    ref = fp.symbol_ref(F.col("id"))
    return g.symbols.select("id", fp.base_symbol_id(again).alias("base"), fp.symbol_path(F.col("id")).alias("of_path"), fp.short_symbol(F.col("id")).alias("short"), ref["path"].alias("ref_path"), ref["name"].alias("ref_name"))


@table_query("F13_F26_text", r"""select doc_id, coalesce(nullif(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'domain') as slug, case when length(flat) > 80 then substr(flat, 1, 79) || '…' else flat end as fragment
from (select doc_id, text, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) as flat from documents)""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", fp.slug(F.col("text")).alias("slug"), fp.fragment(F.col("text"), 80).alias("fragment"))


@table_query("F15_human_bytes", "select doc_id, case when n_chars * 37 < 1024 then n_chars * 37 || ' B' when n_chars * 37 < 1048576 then format('{:.1f} KB', round(n_chars * 37 / 1024.0, 1)) else format('{:.1f} MB', round(n_chars * 37 / 1048576.0, 1)) end as size from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", fp.human_bytes(F.col("n_chars") * 37).alias("size"))


@table_query("F17_F31_markers", "select p_partkey, case when p_size % 7 > 0 then '(+' || p_size % 7 || ' more…)' else '' end as more, case when p_size % 3 = 0 then '' else p_size % 3 || case when p_size % 3 = 1 then ' computed import' else ' computed imports' end || ' in 1 file may hide uses' end as caveat from part")
def _(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", fp.more_marker(F.col("p_size") % 7).alias("more"), fp.caveat(F.col("p_size") % 3, F.lit(1)).alias("caveat"))


#: File names of all sorts, {k} being a part's number: what predicates of paths are asked about.
NAMES = (
    "index{k}.ts", "src/index.ts", "src/a{k}.ts", "src/a{k}.d.ts", "src/b{k}.d.mts", "src/c{k}.test.ts", "src/d{k}.spec.jsx", "tests/e{k}.py", "tests/e{k}.json", "__tests__/f{k}.css", "Spec/g{k}.ts", "src/Worker.mjs", "src/bootstrap.cjs",
    "vite.config.ts", "pkg/tool.config.{k}.js", "src/h{k}.module.css", "src/i{k}.min.js", "src/j{k}.js.map", "Dockerfile", "x/dockerfile.{k}", "Makefile", "a/k{k}.tar.gz", "a/l{k}.xz", "a/M{k}.PNG", "a/n{k}.svg", "a/o{k}.MD", "a/p{k}.txt",
    "a/q{k}.json", "a/package.json", "a/yarn.lock", "a/Cargo.lock", "a/.env", "a/.env.local", "a/.env.{k}.sample", "a/.gitignore", "a/r{k}", "a/s{k}.key", "a/t-key.pem", "a/u{k}.pem", "a/id_rsa", "a/.netrc", "a/v{k}.P8", "a/.DS_Store",
    "node_modules/w{k}.js", "a/dist/x{k}.d.ts", "a/out/y{k}.js", "vendor/z{k}.go", "a/.venv/b{k}.py", "a/c{k}.egg-info/d.txt", "a/build", "a/__generated__/e{k}.ts", "a/.next/f{k}.tsx", "g{k}.toml", "a/h{k}.yaml", "a/i{k}.ini", "a/j{k}.c", "a/k{k}.", "a/l{k}.unknown",
)
UNIVERSE = f"u as (select distinct replace(([{', '.join(repr(n) for n in NAMES)}])[p_partkey % {len(NAMES)} + 1], '{{k}}', cast(p_partkey as varchar)) as path from part), "
UNIVERSE += "p as (select path, lower(regexp_extract(path, '[^/]*$')) as base, regexp_extract(path, '[^/]*$') as name from u)"
TYPES = ", ".join(f"('{e}', '{l}')" for e, l in fp.LANGUAGES.items())


def _universe(spark: SparkSession, d: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % len(NAMES) + 1).cast("int"))
    return table(spark, d, "part").select(F.replace(names, F.lit("{k}"), F.col("p_partkey").cast("string")).alias("path")).distinct()


@table_query("S2_should_skip", f"""with {UNIVERSE} select path, regexp_matches(path, '(^|/)(\\.git|\\.kg-cache|node_modules|\\.cache|\\.turbo|\\.vite|dist|build|coverage|\\.next|\\.venv|venv|__pycache__|\\.pytest_cache|\\.mypy_cache|[^/]*\\.egg-info)/')
or name = '.DS_Store' or name in ('id_rsa', 'id_dsa', 'id_ecdsa', 'id_ed25519', '.npmrc', '.netrc', '_netrc') or regexp_matches(base, '(\\.key|-key\\.pem|\\.private\\.pem|\\.key\\.pem|\\.p12|\\.pfx|\\.jks|\\.keystore|\\.pkcs12|\\.ppk|\\.p8|\\.mobileprovision|\\.provisionprofile)$')
or (name = '.env' or name like '.env.%') and not regexp_matches(base, '\\.(sample|example)$') as skip from p""")
def _(spark, d):
    return _universe(spark, d).select("path", fp.should_skip(F.col("path")).alias("skip"))


@table_query("P4_P5_H8_classify", f"""with {UNIVERSE}, types(ext, lang) as (values {TYPES}),
e as (select *, case when regexp_matches(base, '^.+\\.(d\\.[mc]?ts|tar\\.(gz|bz2|xz))$') then regexp_extract(base, '\\.(d\\.[mc]?ts|tar\\.(gz|bz2|xz))$') else regexp_extract(base, '^.+(\\.[^.]*)$', 1) end as extension from p),
l as (select e.*, lang, regexp_matches(extension, '^\\.(png|jpe?g|gif|bmp|ico|webp|tiff?|avif|hei[cf]|woff2?|ttf|otf|eot|mp[34]|wav|og[ga]|webm|mov|avi|mkv|flac|m4[av]|aac|wmv|zip|(tar\\.)?(gz|bz2|xz)|tar|tgz|7z|rar|[jw]ar|pdf|wasm|so|dylib|dll|exe|bin|class|o|a|node|dat|dmg|iso)$') as is_binary from e left join types on ext = extension),
m as (select *, coalesce(lang, case when is_binary then 'Binary' when base = 'dockerfile' or base like 'dockerfile.%' then 'Dockerfile' when base = 'makefile' then 'Makefile' else 'Unknown' end) as language, is_binary or extension = '.svg' as asset,
  base in ('package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'npm-shrinkwrap.json', 'bun.lockb') as lockfile from l)
select path, extension, language, case when lockfile then 'lockfile' when asset then 'asset' when regexp_matches(base, '\\.(test|spec)\\.') or regexp_matches(path, '(^|/)(tests|__tests__)/') and lang is not null and language not in ('JSON', 'Markdown', 'CSS', 'HTML', 'YAML', 'SVG', 'XML', 'TOML', 'INI', 'Text') then 'test'
  when language = 'Markdown' then 'doc' when base in ('vite.config.ts', 'package.json', '.gitignore', 'dockerfile', 'makefile') or extension in ('.yaml', '.yml', '.toml', '.ini', '.cfg', '.conf', '.editorconfig') then 'config' else 'code' end as kind,
  case when language = 'Markdown' then 'doc' when asset then 'asset' else 'code' end as trust, is_binary, lockfile or contains(base, '.min.') or extension = '.map' as is_generated from m""")
def _(spark, d):
    c = fp.classify(F.col("path"))
    return _universe(spark, d).select("path", *[c[x].alias(x) for x in ("extension", "language", "kind", "trust")], c["isBinary"].alias("is_binary"), c["isGenerated"].alias("is_generated"))


@table_query("F14_path_predicates", f"""with {UNIVERSE} select path, lower(regexp_replace(name, '\\.[^.]+$', '')) as stem, regexp_matches(base, '^.+\\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)$') as linkable,
regexp_matches(lower(path), '(^|/)(__tests__|__test__|test|tests|spec)/') or regexp_matches(base, '\\.(test|spec)\\.[a-z]+$') as test,
not contains(path, '/') or regexp_matches(base, '\\.d\\.[cm]?ts$') or contains(base, '.config.') or lower(regexp_replace(name, '\\.[^.]+$', '')) in ('index', 'main', 'bootstrap', 'entry', 'app', 'server', 'cli', 'worker', 'setup') as entry_like from p""")
def _(spark, d):
    q = F.col("path")
    return _universe(spark, d).select("path", fp.stem(q).alias("stem"), fp.is_linkable(q).alias("linkable"), fp.is_test_path(q).alias("test"), fp.is_entry_like(q).alias("entry_like"))


@table_query("F25_importable", f"""with {UNIVERSE} select path, regexp_matches(path, '\\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)$') and not regexp_matches(path, '\\.d\\.[mc]?ts$') and not regexp_matches(path, '(^|/)__tests__/') and not regexp_matches(path, '\\.(test|spec)\\.[a-z]+$')
and len(list_intersect(string_split(path, '/'), ['dist', 'build', 'out', '.next', 'coverage', 'storybook-static', '__generated__'])) = 0 as importable from p""")
def _(spark, d):
    return _universe(spark, d).select("path", fp.is_importable(F.col("path")).alias("importable"))


@table_query("F27_injects_globals", r"""select doc_id, x.path as path, x.path like '%.d.ts' or coalesce(regexp_matches(x.t, '\bdeclare\s+global\b|\bexport\s+as\s+namespace\b'), false) as injects from (select doc_id, case doc_id % 5 when 0 then 'a.d.ts' else 'a.ts' end as path,
case doc_id % 5 when 1 then text || ' declare  global {' when 2 then 'export as namespace N; ' || text when 3 then text || ' declare module "m" {}' else text end as t from documents) x""")
def _(spark, d):
    k, t = F.col("doc_id") % 5, F.col("text")
    text = F.when(k == 1, F.concat(t, F.lit(" declare  global {"))).when(k == 2, F.concat(F.lit("export as namespace N; "), t)).when(k == 3, F.concat(t, F.lit(' declare module "m" {}'))).otherwise(t)
    docs = table(spark, d, "documents").select("doc_id", F.when(k == 0, "a.d.ts").otherwise("a.ts").alias("path"), text.alias("text"))
    return docs.select("doc_id", "path", fp.injects_globals(F.col("path"), F.col("text")).alias("injects"))


@table_query("F12_nearest", """with k as (select n_name as key from nation union select substr(n_name, 1, greatest(length(n_name) - 2, 2)) from nation union select lower(reverse(n_name)) from nation union select r_name from region)
select key, (select n_name from nation where levenshtein(lower(n_name), lower(key)) <= 3 order by levenshtein(lower(n_name), lower(key)), n_name limit 1) as nearest from k""")
def _(spark, d):
    from .operators.answer import nearest

    n = table(spark, d, "nation").select("n_name")
    keys = n.select(F.col("n_name").alias("key")).union(n.select(F.expr("substring(n_name, 1, greatest(length(n_name) - 2, 2))"))).union(n.select(F.lower(F.reverse("n_name")))).union(table(spark, d, "region").select("r_name")).distinct()
    return nearest(keys, "key", n, "n_name")


BUILT = ("pk/dist/{n}.d.ts", "pk/dist/sub/{n}.js", "pk/lib/esm/{n}.mjs", "pk/src/{n}.ts", "build/pk/{n}.js", "pk/dist", "pk/out/{n}.CSS", "pk/es/{n}.d.CTS")


@graph_query("F8_H11_build_paths", f""", b as (select path, replace(([{', '.join(repr(n) for n in BUILT)}])[length(path) % {len(BUILT)} + 1], '{{n}}', name) as target from file),
x as (select path, target, regexp_extract(target, '^(.*?/)?(dist|build|out|lib|es|esm|cjs)/(.*)$', 1) as before, regexp_extract(target, '^(.*?/)?(dist|build|out|lib|es|esm|cjs)/(.*)$', 3) as after from b),
y as (select *, regexp_replace(after, '\\.(d\\.(ts|mts|cts)|ts|tsx|mts|cts|js|jsx|mjs|cjs)$', '', 'i') as stem from x)
select path, target, case when after = '' then target else target || '|' || before || 'src/' || stem || '|' || before || stem end as variants, regexp_replace(target, '\\.(d\\.(ts|mts|cts)|ts|tsx|mts|cts|js|jsx|mjs|cjs)$', '', 'i') as bare, target like 'pk/%' as under from y""")
def _(g):
    t = F.replace(F.element_at(F.array(*map(F.lit, BUILT)), (F.length("path") % len(BUILT) + 1).cast("int")), F.lit("{n}"), F.col("name"))
    rows = g.files.select("path", t.alias("target"))
    return rows.select("path", "target", F.array_join(fp.source_variants(F.col("target")), "|").alias("variants"), fp.without_build_extension(F.col("target")).alias("bare"), fp.under_dir(F.col("target"), F.lit("pk")).alias("under"))


@graph_query("J12_match_generated", """select 'pk/dist/' || replace(name, '.ts', '.d.ts') as base, 'pk/src/' || name as path from file where kind = 'test' union all select 'dist/lib/' || replace(name, '.ts', '.js'), 'dist/src/' || replace(name, '.ts', '.tsx') from file where kind = 'asset'""")
def _(g):
    """Declarations and scripts of built packages; the second package lies in a folder that is named like a build folder."""
    spark = g.edges.sparkSession
    tests, assets = g.files.filter("kind = 'test'"), g.files.filter("kind = 'asset'")
    files = tests.select(F.concat(F.lit("pk/src/"), "name").alias("path")).union(assets.select(F.concat(F.lit("dist/src/"), F.regexp_replace("name", r"\.ts$", ".tsx"))))
    bases = g.files.filter("kind <> 'asset'").select(F.concat(F.lit("pk/dist/"), F.regexp_replace("name", r"\.ts$", ".d.ts")).alias("base")).union(assets.select(F.concat(F.lit("dist/lib/"), F.regexp_replace("name", r"\.ts$", ".js"))))
    return rs.match_generated(bases, files, spark.createDataFrame([("pk",), ("dist",)], "root string"))


@graph_query("R11_file_brief", """select f.id, f.kind, (select count(*) from symbol s where s.path = f.path) as symbols, (select count(*) from symbol s where s.path = f.path and s.exported) as exported, (select count(distinct src) from internal where dst = f.id) as importers,
(select count(*) from (select distinct dst from edge where type = 'IMPORTS' and src = f.id)) as imports, b.dst as domain from file f left join belongs b on b.src = f.id""")
def _(g):
    return lo.file_briefs(g)


@graph_query("R11_symbol_brief", """select s.id, s.name, s.kind, s.exported, coalesce(r.n, 0) as referencing_files, coalesce(r.own, 0) as own_references, coalesce(u.n, 0) as users, b.dst as domain from symbol s
left join (select dst, count(distinct src) filter (not same_file) as n, count(distinct src) filter (same_file) as own from refs group by dst) r on r.dst = s.id left join (select dst, count(distinct src) as n from uses group by dst) u on u.dst = s.id left join belongs b on b.src = 'file:' || s.path""")
def _(g):
    return lo.symbol_briefs(g)


graph_query("R10_impact_radius", IMPACT + f" select id as node, cast(min(d) as int) as depth from r where id not in {TEN} group by id", True)(_impact("radius"))


@graph_query("R13_path_compression")
def _(g):
    """The paths of each domain's files, compressed round by round until no folder saves anything: prefix, rest."""
    from .operators.answer import compressed_rows

    return compressed_rows(g.of("BELONGS_TO").select(F.col("dst").alias("key"), tail(F.col("src")).alias("path")))


@table_query("F20_F21_content_hash", """select c_custkey, sha256('{"facts":{"balance":' || cast(cast(round(c_acctbal * 100) as bigint) as varchar) || ',"segment":"' || c_mktsegment || '"},"id":"' || c_name || '","kind":"customer"}') as content_hash from customer""")
def _(spark, d):
    c = table(spark, d, "customer")
    facts = F.struct(F.col("c_mktsegment").alias("segment"), F.round(F.col("c_acctbal") * 100).cast("long").alias("balance"))
    return c.select("c_custkey", inc.content_hash(F.struct(F.lit("customer").alias("kind"), F.col("c_name").alias("id"), facts.alias("facts")), c.select(F.struct(F.lit("customer").alias("kind"), F.col("c_name").alias("id"), facts.alias("facts")).alias("x")).schema["x"].dataType).alias("content_hash"))


@graph_query("F18_dir_prefixes", "select path, unnest(['src/', 'src/' || split_part(path, '/', 2) || '/', 'src/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) || '/']) as prefix from file")
def _(g):
    return g.files.select("path", F.explode(fp.dir_prefixes(F.col("path"))).alias("prefix"))


@table_query("F23_generated_label", "select o_orderkey, 'generated by ' || o_orderpriority || ' via ' || o_orderstatus || ', ' || strftime(o_orderdate, '%Y-%m-%d') as label from orders")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", fp.generated_label(F.col("o_orderpriority"), F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("label"))


@graph_query("H1_kind_of_id", "select id, label from node")
def _(g):
    return g.nodes().select("id", kind_of_id(F.col("id")).alias("label"))


@graph_query("H4_S4_file_hash", "select id, sha256(case when kind = 'test' then null else path end || '') as sha256 from file where kind <> 'test' union all select id, sha256('text of ' || name) from file where kind = 'test'")
def _(g):
    """The hash that the inventory has, else that of the text; tests come without one here."""
    files = g.files.withColumn("sha256", F.when(F.col("kind") != "test", F.col("sha256")))
    return lo.file_hashes(files, g.files.select("path", F.concat(F.lit("text of "), "name").alias("text")))


@table_query("S4_hash_texts", "select doc_id, sha256(text) as sha256 from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def _sources(g: Graph) -> DataFrame:
    """path, text: a module for every file that imports, with decoys in a comment, a string and a template."""
    e = g.of("IMPORTS").select(tail(F.col("src")).alias("path"), "kind", "specifier")
    line = F.when(F.col("kind") == "internal", F.concat(F.lit("import { x } from '"), "specifier", F.lit("';"))).otherwise(F.concat(F.lit('const y = require("'), "specifier", F.lit('");')))
    made = e.select("path", F.struct((F.col("kind") != "internal").alias("k"), "specifier", line.alias("line")).alias("l")).groupBy("path").agg(F.sort_array(F.collect_list("l")).alias("l"))
    decoys = F.lit("// import { no } from 'no';\nconst s = \"import z from 'no'\", t = `from 'no'`;")
    return made.select("path", F.concat_ws("\n", decoys, F.col("l.line")).alias("text"))


@graph_query("P6_specifiers", "select substr(src, 6) as path, row_number() over (partition by src order by kind <> 'internal', specifier) - 1 as ord, specifier from edge where type = 'IMPORTS'")
def _(g):
    return layers.specifier_rows(_sources(g))


@graph_query("P9_J13_resolved_imports", "select substr(src, 6) as file, specifier, case when kind = 'internal' then 'unresolved' else 'external' end as kind, case when kind = 'external' then 'pkg:' || specifier end as target from edge where type = 'IMPORTS' and not contains(specifier, '/') union all select substr(src, 6), './../../' || substr(specifier, 6), 'internal', substr(specifier, 2) from edge where type = 'IMPORTS' and kind = 'internal' and contains(specifier, '/')")
def _(g):
    """Specifiers out of the modules' texts, the internal ones made relative, resolved on the files."""
    found = layers.specifier_rows(_sources(g))
    inner = F.col("specifier").startswith("/")
    specs = found.select(F.col("path").alias("file"), F.when(inner, F.concat(F.lit("./../../"), F.expr("substring(specifier, 6)"))).otherwise(F.col("specifier")).alias("specifier"))
    spark = g.edges.sparkSession
    none = spark.createDataFrame([], "name string, dir string")
    return rs.resolve_specifiers(specs, g.files, _patterns(spark).limit(0), none, spark.createDataFrame([], "root string"))


@table_query("P15_slice_lines", "select doc_id, case when text is not null then coalesce(array_to_string(string_split(text, chr(10))[2:4], chr(10)), '') end as part from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", fp.slice_lines(F.col("text"), 2, 4).alias("part"))


@table_query("P16_first_doc_line", r"""select doc_id, case when length(l) > 60 then substr(l, 1, 59) || '…' else l end as line from (select doc_id, trim(regexp_replace(coalesce(list_filter(list_transform(string_split(text, chr(10)),
lambda s: trim(regexp_replace(regexp_replace(s, '^[ \t\n\x0B\f\r]*(/\*+|\*+/|\*+|//+)?', ''), '\*+/[ \t\n\x0B\f\r]*$', ''))), lambda s: s <> '')[1], ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) as l from documents)""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", fp.first_doc_line(F.col("text"), 60).alias("line"))


@table_query("I2_staleness", """select p_partkey, case when p_size % 9 = 0 then 'no-cache' when p_size % 7 = 0 then 'build-incomplete' when p_size % 5 = 0 then 'build-context-changed' when p_size % 4 = 0 then 'revision-changed' when p_size % 3 = 0 then 'working-tree-changed' else 'up-to-date' end as reason,
p_size % 9 = 0 or p_size % 7 = 0 or p_size % 5 = 0 or p_size % 4 = 0 or p_size % 3 = 0 as stale from part""")
def _(spark, d):
    s = F.col("p_size")
    p = table(spark, d, "part").select(
        "p_partkey", (s % 9 != 0).alias("cached"), F.lit(True).alias("layers_complete"), F.lit(True).alias("snapshots_match"), (s % 7 != 0).alias("build_complete"), F.when(s % 5 == 0, "x").otherwise("c").alias("context_stored"), F.lit("c").alias("context_now"),
        F.lit(True).alias("vcs_known"), F.concat(F.lit("snapshot:p:"), F.when(s % 4 == 0, "old").otherwise("head")).alias("cache_revision"), F.lit("head").alias("head_revision"), (s % 3 == 0).alias("dirty"),
    )
    return inc.staleness(p).select("p_partkey", "reason", "stale")


@table_query("I3_revision", "select o_orderkey, nullif(nullif(split_part('snapshot:p:' || case when o_orderstatus = 'O' then 'no-revision' else o_orderstatus end, ':', 3), 'no-revision'), '') as revision from orders")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", fp.revision_of(F.concat(F.lit("snapshot:p:"), F.when(F.col("o_orderstatus") == "O", "no-revision").otherwise(F.col("o_orderstatus")))).alias("revision"))


@table_query("X13_search", "select doc_id from documents where regexp_matches(text, 'License')")
def _(spark, d):
    return table(spark, d, "documents").filter(F.col("text").rlike("License")).select("doc_id")
