"""Documentation pages from aggregates: tables made on Spark, text on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import Graph, file_id
from .operators import aggregates as ag
from .operators import lookup
from .operators.windows import capped, unique_slugs

BEGIN, END = "<!-- generated:begin -->", "<!-- generated:end -->"


def merge_generated(existing: str | None, body: str, force: bool = False) -> str | None:
    """The page with what stands between its markers replaced. A page without markers is left alone (null) unless forced."""
    block = f"{BEGIN}\n{body.rstrip()}\n{END}\n"
    if not existing:
        return block
    a, b = existing.find(BEGIN), existing.find(END)
    if a < 0 or b < a:
        return block if force else None
    return existing[:a] + block.rstrip("\n") + existing[b + len(END) :]


def table(df: DataFrame, order: list, limit: int) -> str:
    """A Markdown table of the first rows, and how many more there are."""
    rows = capped(df, order, limit).collect()
    names = df.columns
    if not rows:
        return "(none)\n"
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)] + ["| " + " | ".join(str(r[c]) for c in names) + " |" for r in rows]
    more = rows[0]["total"] - len(rows)
    return "\n".join(lines) + (f"\n\nand {more} more" if more > 0 else "") + "\n"


# Headings by language; what has no entry stands as it is.
WORDS = {
    "ru": {"Overview": "Обзор", "Dependencies": "Зависимости", "Health": "Состояние", "Files": "Файлы", "Symbols": "Символы", "Packages": "Пакеты", "Domains": "Домены", "Most imported": "Чаще всего импортируются", "Most referenced": "Чаще всего используются", "Descriptions": "Описания"},
}


def translator(lang: str) -> Callable[..., str]:
    """text with {names} filled in, in a language; unknown languages and texts stay in English."""
    table = WORDS.get(lang, {})
    return lambda text, **values: table.get(text, text).format(**values)


def agents_page(g: Graph, lang: str = "en") -> str:
    """The page that tools read first: what there is, by domain, and where to look further."""
    t = translator(lang)
    lines = [f"# {t('Overview')}", "", table(ag.label_counts(g), ["label"], 20), f"## {t('Domains')}", "", table(ag.domain_facts(g).select("name", "kind", "files", "deps", "dependents"), [F.desc("files"), "name"], 50)]
    return "\n".join([*lines, f"## {t('Most imported')}", "", table(ag.ranked_targets(g, 10).filter("kind = 'file'").select("id", "score"), [F.desc("score"), "id"], 10)])


def domain_page(g: Graph, domain: str, lang: str = "en", limit: int = 10) -> str:
    """Files by importers, symbols by references from other files, packages, and what the domain depends on."""
    t = translator(lang)
    members = g.of("BELONGS_TO").filter(F.col("dst") == domain).select(F.col("src").alias("id"))
    files = ag.domain_top_files(g, domain, limit)
    symbols = lookup.exported_symbols(g).filter("refs > 0").join(members.withColumnRenamed("id", "file"), file_id(F.col("path")) == F.col("file"), "left_semi").select("id", "refs")
    parts = [
        ("Files", files, [F.desc("importers"), "id"]), ("Symbols", symbols, [F.desc("refs"), "id"]), ("Packages", ag.packages_for_files(g, members), [F.desc("files"), "package"]),
        ("Dependencies", ag.domain_dependencies(g, domain), ["dir", F.desc("weight"), "other"]),
    ]
    return "\n".join(f"## {t(title)}\n\n{table(df, order, limit)}" for title, df, order in parts)


def described(descriptions: DataFrame, g: Graph, lang: str = "en") -> str:
    """What has been written of domains, with links to their pages."""
    slugs = {r["name"]: r["slug"] for r in unique_slugs(g.domains.select("name")).collect()}
    rows = descriptions.select(F.col("targetId").alias("id"), "text").join(g.domains.select("id", "name"), "id").orderBy("name").collect()  # a row per domain
    return "\n".join([f"## {translator(lang)('Descriptions')}", "", *(f"- [{r['name']}](domains/{slugs[r['name']]}.md): {r['text']}" for r in rows)]) + "\n"


def pages(g: Graph, lang: str = "en") -> dict[str, str]:
    """agents, index, dependencies, health and one page per domain."""
    t = translator(lang)
    out = {"agents": agents_page(g, lang), "index": f"# {t('Overview')}\n\n" + table(ag.label_counts(g), ["label"], 20) + "\n" + table(ag.language_histogram(g), [F.desc("n"), "language"], 10)}
    crossings = g.of("DEPENDS_ON").select("src", "dst", "weight")
    out["dependencies"] = f"# {t('Dependencies')}\n\n" + table(crossings, [F.desc("weight"), "src", "dst"], 20) + "\n" + table(ag.package_ranking(g), [F.desc("files"), "id"], 20) + "\n" + table(ag.biggest_importers(g), [F.desc("n"), "id"], 10)
    out["health"] = f"# {t('Health')}\n\n" + table(ag.dead_export_counts(g), ["dead"], 1) + "\n" + table(ag.health(g).drop("total"), ["what", "position"], 40)
    slugs = {r["name"]: r["slug"] for r in unique_slugs(g.domains.select("name")).collect()}  # a page per domain
    for r in ag.domain_facts(g).orderBy("name").collect():
        out[f"domains/{slugs[r['name']]}"] = f"# {r['name']}\n\n{r['kind']}, {r['files']} files, depends on {r['deps']}, {r['dependents']} depend on it\n\n" + domain_page(g, r["id"], lang)
    return out
