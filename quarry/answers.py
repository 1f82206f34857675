"""Answers as text, and the measure that they are cut to.

A payload is a plain dict. `fit_answer` compresses its path lists, cuts its
sections by rank until what is printed fits, and gives back the payload and the
very text that was measured.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable

from .operators.answer import compress_paths, estimate

#: Sections that a budget may cut, the least important with the highest rank.
RANKS = {
    "brief": {"importers": 1, "packages": 2, "symbols": 3, "edges": 4, "dependencies": 1, "top_files": 3, "referenced_by": 2},
    "impact": {"tests": 4, "radius": 3, "risky_exports": 2, "domains": 1, "unknown": 0},
    "outline": {"imports": 2, "declarations": 1},
    "cycles": {"files": 2, "domains": 1},
    "check": {"rules": 1},
    "list": {"items": 1},
}
#: Where a payload has lists of paths: section, field.
PATHS = {"impact": {"radius": "node", "tests": "node", "known": "path", "unknown": "path"}, "brief": {"importers": "src"}, "list": {"items": "path"}}


def resolve_compress(flags: dict, configured: bool | None) -> bool:
    """no_compress_paths over compress_paths over the settings over not."""
    if flags.get("no_compress_paths"):
        return False
    return bool(flags.get("compress_paths") or configured)


def resolve_max_tokens(flags: dict, configured: int | None = None) -> int | None:
    """The flag over the settings; it must be a positive whole number."""
    given = flags.get("max_tokens", configured)
    if given is None:
        return None
    if isinstance(given, bool) or not str(given).isdigit() or int(given) < 1:
        raise ValueError(f"max_tokens: a positive whole number is needed, not {given!r}")
    return int(given)


def _items(section: object) -> list | None:
    """The rows of a section: a list, or what a capped one holds."""
    if isinstance(section, list):
        return section
    if isinstance(section, dict):
        return section.get("items", section.get("list"))
    return None


def _with_items(section: object, rows: list) -> object:
    if isinstance(section, list):
        return rows
    key = "items" if "items" in section else "list"
    return {**section, key: rows}


def compressed(payload: dict, kind: str) -> dict:
    """Path lists as groups: `groups` of prefix and rest, and `items` that stay. Nothing is lost, so `restored` gives the payload back."""
    out = dict(payload)
    for name, field in PATHS.get(kind, {}).items():
        rows = _items(out.get(name))
        if not rows or not all(isinstance(r, dict) and set(r) == {field} and isinstance(r[field], str) for r in rows):
            continue
        groups, left = compress_paths([r[field] for r in rows])
        if groups:
            rest = _with_items(out[name], [{field: p} for p in left])
            made = [{"prefix": d, "paths": ps} for d, ps in groups]
            out |= {name: rest, "groups": made} if isinstance(rest, list) else {name: {**rest, "groups": made}}
    return out


def restored(section: dict, field: str) -> list[str]:
    """All paths of a compressed section, in order."""
    return sorted([r[field] for r in section["items"]] + [g["prefix"] + p for g in section.get("groups", []) for p in g["paths"]])


def _more(section: object, shown: int) -> str:
    total = section.get("total", section.get("count", shown)) if isinstance(section, dict) else shown
    return f"  (+{total - shown} more…)" if total > shown else ""


def _line(row: object) -> str:
    if not isinstance(row, dict):
        return str(row)
    values = [v for v in row.values() if v is not None]
    return " ".join(json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict)) else str(v) for v in values)


def _block(title: str, section: object) -> list[str]:
    rows = _items(section) or []
    groups = section.get("groups", []) if isinstance(section, dict) else []
    shown = len(rows) + sum(len(g["paths"]) for g in groups)
    total = section.get("total", section.get("count", shown)) if isinstance(section, dict) else shown
    lines = [f"{title} ({total}):"]
    for g in groups:
        lines.append(f"  {g['prefix']}{{{', '.join(g['paths'])}}}")
    lines += [f"  {_line(r)}" for r in rows] or ([] if groups else ["  —"])
    more = _more(section, shown)
    return lines + ([more] if more else [])


def _missing(p: dict) -> list[str] | None:
    """An answer that found nothing, or too much."""
    if p.get("ambiguous"):
        return ["ambiguous, candidates:", *(f"  {c}" for c in p["ambiguous"])]
    if p.get("found") is False or p.get("kind") == "not-found":
        near = p.get("suggestions") or p.get("candidates") or []
        return [f"no match for {p.get('query') or p.get('symbol') or p.get('target') or 'it'}", *(["did you mean:"] if near else []), *(f"  {_line(c)}" for c in near)]
    if p.get("kind") == "ambiguous":
        return [f"ambiguous, {p['total']} candidates:", *(f"  {_line(c)}" for c in p["candidates"])]
    return None


def brief_text(p: dict) -> str:
    lines = [p["id"] + (f"  in {p['domain']}" if p.get("domain") else "")]
    if p.get("description"):
        lines.append(f"description: {p['description']}")
    for name in ("dependencies", "importers", "symbols", "referenced_by", "top_files", "packages", "edges"):
        if name in p:
            lines += _block(name.replace("_", " "), p[name])
    return "\n".join(lines)


def impact_text(p: dict) -> str:
    known = p["known"].get("total", 0)
    lines = [f"impact of {known} changed files"]
    if _items(p["unknown"]):
        lines += _block("not in the graph", p["unknown"])
    for name, title in (("radius", "files that import them"), ("domains", "affected domains"), ("risky_exports", "exports that others use"), ("tests", "likely tests")):
        lines += _block(title, p[name])
    return "\n".join(lines)


def outline_text(p: dict) -> str:
    lines = [f"{p['path']}  {p['lines']} lines" + (f", {p['parseErrors']} parse errors" if p["parseErrors"] else "")]
    imports = p["imports"]
    if imports["list"]:
        lines.append(f"imports ({imports['count']}): " + ", ".join(imports["list"]) + (" …" if imports["truncated"] else ""))
    for d in p["declarations"]["list"]:
        mark = "export " if d["exported"] else ""
        lines.append(f"{d['startLine']}-{d['endLine']}  {mark}{d['kind']} {d['signature']}" + (f"  // {d['doc']}" if d["doc"] else ""))
        lines += [f"    {m['startLine']}  {m['signature']}" for m in d.get("members", {}).get("list", [])]
        if d.get("members", {}).get("truncated"):
            lines.append(f"    (+{d['members']['count'] - len(d['members']['list'])} more…)")
    if p["declarations"]["truncated"]:
        lines.append(f"(+{p['declarations']['count'] - len(p['declarations']['list'])} more…)")
    return "\n".join(lines)


def show_text(p: dict) -> str:
    width = len(str(p["endLine"]))
    head = f"{p['id']}  {p['symbolKind']}, lines {p['startLine']}-{p['endLine']}" + ("  (long)" if p["large"] else "")
    return "\n".join([head, *(f"{p['startLine'] + k:>{width}}  {line}" for k, line in enumerate(p["source"].split("\n")))])


def cycles_text(p: dict) -> str:
    return "\n".join(line for name in ("files", "domains") if name in p for line in _block(f"cycles of {name}", p[name]))


def check_text(p: dict) -> str:
    if not p["configured"]:
        return "no rules are configured"
    lines = [("ok" if p["ok"] else "failed") + f", {len(p['rules'])} rules"]
    for r in p["rules"]:
        lines.append(f"{'ok  ' if r['ok'] else 'FAIL'} {r['rule']}: {r['detail']}")
        lines += [f"       {o}" for o in r["offenders"]]
        if r["offenders"] and r["total"] > len(r["offenders"]):
            lines.append(f"       (+{r['total'] - len(r['offenders'])} more…)")
    return "\n".join(lines + [f"problem: {x}" for x in p["problems"]])


def describe_text(p: dict) -> str:
    return p.get("text") or f"{p['status']}: no description of {p['target']}"


def list_text(p: dict) -> str:
    return "\n".join(_block("found", p)) if "items" in p else json.dumps(p, ensure_ascii=False, indent=1)


TEXTS: dict[str, Callable[[dict], str]] = {"brief": brief_text, "impact": impact_text, "outline": outline_text, "show": show_text, "cycles": cycles_text, "check": check_text, "describe": describe_text, "list": list_text}


def as_text(kind: str, payload: dict) -> str:
    missing = _missing(payload)
    return "\n".join(missing) if missing else TEXTS.get(kind, list_text)(payload)


def fit_answer(payload: dict, kind: str, *, mode: str = "text", compress: bool = False, max_tokens: int | None = None) -> dict:
    """payload, text, tokens, omitted, overBudget: the answer as it is printed, within the budget if that can be.

    Sections go by rank, highest first, and the last one that had to go gets back
    as many rows as fit; each cut stands in the payload's `budget`. The head of an
    answer is never dropped: an answer that is still too long says so.
    """
    whole = copy.deepcopy(payload)
    omitted: dict[str, int] = {}

    def made(p: dict) -> tuple[dict, str]:
        shaped = compressed(p, kind) if compress else p
        if max_tokens is not None:
            shaped = {**shaped, "budget": {"maxTokens": max_tokens, "omitted": dict(omitted), **({"overBudget": True} if over else {})}}
        if mode == "json":
            return shaped, json.dumps(shaped, ensure_ascii=False, separators=(",", ":"))
        text = as_text(kind, shaped)
        if omitted:
            text += "\n(cut to fit: " + ", ".join(f"{n} of {k}" for k, n in sorted(omitted.items())) + ")"
        return shaped, text

    over = False
    now = whole
    fits = lambda p: max_tokens is None or estimate(made(p)[1]) <= max_tokens
    if not fits(now):
        ranks = {k: r for k, r in RANKS.get(kind, RANKS["list"]).items() if _items(now.get(k))}
        for name in sorted(ranks, key=lambda k: (-ranks[k], k)):
            section = now[name]
            rows = _items(section)

            def cut(n: int, section=section, rows=rows, name=name) -> dict:
                omitted.pop(name, None)
                if n < len(rows):
                    omitted[name] = len(rows) - n
                return {**now, name: _with_items(section, rows[:n])}

            if fits(cut(0)):
                low, high = 0, len(rows) - 1
                while low < high:
                    mid = (low + high + 1) // 2
                    low, high = (mid, high) if fits(cut(mid)) else (low, mid - 1)
                now = cut(low)
                break
            now = cut(0)
        over = not fits(now)
    shaped, text = made(now)
    return {"payload": shaped, "text": text, "tokens": estimate(text), "omitted": omitted, "overBudget": over}
