"""What a module imports, declares, exports and uses, from its tokens.

Names are bound lexically: there is no type checker here, so uses through types,
namespaces of other files or overloads are approximated by the import table.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from .lexer import Token, tokens

DECLARING = {"function": "function", "class": "class", "interface": "interface", "type": "type", "enum": "enum", "const": "variable", "let": "variable", "var": "variable", "namespace": "namespace", "module": "namespace"}
MODIFIERS = frozenset("export default declare async abstract".split())


@dataclass
class Symbol:
    name: str
    kind: str
    exported: bool
    line: int
    end_line: int
    ordinal: int


@dataclass
class Import:
    specifier: str
    local: str  # empty for side effects
    name: str  # default, * or the exported name


@dataclass
class Reexport:
    specifier: str
    kind: str  # named, star, namespace
    exported: str
    declared: str


def specifiers(text: str) -> list[str]:
    """Specifiers of imports, re-exports, literal dynamic imports and require calls, in source order, repeats kept."""
    ts, out = tokens(text), []
    for k, t in enumerate(ts):
        before = ts[k - 1].text if k else ""
        if t.kind not in ("string", "template") or t.kind == "template" and "${" in t.text:
            continue
        call = before == "(" and k >= 2 and ts[k - 2].text in ("require", "import") and (k < 3 or ts[k - 3].text != ".")
        if t.kind == "string" and (before == "from" or before == "import") or call:
            out.append(t.value)
    return out


def computed_imports(text: str) -> int:
    """Dynamic imports whose argument is no literal; a template without substitutions counts as one."""
    if not re.search(r"\bimport\s*\(", text):
        return 0
    ts, n = tokens(text), 0
    for k in range(len(ts) - 2):
        if ts[k].text == "import" and ts[k + 1].text == "(" and (not k or ts[k - 1].text != "."):
            a, b = ts[k + 2], ts[k + 3].text if k + 3 < len(ts) else ")"
            literal = (a.kind == "string" or a.kind == "template" and "${" not in a.text) and b in (")", ",")
            n += not literal
    return n


def _braces(ts: list[Token], k: int) -> tuple[list[tuple[str, str]], int]:
    """Pairs (name, alias) of a brace list that begins at k, and the index after it."""
    pairs, k = [], k + 1
    while k < len(ts) and ts[k].text != "}":
        if ts[k].text == "type" and k + 1 < len(ts) and ts[k + 1].text not in (",", "}", "as"):
            k += 1
        name = alias = ts[k].value
        if k + 2 < len(ts) and ts[k + 1].text == "as":
            alias, k = ts[k + 2].value, k + 2
        pairs.append((name, alias))
        k += 1
        if k < len(ts) and ts[k].text == ",":
            k += 1
    return pairs, k + 1


def imports(text: str) -> list[Import]:
    ts, out = tokens(text), []
    for k, t in enumerate(ts):
        if t.text != "import" or t.kind != "name" or t.depth or k and ts[k - 1].text == "." or k + 1 >= len(ts):
            continue
        j, found = k + 1, []
        if ts[j].kind == "string":
            out.append(Import(ts[j].value, "", ""))
            continue
        if ts[j].text == "type" and j + 1 < len(ts) and ts[j + 1].text not in ("from", ","):
            j += 1
        while j < len(ts) and ts[j].text != "from" and ts[j].text != ";":
            if ts[j].text == "{":
                pairs, j = _braces(ts, j)
                found += [(alias, name) for name, alias in pairs]
            elif ts[j].text == "*":
                found.append((ts[j + 2].text if j + 2 < len(ts) else "", "*"))
                j += 3
            else:
                if ts[j].kind == "name":
                    found.append((ts[j].text, "default"))
                j += 1
        if j + 1 < len(ts) and ts[j].text == "from" and ts[j + 1].kind == "string":
            out += [Import(ts[j + 1].value, local, name) for local, name in found]
    return out


def reexports(text: str) -> list[Reexport]:
    ts, out = tokens(text), []
    for k, t in enumerate(ts):
        if t.text != "export" or t.depth or k + 1 >= len(ts):
            continue
        j = k + 1
        if ts[j].text == "type":
            j += 1
        if ts[j].text == "*":
            spaced = j + 2 < len(ts) and ts[j + 1].text == "as"
            at = j + 3 if spaced else j + 1
            if at + 1 < len(ts) and ts[at].text == "from":
                out.append(Reexport(ts[at + 1].value, "namespace" if spaced else "star", ts[j + 2].value if spaced else "*", "*"))
        elif ts[j].text == "{":
            pairs, at = _braces(ts, j)
            if at + 1 < len(ts) and ts[at].text == "from":
                out += [Reexport(ts[at + 1].value, "named", alias, name) for name, alias in pairs]
    return out


def export_aliases(text: str) -> dict[str, str]:
    """Outside name -> declared name of local export lists and default identifiers; equal ones are left out, the first wins."""
    ts, out = tokens(text), {}
    for k, t in enumerate(ts):
        if t.text != "export" or t.depth or k + 1 >= len(ts):
            continue
        if ts[k + 1].text == "{":
            pairs, at = _braces(ts, k + 1)
            if at >= len(ts) or ts[at].text != "from":
                for name, alias in pairs:
                    if name != alias:
                        out.setdefault(alias, name)
        elif ts[k + 1].text == "default" and k + 2 < len(ts) and ts[k + 2].kind == "name":
            name = next((x for x in ts[k + 2 : k + 6] if x.kind == "name" and x.text not in DECLARING and x.text not in MODIFIERS), None)
            name = None if name is not None and name.text in ("extends", "implements") else name
            if name:
                out.setdefault("default", name.text)
    return out


def _pattern_names(ts: list[Token], k: int) -> tuple[list[Token], int]:
    """Names that a destructuring pattern at k binds, and the index after it."""
    open_, depth, names = k, ts[k].depth, []
    k += 1
    while k < len(ts) and not (ts[k].depth == depth and ts[k].text in ("}", "]")):
        t, after = ts[k], ts[k + 1].text if k + 1 < len(ts) else ""
        if t.text in ("{", "["):
            inner, k = _pattern_names(ts, k)
            names += inner
            continue
        if t.kind == "name" and after != ":" and t.depth == ts[open_].depth + 1 and ts[k - 1].text not in ("=", "."):
            names.append(t)
        k += 1
    return names, k + 1


def symbols(text: str) -> list[Symbol]:
    """Top-level declarations in source order."""
    ts = tokens(text)
    top = [k for k, t in enumerate(ts) if t.depth == 0]
    out: list[Symbol] = []
    k = 0
    while k < len(ts):
        t = ts[k]
        if t.depth or t.kind != "name" or t.text not in DECLARING and t.text != "export" and t.text not in MODIFIERS:
            k += 1
            continue
        begin, exported, default = k, False, False
        while k < len(ts) and ts[k].text in MODIFIERS:
            exported |= ts[k].text == "export"
            default |= ts[k].text == "default"
            k += 1
        if k >= len(ts):
            break
        word = ts[k].text
        if word == "const" and k + 1 < len(ts) and ts[k + 1].text == "enum":
            word, k = "enum", k + 1
        if word not in DECLARING or k + 1 >= len(ts) or word in ("type", "namespace", "module") and ts[k + 1].kind not in ("name", "string"):
            if default and ts[k].kind in ("punct", "string", "number", "template"):
                out.append(Symbol("default", "default", True, ts[begin].line, _end_line(ts, k), len(out)))
            k += begin == k
            continue
        kind, j = DECLARING[word], k + 1
        if kind == "variable":
            while j < len(ts):
                if ts[j].text in ("{", "["):
                    names, after = _pattern_names(ts, j)
                else:
                    names, after = [ts[j]], j + 1
                end = _end_line(ts, j)
                out += [Symbol(n.text, kind, exported, n.line, end, len(out) + i) for i, n in enumerate(names) if n.kind == "name"]
                j = after
                while j < len(ts) and not (ts[j].depth == 0 and (ts[j].text in (",", ";") or ts[j].kind == "name" and ts[j].line > ts[j - 1].line and ts[j - 1].text not in ("=", ":", "=>", "extends", "|", "&", "?", "."))):
                    j += 1
                if j >= len(ts) or ts[j].text != ",":
                    break
                j += 1
            k = j
            continue
        if ts[j].text == "*":
            j += 1
        name = ts[j].text if j < len(ts) and ts[j].kind == "name" and ts[j].text not in ("extends", "implements") else "default"
        out.append(Symbol(name, kind, exported, ts[begin].line, _end_line(ts, k), len(out)))
        k = j + 1
    listed = set(export_aliases(text).values()) | {n for k in top if ts[k].text == "export" and k + 1 < len(ts) and ts[k + 1].text == "{" for n, _ in _local_list(ts, k + 1)}
    for s in out:
        s.exported |= s.name in listed
    return out


def _local_list(ts: list[Token], k: int) -> list[tuple[str, str]]:
    pairs, at = _braces(ts, k)
    return [] if at < len(ts) and ts[at].text == "from" else pairs


def _end_line(ts: list[Token], k: int) -> int:
    """Line where a top-level declaration ends: its closing brace, its semicolon, or before the next statement."""
    seen = False
    for j in range(k, len(ts)):
        t = ts[j]
        if t.depth == 0 and t.text == ";":
            return t.line
        if t.depth == 0 and t.text == "}":
            nxt = ts[j + 1] if j + 1 < len(ts) else None
            if nxt is None or nxt.line > t.line or nxt.text == ";":
                return t.line
        if seen and t.depth == 0 and t.kind == "name" and t.line > ts[j - 1].line and (t.text in DECLARING or t.text in ("export", "import")):
            return ts[j - 1].line
        seen = seen or t.line > ts[k].line
    return ts[-1].line


def uses(text: str) -> list[tuple[str, int]]:
    """(name, line) of identifiers that are no declaration and no property after a dot; shorthand properties count."""
    ts, out = tokens(text), []
    for k, t in enumerate(ts):
        if t.kind != "name":
            continue
        before, after = (ts[k - 1].text if k else ""), (ts[k + 1].text if k + 1 < len(ts) else "")
        if before in (".", "?.") or before in DECLARING or t.text in DECLARING or t.text in MODIFIERS:
            continue
        if after == ":" and before in ("{", ","):
            continue
        out.append((t.text, t.line))
    return out


def member_uses(text: str) -> list[tuple[str, str, int]]:
    """(object, member, line) of property accesses on plain names."""
    ts = tokens(text)
    return [
        (a.text, c.text, c.line) for before, a, b, c in zip([None, *ts], ts, ts[1:], ts[2:])
        if a.kind == "name" and b.text in (".", "?.") and c.kind == "name" and (before is None or before.text not in (".", "?."))
    ]


def _cut(text: str, most: int) -> str:
    """On one line, with an ellipsis where it had to be cut."""
    flat = re.sub(r"\s+", " ", text).strip()
    return flat if len(flat) <= most else flat[: most - 1] + "…"


MEMBER_WORDS = frozenset("public static readonly async get set abstract override declare accessor".split())
HIDDEN_WORDS = frozenset(("private", "protected"))


def members(text: str, line: int, end_line: int) -> list[dict]:
    """What a class that stands on these lines shows: methods, accessors and properties, without private ones."""
    ts = [t for t in tokens(text) if line <= t.line <= end_line]
    at = next((k for k, t in enumerate(ts) if t.text == "class"), None)
    if at is None:
        return []
    body = next((k for k in range(at, len(ts)) if ts[k].text == "{" and ts[k].depth == ts[at].depth), None)
    if body is None:
        return []
    depth, out, k = ts[body].depth + 1, [], body + 1
    lines = text.split("\n")
    while k < len(ts) and ts[k].depth >= depth:
        words: set[str] = set()
        begin = k
        while k + 1 < len(ts) and (ts[k].text in MEMBER_WORDS | HIDDEN_WORDS or ts[k].text == "*") and ts[k + 1].text not in ("(", "=", ":", ";", "?", "}"):
            words.add(ts[k].text)
            k += 1
        t = ts[k]
        after = ts[k + 1].text if k + 1 < len(ts) else "}"
        if t.depth == depth and t.kind in ("name", "string") and not t.text.startswith("#") and not words & HIDDEN_WORDS:
            kind = "getter" if "get" in words else "setter" if "set" in words else "constructor" if t.text == "constructor" else "method" if after in ("(", "<") else "property"
            signature = lines[ts[begin].line - 1].split("{")[0] if kind != "property" else re.split(r"=(?!>)|;", lines[ts[begin].line - 1])[0]
            out.append({"name": t.value, "kind": kind, "static": "static" in words, "startLine": ts[begin].line, "signature": _cut(signature, 120)})
        # to the member's end: its semicolon, its body's brace, or a new line after a complete one
        k += 1
        while k < len(ts) and ts[k].depth >= depth:
            end = ts[k].depth == depth and ts[k].text in (";", "}")
            k += 1
            if end or k < len(ts) and ts[k].depth == depth and ts[k].line > ts[k - 1].line and ts[k - 1].text not in ("=", ":", "=>", ",", "|", "&", "(", "<") and ts[k].text not in ("{", "}", "=", ":", "|", "&", ".", "?."):
                break
    return out


def _capped(rows: list, limit: int) -> dict:
    return {"count": len(rows), "list": rows[:limit], "truncated": len(rows) > limit}


def outline(text: str) -> list[dict]:
    """Declarations with their first line as a signature, their range and the first line of the comment above."""
    lines = text.split("\n")
    notes = {t.line + t.text.count("\n"): t for t in tokens(text, comments=True) if t.kind == "comment"}
    out = []
    for s in symbols(text):
        note = notes.get(s.line - 1)
        doc = ""
        if note is not None:
            bare = [re.sub(r"^\s*(/\*+|\*/|\*+|//+)?\s*", "", x).replace("*/", "").strip() for x in note.text.split("\n")]
            doc = next((x for x in bare if x), "")
        out.append({"name": s.name, "kind": s.kind, "exported": s.exported, "signature": _cut(lines[s.line - 1], 200), "line": s.line, "end_line": s.end_line, "doc": _cut(doc, 100)})
    return out


def unbalanced(text: str) -> int:
    """Brackets that close nothing or stay open, literals that do not end: how far a text is from being read whole."""
    pairs, held, n = {")": "(", "]": "[", "}": "{"}, [], 0
    for t in tokens(text):
        if t.kind == "punct" and t.text in "([{":
            held.append(t.text)
        elif t.kind == "punct" and t.text in pairs:
            if held and held[-1] == pairs[t.text]:
                held.pop()
            else:
                n += 1
        elif t.kind == "string" and (len(t.text) < 2 or t.text[-1] != t.text[0]) or t.kind == "template" and not t.text.endswith("`"):
            n += 1
    return n + len(held)


def outline_payload(path: str, text: str | None, limit: int = 100) -> dict:
    """A file's skeleton: lines, imports, declarations with the members of classes; each list capped with its whole count."""
    text = text or ""
    rows = [{**{k: o[k] for k in ("name", "kind", "exported", "signature", "doc")}, "startLine": o["line"], "endLine": o["end_line"]} for o in outline(text)]
    for r in rows:
        if r["kind"] == "class":
            r["members"] = _capped(members(text, r["startLine"], r["endLine"]), limit)
    taken = {}
    for x in reexports(text):
        taken.setdefault(x.specifier, []).append("*" if x.kind == "star" else f"* as {x.exported}" if x.kind == "namespace" else x.exported if x.exported == x.declared else f"{x.declared} as {x.exported}")
    places = {t.value: t.line for t in tokens(text) if t.kind == "string"}
    rows += [{"name": s, "kind": "reexport", "exported": True, "signature": _cut(f"{', '.join(names)} from {s}", 200), "doc": "", "startLine": places.get(s, 1), "endLine": places.get(s, 1)} for s, names in taken.items()]
    rows.sort(key=lambda r: r["startLine"])
    sources = [s for s in dict.fromkeys(specifiers(text)) if s not in taken]
    return {"kind": "outline", "path": path, "lines": len(text.split("\n")) if text else 0, "parseErrors": unbalanced(text), "imports": _capped(sources, limit), "declarations": _capped(rows, limit)}


#: Lines from which a symbol is long.
LONG = 200
NEAR = 8


def show_payload(ref: str, files: list[str], read: Callable[[str], str | None], context: int = 0) -> dict:
    """The source of the one declaration that a reference (name, path#name or a symbol id) means, or the candidates.

    A path may be a suffix. Declarations of a name that follow each other closely
    in a file, as overloads do, are one.
    """
    bare = re.sub(r"^sym:|~\d+$", "", ref or "")
    path, _, name = bare.rpartition("#")
    if not name:
        return {"kind": "not-found", "symbol": ref, "error": "no name", "candidates": []}
    exact = [f for f in files if f == path]
    among = files if not path else exact or [f for f in files if f.endswith("/" + path)] or [path]
    hits, near, low = [], [], name.lower()
    for f in among:
        text = read(f)
        if text is None:
            continue
        for s in symbols(text):
            if s.name == name:
                last = hits[-1] if hits else None
                if last and last["path"] == f and s.line - last["end"] <= 2:
                    last["end"] = max(last["end"], s.end_line)
                else:
                    hits.append({"path": f, "kind": s.kind, "line": s.line, "end": s.end_line, "text": text})
            elif len(near) < NEAR and (low in s.name.lower() or s.name.lower() in low):
                near.append({"name": s.name, "path": f, "line": s.line, "kind": s.kind})
    if not hits:
        return {"kind": "not-found", "symbol": ref, "name": name, "candidates": near}
    if len(hits) > 1:
        return {"kind": "ambiguous", "symbol": ref, "name": name, "total": len(hits), "candidates": [{"id": f"sym:{h['path']}#{name}", "path": h["path"], "line": h["line"], "kind": h["kind"]} for h in hits]}
    h = hits[0]
    lines = h["text"].split("\n")
    first = h["line"]
    while first > 1 and re.match(r"\s*(/\*|\*|//)", lines[first - 2]):  # the comment above belongs to it
        first -= 1
    first, last = max(1, first - max(0, context)), min(len(lines), h["end"] + max(0, context))
    return {
        "kind": "symbol", "symbol": ref, "id": f"sym:{h['path']}#{name}", "path": h["path"], "name": name, "symbolKind": h["kind"], "startLine": first, "endLine": last, "declarationLine": h["line"], "lines": last - first + 1, "context": max(0, context),
        "large": last - first + 1 > LONG, "source": "\n".join(lines[first - 1 : last]),
    }


def show(text: str, name: str, context: int = 0) -> list[dict]:
    """Every declaration of a name with its lines."""
    lines = text.split("\n")
    return [{"line": s.line, "end_line": s.end_line, "text": "\n".join(lines[max(0, s.line - 1 - context) : s.end_line + context]), "large": s.end_line - s.line >= 200} for s in symbols(text) if s.name == name]
