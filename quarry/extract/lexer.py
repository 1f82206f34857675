"""Tokens of JavaScript and TypeScript, JSX included as far as names go.

One regular expression finds the next token; only two things need state: whether
a slash begins a regular expression, and how deep template literals nest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)|(?P<name>[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*|\#[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<punct>=>|\.\.\.|\?\.|[{}()\[\];,<>=:.?!&|+\-*%^~@/`\\])|(?P<other>.)""",
    re.S | re.X,
)
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*", re.S)
#: After these a slash divides.
VALUE_END = frozenset((")", "]", "}"))
KEYWORDS_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new do else instanceof yield await".split())


@dataclass(frozen=True)
class Token:
    kind: str  # name, string, template, number, punct, regex, comment, other
    text: str
    line: int
    depth: int  # of brackets before the token
    start: int
    end: int

    @property
    def value(self) -> str:
        """A string's contents, escapes other than of quotes left as they are."""
        if self.kind == "string":
            return re.sub(r"\\(['\"\\])", r"\1", self.text[1:-1])
        return self.text[1:-1] if self.kind == "template" else self.text


def tokens(text: str, comments: bool = False) -> list[Token]:
    out: list[Token] = []
    at, line, depth, last = 0, 1, 0, None
    while at < len(text):
        m = TOKEN.match(text, at)
        kind, value = m.lastgroup, m[0]
        if kind == "punct" and value == "/" and not (last and (last.kind in ("number", "string", "template", "regex") or last.text in VALUE_END or last.kind == "name" and last.text not in KEYWORDS_BEFORE_REGEX)):
            r = REGEX.match(text, at)
            if r:
                kind, value = "regex", r[0]
        if kind == "punct" and value == "`":
            kind, value = "template", text[at : template_end(text, at)]
        if kind != "space" and (comments or kind != "comment"):
            if kind == "punct" and value in ")]}":
                depth = max(0, depth - 1)
            token = Token(kind, value, line, depth, at, at + len(value))
            out.append(token)
            if kind == "punct" and value in "([{":
                depth += 1
            if kind != "comment":
                last = token
        line += value.count("\n")
        at += len(value)
    return out


def template_end(text: str, at: int) -> int:
    """Just after a template literal; substitutions may hold templates again."""
    k = at + 1
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 2
        elif c == "`":
            return k + 1
        elif text.startswith("${", k):
            level, k = 1, k + 2
            while k < len(text) and level:
                if text[k] == "`":
                    k = template_end(text, k)
                    continue
                level += (text[k] == "{") - (text[k] == "}")
                k += 1
        else:
            k += 1
    return len(text)
