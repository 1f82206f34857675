"""HTML extraction by consensus host paths.

First pass: every page's containers are scored by the running text in them, and
the page votes for the generalised path (tags with classes, digits levelled) of
its best one. Spark adds the votes up per host and path, so a host of a third of
all pages is a few partial sums per task. Second pass: each page is extracted
again with its host's winning path; a page without it uses its own best path.

What is no main text is told by tags, which always count, and by class names,
ids and roles, which are weighed: a name that is only part of a longer one
("header-fixed") never hides what holds most of a page's running text.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ragged import groups
from ._shared import release, written

#: Hosts up to which the winning paths are sent to every executor; beyond it they are joined in by a salted shuffle.
BROADCAST_HOSTS = 20_000
SALTS = 64
#: Longer paths stand as a digest, so that each container keeps a path of its own.
PATH_LENGTH = 400
#: Characters outside of links that make a block running text.
RUNNING = 80
#: Bytes of html that are parsed before their texts are given out.
GROUP_BYTES = 4 << 20

# Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Of these nothing is kept; they stand within a line and do not end it.
EMBEDDED = frozenset("script style noscript template svg math iframe object button select canvas audio video map textarea noembed".split())
CONTAINER = frozenset("article main section div body html td center details blockquote".split())
OUTSIDE = frozenset("nav footer aside head title menu dialog".split()) | EMBEDDED
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar "
    "notice notices cookie cookies consent gdpr popup modal overlay alert comment comments reply replies respond discussion disqus share sharing social related recommended newsletter subscribe subscription "
    "signup login widget toolbar pagination pager tags skip copyright".split()
)
COMMENTS = frozenset("comment comments reply replies respond discussion disqus".split())
#: With these a name tells of a state of what it stands on: no-sidebar, has-comments, comments-open.
STATES = frozenset("no not has have with without is in on off open opened closed enabled disabled fixed sticky static visible below above".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu alert dialog".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol dl table select".split())

# a quote counts only behind "=", and only if it is closed; nothing is tried twice
TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)[^>]*(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
TELLING = re.compile(r"class|id|role|hidden|style|href", re.I)
DIGITS = re.compile(r"\d+")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")

# How surely an element is no main text.
MAYBE, NAMED, SURE = 1, 2, 3


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


@functools.lru_cache(maxsize=20_000)
def name_says(token: str) -> int:
    """Of one class or id: NAMED if it is a listed name, or about comments; MAYBE if a part of it is; else nothing."""
    if token.lower() in NAMES:
        return NAMED
    parts = [p.lower() for p in PARTS.findall(token)]
    listed = [p for p in parts if p in NAMES]
    if not listed:
        return 0
    if any(p in STATES for p in parts):
        return 0 if parts[0] in STATES else MAYBE
    return NAMED if any(p in COMMENTS for p in listed) else MAYBE


def _attributes(text: str) -> tuple[str, int, bool, bool]:
    """The classes that stand in a path, how surely names say that this is no main text, whether the role is main, whether there is a link."""
    if not text or not TELLING.search(text):
        return "", 0, False, False
    classes, says, main, link = "", 0, False, False
    for name, *values in ATTRIBUTE.findall(text):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name == "class":
            tokens = value.split()
            says = max([says, *map(name_says, tokens)])
            classes = ".".join(sorted(DIGITS.sub("#", value).lower().split()))
        elif name == "id":
            says = max([says, *map(name_says, value.split())])
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and UNSEEN.search(value):
            says = NAMED
        elif name == "role":
            says = NAMED if value.lower() in ROLES else says
            main |= value.lower() in ("main", "article")
        elif name == "href":
            link = True
    return classes, says, main, link


class Element:
    """An open element; containers stay behind as the tree that blocks point to."""

    __slots__ = ("tag", "path", "up", "says", "article", "headed", "live", "solid", "number")

    def __init__(self, tag: str, path: str, up: Element | None, says: int, article: bool):
        self.tag, self.path, self.up, self.says, self.article = tag, path, up, says, article
        self.headed = self.solid = False
        self.live = 0


class Page:
    """The containers of a page in order, and its blocks: container, text, characters in links."""

    def __init__(self, html: str | None):
        self.boxes: list[Element] = []
        self.blocks: list[tuple[Element, str, int]] = []
        self._parse(html or "")
        self._weigh()

    def _box(self, tag: str, path: str, up: Element | None, says: int, article: bool) -> Element:
        e = Element(tag, path, up, says, article)
        e.number = len(self.boxes)
        self.boxes.append(e)
        return e

    def _parse(self, html: str) -> None:
        # per open element: tag, box, whether it counts as a link; `open_at` has the places of each tag in the stack
        stack: list[list] = [["", self._box("", "", None, 0, False), False]]
        open_at: dict[str, list[int]] = defaultdict(list)
        containers = [0]
        text: list[str] = []
        owner, linked, links = stack[0][1], 0, 0
        search, blocks = TAG.search, self.blocks

        def flush() -> None:
            nonlocal linked
            if text:
                joined = " ".join("".join(text).split())
                if joined:
                    blocks.append((owner, joined, min(linked, len(joined))))
                text.clear()
                linked = 0

        def pop_to(k: int) -> None:
            nonlocal links
            for tag, _, link in stack[k:]:
                if tag:
                    open_at[tag].pop()
                links -= link
            del stack[k:]
            while containers[-1] >= k:
                containers.pop()

        def last(tags) -> int:
            return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

        at, n = 0, len(html)
        while at < n:
            m = search(html, at)
            begin = m.start() if m else n
            box = stack[-1][1]
            if begin > at and box.says != SURE:
                piece = html[at:begin]
                if "&" in piece:
                    piece = unescape(piece)
                if not text:
                    owner = box
                text.append(piece)
                if links:
                    linked += len(piece.strip())
            if not m:
                break
            at = m.end()
            tag = m[2] or m[5]  # the second form is cut off by the page's end
            if not tag:
                continue
            tag = tag.lower()
            within = tag in INLINE or tag in EMBEDDED
            if m[1] or m[4]:
                k = last((tag,))
                if not within and (box.says != SURE or 0 < k < containers[-1]):
                    flush()
                if k and within and k < containers[-1]:  # it ended inside of a later container, which stays open
                    open_at[tag].pop()
                    links -= stack[k][2]
                    stack[k][0], stack[k][2] = "", False
                elif k:
                    pop_to(k)
                continue
            if not within and box.says != SURE:
                flush()
            if tag == "br" and text:
                text.append(" ")
            if tag in VOID:
                continue
            if tag in RAW:
                end = _raw_end(tag).search(html, at)
                at = end.end() if end else n
                continue
            if not within:
                k = last(("p",))
                if k > containers[-1]:  # a block ends an open paragraph
                    pop_to(k)
            if tag in CLOSES:
                k = last(CLOSES[tag])
                if k > last(LISTS):
                    pop_to(k)
            box = stack[-1][1]
            classes, says, main, link = _attributes(m[3] or "")
            if tag == "a":
                k = last(("a",))
                if k > containers[-1]:
                    pop_to(k)
            if tag in ("html", "body", "main") or main:  # such names on the whole page say nothing
                says = 0
            elif tag == "article" and not box.article:  # nor do they on an article, unless it is a comment
                says = says if any(t in COMMENTS for t in classes.split(".")) else 0
            elif tag == "form":
                says = max(says, MAYBE)
            if tag in OUTSIDE or tag == "header" and not box.article:
                says = SURE
            if tag == "h1":
                box.headed = True
            if tag in CONTAINER or says and not (tag in INLINE and says == MAYBE) or main:
                step = "main" if main else tag
                path = f"{box.path}>{step}" + (f".{classes}" if classes else "")
                if len(path) > PATH_LENGTH:
                    path = "~" + blake2b(path.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
                says = max(says, SURE) if box.says == SURE else says
                box = self._box(step, path, box, says, box.article or tag == "article")
                if tag == "main" or main:
                    box.headed = True
                if not within or says == SURE:
                    containers.append(len(stack))
            open_at[tag].append(len(stack))
            link = link and tag == "a"
            links += link
            stack.append([tag, box, link])
        flush()

    def _weigh(self) -> None:
        """Settle what is outside, and keep the other blocks."""
        boxes = self.boxes
        for e in reversed(boxes):  # a named element with the page's heading or main part is not sure to be beside it
            if e.headed and e.up and e.up.says < SURE:
                e.up.headed = True
            if e.headed and e.says == NAMED:
                e.says = MAYBE
        for least in (MAYBE, NAMED, SURE):
            kept = self._kept(least)
            if kept:
                break
        self.blocks = kept

    def _kept(self, least: int) -> list[tuple[Element, str, int]]:
        """Blocks outside of nothing that is at least so surely no main text; a lower certainty only hides what holds the lesser part of the running text."""
        boxes = self.boxes
        for e in boxes:
            e.live, e.solid = 0, e.headed
        hidden = [False] * len(boxes)
        for e in boxes:
            hidden[e.number] = bool(e.up and hidden[e.up.number]) or e.says >= max(least, NAMED)
        total, solid = 0, False
        for e, text, linked in self.blocks:
            if not hidden[e.number]:
                e.live += len(text) - linked
                e.solid |= len(text) - linked >= RUNNING
                total += len(text) - linked
        for e in reversed(boxes):
            solid |= e.solid and not hidden[e.number]
            if e.up:
                e.up.live += e.live
                e.up.solid |= e.solid
        if least > MAYBE and not solid:  # a page of nothing but names and menus has no main text
            return []
        for e in boxes:
            weak = e.says == MAYBE and least == MAYBE and not (e.solid and 2 * e.live > total)
            hidden[e.number] = bool(e.up and hidden[e.up.number]) or e.says >= max(least, NAMED) or weak
        return [b for b in self.blocks if not hidden[b[0].number]]

    def best(self) -> tuple[str, float]:
        """The page's vote: each block counts its text outside of links for its container and half of it for the next one out."""
        scores: dict[str, float] = defaultdict(float)
        first: dict[str, Element] = {}
        for e, text, linked in self.blocks:
            s = max(0, len(text) - 2 * linked) * (1.0 if len(text) >= RUNNING else 0.5)
            scores[e.path] += s
            first.setdefault(e.path, e)
            if e.up and e.up.path:
                scores[e.up.path] += 0.5 * s
                first.setdefault(e.up.path, e.up)
        if not scores:
            return "", 0.0
        path = min(scores, key=lambda p: (-scores[p], p))
        return promoted(first[path]).path, scores[path]

    def within(self, path: str) -> list[str]:
        """Texts of the containers of a path and of all in them."""
        inside = [False] * len(self.boxes)
        for e in self.boxes:
            inside[e.number] = e.path == path or bool(e.up and inside[e.up.number])
        return [t for e, t, _ in self.blocks if inside[e.number]]


@functools.lru_cache(maxsize=None)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


def promoted(box: Element) -> Element:
    """The outermost article, else main element, that a container is in: text beside the best container belongs to it."""
    found: dict[str, Element] = {}
    e: Element | None = box
    while e:
        found[e.tag] = e
        e = e.up
    return found.get("article") or found.get("main") or box


def extract(html: str | None, path: str | None = None) -> str:
    """The main text by a path, or by the page's own best one if the page has nothing there."""
    page = Page(html)
    within = page.within(path) if path else []
    if not within:
        within = page.within(page.best()[0])
    return "\n".join(within)


def host_votes(pages: DataFrame) -> DataFrame:
    """host, path: the winner of each host, by pages, then score, then path."""
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.int64()), ("score", pa.int64())])

    def run(batches):
        release()
        for batch in batches:
            votes: dict[tuple[str, str], list] = {}
            for begin, end in groups(batch.column(1), GROUP_BYTES):
                part = batch.slice(begin, end - begin)
                for url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    path, score = Page(html).best()
                    if path:
                        v = votes.setdefault((host_of(url), path), [0, 0.0])
                        v[0] += 1
                        v[1] += score
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([k[0] for k in votes], [k[1] for k in votes], [v[0] for v in votes.values()], [int(v[1]) for v in votes.values()]), schema)], schema=schema)

    votes = pages.select("url", "html").mapInArrow(run, "host string, path string, votes long, score long")
    summed = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    return summed.groupBy("host").agg(F.max(F.struct("votes", "score", "path")).alias("w")).select("host", F.col("w.path").alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty html, and a page without main text, give the empty text; a
    null url is a host of its own name (the empty one); a null page_id stays null;
    repeated rows each give a row and a vote; an empty table gives none; further
    columns are not read, whatever their names. Nesting and length have no bound.
    """
    winners = written(host_votes(pages), "host-paths")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host().alias("on"))
    if winners.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(winners), rows["on"] == winners["host"], "left")
    else:
        spread = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("dealt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, (salted["on"] == spread["host"]) & (salted["dealt"] == spread["salt"]), "left")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        release()
        for batch in batches:
            for begin, end in groups(batch.column(2), GROUP_BYTES):
                part = batch.slice(begin, end - begin)
                texts = [extract(h, p) for h, p in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return joined.select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def _host():
    """`host_of` as a column."""
    scheme = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(scheme)
