"""HTML extraction: hostile pages, pages made around known text, and time linear in nesting."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import host_paths
from quarry.llm.host_paths import extract

LONG = "long enough running text of the article that goes on for a while, " * 3
TEXT = " ".join(LONG.split())


@pytest.mark.parametrize("names", ["content no-sidebar", "post has-comments", "page header-fixed", "content-tags", "nav-open wrap", "widget", "hfeed site comments-open"])
def test_wrappers_keep_their_text(names):
    page = f"<html><body><nav>menu</nav><div class='{names}'><article><h1>Title</h1><p>{LONG}</p></article></div><div class='cookie-notice'>We use cookies</div><footer>f</footer></body></html>"
    assert extract(page) == f"Title\n{TEXT}"
    assert extract(page.replace("class", "id", 1)) == f"Title\n{TEXT}"
    plain = f"<body><nav>menu</nav><div class='{names}'><p>{LONG}</p><p>{LONG}</p></div><aside>x</aside></body>"
    assert extract(plain) == f"{TEXT}\n{TEXT}"


@pytest.mark.parametrize("names", ["comments", "comment-list", "reader-comments", "sidebar", "site-footer", "main-nav", "cookie-notice", "ad", "ad-slot", "newsletter-signup"])
def test_named_parts_go(names):
    page = f"<body><div class=main><p>{LONG}</p><div class='{names}'>{LONG[:60]}</div></div></body>"
    assert extract(page) == TEXT
    assert extract(f"<div class=a><p>{LONG}</p></div><div class=comments>{LONG * 9}</div>") == TEXT


def test_comments_and_embedded_elements():
    assert extract("<article><p>a<!-->b c<!--->d<!-- x --!>e &amp;amp; f<svg><title>q</title><path d='x'/><text>no</text></svg>g<script>1</script>h</p></article>") == "ab cde &amp; fgh"
    assert extract("<p>one<button><div>no</div></button> two<select><option>x</select> three</p>") == "one two three"
    assert extract("<p data-x='class=sidebar'>kept</p><p title=\"a > b\">too</p><p class=it's>and</p><a href=\"x y>z</a>") == "kept\ntoo\nand\nz"
    assert extract("<p>a &am<b></b>p; b</p>") == "a &amp; b"


def test_deep_wrappers_are_told_apart():
    """Sixteen nested wrappers with long classes, and a column beside the article below them."""
    wrap = "".join(f"<div class='wrapper-of-the-page level-{'abcdefghijklmnop'[k]} some-utility-class'>" for k in range(16))
    page = f"<body>{wrap}<div class='col-text'><p>{LONG}</p><p>{LONG}</p></div><div class='col-other'><p>beside it</p></div>{'</div>' * 16}</body>"
    assert extract(page) == f"{TEXT}\n{TEXT}"
    assert extract(page, host_paths.Page(page).best()[0]) == f"{TEXT}\n{TEXT}"


def test_pages_without_main_text():
    for page in (None, "", "  ", "<nav>only a menu</nav>", "<div class=sidebar>side</div>", "<div class=cookie-notice>We use cookies</div>", "<script>x", "<!-- open", "<p", "<footer><p>" + LONG + "</p></footer>"):
        assert extract(page) == ""


def test_time_is_linear():
    def seconds(n):
        best = 9.0
        for _ in range(2):
            t = time.perf_counter()
            for page in ("<i>" * n + "</b>" * n, "<i>" * n + "<h2>x" * n, "<div>" * n + "x" + "</p>" * n, "<a \"'='" * n + '<p ="' * n, "<div class='a b-c'>" * n + TEXT, "<!-" * n + "<" * n + "</" * n + "<p x=\"'" * n, "<ul>" * n + "<li>x" * n):
                extract(page)
            best = min(best, time.perf_counter() - t)
        return best

    assert seconds(24_000) < 12 * seconds(4_000) + 1


WORDS = st.lists(st.sampled_from("alpha beta gamma é &amp; &lt;i&gt; delta 1 < 2 naïve".split(" ")), min_size=1, max_size=12).map(" ".join)
NOISE = st.sampled_from(
    ["<nav><ul><li><a href=x>one</a><li>two</ul></nav>", "<aside><p>beside</p></aside>", "<div class='ad'>buy</div>", "<div id=cookie-notice>cookies</div>", "<script>var a = '<p>no</p>';</script>", "<style>p{}</style>", "<!-- <p>no</p> -->", "<!-->", "</section>", "</b>", "<form><input><p>mail</p></form>", "<section class='comments'><article><p>nice</p></article></section>", "<noscript><p>on</p></noscript>", ""]
)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["p", "h2", "li", "pre", "blockquote"]), WORDS, NOISE), min_size=1, max_size=8), st.integers(0, 5), st.booleans(), NOISE, NOISE)
def test_known_text_comes_back(parts, depth, closed, before, after):
    """The article's blocks, whatever stands between, before and around them."""
    inner = "".join(f"<{t}>{w.replace(' 1 < 2', ' 1 &lt; 2')}" + (f"</{t}>" if closed or t in ("h2", "pre", "blockquote") else "") + n for t, w, n in parts)
    page = f"<html><body>{before}{'<div class=w>' * depth}<article><h1>Head</h1>{inner}</article>{'</div>' * depth}{after}<footer>end</footer></body></html>"
    from html import unescape

    assert extract(page) == "\n".join(["Head", *(unescape(w) for _, w, _ in parts)])


def test_rows_of_any_kind(spark):
    rows = [(None, None, None, "x", 1, "p"), (1, "http://a/", None, "x", 1, "p"), (2, "http://a/", f"<article><p>{LONG}", "x", 1, "p"), (2, "http://a/", f"<article><p>{LONG}", "x", 1, "p"), (3, "bad url", "<p>" + "word " * 400_000, "x", 1, "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, salt int, path string")
    got = sorted((tuple(r) for r in host_paths.main_text(pages).collect()), key=repr)
    long = ("word " * 400_000).strip()
    assert got == sorted([(None, None, "", 0), (1, "http://a/", "", 0), (2, "http://a/", TEXT, len(TEXT)), (2, "http://a/", TEXT, len(TEXT)), (3, "bad url", long, len(long))], key=repr)
