"""Main text of pages: worked cases, odd markup, and templates by counting."""

from __future__ import annotations

import random
import time
from collections import Counter

import pytest

from addrloom.llm import html

CASES = [
    ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("<article><h1>T</h1><p>a\n  b&nbsp;c &amp;lt; &copy;</p></article>", "T\na b c &lt; ©"),
    ("<body><nav>n</nav><article><p><b>x<br><p>y</p></article><footer>f</footer>", "x\ny"),
    ("<header>h</header><main>m<aside>s</aside><header><h1>t</h1></header></main>", "m\nt"),
    ("<div class='cookie-notice'>c</div><div>keep</div><form>f<input>g</form>", "keep"),
    ("<div class=with-sidebar><div class='sidebar'>s</div><article>a</article></div>", "a"),
    ("<article>a<div class=comments><article>c</article></div></article>", "a"),
    ("<article class=post><div class='entry-header'>t</div>b</article><article class=comment>c</article>", "t\nb"),
    ("<script>var a='<p>x</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes", "yes"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("a < b and b <c", "a < b and b"), ("<p title='a>b'>x</p>", "x"), ("<p>1</div>2</p>3", "12\n3"), ("<P>Up</P><BR/>x", "Up\nx"),
    ("x<br>y <i>z</i>w", "x y zw"), ("<div hidden>h</div><span>a</span><span>b</span>", "ab"), ("<script>never closed <p>x", ""),
    ("<![CDATA[x]]><?php y ?><!doctype html>z", "z"), ("<article></article>", ""), ("<p>&#x41;&#66;&notanentity;", "AB¬anentity;"),
]


@pytest.mark.parametrize("source, want", CASES)
def test_main_text(source, want):
    assert html.main_text(source) == want


def test_linear_and_deep():
    start = time.time()
    for source in ("<div>" * 20000 + "x", "<" * 50000, "<a " * 20000, "<p>" * 20000 + "x", "<b a='" * 20000, "<li>" * 20000, "<!--" * 20000, "&" * 50000, "</div>" * 20000, "<script>" * 5000):
        html.main_text(source, frozenset([1]))
        html.candidates(source)
    assert time.time() - start < 60


def test_templates_are_counted_per_host(spark):
    promo, other = "<div class=x><p>Join our club today</p></div>", "<section><p>Also here</p></section>"
    page = lambda i, extra="": f"<html><body>{promo}<div><p>story {i}</p><p>All rights reserved.</p></div>{extra}</body></html>"
    rows = [(i, f"https://User@A.example:80/{i}", page(i)) for i in range(6)]
    rows += [(10 + i, f"http://b.example/{i}", page(i)) for i in range(3)]
    rows += [(20 + i, f"http://c.example/{i}", f"<article>{other}<p>same line</p><p>text {i}</p></article>") for i in range(5)]
    rows += [(30, None, page(0)), (31, "http://a.example/x", None), (32, "odd", ""), (None, "http://a.example/y", promo)]
    df = spark.createDataFrame([(a, b, c, "t", "h") for a, b, c in rows], "page_id long, url string, html string, text string, host string")
    out = html.extract(df, ("page_id", "url", "text")).select("document.page_id", "document.text", html.F.col("text").alias("said")).collect()
    got = {r["page_id"]: r["said"] for r in out}
    assert len(out) == len(rows) and out[0]["text"] == "t"
    # the promotion and the repeated block go on the host where they are common, outside of articles
    assert got[3] == "story 3" and got[None] == ""
    # too few pages, no host
    assert got[11] == got[30].replace("story 0", "story 1") == "Join our club today\nstory 1\nAll rights reserved."
    # inside an article only containers are template
    assert got[22] == "same line\ntext 2"
    assert got[31] == "" and got[32] == ""
    assert html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<body><div><p>The whole story</p><p>and its end</p></div></body>", "<article><h1>T</h1><section><p>The whole story</p></section><div>and its end</div></article>"])
def test_copies_prove_no_template(spark, page):
    menu = "<div><p>Our shops</p></div>"
    rows = [(i, f"http://a.example/{i}", page + menu) for i in range(5)] + [(10 + i, f"http://a.example/{i}", f"<p>page {i}</p>{menu}") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).select("document.page_id", "text").collect()}
    for i in range(5):
        assert "The whole story" in got[i] and "and its end" in got[i] and "shops" not in got[i]
    assert got[10] == "page 0"


@pytest.mark.parametrize("source, want", [
    ("<article><section id='discussion'><h2 id='related-work'>Related</h2><p>a</p></section></article>", "Related\na"),
    ("<article><h2 id='search' class='share'>Search</h2><div class='notice'>b</div><ul id='comments'><li>c</ul></article>", "Search\nb\nc"),
    ("<article>a<div class='share'>s</div><div class='comments'>c</div></article>", "a"),
    ("<body><form id='aspnetForm'><input name=v><div>x</div><main><p>m</p><button>b</button><select><option>o</select></main></form></body>", "m"),
    ("<form role='form' class='search-form'><article>a</article></form><form>f</form>", "a"), ("<form>f</form>", ""),
])
def test_article_sections_and_forms_around(source, want):
    assert html.main_text(source) == want


@pytest.mark.parametrize("source, want", [
    ("<article><p>a</p><div class='share-price'>12.5</div><section class='ad-hoc-methods'><p>m</p></section></article>", "a\n12.5\nm"),
    ("<article><div class='social-history'>s</div><section class='recommended-dosage'>d</section><figure class='widget'>f</figure></article>", "s\nd\nf"),
    ("<body><p class='notice-period'>n</p><div class='site-footer'>f</div><div class='cookie_notice'>c</div></body>", "n"),
    ("<article><div class='related-posts'><a href=x>one</a> <a href=y>two</a></div><p>a</p></article>", "a"),
    ("<article><div class='widget'><p>A whole paragraph that the author wrote, about a widget.</p></div></article>", "A whole paragraph that the author wrote, about a widget."),
    ("<article><p>a</p><div class='comments'><p>I liked this very much, and said so at some length.</p></div></article>", "a"),
    ("<div class='comment-list'><p>c</p></div><p>a</p>", "a"),
])
def test_names_need_a_second_sign(source, want):
    assert html.main_text(source) == want


def plain_templates(rows):
    """Counted in plain Python: subtrees of the different pages of each host."""
    pages = {}
    for url, source in rows:
        content, hashes = html.candidates(source)
        pages.setdefault((url.split("/")[2], content), set()).update(hashes)
    out = {}
    for host in {h for h, _ in pages}:
        own = [s for (h, _), s in pages.items() if h == host]
        counts = Counter(x for s in own for x in s)
        out[host] = {x for x, n in counts.items() if n >= html.MANY_PAGES or n >= max(html.MIN_PAGES, html.SHARE * len(own))}
    return {h: s for h, s in out.items() if s}


def test_templates_against_counting(spark):
    """Random sites: the same subtrees, and blocks that no rule knows go by being counted alone."""
    rng, rows, told = random.Random(4), [], {}
    for site in range(6):
        blocks = [f"<div><b>block {site} {k}</b> of words</div>" for k in range(12)]
        for page in range(rng.choice([3, 8, 30, 60])):
            some = rng.sample(blocks, 3)
            body = f"<body>{some[0]}<div><p>story {site} {page}</p></div>{some[1]}{some[2]}</body>"
            rows += [(f"http://s{site}.example/{page}", body)] * (4 if page == 1 else 1)
    df = spark.createDataFrame(rows, "url string, html string").repartition(5)
    want = plain_templates(rows)
    assert {r["host"]: set(r["hashes"]) for r in html.templates(df).collect()} == want
    assert any(len(s) == 24 for s in want.values())  # a third or a tenth of a large site's pages is enough
    for rules in (True, False):
        for r in html.extract(df, ("url",), rules=rules).select("document.url", "text").collect():
            host, page = r["url"].split("/")[2:]
            hashes = frozenset(want.get(host, ()))
            assert r["text"] == html.main_text(dict(rows)[r["url"]], hashes, rules)
            if len(hashes) == 24:
                assert r["text"] == f"story {host[1]} {page}"


def test_counting_on_the_given_pages(spark):
    """The given menus and footers differ from page to page of a host, so counting alone reaches some pages only."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    size = lambda **o: {r["page_id"]: r["n"] for r in html.extract(pages, rules=False, **o).selectExpr("document.page_id", "length(text) as n").collect()}
    counted, nothing = size(), size(min_pages=10**6, many_pages=10**6)
    assert len(counted) == 2500 and all(counted[i] <= nothing[i] for i in counted)
    assert sum(counted[i] < nothing[i] for i in counted) >= 200
