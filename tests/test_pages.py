from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from leadflow.operators import extract, pages
from leadflow.operators.pages import _text_by_parser

HTML = {
    "<html><body><nav>menu</nav><p>Hello <b>big</b> world</p><script>var a='<p>no</p>';</script></body></html>": "Hello\nbig\nworld",
    "<body><article>side</article><main> Main  text <!-- note --></main></body>": "Main text",
    "<body><div>x</div><article>one</article><article>two</article></body>": "one",
    "<p>Tom &amp; Jerry &lt;3 &copy; &middot;</p>": "Tom & Jerry <3 © ·",
    "<p>a &eacute; &#233; b</p>": "a é é b",
    "<body><div title=\"a>b\">quoted</div></body>": "quoted",
    "<body><header>h<header>inner</header>still</header>text</body>": "text",
    "<body><article>a<article>b</article>c</article>d</body>": "a\nb\nc",
    "<body>a &nbsp; <footer>f</footer>  <svg><text>s</text></svg>b</body>": "a\nb",
    "plain words": "plain words",
    "<body>1 < 2 and 3 > 2</body>": "1 < 2 and 3 > 2",
    "": "",
    "<body>a\n\n\n\nb\t\t c</body>": "a\n\nb c",
    "<HTML><BODY><Nav>n</NAV>Upper</BODY></HTML>": "Upper",
}


def test_page_text(spark):
    df = spark.createDataFrame([(h,) for h in HTML], "html string")
    got = {r.html: r.text for r in pages.page_text(df).collect()}
    assert got == HTML


def test_page_text_limit_and_null(spark):
    df = spark.createDataFrame([("<body>" + "x" * 9000 + "</body>",), (None,)], "html string")
    assert [len(r.text) for r in pages.page_text(df, limit=8000).collect()] == [8000, 0]
    assert [len(r.text) for r in pages.page_text(df).collect()] == [9000, 0]


def test_both_readers_agree_on_given_pages(spark):
    df = pages.page_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    for r in df.select("html", "text").collect():
        assert r.text == _text_by_parser(r.html, None)


HREFS = ["/about", "team", "./x", "../y", "a/../b", "/a/./b/", "//other.com/z", "https://acme.com/q?x#y", "?p=1", "#top", "/", "mailto:a@b.c", "a//b", "/a//b", "..", "a/.", "HTTPS://www.acme.com/w"]


@pytest.mark.parametrize("href", HREFS)
def test_links_resolve_like_the_standard(spark, href):
    got = spark.createDataFrame([(href,)], "h string").select(pages.resolved_link(F.col("h"), F.lit("acme.com")).alias("u")).first().u
    want = urljoin("https://acme.com", href)
    assert got.rstrip("/") == want.rstrip("/") or got == want


def test_page_links(spark):
    html = """<a href="/about/">A</a><a class='x' href='https://www.acme.com/about'>dup</a><a href=/team?x=1>T</a><a href="/doc.pdf">d</a><a href="/doc.PDF">D</a>
      <a href="https://other.com/x">o</a><a href="/">root</a><!-- <a href="/hidden">h</a> --><a data-href="/no" href="https://acme.com/case-studies">c</a><area href="/map">"""
    df = spark.createDataFrame([(1, "acme.com", html)], "page_id int, site string, html string")
    links = pages.page_links(df)
    assert [(r.path, r.url) for r in links.orderBy("ordinal").collect()] == [
        ("/about", "https://acme.com/about/"), ("/team", "https://acme.com/team"), ("/doc.PDF", "https://acme.com/doc.PDF"), ("/case-studies", "https://acme.com/case-studies"),
    ]
    best = pages.relevant_links(links, ["industry_description", "company_people", "target_market"])
    assert {r.path: r.score for r in best.collect()} == {"/about": 6, "/team": 6}
    from leadflow.functions.fixed import LINK_PATTERNS_CORRECTED

    more = pages.relevant_links(links, ["target_market"], patterns=LINK_PATTERNS_CORRECTED)
    assert [r.path for r in more.collect()] == ["/case-studies"]


def test_fetch_passes(spark):
    thin, rich = "x" * 100, "y" * 2000
    rows = [
        ("a.com", 1, True, rich), ("a.com", 2, True, thin),
        ("b.com", 1, True, thin), ("b.com", 2, True, "z" * 50), ("b.com", 3, True, "w"),
        ("c.com", 1, False, None), ("c.com", 2, True, rich),
        ("d.com", 1, True, thin), ("d.com", 2, False, None), ("d.com", 3, False, None),
        ("x.g2.com", 1, True, rich), ("x.g2.com", 3, True, thin),
        ("linkedin.com", 1, True, rich), ("linkedin.com", 3, False, None),
    ]
    df = spark.createDataFrame(rows, "domain string, pass int, ok boolean, text string")
    assert {r.domain: r["pass"] for r in pages.choose_fetch_pass(df).collect()} == {"a.com": 1, "b.com": 3, "d.com": 1, "x.g2.com": 3}
    assert {r.domain: r["pass"] for r in pages.choose_fetch_pass(df, has_key=False).collect()} == {"a.com": 1, "b.com": 1, "d.com": 1, "x.g2.com": 1, "linkedin.com": 1}


def test_documents_and_their_cut(spark):
    rows = [("s.com", i, f"https://s.com/{i}", "t" * n) for i, n in enumerate([10, 20])] + [("l.com", i, f"u{i}", "w" * 7000) for i in range(4)]
    df = spark.createDataFrame(rows, "domain string, ordinal int, url string, text string")
    got = {r.domain: r for r in extract.site_documents(df, 16_000).collect()}
    assert got["s.com"].document == "[Page: https://s.com/0]\n" + "t" * 10 + "\n\n---\n\n[Page: https://s.com/1]\n" + "t" * 20
    assert len(got["l.com"].document) == 16000 + 16 and got["l.com"].document.endswith("[...truncated]")
    many = spark.range(3000).selectExpr("'m.com' AS domain", "id AS ordinal", "'' AS url", "'' AS text")
    doc = extract.site_documents(many, 16_000).first()
    whole = "\n\n---\n\n".join(["[Page: ]\n"] * 3000)
    assert len(doc.page_urls) == 3000 and extract.site_documents(many).first().document == whole
    assert doc.n_pages == 3000 and doc.document == whole[:16000] + "\n\n[...truncated]"


def test_link_and_template_probes(spark):
    html = (
        '<a title="see href=/bad now" href="/about">x</a><a data-x=\'href="/no"\' class=y href=/team/>t</a><a\nhref = "/about/">again</a>'
        '<A HREF="https://www.s.com/news?x=1">n</A><a hreflang="en" href="/de">d</a><abbr href="/never">z</abbr><a name="top">no</a>'
    )
    df = spark.createDataFrame([(1, "s.com", html), (2, "s.com", None), (3, "s.com", "<a " + "x=1 " * 20_000 + 'href="/far">')], "page_id int, site string, html string")
    links = pages.page_links(df)
    got = sorted((r.page_id, r.ordinal, r.path, r.url) for r in links.collect())
    assert got == [
        (1, 0, "/about", "https://s.com/about"), (1, 1, "/team", "https://s.com/team/"), (1, 3, "/news", "https://www.s.com/news"),
        (1, 4, "/de", "https://s.com/de"), (3, 0, "/far", "https://s.com/far"),
    ]
    for plan in (links, pages.relevant_links(links, ["industry_description"])):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    texts = spark.createDataFrame([("<body>a<template>hidden <b>x</b></template><ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby></body>",)], "html string")
    assert pages.page_text(texts).first().text == "a\nk"
