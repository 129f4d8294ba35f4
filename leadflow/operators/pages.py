"""Jobs over the page table: text, links, mailboxes, fetch passes, site pages."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions import fixed
from leadflow.functions.html import read_page
from leadflow.functions.tables import cap_per_key, first_per_key, look_up
from leadflow.functions.text import any_of, col, filled, one_of, or_blank, strip
from leadflow.operators.domains import is_antibot

SKIPPED_TAGS = ["script", "style", "nav", "footer", "header", "noscript", "svg", "template", "rt", "rp"]
# Entities that the fast path decodes itself; & comes last.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": "\xa0",
    "&copy;": "\xa9", "&reg;": "\xae", "&middot;": "\xb7", "&amp;": "&",
}
_TAG = r"<(?:/?[a-zA-Z]|!)[^>]*>"
_BREAK = "\x01"
# steps over whole attributes, so that quoted text is never taken for one
_HREF = (
    r"""(?is)<a(?:\s++(?!href\s*=)[^\s"'>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+)*+\s++href\s*=\s*"""
    r"""("[^"]*"|'[^']*'|[^\s>"']+)"""
)
_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"


def decode_entities(c: Column) -> Column:
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def without_blocks(html: str | Column, tags: Sequence[str]) -> Column:
    """Page source with a break in place of comments and of the named elements."""
    c = F.regexp_replace(or_blank(html), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", _BREAK)
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", _BREAK)
    rest = "|".join(t for t in tags if t not in ("script", "style"))
    return F.regexp_replace(c, rf"(?is)<({rest})\b[^>]*>.*?</\1\s*>", _BREAK) if rest else c


def tidy_text(text: Column, limit: int | None) -> Column:
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"[ \t]{2,}", " ")
    return text if limit is None else F.substring(text, 1, limit)


def _text_by_parser(html: str, limit: int | None) -> str:
    page = read_page(html)
    for tag in ("main", "article", "body"):
        found = _first_outside(page, tag)
        if found is not None:
            page = found
            break
    text = "\n".join(page.strings(frozenset(SKIPPED_TAGS)))
    text = re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", text))
    return text[:limit]


def _first_outside(page, tag: str):
    """First element of a kind that does not sit inside a dropped element."""
    stack = list(reversed(page.children))
    while stack:
        node = stack.pop()
        if node.tag in SKIPPED_TAGS:
            continue
        if node.tag == tag:
            return node
        stack.extend(reversed(node.children))
    return None


def page_text(pages: DataFrame, html_col: str = "html", limit: int | None = None) -> DataFrame:
    """Add ``text``: the visible text of each page, with ``limit`` its first characters.

    Plain pages are read by Spark's own string functions. Pages those cannot read exactly (nested or
    unclosed elements, rare entities, angle brackets in attributes) go to the parser; for all other
    rows the parser column is null, so their source never leaves the JVM.
    """
    body, content = F.col("_body"), F.col("_content")
    block = lambda tag: F.regexp_extract(body, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    has = lambda tag: body.rlike(rf"(?i)<{tag}\b")
    pieces = F.split(F.regexp_replace(content, _TAG, _BREAK), _BREAK)
    texts = F.filter(F.transform(pieces, lambda p: strip(decode_entities(p))), lambda p: p != "")
    known = "|".join(e[1:-1] for e in ENTITIES)
    hard = any_of(
        [
            body.rlike(rf"(?i)</?({'|'.join(SKIPPED_TAGS)})\b"),
            body.rlike(rf"&(?!(?:{known});)#?[a-zA-Z0-9]"),
            body.rlike(r"""=\s*(?:"[^"]*[<>][^"]*"|'[^']*[<>][^']*')"""),
            body.rlike(r"(?i)<!\[CDATA\[|<\?|<plaintext"),
            content.rlike(r"(?i)<(main|article|body)\b"),
            *[has(t) & ~body.rlike(rf"(?i)</{t}\s*>") for t in ("main", "article", "body")],
        ]
    )

    @F.pandas_udf("string")
    def parsed(sources: pd.Series) -> pd.Series:
        return sources.map(lambda s: None if s is None else _text_by_parser(s, limit))

    # one step per column, so that each pattern runs once per page
    return (
        pages.withColumn("_body", without_blocks(html_col, SKIPPED_TAGS))
        .withColumn(
            "_content",
            F.when(has("main"), block("main")).when(has("article"), block("article"))
            .when(has("body"), block("body")).otherwise(body),
        )
        .withColumn("_hard", F.when(hard, col(html_col)))
        .withColumn("_plain", F.when(F.col("_hard").isNull(), tidy_text(F.array_join(texts, "\n"), limit)))
        .withColumn("text", F.coalesce(parsed("_hard"), "_plain"))
        .drop("_body", "_content", "_hard", "_plain")
    )


def resolved_link(href: Column, site: Column) -> Column:
    """Absolute form of a link against ``https://site``."""
    base = F.concat(F.lit("https://"), site)
    path = F.regexp_extract(href, r"^[^?#]*", 0)
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    rooted = path.startswith("/")
    inner = F.filter(F.split(path, "/"), lambda s: s != "")
    relative = F.concat(
        F.array(F.lit("")), inner, F.when(path.endswith("/"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    )
    segments = F.when(rooted, F.split(path, "/")).otherwise(relative)
    # '.' stays where it is, '..' drops the segment before it
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done))
        .otherwise(F.array_append(done, s)),
    )
    closing = F.when(path.rlike(r"(^|/)\.\.?$"), "/").otherwise("")
    joined = F.concat(F.array_join(walked, "/"), closing)
    full = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    return (
        F.when(href.rlike(_SCHEME), F.concat(F.lower(F.regexp_extract(href, _SCHEME, 0)), F.regexp_replace(href, _SCHEME, "")))
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(path == "", F.concat(base, tail))
        .otherwise(F.concat(base, full, tail))
    )


def page_links(pages: DataFrame, key: str = "page_id", site_col: str = "site", html_col: str = "html") -> DataFrame:
    """Links of each page to its own site: (key, site, ordinal, path, url), one per path, first wins.

    Links are read, resolved and sorted out inside the page's own array, step by step: a filter behind an
    explode would be pushed in front of it with every step spelled out again.
    """
    site = F.col("site")
    hrefs = F.regexp_extract_all(
        without_blocks("_html", ["script", "style"]), F.lit(_HREF), F.lit(1)
    )

    def cleaned(href: Column) -> Column:
        bare = F.regexp_replace(href, r"""^["']|["']$""", "")
        return F.regexp_replace(strip(decode_entities(bare)), r"[\t\r\n]", "")

    def parts(url: Column, i: Column) -> Column:
        after = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^?#]*)", 1)
        return F.struct(
            i.alias("ordinal"),
            F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://)", 1).alias("scheme"),
            F.regexp_extract(after, r"^[^/]*", 0).alias("netloc"),
            F.regexp_replace(F.regexp_extract(after, r"^[^/]*(.*)$", 1), r";[^/]*$", "").alias("path"),
        )

    def kept(link: Column) -> Column:
        host = F.regexp_replace(link["netloc"], r"^www\.", "")
        page = link["path"].rlike(r"[^/]") & ~link["path"].rlike(rf"(?:{one_of(fixed.SKIPPED_FILES)})/*$")
        return ((host == site) | (host == F.concat(F.lit("www."), site))) & page

    def named_path(link: Column) -> Column:
        url = F.concat(link["scheme"], link["netloc"], link["path"])
        return F.struct(F.regexp_replace(link["path"], r"/+$", "").alias("path"), link["ordinal"].alias("ordinal"), url.alias("url"))

    def firsts(links: Column) -> Column:
        paths = F.transform(links, lambda x: x["path"])
        return F.transform(F.array(paths), lambda all_paths: F.filter(links, lambda x, i: F.array_position(all_paths, x["path"]) == i + 1))[0]

    resolved = F.transform(F.transform(hrefs, cleaned), lambda h: resolved_link(h, site))
    own = F.transform(F.filter(F.transform(resolved, parts), kept), named_path)
    # bound once: the first of each path is found inside the page's own list
    found = F.transform(F.array(own), firsts)[0]
    named = pages.select(key, F.col(site_col).alias("site"), F.col(html_col).alias("_html"))
    links = named.select(key, "site", F.explode_outer(found).alias("l")).filter(F.col("l").isNotNull())
    return links.select(key, "site", "l.path", "l.ordinal", "l.url")


def relevant_links(
    links: DataFrame,
    options: Sequence[str],
    k: int | None = None,
    patterns: Mapping[str, Sequence[str]] = fixed.LINK_PATTERNS,
    key: str = "page_id",
) -> DataFrame:
    """Links per page that fit the patterns of the chosen options; with ``k`` the best ones, ties in page order."""
    score = F.lit(0)
    for option in options:
        for i, pattern in enumerate(patterns.get(option, [])):
            score = score + F.when(F.col("path").rlike(pattern), 3 - i).otherwise(0)
    scored = links.withColumn("score", score).filter(F.col("score") > 0)
    return cap_per_key(scored, [key], [F.desc("score"), F.asc("ordinal")], k)


def generic_mailboxes(text: str | Column, mailboxes: Sequence[str] = fixed.GENERIC_MAILBOXES) -> Column:
    found = F.transform(F.regexp_extract_all(or_blank(text), F.lit(f"({fixed.EMAIL_PATTERN})"), F.lit(1)), F.lower)
    return F.array_distinct(F.filter(found, lambda e: F.split_part(e, F.lit("@"), F.lit(1)).isin(list(mailboxes))))


def generic_emails(
    pages: DataFrame, text_col: str = "text", mailboxes: Sequence[str] = fixed.GENERIC_MAILBOXES
) -> DataFrame:
    """Add ``general_emails``: company mailboxes in the text, lower case, in order of appearance."""
    return pages.withColumn("general_emails", generic_mailboxes(text_col, mailboxes))


def choose_fetch_pass(
    attempts: DataFrame, has_key: bool = True, min_length: int = fixed.MIN_CONTENT_LENGTH
) -> DataFrame:
    """The attempt that counts per domain.

    ``attempts(domain, pass, ok, text ...)``: pass 1 plain, 2 rendered, 3 residential. The last successful
    pass that was tried wins, even when shorter; a failed first pass fails the site. Listed anti-bot
    sites only use the last pass.
    """
    antibot = is_antibot("domain") & F.lit(has_key)
    # only lengths are grouped; the page itself is joined back once
    size = lambda n: F.max(F.when((F.col("pass") == n) & F.col("ok"), F.length("text"))).alias(f"_len{n}")
    sizes = attempts.groupBy("domain").agg(size(1), size(2), size(3))
    one, two, three = F.col("_len1"), F.col("_len2"), F.col("_len3")
    short1 = (one < min_length) & F.lit(has_key)
    after2 = F.when(short1 & two.isNotNull(), two).otherwise(one)
    short2 = (after2 < min_length) & F.lit(has_key)
    chosen = (
        F.when(antibot, F.when(three.isNotNull(), 3))
        .when(one.isNull(), None)
        .when(short2 & three.isNotNull(), 3)
        .when(short1 & two.isNotNull(), 2)
        .otherwise(1)
    )
    picked = sizes.select("domain", chosen.alias("pass")).filter(F.col("pass").isNotNull())
    return attempts.join(picked, ["domain", "pass"], "left_semi")


def site_pages(homepages: DataFrame, internal: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Homepage first, then the chosen pages that have text: (domain, ordinal, url, text).

    ``internal`` carries the link order in ``ordinal`` (0 is the best link).
    """
    home = homepages.select("domain", F.lit(0).cast("long").alias("ordinal"), F.concat(F.lit("https://"), "domain").alias("url"), "text")
    inner = internal.filter(filled("text")).select(
        "domain", (F.col("ordinal") + 1).cast("long").alias("ordinal"), "url", "text"
    )
    fetched = inner.join(home.select("domain"), "domain", "left_semi")
    return cap_per_key(home.unionByName(fetched), ["domain"], ["ordinal"], max_pages)


CRAWL_OPTIONS = ("industry_description", "target_market", "homepage_raw_text")


def needs_crawl(options: Sequence[str]) -> bool:
    return any(o in options for o in CRAWL_OPTIONS)


def crawl_targets(rows: DataFrame, have: DataFrame, options: Sequence[str]) -> DataFrame:
    """Domains that still have to be crawled; none when no option reads page text."""
    wanted = rows.filter(filled("raw_domain")).select(F.col("raw_domain").alias("domain")).distinct()
    if not needs_crawl(options):
        return wanted.limit(0)
    return wanted.join(have.select("domain"), "domain", "left_anti")


def site_mailboxes(pages: DataFrame) -> DataFrame:
    """Distinct generic mailboxes per domain, in order of appearance over its pages."""
    found = pages.select(
        "domain", "ordinal", F.posexplode_outer(generic_mailboxes("text")).alias("_pos", "_mail")
    ).filter(F.col("_mail").isNotNull())
    # duplicates fold on the map side, only the addresses of the result are gathered
    first = found.groupBy("domain", "_mail").agg(F.min(F.struct("ordinal", "_pos")).alias("_at"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_mail")))
    return first.groupBy("domain").agg(F.transform(ordered, lambda x: x["_mail"]).alias("general_emails"))


def site_homepages(pages: DataFrame) -> DataFrame:
    """Text of the page whose address is exactly the domain's root."""
    home = pages.filter(F.col("url") == F.concat(F.lit("https://"), "domain"))
    return first_per_key(home.select("domain", "ordinal", F.col("text").alias("homepage_text")), ["domain"], ["ordinal"])


def apply_crawl(rows: DataFrame, crawled: DataFrame, pages: DataFrame, options: Sequence[str]) -> DataFrame:
    """Status after the crawl, with homepage text and mailboxes.

    ``crawled(domain)`` lists every domain that was tried with an answer, also those without a page.
    """
    has = filled("raw_domain")
    if not needs_crawl(options):
        return rows.withColumn("status", F.when(has, "crawled").otherwise("not_found"))
    digest = crawled.select("domain").distinct().join(site_mailboxes(pages), "domain", "left")
    raw_text = F.lit(None).cast("string")
    if "homepage_raw_text" in options:
        digest = digest.join(site_homepages(pages).drop("ordinal"), "domain", "left")
        raw_text = F.when(F.col("_crawled"), or_blank("homepage_text"))
    digest = digest.withColumn("_crawled", F.lit(True)).withColumnRenamed("domain", "raw_domain")
    status = F.when(~has, "not_found").when(F.col("_crawled"), "crawled").otherwise("scrape_failed")
    return (
        look_up(rows, digest, "raw_domain")
        .withColumns({"status": status, "homepage_raw_text": raw_text})
        .drop("homepage_text", "_crawled")
    )
