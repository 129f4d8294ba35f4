import pytest
from check import compare, connection

from leadflow.llm.urlfilter import build_cascade, judge_urls

PAGES = "page_id long, url string, host string"
URLS = [
    "https://A.Example.org/es/1", "http://example.org", "http://example.org/en/12?x=/es/", "http://badexample.org/es/", "http://x.com/fr/#a",
    "http://x.com/de/", "http://x.com/es/", "no address", "", None, "ftp://listed.net", "ftp://LISTED.net/a?b", "http://sub.listed.net/",
    "http://x.net?http://listed.net/", "a://b://c/d", "http://" + "h" * 50_000 + "/p", "http://x.com/fr/#a",
]
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def brute(url, listed):
    rest = url.partition("://")[2] if url else ""
    host = rest
    for sign in "/?#":
        host = host.partition(sign)[0]
    path = rest[len(host) :]
    for sign in "?#":
        path = path.partition(sign)[0]
    host = host.lower()
    fits = [
        (len(r), r, act) for act, r in RULES
        if ("." + host).endswith("." + r.partition("/")[0]) and path.startswith("/" + r.partition("/")[2])
    ]
    if fits:
        _, rule, act = max(fits)
        return host, path, rule, act
    return host, path, None, "block" if host in listed else "allow"


@pytest.mark.parametrize("max_bytes", [64 << 20, 0])
def test_against_brute_force(spark, max_bytes):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], PAGES)
    listed = spark.createDataFrame([("listed.net",), ("listed.net",), (None,), ("elsewhere.net",)], "key string")
    got = judge_urls(pages, listed, RULES, max_bytes=max_bytes)
    assert sorted(got.columns) == sorted(["page_id", "url", "host", "path", "rule", "verdict"])
    want = {i: brute(u, {"listed.net"}) for i, u in enumerate(URLS)}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == want


def test_empty_tables(spark):
    pages, none = spark.createDataFrame([], PAGES), spark.createDataFrame([], "key string")
    assert judge_urls(pages, none, RULES).collect() == []
    some = spark.createDataFrame([(1, "http://x.net", None)], PAGES)
    assert [r.verdict for r in judge_urls(some, none).collect()] == ["allow"]


@pytest.mark.parametrize("part", [2, 10, 1000])
def test_cascade_is_exact(spark, part):
    keys = spark.range(20_000).selectExpr("CAST(id AS STRING) AS key", f"id % {part} = 0 AS listed")
    cascade = build_cascade(keys)
    assert len(cascade.levels) > 1
    assert keys.filter(cascade.listed("key") != keys.listed).count() == 0


def test_query_against_sql(spark, tables):
    from leadflow.llm.queries import ORACLES, QUERIES

    name = "op7_url_filter"
    ok, note, _ = compare(spark, connection(tables), name, QUERIES[name], ORACLES[name], tables)
    assert ok, note
    plan = QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan
