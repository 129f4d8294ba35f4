import os

import pytest

from leadflow.operators import domains

CLEAN = {
    "https://www.example.com/path?q=1#frag": "example.com",
    "http://example.com": "example.com",
    "www.example.com": "example.com",
    "  HTTPS://Example.COM/  ": "example.com",
    "blog.example.com": "example.com",
    "https://www.bbc.co.uk/news": "bbc.co.uk",
    "shop.acme.com.au": "acme.com.au",
    "example.com:8080": "example.com",
    "https://user:pw@example.io": "example.io",
    "example.com.": "example.com",
    "not-a-domain": None,
    "co.uk": None,
    "com": None,
    "192.168.0.1": None,
    "": None,
    ".com": None,
    "example..com": None,
}


def test_clean_domains(spark):
    df = spark.createDataFrame(list(CLEAN.items()), "url string, want string")
    for r in domains.clean_domains(df, "url").collect():
        assert r.domain == r.want, r.url


def test_clean_domains_with_own_suffixes(spark):
    df = spark.createDataFrame([("a.b.internal.lan",), ("x.com",)], "url string")
    got = domains.clean_domains(df, "url", ["internal.lan", "lan"]).collect()
    assert [r.domain for r in got] == ["b.internal.lan", None]


def test_normalize_outcomes(spark):
    rows = [("https://www.linkedin.com/company/acme",), ("",), (None,), ("nope",), ("https://acme.org/x",)]
    got = domains.normalize_domains(spark.createDataFrame(rows, "url string"), "url").collect()
    assert [(r.domain, r.blocked, r.error) for r in got] == [
        (None, True, "blocked domain: linkedin.com"),
        (None, False, "empty input"),
        (None, False, "empty input"),
        (None, False, "invalid URL"),
        ("acme.org", False, None),
    ]


@pytest.mark.parametrize(
    "ip,private",
    [
        ("10.0.0.1", True), ("172.15.0.1", False), ("172.31.9.9", True), ("192.168.1.1", True), ("8.8.8.8", False),
        ("127.0.0.1", True), ("169.254.1.1", True), ("::1", True), ("fe80::1", True), ("2606:4700::1", False),
        ("10.example.com", False), ("100.1.1.1", False), ("0.0.0.0", True), ("241.1.1.1", True),
    ],
)
def test_private_addresses(spark, ip, private):
    got = spark.createDataFrame([(ip,)], "ip string").select(domains.is_private_address("ip").alias("p")).first()
    assert got.p is private


def test_antibot_needs_a_label_border(spark):
    df = spark.createDataFrame([("g2.com",), ("WWW.g2.com",), ("a.b.g2.com",), ("notg2.com",), ("g2.com.evil.org",), (None,)], "domain string")
    assert [r.antibot for r in domains.antibot_domains(df).collect()] == [True, True, True, False, False, False]


PROBES = {
    "acme.club": "acme.club", "a.acme.law": "acme.law", "acme.fun": "acme.fun", "acme.art": "acme.art", "acme.restaurant": "acme.restaurant",
    "bank.top": "bank.top", "www.acme.co.hu": "acme.co.hu", "acme.com.ro": "acme.com.ro", "acme.com.ve": "acme.com.ve", "foo.zz": None,
    "a.b.ck": "a.b.ck", "b.ck": None, "x.www.ck": "www.ck", "ck": None, "city.kawasaki.jp": "city.kawasaki.jp", "a.b.c.kawasaki.jp": "b.c.kawasaki.jp",
    "a.xn--55qx5d.cn": "a.xn--55qx5d.cn",
}


def longest_rule(host, rules):
    """Registered domain by the list's own description, label by label."""
    labels, best = host.split("."), 0
    for n in range(1, len(labels) + 1):
        tail = labels[-n:]
        if "!" + ".".join(tail) in rules:
            best = n - 1
            break
        if ".".join(tail) in rules or (n > 1 and "*." + ".".join(tail[1:]) in rules):
            best = n
    return ".".join(labels[-best - 1 :]) if 0 < best < len(labels) else None


@pytest.mark.skipif(not os.path.exists(domains.SUFFIX_FILES[0]), reason="no public suffix list on this machine")
def test_full_suffix_list(spark):
    rules = set(domains.read_suffix_file(domains.SUFFIX_FILES[0]))
    hosts = list(PROBES) + [f"a.b.{r.removeprefix('!').removeprefix('*.')}" for r in sorted(rules)[::7]]
    df = spark.createDataFrame([(h,) for h in hosts], "url string")
    got = {r.url: r.domain for r in domains.clean_domains(df, "url").collect()}
    assert {h: got[h] for h in PROBES} == PROBES
    assert got == {h: longest_rule(h, rules) for h in hosts}
