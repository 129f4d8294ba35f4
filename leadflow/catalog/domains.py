"""Domain operators over the page addresses."""

from pyspark.sql import functions as F

from leadflow.catalog.base import mod, query, raw_urls, table, text, view
from leadflow.operators import domains

# what each way of writing an address normalises to
view(
    "clean_urls",
    """SELECT page_id, raw, kind, netloc, base,
       CASE WHEN kind IN (0, 1, 2, 7) THEN base WHEN kind = 3 THEN 'bbc.co.uk' WHEN kind = 4 THEN 'linkedin.com' END AS domain
       FROM raw_urls""",
    ("raw_urls",),
)
view(
    "normal_urls",
    """SELECT page_id, raw, kind = 4 AS blocked, CASE WHEN kind <> 4 THEN domain END AS domain,
       CASE WHEN kind = 5 THEN 'empty input' WHEN kind IN (6, 8) THEN 'invalid URL' WHEN kind = 4 THEN 'blocked domain: linkedin.com' END AS error
       FROM clean_urls""",
    ("clean_urls",),
)


@query("clean_domains", "SELECT page_id, raw, domain FROM clean_urls", ("clean_urls",))
def clean_domains(spark, d):
    return domains.clean_domains(raw_urls(spark, d), "raw")


@query("blocked_domains", "SELECT page_id, raw, domain, kind = 4 AS blocked FROM clean_urls", ("clean_urls",))
def blocked_domains(spark, d):
    return domains.blocked_domains(clean_domains(spark, d))


@query("normalize_domains", "SELECT page_id, raw, domain, blocked, error FROM normal_urls", ("normal_urls",))
def normalize_domains(spark, d):
    return domains.normalize_domains(raw_urls(spark, d), "raw")


@query(
    "normalize_domains_summary",
    "SELECT domain, error, blocked, count(*) AS n_pages FROM normal_urls GROUP BY domain, error, blocked",
    ("normal_urls",),
)
def normalize_domains_summary(spark, d):
    return normalize_domains(spark, d).groupBy("domain", "error", "blocked").agg(F.count(F.lit(1)).alias("n_pages"))


view(
    "redirect_rows",
    """SELECT c_custkey AS row_index,
       CASE WHEN c_custkey % 4 = 0 THEN 'https://www.v' || (c_custkey // 6) || '.com/a' WHEN c_custkey % 4 = 1 THEN '' END AS verified_domain,
       CASE WHEN c_custkey % 9 = 8 THEN NULL WHEN c_custkey % 9 = 7 THEN 'facebook.com' ELSE 'r' || (c_custkey // 6) || '.org' END AS raw_domain,
       CASE WHEN c_custkey % 4 = 0 THEN 'v' || (c_custkey // 6) || '.com'
            WHEN c_custkey % 9 < 7 THEN 'r' || (c_custkey // 6) || '.org' END AS known, c_custkey // 6 AS g
       FROM customer""",
)


def redirect_rows(spark, d):
    k = F.col("c_custkey")
    g = F.floor(k / 6)
    return table(spark, d, "customer").select(
        k.alias("row_index"),
        F.when(k % 4 == 0, text("https://www.v", g, ".com/a")).when(k % 4 == 1, "").alias("verified_domain"),
        F.when(k % 9 == 8, F.lit(None)).when(k % 9 == 7, "facebook.com").otherwise(text("r", g, ".org")).alias("raw_domain"),
    )


@query(
    "normalize_with_redirects",
    """SELECT row_index,
       CASE WHEN known IS NULL THEN NULL WHEN g % 5 = 1 THEN 'moved' || g || '.net' WHEN g % 5 = 2 THEN NULL ELSE known END AS domain,
       CASE WHEN known IS NULL THEN row_index % 9 = 7 ELSE g % 5 = 2 END AS blocked,
       CASE WHEN known IS NULL AND row_index % 9 = 7 THEN 'blocked domain: facebook.com' WHEN known IS NULL THEN 'empty input'
            WHEN g % 5 = 2 THEN 'blocked domain: x.com' END AS error
       FROM redirect_rows""",
    ("redirect_rows",),
)
def normalize_with_redirects(spark, d):
    g = F.col("g")
    hops = table(spark, d, "customer").filter(mod("c_custkey", 6) == 0).select(F.floor(F.col("c_custkey") / 6).alias("g"))
    final = (
        F.when(g % 5 == 1, text("https://www.moved", g, ".net/home")).when(g % 5 == 2, "https://x.com/acme")
        .when(g % 5 == 3, "https://nowhere").otherwise(F.lit(None))
    )
    redirects = hops.select(
        F.explode(F.array(text("v", g, ".com"), text("r", g, ".org"))).alias("domain"), final.alias("final_url")
    ).filter(F.col("final_url").isNotNull())
    return domains.normalize_with_redirects(redirect_rows(spark, d), redirects)


@query(
    "apply_normalized",
    """SELECT c_custkey AS row_index, CASE WHEN c_custkey % 3 <> 0 THEN 'v.com' END AS verified_domain,
       CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 > 1 AND c_custkey % 7 <> 0 THEN 'v' || c_custkey || '.com' END AS normalized_domain,
       CASE WHEN c_custkey % 3 = 0 THEN 'not_found' WHEN c_custkey % 7 = 0 THEN 'failed' WHEN c_custkey % 5 = 0 THEN 'blocked'
            WHEN c_custkey % 5 = 1 THEN 'failed' ELSE 'normalized' END AS status
       FROM customer""",
)
def apply_normalized(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    rows = c.select(
        k.alias("row_index"), F.when(k % 3 != 0, "v.com").alias("verified_domain"),
        F.lit(None).cast("string").alias("normalized_domain"), F.when(k % 3 == 0, "not_found").otherwise("verified").alias("status"),
    )
    outcomes = c.filter(k % 7 != 0).select(
        k.alias("row_index"), F.when(k % 5 > 1, text("v", k, ".com")).alias("domain"), (k % 5 == 0).alias("blocked"),
        F.when(k % 5 == 0, "blocked domain: v.com").when(k % 5 == 1, "invalid URL").alias("error"),
    )
    return domains.apply_normalized(rows, outcomes)


@query(
    "host_of",
    r"""SELECT page_id, raw,
       CASE WHEN kind = 1 THEN regexp_replace(upper(netloc), '^www\.', '') WHEN kind = 0 THEN regexp_replace(netloc, '^www\.', '')
            WHEN kind = 3 THEN 'bbc.co.uk' WHEN kind = 4 THEN 'linkedin.com' WHEN kind = 7 THEN 'user@' || netloc || ':8080' ELSE '' END AS host
       FROM raw_urls""",
    ("raw_urls",),
)
def host_of(spark, d):
    return domains.add_host(raw_urls(spark, d), "raw")


@query(
    "antibot_domains",
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'g2.com' WHEN 1 THEN 'www.sell.G2.com' WHEN 2 THEN 'notg2.com' WHEN 3 THEN 'reuters.com' ELSE url END AS domain,
       page_id % 5 IN (0, 1, 3) AS antibot FROM pages""",
)
def antibot_domains(spark, d):
    k = F.col("page_id") % 5
    dom = F.when(k == 0, "g2.com").when(k == 1, "www.sell.G2.com").when(k == 2, "notg2.com").when(k == 3, "reuters.com").otherwise(F.col("url"))
    return domains.antibot_domains(table(spark, d, "pages").select("page_id", dom.alias("domain")))


@query(
    "safe_urls",
    """SELECT page_id, CASE WHEN page_id % 10 = 7 THEN 'https://8.8.4.4/x' ELSE url END AS url
       FROM pages WHERE page_id % 10 NOT IN (1, 2, 3, 4, 5)
       AND regexp_extract(url, '//([^/?#]*)', 1) NOT IN (SELECT regexp_extract(url, '//([^/?#]*)', 1) FROM pages WHERE page_id % 50 = 0)
       OR page_id % 10 = 7""",
)
def safe_urls(spark, d):
    k = F.col("page_id") % 10
    p = table(spark, d, "pages")
    url = (
        F.when(k == 1, F.concat(F.lit("ftp://a.b/"), "url")).when(k == 2, "http://LocalHost:80/").when(k == 3, "www.example.com")
        .when(k == 4, "http://172.20.1.9/").when(k == 5, "http://[fe80::1]/").when(k == 7, "https://8.8.4.4/x").otherwise(F.col("url"))
    )
    host = F.regexp_extract("url", "//([^/?#]*)", 1)
    dns = p.select(host.alias("host"), F.when(F.col("page_id") % 50 == 0, "10.1.2.3").otherwise("93.184.216.34").alias("ip"))
    return domains.safe_urls(p.select("page_id", url.alias("url")), "url", dns)


@query(
    "validate_emails",
    "SELECT event_id, 'user' || user_id || '@example.com' AS email FROM events WHERE event_type IN ('view', 'signup')",
)
def validate_emails(spark, d):
    t = F.col("event_type")
    mail = F.when(t == "error", "a b@example.com").when(t == "click", text("u", ":user_id", "@example")).when(
        t == "purchase", text("@", ":user_id", ".example.com")
    ).otherwise(text("user", ":user_id", "@example.com"))
    return domains.validate_emails(table(spark, d, "events").select("event_id", mail.alias("email")), "email")
