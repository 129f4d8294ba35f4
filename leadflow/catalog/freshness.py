"""Cache, captures, row statuses and diagnosis over events, pages and customers."""

from pyspark.sql import functions as F

from leadflow.catalog.base import mod, query, result_rows, table, text, view
from leadflow.catalog.extract import answers
from leadflow.catalog.pages import site_rows
from leadflow.functions.text import micros
from leadflow.operators import entities, extract, freshness

NOW = "TIMESTAMP '2024-01-20 12:00:00'"
view(
    "cache",
    """SELECT CASE event_type WHEN 'view' THEN 'serper' WHEN 'click' THEN 'g2_cat' WHEN 'error' THEN 'g2_cat_scrape_v3' WHEN 'signup' THEN 'scrape' ELSE 'funding_discovery' END
         || ':' || sha256('u' || user_id || ':' || (event_id % 20)) AS cache_key, props AS payload, ts AS written_at,
       CASE event_type WHEN 'purchase' THEN 3600 WHEN 'view' THEN 604800 WHEN 'signup' THEN 604800 ELSE 259200 END AS ttl_seconds, event_id, event_type FROM events""",
)


def cache(spark, d):
    t = F.col("event_type")
    prefix = F.when(t == "view", "serper").when(t == "click", "g2_cat").when(t == "error", "g2_cat_scrape_v3").when(t == "signup", "scrape").otherwise("funding_discovery")
    ttl = F.when(t == "purchase", 3600).when(t.isin("view", "signup"), 604800).otherwise(259200)
    keyed = freshness.cache_keys(
        table(spark, d, "events").withColumns({"_a": text("u", ":user_id"), "_b": mod("event_id", 20).cast("string")}), "k", ["_a", "_b"]
    )
    return keyed.select(
        F.concat(prefix, F.lit(":"), F.split_part("cache_key", F.lit(":"), F.lit(2))).alias("cache_key"), F.col("props").alias("payload"),
        F.col("ts").alias("written_at"), ttl.alias("ttl_seconds"), "event_id", "event_type",
    )


def requests(spark, d):
    return table(spark, d, "customer").select("c_custkey", freshness.cache_key("serper", [text("u", F.col("c_custkey") % 300), (F.col("c_custkey") % 20).cast("string")]).alias("cache_key"))


view("requests", "SELECT c_custkey, 'serper:' || sha256('u' || (c_custkey % 300) || ':' || (c_custkey % 20)) AS cache_key FROM customer")
view(
    "live",
    f"""SELECT cache_key, payload, written_at FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY written_at DESC) AS n FROM cache WHERE written_at <= {NOW})
        WHERE n = 1 AND {NOW} - written_at < to_seconds(ttl_seconds)""",
    ("cache",),
)


def now():
    return F.lit("2024-01-20 12:00:00").cast("timestamp")


@query("cache_keys", "SELECT c_custkey, 'enrich:' || sha256(lower(c_name) || '::' || c_mktsegment) AS cache_key FROM customer")
def cache_keys(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.lower("c_name").alias("a"), F.lit(None).cast("string").alias("b"), F.col("c_mktsegment").alias("c"))
    return freshness.cache_keys(rows, "enrich", ["a", "b", "c"]).select("c_custkey", "cache_key")


@query("cache_hits", "SELECT c_custkey, cache_key, payload, epoch_us(written_at) AS written_us FROM requests JOIN live USING (cache_key)", ("requests", "live"))
def cache_hits(spark, d):
    return freshness.cache_hits(requests(spark, d), cache(spark, d), now()).select("c_custkey", "cache_key", "payload", micros("written_at").alias("written_us"))


@query("cache_misses", "SELECT * FROM requests WHERE cache_key NOT IN (SELECT cache_key FROM live)", ("requests", "live"))
def cache_misses(spark, d):
    return freshness.cache_misses(requests(spark, d), cache(spark, d), now())


@query(
    "cache_write",
    """SELECT cache_key, payload, epoch_us(written_at) AS written_us, ttl_seconds FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY written_at DESC) AS n FROM (
       SELECT * FROM cache WHERE event_id % 3 <> 0 UNION ALL SELECT * FROM cache WHERE event_id % 3 = 0 AND event_id % 5 <> 0)) WHERE n = 1""",
    ("cache",),
)
def cache_write(spark, d):
    c = cache(spark, d)
    new = c.filter(mod("event_id", 3) == 0).withColumn("payload", F.when(mod("event_id", 5) == 0, "{}").otherwise(F.col("payload")))
    out = freshness.cache_write(c.filter(mod("event_id", 3) != 0), new)
    return out.select("cache_key", "payload", micros("written_at").alias("written_us"), "ttl_seconds")


@query("cache_purge", "SELECT cache_key, event_id FROM cache WHERE event_type NOT IN ('click', 'signup')", ("cache",))
def cache_purge(spark, d):
    return freshness.cache_purge(cache(spark, d), ["g2_cat", "scrape"]).select("cache_key", "event_id")


@query(
    "cache_purge_counts",
    "SELECT CASE event_type WHEN 'click' THEN 'g2_cat' ELSE 'scrape' END AS prefix, count(DISTINCT cache_key) AS removed FROM cache WHERE event_type IN ('click', 'signup') GROUP BY 1",
    ("cache",),
)
def cache_purge_counts(spark, d):
    return freshness.cache_purge_counts(cache(spark, d), ["g2_cat", "scrape"])


@query(
    "upsert_captures",
    """SELECT email, tool_slug, arg_min(id, id) AS id, epoch_us(min(ts)) AS created_us, arg_max(ip, id) AS ip_address, arg_max_null(source, id) AS source FROM (
       SELECT event_id AS id, 'user' || user_id || '@example.com' AS email, event_type AS tool_slug, '10.0.0.' || (event_id % 250) AS ip,
              CASE WHEN event_id % 4 <> 1 THEN 'src' || (event_id % 9) END AS source, ts FROM events) GROUP BY email, tool_slug""",
)
def upsert_captures(spark, d):
    k = F.col("event_id")
    e = table(spark, d, "events").select(
        k.alias("id"), text("user", ":user_id", "@example.com").alias("email"), F.col("event_type").alias("tool_slug"), text("10.0.0.", k % 250).alias("ip_address"),
        F.when(k % 4 != 1, text("src", k % 9)).alias("source"), "ts",
    )
    out = entities.upsert_captures(e.filter(mod("id", 2) == 0), e.filter(mod("id", 2) == 1))
    return out.withColumn("created_us", micros("created_at")).drop("created_at")


@query("unknown_statuses", "SELECT event_type AS status, count(*) AS n_rows FROM events GROUP BY event_type")
def unknown_statuses(spark, d):
    known = result_rows(spark, d).select("status")
    return entities.unknown_statuses(known.unionByName(table(spark, d, "events").select(F.col("event_type").alias("status"))))


@query(
    "job_diagnosis",
    """SELECT domain, count(*) AS n_pages, sum(length(text))::BIGINT AS total_chars, round(sum(length(text)) / count(*), 6) AS chars_per_page,
       any_value(coalesce(p, 0)) AS populated_fields, any_value(coalesce(t, 0)) AS total_fields
       FROM site_rows LEFT JOIN (SELECT domain, (coalesce(industry <> '', false)::INT + coalesce(niche <> '', false)::INT + (cases IS NOT NULL)::INT) AS p,
         CASE WHEN nothing THEN 0 WHEN nulls THEN 2 ELSE 3 END AS t FROM answers) USING (domain) GROUP BY domain""",
    ("site_rows", "answers"),
)
def job_diagnosis(spark, d):
    out = entities.job_diagnosis(site_rows(spark, d), extract.parse_extractions(answers(spark, d)))
    return out.withColumn("chars_per_page", F.round("chars_per_page", 6))
