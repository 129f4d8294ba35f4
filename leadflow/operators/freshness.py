"""The freshness cache as a table (cache_key, payload, written_at, ttl_seconds)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions.tables import look_up
from leadflow.functions.text import micros, or_blank

DAY = 86_400
# How long answers stay fresh, in seconds.
TTL = {
    "serper": 7 * DAY, "linkedin": 7 * DAY, "scrape": 7 * DAY, "intel": 7 * DAY, "enrich": 7 * DAY,
    "enrich_person": 7 * DAY, "serper_maps": 3 * DAY, "g2_cat": 3 * DAY, "g2_cat_scrape_v3": 3 * DAY,
    "funding_discovery": 3_600,
}


def cache_key(prefix: str, parts: Sequence[str | Column]) -> Column:
    """``prefix:sha256(a:b:c)``; a null part counts as blank."""
    text = F.concat_ws(":", *[or_blank(p) for p in parts])
    return F.concat(F.lit(f"{prefix}:"), F.sha2(text, 256))


def title_part(titles: Sequence[str]) -> str:
    """Requested titles as one key part: lower case, sorted."""
    return ", ".join(sorted(t.lower() for t in titles))


def cache_keys(df: DataFrame, prefix: str, cols: Sequence[str]) -> DataFrame:
    return df.withColumn("cache_key", cache_key(prefix, cols))


def live_entries(cache: DataFrame, now: Column, fields: Sequence[str] = ("payload",)) -> DataFrame:
    """Newest entry per key, if it is still within its time: the key, ``fields`` and ``written_at``."""
    newest = cache.groupBy("cache_key").agg(
        F.max_by(F.struct(*fields, "written_at", "ttl_seconds"), "written_at").alias("e")
    )
    age = micros(now) - micros("e.written_at")
    fresh = newest.filter((age >= 0) & (age < F.col("e.ttl_seconds").cast("long") * 1_000_000))
    return fresh.select("cache_key", *[F.col(f"e.{c}").alias(c) for c in fields], F.col("e.written_at").alias("written_at"))


def asked_entries(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Cache entries that someone asks for; those written after ``now`` do not exist yet."""
    asked = requests.select("cache_key").distinct()
    return cache.filter(F.col("written_at") <= now).join(asked, "cache_key", "left_semi")


def cache_hits(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests with a fresh answer. Entries written after ``now`` do not exist yet."""
    known = live_entries(asked_entries(requests, cache, now), now)
    return look_up(requests, known, "cache_key", "inner")


def cache_misses(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests still to be fetched."""
    known = live_entries(asked_entries(requests, cache, now), now, fields=())
    return requests.join(known.select("cache_key"), "cache_key", "left_anti")


def cache_write(cache: DataFrame, fetched: DataFrame, skip_empty: bool = True) -> DataFrame:
    """Add answers; the last one per key wins. Empty crawls and extractions are not kept."""
    if skip_empty:
        fetched = fetched.filter(~or_blank("payload").isin("", "{}", "[]", "null"))
    cols = ["cache_key", "payload", "written_at", "ttl_seconds"]
    both = cache.select(*cols).unionByName(fetched.select(*cols))
    newest = both.groupBy("cache_key").agg(F.max_by(F.struct(*cols[1:]), "written_at").alias("e"))
    return newest.select("cache_key", "e.*")


def cache_prefix() -> Column:
    return F.substring_index("cache_key", ":", 1)


def cache_purge(cache: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """The cache without the named prefixes; a prefix only matches up to its colon."""
    return cache.filter(~cache_prefix().isin(list(prefixes)))


def cache_purge_counts(cache: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    gone = cache.withColumn("prefix", cache_prefix()).filter(F.col("prefix").isin(list(prefixes)))
    return gone.groupBy("prefix").agg(F.count_distinct("cache_key").alias("removed"))
