"""The answer cache as a table of buckets, and tools that ask it first.

Entries lie in directories by the hash of their key, so a probe reads the buckets of its keys alone. Answers are
appended; of several entries of a key the newest counts. A tool run over the cache takes what it has, and says what is
still to be fetched; once those answers are added, the same run has all of its answers and asks for nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.functions.text import or_blank
from leadflow.operators import freshness
from leadflow.operators.contacts import RECORD_FIELDS
from leadflow.plans.stages import Providers, written

ENTRY = "cache_key string, payload string, written_at timestamp, ttl_seconds bigint"
# Kinds whose empty answers are asked for again.
NOT_KEPT_EMPTY = ["scrape", "intel"]
TO_FETCH = "kind string, cache_key string, request string"
PAGES = "array<struct<ordinal:bigint,url:string,text:string>>"
RECORDS = f"array<struct<title_idx:bigint,pos:bigint,{','.join(f'{c}:string' for c in RECORD_FIELDS)}>>"


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create_cache(spark: SparkSession, folder: str, buckets: int = 64) -> str:
    """An empty cache in ``folder``, of ``buckets`` directories."""
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{folder}/about")
    add_answers(spark.createDataFrame([], ENTRY), folder)
    return folder


def _buckets(spark: SparkSession, folder: str) -> int:
    return spark.read.parquet(f"{folder}/about").first()["buckets"]


def add_answers(entries: DataFrame, folder: str) -> None:
    """Append entries (cache_key, payload, written_at, ttl_seconds); empty crawls and extractions are not kept."""
    spark = entries.sparkSession
    empty = or_blank("payload").isin("", "{}", "[]", "null") & freshness.cache_prefix().isin(NOT_KEPT_EMPTY)
    kept = entries.filter(F.col("payload").isNotNull() & ~empty)
    columns = [F.col(c.split()[0]).cast(c.split()[1]) for c in ENTRY.split(", ")]
    dealt = kept.select(*columns).withColumn("bucket", bucket_of("cache_key", _buckets(spark, folder)))
    dealt.repartition("bucket").sortWithinPartitions("bucket", "cache_key").write.mode("append").partitionBy("bucket").parquet(f"{folder}/entries")


def cache_entries(spark: SparkSession, folder: str) -> DataFrame:
    schema = f"{ENTRY}, bucket int"
    return spark.read.schema(schema).option("mergeSchema", False).parquet(f"{folder}/entries")


def probe(asked: DataFrame, folder: str, now: Column) -> DataFrame:
    """The rows of ``asked`` (cache_key ...) with ``payload`` of a fresh entry, null where there is none.

    At most one number a bucket comes to the driver, to read those buckets alone.
    """
    spark = asked.sparkSession
    n = _buckets(spark, folder)
    wanted = [r["b"] for r in asked.select(bucket_of("cache_key", n).alias("b")).distinct().collect()]
    entries = cache_entries(spark, folder).filter(F.col("bucket").isin(wanted))
    known = freshness.live_entries(freshness.asked_entries(asked, entries, now), now)
    return asked.join(known.select("cache_key", "payload", F.lit(True).alias("_known")), "cache_key", "left")


@dataclass
class CachedAnswers:
    """Providers that answer from the cache, and note what it lacks."""

    folder: str
    now: Column
    titles: Sequence[str] = ()
    lacking: list[DataFrame] = field(default_factory=list)

    def _asked(self, kind: str, requests: DataFrame, parts: Sequence[str | Column]) -> DataFrame:
        """The requests that have an answer, with ``payload``."""
        keyed = requests.withColumn("cache_key", freshness.cache_key(kind, parts))
        # written, since both what is known and what is not are read from it
        probed = written(probe(keyed, self.folder, self.now), f"asked-{kind}")
        missing = probed.filter(F.col("_known").isNull())
        request = F.to_json(F.struct(*requests.columns))
        self.lacking.append(missing.select(F.lit(kind).alias("kind"), "cache_key", request.alias("request")))
        return probed.filter("_known").drop("_known", "cache_key")

    def search(self, requests: DataFrame) -> DataFrame:
        """(request_key ...) to (request_key, body)."""
        found = self._asked("serper", requests.select("request_key").distinct(), ["request_key"])
        return found.select("request_key", F.col("payload").alias("body"))

    def profiles(self, requests: DataFrame) -> DataFrame:
        found = self._asked("linkedin", requests.select("request_key").distinct(), ["request_key"])
        return found.select("request_key", F.col("payload").alias("body"))

    def sites(self, domains: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(domain) to the domains that were crawled, and their pages (domain, ordinal, url, text)."""
        found = self._asked("scrape", domains, ["domain"])
        pages = found.select("domain", F.explode(F.from_json("payload", PAGES)).alias("p")).select("domain", "p.*")
        return found.select("domain"), pages

    def extractions(self, domains: DataFrame) -> DataFrame:
        found = self._asked("intel", domains, ["domain"])
        return found.select("domain", F.col("payload").alias("body"))

    def directory(self, domains: DataFrame) -> DataFrame:
        """(domain) to its records in query order; the answer depends on the titles asked for."""
        found = self._asked("enrich", domains, ["domain", F.lit(freshness.title_part(self.titles))])
        records = found.select("domain", F.explode(F.from_json("payload", RECORDS)).alias("r"))
        return records.select("domain", "r.*")

    def providers(self, **known: DataFrame) -> Providers:
        """Providers for a tool; ``known`` are the tables that no cache holds (verdicts, redirects)."""
        return Providers(
            search=self.search, profiles=self.profiles, sites=self.sites, extractions=self.extractions, directory=self.directory, **known
        )

    def to_fetch(self) -> DataFrame:
        """(kind, cache_key, request) of all that the tools asked for and the cache lacks, each once."""
        spark = SparkSession.active()
        every = spark.createDataFrame([], TO_FETCH)
        for missing in self.lacking:
            every = every.unionByName(missing)
        return every.dropDuplicates(["cache_key"])


def fetched(to_fetch: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """Entries for ``add_answers`` from answers (cache_key, payload) of what was to be fetched."""
    kind = F.create_map(*[F.lit(x) for pair in freshness.TTL.items() for x in pair])
    asked = to_fetch.select("cache_key", kind[F.col("kind")].alias("ttl_seconds"))
    return answers.join(asked, "cache_key").select("cache_key", "payload", now.alias("written_at"), "ttl_seconds")
