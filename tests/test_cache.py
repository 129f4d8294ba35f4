"""The bucketed cache, and tools that ask it before they fetch."""

import datetime as dt

from pyspark.sql import functions as F

from leadflow.catalog import tools as flows
from leadflow.functions.workspace import workspace
from leadflow.plans import cache, tools

SF = "/root/testdata/sf0.001"
AT = dt.datetime(2026, 1, 1)


def stored(spark, entries, buckets=8):
    folder = cache.create_cache(spark, workspace(spark, "cache-test"), buckets)
    for some in entries:
        cache.add_answers(spark.createDataFrame(some, cache.ENTRY), folder)
    return folder


def asked(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "cache_key string")


def answers(df):
    return {r.cache_key: r.payload if r._known else "?" for r in df.collect()}


def test_newest_fresh_entry_counts(spark):
    hour, now = dt.timedelta(hours=1), F.lit("2026-01-01 00:00:00").cast("timestamp")
    first = [("serper:a", "old", AT - 3 * hour, 36_000), ("serper:b", "stale", AT - 3 * hour, 3_600), ("serper:c", "later", AT + hour, 3_600)]
    then = [("serper:a", "new", AT - hour, 36_000), ("scrape:d", "[]", AT, 60), ("serper:e", "", AT, 60), ("serper:f", None, AT, 60)]
    folder = stored(spark, [first, then])
    want = {"serper:a": "new", "serper:b": "?", "serper:c": "?", "scrape:d": "?", "serper:e": "", "serper:f": "?"}
    assert answers(cache.probe(asked(spark, want), folder, now)) == want
    assert answers(cache.probe(asked(spark, []), folder, now)) == {}


def test_a_probe_reads_its_buckets_alone(spark):
    keys = [f"serper:{i}" for i in range(400)]
    folder = stored(spark, [[(k, k, AT, 60) for k in keys]], buckets=32)
    found = cache.probe(asked(spark, keys[:2]), folder, F.lit(AT))
    assert answers(found) == {k: k for k in keys[:2]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    used = {r.b for r in asked(spark, keys[:2]).select(cache.bucket_of("cache_key", 32).alias("b")).collect()}
    entries = cache.cache_entries(spark, folder).filter(F.col("bucket").isin(list(used)))
    assert entries.select(F.input_file_name()).distinct().count() == len(used) < 3  # of some thirty files


def test_company_intel_over_the_cache(spark):
    rows = flows.written(flows.company_rows(spark, SF), "rows").filter("row_index < 60")
    p = flows.with_verdicts(flows.intel_providers(spark, SF), rows, spark, SF)
    p = flows.replace(p, verdicts=flows.written(p.verdicts, "verdicts"))
    done, lacked = flows.over_cache(
        spark, SF, p, lambda cached: tools.company_intel(rows, cached, flows.OPTIONS, titles=flows.WANTED), 5
    )
    want = flows.intel_columns(tools.company_intel(rows, p, flows.OPTIONS, titles=flows.WANTED)).collect()
    assert sorted(map(repr, flows.intel_columns(done).collect())) == sorted(map(repr, want))
    kinds = [{r.kind: r["count"] for r in some.groupBy("kind").count().collect()} for some in lacked]
    assert set(kinds[0]) == {"serper", "scrape"}  # the sites of rows that came as addresses
    # in the end only requests are left that no service answers, or whose answers are empty and not kept
    rest = {(r.kind, r.request) for r in lacked[-1].collect()}
    served = flows.served(spark, SF, lacked[-1], p).filter("payload NOT IN ('{}', '[]')")
    assert served.join(lacked[-1].select("cache_key"), "cache_key").count() == 0 and rest < {(r.kind, r.request) for f in lacked for r in f.collect()}
