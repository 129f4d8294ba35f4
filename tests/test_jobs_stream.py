"""Finished jobs, limits by kind on a stream, paging, refusals, illegal steps."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from leadflow.functions import fixed
from leadflow.operators import entities, ingest, results
from leadflow.streaming import feeds, limits

START = dt.datetime(2024, 1, 1)


def fed(spark, path, batches, schema):
    """A stream that brings each list of rows as a micro-batch."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def run(out, path):
    writer = out.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query, out.sparkSession.read.parquet(f"{path}/out")


def test_state_of_finished_jobs_ends(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    row = lambda job, minutes, status, domain="d", contacts=None: (job, at(minutes), domain, contacts, status)
    batches = [
        [row("a", 0, "enriching"), row("a", 5, "enriching", None), row("b", 5, "enriching", "d", [1])],
        [row("a", 6, "completed", "d", [1]), row("a", 60, "enriching"), row("a", 67, "late"), row("c", 7, "failed", None)],
        [row("b", 400, "enriching"), (None, None, None, None, "completed")],
        [row("b", 900, "completed"), row("a", 890, "after its end")],
        [row("a", 901, "enriching")],
        [row("z", 3000, "enriching")],
        [row("z", 3001, "enriching")],
    ]
    stream = fed(spark, tmp_path, batches, "job_id string, ts timestamp, normalized_domain string, contacts array<int>, job_status string")
    query, out = run(feeds.finished_jobs(stream, grace="1 hour", idle="1 day", delay="10 minutes"), tmp_path)
    got = sorted(tuple(r) for r in out.collect())
    assert got == [
        ("a", 1, 1, 0, False, None), ("a", 4, 3, 1, True, "completed"), ("b", 3, 3, 1, True, "completed"), ("c", 1, 0, 0, True, "failed"),
    ]
    state = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert max(state) > state[-1]  # only the running job is left


def test_limits_by_kind_on_a_stream(spark, tmp_path):
    rows = [
        (i, None if i % 10 == 9 else f"x{i % 2}", "ip" if i % 3 else "email", "upload" if i % 5 else "other", START + dt.timedelta(minutes=i))
        for i in range(120)
    ]
    schema = "event_id long, identifier string, identifier_type string, action string, ts timestamp"
    table = spark.createDataFrame([("ip", "upload", 3), ("email", "upload", 1)], "identifier_type string, action string, `limit` int")
    stream = fed(spark, tmp_path, [rows[:40], rows[40:45], rows[45:]], schema)
    _, out = run(limits.daily_limit_stream(stream, limits=table, seconds=1800), tmp_path)
    state, want = {}, {}
    for i, who, kind, action, ts in rows:
        size = {("ip", "upload"): 3, ("email", "upload"): 1}.get((kind, action))
        rule = state.setdefault((who, kind, action), limits.Daily(size, 1800 * limits.MICROS)) if size else None
        want[i] = rule.accept(round(ts.timestamp() * 1e6)) if rule else True
    assert {r.event_id: r.allowed for r in out.collect()} == want
    assert out.columns == ["identifier", "identifier_type", "action", "event_id", "allowed"]


def test_deep_pages_read_few_files(spark, tmp_path):
    rows = spark.range(2000).select(
        F.col("id").alias("row_index"), F.concat(F.lit("c"), "id").alias("company_name"), F.lit("x").alias("location"), F.lit("d").alias("normalized_domain"),
        F.lit("v").alias("verified_domain"), F.lit(0.5).alias("verification_confidence"), F.when(F.col("id") % 7 == 0, "pending").otherwise("found").alias("status"),
    )
    folder = results.write_preview(rows, f"{tmp_path}/preview", ranges=40)
    files = len(spark.read.parquet(f"{folder}/rows").inputFiles())
    for offset, limit in ((0, 50), (1540, 50), (1700, 50), (1713, 50), (10**6, 50), (700, 300)):
        want = results.preview_page(rows, limit, offset).collect()
        page = results.preview_stored(spark, folder, limit, offset)
        assert page.collect() == want
        if want:
            plan = page._jdf.queryExecution().executedPlan().toString()
            listed = re.search(r"PartitionFilters: \[[^]]*_range#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
            read = (listed[1] or listed[2]).split(",")
            assert len(read) <= 0.05 * files + limit // 40
    none = results.write_preview(rows.limit(0), f"{tmp_path}/none")
    assert results.preview_stored(spark, none).collect() == []


def test_plans_beyond_their_limits_are_refused_when_they_run(spark):
    terms = spark.createDataFrame([(f" t{i} " if i else " ",) for i in range(6)], "term string")
    plan = lambda **kw: ingest.maps_search_plan(terms, " Austin ", **kw)
    assert sorted(map(tuple, plan(max_per_search=10, limits=ingest.SearchLimits(5, 10, 50)).collect())) == [(f"t{i}", "Austin") for i in range(1, 6)]
    for per, limit, why in ((10, (4, 10, 50), "at most 4"), (11, (5, 10, 100), "between 1 and 10"), (0, (5, 10, 50), "between 1 and 10"), (10, (5, 10, 49), "more than 49")):
        refused = plan(max_per_search=per, limits=ingest.SearchLimits(*limit))  # nothing is counted yet
        with pytest.raises(Exception, match=why):
            refused.collect()
    pairs = spark.createDataFrame([("a ", " x"), ("b", "y")], "term string, location string")
    assert sorted(map(tuple, ingest.maps_search_plan(terms, "Austin", pairs).collect())) == [("a", "x"), ("b", "y")]
    with pytest.raises(ingest.PlanError, match="provide"):
        ingest.maps_search_plan(terms, " ")


def test_illegal_steps_are_named(spark):
    flows = {
        1: ["pending", "searched", "searched", "verified", "normalized", "enriched"], 2: ["searched", "verified"], 3: ["pending", "normalized"],
        4: ["pending", "searched", None, "verified"], 5: ["pending", "crawled"], 6: [], 7: ["gone"],
    }
    rows = [(100 * k + i, k, START + dt.timedelta(days=i), s) for k, flow in flows.items() for i, s in enumerate(flow)]
    history = spark.createDataFrame(rows, "event_id long, row_index long, ts timestamp, status string")
    got = {(r.event_id, r.problem) for r in entities.row_status_flow(history, fixed.WEBSITE_STEPS).collect()}
    assert got == {
        (200, "begins elsewhere"), (301, "illegal step"), (402, "unknown status"), (403, "illegal step"), (501, "unknown status"), (700, "unknown status"),
    }
