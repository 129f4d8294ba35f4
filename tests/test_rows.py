"""Verdicts, extraction, exports, files, cache and streams on small literal cases."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leadflow.functions.text import natural_key, sanitize
from leadflow.operators import contacts, discover, extract, freshness, listing, results, verify
from leadflow.sources import csv_files
from leadflow.streaming import feeds, limits

GOOD = {"row_index": 1, "match": True, "confidence": 0.9, "reason": "ok", "suggested_domain": None}
ANSWERS = [
    (json.dumps([GOOD]), (1, True, 0.9, None, False)),
    (json.dumps({"results": [{**GOOD, "suggested_domain": ""}]}), (1, True, 0.9, None, False)),
    (json.dumps([{**GOOD, "row_index": "1", "confidence": "0.5", "match": None, "reason": None}]), (1, False, 0.5, None, False)),
    (json.dumps([{**GOOD, "row_index": 1.7, "match": "false", "suggested_domain": "x.com"}]), (1, True, 0.9, "x.com", False)),
    (json.dumps([{k: v for k, v in GOOD.items() if k != "reason"}]), None),
    (json.dumps([{**GOOD, "confidence": "high"}]), None),
    (json.dumps([{**GOOD, "row_index": "1.7"}]), None),
    (json.dumps({"items": [GOOD]}), None),
    ("no json", None),
    ('"text"', None),
    (None, None),
]


@pytest.mark.parametrize("body,want", ANSWERS)
def test_verdict_answers(spark, body, want):
    sent = spark.createDataFrame([(0, 1)], "batch_id int, row_index long")
    got = verify.parse_verdicts(sent, spark.createDataFrame([(0, body)], "batch_id int, body string")).collect()
    want = want or (1, False, 0.0, None, True)
    assert [(r.row_index, r["match"], r.confidence, r.suggested_domain, r.errored) for r in got] == [want]


def test_low_confidence_match_takes_the_suggestion(spark):
    rows = spark.createDataFrame([(i, "raw.com" if i < 4 else None, "searched") for i in range(5)], "row_index long, raw_domain string, status string")
    verdicts = spark.createDataFrame(
        [(0, True, 0.7, None), (1, True, 0.69, "s.com"), (2, True, 0.69, None), (4, True, 0.9, None)], "row_index long, match boolean, confidence double, suggested_domain string"
    )
    got = verify.apply_verdicts(rows, verdicts).orderBy("row_index").collect()
    assert [(r.verified_domain, r.status) for r in got][:4] == [("raw.com", "verified"), ("s.com", "verified"), (None, "not_found"), (None, "searched")]


def test_extraction_overwrites_with_null(spark):
    rows = extract.with_intel_columns(
        spark.createDataFrame([(0, "a.com", "crawled", None, "old", "kept")], "row_index int, raw_domain string, status string, normalized_domain string, industry string, address string")
    )
    answer = extract.parse_extractions(spark.createDataFrame([("a.com", '{"industry": null, "niche": "n"}')], "domain string, body string"))
    got = extract.extract_status(extract.merge_extractions(rows, answer)).first()
    assert (got.industry, got.niche, got.address, got.status, got.normalized_domain) == (None, "n", "kept", "extracted", "a.com")


@pytest.mark.parametrize("cell,want", [("=1", "'=1"), ("+1", "'+1"), ("-1", "'-1"), ("@x", "'@x"), ("\tx", "'\tx"), ("\rx", "'\rx"), ("x=1", "x=1"), ("", ""), (None, None)])
def test_sanitize(spark, cell, want):
    assert spark.createDataFrame([(cell,)], "c string").select(sanitize("c").alias("s")).first().s == want


def test_natural_order(spark):
    cells = ["row 10", "row 9", "Row 2", "row 02b", "a", "row 123456789012345678901234567890", "10", "9"]
    got = [r.c for r in spark.createDataFrame([(c,) for c in cells], "c string").orderBy(natural_key("c")).collect()]
    assert got == ["9", "10", "a", "Row 2", "row 02b", "row 9", "row 10", "row 123456789012345678901234567890"]


def test_csv_in_counts_skipped_rows_and_ignores_bom(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes("﻿company,location\nStripe, San Francisco \n  ,x\n\"A, \"\"B\"\"\nC\",\nMonzo\n".encode())
    got = csv_files.csv_company_rows(spark, str(path), "company", "location").orderBy("row_index").collect()
    assert [(r.row_index, r.company_name, r.location) for r in got] == [(0, "Stripe", "San Francisco"), (2, 'A, "B"\nC', None), (3, "Monzo", None)]
    assert [r.row_index for r in csv_files.csv_company_rows(spark, str(path), "company", max_rows=2).collect()] == [0, 2]


def test_csv_out_bytes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", 'say "hi"'), (0, "a, x", ""), (2, "é", None)], "row_index int, name string, note string")
    csv_files.csv_sink(rows, str(tmp_path / "out"), single_file=True)
    [part] = Path(tmp_path / "out").glob("part-*.txt")
    assert part.read_bytes().decode() == '﻿name,note\r\n"a, x",\r\nb,"say ""hi"""\r\né,\r\n'


def test_csv_out_keeps_line_breaks_and_contact_order(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, 0, "A\nB"), (0, 1, "second"), (0, 0, "first\r\nline, with \r and \"q\""), (1, 1, " spaced ")], "row_index int, contact_no int, note string"
    )
    csv_files.csv_sink(rows, str(tmp_path / "one"), single_file=True)
    [part] = Path(tmp_path / "one").glob("part-*.txt")
    want = '﻿note\r\n"first\r\nline, with \r and ""q"""\r\nsecond\r\n"A\nB"\r\n spaced \r\n'
    assert part.read_bytes().decode() == want
    csv_files.csv_sink(rows.limit(0), str(tmp_path / "none"))
    assert b"".join(p.read_bytes() for p in Path(tmp_path / "none").glob("part-*.txt")).decode() == "﻿note\r\n"


def test_pasted_text_delimiter(spark, tmp_path):
    assert csv_files.paste_delimiter("a\tb,c") == "\t" and csv_files.paste_delimiter("a,b,c\td") == ","
    (tmp_path / "p.txt").write_text("a, b ,c\n1,2,3\n\n4,5,6\n")
    got = csv_files.paste_rows(spark, str(tmp_path / "p.txt"))
    assert got.columns == ["a", "b", "c"] and got.count() == 2


def test_progress_counts_empty_lists(spark):
    rows = spark.createDataFrame([("j", "d", []), ("j", None, None), ("j", "e", [1])], "job_id string, normalized_domain string, contacts array<int>")
    assert tuple(results.progress_counts(rows).first()) == ("j", 3, 2, 2)


def test_purge_stops_at_the_colon(spark):
    cache = spark.createDataFrame([("g2_cat:1",), ("g2_cat_scrape_v3:1",)], "cache_key string")
    assert [r.cache_key for r in freshness.cache_purge(cache, ["g2_cat"]).collect()] == ["g2_cat_scrape_v3:1"]
    assert freshness.title_part(["CTO", "ceo"]) == "ceo, cto"


def test_empty_answers_are_not_stored(spark):
    c = spark.createDataFrame([("k", "old", "2024-01-01", 60)], "cache_key string, payload string, written_at string, ttl_seconds int")
    new = spark.createDataFrame([("k", "{}", "2024-01-02", 60), ("n", "v", "2024-01-02", 60)], c.schema)
    at = lambda df: df.withColumn("written_at", F.col("written_at").cast("timestamp"))
    assert {r.cache_key: r.payload for r in freshness.cache_write(at(c), at(new)).collect()} == {"k": "old", "n": "v"}


def test_listing_fallback_marks(spark):
    html = """<div data-product-id="1"><h3><a href="https://www.g2.com/products/acme/reviews">Acme</a></h3><span class="star-wrapper__value">4.2</span> (1,234)
      <a href="https://x.com/visit_website?url=https%3A%2F%2Fwww.acme.com%2F">go</a></div><div data-product-id="2"><h3><a href="/sellers/x">No slug</a></h3></div>
      <a aria-label="Page 7" href="?page=7">7</a>"""
    df = spark.createDataFrame([("c", 1, html), ("c", 2, "<p>empty</p>")], "category string, page int, html string")
    [p] = listing.listing_products(df).collect()
    assert (p.name, p.slug, p.website, p.rating, p.review_count) == ("Acme", "acme", "acme.com", 4.2, 1234)
    assert {r.page: (r.page_count, r.n_cards) for r in listing.listing_page_count(df).collect()} == {1: (7, 2), 2: (1, 0)}


def test_listing_stops_where_nothing_is_new(spark):
    def run(pages, cap=250):
        rows = [("c", p, i, s, s) for p, (slugs, _) in enumerate(pages, 1) for i, s in enumerate(slugs)]
        products = spark.createDataFrame(rows, "category string, page int, pos int, slug string, name string")
        fetched = spark.createDataFrame([("c", p, n) for p, (_, n) in enumerate(pages, 1)], "category string, page int, page_count int")
        return [r.slug for r in discover.listing_merge_pages(products, fetched, cap).orderBy("page", "pos").collect()]

    assert run([("ab", 1), ("ab", 1), ("cd", 1)]) == ["a", "b"]
    assert run([("ab", 1), ("bc", 1), ("de", 1)]) == ["a", "b", "c", "d", "e"]
    assert run([("ab", 2), ("c", 2), ("d", 2)]) == ["a", "b", "c"]
    assert run([("ab", 1), ("", 1), ("d", 1)]) == ["a", "b"]
    assert run([("ab", 1), ("cd", 1), ("ef", 1)], cap=3) == ["a", "b"]  # the cap allows one page
    assert run([("ab", 1), ("cd", 1), ("ef", 1)], cap=16) == ["a", "b", "c", "d"]
    assert len(run([("".join(chr(97 + i) for i in range(20)), 1), ("xyz", 1)], cap=17)) == 17
    assert run([("", 1), ("ab", 1)]) == []


def test_status_changes_over_slots(spark):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    seen = [(0, "a"), (1, "a"), (30, "b"), (31, None), (200, None), (201, "b")]
    rows = [(i, 7, start + dt.timedelta(hours=h), s) for i, (h, s) in enumerate(seen)]
    got = feeds.status_changes(spark.createDataFrame(rows, "event_id int, row_index int, ts timestamp, status string")).collect()
    assert sorted((r.event_id, r.previous_status, r.status) for r in got) == [(2, "a", "b"), (3, "b", None), (5, None, "b")]


def test_limit_state_lives_across_micro_batches(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rows = [(i, f"c{i % 3}", start + dt.timedelta(seconds=7 * i)) for i in range(90)]
    schema = "event_id long, client string, ts timestamp"
    for n in range(3):
        spark.createDataFrame(rows[n * 30:(n + 1) * 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = limits.sliding_limit_stream(stream, "client", 2, seconds=60, delay="1 day")
    run = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    run.trigger(availableNow=True).start().awaitTermination()
    got = {r.event_id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = limits.sliding_limits(spark.createDataFrame(rows, schema), 2, 60)
    assert got == {r.event_id: r.allowed for r in batch.collect()}


def test_helpers_travel_with_their_job(spark):
    from pyspark import cloudpickle

    blob = cloudpickle.dumps(contacts._letters)
    assert b"NFKD" in blob and len(blob) > 200
