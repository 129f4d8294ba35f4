"""Answers of outside services: one per key, and nothing behind the JSON."""

import pytest
from pyspark.sql import functions as F

from leadflow.functions.text import strict_json
from leadflow.operators import discover, extract, verify

BODIES = {
    "[1]": True, " [1] ": True, '{"a":1}': True, "1": True, "[1] thanks": False, '{"a":1}] junk': False, '{"a":1} xyz': False, "[1],2": False,
    "[1]],[0": False, "": False, "no": False, "[1": False, '{"a":1},{"b":2}': False, "null": True,
}


def test_strict_json(spark):
    df = spark.createDataFrame([*[(b,) for b in BODIES], (None,)], "body string")
    assert {r.body: r.ok for r in df.select("body", strict_json("body").isNotNull().alias("ok")).collect()} == BODIES | {None: False}


def test_text_behind_an_answer_is_refused(spark):
    bodies = [(0, '[{"item_index": 0}] thanks'), (1, '[{"item_index": 0}]')]
    funding = spark.createDataFrame(bodies, "batch_id int, body string")
    assert [r.batch_id for r in discover.parse_funding_responses(funding).collect()] == [1]
    assert discover.dropped_batches(funding).first().dropped == 1
    search = spark.createDataFrame([("a", '{"organic": []} xyz'), ("b", '{"organic": []}')], "request_key string, body string")
    assert {r.request_key: r.results for r in discover.parse_search_responses(search).collect()} == {"a": None, "b": []}
    intel = spark.createDataFrame([("a", '{"industry":"x"} xyz'), ("b", '{"industry":"x"}')], "domain string, body string")
    assert {r.domain: r.present for r in extract.parse_extractions(intel).collect()} == {"a": [], "b": ["industry"]}


def entry(row, match=True, conf=0.9):
    return f'{{"row_index": {row}, "match": {str(match).lower()}, "confidence": {conf}, "reason": "r"}}'


def test_verdicts_of_rows_that_were_sent(spark):
    sent = spark.createDataFrame([(0, 1), (0, 2), (1, 30), (10, 201)], "batch_id int, row_index int")
    bodies = [
        (0, f"[{entry(1)}, {entry(2)}, {entry(2, False, 0.1)}, {entry(77)}, {entry(201)}]"),  # 77 never sent, 201 in another block
        (1, f"[{entry(30)}, {entry(1, False, 0.2)}]"),  # later batch of the block
        (10, f"[{entry(201)}] done"),
    ]
    got = verify.parse_verdicts(sent, spark.createDataFrame(bodies, "batch_id int, body string")).collect()
    assert sorted((r.row_index, r.match, r.errored) for r in got) == [(1, False, False), (2, False, False), (30, True, False), (201, False, True)]


@pytest.mark.parametrize("apply", [verify.apply_verdicts, verify.apply_verdicts_intel])
def test_repeated_verdicts_do_not_multiply_rows(spark, apply):
    rows = spark.createDataFrame([(1, "a.com", "searched", "name")], "row_index int, raw_domain string, status string, input_type string")
    verdicts = spark.createDataFrame(
        [(1, False, 0.0, "x", None, True), (1, True, 0.9, "x", None, False), (1, False, 0.2, "x", None, False)],
        "row_index long, match boolean, confidence double, reason string, suggested_domain string, errored boolean",
    )
    assert [(r.status, r.raw_domain) for r in apply(rows, verdicts).collect()] == [("verified", "a.com")]


def test_repeated_answers_do_not_multiply_rows(spark):
    rows = spark.createDataFrame([(0, "Acme", "")], "row_index int, company_name string, location string")
    answers = spark.createDataFrame(
        [("acme|", "no json"), ("acme|", '{"organic": [{"link": "https://a.com"}]}'), ("acme|", '{"organic": []}')], "request_key string, body string"
    )
    found = discover.fan_out_search(rows, discover.parse_search_responses(answers)).collect()
    assert len(found) == 1 and found[0].search_results is not None
    people = spark.createDataFrame([("Ann", "Acme")], "full_name string, company_name string")
    profiles = spark.createDataFrame([("ann|acme", "u1", 0.5), ("ann|acme", "u2", 0.8)], "request_key string, linkedin_url string, confidence double")
    assert [r.linkedin_url for r in discover.fan_out_profiles(people, profiles).collect()] == ["u2"]
    crawled = extract.with_intel_columns(spark.createDataFrame([("a.com", "crawled", None)], "raw_domain string, status string, normalized_domain string"))
    intel = extract.parse_extractions(spark.createDataFrame([("a.com", "{}"), ("a.com", '{"industry":"x"}')], "domain string, body string"))
    assert [r.industry for r in extract.merge_extractions(crawled, intel).withColumn("n", F.lit(1)).collect()] == ["x"]
