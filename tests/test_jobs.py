"""Several jobs in one table: their rows have equal numbers."""

import json

from pyspark.sql import functions as F

from leadflow.operators import contacts, domains, results, verify
from leadflow.plans import tools
from leadflow.plans.stages import Providers, lazy

KEY = ("job_id", "row_index")


def verdict(row, match, suggested=None):
    return {"row_index": row, "match": match, "confidence": 0.9, "reason": "r", "suggested_domain": suggested}


def test_website_finder_over_jobs(spark):
    rows = [(j, i, f"Firm {j}-{i}", "") for j in ("a", "b", "c") for i in range(3)]
    search = [(f"firm {j}-{i}|", json.dumps({"organic": [{"link": f"https://{j}{i}.com"}]})) for j in ("a", "b", "c") for i in range(3)]
    answers = [
        ("a", 0, json.dumps([verdict(i, True) for i in range(3)])),
        ("b", 0, json.dumps([verdict(0, False, "other.com"), verdict(1, False), verdict(2, True)])),
        ("c", 0, "no json"),
    ]
    p = Providers(
        search=spark.createDataFrame(search, "request_key string, body string"),
        verdicts=spark.createDataFrame(answers, "job_id string, batch_id int, body string"),
        redirects=spark.createDataFrame([], "domain string, final_url string"),
    )
    found = tools.website_finder(spark.createDataFrame(rows, "job_id string, row_index long, company_name string, location string"), p, stage=lazy, key=KEY)
    want = {("a", 0): "a0.com", ("a", 1): "a1.com", ("a", 2): "a2.com", ("b", 0): "other.com", ("b", 1): None, ("b", 2): "b2.com"}
    want |= {("c", i): None for i in range(3)}
    got = found.collect()
    assert len(got) == 9 and {(r.job_id, r.row_index): r.normalized_domain for r in got} == want
    assert results.export_websites(found, KEY).columns[:2] == list(KEY)


def test_batches_of_each_job(spark):
    items = spark.range(250).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("job_id"), F.col("id").alias("row_index"))
    items = items.filter("job_id = 1 OR row_index % 2 = 0")
    sizes = verify.number_batches(items, key=KEY).groupBy("job_id", "batch_id").count().collect()
    assert max(r["count"] for r in sizes) == 20 and {r.batch_id for r in sizes if r.job_id == 2} == {0, 1, 2, 3, 4, 10, 11}
    asked = verify.number_batches(items, key=KEY).select(*KEY, "batch_id")
    none = spark.createDataFrame([], "job_id int, batch_id int, body string")
    assert verify.parse_verdicts(asked, none, key=KEY).filter("errored").count() == 250 + 125


def test_outcomes_and_persons_of_each_job(spark):
    rows = spark.createDataFrame([(j, 0, f"{j}.com") for j in ("a", "b")], "job_id string, row_index int, verified_domain string")
    rows = rows.withColumns({"raw_domain": F.col("verified_domain"), "normalized_domain": F.lit(None).cast("string"), "status": F.lit("verified")})
    outcomes = domains.normalize_with_redirects(rows, spark.createDataFrame([], "domain string, final_url string"), key=KEY)
    got = domains.apply_normalized(rows, outcomes, KEY).collect()
    assert sorted((r.job_id, r.normalized_domain) for r in got) == [("a", "a.com"), ("b", "b.com")]
    looked_up = spark.createDataFrame([("a", 0, ("Ann",))], "job_id string, row_index int, contact struct<first_name:string>")
    looked_up = looked_up.withColumn("contact", F.from_json(F.to_json("contact"), contacts.schemas.CONTACT))
    people = contacts.apply_person_contacts(rows, looked_up, KEY).collect()
    assert sorted((r.job_id, r.status, len(r.contacts)) for r in people) == [("a", "enriched", 1), ("b", "verified", 0)]
