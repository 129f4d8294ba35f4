"""Verification operators over the given tables."""

from pyspark.sql import functions as F

from leadflow.catalog.base import firm_answers, firms, query, text, view
from leadflow.operators import discover, verify

# rows after the search: candidate and results per row
view(
    "searched",
    """SELECT f.row_index, f.k, f.company_name, f.location, nullif(coalesce(a.candidate, ''), '') AS raw_domain, coalesce(a.n_results, 0) AS n_results
       FROM firms f LEFT JOIN firm_answers a ON a.k = f.k""",
    ("firms", "firm_answers"),
)


def searched(spark, d):
    out = discover.fan_out_search(firms(spark, d), discover.parse_search_responses(firm_answers(spark, d)))
    return out.withColumn("raw_domain", F.when(F.col("candidate_domain") != "", F.col("candidate_domain"))).withColumn(
        "status", F.lit("searched")
    ).drop("candidate_domain")


@query(
    "verify_items",
    "SELECT row_index, company_name, location, raw_domain AS candidate_domain, n_results::INTEGER AS n_results FROM searched WHERE raw_domain IS NOT NULL",
    ("searched",),
)
def verify_items(spark, d):
    return verify.verify_items(searched(spark, d)).withColumn("n_results", F.size("results")).drop("results")


# mixed inputs: every fourth row is a URL, the others are firm names
view(
    "mixed",
    """SELECT row_index, k, CASE WHEN row_index % 4 = 1 THEN 'url' ELSE 'name' END AS input_type,
       CASE WHEN row_index % 4 = 1 THEN CASE WHEN row_index % 8 = 1 THEN 'HTTPS://www.Site' || k || '.example.org:8080/a?b' ELSE ' / ' END ELSE company_name END AS input,
       location, raw_domain AS candidate, n_results FROM searched""",
    ("searched",),
)
view(
    "resolved",
    """SELECT row_index, k, input_type, input, location, CASE WHEN input_type = 'name' THEN n_results ELSE 0 END AS n_results,
       CASE WHEN input_type = 'name' THEN candidate WHEN row_index % 8 = 1 THEN 'site' || k || '.example.org:8080' END AS raw_domain
       FROM mixed""",
    ("mixed",),
)


def mixed(spark, d):
    r = F.col("row_index")
    url = r % 4 == 1
    return firms(spark, d).select(
        "row_index", F.when(url, "url").otherwise("name").alias("input_type"),
        F.when(url & (r % 8 == 1), text("HTTPS://www.Site", ":k", ".example.org:8080/a?b")).when(url, " / ").otherwise(F.col("company_name")).alias("input"),
        F.lit("").alias("company_name"), "location",
    )


def resolved(spark, d):
    rows = mixed(spark, d)
    names = rows.filter(F.col("input_type") == "name").withColumn("company_name", F.col("input"))
    found = discover.fan_out_search(names, discover.parse_search_responses(firm_answers(spark, d)))
    return verify.resolve_rows(rows, found)


@query(
    "resolve_rows",
    "SELECT row_index, input_type, input, location, raw_domain, n_results::INTEGER AS n_results, 'resolved' AS status FROM resolved",
    ("resolved",),
)
def resolve_rows(spark, d):
    n = F.coalesce(F.size("search_results.results"), F.lit(0))
    return resolved(spark, d).withColumn("n_results", F.greatest(n, F.lit(0))).drop("search_results", "company_name")


@query(
    "verify_items_intel",
    "SELECT row_index, input AS company_name, location, raw_domain AS candidate_domain FROM resolved WHERE raw_domain IS NOT NULL AND input_type = 'name'",
    ("resolved",),
)
def verify_items_intel(spark, d):
    return verify.verify_items_intel(resolved(spark, d)).drop("results")


def batches_view(name: str, source: str, condition: str) -> None:
    """Batches of 20 inside blocks of 200 rows, and what each row's verdict will be."""
    view(
        name,
        f"""SELECT *, (row_index // 200) * 10 + (n - 1) // 20 AS batch_id FROM (
            SELECT *, row_number() OVER (PARTITION BY row_index // 200 ORDER BY row_index) AS n FROM {source} WHERE {condition})""",
        (source,),
    )


batches_view("item_batches", "searched", "raw_domain IS NOT NULL")
batches_view("intel_batches", "resolved", "raw_domain IS NOT NULL AND input_type = 'name'")


@query(
    "verify_batches",
    """SELECT batch_id, count(*) AS n_items, string_agg('- row_index=' || row_index || ' | company="' || company_name || '" | location="' || location ||
       '" | candidate_domain="' || raw_domain || '"' || array_to_string(list_transform(range(1, least(n_results, 3) + 1), lambda i:
         chr(10) || '    result_' || i || ': domain="firm' || k || '-' || i || '.com" | title="Firm ' || k || ' site ' || i || '" | snippet="about firm ' || k || '"'), ''),
       chr(10) ORDER BY row_index) AS items FROM item_batches GROUP BY batch_id""",
    ("item_batches",),
)
def verify_batches(spark, d):
    return verify.verify_batches(verify.verify_items(searched(spark, d)))


def verdict_answers(items, number="row_index"):
    """One answer per batch: a list, an object, garbage, or one entry without a reason; ``number`` is the row it names."""
    r, shown = F.col("row_index"), F.col(number)
    entry = F.concat(
        text('{"row_index": ', F.when(r % 5 == 0, text('"', shown, '"')).otherwise(shown.cast("string")), ', "match": ', F.when(r % 2 == 0, "true").otherwise("false"),
             ', "confidence": ', (r % 100) / 100.0, F.when((F.col("batch_id") % 9 == 2) & (F.col("_n") == 3), "").otherwise(', "reason": "seen"'),
             ', "suggested_domain": ', F.when(r % 7 == 0, text('"alt', r, '.example.org"')).when(r % 7 == 1, '""').otherwise("null"), "}"),
    )
    from pyspark.sql import Window

    numbered = items.withColumn("_n", F.row_number().over(Window.partitionBy("batch_id").orderBy("row_index")))
    listed = F.array_join(F.array_sort(F.collect_list(entry)), ",")  # 20 entries per batch
    b = F.col("batch_id")
    body = (
        F.when(b % 5 == 0, F.lit("Sorry, no JSON")).when(b % 5 == 1, F.concat(F.lit('{"results": ['), "_l", F.lit("]}")))
        .when(b % 5 == 4, F.concat(F.lit('{"items": ['), "_l", F.lit("]}"))).otherwise(F.concat(F.lit("["), "_l", F.lit("]")))
    )
    return numbered.groupBy("batch_id").agg(listed.alias("_l")).filter(b % 11 != 3).select("batch_id", body.alias("body"))


def verdict_sql(source: str) -> str:
    bad = "(batch_id % 5 IN (0, 4) OR batch_id % 11 = 3 OR (batch_id % 9 = 2 AND size >= 3))"
    return f"""SELECT row_index, CASE WHEN {bad} THEN false ELSE row_index % 2 = 0 END AS match,
        CASE WHEN {bad} THEN 0.0 ELSE (row_index % 100) / 100.0::DOUBLE END AS confidence,
        CASE WHEN {bad} THEN 'LLM call failed or response could not be parsed.' ELSE 'seen' END AS reason,
        CASE WHEN NOT {bad} AND row_index % 7 = 0 THEN 'alt' || row_index || '.example.org' END AS suggested_domain, {bad} AS errored
        FROM (SELECT *, count(*) OVER (PARTITION BY batch_id) AS size FROM {source})"""


view("verdicts", verdict_sql("item_batches"), ("item_batches",))
view("intel_verdicts", verdict_sql("intel_batches"), ("intel_batches",))


def verdicts(items):
    numbered = verify.number_batches(items).select("batch_id", "row_index")
    return verify.parse_verdicts(numbered, verdict_answers(numbered))


@query("parse_verdicts", "SELECT * FROM verdicts", ("verdicts",))
def parse_verdicts(spark, d):
    return verdicts(verify.verify_items(searched(spark, d)))


view(
    "verified",
    """SELECT s.row_index, s.company_name, s.location, s.raw_domain, v.confidence AS verification_confidence,
       CASE WHEN v.match AND v.confidence >= 0.7 THEN s.raw_domain ELSE v.suggested_domain END AS verified_domain,
       CASE WHEN (v.match AND v.confidence >= 0.7) OR v.suggested_domain IS NOT NULL THEN 'verified' ELSE 'not_found' END AS status
       FROM searched s LEFT JOIN verdicts v ON v.row_index = s.row_index""",
    ("searched", "verdicts"),
)


def verified(spark, d):
    rows = searched(spark, d)
    return verify.apply_verdicts(rows, verdicts(verify.verify_items(rows)))


@query("apply_verdicts", "SELECT * FROM verified", ("verified",))
def apply_verdicts(spark, d):
    return verified(spark, d).drop("search_results", "k")


view(
    "intel_verified",
    """SELECT r.row_index, r.input_type, r.input, r.location, v.confidence AS verification_confidence,
       CASE WHEN v.row_index IS NULL OR (v.match AND v.confidence >= 0.7) THEN r.raw_domain ELSE v.suggested_domain END AS raw_domain,
       CASE WHEN r.raw_domain IS NULL THEN 'not_found' WHEN v.row_index IS NULL THEN 'resolved'
            WHEN (v.match AND v.confidence >= 0.7) OR v.suggested_domain IS NOT NULL THEN 'verified' ELSE 'not_found' END AS status
       FROM resolved r LEFT JOIN intel_verdicts v ON v.row_index = r.row_index""",
    ("resolved", "intel_verdicts"),
)


def intel_verified(spark, d):
    rows = resolved(spark, d)
    return verify.apply_verdicts_intel(rows, verdicts(verify.verify_items_intel(rows)))


@query("apply_verdicts_intel", "SELECT * FROM intel_verified", ("intel_verified",))
def apply_verdicts_intel(spark, d):
    return intel_verified(spark, d).drop("search_results", "company_name")
