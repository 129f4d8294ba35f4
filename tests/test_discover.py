import random

import pandas as pd
from pyspark.sql import functions as F

from leadflow.functions.tables import cap_per_key, dense_index, first_per_key
from leadflow.operators import discover, ingest


def lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_index long, line string")


def parsed(spark, texts):
    out = ingest.people_lines(lines(spark, texts)).orderBy("row_index").collect()
    return [(r.full_name, r.company_name) if r.ok else None for r in out]


def test_people_lines_by_comma(spark):
    assert parsed(spark, ["Fred Smith, Apple, Inc.", "", "no separator", "Ann Lee,IBM", ", X"]) == [
        ("Fred Smith", "Apple, Inc."), None, ("Ann Lee", "IBM"), None
    ]


def test_people_lines_by_bar_and_dash(spark):
    assert parsed(spark, ["A B | C, D", "E F | G", "K | L", "H I, J", "nothing"]) == [("A B", "C, D"), ("E F", "G"), ("K", "L"), ("H I", "J"), None]
    assert parsed(spark, ["A B - C", "D E - F - G"]) == [("A B", "C"), ("D E", "F - G")]
    errors = ingest.people_line_errors(ingest.people_lines(lines(spark, ["x", "y", "A B, C"]))).first()
    assert (errors["items"], errors["errors"]) == (1, 2)


def test_classify_inputs_and_quick_rule(spark):
    texts = ["https://x", "acme.com", "Acme Inc.", "a.b.com", "Acme", "acme.co.uk/x", "acme.unknowntld"]
    df = lines(spark, texts)
    got = [r.input_type for r in ingest.classify_inputs(df).orderBy("row_index").collect()]
    assert got == ["url", "url", "name", "url", "name", "url", "name"]
    quick = [r.t for r in df.orderBy("row_index").select(ingest.loose_line_type("line").alias("t")).collect()]
    assert quick == ["url", "url", "name", "name", "name", "name", "url"]


def test_column_mapping():
    assert ingest.company_columns(["Name", "Organization", "HQ city"]) == ("Organization", "HQ city")
    assert ingest.company_columns(["state company", "x"]) == ("state company", "")
    assert ingest.people_columns(["First Name", "Last Name", "Contact", "Firm", "URL"])["full_name"] == "Contact"
    assert ingest.intel_column(["Company", "My Website"]) == "My Website"
    assert ingest.intel_column(["a", "b"]) == "a"


def test_maps_pairs_one_or_many_places(spark):
    schema = "row_index int, keyword string, city string"
    one = ingest.maps_pairs_from_csv(spark.createDataFrame([(0, "cafe", "Rome"), (1, "bar", " "), (2, "", "Rome")], schema))
    assert [(r.search_term, r.location) for r in one.orderBy("row_index").collect()] == [("cafe", "Rome"), ("bar", "Rome")]
    many = ingest.maps_pairs_from_csv(spark.createDataFrame([(0, "cafe", "Rome"), (1, "bar", " "), (2, "pub", "Bonn")], schema))
    assert [r.search_term for r in many.orderBy("row_index").collect()] == ["cafe", "pub"]
    none = ingest.maps_pairs_from_csv(spark.createDataFrame([(0, "cafe", None), (1, "bar", "")], schema))
    assert [(r.search_term, r.location) for r in none.orderBy("row_index").collect()] == [("cafe", ""), ("bar", "")]


def test_search_query_cuts_key_at_first_bar(spark):
    rows = spark.createDataFrame([(0, "A|B", "Rome"), (1, "a|b", "ROME"), (2, "Acme", "")], "row_index long, company_name string, location string")
    got = {r.request_key: (r.query, r.n_rows) for r in discover.search_requests(rows).collect()}
    assert got == {"a|b|rome": ('"a" b|rome official website', 2), "acme|": ('"acme" official website', 1)}


def test_tiles_stay_near_their_centre(spark):
    rows = [(0, "25.0", 25.76 + i / 100, -80.19 - i / 100) for i in range(4)] + [(0, "far", 40.0, -70.0), (1, "one", 1.0, 1.0), (2, "n", None, 2.0)]
    seeds = spark.createDataFrame(rows, "search_idx int, title string, latitude double, longitude double")
    for asked, got_n in ((6, 6), (4, 4), (3, 2), (7, 6), (9, 9), (1, 1)):
        tiles = discover.place_tiles(seeds, asked, 50.0).collect()
        assert len(tiles) == got_n and {t.search_idx for t in tiles} == {0}
        lat = sum(r[2] for r in rows[:5]) / 5
        assert all(abs(t.latitude - lat) <= 50 / 111 + 1e-9 for t in tiles)


def test_place_collect_cap_ids_and_empty_seed(spark):
    rows = [(0, 0, 0, "p1", "A"), (0, 0, 1, "p1", "A again"), (0, 1, 0, "", "B"), (0, 1, 1, "p1", "A"), (0, 2, 0, "p3", "C"), (1, 1, 0, "p9", "only a tile"), (0, 0, 2, "", "")]
    df = spark.createDataFrame(rows, "search_idx int, call int, pos int, placeId string, title string").withColumn("cid", F.lit(None).cast("string"))
    got = discover.place_collect(df, 2).orderBy("call", "pos").collect()
    assert [(r.search_idx, r.title) for r in got] == [(0, "A"), (0, "B")]


NAMES = {
    "HeyReach Reviews 2026": "HeyReach", "Reviews": "Reviews", " Reviews of X Pricing": "Reviews of X", "Acme - G2": "Acme", "Top 10 Acme Alternatives": "Top 10 Acme",
    "Top 10 Acme competitors in town": "Acme", "Acme 2025 ": "Acme", "Acme": "Acme", "2024": "2024",
}


def test_clean_product_name(spark):
    df = spark.createDataFrame([(k,) for k in NAMES], "title string")
    assert {r.title: r.name for r in discover.clean_product_name(df).collect()} == NAMES


def test_category_summary_with_cap_matches_walk(spark):
    rng = random.Random(5)
    rows = [("c", q, p, i, f"Product {rng.randrange(30)}") for q in range(3) for p in range(1, 4) for i in range(8)]
    results = [(c, q, p, i, t, f"https://www.g2.com/products/{t.replace(' ', '-')}/reviews") for c, q, p, i, t in rows]
    df = spark.createDataFrame(results, "category string, query_idx int, page int, pos int, title string, link string")
    for cap in (1, 5, 12, 100):
        seen, per_query = [], {q: set() for q in range(3)}
        for q in range(3):
            for p in range(1, 4):
                on_page = list(dict.fromkeys(t for _, qq, pp, _, t in rows if (qq, pp) == (q, p)))
                for t in on_page:
                    per_query[q].add(t)
                    if t not in seen:
                        seen.append(t)
                        if len(seen) >= cap:
                            break
        got = discover.category_query_summary(df, cap).collect()
        assert {r.query_idx: r.unique_slugs for r in got} == {q: len(s) for q, s in per_query.items()}
        assert {r.raw_results for r in got} == {24}
        assert {r.category_slugs for r in got} == {len(seen)}


def test_funding_dedupe_prefers_richest_then_first(spark):
    rows = [
        (0, "Acme ", None, "Seed", None), (1, "acme", "$5M", "seed ", "VC"), (2, "ACME", "$6M", "Seed", "Other"), (3, "Acme", None, "Series A", None), (4, " ", "$1M", "Seed", None),
    ]
    df = spark.createDataFrame(rows, "ordinal int, company_name string, funding_amount string, funding_round string, lead_investor string")
    got = discover.funding_dedupe(df).orderBy("first_seen").collect()
    assert [(r.first_seen, r.funding_amount, r.funding_round) for r in got] == [(0, "$5M", "seed "), (3, None, "Series A")]


def test_unreadable_funding_answers(spark):
    rows = [(0, '[{"item_index": 0, "is_funding_round": true, "company_name": "A"}]'), (1, "[oops"), (2, '{"item_index": 1}'), (3, None), (4, "[]")]
    df = spark.createDataFrame(rows, "batch_id int, body string")
    assert [r.batch_id for r in discover.parse_funding_responses(df).collect()] == [0]
    assert tuple(discover.dropped_batches(df).first()) == (5, 3)


def test_score_looks_at_first_result(spark):
    def case(name, company, results):
        df = spark.createDataFrame([(name, company, results)], "full_name string, company_name string, results array<struct<title:string,link:string,snippet:string>>")
        r = discover.score_profile(discover.pick_profile(df)).first()
        return r.linkedin_url, r.confidence

    hit = ("Ann Lee - CEO", "https://www.linkedin.com/in/ann/?a=1", "at Acme")
    assert case("Ann Lee", "Acme", [hit]) == ("https://www.linkedin.com/in/ann", 0.9)
    assert case("Ann Lee", "Other", [hit]) == ("https://www.linkedin.com/in/ann", 0.8)
    assert case("Ann Lee", "Acme", [("News", "https://n.com", "x"), hit]) == ("https://www.linkedin.com/in/ann", 0.5)
    assert case("Ann Lee", "Acme", [("N", "https://n.com", "x")] * 3 + [hit]) == ("", 0.0)
    assert case("Ann Lee", "Acme", []) == ("", 0.0)


def test_dense_index_and_hot_keys(spark):
    values = random.Random(3).sample(range(10**9), 500)
    df = spark.createDataFrame([(v,) for v in values], "o long")
    for tasks in (None, 10, 1010):  # beyond 1,000 ranges the sums go over two levels
        got = {r.o: r.i for r in dense_index(df, "o", "i", tasks=tasks).collect()}
        assert got == {v: i for i, v in enumerate(sorted(values))}
    far = spark.range(2000).union(spark.range(10**15, 10**15 + 1)).toDF("o")
    numbered = dense_index(far, "o", "i", tasks=8)
    assert numbered.filter("i <> CASE WHEN o > 5000 THEN 2000 ELSE o END").count() == 0
    sizes = far.repartitionByRange(8, "o").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.max() < 2 * 2001 / 8  # one far value leaves the ranges even
    hot = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"), F.col("id").alias("o"))
    assert first_per_key(hot, ["k"], ["o"]).count() == 4001
    assert cap_per_key(hot, ["k"], ["o"], 5).filter("k = 'hot'").toPandas()["o"].sort_values().tolist() == [0, 3, 6, 9, 12]
    assert isinstance(hot.limit(1).toPandas(), pd.DataFrame)
