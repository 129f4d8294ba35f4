"""Input shaping over the given tables."""

from pyspark.sql import functions as F

from leadflow.catalog.base import case, mod, query, raw_urls, table, text, view
from leadflow.functions.workspace import workspace
from leadflow.operators import ingest
from leadflow.sources import csv_files


@query(
    "csv_company_rows",
    """SELECT c_custkey AS row_index, trim(c_name) AS company_name,
       CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE c_mktsegment END AS location
       FROM customer WHERE c_custkey % 10 <> 3""",
)
def csv_company_rows(spark, d):
    path = workspace(spark, "upload")
    rows = table(spark, d, "customer").select(
        "c_custkey",
        F.when(mod("c_custkey", 10) == 3, "  ").otherwise(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("Company"),
        F.when(mod("c_custkey", 4) == 1, " ").otherwise(F.col("c_mktsegment")).alias("City"),
    )
    out = rows.orderBy("c_custkey").drop("c_custkey").write.option("header", True)
    out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return csv_files.csv_company_rows(spark, path, "Company", "City", max_rows=None)


@query("paste_rows", "SELECT c_name AS name, c_mktsegment || ', ' || c_custkey AS note FROM customer")
def paste_rows(spark, d):
    path = workspace(spark, "paste")
    rows = table(spark, d, "customer").select(F.col("c_name").alias("name"), text(":c_mktsegment", ", ", ":c_custkey").alias("note"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return csv_files.paste_rows(spark, path)


@query(
    "auto_map_company_columns",
    "SELECT c_custkey AS row_index, c_name AS company_name, c_mktsegment AS location FROM customer",
)
def auto_map_company_columns(spark, d):
    c = table(spark, d, "customer")
    return ingest.auto_map_company_columns(
        c.select(
            F.col("c_custkey").alias("row_index"), F.col("c_acctbal").alias("balance"),
            F.lower("c_name").alias("Organization"), F.col("c_name").alias("Company-Name"),
            F.lit("x").alias("HQ"), F.col("c_mktsegment").alias("City, State"),
        )
    )


PEOPLE_SQL = """SELECT c_custkey AS row_index,
    trim(CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'Ann' || c_custkey END || ' ' ||
         CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Lee' END) AS full_name,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS company_name,
    CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey || '.example.com' ELSE '' END AS website
    FROM customer"""
view("people_cells", PEOPLE_SQL)


def people_cells(spark, d):
    k = "c_custkey"
    return table(spark, d, "customer").select(
        F.col(k).alias("row_index"),
        F.when(mod(k, 6) == 0, " ").otherwise(text(" Ann", ":c_custkey")).alias("First Name"),
        F.when(mod(k, 4) == 0, F.lit(None).cast("string")).otherwise(F.lit("Lee ")).alias("surname"),
        F.when(mod(k, 5) == 0, " ").otherwise(F.concat(F.col("c_mktsegment"), F.lit(" "))).alias("Employer"),
        F.when(mod(k, 3) == 0, text("c", ":c_custkey", ".example.com")).alias("Company URL"),
    )


MAPPED_PEOPLE = """SELECT row_index, full_name, company_name, website,
    CASE WHEN website <> '' THEN 'url' ELSE 'name' END AS input_type
    FROM people_cells WHERE full_name <> '' AND company_name <> ''"""


@query("auto_map_people_columns", MAPPED_PEOPLE, ("people_cells",))
def auto_map_people_columns(spark, d):
    return ingest.auto_map_people_columns(people_cells(spark, d))


@query("people_rows", MAPPED_PEOPLE, ("people_cells",))
def people_rows(spark, d):
    return ingest.people_rows(
        people_cells(spark, d), first_name_col="First Name", last_name_col="surname",
        company_col="Employer", website_col="Company URL",
    )


LINES_SQL = """SELECT c_custkey AS row_index, c_custkey % 8 AS kind,
    CASE c_custkey % 8
      WHEN 2 THEN 'Max ' || c_custkey || ',Firm ' || c_custkey WHEN 3 THEN 'nobody ' || c_custkey
      WHEN 4 THEN '   ' WHEN 5 THEN ', Firm ' || c_custkey WHEN 6 THEN 'Bo ' || c_custkey || ' - Firm, Inc.'
      WHEN 7 THEN 'Jo ' || c_custkey || ' | ' ELSE 'Ann ' || c_custkey || ' | Firm ' || c_custkey || ', Inc. ' END AS line
    FROM customer"""
view("pasted_lines", LINES_SQL)


def pasted_lines(spark, d):
    c = F.col("c_custkey")
    line = case(
        c % 8,
        {
            2: text("Max ", c, ",Firm ", c), 3: text("nobody ", c), 4: "   ", 5: text(", Firm ", c),
            6: text("Bo ", c, " - Firm, Inc."), 7: text("Jo ", c, " | "),
        },
        text("Ann ", c, " | Firm ", c, ", Inc. "),
    )
    return table(spark, d, "customer").select(c.alias("row_index"), line.alias("line"))


@query(
    "people_lines",
    # among the first five lines two hold ' | ' and two ', ': the comma is listed first and wins
    r"""SELECT row_index, line,
       CASE WHEN instr(trim(line), ',') > 0 THEN trim(substr(trim(line), 1, instr(trim(line), ',') - 1)) ELSE '' END AS full_name,
       CASE WHEN instr(trim(line), ',') > 0 THEN trim(substr(trim(line), instr(trim(line), ',') + 1)) ELSE '' END AS company_name,
       instr(trim(line), ',') > 1 AS ok
       FROM pasted_lines WHERE trim(line) <> ''""",
    ("pasted_lines",),
)
def people_lines(spark, d):
    return ingest.people_lines(pasted_lines(spark, d))


@query(
    "classify_inputs",
    r"""SELECT page_id, raw, coalesce(trim(raw), '') AS input,
       CASE WHEN kind IN (5, 6, 8) THEN 'name' ELSE 'url' END AS input_type FROM raw_urls""",
    ("raw_urls",),
)
def classify_inputs(spark, d):
    return ingest.classify_inputs(raw_urls(spark, d), "raw")


@query(
    "line_stats",
    # 'co.uk' looks like a site here, and a host with two dots before the suffix does not
    r"""SELECT count(*) AS total, count(*) FILTER (WHERE url) AS urls, count(*) FILTER (WHERE NOT url) AS names
       FROM (SELECT kind IN (0, 1, 3, 4, 7, 8) OR
             regexp_matches(lower(trim(raw)), '^[^.]+\.[a-z]{2,10}([/?#]|$)') AS url
             FROM raw_urls WHERE trim(raw) <> '')""",
    ("raw_urls",),
)
def line_stats(spark, d):
    return ingest.line_stats(raw_urls(spark, d), "raw")


@query(
    "maps_search_plan",
    """SELECT p_partkey AS search_idx, p_name AS search_term, 'Austin, TX' AS location
       FROM part WHERE p_partkey % 7 <> 3""",
)
def maps_search_plan(spark, d):
    terms = table(spark, d, "part").select(
        F.col("p_partkey").alias("search_idx"),
        F.when(mod("p_partkey", 7) == 3, "  ").otherwise(F.concat(F.lit(" "), "p_name")).alias("term"),
    )
    return ingest.maps_search_plan(terms, " Austin, TX ", max_per_search=100, limits=ingest.SearchLimits(searches=10**9, per_search=100))


@query(
    "maps_search_pairs",
    """SELECT s_suppkey AS search_idx, s_name AS search_term, n_name AS location FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def maps_search_pairs(spark, d):
    n = table(spark, d, "nation")
    pairs = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("search_idx"), F.concat(F.lit("  "), "s_name").alias("term"), F.concat("n_name", F.lit(" ")).alias("location")
    )
    return ingest.maps_search_plan(pairs=pairs, terms=pairs, location="not used", max_per_search=1, limits=ingest.SearchLimits(10**9, 100, 10**9))


# a job per nation: its customers are the terms, its key the results wanted per search
@query(
    "maps_search_refusals",
    """SELECT c_nationkey AS job_id, count(*) AS n_searches, CASE
         WHEN count(*) > (SELECT count(*) FROM customer) / 24 THEN 'at most ' || CAST(floor((SELECT count(*) FROM customer) / 24) AS BIGINT) || ' search term and location combinations'
         WHEN c_nationkey < 1 OR c_nationkey > 20 THEN 'max_per_search must be between 1 and 20'
         WHEN count(*) * c_nationkey > (SELECT count(*) FROM customer) / 2 THEN 'more than ' || CAST(floor((SELECT count(*) FROM customer) / 2) AS BIGINT) || ' results expected' END AS error
       FROM customer GROUP BY c_nationkey""",
)
def maps_search_refusals(spark, d):
    c = table(spark, d, "customer")
    n = c.count()
    terms = c.select(F.col("c_nationkey").cast("long").alias("job_id"), F.col("c_name").alias("term"))
    plan = ingest.maps_search_plan(terms, "Austin")
    return ingest.search_plan_errors(plan, "job_id", ingest.SearchLimits(n // 24, 20, n // 2), jobs=["job_id"])


@query(
    "maps_pairs_from_csv",
    """SELECT c_custkey AS row_index, c_mktsegment AS search_term, n_name AS location
       FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 9 <> 2""",
)
def maps_pairs_from_csv(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return ingest.maps_pairs_from_csv(
        c.select(
            F.col("c_custkey").alias("row_index"), F.concat("c_mktsegment", F.lit(" ")).alias("Search Term"),
            F.when(mod("c_custkey", 9) == 2, " ").otherwise(F.col("n_name")).alias("City"),
        )
    )


view("part_categories", "SELECT p_partkey AS ordinal, p_type || '-' || p_partkey AS slug, p_name AS name, p_brand AS parent FROM part")


def part_categories(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("ordinal"), text(":p_type", "-", ":p_partkey").alias("slug"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("parent"),
    )


@query(
    "category_rows",
    """SELECT * FROM part_categories WHERE contains(lower(name), 'ring') OR contains(slug, 'ring') OR contains(lower(parent), 'ring')""",
    ("part_categories",),
)
def category_rows(spark, d):
    return ingest.category_rows(part_categories(spark, d), search=" Ring ")


@query("category_parents", "SELECT DISTINCT parent FROM part_categories", ("part_categories",))
def category_parents(spark, d):
    return ingest.category_parents(part_categories(spark, d))


@query(
    "categories_grouped",
    """SELECT *, count(*) OVER (PARTITION BY parent) AS n_categories FROM part_categories
       WHERE contains(lower(name), 'red') OR contains(slug, 'red') OR contains(lower(parent), 'red')""",
    ("part_categories",),
)
def categories_grouped(spark, d):
    return ingest.categories_grouped(part_categories(spark, d), search="red")


@query(
    "validate_categories",
    "SELECT p_type || '-' || (p_partkey + 5) AS slug FROM part WHERE p_type || '-' || (p_partkey + 5) NOT IN (SELECT slug FROM part_categories)",
    ("part_categories",),
)
def validate_categories(spark, d):
    picked = table(spark, d, "part").select(text(":p_type", "-", F.col("p_partkey") + 5).alias("slug"))
    return ingest.validate_categories(picked, part_categories(spark, d))


@query(
    "intel_lines",
    "SELECT page_id AS row_index, trim(raw) AS line FROM raw_urls WHERE trim(raw) <> ''",
    ("raw_urls",),
)
def intel_lines(spark, d):
    rows = raw_urls(spark, d)
    return ingest.intel_lines(rows.select(F.col("page_id").alias("row_index"), F.lit("n").alias("Company"), F.col("raw").alias("Web site link")))


@query(
    "seed_category_rows",
    """SELECT p_partkey AS row_index, CASE WHEN p_partkey % 3 = 0 THEN 'p' || p_partkey || '.example.com' ELSE p_name END AS input,
       CASE WHEN p_partkey % 3 = 0 THEN 'url' ELSE 'name' END AS input_type, p_name AS company_name,
       '' AS g2_url, p_brand AS g2_category, p_size / 10.0::DOUBLE AS g2_rating, p_partkey % 50 AS g2_review_count, 'pending' AS status
       FROM part""",
)
def seed_category_rows(spark, d):
    k = "p_partkey"
    return ingest.seed_category_rows(
        table(spark, d, "part").select(
            F.col(k).alias("row_index"), F.col("p_name").alias("name"),
            F.when(mod(k, 3) == 0, text("p", ":p_partkey", ".example.com")).when(mod(k, 3) == 1, "").alias("website"),
            F.lit(None).cast("string").alias("g2_url"), F.col("p_brand").alias("g2_category"),
            (F.col("p_size") / 10.0).alias("rating"), mod(k, 50).alias("review_count"),
        )
    )


@query(
    "seed_place_rows",
    """SELECT c_custkey AS row_index, CASE WHEN c_custkey % 5 <> 0 THEN 'https://WWW.Shop' || c_custkey || '.example.com/a?b' ELSE c_name END AS input,
       CASE WHEN c_custkey % 5 <> 0 THEN 'url' ELSE 'name' END AS input_type, c_mktsegment AS search_term, '' AS location, c_name AS business_name,
       'cafe' AS category, '' AS maps_address, '' AS maps_phone, c_acctbal AS rating, c_custkey % 9 AS review_count,
       c_nationkey / 2.0::DOUBLE AS latitude, NULL::DOUBLE AS longitude,
       CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_custkey::VARCHAR END AS google_cid,
       CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'https://www.google.com/maps/place/?cid=' || c_custkey END AS google_maps_url,
       CASE WHEN c_custkey % 5 <> 0 THEN 'shop' || c_custkey || '.example.com' END AS raw_domain, 'pending' AS status
       FROM customer""",
)
def seed_place_rows(spark, d):
    k = "c_custkey"
    none = F.lit(None).cast("string")
    return ingest.seed_place_rows(
        table(spark, d, "customer").select(
            F.col(k).alias("row_index"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("search_term"),
            none.alias("location"), F.lit("cafe").alias("category"), none.alias("address"), none.alias("phoneNumber"),
            F.when(mod(k, 5) != 0, text("https://WWW.Shop", ":c_custkey", ".example.com/a?b")).alias("website"),
            F.when(mod(k, 4) != 0, F.col(k).cast("string")).alias("cid"), F.col("c_acctbal").alias("rating"),
            mod(k, 9).alias("ratingCount"), (F.col("c_nationkey") / 2.0).alias("latitude"),
            F.lit(None).cast("double").alias("longitude"),
        )
    )


@query(
    "seed_funding_rows",
    """SELECT o_orderkey AS row_index, 'Firm ' || o_custkey AS input, 'name' AS input_type, 'Firm ' || o_custkey AS company_name,
       CASE WHEN o_orderkey % 3 = 0 THEN '$' || o_orderkey || 'M' END AS funding_amount, o_orderpriority AS funding_round,
       NULL::VARCHAR AS lead_investor, 'text' AS funding_description, 'https://news.example.com/' || o_orderkey AS source_url,
       '' AS source_name, 'pending' AS status FROM orders""",
)
def seed_funding_rows(spark, d):
    none = F.lit(None).cast("string")
    return ingest.seed_funding_rows(
        table(spark, d, "orders").select(
            F.col("o_orderkey").alias("row_index"), text("Firm ", ":o_custkey").alias("company_name"),
            F.when(mod("o_orderkey", 3) == 0, text("$", ":o_orderkey", "M")).alias("funding_amount"),
            F.col("o_orderpriority").alias("funding_round"), none.alias("lead_investor"),
            F.lit("text").alias("description_snippet"), text("https://news.example.com/", ":o_orderkey").alias("source_url"),
            none.alias("source_name"),
        )
    )


@query(
    "seed_people_rows",
    """SELECT row_index, full_name, company_name, website,
       CASE WHEN row_index % 2 = 0 THEN 'https://linkedin.com/in/p' || row_index ELSE '' END AS linkedin_url,
       CASE WHEN row_index % 2 = 0 THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS linkedin_confidence,
       CASE WHEN website <> '' THEN website ELSE company_name END AS input,
       CASE WHEN website <> '' THEN 'url' ELSE 'name' END AS input_type, 'pending' AS status
       FROM people_cells WHERE full_name <> '' AND company_name <> ''""",
    ("people_cells",),
)
def seed_people_rows(spark, d):
    people = ingest.auto_map_people_columns(people_cells(spark, d))
    found = table(spark, d, "customer").filter(mod("c_custkey", 2) == 0).select(
        F.col("c_custkey").alias("row_index"), text("https://linkedin.com/in/p", ":c_custkey").alias("linkedin_url"),
        F.lit(0.8).alias("confidence"),
    )
    return ingest.seed_people_rows(people, found)
