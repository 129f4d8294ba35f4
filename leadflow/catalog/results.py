"""Exports, summaries and views over the result rows."""

from pyspark.sql import functions as F

from leadflow.catalog.base import mod, query, result_rows, table, text
from leadflow.catalog.extract import FLAG_SQL
from leadflow.functions.workspace import workspace
from leadflow.operators import results
from leadflow.sources import csv_files

OPTIONS = ["industry_description", "target_market", "homepage_raw_text"]


def safe(c: str) -> str:
    return f"CASE WHEN left({c}, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || {c} ELSE {c} END"


def contact_cells(sanitized: tuple[str, ...], mobile: bool = False) -> str:
    cells = [("contact_title", "title"), ("first_name", "first_name"), ("last_name", "last_name"), ("email", "email"), ("phone", "phone"), ("linkedin", "linkedin_url")]
    if mobile:
        cells.insert(5, ("mobile", "mobile"))
    return ", ".join(f"coalesce({safe('c.' + f) if f in sanitized else 'c.' + f}, '') AS {n}" for n, f in cells)


NAMES = ("title", "first_name", "last_name", "email")
ALL = (*NAMES, "phone", "mobile", "linkedin_url")
INTEL_SQL = """coalesce(industry, '') AS industry, coalesce(niche, '') AS niche, coalesce(description, '') AS description, coalesce(address, '') AS address,
    coalesce(r.phone, '') AS company_phone, coalesce(mail_text, '') AS general_emails, coalesce(target_market, '') AS target_market,
    coalesce(case_text, '') AS case_studies, coalesce(homepage_raw_text, '') AS homepage_raw_text"""
SITE_SQL = "coalesce(normalized_domain, raw_domain, '') AS website"
JOIN_SQL = "FROM result_rows r LEFT JOIN result_contacts c ON c.row_index = r.row_index"
LINE_SQL = "r.row_index, coalesce(c.contact_no, 0)::INTEGER AS contact_no, status"
VIEWS = ("result_rows", "result_contacts")

WEBSITES_SQL = f"""SELECT {LINE_SQL}, {safe('company_name')} AS company_name, {safe('location')} AS location, coalesce(normalized_domain, verified_domain, '') AS website,
    coalesce(verification_confidence::VARCHAR, '') AS verification_confidence, {contact_cells(NAMES)} {JOIN_SQL}"""


@query("export_websites", WEBSITES_SQL, VIEWS)
def export_websites(spark, d):
    return results.export_websites(result_rows(spark, d))


@query("export_intel", f"SELECT {LINE_SQL}, {safe('input')} AS input, {SITE_SQL}, {FLAG_SQL} AS intel_extracted, {INTEL_SQL}, {contact_cells(ALL)} {JOIN_SQL}", VIEWS)
def export_intel(spark, d):
    return results.export_intel(result_rows(spark, d), OPTIONS)


@query(
    "export_categories",
    f"""SELECT {LINE_SQL}, {safe('location')} AS g2_category, 'https://g2.example.com/' || r.row_index AS g2_url,
        CASE WHEN r.row_index % 4 = 0 THEN '' ELSE (r.row_index % 4 / 2.0::DOUBLE)::VARCHAR END AS g2_rating,
        CASE WHEN r.row_index % 6 = 0 THEN '' ELSE (r.row_index % 6)::VARCHAR END AS g2_review_count,
        input, {SITE_SQL}, {FLAG_SQL} AS intel_extracted, {INTEL_SQL}, {contact_cells(ALL, mobile=True)} {JOIN_SQL}""",
    VIEWS,
)
def export_categories(spark, d):
    rows = result_rows(spark, d).withColumns(
        {"g2_category": F.col("location"), "g2_url": text("https://g2.example.com/", ":row_index"), "g2_rating": mod("row_index", 4) / 2.0, "g2_review_count": mod("row_index", 6)}
    )
    return results.export_categories(rows, OPTIONS)


@query(
    "export_places",
    f"""SELECT {LINE_SQL}, {safe('company_name')} AS search_term, {safe('location')} AS location, '''=x' AS business_name, '' AS category, '''-1 Street' AS maps_address, '+1 5' AS maps_phone,
        {SITE_SQL}, CASE WHEN r.row_index % 4 = 0 THEN '' ELSE (r.row_index % 4 / 2.0::DOUBLE)::VARCHAR END AS rating, CASE WHEN r.row_index % 6 = 0 THEN '' ELSE (r.row_index % 6)::VARCHAR END AS review_count,
        '' AS latitude, '-0.5' AS longitude, '' AS google_maps_url, {FLAG_SQL} AS intel_extracted, {INTEL_SQL}, {contact_cells(NAMES)} {JOIN_SQL}""",
    VIEWS,
)
def export_places(spark, d):
    none = F.lit(None).cast("string")
    rows = result_rows(spark, d).withColumns(
        {
            "search_term": F.col("company_name"), "business_name": F.lit("=x"), "category": none, "maps_address": F.lit("-1 Street"), "maps_phone": F.lit("+1 5"),
            "rating": mod("row_index", 4) / 2.0, "review_count": mod("row_index", 6), "latitude": F.lit(0.0), "longitude": F.lit(-0.5), "google_maps_url": none,
        }
    )
    return results.export_places(rows, OPTIONS)


@query(
    "export_funding",
    f"""SELECT {LINE_SQL}, {safe('company_name')} AS company_name, CASE WHEN r.row_index % 3 = 0 THEN '-$5M' ELSE '' END AS funding_amount, location AS funding_round,
        CASE WHEN r.row_index % 2 = 0 THEN '''@fund' ELSE '' END AS lead_investor, '' AS funding_description, 'https://n.example.com/' || r.row_index AS source_url, 'News' AS source_name,
        {SITE_SQL}, {FLAG_SQL} AS intel_extracted, {contact_cells(NAMES)} {JOIN_SQL}""",
    VIEWS,
)
def export_funding(spark, d):
    r = F.col("row_index")
    rows = result_rows(spark, d).withColumns(
        {
            "funding_amount": F.when(r % 3 == 0, "-$5M"), "funding_round": F.col("location"), "lead_investor": F.when(r % 2 == 0, "@fund"),
            "funding_description": F.lit(None).cast("string"), "source_url": text("https://n.example.com/", r), "source_name": F.lit("News"),
        }
    )
    return results.export_funding(rows, [])


@query(
    "export_people",
    f"""SELECT r.row_index, status, {safe('company_name')} AS full_name, {safe('location')} AS company_name, 'https://linkedin.com/in/p' || r.row_index AS linkedin_url,
        coalesce(verification_confidence::VARCHAR, '') AS linkedin_confidence, {SITE_SQL}, coalesce(target_market, '') AS target_market, coalesce(case_text, '') AS case_studies,
        coalesce({safe('c.title')}, '') AS contact_title, coalesce({safe('c.first_name')}, '') AS contact_first_name, coalesce({safe('c.last_name')}, '') AS contact_last_name,
        coalesce({safe('c.email')}, '') AS contact_email, coalesce(c.phone, '') AS contact_phone, coalesce(c.linkedin_url, '') AS contact_linkedin
        {JOIN_SQL} AND c.contact_no = 0""",
    VIEWS,
)
def export_people(spark, d):
    rows = result_rows(spark, d)
    rows = rows.withColumns(
        {"full_name": F.col("company_name"), "company_name": F.col("location"), "linkedin_url": text("https://linkedin.com/in/p", ":row_index"), "linkedin_confidence": F.col("verification_confidence")}
    )
    return results.export_people(rows, ["target_market"])


def wide_sql(title: str, no: int) -> str:
    pairs = [("Title", "title"), ("First Name", "first_name"), ("Last Name", "last_name"), ("Email", "email"), ("Phone", "phone"), ("LinkedIn", "linkedin_url")]
    return ", ".join(f"coalesce(max(CASE WHEN c.contact_no = {no} THEN c.{f} END), '') AS \"{title} - {n}\"" for n, f in pairs)


@query(
    "wide_contacts",
    f"""SELECT r.row_index, any_value(company_name) AS company_name, any_value(location) AS location, coalesce(any_value(normalized_domain), '') AS website,
        coalesce(any_value(verification_confidence)::VARCHAR, '') AS verification_confidence, any_value(status) AS status, {wide_sql('CEO', 0)}, {wide_sql('Head of Sales', 1)}
        {JOIN_SQL} GROUP BY r.row_index""",
    VIEWS,
)
def wide_contacts(spark, d):
    return results.wide_contacts(result_rows(spark, d).withColumn("website", F.col("normalized_domain")), ["CEO", "Head of Sales"])


CELLS = {0: "=", 1: "+", 2: "-", 3: "@", 4: "\t", 5: "\r", 6: " =", 7: ""}


@query(
    "sanitize_cells",
    """SELECT c_custkey, CASE WHEN c_custkey % 8 < 6 THEN '''' ELSE '' END || (['=', '+', '-', '@', chr(9), chr(13), ' =', ''])[c_custkey % 8 + 1] || c_name AS cell FROM customer""",
)
def sanitize_cells(spark, d):
    lead = F.element_at(F.array(*[F.lit(v) for v in CELLS.values()]), (mod("c_custkey", 8) + 1).cast("int"))
    return results.sanitize_cells(table(spark, d, "customer").select("c_custkey", F.concat(lead, "c_name").alias("cell")), ["cell"])


@query(
    "csv_sink",
    f"SELECT * EXCLUDE (row_index, contact_no) FROM ({WEBSITES_SQL})",
    VIEWS,
)
def csv_sink(spark, d):
    path = workspace(spark, "export")
    csv_files.csv_sink(results.export_websites(result_rows(spark, d)), path)
    return csv_files.read_header_csv(spark, path).na.fill("")


CONTACTS_SQL = """(SELECT count(DISTINCT CASE WHEN email <> '' THEN email WHEN first_name || '|' || last_name <> '|' THEN first_name || '|' || last_name END) FROM result_contacts) AS contacts_enriched"""


@query(
    "job_summary",
    f"""SELECT 'websites' AS tool, count(*) AS total_rows, count(normalized_domain) AS websites_found, NULL::BIGINT AS intel_extracted, {CONTACTS_SQL} FROM result_rows
        UNION ALL SELECT 'intel', count(*), count(coalesce(normalized_domain, raw_domain)), count(*) FILTER (WHERE contact_kind <> 2), {CONTACTS_SQL} FROM result_rows""",
    VIEWS,
)
def job_summary(spark, d):
    rows = result_rows(spark, d)
    one = results.job_summary(rows).withColumn("tool", F.lit("websites"))
    return one.unionByName(results.job_summary(rows, "intel").withColumn("tool", F.lit("intel")), allowMissingColumns=True)


@query(
    "progress_counts",
    """SELECT job_id, count(*) AS total_rows, count(normalized_domain) AS found_count, count(*) FILTER (WHERE contact_kind <> 0) AS enriched_count FROM result_rows GROUP BY job_id""",
    ("result_rows",),
)
def progress_counts(spark, d):
    return results.progress_counts(result_rows(spark, d))


@query(
    "preview_page",
    """SELECT row_index, coalesce(nullif(company_name, ''), input) AS company_name, location, coalesce(normalized_domain, verified_domain) AS domain, verification_confidence::VARCHAR AS confidence,
       status, industry, niche, (SELECT count(*) FROM result_rows WHERE status <> 'pending') AS total FROM result_rows WHERE status <> 'pending' ORDER BY row_index LIMIT 500 OFFSET 40""",
    ("result_rows",),
)
def preview_page(spark, d):
    return results.preview_page(result_rows(spark, d), limit=500, offset=40).drop("contacts")


@query(
    "preview_deep",
    """SELECT * EXCLUDE (n) FROM (SELECT row_index, coalesce(nullif(company_name, ''), input) AS company_name, location, coalesce(normalized_domain, verified_domain) AS domain, verification_confidence::VARCHAR AS confidence,
       status, industry, niche, count(*) OVER () AS total, row_number() OVER (ORDER BY row_index) AS n FROM result_rows WHERE status <> 'pending')
       WHERE n > total * 9 // 10 AND n <= total * 9 // 10 + 50""",
    ("result_rows",),
)
def preview_deep(spark, d):
    folder = results.write_preview(result_rows(spark, d), workspace(spark, "preview"), ranges=64)
    total = spark.read.parquet(f"{folder}/ranges").agg(F.sum("n")).first()[0]
    return results.preview_stored(spark, folder, 50, total * 9 // 10).drop("contacts")


@query(
    "flatten_results",
    f"""SELECT r.row_index, nullif(trim(c.first_name || ' ' || c.last_name), '') AS contact_name, nullif(c.title, '') AS contact_title, nullif(c.email, '') AS contact_email,
        nullif(c.phone, '') AS contact_phone, nullif(c.linkedin_url, '') AS contact_linkedin, nullif(industry, '') AS industry, nullif(niche, '') AS niche {JOIN_SQL} AND c.contact_no = 0""",
    VIEWS,
)
def flatten_results(spark, d):
    out = results.flatten_results(result_rows(spark, d))
    return out.select("row_index", *[c for c in out.columns if c.startswith("contact_")], "industry", "niche")


@query(
    "filter_results",
    """SELECT row_index, company_name, status FROM result_rows WHERE status IN ('not_found', 'blocked', 'failed', 'scrape_failed') AND contains(lower(company_name), '#0000001')""",
    ("result_rows",),
)
def filter_results(spark, d):
    rows = results.filter_results(result_rows(spark, d), tab="not_found", text="#0000001", sort="input", descending=True)
    return rows.select("row_index", "company_name", "status")


@query(
    "natural_order",
    "SELECT input, row_number() OVER (ORDER BY row_index) - row_index AS shift FROM result_rows",
    ("result_rows",),
)
def natural_order(spark, d):
    """Rank of every row by the natural order of its input ('in9' before 'in10') against its number."""
    from leadflow.functions.tables import dense_index
    from leadflow.functions.text import natural_key

    rows = result_rows(spark, d).select("row_index", "input", natural_key("input").alias("_key"))
    # the key is fixed width per digit count, so its digits order rows as a number
    ordinal = F.regexp_extract("_key", r"(\d+)$", 1).cast("long")
    ranked = dense_index(rows.withColumn("_o", ordinal), "_o", "rank")
    return ranked.select("input", (F.col("rank") + 1 - F.col("row_index")).alias("shift"))


@query(
    "match_rate",
    f"""SELECT count(*) AS total_rows, count(normalized_domain) AS found, floor(count(normalized_domain) / count(*) * 100 + 0.5)::INTEGER AS match_rate, {CONTACTS_SQL} FROM result_rows""",
    VIEWS,
)
def match_rate(spark, d):
    return results.match_rate(result_rows(spark, d))


@query(
    "confidence_buckets",
    """SELECT CASE WHEN verification_confidence IS NULL THEN 'missing' WHEN floor(verification_confidence * 100 + 0.5) >= 80 THEN 'high'
       WHEN floor(verification_confidence * 100 + 0.5) >= 50 THEN 'medium' ELSE 'low' END AS band, count(*) AS n_rows FROM result_rows GROUP BY 1""",
    ("result_rows",),
)
def confidence_buckets(spark, d):
    return results.confidence_buckets(result_rows(spark, d))


GROUPED = """SELECT view, status_group, status_label, count(*) AS n_rows FROM (
    SELECT 'preview' AS view, CASE WHEN status IN ('normalized', 'enriched', 'extracted', 'crawled') THEN 'success' WHEN status IN ('not_found', 'scrape_failed') THEN 'destructive'
      WHEN status IN ('blocked', 'extract_failed') THEN 'warning' ELSE 'secondary' END AS status_group,
      CASE status WHEN 'not_found' THEN 'Not Found' WHEN 'extract_failed' THEN 'No intel' WHEN 'scrape_failed' THEN 'Scrape Failed' ELSE upper(left(status, 1)) || substr(status, 2) END AS status_label FROM result_rows
    UNION ALL
    SELECT 'results', CASE WHEN status IN ('normalized', 'enriched', 'extracted', 'crawled') THEN 'success' WHEN status IN ('not_found', 'blocked', 'failed', 'scrape_failed') THEN 'destructive'
      WHEN status = 'pending' THEN 'secondary' ELSE 'outline' END,
      CASE status WHEN 'not_found' THEN 'Not Found' WHEN 'extract_failed' THEN 'Extract Failed' WHEN 'scrape_failed' THEN 'Scrape Failed' ELSE upper(left(status, 1)) || substr(status, 2) END FROM result_rows)
    GROUP BY ALL"""


@query("status_groups", GROUPED, ("result_rows",))
def status_groups(spark, d):
    rows = result_rows(spark, d)
    both = [
        results.status_groups(rows, v).groupBy(F.lit(v).alias("view"), "status_group", "status_label").agg(F.count(F.lit(1)).alias("n_rows"))
        for v in ("preview", "results")
    ]
    return both[0].unionByName(both[1])


@query(
    "phase_progress",
    """SELECT phase, done, total, floor(done / total * 100 + 0.5)::INTEGER AS percent FROM (
       SELECT unnest(['search', 'verify', 'normalize', 'enrich']) AS phase, unnest([count(*) FILTER (WHERE status <> 'pending'), count(*) FILTER (WHERE status NOT IN ('pending', 'searched', 'resolved')),
              count(*) FILTER (WHERE status IN ('normalized', 'enriched', 'blocked', 'failed')), count(*) FILTER (WHERE status = 'enriched')]) AS done, count(*) AS total FROM result_rows)""",
    ("result_rows",),
)
def phase_progress(spark, d):
    return results.phase_progress(result_rows(spark, d))


@query("enriched_count", "SELECT count(*) FILTER (WHERE status = 'enriched') AS enriched FROM result_rows", ("result_rows",))
def enriched_count(spark, d):
    return results.enriched_count(result_rows(spark, d))
