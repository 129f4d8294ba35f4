"""Registry, table access and the adapters that turn the given tables into operator inputs.

Each adapter exists twice, as a DataFrame and as a SQL view with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    VIEWS[name] = (needs, sql)


def with_views(names: tuple[str, ...], body: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    return f"WITH RECURSIVE {ctes}\n{body}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts: str | Column) -> Column:
    """Join literals and columns to one string; a str starting with ':' is a column name."""
    def one(p):
        if isinstance(p, Column):
            return p.cast("string")
        return F.col(p[1:]).cast("string") if p.startswith(":") else F.lit(p)

    return F.concat(*[one(p) for p in parts])


def mod(c: str, n: int) -> Column:
    return F.col(c) % n


def div(c: str, n: int) -> Column:
    return F.floor(F.col(c) / n)


def case(value: Column, options: dict[int, Column | str | None], default: Column | str | None = None) -> Column:
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v).cast("string")

    out = None
    for k, v in options.items():
        out = F.when(value == k, lit(v)) if out is None else out.when(value == k, lit(v))
    return out.otherwise(lit(default))


# --- company rows: three rows per firm, one of them in capitals ------------------------------

view(
    "firms",
    """SELECT c_custkey AS row_index, c_custkey // 3 AS k,
       CASE WHEN c_custkey % 3 = 1 THEN upper('Firm ' || (c_custkey // 3)) ELSE 'Firm ' || (c_custkey // 3) END AS company_name,
       CASE WHEN (c_custkey // 3) % 10 = 3 THEN '' ELSE n_name END AS location
       FROM customer JOIN nation ON n_nationkey = (c_custkey // 3) % 25""",
)


def firms(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("row_index"), div("c_custkey", 3).alias("k"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("_n"), "n_name")
    named = text("Firm ", ":k")
    return c.join(n, F.col("k") % 25 == F.col("_n")).select(
        "row_index",
        "k",
        F.when(mod("row_index", 3) == 1, F.upper(named)).otherwise(named).alias("company_name"),
        F.when(mod("k", 10) == 3, "").otherwise(F.col("n_name")).alias("location"),
    )


# one answer per firm: none, unreadable, empty, or one to three results
view(
    "firm_answers",
    """SELECT k, lower(company_name) || '|' || lower(location) AS request_key,
       CASE WHEN k % 11 = 5 THEN NULL WHEN k % 7 = 2 THEN 0 ELSE 1 + k % 3 END AS n_results,
       CASE WHEN k % 11 = 5 OR k % 7 = 2 THEN '' ELSE 'firm' || k || '-1.com' END AS candidate
       FROM firms WHERE row_index % 3 = 0 AND k % 13 <> 4""",
    ("firms",),
)


def firm_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = firms(spark, d).filter((mod("row_index", 3) == 0) & (mod("k", 13) != 4))
    organic = F.transform(
        F.sequence(F.lit(1), (mod("k", 3) + 1).cast("int")),
        lambda i: F.struct(
            text("Firm ", ":k", " site ", i).alias("title"),
            text("https://www.firm", ":k", "-", i, ".com/home?x=1").alias("link"),
            text("about firm ", ":k").alias("snippet"),
        ),
    )
    body = F.when(mod("k", 11) == 5, '{"organic": [').when(mod("k", 7) == 2, '{"organic": []}').otherwise(
        F.to_json(F.struct(organic.alias("organic")))
    )
    key = F.concat(F.lower("company_name"), F.lit("|"), F.lower("location"))
    return rows.select(key.alias("request_key"), body.alias("body"))


# --- raw addresses: the page addresses and eight ways to write one ---------------------------

view(
    "raw_urls",
    r"""SELECT page_id, page_id % 9 AS kind, regexp_extract(url, 'example\.(com|net|org)') AS base,
       regexp_extract(url, '^https?://([^/?#]*)', 1) AS netloc,
       CASE page_id % 9
         WHEN 1 THEN '  ' || upper(url) || ' '
         WHEN 2 THEN 'www.' || regexp_extract(url, '^https?://([^/?#]*)', 1)
         WHEN 3 THEN 'https://www.bbc.co.uk/news/' || page_id
         WHEN 4 THEN 'https://www.linkedin.com/company/' || page_id
         WHEN 5 THEN CASE WHEN page_id % 2 = 0 THEN '  ' END
         WHEN 6 THEN 'not-a-domain-' || page_id
         WHEN 7 THEN 'https://user@' || regexp_extract(url, '^https?://([^/?#]*)', 1) || ':8080/x'
         WHEN 8 THEN 'co.uk'
         ELSE url END AS raw
       FROM pages""",
)


def raw_urls(spark: SparkSession, d: str) -> DataFrame:
    netloc = F.regexp_extract("url", r"^https?://([^/?#]*)", 1)
    raw = case(
        mod("page_id", 9),
        {
            1: F.concat(F.lit("  "), F.upper("url"), F.lit(" ")),
            2: F.concat(F.lit("www."), netloc),
            3: text("https://www.bbc.co.uk/news/", ":page_id"),
            4: text("https://www.linkedin.com/company/", ":page_id"),
            5: F.when(mod("page_id", 2) == 0, "  "),
            6: text("not-a-domain-", ":page_id"),
            7: F.concat(F.lit("https://user@"), netloc, F.lit(":8080/x")),
            8: "co.uk",
        },
        F.col("url"),
    )
    return table(spark, d, "pages").select("page_id", raw.alias("raw"))


# --- result rows: every status, blank and formula cells, none to two contacts ----------------

STATUS_SQL = (
    "['pending','searched','resolved','verified','normalized','crawled','extracted','enriched',"
    "'not_found','blocked','failed','scrape_failed','extract_failed'][c_custkey % 13 + 1]"
)
view(
    "result_rows",
    f"""SELECT c_custkey AS row_index, 'job' || (c_custkey // 100) AS job_id, {STATUS_SQL} AS status,
       CASE WHEN c_custkey % 10 = 0 THEN '=' || c_name WHEN c_custkey % 10 = 1 THEN '' ELSE c_name END AS company_name,
       CASE WHEN c_custkey % 10 = 2 THEN '@' || c_mktsegment ELSE c_mktsegment END AS location,
       CASE WHEN c_custkey % 3 <> 0 THEN 'd' || (c_custkey // 4) || '.example.com' END AS normalized_domain,
       CASE WHEN c_custkey % 5 <> 0 THEN 'v' || (c_custkey // 4) || '.example.com' END AS verified_domain,
       CASE WHEN c_custkey % 2 <> 0 THEN 'r' || (c_custkey // 4) || '.example.com' END AS raw_domain,
       CASE WHEN c_custkey % 8 <> 0 THEN (c_custkey % 101) / 100.0::DOUBLE END AS verification_confidence,
       'in' || c_custkey AS input,
       CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment WHEN c_custkey % 4 = 1 THEN '' END AS industry,
       CASE WHEN c_custkey % 6 = 0 THEN 'niche ' || c_custkey END AS niche,
       CASE WHEN c_custkey % 12 = 5 THEN '  ' END AS description,
       CASE WHEN c_custkey % 9 = 0 THEN 'Street ' || c_custkey END AS address,
       CASE WHEN c_custkey % 9 = 1 THEN '+1 555 ' || c_custkey END AS phone,
       CASE WHEN c_custkey % 7 = 3 THEN 'market ' || c_custkey END AS target_market,
       CASE WHEN c_custkey % 5 = 1 THEN 'case a, case ' || c_custkey WHEN c_custkey % 5 = 2 THEN '' END AS case_text,
       CASE WHEN c_custkey % 5 = 3 THEN 'info@d' || c_custkey || '.example.com' END AS mail_text,
       CASE WHEN c_custkey % 8 = 1 THEN 'home ' || c_custkey END AS homepage_raw_text,
       c_custkey % 4 AS contact_kind,
       CASE WHEN c_custkey % 4 >= 2 THEN c_custkey % 4 - 1 ELSE 0 END AS n_contacts
       FROM customer""",
)
# one line per contact, contact_no 0 and 1
view(
    "result_contacts",
    """SELECT row_index, i AS contact_no,
       CASE WHEN row_index % 8 = 2 THEN '+CEO' ELSE 'CEO' END AS title,
       CASE WHEN row_index % 16 = 6 THEN '' ELSE 'Ann' || (row_index // 8) END AS first_name,
       CASE WHEN row_index % 16 = 6 THEN '' ELSE 'Lee' || i END AS last_name,
       CASE WHEN row_index % 16 = 6 THEN '' WHEN row_index % 16 = 7 THEN 'N/A' WHEN row_index % 16 = 11 THEN ''
            ELSE 'a' || (row_index // 8) || i || '@example.com' END AS email,
       CASE WHEN i = 0 THEN '-1' ELSE '' END AS phone, '' AS mobile,
       'https://linkedin.com/in/p' || row_index AS linkedin_url
       FROM result_rows, (VALUES (0), (1)) AS t(i) WHERE i < n_contacts""",
    ("result_rows",),
)


def result_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = "c_custkey"
    m = lambda n: mod(k, n)
    statuses = F.array(*[F.lit(s) for s in (
        "pending", "searched", "resolved", "verified", "normalized", "crawled", "extracted", "enriched",
        "not_found", "blocked", "failed", "scrape_failed", "extract_failed",
    )])
    domain = lambda p: text(p, div(k, 4), ".example.com")
    blank = m(16) == 6
    contact = lambda i: F.struct(
        F.when(m(8) == 2, "+CEO").otherwise("CEO").alias("title"),
        F.when(blank, "").otherwise(text("Ann", div(k, 8))).alias("first_name"),
        F.when(blank, "").otherwise(f"Lee{i}").alias("last_name"),
        F.when(blank | (m(16) == 11), "").when(m(16) == 7, "N/A")
        .otherwise(text("a", div(k, 8), f"{i}@example.com")).alias("email"),
        F.lit("-1" if i == 0 else "").alias("phone"),
        F.lit("").alias("mobile"),
        text("https://linkedin.com/in/p", ":c_custkey").alias("linkedin_url"),
    )
    one = F.array(contact(0))
    return c.select(
        F.col(k).alias("row_index"),
        text("job", div(k, 100)).alias("job_id"),
        F.element_at(statuses, (m(13) + 1).cast("int")).alias("status"),
        F.when(m(10) == 0, F.concat(F.lit("="), "c_name")).when(m(10) == 1, "").otherwise(F.col("c_name")).alias("company_name"),
        F.when(m(10) == 2, F.concat(F.lit("@"), "c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("location"),
        F.when(m(3) != 0, domain("d")).alias("normalized_domain"),
        F.when(m(5) != 0, domain("v")).alias("verified_domain"),
        F.when(m(2) != 0, domain("r")).alias("raw_domain"),
        F.when(m(8) != 0, m(101) / 100.0).alias("verification_confidence"),
        text("in", ":c_custkey").alias("input"),
        F.when(m(4) == 0, F.col("c_mktsegment")).when(m(4) == 1, "").alias("industry"),
        F.when(m(6) == 0, text("niche ", ":c_custkey")).alias("niche"),
        F.when(m(12) == 5, "  ").alias("description"),
        F.when(m(9) == 0, text("Street ", ":c_custkey")).alias("address"),
        F.when(m(9) == 1, text("+1 555 ", ":c_custkey")).alias("phone"),
        F.when(m(7) == 3, text("market ", ":c_custkey")).alias("target_market"),
        F.when(m(5) == 1, F.array(F.lit("case a"), text("case ", ":c_custkey")))
        .when(m(5) == 2, F.array().cast("array<string>")).alias("case_studies"),
        F.when(m(5) == 3, F.array(text("info@d", ":c_custkey", ".example.com"))).alias("general_emails"),
        F.when(m(8) == 1, text("home ", ":c_custkey")).alias("homepage_raw_text"),
        (m(4) != 2).alias("has_extracted"),
        F.when(m(4) == 1, F.slice(one, 1, 0)).when(m(4) == 2, one)
        .when(m(4) == 3, F.array(contact(0), contact(1))).alias("contacts"),
    )
