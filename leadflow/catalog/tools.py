"""The six tools end to end, and the row statuses they leave."""

import os
import re
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from leadflow.catalog.base import VIEWS, div, firm_answers, firms, mod, query, table, text, view
from leadflow.catalog.contacts import FITS, REAL, WANTED, directory, people_text
from leadflow.catalog.discover import articles, funding_answers, person_results, persons
from leadflow.catalog.verify import batches_view, searched, verdict_answers, verdict_sql
from leadflow.functions import fixed
from leadflow.functions.workspace import workspace
from leadflow.operators import discover, entities, ingest, verify
from leadflow.operators.contacts import RECORD_FIELDS
from leadflow.plans import cache, tools
from leadflow.plans.stages import Providers, written
from leadflow.streaming import phases

OPTIONS = ["industry_description", "homepage_raw_text", "company_people"]

# --- what the providers know about the firms --------------------------------------------------


def firm_keys(spark, d):
    return table(spark, d, "customer").filter(mod("c_custkey", 3) == 0).select(div("c_custkey", 3).alias("k"))


def firm_domain(k="k"):
    return text("firm", F.col(k), "-1.com")


def all_answers(spark, d):
    """Answers under the firm's own place and under no place."""
    own = firm_answers(spark, d)
    none = own.filter(~F.col("request_key").endswith("|")).withColumn("request_key", F.regexp_replace("request_key", r"\|.*$", "|"))
    return own.unionByName(none)


def flow_directory(spark, d):
    return directory(spark, d).join(
        table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), text("firm", div("o_custkey", 3), "-1.com").alias("_d")), "pos"
    ).withColumn("domain", F.col("_d")).drop("_d")


def site_facts(spark, d):
    k = F.col("k")
    known = firm_keys(spark, d).filter(k % 4 != 3)
    mail = F.when(k % 4 == 0, text(" Info@firm", k, "-1.com")).otherwise("")
    pages = known.filter(k % 4 < 2).select(
        firm_domain().alias("domain"), F.lit(0).cast("long").alias("ordinal"), F.concat(F.lit("https://"), firm_domain()).alias("url"), text("home of ", k, mail).alias("text")
    )
    body = F.when(k % 2 == 0, text('{"industry": "', F.when(k % 12 == 6, " ").otherwise(text("ind ", k)), '"}')).otherwise("{}")
    return known.select(firm_domain().alias("domain")), pages, known.select(firm_domain().alias("domain"), body.alias("body"))


def with_verdicts(p: Providers, rows, spark, d):
    """The provider's verdicts about the rows that have to be checked."""
    names = rows.filter(F.coalesce(F.col("input_type") != "url", F.lit(True)))
    if "location" not in names.columns:
        names = names.withColumn("location", F.lit(""))
    names = names.select("row_index", "input", "input_type", F.col("input").alias("company_name"), "location")
    found = discover.fan_out_search(names, discover.parse_search_responses(p.search))
    items = verify.verify_items_intel(verify.resolve_rows(names, found))
    numbered = written(verify.number_batches(items).select("batch_id", "row_index"), "asked")
    return replace(p, verdicts=verdict_answers(numbered))


def intel_providers(spark, d):
    crawled, pages, answers = site_facts(spark, d)
    return Providers(search=all_answers(spark, d), directory=flow_directory(spark, d), crawled=crawled, site_pages=pages, extractions=answers)


view(
    "flow_lists",
    f"""SELECT domain, string_agg(first_name || '/' || last_name || '/' || email, ';' ORDER BY r) AS people FROM (
        SELECT *, row_number() OVER (PARTITION BY domain ORDER BY title_idx, pos) AS r FROM (
          SELECT *, row_number() OVER (PARTITION BY domain, key ORDER BY title_idx, pos) AS n FROM (
            SELECT rec.* EXCLUDE (domain), 'firm' || (o_custkey // 3) || '-1.com' AS domain,
                   CASE WHEN email <> '' AND upper(email) <> 'N/A' THEN 'm' || lower(email) WHEN first_name <> '' OR last_name <> '' THEN 'n' || lower(first_name || '|' || last_name)
                   ELSE 'r' || pos END AS key FROM records rec JOIN orders ON o_orderkey = pos WHERE {FITS} AND {REAL})) WHERE n = 1) GROUP BY domain""",
    ("records",),
)

# --- website finder ---------------------------------------------------------------------------

view(
    "websites",
    """SELECT row_index, raw_domain, verified_domain, verification_confidence, norm AS normalized_domain,
       CASE WHEN verified_domain IS NULL THEN status WHEN norm IS NULL THEN 'blocked' WHEN people <> '' THEN 'enriched' ELSE 'normalized' END AS status,
       CASE WHEN norm IS NOT NULL THEN coalesce(people, '') END AS people
       FROM (SELECT v.*, CASE WHEN verified_domain IS NULL THEN NULL WHEN verified_domain LIKE 'alt%' THEN 'example.org' WHEN k % 5 = 1 THEN 'moved' || k || '.net' WHEN k % 5 <> 2 THEN verified_domain END AS norm
             FROM (SELECT verified.*, row_index // 3 AS k FROM verified) v) LEFT JOIN flow_lists ON domain = norm""",
    ("verified", "flow_lists"),
)


def website_providers(spark, d):
    k = F.col("k")
    redirects = firm_keys(spark, d).filter((k % 5 == 1) | (k % 5 == 2)).select(
        firm_domain().alias("domain"), F.when(k % 5 == 1, text("https://moved", k, ".net/")).otherwise("https://x.com/a").alias("final_url")
    )
    items = written(verify.number_batches(verify.verify_items(searched(spark, d))).select("batch_id", "row_index"), "asked")
    return Providers(search=firm_answers(spark, d), verdicts=verdict_answers(items), redirects=redirects, directory=flow_directory(spark, d))


def websites(spark, d):
    return tools.website_finder(firms(spark, d).select("row_index", "company_name", "location"), website_providers(spark, d), WANTED)


# the finder over a cache that is empty at first: each run's missing answers are added for the next one
def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def served(spark, d, missing, p):
    """What the services answer to the requests that a run lacked: (cache_key, payload)."""
    asked = lambda kind, name: missing.filter(F.col("kind") == kind).select("cache_key", F.get_json_object("request", f"$.{name}").alias(name))
    found = asked("serper", "request_key").join(p.search.groupBy("request_key").agg(F.min("body").alias("payload")), "request_key")
    made = found.select("cache_key", "payload")
    if p.directory is not None:
        record = F.struct("title_idx", "pos", *[c for c in RECORD_FIELDS if c in p.directory.columns])
        lists = p.directory.groupBy("domain").agg(F.to_json(F.sort_array(F.collect_list(record))).alias("payload"))
        listed = asked("enrich", "domain").join(lists, "domain", "left").select("cache_key", F.coalesce("payload", F.lit("[]")).alias("payload"))
        made = made.unionByName(listed)
    if p.site_pages is not None:
        page = F.struct("ordinal", "url", "text")
        sites = p.crawled.join(p.site_pages.groupBy("domain").agg(F.to_json(F.sort_array(F.collect_list(page))).alias("pages")), "domain", "left")
        crawled = asked("scrape", "domain").join(sites, "domain").select("cache_key", F.coalesce("pages", F.lit(" []")).alias("payload"))
        read = asked("intel", "domain").join(p.extractions, "domain").select("cache_key", F.col("body").alias("payload"))
        made = made.unionByName(crawled).unionByName(read)
    return made


def over_cache(spark, d, p, tool, runs):
    """Results of the last run, and what every run had to fetch."""
    folder, asked = cache.create_cache(spark, workspace(spark, "cache"), 16), []
    for run in range(runs):
        ans = cache.CachedAnswers(folder, now(), WANTED)
        rows = tool(ans.providers(verdicts=p.verdicts, redirects=p.redirects))
        asked.append(written(ans.to_fetch(), "to-fetch"))
        if run + 1 < runs:
            cache.add_answers(cache.fetched(asked[-1], served(spark, d, asked[-1], p), now()), folder)
    return rows, asked


def finder_over_cache(spark, d, runs):
    p = website_providers(spark, d)
    p = replace(p, verdicts=written(p.verdicts, "verdicts"))
    rows = firms(spark, d).select("row_index", "company_name", "location")
    return over_cache(spark, d, p, lambda cached: tools.website_finder(rows, cached, WANTED), runs)


@query("website_finder_cached", "SELECT * FROM websites", ("websites",))
def website_finder_cached(spark, d):
    out = finder_over_cache(spark, d, 3)[0].withColumn("people", people_text(F.col("contacts")))
    return out.select("row_index", "raw_domain", "verified_domain", "verification_confidence", "normalized_domain", "status", "people")


# an empty cache lacks every search; with the searches known, the contacts of every domain; then the searches nobody answered
@query(
    "website_finder_to_fetch",
    """SELECT 0 AS run, 'serper' AS kind, count(DISTINCT lower(company_name) || '|' || lower(location)) AS n FROM firms
       UNION ALL SELECT 1, 'serper', count(DISTINCT lower(company_name) || '|' || lower(location)) FROM firms WHERE lower(company_name) || '|' || lower(location) NOT IN (SELECT request_key FROM firm_answers)
       UNION ALL SELECT 1, 'enrich', count(DISTINCT normalized_domain) FROM websites
       UNION ALL SELECT 2, 'serper', count(DISTINCT lower(company_name) || '|' || lower(location)) FROM firms WHERE lower(company_name) || '|' || lower(location) NOT IN (SELECT request_key FROM firm_answers)""",
    ("firms", "firm_answers", "websites"),
)
def website_finder_to_fetch(spark, d):
    runs = [a.select(F.lit(i).alias("run"), "kind") for i, a in enumerate(finder_over_cache(spark, d, 3)[1])]
    every = runs[0].unionByName(runs[1]).unionByName(runs[2])
    return every.groupBy("run", "kind").agg(F.count(F.lit(1)).alias("n"))


# the same phases as a chain of streams over rows that arrive in files of whole blocks
@query(
    "phase_stream",
    """SELECT row_index, raw_domain, verified_domain, verification_confidence, normalized_domain,
       CASE WHEN status = 'enriched' THEN 'normalized' ELSE status END AS status FROM websites""",
    ("websites",),
)
def phase_stream(spark, d):
    block = F.floor(F.col("row_index") / fixed.ROW_BATCH)
    rows = written(firms(spark, d).select("row_index", "company_name", "location").repartition(block), "rows-in")
    p = website_providers(spark, d)
    p = replace(p, search=written(p.search, "search"), verdicts=written(p.verdicts, "verdicts"))  # read by every batch
    folder = workspace(spark, "phases")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(os.path.dirname(rows.inputFiles()[0]))
    phases.phase_stream(arriving, tools.website_phases(p), folder, together=block).drain()
    found = phases.phase_rows(spark, folder, "normalized")
    return found.select("row_index", "raw_domain", "verified_domain", "verification_confidence", "normalized_domain", "status")


@query("website_finder", "SELECT * FROM websites", ("websites",))
def website_finder(spark, d):
    out = websites(spark, d).withColumn("people", people_text(F.col("contacts")))
    return out.select("row_index", "raw_domain", "verified_domain", "verification_confidence", "normalized_domain", "status", "people")


# --- company intel and the tools in front of it -----------------------------------------------


def intel_view(tool: str, rows_sql: str, needs: tuple[str, ...] = ()) -> None:
    """Expected result of a tool whose rows are (row_index, k, input_type, url_host)."""
    view(f"{tool}_rows", rows_sql, needs)
    view(
        f"{tool}_resolved",
        f"""SELECT r.row_index, r.k, r.input_type, CASE WHEN r.input_type = 'url' THEN r.url_host ELSE nullif(a.candidate, '') END AS raw_domain
            FROM {tool}_rows r LEFT JOIN firm_answers a ON a.k = r.k""",
        (f"{tool}_rows", "firm_answers"),
    )
    batches_view(f"{tool}_batches", f"{tool}_resolved", "raw_domain IS NOT NULL AND input_type = 'name'")
    view(f"{tool}_verdicts", verdict_sql(f"{tool}_batches"), (f"{tool}_batches",))
    view(
        f"{tool}_final",
        f"""SELECT row_index, raw_domain, CASE WHEN crawled THEN raw_domain END AS normalized_domain,
            CASE WHEN raw_domain IS NULL THEN 'not_found' WHEN NOT crawled THEN 'scrape_failed' WHEN people <> '' THEN 'enriched' WHEN trim(industry) <> '' THEN 'extracted' ELSE 'extract_failed' END AS status,
            industry, CASE WHEN crawled THEN home END AS homepage_raw_text, mails, CASE WHEN crawled THEN coalesce(people, '') END AS people
            FROM (SELECT f.row_index, f.raw_domain, q.fk IS NOT NULL AS crawled, CASE WHEN fk % 2 = 0 THEN CASE WHEN fk % 12 = 6 THEN ' ' ELSE 'ind ' || fk END END AS industry,
                  CASE WHEN fk % 4 < 2 THEN 'home of ' || fk || CASE WHEN fk % 4 = 0 THEN ' Info@firm' || fk || '-1.com' ELSE '' END ELSE '' END AS home,
                  CASE WHEN fk % 4 = 0 THEN 'info@firm' || fk || '-1.com' END AS mails, people
                  FROM (SELECT r.row_index, CASE WHEN v.row_index IS NULL OR (v.match AND v.confidence >= 0.7) THEN r.raw_domain ELSE v.suggested_domain END AS raw_domain
                        FROM {tool}_resolved r LEFT JOIN {tool}_verdicts v ON v.row_index = r.row_index) f
                  LEFT JOIN (SELECT c_custkey // 3 AS fk, 'firm' || (c_custkey // 3) || '-1.com' AS domain FROM customer WHERE c_custkey % 3 = 0 AND (c_custkey // 3) % 4 <> 3) q ON q.domain = f.raw_domain
                  LEFT JOIN flow_lists l ON l.domain = f.raw_domain)""",
        (f"{tool}_resolved", f"{tool}_verdicts", "flow_lists"),
    )


def intel_columns(df):
    mails = F.array_join("general_emails", ",")
    return df.withColumn("mails", mails).withColumn("people", people_text(F.col("contacts"))).select(
        "row_index", "raw_domain", "normalized_domain", "status", "industry", "homepage_raw_text", "mails", "people"
    )


def run_intel(rows, spark, d):
    rows = written(rows, "rows")
    p = with_verdicts(intel_providers(spark, d), rows, spark, d)
    return tools.company_intel(rows, p, OPTIONS, titles=WANTED)


intel_view(
    "company",
    """SELECT row_index, k, CASE WHEN row_index % 4 = 1 THEN 'url' ELSE 'name' END AS input_type,
       CASE WHEN row_index % 8 = 1 THEN 'firm' || k || '-1.com' WHEN row_index % 8 = 5 THEN 'shop.example.org:8080' END AS url_host FROM firms""",
    ("firms",),
)


def company_rows(spark, d):
    r = F.col("row_index")
    url = F.when(r % 8 == 1, text("https://www.FIRM", ":k", "-1.com/x")).when(r % 8 == 5, "shop.example.org:8080/a")
    lines = firms(spark, d).select("row_index", "location", F.coalesce(url, "company_name").alias("line"))
    return ingest.classify_inputs(lines).select("row_index", "input", "input_type", "location")


@query("company_intel", "SELECT * FROM company_final", ("company_final",))
def company_intel(spark, d):
    return intel_columns(run_intel(company_rows(spark, d), spark, d))


intel_view(
    "category",
    """SELECT p_partkey AS row_index, p_partkey // 5 AS k, CASE WHEN p_partkey % 3 = 0 THEN 'url' ELSE 'name' END AS input_type,
       CASE WHEN p_partkey % 3 = 0 THEN 'firm' || (p_partkey // 5) || '-1.com' END AS url_host FROM part""",
)


@query("category_intel", "SELECT * FROM category_final", ("category_final",))
def category_intel(spark, d):
    k = div("p_partkey", 5)
    rows = ingest.seed_category_rows(
        table(spark, d, "part").select(
            F.col("p_partkey").alias("row_index"), text("Firm ", k).alias("name"), F.when(mod("p_partkey", 3) == 0, text("firm", k, "-1.com")).alias("website"),
            F.lit("u").alias("g2_url"), F.col("p_brand").alias("g2_category"), F.lit(4.5).alias("rating"), F.lit(3).alias("review_count"),
        )
    )
    return intel_columns(run_intel(rows, spark, d))


intel_view(
    "maps",
    """SELECT c_custkey AS row_index, c_custkey // 4 AS k, CASE WHEN c_custkey % 5 < 2 THEN 'url' ELSE 'name' END AS input_type,
       CASE c_custkey % 5 WHEN 0 THEN 'firm' || (c_custkey // 4) || '-1.com' WHEN 1 THEN 'other.example.net' END AS url_host FROM customer""",
)


@query("maps_intel", "SELECT * FROM maps_final", ("maps_final",))
def maps_intel(spark, d):
    k = div("c_custkey", 4)
    m = mod("c_custkey", 5)
    none = F.lit(None).cast("string")
    rows = ingest.seed_place_rows(
        table(spark, d, "customer").select(
            F.col("c_custkey").alias("row_index"), text("FIRM ", k).alias("title"), F.lit("cafe").alias("search_term"), none.alias("location"), none.alias("category"),
            none.alias("address"), none.alias("phoneNumber"), none.alias("cid"), F.lit(1.0).alias("rating"), F.lit(1).alias("ratingCount"), F.lit(1.0).alias("latitude"), F.lit(1.0).alias("longitude"),
            F.when(m == 0, text("http://www.Firm", k, "-1.com/a")).when(m == 1, "https://other.example.net").alias("website"),
        )
    )
    return intel_columns(run_intel(rows, spark, d))


# funded companies of the news answers, numbered by first appearance
view(
    "funding_numbered",
    """SELECT row_number() OVER (ORDER BY batch_id, pos) - 1 AS row_index, company_name, funding_round FROM (
       SELECT lower(trim(company_name)) AS nm, lower(trim(funding_round)) AS rd, min(batch_id * 2 + pos) AS o, arg_min(batch_id, batch_id * 2 + pos) AS batch_id, arg_min(pos, batch_id * 2 + pos) AS pos,
              any_value(lower(trim(company_name))) AS company_name, any_value(lower(trim(funding_round))) AS funding_round FROM funded WHERE trim(company_name) <> '' GROUP BY 1, 2)""",
    ("funded",),
)
intel_view(
    "funding",
    "SELECT row_index, regexp_extract(company_name, '([0-9]+)')::BIGINT AS k, 'name' AS input_type, NULL::VARCHAR AS url_host FROM funding_numbered",
    ("funding_numbered",),
)


@query("funding_intel", "SELECT * FROM funding_final", ("funding_final",))
def funding_intel(spark, d):
    found = written(tools.funded_companies(articles(spark, d), funding_answers(spark, d), "pos"), "funded")
    ordered = discover.dense_index(found.withColumn("_o", F.col("first_seen.batch_id") * 2 + F.col("first_seen.pos")), "_o", "row_index")
    rows = ingest.seed_funding_rows(ordered.drop("_o", "first_seen").withColumn("company_name", F.trim("company_name")))
    return intel_columns(run_intel(rows, spark, d))


# --- people intel: no crawl, one contact per person -------------------------------------------

view(
    "people_rows_expected",
    """SELECT p.row_index, p.k, regexp_extract(p.company_name, '([0-9]+)') AS f, p.full_name, p.company_name, pr.linkedin_url,
       CASE WHEN p.row_index % 5 = 2 THEN 'url' ELSE 'name' END AS input_type FROM persons p JOIN profile_rows pr USING (row_index)""",
    ("persons", "profile_rows"),
)
view(
    "people_resolved",
    """SELECT e.row_index, e.full_name, e.linkedin_url, e.input_type, CASE WHEN e.input_type = 'url' THEN 'firm' || (e.row_index // 20) || '-1.com' ELSE nullif(a.candidate, '') END AS raw_domain
       FROM people_rows_expected e LEFT JOIN firm_answers a ON a.k = try_cast(e.f AS BIGINT)""",
    ("people_rows_expected", "firm_answers"),
)
batches_view("people_batches", "people_resolved", "raw_domain IS NOT NULL AND input_type = 'name'")
view("people_verdicts", verdict_sql("people_batches"), ("people_batches",))
view(
    "flow_records",
    "SELECT rec.* EXCLUDE (domain), 'firm' || (o_custkey // 3) || '-1.com' AS domain FROM records rec JOIN orders ON o_orderkey = pos",
    ("records",),
)
view(
    "people_final",
    f"""SELECT f.row_index, f.linkedin_url, f.raw_domain, f.raw_domain AS normalized_domain, coalesce(u.email, n.email) AS email, coalesce(u.pos, n.pos) IS NOT NULL AS found,
        CASE WHEN coalesce(u.pos, n.pos) IS NOT NULL THEN 'enriched' WHEN f.raw_domain IS NULL THEN 'not_found' ELSE 'extracted' END AS status
        FROM (SELECT r.row_index, r.full_name, r.linkedin_url, CASE WHEN v.row_index IS NULL OR (v.match AND v.confidence >= 0.7) THEN r.raw_domain ELSE v.suggested_domain END AS raw_domain
              FROM people_resolved r LEFT JOIN people_verdicts v ON v.row_index = r.row_index) f
        LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY linkedin_url ORDER BY pos) AS n FROM flow_records WHERE linkedin_url <> '') WHERE n = 1 AND {REAL}) u ON u.linkedin_url = f.linkedin_url
        LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, lower(first_name), lower(last_name) ORDER BY pos) AS n FROM flow_records
                   WHERE first_name <> '' AND last_name <> '') WHERE n = 1 AND {REAL}) n ON n.domain = f.raw_domain AND lower(n.first_name || ' ' || n.last_name) = lower(trim(f.full_name))""",
    ("people_resolved", "people_verdicts", "flow_records"),
)


def flow_people(spark, d):
    site = F.when(mod("row_index", 5) == 2, text("firm", div("row_index", 20), "-1.com")).otherwise("")
    return persons(spark, d).select("row_index", "full_name", "company_name", site.alias("website"))


@query("people_intel", "SELECT * FROM people_final", ("people_final",))
def people_intel(spark, d):
    answers = person_results(spark, d).select("request_key", F.to_json(F.struct(F.col("results").alias("organic"))).alias("body"))
    people = flow_people(spark, d)
    p = Providers(search=all_answers(spark, d), directory=flow_directory(spark, d), profiles=answers)
    seeds = people.withColumn("input", F.when(F.col("website") != "", F.col("website")).otherwise(F.col("company_name"))).withColumn(
        "input_type", F.when(F.col("website") != "", "url").otherwise("name")
    )
    p = with_verdicts(p, seeds.select("row_index", "input", "input_type"), spark, d)
    out = tools.people_intel(people, p)
    first = F.try_element_at("contacts", F.lit(1))
    return out.select("row_index", "linkedin_url", "raw_domain", "normalized_domain", first["email"].alias("email"), (F.size("contacts") > 0).alias("found"), "status")


@query(
    "funded_companies",
    "SELECT company_name AS nm, funding_round AS rd FROM funding_numbered",
    ("funding_numbered",),
)
def funded_companies(spark, d):
    found = tools.funded_companies(articles(spark, d), funding_answers(spark, d), "pos")
    return found.select(F.lower(F.trim("company_name")).alias("nm"), F.lower(F.trim("funding_round")).alias("rd"))


@query(
    "row_status_flow",
    """SELECT 'websites' AS tool, status, count(*) AS n_rows, true AS allowed FROM websites GROUP BY status
       UNION ALL SELECT 'intel', status, count(*), true FROM company_final GROUP BY status""",
    ("websites", "company_final"),
)
def row_status_flow(spark, d):
    counts = lambda df, tool: df.groupBy(F.lit(tool).alias("tool"), "status").agg(F.count(F.lit(1)).alias("n_rows"))
    both = counts(websites(spark, d), "websites").unionByName(counts(run_intel(company_rows(spark, d), spark, d), "intel"))
    unknown = entities.unknown_statuses(both).select("status", F.lit(False).alias("_ok"))
    return both.join(unknown, "status", "left").select("tool", "status", "n_rows", F.coalesce("_ok", F.lit(True)).alias("allowed"))


# rows are customers, their orders are snapshots that go through the website finder's statuses; some take a wrong step
view(
    "histories",
    """SELECT o_orderkey AS event_id, o_custkey AS row_index, o_orderdate::TIMESTAMP AS ts,
       CASE WHEN o_orderkey % 17 = 0 THEN 'pending' WHEN o_orderkey % 23 = 0 THEN 'crawled' WHEN o_orderkey % 29 = 0 THEN NULL
            ELSE ['pending', 'searched', 'verified', 'normalized', 'enriched'][least(n, 5)] END AS status
       FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)""",
)


@query(
    "row_status_steps",
    """SELECT event_id, row_index, status, previous_status, problem FROM (
         SELECT *, CASE WHEN n > 1 AND status IS NOT DISTINCT FROM previous_status THEN NULL
           WHEN n = 1 AND status = 'pending' THEN NULL
           WHEN status IS NULL OR status NOT IN ('pending', 'searched', 'verified', 'not_found', 'normalized', 'blocked', 'failed', 'enriched') THEN 'unknown status'
           WHEN n = 1 THEN 'begins elsewhere'
           WHEN (previous_status, status) IN (('pending', 'searched'), ('searched', 'verified'), ('verified', 'normalized'), ('normalized', 'enriched')) THEN NULL
           ELSE 'illegal step' END AS problem
         FROM (SELECT *, lag(status) OVER w AS previous_status, row_number() OVER w AS n FROM histories WINDOW w AS (PARTITION BY row_index ORDER BY ts, event_id)))
       WHERE problem IS NOT NULL""",
    ("histories",),
)
def row_status_steps(spark, d):
    o = F.col("o_orderkey")
    flow = F.array(*[F.lit(s) for s in ("pending", "searched", "verified", "normalized", "enriched")])
    place = F.least(F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")), F.lit(5))
    history = table(spark, d, "orders").select(
        o.alias("event_id"), F.col("o_custkey").alias("row_index"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.when(o % 17 == 0, "pending").when(o % 23 == 0, "crawled").when(o % 29 == 0, F.lit(None)).otherwise(F.element_at(flow, place)).alias("status"),
    )
    return entities.row_status_flow(history, fixed.WEBSITE_STEPS).drop("ts")


# --- many jobs in one table: their rows have equal numbers -------------------------------------

JOB_ROWS = 40
JOB_KEY = ("job_id", "row_index")


def jobs_view(name: str, of: str, **instead: str) -> None:
    """The view ``of`` with other views instead of the named ones."""
    needs, sql = VIEWS[of]
    for old, new in instead.items():
        sql = re.sub(rf"\b{old}\b(?=[ ).]|$)", new, sql)
    view(name, sql, tuple(instead.get(n, n) for n in needs))


def job_batches(name: str, source: str, condition: str) -> None:
    """Two batches of 20 a job, numbered through all jobs."""
    view(
        name,
        f"""SELECT *, (row_index // {JOB_ROWS}) * 2 + (n - 1) // 20 AS batch_id FROM (
            SELECT *, row_number() OVER (PARTITION BY row_index // {JOB_ROWS} ORDER BY row_index) AS n FROM {source} WHERE {condition})""",
        (source,),
    )


def of_jobs(source: str) -> str:
    return f"SELECT row_index // {JOB_ROWS} AS job_id, row_index % {JOB_ROWS} AS row_index, * EXCLUDE (row_index) FROM {source}"


job_batches("job_item_batches", "searched", "raw_domain IS NOT NULL")
view("job_verdicts", verdict_sql("job_item_batches"), ("job_item_batches",))
jobs_view("job_verified", "verified", verdicts="job_verdicts")
jobs_view("job_websites", "websites", verified="job_verified")
intel_view("jobs", VIEWS["company_rows"][1], ("firms",))
job_batches("jobs_batches", "jobs_resolved", "raw_domain IS NOT NULL AND input_type = 'name'")


def in_jobs(rows):
    """Rows with the number of their job and their number in it."""
    return rows.withColumns({"job_id": div("row_index", JOB_ROWS), "row_index": mod("row_index", JOB_ROWS)})


def job_answers(items):
    """The answers about the items of all jobs, in the numbers of each job."""
    numbered = written(verify.number_batches(items, key=JOB_KEY).select("job_id", "batch_id", "row_index"), "asked")
    through = numbered.select(
        (F.col("job_id") * JOB_ROWS + F.col("row_index")).alias("row_index"), (F.col("job_id") * 2 + F.col("batch_id")).alias("batch_id"),
        F.col("row_index").alias("number"),
    )
    return verdict_answers(through, "number").select(div("batch_id", 2).alias("job_id"), mod("batch_id", 2).alias("batch_id"), "body")


@query("website_finder_jobs", of_jobs("job_websites"), ("job_websites",))
def website_finder_jobs(spark, d):
    k = F.col("k")
    redirects = firm_keys(spark, d).filter((k % 5 == 1) | (k % 5 == 2)).select(
        firm_domain().alias("domain"), F.when(k % 5 == 1, text("https://moved", k, ".net/")).otherwise("https://x.com/a").alias("final_url")
    )
    answers = job_answers(verify.verify_items(in_jobs(searched(spark, d)), JOB_KEY))
    p = Providers(search=firm_answers(spark, d), verdicts=answers, redirects=redirects, directory=flow_directory(spark, d))
    rows = in_jobs(firms(spark, d)).select(*JOB_KEY, "company_name", "location")
    out = tools.website_finder(rows, p, WANTED, key=JOB_KEY).withColumn("people", people_text(F.col("contacts")))
    return out.select(*JOB_KEY, "raw_domain", "verified_domain", "verification_confidence", "normalized_domain", "status", "people")


@query("company_intel_jobs", of_jobs("jobs_final"), ("jobs_final",))
def company_intel_jobs(spark, d):
    rows = written(in_jobs(company_rows(spark, d)), "rows")
    p = intel_providers(spark, d)
    names = rows.filter(F.coalesce(F.col("input_type") != "url", F.lit(True))).withColumn("company_name", F.col("input"))
    found = discover.fan_out_search(names, discover.parse_search_responses(p.search))
    items = verify.verify_items_intel(verify.resolve_rows(names, found, JOB_KEY), JOB_KEY)
    out = tools.company_intel(rows, replace(p, verdicts=job_answers(items)), OPTIONS, titles=WANTED, key=JOB_KEY)
    columns = intel_columns(out.withColumn("row_index", F.struct(*JOB_KEY)))
    return columns.select("row_index.job_id", "row_index.row_index", *columns.columns[1:])
