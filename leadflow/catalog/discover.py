"""Discovery operators over the given tables."""

from pyspark.sql import functions as F

from leadflow.catalog.base import case, div, firm_answers, firms, mod, query, table, text, view
from leadflow.functions import fixed
from leadflow.operators import discover, listing
from leadflow.plans.stages import written

# --- web search -----------------------------------------------------------------------------


@query(
    "search_requests",
    """SELECT lower(company_name) || '|' || lower(location) AS request_key, min(row_index) AS first_row, count(*) AS n_rows,
       '"firm ' || k || '" ' || CASE WHEN location = '' THEN '' ELSE lower(location) || ' ' END || 'official website' AS query
       FROM firms GROUP BY k, lower(company_name), lower(location), CASE WHEN location = '' THEN '' ELSE lower(location) || ' ' END""",
    ("firms",),
)
def search_requests(spark, d):
    return discover.search_requests(firms(spark, d))


def _flat_results(df):
    """Result list as text, one line per result."""
    line = F.transform("results", lambda r: F.concat_ws(" | ", r["title"], r["link"], r["snippet"], r["domain"]))
    return df.withColumn("results", F.array_join(line, "\n"))


RESULT_TEXT = """array_to_string(list_transform(range(1, n_results + 1), lambda i: 'Firm ' || k || ' site ' || i ||
    ' | https://www.firm' || k || '-' || i || '.com/home?x=1 | about firm ' || k || ' | firm' || k || '-' || i || '.com'), chr(10))"""


@query(
    "parse_search_responses",
    f"SELECT request_key, CASE WHEN n_results IS NOT NULL THEN {RESULT_TEXT} END AS results, candidate AS candidate_domain FROM firm_answers",
    ("firm_answers",),
)
def parse_search_responses(spark, d):
    return _flat_results(discover.parse_search_responses(firm_answers(spark, d)))


@query(
    "fan_out_search",
    f"""SELECT f.row_index, f.k, f.company_name, f.location,
       CASE WHEN n_results IS NOT NULL THEN {RESULT_TEXT.replace(' k ', ' a.k ')} END AS results,
       coalesce(candidate, '') AS candidate_domain
       FROM firms f LEFT JOIN firm_answers a ON a.k = f.k""".replace("|| k ||", "|| a.k ||").replace("|| k\n", "|| a.k\n"),
    ("firms", "firm_answers"),
)
def fan_out_search(spark, d):
    out = discover.fan_out_search(firms(spark, d), discover.parse_search_responses(firm_answers(spark, d)))
    return _flat_results(out.withColumn("results", F.col("search_results.results"))).drop("search_results")


# --- profile search: people of one firm, in two spellings ------------------------------------

view(
    "persons",
    """SELECT c_custkey AS row_index, c_custkey // 2 AS k,
       CASE WHEN c_custkey % 2 = 1 THEN ' ANN lee' || (c_custkey // 2) ELSE 'Ann Lee' || (c_custkey // 2) || ' ' END AS full_name,
       CASE WHEN (c_custkey // 2) % 9 = 4 THEN '' ELSE 'Firm ' || (c_custkey // 20) END AS company_name FROM customer""",
)
view(
    "person_answers",
    """SELECT k, 'ann lee' || k || '|' || lower(company_name) AS request_key, full_name, company_name,
       CASE WHEN k % 6 = 0 THEN '' WHEN k % 6 = 1 THEN '' WHEN k % 6 = 5 THEN 'https://linkedin.com/in/first' || k
            ELSE 'https://uk.LinkedIn.com/in/ann-' || k END AS linkedin_url,
       CASE WHEN k % 6 IN (0, 1) THEN 0.0::DOUBLE WHEN k % 6 = 2 THEN CASE WHEN company_name = '' THEN 0.9 ELSE 0.8 END
            WHEN k % 6 = 3 THEN 0.9 ELSE 0.5 END AS confidence
       FROM persons WHERE row_index % 2 = 0 AND k % 8 <> 7""",
    ("persons",),
)


def persons(spark, d):
    k = div("c_custkey", 2)
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("row_index"), k.alias("k"),
        F.when(mod("c_custkey", 2) == 1, text(" ANN lee", k)).otherwise(text("Ann Lee", k, " ")).alias("full_name"),
        F.when(k % 9 == 4, "").otherwise(text("Firm ", div("c_custkey", 20))).alias("company_name"),
    )


def person_results(spark, d):
    """One answer per person: none, without a profile, or with one at several places."""
    k = F.col("k")
    hit = F.struct(text("Ann Lee", k, " - CEO").alias("title"), text("https://uk.LinkedIn.com/in/ann-", k, "/?x=1#y").alias("link"), F.lit("profile").alias("snippet"))
    told = F.struct(hit["title"].alias("title"), F.lit("https://news.example.com/").alias("link"), F.concat(F.lit("Works at "), F.lower("company_name")).alias("snippet"))
    other = F.struct(F.lit("Somebody").alias("title"), text("https://linkedin.com/in/first", k).alias("link"), F.lit("").alias("snippet"))
    news = F.struct(F.lit("News").alias("title"), F.lit("https://news.example.com/").alias("link"), F.lit("").alias("snippet"))
    results = (
        F.when(k % 6 == 0, F.slice(F.array(news), 1, 0)).when(k % 6 == 1, F.array(news, news, news, hit)).when(k % 6 == 2, F.array(hit))
        .when(k % 6 == 3, F.array(told, hit)).when(k % 6 == 4, F.array(news, hit)).otherwise(F.array(other, hit))
    )
    rows = persons(spark, d).filter((mod("row_index", 2) == 0) & (k % 8 != 7))
    return rows.select(discover.profile_key().alias("request_key"), "full_name", "company_name", "k", results.alias("results"))


@query(
    "profile_requests",
    """SELECT 'ann lee' || k || '|' || lower(company_name) AS request_key, full_name, company_name,
       'site:linkedin.com/in/ "' || trim(full_name) || '" "' || company_name || '"' AS query FROM persons WHERE row_index % 2 = 0""",
    ("persons",),
)
def profile_requests(spark, d):
    return discover.profile_requests(persons(spark, d))


@query("pick_profile", "SELECT request_key, linkedin_url FROM person_answers", ("person_answers",))
def pick_profile(spark, d):
    return discover.pick_profile(person_results(spark, d)).select("request_key", "linkedin_url")


@query("score_profile", "SELECT request_key, linkedin_url, confidence FROM person_answers", ("person_answers",))
def score_profile(spark, d):
    return discover.score_profile(discover.pick_profile(person_results(spark, d))).select("request_key", "linkedin_url", "confidence")


PROFILE_FAN = """SELECT p.row_index, p.k, p.full_name, p.company_name, coalesce(linkedin_url, '') AS linkedin_url,
    coalesce(confidence, 0.0) AS confidence FROM persons p LEFT JOIN person_answers a ON a.k = p.k"""
view("profile_rows", PROFILE_FAN, ("persons", "person_answers"))


@query("fan_out_profiles", "SELECT * FROM profile_rows", ("profile_rows",))
def fan_out_profiles(spark, d):
    return discover.fan_out_profiles(persons(spark, d), score_profile(spark, d))


@query(
    "profile_hit_rate",
    """SELECT count(*) AS searched, count(*) FILTER (WHERE linkedin_url <> '') AS found,
       count(*) FILTER (WHERE linkedin_url <> '') / count(*) * 100 AS hit_rate FROM profile_rows""",
    ("profile_rows",),
)
def profile_hit_rate(spark, d):
    return discover.profile_hit_rate(fan_out_profiles(spark, d))


# --- map search: 40 places per search, half of them from tiles -------------------------------

view(
    "places",
    """SELECT c_custkey // 40 AS search_idx, (c_custkey % 40) // 10 AS call, c_custkey % 10 AS pos, c_name AS title,
       CASE WHEN c_custkey % 11 = 3 THEN '' ELSE 'p' || (c_custkey % 23) END AS placeId,
       CASE WHEN c_custkey % 3 = 0 THEN 'cid' || c_custkey % 5 END AS cid,
       CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'www.noscheme.com' ELSE 'https://www.Shop' || (c_custkey % 77) || '.example.com/x' END AS website,
       CASE WHEN c_custkey % 13 <> 5 THEN c_nationkey + (c_custkey % 50) / 100.0::DOUBLE END AS latitude,
       c_nationkey * 2 + (c_custkey % 30) / 100.0::DOUBLE AS longitude,
       'Town ' || (c_custkey // 80) AS location, c_mktsegment AS search_term
       FROM customer WHERE NOT ((c_custkey // 40) % 9 = 4 AND (c_custkey % 40) < 10)""",
)


def places(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").filter(~((div("c_custkey", 40) % 9 == 4) & (k % 40 < 10)))
    return rows.select(
        div("c_custkey", 40).alias("search_idx"), F.floor((k % 40) / 10).alias("call"), (k % 10).alias("pos"),
        F.col("c_name").alias("title"), F.when(k % 11 == 3, "").otherwise(text("p", k % 23)).alias("placeId"),
        F.when(k % 3 == 0, text("cid", k % 5)).alias("cid"),
        F.when(k % 5 == 1, "www.noscheme.com").when(k % 5 != 0, text("https://www.Shop", k % 77, ".example.com/x")).alias("website"),
        F.when(k % 13 != 5, F.col("c_nationkey") + (k % 50) / 100.0).alias("latitude"),
        (F.col("c_nationkey") * 2 + (k % 30) / 100.0).alias("longitude"),
        text("Town ", div("c_custkey", 80)).alias("location"), F.col("c_mktsegment").alias("search_term"),
    )


view(
    "place_plan",
    "SELECT c_custkey AS search_idx, c_mktsegment AS search_term, CASE WHEN c_custkey % 4 = 1 THEN '' ELSE 'Town ' || (c_custkey % 50) END AS location FROM customer",
)


def place_plan(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("search_idx"), F.col("c_mktsegment").alias("search_term"), F.when(k % 4 == 1, "").otherwise(text("Town ", k % 50)).alias("location")
    )


# six tiles: two rows of three
view(
    "tiles",
    """SELECT search_idx, tile::INTEGER AS tile, lat0 + (lat1 - lat0) * (tile // 3) AS latitude, lng0 + (lng1 - lng0) * ((tile % 3) / 2) AS longitude
       FROM (SELECT search_idx,
         greatest(lo - greatest(0.02, (hi - lo) * 0.15), c - 50.0 / 111.0) AS lat0,
         least(hi + greatest(0.02, (hi - lo) * 0.15), c + 50.0 / 111.0) AS lat1,
         greatest(llo - greatest(0.02, (lhi - llo) * 0.15), lc - 50.0 / (111.0 * greatest(0.1, cos(radians(c))))) AS lng0,
         least(lhi + greatest(0.02, (lhi - llo) * 0.15), lc + 50.0 / (111.0 * greatest(0.1, cos(radians(c))))) AS lng1
         FROM (SELECT search_idx, avg(latitude) AS c, min(latitude) AS lo, max(latitude) AS hi, avg(longitude) AS lc,
                      min(longitude) AS llo, max(longitude) AS lhi
               FROM places WHERE call = 0 AND latitude IS NOT NULL GROUP BY search_idx HAVING count(*) >= 2)),
       range(6) AS t(tile)""",
    ("places",),
)


def tiles(spark, d):
    return discover.place_tiles(places(spark, d).filter(F.col("call") == 0), fixed.MAX_TILES)


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("latitude", "longitude")})


@query(
    "place_tiles",
    "SELECT search_idx, tile, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM tiles",
    ("tiles",),
)
def place_tiles(spark, d):
    return _rounded(tiles(spark, d))


@query(
    "place_requests",
    """SELECT search_idx, 0 AS call, CASE WHEN location <> '' THEN search_term || ' in ' || location ELSE search_term END AS query, '' AS anchor FROM place_plan
       UNION ALL SELECT search_idx, tile + 1, search_term, format('@{:.6f},{:.6f},12z', latitude, longitude) FROM tiles JOIN place_plan USING (search_idx)""",
    ("place_plan", "tiles"),
)
def place_requests(spark, d):
    return discover.place_requests(place_plan(spark, d), tiles(spark, d))


COLLECTED = """SELECT * EXCLUDE (id, n, r) FROM (SELECT *, row_number() OVER (PARTITION BY search_idx ORDER BY call, pos) AS r FROM (
    SELECT *, row_number() OVER (PARTITION BY search_idx, id ORDER BY call, pos) AS n FROM (
      SELECT *, CASE WHEN placeId <> '' THEN placeId WHEN cid <> '' THEN cid ELSE title END AS id FROM places
      WHERE search_idx IN (SELECT search_idx FROM places WHERE call = 0)) WHERE id <> '') WHERE n = 1)"""
view("collected", COLLECTED, ("places",))


def collected(spark, d):
    return discover.place_collect(places(spark, d))


@query("place_collect", "SELECT * REPLACE (round(latitude, 6) AS latitude, round(longitude, 6) AS longitude) FROM collected", ("collected",))
def place_collect(spark, d):
    return _rounded(collected(spark, d))


@query(
    "place_collect_first_20",
    """SELECT * EXCLUDE (r) REPLACE (round(latitude, 6) AS latitude, round(longitude, 6) AS longitude)
       FROM (SELECT *, row_number() OVER (PARTITION BY search_idx ORDER BY call, pos) AS r FROM collected) WHERE r <= 20""",
    ("collected",),
)
def place_collect_first_20(spark, d):
    return _rounded(discover.place_collect(places(spark, d), cap=20))


view(
    "unique_places",
    """SELECT * EXCLUDE (key, n) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY search_idx, call, pos) AS n FROM (
       SELECT *, CASE WHEN website LIKE 'https://%' THEN 'host:' || regexp_extract(website, '//www.([^/]*)', 1)
                 ELSE 'name:' || lower(title) || '|' || lower(location) END AS key FROM collected)) WHERE n = 1""",
    ("collected",),
)


@query("place_dedupe", "SELECT * REPLACE (round(latitude, 6) AS latitude, round(longitude, 6) AS longitude) FROM unique_places", ("unique_places",))
def place_dedupe(spark, d):
    return _rounded(discover.place_dedupe(collected(spark, d)))


@query(
    "place_search_counts",
    """SELECT search_term, location, coalesce(n, 0) AS n_places, coalesce(n, 0) = 0 AS empty
       FROM (SELECT DISTINCT search_term, location FROM place_plan)
       LEFT JOIN (SELECT search_term, location, count(*) AS n FROM unique_places GROUP BY ALL) USING (search_term, location)""",
    ("place_plan", "unique_places"),
)
def place_search_counts(spark, d):
    return discover.place_search_counts(place_plan(spark, d), discover.place_dedupe(collected(spark, d)))


# --- category listings: 150 parts per category, 15 per page -----------------------------------

view(
    "listed",
    """SELECT 'cat-' || (p_partkey // 150) AS category, ((p_partkey % 150) // 15 + 1)::INTEGER AS page, (p_partkey % 15)::INTEGER AS pos,
       CASE WHEN (p_partkey // 150) % 3 = 1 AND (p_partkey % 150) // 15 = 4 THEN 'rep-' || (p_partkey % 15)
            WHEN (p_partkey % 150) // 15 = 0 THEN 'rep-' || (p_partkey % 15)
            ELSE replace(p_name, ' ', '-') || '-' || (p_partkey % 67) END AS slug,
       p_name AS name, CASE WHEN p_partkey % 4 = 0 THEN 'shop' || p_partkey || '.example.com' END AS website,
       CASE WHEN p_partkey % 3 = 0 THEN (p_size % 50) / 10.0::DOUBLE END AS rating,
       CASE WHEN p_partkey % 6 <> 5 THEN 1000 + p_partkey END AS review_count,
       CASE WHEN (p_partkey // 150) % 4 = 2 THEN 7 ELSE 1 END AS page_count
       FROM part WHERE NOT ((p_partkey // 150) % 5 = 4 AND (p_partkey % 150) // 15 = 2) AND NOT ((p_partkey // 150) % 7 = 3 AND (p_partkey % 150) // 15 = 0)""",
)


def listed(spark, d):
    k = F.col("p_partkey")
    cat, page = div("p_partkey", 150), F.floor((k % 150) / 15)
    own = text(F.replace("p_name", F.lit(" "), F.lit("-")), "-", k % 67)
    kept = ~((cat % 5 == 4) & (page == 2)) & ~((cat % 7 == 3) & (page == 0))
    return table(spark, d, "part").filter(kept).select(
        text("cat-", cat).alias("category"), (page + 1).cast("int").alias("page"), (k % 15).cast("int").alias("pos"),
        F.when(((cat % 3 == 1) & (page == 4)) | (page == 0), text("rep-", k % 15)).otherwise(own).alias("slug"),
        F.col("p_name").alias("name"), F.when(k % 4 == 0, text("shop", k, ".example.com")).alias("website"),
        F.when(k % 3 == 0, (F.col("p_size") % 50) / 10.0).alias("rating"), F.when(k % 6 != 5, k + 1000).alias("review_count"),
        F.when(cat % 4 == 2, 7).otherwise(1).alias("page_count"),
    )


def listing_pages(spark, d):
    """The same products as listing markup, at most 15 cards a page."""
    p = listed(spark, d)
    reviews = F.when(F.col("review_count").isNotNull(), F.concat(F.lit("("), F.format_number("review_count", 0), F.lit(")"))).otherwise("")
    rating = F.when(F.col("rating").isNotNull(), F.concat(F.format_number("rating", 1), F.lit(" out of 5"))).otherwise("")
    link = F.when(F.col("website").isNotNull(), text('<a href="/visit_website?url=https%3A%2F%2Fwww.', ":website", '%2Fhome">site</a>')).otherwise("")
    card = text(
        '<div class="card product-card"><a class="product-card__img" href="/products/', ":slug", '/reviews"><img alt="x"></a><div itemprop="name"> ',
        ":name", " </div><p>", rating, " ", reviews, "</p>", link, "</div>",
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", card.alias("card")))), lambda c: c["card"]), "")
    nav = F.when(F.col("page_count") > 1, text('<div class="pagination"><a href="?page=2">2</a><a href="?page=', ":page_count", '">Last</a></div>')).otherwise("")
    return (
        p.groupBy("category", "page", "page_count").agg(joined.alias("cards"))
        .select("category", "page", text("<html><body><nav>x</nav>", ":cards", nav, "</body></html>").alias("html"))
    )


@query(
    "listing_products",
    "SELECT category, page, pos, name, slug, 'https://www.g2.com/products/' || slug AS g2_url, website, rating, review_count FROM listed",
    ("listed",),
)
def listing_products(spark, d):
    return listing.listing_products(listing_pages(spark, d))


@query(
    "listing_page_count",
    "SELECT category, page, any_value(page_count)::INTEGER AS page_count, count(*)::INTEGER AS n_cards FROM listed GROUP BY category, page",
    ("listed",),
)
def listing_page_count(spark, d):
    return listing.listing_page_count(listing_pages(spark, d))


view(
    "hits",
    """SELECT 'cat-' || (p_partkey // 600) AS category, (p_partkey % 600) // 60 AS query_idx, (p_partkey % 60) // 20 + 1 AS page, p_partkey % 20 AS pos, p_partkey AS k,
       replace(p_name, ' ', '-') || (p_partkey % 7) AS slug, p_name,
       CASE p_partkey % 6 WHEN 0 THEN '/alternatives' WHEN 1 THEN '/reviews?x=1' WHEN 2 THEN '' ELSE '/Compare/a' END AS ending, p_partkey % 10 AS kind FROM part""",
)


def hits(spark, d):
    k = F.col("p_partkey")
    slug = text(F.replace("p_name", F.lit(" "), F.lit("-")), k % 7)
    ending = case(k % 6, {0: "/alternatives", 1: "/reviews?x=1", 2: ""}, "/Compare/a")
    title = case(
        k % 10,
        {0: text(":p_name", " Reviews 2026"), 1: text(":p_name", " - G2"), 2: text("Top 10 ", ":p_name", " Alternatives & Competitors"),
         3: text(" Reviews of ", ":p_name", " Pricing and Features"), 4: "x"},
        text(":p_name", " 2025 "),
    )
    link = F.when(k % 9 == 8, "https://example.com/products/x").otherwise(text("https://www.g2.com/products/", slug, ending))
    return table(spark, d, "part").select(
        text("cat-", div("p_partkey", 600)).alias("category"), F.floor((k % 600) / 60).alias("query_idx"),
        (F.floor((k % 60) / 20) + 1).alias("page"), (k % 20).alias("pos"), title.alias("title"), link.alias("link"),
    )


NAME_SQL = """CASE kind WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN 'Top 10 ' || p_name
    WHEN 3 THEN 'Reviews of ' || p_name WHEN 4 THEN 'x' ELSE p_name END"""
view(
    "products_found",
    f"""SELECT category, query_idx, page, pos, slug, {NAME_SQL} AS name, 'https://www.g2.com/products/' || slug AS g2_url,
        NULL::VARCHAR AS website, NULL::DOUBLE AS rating, NULL::BIGINT AS review_count
        FROM (SELECT *, row_number() OVER (PARTITION BY category, query_idx, page, slug ORDER BY pos) AS n FROM hits WHERE k % 9 <> 8)
        WHERE n = 1 AND k % 6 IN (1, 2) AND kind <> 4""",
    ("hits",),
)
PAGE_KEYS = ["category", "query_idx", "page"]


@query("products_from_search", "SELECT * FROM products_found", ("products_found",))
def products_from_search(spark, d):
    return discover.products_from_search(hits(spark, d), PAGE_KEYS)


@query(
    "clean_product_name",
    f"SELECT category, query_idx, page, pos, {NAME_SQL} AS name FROM hits",
    ("hits",),
)
def clean_product_name(spark, d):
    return discover.clean_product_name(hits(spark, d)).select(*PAGE_KEYS, "pos", "name")


# pages are walked one by one; a category ends at a gap, a page without news, its last page or the cap
view(
    "fresh",
    "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY category, slug ORDER BY page, pos) AS n FROM listed) WHERE n = 1",
    ("listed",),
)
view(
    "walked",
    """SELECT l.category, l.page, l.page_count, coalesce(f.n_new, 0) AS n_new
       FROM (SELECT category, page, any_value(page_count) AS page_count FROM listed GROUP BY category, page) l
       LEFT JOIN (SELECT category, page, count(*) AS n_new FROM fresh GROUP BY category, page) f ON f.category = l.category AND f.page = l.page""",
    ("listed", "fresh"),
)
view(
    "visited",
    """SELECT category, page, page_count, n_new, n_new AS total FROM walked WHERE page = 1
       UNION ALL SELECT w.category, w.page, w.page_count, w.n_new, v.total + w.n_new FROM visited v
       JOIN walked w ON w.category = v.category AND w.page = v.page + 1
       WHERE v.n_new > 0 AND NOT (v.page_count > 1 AND v.page >= v.page_count)""",
    ("walked",),
)
view(
    "merged_listing",
    """SELECT category, page, pos, slug, name, website, rating, review_count, page_count FROM (
       SELECT f.*, row_number() OVER (PARTITION BY f.category ORDER BY f.page, f.pos) AS r
       FROM fresh f JOIN visited v ON v.category = f.category AND v.page = f.page)""",
    ("fresh", "visited"),
)


def merged_listing(spark, d):
    p = listed(spark, d)
    fetched = p.groupBy("category", "page").agg(F.max("page_count").alias("page_count"))
    return discover.listing_merge_pages(p, fetched)


@query(
    "listing_merge_first_100",
    """SELECT category, page, pos, slug, name, website, rating, review_count, page_count FROM (
       SELECT *, row_number() OVER (PARTITION BY category ORDER BY page, pos) AS r FROM merged_listing) WHERE r <= 100""",
    ("merged_listing",),
)
def listing_merge_first_100(spark, d):
    p = listed(spark, d)
    fetched = p.groupBy("category", "page").agg(F.max("page_count").alias("page_count"))
    return discover.listing_merge_pages(p, fetched, max_products=100)


@query("listing_merge_pages", "SELECT * FROM merged_listing", ("merged_listing",))
def listing_merge_pages(spark, d):
    return merged_listing(spark, d)


def _sql_text(phrase: str) -> str:
    """A phrasing as an SQL expression, with the column ``name`` in its place."""
    return "'" + phrase.replace("'", "''").replace("{name}", "' || name || '") + "'"


QUERY_TEXTS = [_sql_text(q) for q in fixed.CATEGORY_QUERIES]


@query(
    "category_query_plan",
    "SELECT slug, (i - 1)::INTEGER AS query_idx, queries[i] AS query, p::INTEGER AS page FROM (SELECT slug, ["
    + ", ".join(QUERY_TEXTS)
    + """] AS queries FROM (SELECT p_name_slug AS slug, CASE WHEN k % 2 = 0 THEN 'Name ' || k ELSE 'Crm2 B2B ' || k END AS name
       FROM (SELECT 'crm2-b2b-' || p_partkey AS p_name_slug, p_partkey AS k FROM part))), range(1, 13) AS q(i), range(1, 4) AS r(p)""",
)
def category_query_plan(spark, d):
    k = F.col("p_partkey")
    return discover.category_query_plan(
        table(spark, d, "part").select(text("crm2-b2b-", k).alias("slug"), F.when(k % 2 == 0, text("Name ", k)).alias("name")),
        pages=3,
    )


@query(
    "category_query_summary",
    """SELECT category, query_idx, raw_results, coalesce(unique_slugs, 0) AS unique_slugs, coalesce(category_slugs, 0) AS category_slugs
       FROM (SELECT category, query_idx, count(*) AS raw_results FROM hits GROUP BY ALL)
       LEFT JOIN (SELECT category, query_idx, count(DISTINCT slug) AS unique_slugs FROM products_found GROUP BY ALL) USING (category, query_idx)
       LEFT JOIN (SELECT category, count(DISTINCT slug) AS category_slugs FROM products_found GROUP BY ALL) USING (category)""",
    ("hits", "products_found"),
)
def category_query_summary(spark, d):
    return discover.category_query_summary(hits(spark, d))


view(
    "merged_products",
    """SELECT slug, g2_category, cat_idx, pos, is_fallback, name FROM (
       SELECT *, row_number() OVER (PARTITION BY slug ORDER BY is_fallback, cat_idx, pos) AS n FROM (
         SELECT slug, category AS g2_category, replace(category, 'cat-', '')::BIGINT AS cat_idx, page * 1000 + pos AS pos, 0 AS is_fallback, name FROM merged_listing
         UNION ALL
         SELECT slug, category, replace(category, 'cat-', '')::BIGINT, query_idx * 100000 + page * 1000 + pos, 1, name FROM products_found
         WHERE category NOT IN (SELECT category FROM merged_listing) AND category IN (SELECT category FROM listed))) WHERE n = 1""",
    ("merged_listing", "products_found", "listed"),
)


def merged_products(spark, d):
    scraped = merged_listing(spark, d).select("category", (F.col("page") * 1000 + F.col("pos")).alias("pos"), "slug", "name")
    late = discover.products_from_search(hits(spark, d), PAGE_KEYS).select(
        "category", (F.col("query_idx") * 100000 + F.col("page") * 1000 + F.col("pos")).alias("pos"), "slug", "name"
    )
    cats = listed(spark, d).select("category").distinct().withColumn("cat_idx", F.split_part("category", F.lit("-"), F.lit(2)).cast("long"))
    return discover.category_merge(scraped, late, cats)


@query("category_merge", "SELECT * FROM merged_products", ("merged_products",))
def category_merge(spark, d):
    return merged_products(spark, d)


@query("category_total_cap", "SELECT * FROM merged_products ORDER BY is_fallback, cat_idx, pos LIMIT 500", ("merged_products",))
def category_total_cap(spark, d):
    return discover.category_total_cap(merged_products(spark, d), 500)


# --- funding news ----------------------------------------------------------------------------

NEWS_SQL = [_sql_text(q) for q in fixed.NEWS_QUERIES]


@query(
    "news_query_plan",
    "SELECT p_partkey AS job, hours, CASE WHEN hours <= 24 THEN 'qdr:d' WHEN hours <= 48 THEN 'qdr:2d' ELSE 'qdr:w' END AS recency, (i - 1)::INTEGER AS query_idx, ["
    + ", ".join(NEWS_SQL)
    + """][i] AS query, p::INTEGER AS page, NULL AS error FROM (SELECT p_partkey, (p_partkey % 200)::INTEGER AS hours FROM part), range(1, 9) AS q(i), range(1, 4) AS r(p)
    WHERE hours BETWEEN 1 AND 168
    UNION ALL SELECT p_partkey, (p_partkey % 200)::INTEGER, NULL, NULL, NULL, NULL, 'hours must be between 1 and 168' FROM part WHERE p_partkey % 200 NOT BETWEEN 1 AND 168""",
)
def news_query_plan(spark, d):
    jobs = table(spark, d, "part").select(F.col("p_partkey").alias("job"), (F.col("p_partkey") % 200).cast("int").alias("hours"))
    return discover.news_query_plan(jobs, pages=3)


view(
    "articles",
    """SELECT o_orderkey % 8 AS query_idx, (o_orderkey // 8) % 3 + 1 AS page, o_orderkey AS pos,
       CASE WHEN o_orderkey % 10 = 0 THEN '' WHEN o_orderkey % 10 = 1 THEN NULL ELSE 'https://news.example.com/' || (o_orderkey // 4) END AS link,
       'Firm ' || o_custkey || ' raises' AS title, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS snippet, o_orderstatus AS source, '' AS date FROM orders""",
)


def articles(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        (k % 8).alias("query_idx"), (div("o_orderkey", 8) % 3 + 1).alias("page"), k.alias("pos"),
        F.when(k % 10 == 0, "").when(k % 10 != 1, text("https://news.example.com/", div("o_orderkey", 4))).alias("link"),
        text("Firm ", ":o_custkey", " raises").alias("title"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("snippet"),
        F.col("o_orderstatus").alias("source"), F.lit(None).cast("string").alias("date"),
    )


view(
    "unique_articles",
    """SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY query_idx, page, pos) AS n FROM articles WHERE link <> '') WHERE n = 1""",
    ("articles",),
)


@query("news_dedupe", "SELECT * FROM unique_articles", ("unique_articles",))
def news_dedupe(spark, d):
    return discover.news_dedupe(articles(spark, d))


@query("news_failures", "SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS failed_queries FROM orders")
def news_failures(spark, d):
    return discover.news_failures(table(spark, d, "orders").select((F.col("o_orderstatus") == "P").alias("failed")))


view(
    "numbered_articles",
    "SELECT *, row_number() OVER (ORDER BY pos) - 1 AS item_index FROM unique_articles",
    ("unique_articles",),
)


@query(
    "news_batches",
    """SELECT item_index // 15 AS batch_id, count(*) AS n_items,
       string_agg('- item_index=' || item_index || ' | headline="' || title || '" | snippet="' || snippet || '"', chr(10) ORDER BY item_index) AS items
       FROM numbered_articles GROUP BY item_index // 15""",
    ("numbered_articles",),
)
def news_batches(spark, d):
    return discover.news_batches(written(discover.news_dedupe(articles(spark, d)), "articles"), "pos")


# one answer per order: unreadable, no list, or one to two entries about an article
view(
    "told",
    """SELECT o_orderkey AS batch_id, i AS pos, o_orderkey, CASE WHEN o_orderkey % 7 = 6 AND i = 1 THEN -1 ELSE o_orderkey // 5 + i END AS item_index,
       NOT (o_orderkey % 5 = 2 AND i = 0) AS is_funding_round,
       CASE WHEN o_orderkey % 11 = 3 THEN '' WHEN o_orderkey % 2 = 0 THEN 'FIRM ' || o_custkey // 3 || ' ' ELSE 'Firm ' || o_custkey // 3 END AS company_name,
       CASE WHEN o_orderkey % 3 = 0 THEN '$' || o_orderkey || 'M' END AS funding_amount,
       CASE o_orderkey % 6 WHEN 0 THEN 'Seed' WHEN 1 THEN 'Series A' WHEN 2 THEN 'Series C' WHEN 3 THEN 'Growth' WHEN 4 THEN '' ELSE 'Series E+' END AS funding_round,
       CASE WHEN o_orderkey % 4 = 1 THEN 'Investor ' || o_orderkey END AS lead_investor,
       CASE WHEN i = 1 THEN 'about ' || o_orderkey END AS description_snippet
       FROM orders, (VALUES (0), (1)) AS t(i) WHERE o_orderkey % 13 NOT IN (5, 6) AND i <= o_orderkey % 2""",
)


def funding_answers(spark, d):
    k = F.col("o_orderkey")
    firm = div("o_custkey", 3)

    def entry(i):
        return F.struct(
            F.when((k % 7 == 6) & F.lit(i == 1), -1).otherwise(div("o_orderkey", 5) + i).alias("item_index"),
            (~((k % 5 == 2) & F.lit(i == 0))).alias("is_funding_round"),
            F.when(k % 11 == 3, "").when(k % 2 == 0, text("FIRM ", firm, " ")).otherwise(text("Firm ", firm)).alias("company_name"),
            F.when(k % 3 == 0, text("$", k, "M")).alias("funding_amount"),
            case(k % 6, {0: "Seed", 1: "Series A", 2: "Series C", 3: "Growth", 4: ""}, "Series E+").alias("funding_round"),
            F.when(k % 4 == 1, text("Investor ", k)).alias("lead_investor"),
            F.when(F.lit(i == 1), text("about ", k)).alias("description_snippet"),
        )

    body = F.when(k % 2 == 0, F.to_json(F.array(entry(0)))).otherwise(F.to_json(F.array(entry(0), entry(1))))
    return table(spark, d, "orders").select(
        k.alias("batch_id"), F.when(k % 13 == 5, "[{oops").when(k % 13 == 6, '{"a": 1}').otherwise(body).alias("body")
    )


@query(
    "parse_funding_responses",
    """SELECT batch_id, pos, item_index::VARCHAR AS item_index, is_funding_round::VARCHAR AS is_funding_round, company_name, funding_amount, funding_round,
       lead_investor, description_snippet FROM told""",
    ("told",),
)
def parse_funding_responses(spark, d):
    return discover.parse_funding_responses(funding_answers(spark, d))


@query("dropped_batches", "SELECT count(*) AS batches, count(*) FILTER (WHERE o_orderkey % 13 IN (5, 6)) AS dropped FROM orders")
def dropped_batches(spark, d):
    return discover.dropped_batches(funding_answers(spark, d))


view(
    "funded",
    """SELECT batch_id, t.pos, company_name, funding_amount, funding_round, lead_investor, description_snippet, link AS source_url, source AS source_name
       FROM told t JOIN numbered_articles a ON a.item_index = t.item_index WHERE is_funding_round""",
    ("told", "numbered_articles"),
)


def funded(spark, d):
    stored = written(discover.news_dedupe(articles(spark, d)), "articles")
    numbered = discover.dense_index(stored, "pos", "item_index")
    return discover.funding_rounds(discover.parse_funding_responses(funding_answers(spark, d)), numbered)


@query("funding_rounds", "SELECT * FROM funded", ("funded",))
def funding_rounds(spark, d):
    return funded(spark, d).select("ordinal.*", "*").drop("ordinal")


FIELDS = ["company_name", "funding_amount", "funding_round", "lead_investor", "description_snippet", "source_url", "source_name"]
SCORE = " + ".join(f"(coalesce({f}, '') <> '')::INT" for f in FIELDS)
view(
    "funded_unique",
    f"""SELECT {', '.join(FIELDS)} FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(company_name)), lower(trim(funding_round)) ORDER BY {SCORE} DESC, batch_id, pos) AS n
        FROM funded WHERE trim(company_name) <> '') WHERE n = 1""",
    ("funded",),
)


@query("funding_dedupe", "SELECT * FROM funded_unique", ("funded_unique",))
def funding_dedupe(spark, d):
    return discover.funding_dedupe(funded(spark, d)).drop("first_seen")


@query(
    "round_filter",
    """SELECT 'C+' AS picked, * FROM funded_unique WHERE lower(trim(funding_round)) LIKE 'series%' AND lower(trim(funding_round)) NOT IN ('series a', 'series b')
       UNION ALL SELECT 'Unknown', * FROM funded_unique WHERE trim(funding_round) = '' UNION ALL SELECT 'Seed', * FROM funded_unique WHERE funding_round = 'Seed'""",
    ("funded_unique",),
)
def round_filter(spark, d):
    companies = discover.funding_dedupe(funded(spark, d)).drop("first_seen")
    pick = lambda label, name: discover.round_filter(companies, name).withColumn("picked", F.lit(label))
    return pick("C+", "Series C+").unionByName(pick("Unknown", "Unknown")).unionByName(pick("Seed", "Seed"))


PICKS = "SELECT o_orderkey AS id, 'Firm ' || (o_custkey // 3) AS company_name, CASE WHEN o_orderkey % 4 <> 0 THEN 'https://n.example.com/' || (o_orderkey % 900) END AS source_url FROM orders"
view("picks", PICKS)


def picks(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("id"), text("Firm ", div("o_custkey", 3)).alias("company_name"),
        F.when(k % 4 != 0, text("https://n.example.com/", k % 900)).alias("source_url"),
    )


@query(
    "select_companies",
    """SELECT * FROM picks WHERE id % 3 = 0 UNION ALL SELECT * FROM picks p WHERE id % 3 = 1 AND NOT EXISTS (
       SELECT 1 FROM picks s WHERE s.id % 3 = 0 AND s.company_name = p.company_name AND coalesce(s.source_url, '') = coalesce(p.source_url, ''))""",
    ("picks",),
)
def select_companies(spark, d):
    p = picks(spark, d)
    return discover.select_companies(p.filter(mod("id", 3) == 0), p.filter(mod("id", 3) == 1))
