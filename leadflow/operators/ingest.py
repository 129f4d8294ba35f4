"""Input shaping: column mapping, pasted people, line types, search plans, seed rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.functions import fixed
from leadflow.functions.tables import Key, key_columns
from leadflow.functions.text import bare_host, blank_to_null, filled, first_filled, or_blank, strip
from leadflow.operators.domains import with_registered_domain

# Header patterns, most specific first.
COMPANY_HEADERS = [
    r"company.?name", r"company", r"org(anization)?", r"business.?name", r"business", r"brand", r"^name$",
]
LOCATION_HEADERS = [
    r"location", r"city.?state", r"address", r"city", r"state", r"region", r"geo", r"hq", r"headquarters",
]
FULL_NAME_HEADER = r"^(full.?name|name|person|contact)$"
FIRST_NAME_HEADER = r"^(first.?name|fname|given.?name|first)$"
LAST_NAME_HEADER = r"^(last.?name|lname|surname|family.?name|last)$"
EMPLOYER_HEADER = r"^(company|org|employer|business|firm|organization|company.?name)$"
WEBSITE_HEADER = r"^(website|url|domain|site|company.?url|company.?website)$"
URL_HEADER = r"url|website|domain|link"
NAME_HEADER = r"company|name|org|business"
TERM_HEADER = r"search.?term|query|keyword|category"
PLACE_HEADER = r"location|city|state|area|region"


def _first_header(headers: Sequence[str], patterns: Sequence[str], skip: str = "") -> str:
    for pattern in patterns:
        for h in headers:
            if h != skip and re.search(pattern, h, re.IGNORECASE):
                return h
    return ""


def company_columns(headers: Sequence[str]) -> tuple[str, str]:
    """(company, location) header names, '' when nothing fits."""
    company = _first_header(headers, COMPANY_HEADERS)
    return company, _first_header(headers, LOCATION_HEADERS, skip=company)


def auto_map_company_columns(df: DataFrame) -> DataFrame:
    """Select the company and location columns by their headers."""
    company, location = company_columns(df.columns)
    pick = lambda h: F.col(f"`{h}`") if h else F.lit(None).cast("string")
    others = [f"`{c}`" for c in df.columns if c == "row_index"]
    return df.select(*others, pick(company).alias("company_name"), pick(location).alias("location"))


def people_columns(headers: Sequence[str]) -> dict[str, str]:
    """Header names for a people file; a full-name column beats first plus last."""
    full = _first_header(headers, [FULL_NAME_HEADER])
    first, last = _first_header(headers, [FIRST_NAME_HEADER]), _first_header(headers, [LAST_NAME_HEADER])
    if full or not (first and last):
        first = last = ""
    return {
        "full_name": full,
        "first_name": first,
        "last_name": last,
        "company": _first_header(headers, [EMPLOYER_HEADER]),
        "website": _first_header(headers, [WEBSITE_HEADER]),
    }


def auto_map_people_columns(df: DataFrame) -> DataFrame:
    """People rows of a file whose columns are recognised by their headers."""
    m = people_columns(df.columns)
    return people_rows(df, **{f"{k}_col": v for k, v in m.items()})


def people_rows(
    df: DataFrame,
    full_name_col: str = "",
    first_name_col: str = "",
    last_name_col: str = "",
    company_col: str = "company_name",
    website_col: str = "",
) -> DataFrame:
    """(full_name, company_name, website, input_type) for rows with a name and a company."""
    def cell(name: str) -> Column:
        return strip(or_blank(f"`{name}`")) if name else F.lit("")

    name = cell(full_name_col) if full_name_col else strip(
        F.concat(cell(first_name_col), F.lit(" "), cell(last_name_col))
    )
    keep = [c for c in ("row_index",) if c in df.columns]
    website = cell(website_col)
    return df.select(
        *keep,
        name.alias("full_name"),
        cell(company_col).alias("company_name"),
        website.alias("website"),
        F.when(website != "", "url").otherwise("name").alias("input_type"),
    ).filter((F.col("full_name") != "") & (F.col("company_name") != ""))


def people_lines(df: DataFrame, line_col: str = "line", order_col: str = "row_index") -> DataFrame:
    """Split pasted ``name, company`` lines; ``ok`` is false for lines that cannot be split.

    The separator is the commonest of ', ', ' | ' and ' - ' among the first five non-empty lines.
    """
    lines = df.withColumn("_line", strip(or_blank(line_col))).filter(F.col("_line") != "")
    # the raw line counts here, not the trimmed one
    sample = lines.orderBy(order_col).limit(5).agg(
        *[
            F.coalesce(F.sum(F.col(line_col).contains(sep).cast("int")), F.lit(0)).alias(name)
            for sep, name in ((", ", "comma"), (" | ", "pipe"), (" - ", "dash"))
        ]
    )
    sep = sample.select(
        F.when((F.col("comma") >= F.col("pipe")) & (F.col("comma") >= F.col("dash")), ", ")
        .when(F.col("pipe") >= F.col("dash"), " | ")
        .otherwise(" - ")
        .alias("sep")
    ).scalar()
    at_comma = F.instr("_line", ",")
    at_sep = F.locate(" | ", "_line")
    at_dash = F.locate(" - ", "_line")
    spot = F.when(F.col("_sep") == " | ", at_sep).when(F.col("_sep") == " - ", at_dash).otherwise(F.lit(0))
    by_sep = spot > 0
    cut = F.when(by_sep, spot).otherwise(at_comma)
    skip = F.when(by_sep, F.lit(3)).otherwise(F.lit(1))
    name = strip(F.col("_line").substr(F.lit(1), cut - 1))
    company = strip(F.col("_line").substr(cut + skip, F.length("_line")))
    return (
        lines.withColumn("_sep", sep)
        .withColumn("full_name", F.when(cut > 0, name).otherwise(""))
        .withColumn("company_name", F.when(cut > 0, company).otherwise(""))
        .withColumn("ok", (F.col("full_name") != "") & (F.col("company_name") != ""))
        .drop("_line", "_sep")
    )


def people_line_errors(parsed: DataFrame) -> DataFrame:
    """Number of parsed and unparsable lines."""
    return parsed.agg(
        F.count_if("ok").alias("items"), F.count_if(~F.col("ok")).alias("errors")
    )


def classify_inputs(df: DataFrame, line_col: str = "line") -> DataFrame:
    """Add the trimmed ``input`` and its ``input_type``.

    'url' for http(s) lines and lines with a registered domain, else 'name'.
    """
    df = df.withColumn("input", strip(or_blank(line_col)))
    rest = F.regexp_replace(F.lower("input"), r"^(?:[a-z][a-z0-9+.\-]*:)?//", "")
    df = with_registered_domain(df, F.regexp_extract(rest, r"^[^/?#]*", 0), "_domain")
    url = F.lower("input").rlike("^https?://") | F.col("_domain").isNotNull()
    return df.withColumn("input_type", F.when(url, "url").otherwise("name")).drop("_domain")


def loose_line_type(line: str | Column) -> Column:
    """The quick rule of the input form: only the text after the first dot is tested."""
    text = F.lower(strip(or_blank(line)))
    after = F.regexp_extract(text, r"^[^.]+\.([^/?#]*)", 1)
    http = text.startswith("http://") | text.startswith("https://")
    return F.when(http | after.rlike(r"^[a-z]{2,10}$"), "url").otherwise("name")


def line_stats(df: DataFrame, line_col: str = "line") -> DataFrame:
    """total, urls and names of the non-blank lines."""
    lines = df.filter(strip(or_blank(line_col)) != "").select(loose_line_type(line_col).alias("t"))
    return lines.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("t") == "url").alias("urls"),
        F.count_if(F.col("t") == "name").alias("names"),
    )


class PlanError(ValueError):
    """A search plan breaks one of the limits."""


@dataclass(frozen=True)
class SearchLimits:
    """What a search plan may ask for; None lifts a limit."""

    searches: int | None = None
    per_search: int | None = None
    results: int | None = None


def search_plan_errors(
    plan: DataFrame, max_per_search: int | str | None = None, limits: SearchLimits = SearchLimits(), jobs: Sequence[str] = ()
) -> DataFrame:
    """(jobs, n_searches, error) of every job of a plan: why it is refused, null if it is not.

    ``max_per_search`` is a number, or a column of the plan with one value a job. The first rule that a job breaks counts:
    too many searches, a number per search outside 1 to its limit, too many results expected.
    """
    per_search = F.lit(max_per_search).cast("long") if max_per_search is None or isinstance(max_per_search, int) else F.col(max_per_search).cast("long")
    counted = plan.groupBy(*jobs).agg(F.count(F.lit(1)).alias("n_searches"), F.min(per_search).alias("_per"), F.max(per_search).alias("_most"))
    rules = []
    if limits.searches is not None:
        rules.append((F.col("n_searches") > limits.searches, f"at most {limits.searches} search term and location combinations"))
    if limits.per_search is not None:
        rules.append(((F.col("_per") < 1) | (F.col("_most") > limits.per_search), f"max_per_search must be between 1 and {limits.per_search}"))
    if limits.results is not None:
        rules.append((F.col("n_searches") * F.col("_most") > limits.results, f"more than {limits.results} results expected"))
    error = F.lit(None).cast("string")
    for broken, message in reversed(rules):
        error = F.when(broken, message).otherwise(error)
    return counted.select(*jobs, "n_searches", error.alias("error"))


def maps_search_plan(
    terms: DataFrame | None = None, location: str = "", pairs: DataFrame | None = None, term_col: str = "term", place_col: str = "location",
    max_per_search: int | None = None, limits: SearchLimits = SearchLimits(),
) -> DataFrame:
    """Searches (other columns, search_term, location): the given pairs, else every term at one location.

    Texts are trimmed; terms that are blank make no search. A plan beyond ``limits`` is refused when it runs: its rows
    carry a guard that the whole plan's count decides, so nothing is counted on the driver before.
    """
    if pairs is not None:
        plan = pairs.select(
            *[c for c in pairs.columns if c not in (term_col, place_col)], strip(or_blank(term_col)).alias("search_term"),
            strip(or_blank(place_col)).alias("location"),
        )
    elif terms is not None and location.strip():
        plan = terms.select(
            *[c for c in terms.columns if c != term_col], strip(or_blank(term_col)).alias("search_term"), F.lit(location.strip()).alias("location")
        ).filter(F.col("search_term") != "")
    else:
        raise PlanError("provide search terms with a location, or pairs")
    if limits == SearchLimits():
        return plan
    error = search_plan_errors(plan, max_per_search, limits).select("error").scalar()
    refused = F.when(error.isNotNull(), F.raise_error(error)).cast("boolean")
    return plan.filter(F.coalesce(refused, F.lit(True)))


def maps_pairs_from_csv(df: DataFrame) -> DataFrame:
    """Search terms of an uploaded file with their location.

    One distinct location serves every term; with several, only rows that have one make a search.
    """
    term = _first_header(df.columns, [TERM_HEADER])
    place = _first_header(df.columns, [PLACE_HEADER])
    if not term:
        raise PlanError("no search term column")
    keep = [c for c in ("row_index",) if c in df.columns]
    rows = df.select(
        *keep,
        strip(or_blank(f"`{term}`")).alias("search_term"),
        (strip(or_blank(f"`{place}`")) if place else F.lit("")).alias("location"),
    ).filter(F.col("search_term") != "")
    seen = rows.filter(F.col("location") != "").agg(
        F.min("location").alias("lo"), F.max("location").alias("hi")
    )
    fill = seen.select(
        F.when(F.col("lo").isNull(), "").when(F.col("lo") == F.col("hi"), F.col("lo")).alias("fill")
    ).scalar()
    # no location at all or one distinct location: every term; several: rows without one drop out
    return (
        rows.withColumn("_fill", fill)
        .withColumn("location", F.coalesce("_fill", "location"))
        .filter(F.col("_fill").isNotNull() | (F.col("location") != ""))
        .drop("_fill")
    )


def category_rows(categories: DataFrame, search: str = "", parent: str = "") -> DataFrame:
    """Registry rows of a parent, else those that hold the search text; a blank search returns all."""
    if parent:
        return categories.filter(F.col("parent") == parent)
    text = search.strip().lower()
    if not text:
        return categories
    return categories.filter(_category_match(text))


def _category_match(text: str) -> Column:
    return (
        F.lower("name").contains(text) | F.col("slug").contains(text) | F.lower("parent").contains(text)
    )


def category_parents(categories: DataFrame) -> DataFrame:
    return categories.select("parent").distinct().orderBy("parent")


def categories_grouped(categories: DataFrame, search: str = "", parent: str = "") -> DataFrame:
    """Categories by parent with the size of their group; parent and search must both hold here."""
    kept = categories
    if parent:
        kept = kept.filter(F.col("parent") == parent)
    if search.strip():
        kept = kept.filter(_category_match(search.strip().lower()))
    sizes = kept.groupBy("parent").agg(F.count(F.lit(1)).alias("n_categories"))
    return kept.join(sizes, "parent").orderBy("parent", "ordinal")


def validate_categories(picked: DataFrame, categories: DataFrame) -> DataFrame:
    """Picked slugs that the registry does not know; must be empty."""
    return picked.join(categories.select("slug"), "slug", "left_anti")


def check_categories(picked: DataFrame, categories: DataFrame, limit: int | None = None) -> None:
    """Raise for an unknown slug, none at all or more than ``limit``."""
    unknown = validate_categories(picked, categories).limit(1).collect()
    if unknown:
        raise PlanError(f"unknown category: {unknown[0]['slug']}")
    if picked.isEmpty() or (limit is not None and picked.limit(limit + 1).count() > limit):
        raise PlanError("pick at least one category" if limit is None else f"pick between 1 and {limit} categories")


def intel_column(headers: Sequence[str]) -> str:
    return _first_header(headers, [URL_HEADER]) or _first_header(headers, [NAME_HEADER]) or headers[0]


def intel_lines(df: DataFrame, column: str | None = None) -> DataFrame:
    """Non-blank trimmed values of the URL or company column as input lines; duplicates stay."""
    name = column or intel_column([c for c in df.columns if c != "row_index"])
    keep = [c for c in ("row_index",) if c in df.columns]
    return df.select(*keep, strip(or_blank(f"`{name}`")).alias("line")).filter(F.col("line") != "")


def seed_category_rows(products: DataFrame, key: Key = "row_index") -> DataFrame:
    """Listing products as rows: website when known, else the product name."""
    site = filled("website")
    return products.select(
        *key_columns(key),
        first_filled("website", "name").alias("input"),
        F.when(site, "url").otherwise("name").alias("input_type"),
        F.col("name").alias("company_name"),
        or_blank("g2_url").alias("g2_url"),
        or_blank("g2_category").alias("g2_category"),
        F.col("rating").alias("g2_rating"),
        F.col("review_count").alias("g2_review_count"),
        F.lit("pending").alias("status"),
    )


def seed_place_rows(places: DataFrame, key: Key = "row_index") -> DataFrame:
    """Map places as rows, with the bare host of the website and the map link of the cid."""
    site = filled("website")
    cid = or_blank("cid")
    return places.select(
        *key_columns(key),
        first_filled("website", "title").alias("input"),
        F.when(site, "url").otherwise("name").alias("input_type"),
        or_blank("search_term").alias("search_term"),
        or_blank("location").alias("location"),
        or_blank("title").alias("business_name"),
        or_blank("category").alias("category"),
        or_blank("address").alias("maps_address"),
        or_blank("phoneNumber").alias("maps_phone"),
        "rating",
        F.col("ratingCount").alias("review_count"),
        "latitude",
        "longitude",
        cid.alias("google_cid"),
        F.when(cid != "", F.concat(F.lit("https://www.google.com/maps/place/?cid="), cid))
        .otherwise("")
        .alias("google_maps_url"),
        blank_to_null(bare_host("website")).alias("raw_domain"),
        F.lit("pending").alias("status"),
    )


def seed_funding_rows(companies: DataFrame, key: Key = "row_index") -> DataFrame:
    """Funded companies as rows, always looked up by name."""
    return companies.select(
        *key_columns(key),
        or_blank("company_name").alias("input"),
        F.lit("name").alias("input_type"),
        or_blank("company_name").alias("company_name"),
        "funding_amount",
        or_blank("funding_round").alias("funding_round"),
        "lead_investor",
        F.col("description_snippet").alias("funding_description"),
        or_blank("source_url").alias("source_url"),
        or_blank("source_name").alias("source_name"),
        F.lit("pending").alias("status"),
    )


def seed_people_rows(people: DataFrame, profiles: DataFrame, key: Key = "row_index") -> DataFrame:
    """People with their profile; the look-up input is the website, else the company name."""
    p = profiles.select(*key_columns(key), "linkedin_url", "confidence")
    site = filled("website")
    return people.drop("input_type").join(p, key_columns(key), "left").select(
        *key_columns(key),
        "full_name",
        "company_name",
        or_blank("website").alias("website"),
        or_blank("linkedin_url").alias("linkedin_url"),
        F.coalesce("confidence", F.lit(0.0)).alias("linkedin_confidence"),
        first_filled("website", "company_name").alias("input"),
        F.when(site, "url").otherwise("name").alias("input_type"),
        F.lit("pending").alias("status"),
    )
