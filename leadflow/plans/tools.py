"""Website finder, company intel and the four discovery tools in front of it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions.tables import Key, job_columns, key_columns, spread
from leadflow.functions.text import blank_to_null, filled
from leadflow.operators import contacts, discover, domains, extract, ingest, pages, verify
from leadflow.plans.stages import Answers, Providers, Stage, answers, written


def _with_enrichment(rows: DataFrame, p: Providers, titles: Sequence[str], max_contacts: int | None, match_names: bool) -> DataFrame:
    if p.directory is None or not titles:
        return rows.withColumn("contacts", F.lit(None).cast(f"array<{contacts.schemas.CONTACT}>"))
    listed = answers(p.directory, lambda: _domains(rows, F.coalesce(blank_to_null("normalized_domain"), F.lit(""))))
    found = contacts.domain_contacts(listed, titles, max_contacts)
    outcomes = found.withColumn("error", F.lit(None).cast("string"))
    return contacts.apply_contacts(contacts.domain_fan_out(rows, outcomes), match_names).drop("enrich_error")


def _domains(rows: DataFrame, domain: Column) -> DataFrame:
    return rows.select(domain.alias("domain")).filter(filled("domain")).distinct()


def search_rows(rows: DataFrame, search: Answers) -> DataFrame:
    """Candidate domain per row from the search answers; status ``searched``."""
    given = answers(search, lambda: discover.search_requests(rows))
    found = discover.fan_out_search(rows, discover.parse_search_responses(given))
    return found.withColumn("raw_domain", blank_to_null("candidate_domain")).withColumn(
        "status", F.lit("searched")
    ).drop("candidate_domain")


def website_phases(p: Providers, key: Key = "row_index") -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """Search, verify and normalise as steps from rows to rows: for whole tables, or for batches of a stream.

    A batch must hold the rows of a block of 200 row numbers together, since verdicts are numbered inside blocks.
    """
    cols = key_columns(key)
    batch = [c for c in cols if c != "row_index"] + ["batch_id"]

    def verified(searched: DataFrame) -> DataFrame:
        items = verify.number_batches(verify.verify_items(searched, key), key=key).select("batch_id", *cols)
        about = p.verdicts.join(items.select(*batch).distinct(), batch, "left_semi")
        verdicts = verify.parse_verdicts(items, about, key=key)
        return verify.apply_verdicts(searched, verdicts, key).withColumn("normalized_domain", F.lit(None).cast("string"))

    def normalized(rows: DataFrame) -> DataFrame:
        outcomes = domains.normalize_with_redirects(rows.filter(filled("verified_domain")), p.redirects, key=key)
        return domains.apply_normalized(rows, outcomes, key)

    return [("searched", lambda rows: search_rows(rows, p.search)), ("verified", verified), ("normalized", normalized)]


def website_finder(
    rows: DataFrame, p: Providers, titles: Sequence[str] = (), max_contacts: int | None = None, stage: Stage = written,
    key: Key = "row_index",
) -> DataFrame:
    """(key, company_name, location) to websites and contacts; a table of several jobs needs their column in the key."""
    for name, step in website_phases(p, key):
        rows = stage(step(rows), name)
    return _with_enrichment(rows, p, titles, max_contacts, match_names=False)


def company_intel(
    rows: DataFrame,
    p: Providers,
    options: Sequence[str],
    titles: Sequence[str] = (),
    max_contacts: int | None = None,
    people_mode: bool = False,
    stage: Stage = written,
    key: Key = "row_index",
) -> DataFrame:
    """Rows with (key, input, input_type ...) through resolve, verify, crawl, extract and enrich."""
    names_persons = "full_name" in rows.columns
    missing = [c for c in ("company_name", "location", "full_name", "linkedin_url") if c not in rows.columns]
    if missing:
        rows = rows.withColumns({c: F.lit("") for c in missing})
    names = rows.filter(F.coalesce(F.col("input_type") != "url", F.lit(True))).select(
        *key_columns(key), F.col("input").alias("company_name"), "location"
    )
    given = answers(p.search, lambda: discover.search_requests(names))
    searched = discover.fan_out_search(names, discover.parse_search_responses(given))
    resolved = stage(verify.resolve_rows(rows.drop("raw_domain", "search_results"), searched, key), "resolved")

    items = verify.number_batches(verify.verify_items_intel(resolved, key), key=key)
    batch = [*job_columns(key), "batch_id"]
    told = stage(verify.read_verdicts(spread(p.verdicts.select(*batch, "body"), *batch), key), "verdicts")
    verdicts = verify.settle_verdicts(items.select("batch_id", *key_columns(key)), told, key=key)
    # what the search found is in the stage before, nothing later reads it
    verified = stage(verify.apply_verdicts_intel(resolved.drop("search_results"), verdicts, key), "verified")

    known, site_pages = p.crawled, p.site_pages
    if p.sites is not None and pages.needs_crawl(options):
        known, site_pages = p.sites(_domains(verified, F.col("raw_domain")))
    crawled = pages.apply_crawl(verified, known, site_pages, options)
    crawled = extract.with_intel_columns(crawled.withColumn("normalized_domain", F.lit(None).cast("string")))
    crawled = stage(crawled, "crawled")

    reads_answers = any(o in options for o in ("industry_description", "target_market"))
    if reads_answers:
        read = answers(p.extractions, lambda: _domains(crawled.filter(F.col("status") == "crawled"), F.col("raw_domain")))
        crawled = extract.merge_extractions(crawled, extract.parse_extractions(read))
    done = stage(extract.extract_status(crawled, reads_answers), "extracted")

    if "company_people" not in options or p.directory is None:
        return done.withColumn("contacts", F.lit(None).cast(f"array<{contacts.schemas.CONTACT}>"))
    if not people_mode:
        return _with_enrichment(done, p, titles, max_contacts, match_names=names_persons)
    people = done.select(
        *key_columns(key), "full_name", F.coalesce(blank_to_null("normalized_domain"), "raw_domain").alias("domain"), "linkedin_url"
    )
    listed = answers(p.directory, lambda: _domains(people, F.col("domain")))
    return contacts.apply_person_contacts(done, contacts.person_fan_out(people, listed, key), key)


def category_intel(products: DataFrame, p: Providers, options: Sequence[str], key: Key = "row_index", **kw) -> DataFrame:
    """Listing products (row_index, name, website ...) to company intel."""
    return company_intel(ingest.seed_category_rows(products, key), p, options, key=key, **kw)


def maps_intel(places: DataFrame, p: Providers, options: Sequence[str], key: Key = "row_index", **kw) -> DataFrame:
    return company_intel(ingest.seed_place_rows(places, key), p, options, key=key, **kw)


def funding_intel(companies: DataFrame, p: Providers, options: Sequence[str], key: Key = "row_index", **kw) -> DataFrame:
    return company_intel(ingest.seed_funding_rows(companies, key), p, options, key=key, **kw)


def profile_answers(people: DataFrame, profiles: Answers, key: Key = "row_index") -> DataFrame:
    """Profile and confidence per request from the profile search answers."""
    asked = discover.profile_requests(people, key)
    parsed = discover.parse_search_responses(answers(profiles, lambda: asked)).select("request_key", "results").filter(F.col("results").isNotNull())
    return discover.score_profile(discover.pick_profile(asked.join(parsed, "request_key")))


def people_intel(people: DataFrame, p: Providers, options: Sequence[str] = ("company_people",), key: Key = "row_index", **kw) -> DataFrame:
    """People (row_index, full_name, company_name, website) to one contact per person."""
    found = discover.fan_out_profiles(people, profile_answers(people, p.profiles, key))
    return company_intel(ingest.seed_people_rows(people, found, key), p, options, people_mode=True, key=key, **kw)


def funded_companies(articles: DataFrame, answers: DataFrame, ordinal: str, stage: Stage = written) -> DataFrame:
    """News articles and their extraction answers to one entry per company and round."""
    numbered = discover.dense_index(stage(discover.news_dedupe(articles), "articles"), ordinal, "item_index")
    entries = discover.parse_funding_responses(answers)
    return discover.funding_dedupe(discover.funding_rounds(entries, numbered))
