"""Exports, summaries and result views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.functions import fixed
from leadflow.functions.tables import Key, key_columns
from leadflow.functions.text import blank_to_null, filled, first_filled, natural_key, or_blank, sanitize
from leadflow.operators.extract import extracted_flag, with_intel_columns


def sanitize_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Defuse cells that a spreadsheet would run as a formula."""
    return df.withColumns({c: sanitize(c) for c in cols})


# --- exports --------------------------------------------------------------------------------

def _text(c: str) -> Column:
    return or_blank(F.col(c).cast("string"))


def _number(c: str) -> Column:
    """A zero prints as blank, like a missing value."""
    return F.when(F.col(c) != 0, F.col(c).cast("string")).otherwise("")


def _intel_cells(options: Sequence[str]) -> list[Column]:
    cells: list[Column] = []
    if "industry_description" in options:
        cells += [_text(c).alias(c) for c in ("industry", "niche", "description", "address")]
        cells.append(_text("phone").alias("company_phone"))
        cells.append(or_blank(F.array_join("general_emails", ", ")).alias("general_emails"))
    if "target_market" in options:
        cells.append(_text("target_market").alias("target_market"))
        cells.append(or_blank(F.array_join("case_studies", ", ")).alias("case_studies"))
    if "homepage_raw_text" in options:
        cells.append(_text("homepage_raw_text").alias("homepage_raw_text"))
    return cells


# Output column and contact field, in column order.
_CONTACT_CELLS = [
    ("contact_title", "title"), ("first_name", "first_name"), ("last_name", "last_name"),
    ("email", "email"), ("phone", "phone"), ("linkedin", "linkedin_url"),
]
_CONTACT_CELLS_MOBILE = [*_CONTACT_CELLS[:5], ("mobile", "mobile"), _CONTACT_CELLS[5]]
_NAME_CELLS = ("title", "first_name", "last_name", "email")


def _contact_cells(cells, contact: Column, sanitized: Sequence[str], prefix: str = "") -> list[Column]:
    out = []
    for name, field in cells:
        value = or_blank(contact[field])
        out.append((sanitize(value) if field in sanitized else value).alias(prefix + name))
    return out


def _export(rows: DataFrame, base: list[Column], cells, sanitized: Sequence[str], key: Key) -> DataFrame:
    """One line per contact, one with blank contact cells where there is none."""
    lines = rows.select(*key_columns(key), *base, F.posexplode_outer("contacts").alias("_pos", "_contact"))
    names = [c for c in lines.columns if c not in ("_pos", "_contact")]
    return lines.select(
        *names, F.coalesce("_pos", F.lit(0)).alias("contact_no"), *_contact_cells(cells, F.col("_contact"), sanitized)
    )


def export_websites(rows: DataFrame, key: Key = "row_index") -> DataFrame:
    """Website finder export; the key and ``contact_no`` carry the line order."""
    base = [
        sanitize(or_blank("company_name")).alias("company_name"),
        sanitize(or_blank("location")).alias("location"),
        first_filled("normalized_domain", "verified_domain").alias("website"),
        _text("verification_confidence").alias("verification_confidence"),
        F.col("status"),
    ]
    return _export(rows, base, _CONTACT_CELLS, _NAME_CELLS, key)


def _website() -> Column:
    return first_filled("normalized_domain", "raw_domain").alias("website")


def _flag() -> Column:
    return extracted_flag().alias("intel_extracted")


_EVERY_CELL = ("title", "first_name", "last_name", "email", "phone", "mobile", "linkedin_url")


def export_intel(rows: DataFrame, options: Sequence[str], key: Key = "row_index") -> DataFrame:
    base = [sanitize(or_blank("input")).alias("input"), _website(), F.col("status"), _flag(), *_intel_cells(options)]
    return _export(with_intel_columns(rows), base, _CONTACT_CELLS, _EVERY_CELL, key)


def export_categories(rows: DataFrame, options: Sequence[str], key: Key = "row_index") -> DataFrame:
    base = [
        sanitize(or_blank("g2_category")).alias("g2_category"),
        or_blank("g2_url").alias("g2_url"),
        _number("g2_rating").alias("g2_rating"),
        _number("g2_review_count").alias("g2_review_count"),
        sanitize(or_blank("input")).alias("input"),
        _website(), F.col("status"), _flag(), *_intel_cells(options),
    ]
    return _export(with_intel_columns(rows), base, _CONTACT_CELLS_MOBILE, _EVERY_CELL, key)


def export_places(rows: DataFrame, options: Sequence[str], key: Key = "row_index") -> DataFrame:
    named = ("search_term", "location", "business_name", "category", "maps_address")
    base = [
        *[sanitize(_text(c)).alias(c) for c in named],
        _text("maps_phone").alias("maps_phone"),
        _website(),
        *[_number(c).alias(c) for c in ("rating", "review_count", "latitude", "longitude")],
        _text("google_maps_url").alias("google_maps_url"),
        F.col("status"), _flag(), *_intel_cells(options),
    ]
    return _export(with_intel_columns(rows), base, _CONTACT_CELLS, _NAME_CELLS, key)


def export_funding(rows: DataFrame, options: Sequence[str], key: Key = "row_index") -> DataFrame:
    base = [
        sanitize(_text("company_name")).alias("company_name"),
        _text("funding_amount").alias("funding_amount"),
        _text("funding_round").alias("funding_round"),
        sanitize(_text("lead_investor")).alias("lead_investor"),
        *[_text(c).alias(c) for c in ("funding_description", "source_url", "source_name")],
        _website(), F.col("status"), _flag(), *_intel_cells(options),
    ]
    return _export(with_intel_columns(rows), base, _CONTACT_CELLS, _NAME_CELLS, key)


_PERSON_CELLS = [
    ("contact_title", "title"), ("contact_first_name", "first_name"), ("contact_last_name", "last_name"),
    ("contact_email", "email"), ("contact_phone", "phone"), ("contact_linkedin", "linkedin_url"),
]


def export_people(rows: DataFrame, options: Sequence[str], key: Key = "row_index") -> DataFrame:
    """One line per person with the first contact only; no flag column."""
    rows = with_intel_columns(rows)
    return rows.select(
        *key_columns(key),
        sanitize(or_blank("full_name")).alias("full_name"),
        sanitize(or_blank("company_name")).alias("company_name"),
        or_blank("linkedin_url").alias("linkedin_url"),
        _text("linkedin_confidence").alias("linkedin_confidence"),
        _website(), F.col("status"), *_intel_cells(options),
        *_contact_cells(_PERSON_CELLS, F.try_element_at("contacts", F.lit(1)), _NAME_CELLS),
    )


_WIDE_CELLS = [
    ("Title", "title"), ("First Name", "first_name"), ("Last Name", "last_name"), ("Email", "email"),
    ("Phone", "phone"), ("LinkedIn", "linkedin_url"),
]


def wide_contacts(rows: DataFrame, titles: Sequence[str], key: Key = "row_index") -> DataFrame:
    """One line per row; contact *i* fills the six columns of title *i*, whatever its own title."""
    base = ["company_name", "location", "website", "verification_confidence", "status"]
    wide = []
    for i, title in enumerate(titles, 1):
        wide += _contact_cells(_WIDE_CELLS, F.try_element_at("contacts", F.lit(i)), (), f"{title} - ")
    return rows.select(*key_columns(key), *[_text(c).alias(c) for c in base], *wide)


# --- summaries ------------------------------------------------------------------------------

def contact_key(contact: Column) -> Column:
    """E-mail, else first|last; case counts, and 'N/A' counts as an address."""
    name = F.concat(or_blank(contact["first_name"]), F.lit("|"), or_blank(contact["last_name"]))
    return F.when(filled(contact["email"]), contact["email"]).when(name != "|", name)


def distinct_contacts(rows: DataFrame) -> DataFrame:
    keys = rows.select(F.explode("contacts").alias("c")).select(contact_key(F.col("c")).alias("k"))
    return keys.agg(F.count_distinct("k").alias("contacts_enriched"))


def job_summary(rows: DataFrame, tool: str = "websites") -> DataFrame:
    """total_rows, websites_found, intel_extracted and distinct contacts of a job.

    The website finder counts final domains; the intel tools count resolved ones too and rows with any
    extracted field.
    """
    found = filled("normalized_domain")
    counts = [F.count(F.lit(1)).alias("total_rows")]
    if tool == "websites":
        counts.append(F.count_if(found).alias("websites_found"))
    else:
        counts.append(F.count_if(found | filled("raw_domain")).alias("websites_found"))
        counts.append(F.count_if("has_extracted").alias("intel_extracted"))
    totals = rows.agg(*counts)
    contacts = distinct_contacts(rows).select("contacts_enriched").scalar()
    return totals.withColumn("contacts_enriched", contacts)


def progress_counts(rows: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """found: rows with a final domain; enriched: rows whose contact list is not null, empty ones included."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count("normalized_domain").alias("found_count"),
        F.count("contacts").alias("enriched_count"),
    )


def preview_rows(rows: DataFrame, key: Key = "row_index") -> DataFrame:
    """Shape of a preview row; the company comes from the first filled naming column."""
    names = [c for c in ("company_name", "Company Name", "business_name", "input") if c in rows.columns]
    places = [c for c in ("location", "Location") if c in rows.columns]
    company = F.coalesce(*[blank_to_null(F.col(f"`{c}`")) for c in names])
    place = F.coalesce(*[blank_to_null(F.col(f"`{c}`")) for c in places]) if places else F.lit(None).cast("string")
    extra = [c for c in ("contacts", "industry", "niche") if c in rows.columns]
    return rows.filter(F.col("status") != "pending").select(
        *key_columns(key), company.alias("company_name"), place.alias("location"),
        F.coalesce(blank_to_null("normalized_domain"), blank_to_null("verified_domain")).alias("domain"),
        F.col("verification_confidence").cast("string").alias("confidence"), "status", *extra,
    )


def preview_page(rows: DataFrame, limit: int = 50, offset: int = 0, key: Key = "row_index") -> DataFrame:
    """One page of processed rows by key, with the total of all pages in ``total``."""
    if not 1 <= limit <= 5000 or offset < 0:
        raise ValueError("limit must be 1 to 5000, offset not negative")
    shaped = preview_rows(rows, key)
    total = rows.filter(F.col("status") != "pending").agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return shaped.orderBy(*key_columns(key)).offset(offset).limit(limit).withColumn("total", total)


def write_preview(rows: DataFrame, folder: str, key: Key = "row_index", ranges: int | None = None) -> str:
    """Store the processed rows for paging: sorted by key into ranges, and the number of rows of each; returns the folder.

    Without ``ranges`` Spark sizes them. ``folder/rows`` has a directory a range, ``folder/ranges`` one row a range,
    ``folder/columns`` the columns.
    """
    cols = key_columns(key)
    shaped = preview_rows(rows, key)
    dealt = shaped.repartitionByRange(*cols) if ranges is None else shaped.repartitionByRange(ranges, *cols)
    placed = dealt.sortWithinPartitions(*cols).withColumn("_range", F.spark_partition_id())
    placed.write.partitionBy("_range").parquet(f"{folder}/rows")
    rows.sparkSession.createDataFrame([], shaped.schema).write.parquet(f"{folder}/columns")  # known also without rows
    stored = rows.sparkSession.read.schema(placed.schema).parquet(f"{folder}/rows")
    stored.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/ranges")
    return folder


def preview_stored(spark: SparkSession, folder: str, limit: int = 50, offset: int = 0, key: Key = "row_index") -> DataFrame:
    """A page of ``write_preview``'s table, equal to that of ``preview_page``: only the ranges it lies in are read."""
    if not 1 <= limit <= 5000 or offset < 0:
        raise ValueError("limit must be 1 to 5000, offset not negative")
    ends = spark.read.parquet(f"{folder}/ranges").withColumn("end", F.sum("n").over(Window.orderBy("_range")))  # one row a range
    total = F.max("end").over(Window.partitionBy())
    hit = ends.withColumn("total", total).filter((F.col("end") > offset) & (F.col("end") - F.col("n") < offset + limit))
    wanted = hit.orderBy("_range").collect()  # a few ranges, those of one page
    rows = spark.read.schema(preview_schema(spark, folder)).parquet(f"{folder}/rows")
    before, total = (wanted[0]["end"] - wanted[0]["n"], wanted[0]["total"]) if wanted else (0, 0)
    some = rows.filter(F.col("_range").isin([r["_range"] for r in wanted])).drop("_range")
    page = some.orderBy(*key_columns(key)).offset(max(0, offset - before)).limit(limit)
    return page.withColumn("total", F.lit(total).cast("long"))


def preview_schema(spark: SparkSession, folder: str) -> T.StructType:
    """Columns of the stored rows and the range."""
    columns = spark.read.parquet(f"{folder}/columns").schema
    return T.StructType([*columns.fields, T.StructField("_range", T.IntegerType())])


def flatten_results(rows: DataFrame) -> DataFrame:
    """First contact and industry fields as flat columns, empty ones null."""
    first = F.try_element_at("contacts", F.lit(1))
    name = F.trim(F.concat(or_blank(first["first_name"]), F.lit(" "), or_blank(first["last_name"])))
    rows = with_intel_columns(rows)
    return rows.withColumns(
        {
            "contact_name": F.when(first.isNotNull(), blank_to_null(name)),
            "contact_title": blank_to_null(first["title"]),
            "contact_email": blank_to_null(first["email"]),
            "contact_phone": blank_to_null(first["phone"]),
            "contact_linkedin": blank_to_null(first["linkedin_url"]),
            "industry": blank_to_null("industry"),
            "niche": blank_to_null("niche"),
        }
    )


def filter_results(
    rows: DataFrame, tab: str = "all", text: str = "", sort: str = "row_index", descending: bool = False,
    key: Key = "row_index",
) -> DataFrame:
    """Rows of a tab whose company holds the text, sorted with numbers in natural order."""
    if tab == "found":
        rows = rows.filter(F.col("status").isin(fixed.FOUND_STATUSES))
    elif tab == "not_found":
        rows = rows.filter(F.col("status").isin(fixed.NOT_FOUND_STATUSES))
    if text.strip():
        rows = rows.filter(F.lower("company_name").contains(text.lower()))
    by = natural_key(F.col(sort).cast("string"))
    return rows.orderBy(by.desc() if descending else by.asc(), *key_columns(key))


def rounded_percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves up; 0 when there is nothing."""
    return F.when(whole > 0, F.floor(part / whole * 100 + 0.5)).otherwise(0).cast("int")


def match_rate(rows: DataFrame) -> DataFrame:
    """total, found, percent found and distinct contacts."""
    totals = rows.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(filled("normalized_domain")).alias("found")
    )
    contacts = distinct_contacts(rows).select("contacts_enriched").scalar()
    return totals.withColumn("match_rate", rounded_percent(F.col("found"), F.col("total_rows"))).withColumn(
        "contacts_enriched", contacts
    )


def confidence_buckets(rows: DataFrame, confidence_col: str = "verification_confidence") -> DataFrame:
    """Rows per confidence band; the rounded percent is compared."""
    pct = F.floor(F.col(confidence_col) * 100 + 0.5)
    band = F.when(pct.isNull(), "missing").when(pct >= 80, "high").when(pct >= 50, "medium").otherwise("low")
    return rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n_rows"))


def status_groups(df: DataFrame, view: str = "preview", status_col: str = "status") -> DataFrame:
    """Add ``status_group`` and ``status_label``; the live preview and the result table differ."""
    s = F.col(status_col)
    spaced = F.replace(s, F.lit("_"), F.lit(" "))
    if view == "preview":
        group = F.lit("secondary")
        for name in ("warning", "destructive", "success"):
            group = F.when(s.isin(fixed.PREVIEW_GROUPS[name]), name).otherwise(group)
        label = F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s)))
        for status, text in fixed.PREVIEW_LABELS.items():
            label = F.when(s == status, text).otherwise(label)
    else:
        group = (
            F.when(s.isin(fixed.FOUND_STATUSES), "success")
            .when(s.isin(fixed.NOT_FOUND_STATUSES), "destructive")
            .when(s.isin("pending", "processing"), "secondary")
            .otherwise("outline")
        )
        words = F.split(spaced, " ")
        label = F.array_join(
            F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " "
        )
    return df.withColumn("status_group", group).withColumn("status_label", label)


# statuses that have passed each phase
PHASE_STATUSES = {
    "search": [s for s in fixed.ROW_STATUSES if s != "pending"],
    "verify": ["verified", "normalized", "enriched", "not_found", "blocked", "failed", "crawled",
               "extracted", "extract_failed", "scrape_failed"],
    "normalize": ["normalized", "enriched", "blocked", "failed"],
    "crawl": ["crawled", "extracted", "enriched", "scrape_failed", "extract_failed"],
    "extract": ["extracted", "enriched", "extract_failed"],
    "enrich": ["enriched"],
}


def phase_progress(rows: DataFrame, phases: Sequence[str] = ("search", "verify", "normalize", "enrich"), total: int | None = None) -> DataFrame:
    """done, total and percent per phase: (phase, done, total, percent). One pass over the rows."""
    done = [F.count_if(F.col("status").isin(PHASE_STATUSES[p])).alias(p) for p in phases]
    counts = rows.agg(F.count(F.lit(1)).alias("_n"), *done)
    all_rows = F.col("_n") if total is None else F.lit(total).cast("long")
    lines = F.array(*[F.struct(F.lit(p).alias("phase"), F.col(p).alias("done")) for p in phases])
    return counts.select(all_rows.alias("total"), F.inline(lines)).select(
        "phase", "done", "total", rounded_percent(F.col("done"), F.col("total")).alias("percent")
    )


def enriched_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("status") == "enriched").alias("enriched"))
