"""Site documents and the fields extracted from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow import schemas
from leadflow.functions import fixed
from leadflow.functions.tables import cap_per_key, first_per_key, look_up
from leadflow.functions.text import filled, or_blank, strict_json, strip

TEXT_FIELDS = ["industry", "niche", "description", "address", "phone", "target_market", "homepage_raw_text"]
LIST_FIELDS = ["case_studies", "website_contacts", "general_emails"]
INTEL_FIELDS = [
    "industry", "niche", "description", "address", "phone", "target_market", "case_studies",
    "website_contacts", "general_emails", "homepage_raw_text",
]
STATUS_FIELDS = ["industry", "niche", "description", "target_market", "case_studies"]
FLAG_FIELDS = [*STATUS_FIELDS, "homepage_raw_text"]

_BETWEEN = "\n\n---\n\n"
# "[Page: ]" with its line break and the separator: no page takes less room than this
_LEAST_PER_PAGE = 16


def site_documents(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """One document per domain from (domain, ordinal, url, text), with ``cap`` cut there with a marker.

    With a cap, pages that start behind the cut cannot show and are not gathered; addresses, lengths and
    counts cover all pages. Without one a document is as long as its site.
    """
    block = F.concat(F.lit("[Page: "), "url", F.lit("]\n"), or_blank("text"))
    blocks = pages.select("domain", "ordinal", "url", block.alias("_block"))
    urls = F.array_sort(F.collect_list(F.struct("ordinal", "url")))
    totals = blocks.groupBy("domain").agg(
        F.transform(urls, lambda p: p["url"]).alias("page_urls"),
        F.count(F.lit(1)).alias("n_pages"),
        (F.sum(F.length("_block")) + (F.count(F.lit(1)) - 1) * len(_BETWEEN)).alias("_chars"),
    )
    shown = cap_per_key(blocks, ["domain"], ["ordinal"], None if cap is None else max(1, cap // _LEAST_PER_PAGE))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "_block")))
    docs = shown.groupBy("domain").agg(ordered.alias("_pages"))
    joined = F.array_join(F.transform("_pages", lambda p: p["_block"]), _BETWEEN)
    document = joined
    if cap is not None:
        more = F.when(F.col("n_pages") > F.size("_pages"), _BETWEEN).otherwise("")
        cut = F.concat(F.substring(F.concat(joined, more), 1, cap), F.lit(fixed.TRUNCATION_MARK))
        document = F.when(F.col("_chars") > cap, cut).otherwise(joined)
    return docs.join(totals, "domain").select("domain", "n_pages", "page_urls", document.alias("document"))


def has_value(field: str, source: str = "") -> Column:
    """The field holds something: a non-empty text or list."""
    c = F.col(f"{source}{field}")
    return F.coalesce(F.size(c) > 0, F.lit(False)) if field in LIST_FIELDS else filled(c)


def parse_extractions(resp: DataFrame) -> DataFrame:
    """Answers as typed fields.

    ``present`` lists the keys of the answer, ``populated`` those that hold something; only an answer with
    a populated key may be cached. An unreadable or empty answer has neither.
    """
    parsed = resp.withColumn("intel", F.from_json(strict_json("body"), schemas.INTEL))
    keys = F.json_object_keys(strict_json("body"))
    with_keys = parsed.withColumn("present", F.coalesce(keys, F.array().cast("array<string>")))
    populated = F.filter(
        F.array(*[F.when(has_value(f, "intel."), F.lit(f)) for f in INTEL_FIELDS]), lambda f: f.isNotNull()
    )
    return (
        with_keys.withColumn("populated", F.when(F.size("present") > 0, populated).otherwise(F.array().cast("array<string>")))
        .withColumn("cacheable", F.size("populated") > 0)
        .drop("body")
    )


def merge_extractions(rows: DataFrame, intel: DataFrame) -> DataFrame:
    """Put a domain's answer into all its rows.

    Keys of the answer overwrite, null included; other fields stay. The row's domain becomes final. Of several
    answers of a domain that with most keys counts.
    """
    order = [-F.size("present"), F.xxhash64("intel")]
    answer = first_per_key(intel.select("domain", "intel", "present"), ["domain"], order).select(
        F.col("domain").alias("raw_domain"), F.col("intel").alias("_new"), F.col("present").alias("_keys")
    )
    joined = look_up(rows, answer, "raw_domain")
    merged = {
        f: F.when(F.array_contains("_keys", f), F.col(f"_new.{f}")).otherwise(F.col(f)) for f in INTEL_FIELDS
    }
    read = (F.col("status") == "crawled") & filled("raw_domain")
    merged["normalized_domain"] = F.when(read, F.col("raw_domain")).otherwise(F.col("normalized_domain"))
    return joined.withColumns(merged).drop("_new", "_keys")


def with_intel_columns(rows: DataFrame) -> DataFrame:
    """Add the intel fields a row does not have yet, empty."""
    kinds = {
        "case_studies": "array<string>", "general_emails": "array<string>",
        "website_contacts": "array<struct<name:string,title:string>>",
    }
    missing = {f: F.lit(None).cast(kinds.get(f, "string")) for f in INTEL_FIELDS if f not in rows.columns}
    return rows.withColumns(missing) if missing else rows


def _any(fields: list[str], blank_counts: bool) -> Column:
    def holds(f: str) -> Column:
        if f in LIST_FIELDS or blank_counts:
            return has_value(f)
        return strip(or_blank(f)) != ""

    out = holds(fields[0])
    for f in fields[1:]:
        out = out | holds(f)
    return out


def extract_status(rows: DataFrame, needs_answer: bool = True) -> DataFrame:
    """Row status after extraction; homepage text alone is no success."""
    has = filled("raw_domain")
    if not needs_answer:
        return rows.withColumn(
            "normalized_domain", F.when(has, F.col("raw_domain")).otherwise(F.col("normalized_domain"))
        ).withColumn("status", F.when(has, "extracted").otherwise(F.col("status")))
    final = F.col("status").isin("extracted", "extract_failed", "not_found", "scrape_failed")
    read = (F.col("status") == "crawled") & has
    left = ~final & ~read & has
    return rows.withColumn(
        "normalized_domain", F.when(read | left, F.col("raw_domain")).otherwise(F.col("normalized_domain"))
    ).withColumn(
        "status",
        F.when(read & _any(STATUS_FIELDS, blank_counts=False), "extracted")
        .when(read, "extract_failed")
        .when(final, F.col("status"))
        .when(has, "extract_failed")
        .otherwise("not_found"),
    )


def extracted_flag() -> Column:
    """'true' when any of the six intel fields holds something, homepage text included."""
    return F.when(_any(FLAG_FIELDS, blank_counts=True), "true").otherwise("false")


def intel_extracted_flag(rows: DataFrame) -> DataFrame:
    return rows.withColumn("intel_extracted", extracted_flag())
