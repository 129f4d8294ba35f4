"""Verification joins: items, batches, verdicts and what they do to a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow import schemas
from leadflow.functions import fixed
from leadflow.functions.tables import Key, first_per_key, job_columns, key_columns
from leadflow.functions.text import bare_host, blank_to_null, filled, or_blank, strict_json

MATCH_THRESHOLD = 0.7


def verify_items(rows: DataFrame, key: Key = "row_index") -> DataFrame:
    """Rows with a candidate domain as verification items."""
    return rows.filter(filled("raw_domain")).select(
        *key_columns(key),
        or_blank("company_name").alias("company_name"),
        or_blank("location").alias("location"),
        F.col("raw_domain").alias("candidate_domain"),
        F.col("search_results.results").alias("results"),
    )


def verify_items_intel(rows: DataFrame, key: Key = "row_index") -> DataFrame:
    """The variant for mixed inputs: URL rows need no check, the name falls back to the input."""
    named = rows.filter(F.coalesce(F.col("input_type") != "url", F.lit(True)))
    return verify_items(
        named.withColumn("company_name", F.coalesce(blank_to_null("company_name"), F.col("input"))), key
    )


def mark_without_candidate(rows: DataFrame) -> DataFrame:
    """Rows without a candidate become ``not_found``."""
    return rows.withColumn(
        "status", F.when(filled("raw_domain"), F.col("status")).otherwise("not_found")
    )


def item_text() -> Column:
    """Header line and the top three results of one item."""
    quote = lambda label, c: F.concat(F.lit(f'{label}="'), c, F.lit('"'))
    header = F.concat(
        F.lit("- row_index="), F.col("row_index").cast("string"), F.lit(" | "),
        quote("company", F.col("company_name")), F.lit(" | "),
        quote("location", F.col("location")), F.lit(" | "),
        quote("candidate_domain", F.col("candidate_domain")),
    )
    top = F.slice(F.coalesce("results", F.array().cast(f"array<{schemas.SEARCH_RESULT}>")), 1, 3)
    lines = F.transform(
        top,
        lambda r, i: F.concat(
            F.lit("    result_"), (i + 1).cast("string"), F.lit(": "),
            quote("domain", or_blank(r["domain"])), F.lit(" | "),
            quote("title", or_blank(r["title"])), F.lit(" | "),
            quote("snippet", or_blank(r["snippet"])),
        ),
    )
    return F.array_join(F.concat(F.array(header), lines), "\n")


def number_batches(
    items: DataFrame, size: int = fixed.VERDICT_BATCH, block: int = fixed.ROW_BATCH, key: Key = "row_index"
) -> DataFrame:
    """Add ``batch_id``: ``size`` items each, cut inside blocks of ``block`` rows; every job counts its own.

    The block comes from the row index, so no window ever holds more than ``block`` rows.
    """
    w = Window.partitionBy(*job_columns(key), "_block").orderBy("row_index")
    per_block = -(-block // size)
    return (
        items.withColumn("_block", F.floor(F.col("row_index") / block))
        .withColumn("_in_block", F.floor((F.row_number().over(w) - 1) / size))
        .withColumn("batch_id", F.col("_block") * per_block + F.col("_in_block"))
        .drop("_block", "_in_block")
    )


def verify_batches(
    items: DataFrame, size: int = fixed.VERDICT_BATCH, block: int = fixed.ROW_BATCH, key: Key = "row_index"
) -> DataFrame:
    """One text block per batch of items."""
    batch = [*job_columns(key), "batch_id"]
    numbered = number_batches(items, size, block, key).select(*batch, "row_index", item_text().alias("_text"))
    ordered = F.array_sort(F.collect_list(F.struct("row_index", "_text")))  # at most `size` per group
    return numbered.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.array_join(F.transform(ordered, lambda x: x["_text"]), "\n").alias("items"),
    )


def verdict_columns() -> list[str]:
    return ["row_index", "match", "confidence", "reason", "suggested_domain", "errored"]


def _answer_cells(entry: Column) -> Column:
    """Text and kind of every cell of one answer entry; the kind of a missing key is null."""
    def kind(key: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(entry, f"$.{key}", "variant"))

    keys = ("row_index", "match", "confidence", "reason")
    texts = [F.try_variant_get(entry, f"$.{k}", "string").alias(k) for k in (*keys, "suggested_domain")]
    return F.struct(*texts, *[kind(k).alias(f"{k}_kind") for k in keys])


def _verdict_cells(e: Column) -> Column:
    """Typed cells of one entry; ``good`` is false when a key is missing or a number unreadable."""
    row, conf, match = e["row_index"], e["confidence"], e["match"]
    # a quoted number must be whole, a bare one is cut to a whole number
    row_index = (
        F.when(e["row_index_kind"] == "BOOLEAN", F.when(row == "true", 1).otherwise(0))
        .when(e["row_index_kind"] == "STRING", F.trim(row).try_cast("long"))
        .otherwise(row.try_cast("double").try_cast("long"))
    )
    confidence = F.when(e["confidence_kind"] == "BOOLEAN", F.when(conf == "true", 1.0).otherwise(0.0)).otherwise(
        F.trim(conf).try_cast("double")
    )
    # false, null, zero and everything empty count as no match; any other text is a match
    quoted = e["match_kind"] == "STRING"
    bare_no = match.isNull() | (match == "false") | match.try_cast("double").eqNullSafe(F.lit(0.0))
    matched = F.when(quoted, match != "").otherwise(~bare_no & ~e["match_kind"].isin("ARRAY<VOID>", "OBJECT<>"))
    complete = e["match_kind"].isNotNull() & e["reason_kind"].isNotNull()
    return F.struct(
        row_index.cast("long").alias("row_index"),
        F.coalesce(matched, F.lit(False)).alias("match"),
        confidence.alias("confidence"),
        F.coalesce(e["reason"], F.lit("None")).alias("reason"),
        blank_to_null(e["suggested_domain"]).alias("suggested_domain"),
        F.lit(False).alias("errored"),
        (row_index.isNotNull() & confidence.isNotNull() & complete).alias("good"),
    )


def read_verdicts(resp: DataFrame, key: Key = "row_index") -> DataFrame:
    """(the job columns of the key, batch_id, entries): typed entries of each answer, null where one is bad or none is readable."""
    batch = [*job_columns(key), "batch_id"]
    doc = F.try_parse_json(strict_json("body"))
    kind = F.schema_of_variant("_doc")
    listed = F.try_variant_get("_doc", "$", "array<variant>")
    wrapped = F.try_variant_get("_doc", "$.results", "array<variant>")
    return (
        resp.select(*batch, doc.alias("_doc"))
        .select(
            *batch,
            F.when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT"), wrapped).alias("_e"),
        )
        .select(*batch, F.transform(F.transform("_e", _answer_cells), _verdict_cells).alias("_e"))
        .select(*batch, F.when(F.forall("_e", lambda e: e["good"]), F.col("_e")).alias("entries"))
    )


def parse_verdicts(
    batches: DataFrame, resp: DataFrame, size: int = fixed.VERDICT_BATCH, block: int = fixed.ROW_BATCH, key: Key = "row_index"
) -> DataFrame:
    """One verdict per item.

    ``batches(batch_id, row_index)`` are the items sent, ``resp(batch_id, body)`` one answer per batch:
    an array, or an object with ``results``. One bad entry, or no readable answer, fails the whole batch:
    every item of it gets match false, confidence 0.0 and errored true. An answer speaks of the items that were
    sent in its block of rows, other row numbers are passed over; the last verdict of an item counts. With a
    ``key`` of several columns both tables hold those of the job, and an answer speaks of its own job only.
    """
    return settle_verdicts(batches, read_verdicts(resp, key), size, block, key)


def settle_verdicts(
    batches: DataFrame, answered: DataFrame, size: int = fixed.VERDICT_BATCH, block: int = fixed.ROW_BATCH, key: Key = "row_index"
) -> DataFrame:
    """``parse_verdicts`` over answers that ``read_verdicts`` read; they are used twice, so a large job has them written."""
    jobs = job_columns(key)
    batch = [*jobs, "batch_id"]
    of_block = F.floor(F.col("batch_id") / -(-block // size)).alias("_block")
    sent = batches.select(*jobs, of_block, F.col("row_index").cast("long").alias("row_index")).distinct()
    parsed = (
        answered.select(*batch, F.posexplode_outer("entries").alias("_pos", "e"))
        .filter(F.col("e").isNotNull())
        .select(*batch, "_pos", of_block, *[F.col(f"e.{c}").alias(c) for c in verdict_columns()])
        .join(sent, [*jobs, "_block", "row_index"], "left_semi")
        .drop("_block")
    )
    usable = answered.filter(F.col("entries").isNotNull()).select(*batch).distinct()
    failed = batches.join(usable, batch, "left_anti").select(
        *batch,
        F.lit(-1).alias("_pos"),
        F.col("row_index").cast("long").alias("row_index"),
        F.lit(False).alias("match"),
        F.lit(0.0).alias("confidence"),
        F.lit(fixed.FAILED_VERDICT).alias("reason"),
        F.lit(None).cast("string").alias("suggested_domain"),
        F.lit(True).alias("errored"),
    )
    # the later batch and place first; a tie of equal places by the surest
    order = [-F.col("batch_id"), -F.col("_pos"), -F.col("confidence"), F.xxhash64("reason", "suggested_domain")]
    return first_per_key(parsed.unionByName(failed), key_columns(key), order).select(*jobs, *verdict_columns())


def _verdicts_by_row(verdicts: DataFrame, key: Key) -> DataFrame:
    """One verdict per row: one that did not fail, the surest, whatever the table repeats."""
    known = verdicts.select(*key_columns(key), "match", "confidence", "suggested_domain", *[c for c in ("errored",) if c in verdicts.columns])
    failed = [F.coalesce("errored", F.lit(False))] if "errored" in verdicts.columns else []
    order = [*failed, -F.coalesce("confidence", F.lit(-1.0)), ~F.coalesce("match", F.lit(False)), or_blank("suggested_domain")]
    return first_per_key(known, key_columns(key), order).select(
        *key_columns(key),
        F.col("match").alias("_match"),
        F.col("confidence").alias("_conf"),
        F.col("suggested_domain").alias("_suggested"),
    )


def _accepted() -> Column:
    return F.coalesce(F.col("_match") & (F.col("_conf") >= MATCH_THRESHOLD), F.lit(False))


def apply_verdicts(rows: DataFrame, verdicts: DataFrame, key: Key = "row_index") -> DataFrame:
    """A sure match verifies the candidate, else a suggestion replaces it, else the row is not found.

    A failed call reads as not found; an item without any verdict keeps its status.
    """
    ok, suggested, judged = _accepted(), filled("_suggested"), F.col("_conf").isNotNull()
    return (
        mark_without_candidate(rows).join(_verdicts_by_row(verdicts, key), key_columns(key), "left")
        .withColumn(
            "verified_domain",
            F.when(judged & ok, F.col("raw_domain")).when(judged & suggested, F.col("_suggested"))
            .otherwise(F.lit(None).cast("string")),
        )
        .withColumn("verification_confidence", F.col("_conf"))
        .withColumn(
            "status",
            F.when(~judged, F.col("status")).when(ok | suggested, "verified").otherwise("not_found"),
        )
        .drop("_match", "_conf", "_suggested")
    )


def apply_verdicts_intel(rows: DataFrame, verdicts: DataFrame, key: Key = "row_index") -> DataFrame:
    """The same rule on ``raw_domain``: a suggestion replaces it, a rejection empties it; URL rows pass."""
    checked = F.coalesce(F.col("input_type") != "url", F.lit(True)) & filled("raw_domain")
    ok, suggested = _accepted(), filled("_suggested")
    judged = checked & F.col("_conf").isNotNull()
    marked = mark_without_candidate(rows).join(_verdicts_by_row(verdicts, key), key_columns(key), "left")
    return (
        marked.withColumn("_judged", judged)
        .withColumn("verification_confidence", F.when(F.col("_judged"), F.col("_conf")))
        .withColumn(
            "status",
            F.when(~F.col("_judged"), F.col("status")).when(ok | suggested, "verified").otherwise("not_found"),
        )
        .withColumn(
            "raw_domain",
            F.when(~F.col("_judged") | ok, F.col("raw_domain")).when(suggested, F.col("_suggested")),
        )
        .drop("_match", "_conf", "_suggested", "_judged")
    )


def resolve_rows(rows: DataFrame, searched: DataFrame, key: Key = "row_index") -> DataFrame:
    """URL rows take the host of their text, name rows the candidate of their search; all are resolved.

    ``searched(row_index, search_results, candidate_domain)`` holds the answers of the name rows.
    """
    answers = searched.select(*key_columns(key), F.col("search_results").alias("_sr"), F.col("candidate_domain").alias("_cand"))
    is_url = F.coalesce(F.col("input_type") == "url", F.lit(False))
    return (
        rows.join(answers, key_columns(key), "left")
        .withColumn("raw_domain", blank_to_null(F.when(is_url, bare_host("input")).otherwise(F.col("_cand"))))
        .withColumn("search_results", F.when(~is_url, F.col("_sr")))
        .withColumn("status", F.lit("resolved"))
        .drop("_sr", "_cand")
    )
