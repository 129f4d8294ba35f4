"""Captures, allowed row statuses, per-site diagnosis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.functions import fixed
from leadflow.functions.tables import first_per_key
from leadflow.streaming.feeds import status_changes


def upsert_captures(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (email, tool): the first id and time stay, the last address and source win, null too.

    Both tables carry (id, email, tool_slug, ip_address, source, ts); ``id`` orders equal times.
    """
    both = current.unionByName(incoming)
    at = F.struct("ts", "id")
    return both.groupBy("email", "tool_slug").agg(
        F.min_by(F.struct("id", F.col("ts").alias("created_at")), at).alias("_first"),
        F.max_by(F.struct("ip_address", "source"), at).alias("_last"),
    ).select("email", "tool_slug", "_first.*", "_last.*")


def unknown_statuses(rows: DataFrame) -> DataFrame:
    """Statuses outside the allowed set, with their row count; must be empty."""
    return (
        rows.filter(~F.col("status").isin(fixed.ROW_STATUSES) | F.col("status").isNull())
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def row_status_flow(
    history: DataFrame, steps: Sequence[tuple[str, str]], key: str = "row_index", order: Sequence[str] = ("ts", "event_id"), first: str = "pending"
) -> DataFrame:
    """Illegal steps of rows through their statuses: the snapshots that took them, with ``previous_status`` and ``problem``.

    ``history`` holds snapshots (key, order columns, status). A row begins as ``first``; from there only ``steps`` lead on,
    and a repeated status is no step. The problem is ``begins elsewhere``, ``unknown status`` (in no step) or
    ``illegal step``. Changes are found slot by slot in time, so a row with very many snapshots spreads over tasks.
    """
    known = sorted({s for step in steps for s in step})
    changes = status_changes(history, key, order)
    begins = first_per_key(history.withColumn("_key", F.struct(key)), ["_key"], list(order)).drop("_key")
    begins = begins.filter(~F.col("status").eqNullSafe(first)).withColumn("previous_status", F.lit(None).cast("string"))
    step = F.struct(F.col("previous_status"), F.col("status"))
    legal = F.array(*[F.struct(F.lit(a).alias("previous_status"), F.lit(b).alias("status")) for a, b in steps])
    unknown = F.coalesce(~F.col("status").isin(known), F.lit(True))
    problem = F.when(unknown, "unknown status").when(~F.array_contains(legal, step), "illegal step")
    bad = changes.withColumn("problem", problem).filter(F.col("problem").isNotNull())
    return bad.unionByName(begins.withColumn("problem", F.when(unknown, "unknown status").otherwise("begins elsewhere")).select(bad.columns))


def job_diagnosis(site_pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """Pages, characters, characters per page and populated fields per domain."""
    pages = site_pages.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum(F.length("text")).alias("total_chars")
    )
    fields = parsed.select(
        "domain", F.size("populated").alias("populated_fields"), F.size("present").alias("total_fields")
    )
    return (
        pages.join(fields, "domain", "left")
        .withColumn("chars_per_page", F.col("total_chars") / F.col("n_pages"))
        .na.fill(0, ["populated_fields", "total_fields"])
    )
