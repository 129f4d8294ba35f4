"""Progress feed, change feed and first-seen feed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leadflow.functions.text import micros
from leadflow.streaming.limits import use_rocksdb

TERMINAL = ["completed", "failed"]


def progress_stream(rows: DataFrame) -> DataFrame:
    """Running counts per job over a feed of row results: (job_id, processed, found, enriched, terminal).

    Works on a stream (update mode) and on a table. ``terminal`` turns true with the job's last status. On a stream the
    counts of a job stay in state for good; ``finished_jobs`` ends them.
    """
    return rows.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("processed_rows"),
        F.count("normalized_domain").alias("found_count"),
        F.count("contacts").alias("enriched_count"),
        F.coalesce(F.max(F.col("job_status").isin(TERMINAL)), F.lit(False)).alias("terminal"),
    )


class _JobKeeper(StatefulProcessor):
    """Counts of one job until some time after its last status, when a timer sends them and ends the state."""

    def __init__(self, grace: int, idle: int):
        self.grace, self.idle = grace, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "processed bigint, found bigint, enriched bigint, ends bigint, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        processed, found, enriched, ends, status = self.job.get() if self.job.exists() else (0, 0, 0, None, None)
        last, seen = 0, []
        for pdf in rows:  # of a micro-batch only these five values of a row are held, to take them in time order
            seen += zip(*(pdf.iloc[:, i] for i in range(2, 7)))  # by place: not every name reaches the worker
        for us, end, has_domain, has_contacts, name in sorted(seen, key=lambda r: r[:4]):
            if ends is not None and us > ends:
                continue  # the job is over; what comes later than its grace is no part of it
            processed, found, enriched, last = processed + 1, found + int(has_domain), enriched + int(has_contacts), us
            if end and ends is None:
                ends, status = int(us) + self.grace, name
        self.job.update((processed, found, enriched, ends, status))
        if ends is not None or last:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer((int(last) + self.idle if ends is None else ends) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        processed, found, enriched, ends, status = self.job.get()
        self.job.clear()
        yield pd.DataFrame({
            "job_id": [key[0]], "processed_rows": [processed], "found_count": [found], "enriched_count": [enriched],
            "terminal": [ends is not None], "job_status": [status],
        })

    def close(self) -> None:
        pass


def finished_jobs(rows: DataFrame, *, grace: str = "1 hour", idle: str = "7 days", delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """One row per job of a stream once it is over, in append mode: its counts, ``terminal`` and the status that ended it.

    A job is over ``grace`` after its first row of a terminal status, or ``idle`` after its last row (``terminal`` is
    false then). Its state goes with that row, so state holds running jobs alone. Rows count up to the end by their own
    time; rows later than the end, later than the watermark (``delay`` behind the newest) or without a time do not. A job
    that comes again once its row went out is a new one.
    """
    use_rocksdb(rows.sparkSession)
    length = lambda text: int(pd.Timedelta(text).total_seconds() * 1_000_000)
    fed = rows.filter(F.col(ts).isNotNull()).withWatermark(ts, delay).select(
        "job_id", ts, micros(ts).alias("_us"), F.coalesce(F.col("job_status").isin(TERMINAL), F.lit(False)).alias("_end"),
        F.col("normalized_domain").isNotNull().alias("_found"), F.col("contacts").isNotNull().alias("_enriched"), "job_status",
    )
    kind = (
        f"job_id {dict(rows.dtypes)['job_id']}, processed_rows bigint, found_count bigint, enriched_count bigint, terminal boolean, job_status string"
    )
    return fed.groupBy("job_id").transformWithStateInPandas(_JobKeeper(length(grace), length(idle)), kind, "append", "eventtime")


def status_changes(
    snapshots: DataFrame, key: str = "row_index", order: Sequence[str] = ("ts", "event_id"), slot_seconds: int = 86_400
) -> DataFrame:
    """Snapshots whose status differs from the row's previous one; the first sight is no change.

    A row's history is cut into time slots; each slot takes over the last status of the slot before, so a
    row with very many snapshots spreads over many tasks. A null key is a row like others; snapshots without a
    time come first.
    """
    cut = snapshots.withColumn("_slot", F.floor(micros(order[0]) / (slot_seconds * 1_000_000)))
    at = F.struct(*order)
    # a struct keeps a null status apart from no status at all
    ends = cut.groupBy(key, "_slot").agg(F.max_by(F.struct("status"), at).alias("_last"))
    carried = ends.select(
        F.col(key).alias("_key"), F.col("_slot").alias("_at_slot"), F.lag("_last").over(Window.partitionBy(key).orderBy("_slot")).alias("_carried")
    )
    inside = Window.partitionBy(key, "_slot").orderBy(*order)
    previous = F.coalesce(F.lag(F.struct("status")).over(inside), F.col("_carried"))
    return (
        cut.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_slot").eqNullSafe(F.col("_at_slot")))
        .drop("_key", "_at_slot")
        .withColumn("_prev", previous)
        .filter(F.col("_prev").isNotNull() & ~F.col("_prev.status").eqNullSafe(F.col("status")))
        .withColumn("previous_status", F.col("_prev.status"))
        .drop("_slot", "_carried", "_prev")
    )


def streaming_first_seen(feed: DataFrame, keys: Sequence[str], ts: str = "ts", horizon: str = "1 day") -> DataFrame:
    """First row per key within the watermark horizon of an unbounded feed."""
    return feed.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(list(keys))
