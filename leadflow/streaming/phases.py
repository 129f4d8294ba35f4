"""Phases as a chain of streams: each is a query of its own that reads the table before it as a stream.

An early phase goes on with later rows while a later phase still works on earlier ones. Every phase has its own
checkpoint and appends its rows to its own table, so a lost executor or a restart repeats at most one batch of one phase.
A batch that is written again has the same rows under the same number; the next phase passes over keys that it has
seen within the last batches. The event time of that watermark is the number of the batch that wrote a row, so it
neither follows a clock nor drops rows of a backlog, and the state of a phase is bounded by some batches' keys.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Phase = tuple[str, Callable[[DataFrame], DataFrame]]
_BATCH = "_batch_time"


class PhaseRun:
    """The running queries of a chain, in the order of its phases."""

    def __init__(self):
        self.queries: list[StreamingQuery] = []
        self._lock, self._failed = threading.Lock(), False

    def fail(self) -> None:
        """Called by a phase that fails: ends the others. A second failure meanwhile ends by itself."""
        with self._lock:
            if self._failed:
                return
            self._failed = True
        current = threading.current_thread()
        threading.Thread(target=self.stop, name=f"{current.name}-stop", daemon=True).start()

    def raise_failure(self) -> None:
        for query in self.queries:
            if query.exception() is not None:
                self.stop()
                raise query.exception()

    def drain(self) -> None:
        """Wait until all rows that are there have gone through every phase, then end. A failed phase raises."""
        try:
            for query in self.queries:  # a phase is through once the one before it is, and then itself
                query.processAllAvailable()
                self.raise_failure()
            if self._failed:
                for query in self.queries:
                    query.awaitTermination()
        finally:
            self.stop()
        self.raise_failure()

    def stop(self) -> None:
        for query in self.queries:
            query.stop()


def _table_stream(spark: SparkSession, path: str, schema, files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def _start(
    run: PhaseRun, feed: DataFrame, name: str, step: Callable[[DataFrame], DataFrame], folder: str, together: Column | None, trigger: str
) -> StreamingQuery:
    def take(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # a step may read its rows several times
        try:
            if batch.isEmpty():
                return
            # watermarks begin at 0, and what is not behind them counts as late
            done = step(batch).withColumn(_BATCH, F.timestamp_seconds(F.lit(batch_id + 1)))
            done = done if together is None else done.repartition(together)
            done.write.mode("append").parquet(f"{folder}/{name}")
        except BaseException:
            run.fail()
            raise
        finally:
            batch.unpersist()

    writer = feed.writeStream.queryName(f"{name}-{folder.rsplit('/', 1)[-1]}").foreachBatch(take)
    return writer.option("checkpointLocation", f"{folder}/_checkpoints/{name}").trigger(processingTime=trigger).start()


def phase_stream(
    rows: DataFrame, phases: Sequence[Phase], folder: str, *, key: Sequence[str] = ("row_index",), together: Column | None = None,
    horizon: int = 100, files_per_batch: int | None = None, trigger: str = "0 seconds",
) -> PhaseRun:
    """Start the phases (name, step) over a stream of rows, each as a query; ``folder/<name>`` are their tables.

    A step takes a batch of rows as a table and returns rows that still have the columns ``key``, which tell a row and
    are never null; it may use joins, windows and aggregates. Rows with equal values of ``together`` are written into
    one file, so that they come into one batch of the next phase if they did into this one. A key that comes again
    within ``horizon`` batches is a repeated write and passed over from the second phase on. ``files_per_batch`` bounds
    the batches of the later phases, the source's own options those of the first.

    A phase that fails ends all of them. Started again with the same folder, every phase goes on where it was.
    """
    spark, run, feed = rows.sparkSession, PhaseRun(), rows
    try:
        for name, step in phases:
            given = spark.createDataFrame([], feed.schema)
            if run.queries:
                feed = feed.withWatermark(_BATCH, f"{horizon} seconds").dropDuplicatesWithinWatermark(list(key)).drop(_BATCH)
                given = given.drop(_BATCH)
            made = step(given).withColumn(_BATCH, F.lit(None).cast("timestamp"))
            path = f"{folder}/{name}"
            spark.createDataFrame([], made.schema).write.mode("append").parquet(path)  # a stream reads what exists
            run.queries.append(_start(run, feed, name, step, folder, together, trigger))
            feed = _table_stream(spark, path, made.schema, files_per_batch)
    except BaseException:
        run.stop()
        raise
    return run


def phase_rows(spark: SparkSession, folder: str, name: str, key: Sequence[str] = ("row_index",)) -> DataFrame:
    """The table of a phase, a row for each key: batches that were written again count once."""
    return spark.read.parquet(f"{folder}/{name}").drop(_BATCH).dropDuplicates(list(key))
