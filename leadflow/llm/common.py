"""Helpers of the corpus operators: per-process caches, written steps, row slices of Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.functions.workspace import workspace


_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def process_cache(step: str) -> dict:
    """A dict that lives as long as the Python worker works at ``step``, so models load once and not once a task.

    Workers go on from one step's tasks to another's: what the last step left here is given up, or it would take
    memory beside all later steps.
    """
    worker = sys.modules.setdefault("_leadflow_process_cache", ModuleType("_leadflow_process_cache"))
    left, held = getattr(worker, "held", (step, {}))
    if left != step:
        held.clear()
        gc.collect()  # models may hold themselves
        give_back()
    worker.held = (step, held)
    return held


def give_back() -> None:
    """Freed memory goes to the system, at the end of a task: the allocators would keep most of it for this worker."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: later steps neither repeat the work nor lose it with an executor."""
    path = workspace(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches to and from Python of at most 8 MB, unless the session has a limit of its own.

    Spark fills a batch up to 64 MB, and a task then holds it several times: as vectors, as the message and in the
    worker. The setting stays with the session, since steps run when their result is read.
    """
    if spark.conf.get(_BATCH_LIMIT, None) is None:
        spark.conf.set(_BATCH_LIMIT, "8m")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slice_bounds(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, done = 0, 0
    while start < len(column):
        end = min(len(column), max(start + 1, int(np.searchsorted(ends, done + size))))
        yield start, end
        start, done = end, int(ends[end - 1])


def text_slices(column: pa.Array, size: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """The same ranges with their texts: only a range is turned into strings."""
    for start, end in slice_bounds(column, size):
        yield start, end, column.slice(start, end - start).to_pylist()
