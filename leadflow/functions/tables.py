"""Small table helpers: first-wins, capped groups, dense numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions.workspace import workspace


Key = str | Sequence[str]


def key_columns(key: Key) -> list[str]:
    """The columns that tell a row, ``row_index`` or for instance (``job_id``, ``row_index``); none may be null."""
    cols = [key] if isinstance(key, str) else list(key)
    if "row_index" not in cols:
        raise ValueError("a key needs row_index, the number of a row in its job")
    return cols


def job_columns(key: Key) -> list[str]:
    """The key without the row number; rows with equal values are one job."""
    return [c for c in key_columns(key) if c != "row_index"]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Keep the first row of each key by a declared order.

    ``min_by`` combines on the map side, so a key that holds a large share of the rows sends one
    row per input partition over the shuffle.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = [c for c in df.columns if c not in keys]
    ordering = order[0] if len(order) == 1 else F.struct(*order)
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordering).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def cap_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, cap: int | None) -> DataFrame:
    """First ``cap`` rows of each key, all for None. Spark prunes to ``cap`` per partition before the shuffle."""
    if cap is None:
        return df
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= cap).drop("_rank")


def look_up(rows: DataFrame, answers: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join rows to answers that have one row per key, so that a hot key (or null) is split over tasks.

    Adaptive execution only splits a skewed side when both sides come straight from a shuffle. Answers
    that were just grouped by the key would be joined in place; the hash as a second join column makes
    Spark shuffle them once more, which is cheap next to the rows.
    """
    keys = [on] if isinstance(on, str) else list(on)
    guarded = [df.withColumn("_guard", F.xxhash64(*keys)) for df in (rows, answers)]
    return guarded[0].join(guarded[1], [*keys, "_guard"], how).drop("_guard")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over as many tasks as the session has for a shuffle.

    For work that is heavy next to its bytes: adaptive execution puts small partitions together by their bytes alone.
    The hash of the keys is no key itself, so rows that already lie by the keys are spread as well.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, F.xxhash64(*keys))


def dense_index(df: DataFrame, ordinal: str, name: str, tasks: int | None = None) -> DataFrame:
    """Number rows 0, 1, 2 ... by a unique ``ordinal`` without a one-task window.

    Rows are sorted into ranges, wherever the values lie, and stored so that counting and numbering see the same ranges. A
    row's number is its place in its range plus the rows of the ranges before. Without ``tasks`` the ranges are as many as
    the session's shuffle partitions, small ones put together by adaptive execution, so they follow the cluster's own
    settings for the size of the data. Sums over ranges go in two levels, by thousands of ranges.
    """
    ranged = (df.repartitionByRange(ordinal) if tasks is None else df.repartitionByRange(tasks, ordinal)).sortWithinPartitions(ordinal)
    path = workspace(df.sparkSession, "numbered")
    ranged.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    placed = df.sparkSession.read.parquet(path).withColumn("_range", F.shiftright("_id", 33))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_many", F.floor(F.col("_range") / 1000))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    many = sizes.groupBy("_many").agg(F.sum("_n").alias("_n")).select("_many", earlier(Window.orderBy("_many")).alias("_base"))
    inside = sizes.withColumn("_inside", earlier(Window.partitionBy("_many").orderBy("_range")))
    starts = inside.join(many, "_many").select("_range", (F.col("_base") + F.col("_inside")).alias("_start"))
    return (
        placed.join(starts, "_range")
        .withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_range", "_start", "_id")
    )
