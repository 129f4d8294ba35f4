"""The chain of streams: overlap of phases, restarts, failures."""

import glob
import os
import threading

import pytest
from pyspark.sql import functions as F

from leadflow.streaming.phases import phase_rows, phase_stream


@pytest.fixture
def arriving(spark, tmp_path):
    """Rows 0 to 59 in six files, one file a batch."""
    path = f"{tmp_path}/in"
    for i in range(6):
        spark.range(10 * i, 10 * i + 10, 1, 1).withColumnRenamed("id", "row_index").write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_early_phases_run_ahead_of_late_ones(spark, arriving, tmp_path):
    log, ahead = [], threading.Event()

    def first(rows):
        found = rows.agg(F.max("row_index")).first()[0]
        log.append(("a", found))
        if found == 59:
            ahead.set()
        return rows.withColumn("a", F.lit(1))

    def last(rows):
        found = rows.agg(F.min("row_index")).first()[0]
        if found is not None:
            assert ahead.wait(120)  # the first rows wait here until the first phase has taken the last ones
            log.append(("c", found))
        return rows.withColumn("c", F.col("a") + F.col("b"))

    phases = [("a", first), ("b", lambda rows: rows.withColumn("b", F.lit(2))), ("c", last)]
    run = phase_stream(arriving(), phases, f"{tmp_path}/run")
    run.drain()
    taken = [x for x in log if x[1] is not None]
    assert taken.index(("a", 59)) < taken.index(("c", 0))
    got = sorted((r.row_index, r.c) for r in phase_rows(spark, f"{tmp_path}/run", "c").collect())
    assert got == [(i, 3) for i in range(60)] and all(not q.isActive for q in run.queries)


def test_rows_that_must_stay_together_do(spark, arriving, tmp_path):
    sizes = []

    def second(rows):
        sizes.extend(r["count"] for r in rows.groupBy(F.floor(F.col("row_index") / 10)).count().collect())
        return rows

    phase_stream(
        arriving(), [("a", lambda rows: rows.repartition(7)), ("b", second)], f"{tmp_path}/run",
        together=F.floor(F.col("row_index") / 10), files_per_batch=1,
    ).drain()
    assert sizes == [10] * 6


def test_a_failed_phase_ends_the_run_and_a_restart_loses_nothing(spark, arriving, tmp_path):
    folder, broken = f"{tmp_path}/run", [True]

    def second(rows):
        if broken[0] and rows.filter("row_index = 25").count():
            raise RuntimeError("a lost machine")
        return rows.withColumn("b", F.col("row_index") + 1)

    phases = [("a", lambda rows: rows), ("b", second), ("c", lambda rows: rows)]
    run = phase_stream(arriving(), phases, folder, files_per_batch=1)
    with pytest.raises(Exception, match="a lost machine"):
        run.drain()
    assert all(not q.isActive for q in run.queries)
    assert phase_rows(spark, folder, "c").count() < 60
    broken[0] = False
    phase_stream(arriving(), phases, folder, files_per_batch=1).drain()
    assert sorted((r.row_index, r.b) for r in phase_rows(spark, folder, "c").collect()) == [(i, i + 1) for i in range(60)]


def test_a_batch_written_twice_counts_once(spark, arriving, tmp_path):
    folder = f"{tmp_path}/run"
    phases = [("a", lambda rows: rows.withColumn("a", F.lit(1))), ("b", lambda rows: rows.withColumn("n", F.lit(1)))]
    phase_stream(arriving(), phases, folder).drain()
    # the first phase dies between writing its last batch and noting it
    last = max(glob.glob(f"{folder}/_checkpoints/a/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    for path in (last, os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")):
        if os.path.exists(path):
            os.remove(path)
    phase_stream(arriving(), phases, folder).drain()
    assert spark.read.parquet(f"{folder}/a").count() == 70
    assert spark.read.parquet(f"{folder}/b").count() == 60
    assert phase_rows(spark, folder, "a").count() == 60


def test_an_empty_source(spark, tmp_path):
    spark.createDataFrame([], "row_index long").write.parquet(f"{tmp_path}/none")
    feed = spark.readStream.schema("row_index long").parquet(f"{tmp_path}/none")
    phase_stream(feed, [("a", lambda r: r), ("b", lambda r: r)], f"{tmp_path}/run").drain()
    assert phase_rows(spark, f"{tmp_path}/run", "b").collect() == []
