"""Run registered queries against their SQL: python tests/check.py SF [name ...]."""

from __future__ import annotations

import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("leadflow-check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="leadflow-check-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=repr
    )


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no SQL", took
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    want_cols, want = rows_of(cols, res.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", took
    if got != want:
        extra = [r for r in got if r not in set(want)][:3] if len(got) < 20000 else []
        missing = [r for r in want if r not in set(got)][:3] if len(want) < 20000 else []
        return False, f"{len(got)} vs {len(want)} rows\n   got  {extra}\n   want {missing}", took
    return True, f"{len(got)} rows", took


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:]
    spark, con = session(), connection(sf_dir)
    oracle, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            ok, note, took = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            ok, note, took = False, f"{type(exc).__name__}: {str(exc)[:900]}", 0.0
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {took:.2f}s {note}", flush=True)
    print("bad:", bad)
