import math

import numpy as np
import pytest
from check import compare, connection
from pyspark.sql import functions as F

from leadflow.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints.setdefault(i, []).append([math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for q in queries:
        for mine in ints.get(q, []):
            scored = [(-sum(a * b for a, b in zip(mine, v)), i) for i, vs in ints.items() if i != q for v in vs]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize(("lists", "tile", "block"), [(1, 7, 3), (4, 50, 5), (3, 4096, 1024)])
def test_against_brute_force(spark, lists, tile, block):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.normal(size=8)]) for i in range(150)]
    rows += [(200 + i, [1.0] * 8) for i in range(30)]  # one vector many times: ties
    rows += [(300, [-3.0] * 8), (301, [0.0] * 8), (302, []), (303, [2.0, -1.0]), (304, None), (305, [1.0, None]), (306, [float("nan")] * 8)]
    rows += [(307, [float("inf")] * 8), (None, [1.0] * 8), (10, [0.5] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    queries = [0, 50, 100, 200, 300, 301, 302, 303, 304, 305]
    got = top_k(df, df.filter(F.col("vec_id").isin(queries)), 5, lists=lists, tile_rows=tile, query_rows=block)
    assert rows_of(got) == brute(rows, queries, 5)


def test_few_candidates_and_huge_components(spark):
    rows = [(0, [3e38, 1.0]), (1, [3e38, 2.0]), (2, [1e9, 3e9])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = rows_of(top_k(df, df, 5))
    assert [(q, n) for q, n, _, _ in got] == [(q, n) for q in range(3) for n in (1, 2)]
    assert got[0][2:] == (1, 2**63 - 1)  # clipped
    one = df.limit(1)
    assert top_k(one, one).collect() == []


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert top_k(none, none).collect() == []


def test_query_against_sql(spark, tables):
    from leadflow.llm.queries import ORACLES, QUERIES

    name = "op3_exact_top_k"
    ok, note, _ = compare(spark, connection(tables), name, QUERIES[name], ORACLES[name], tables)
    assert ok, note
