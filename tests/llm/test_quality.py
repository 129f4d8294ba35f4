import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from leadflow.llm.quality import features, fit, held_out, keep_good, score_quality

GOOD = ["The river ran along the old wall, and people of the town came to see it number {i}. They stayed a while."] * 40
BAD = ["BUY!! NOW!! BUY!! NOW!! CHEAP!! {i}!! BUY!! NOW!! BUY!!", "| a | {i} | b | | c | | d |"] * 20


def labelled(spark, make):
    texts = [t.format(i=i) for i, t in enumerate(GOOD + BAD)]
    labels = [(i, int(i < len(GOOD)), 0) for i in range(len(texts))] + [(None, 1, 0), (3, None, 0), (5000, 1, 0), (4, 7, 0)]
    return make(texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_votes_against_brute_force(spark, make):
    docs, labels = labelled(spark, make)
    model = fit(docs, labels, per_class=30, axes=8, neighbours=5)
    assert len(model.labels) == 60 and set(model.labels) == {0.0, 1.0}
    rows = docs.collect()
    latent = features([r.text for r in rows]) @ model.axes
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    got = {r.doc_id: r.score for r in score_quality(docs, model).collect()}
    for r, v in zip(rows, latent, strict=True):
        near = sorted(((float(v @ m), y) for m, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[:5]
        want = sum(max(s, 0) * y for s, y in near) / sum(max(s, 0) for s, _ in near)
        if near[0][1] == near[-1][1] == want:  # equal cosines at the edge may fall either way
            assert abs(got[r.doc_id] - want) < 1e-4
    assert all((got[i] >= 0.7) == (i < len(GOOD)) for i in got)


def test_odd_rows(spark, make, odd):
    docs, labels = labelled(spark, make)
    model = fit(docs, labels)
    scored = score_quality(odd.withColumnRenamed("lang", "score"), model)
    assert scored.columns.count("score") == 1 and scored.count() == odd.count()
    for r in scored.collect():
        assert 0 <= r.score <= 1 and ((r.text or "").strip() or r.score == 0)
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(GOOD)))


def test_empty_tables(spark, make):
    docs, labels = labelled(spark, make)
    assert fit(docs, labels.limit(0)) is None and fit(make([]), labels) is None
    assert [r.score for r in score_quality(docs, None).limit(2).collect()] == [1.0, 1.0]
    assert score_quality(make([]), fit(docs, labels)).collect() == []
    one = fit(docs, labels.filter("quality = 1"))
    assert {r.score for r in score_quality(docs, one).collect()} == {1.0}


def test_held_out_accuracy(spark, tables):
    from leadflow.llm.queries import QUERIES

    found = QUERIES["op10_quality"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    assert all(r.predicted == 1 for r in rows if r.quality == 1)


def test_labels_and_ids_are_no_inputs(spark, make):
    docs, labels = labelled(spark, make)
    model = fit(docs, labels)
    moved = docs.withColumns({"doc_id": F.col("doc_id") + 999, "lang": F.lit("x"), "source": F.lit("y")})
    assert [r.score for r in score_quality(docs, model).collect()] == [r.score for r in score_quality(moved, model).collect()]
    assert docs.filter(held_out()).count() == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(len(GOOD + BAD)))


def test_a_rare_label_is_not_outvoted_by_number(spark, make):
    texts = [t.format(i=i) for i, t in enumerate(GOOD[:30] + BAD[:4])]
    docs = make(texts + BAD[4:10])
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(34)], "doc_id long, quality int")
    model = fit(docs, labels)
    assert model.neighbours > 2 * (model.labels == 0).sum()
    scores = {r.doc_id: r.score for r in score_quality(docs, model).collect()}
    assert all((scores[i] >= 0.7) == (i < 30) for i in scores)


def test_workers_need_no_installation(tmp_path):
    repo = Path(__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(repo)!r})
from pyspark.sql import SparkSession
from leadflow.llm.quality import fit, score_quality
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", "w").getOrCreate()
docs = spark.createDataFrame([(i, "one two" if i % 2 else "!! ??") for i in range(8)], "doc_id long, text string")
labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
print("scores", sorted((r.doc_id, round(r.score)) for r in score_quality(docs, fit(docs, labels)).collect()))
"""
    made = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert f"scores {[(i, i % 2) for i in range(8)]}" in made.stdout, made.stderr[-2000:]
