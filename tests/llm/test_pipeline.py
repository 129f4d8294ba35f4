"""Each stage on its predecessor's rows, against brute force over the small tables."""

import pytest
import test_decontam
import test_neardup
import test_pii

import corpus_pipeline
from leadflow.llm.common import written
from leadflow.llm.packing import pack


@pytest.fixture(scope="module")
def stages(spark, tables):
    docs, out = spark.read.parquet(f"{tables}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, docs, tables), name)
        out.append((docs, made))
        docs = made
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "pii", "packing",
    ]
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality_keeps_clean_documents(spark, tables, stages):
    before, after = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    assert all(i in kept for i, q in labels.items() if q == 1)
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.05 * len(labels)


def test_near_dedup(stages):
    before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = {i for i, _, c in test_neardup.brute(rows, 5) if i == c}
    assert {r.doc_id for r in after.collect()} == want and after.count() == len(want)


def test_decontamination(spark, tables, stages):
    before, after = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    found = test_decontam.brute([(r.doc_id, r.text) for r in before.collect()], items, 10)
    assert {r.doc_id for r in after.collect()} == {i for i, _, hit, _ in found if not hit}


def test_pii_masked(stages):
    before, after = stages[3]
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.n_chars == len(r.text) and (r.text == texts[r.doc_id] or test_pii.base(texts[r.doc_id]))
        assert not test_pii.base(r.text) or r.text != texts[r.doc_id]
    assert after.count() == before.count()


def test_packing(stages, tokenizer):
    before, after = stages[4]
    want = {(r.doc_id, r.start): r.ids for r in pack(before, tokenizer("word_bpe_49k.json")).collect()}
    assert {(r.doc_id, r.start): r.ids for r in after.collect()} == want
    assert {k[0] for k in want} == {r.doc_id for r in before.collect()}


def test_run(spark, tables, stages):
    got = corpus_pipeline.run(spark, tables)
    assert got.columns == stages[-1][1].columns and got.count() == stages[-1][1].count()
