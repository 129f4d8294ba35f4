"""Exact round trips of id files against the tokenizer library."""

import glob
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadflow.llm.idfiles import MARK, blocks_of, fetch_ids, index_of, read_ids, train_dictionary, write_ids
from leadflow.llm.packing import _words
from leadflow.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library(tokenizer):
    words = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    return lambda text: [*words.encode(text or "", add_special_tokens=False).ids, 2]


def ids(row):
    return np.frombuffer(row.ids, "<u4").tolist()


def by_place(rows):
    rows = sorted(rows, key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    return rows


def test_round_trip_of_odd_rows(spark, odd, tokenizer, library):
    folder = write_ids(odd.withColumnRenamed("lang", "ids"), tokenizer("word_bpe_49k.json"), block_docs=3, file_bytes=2000)
    rows = by_place(read_ids(spark, folder).collect())
    assert sorted(ids(r) for r in rows) == sorted(library(r.text) for r in odd.collect())
    names = [r.id for r in rows]
    assert names == sorted(names, key=lambda i: (i is not None, i or 0))
    texts = {r.doc_id: r.text for r in odd.filter("doc_id IS NOT NULL").collect()}
    assert all(ids(r) == library(texts[r.id]) for r in rows if r.id is not None)


def test_text_ids_and_wide_ids(spark, tokenizer, library):
    docs = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, None), ("é", "drei")], "name string, text string")
    folder = write_ids(docs, tokenizer("word_bpe_49k.json"), id_col="name", end_id=70_000)
    rows = by_place(read_ids(spark, folder).collect())
    assert [r.id for r in rows] == [None, "a", "b", "é"] and all(ids(r)[-1] == 70_000 for r in rows)
    assert ids(rows[2])[:-1] == library("two words")[:-1]


def test_empty_table(spark, make, tokenizer):
    folder = write_ids(make([]), tokenizer("word_bpe_49k.json"))
    assert read_ids(spark, folder).collect() == [] and index_of(spark, folder).collect() == []
    assert fetch_ids(spark, folder, make(["x"])).collect() == []


def test_one_document_by_its_entry(spark, tables, tokenizer, library):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    folder = write_ids(docs, tokenizer("word_bpe_49k.json"), block_docs=16)
    every = {r.id: r for r in read_ids(spark, folder).collect()}
    wanted = spark.createDataFrame([(5,), (5,), (77,), (None,), (-3,)], "doc_id long")
    found = {r.id: r for r in fetch_ids(spark, folder, wanted).collect()}
    assert found == {i: every[i] for i in (5, 77)}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert ids(found[77]) == library(texts[77])
    # the dictionary makes short documents smaller than frames without one
    import zstandard

    entries = index_of(spark, folder).filter("n_tokens BETWEEN 5 AND 400").collect()
    alone = zstandard.ZstdCompressor(level=3)
    plain = sum(len(alone.compress(np.array(ids(every[r.id]), "<u2").tobytes())) for r in entries)
    assert sum(r.length for r in entries) < 0.9 * plain


def test_files_name_their_dictionary(spark, tables, tokenizer):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(40)
    folder = write_ids(docs, tokenizer("word_bpe_49k.json")).removeprefix("file:")
    (name,) = glob.glob(f"{folder}/*.zdict")
    for path in glob.glob(f"{folder}/*.ids"):
        with open(path, "rb") as file:
            raw = file.read()
        assert raw[:8] == raw[-8:] == MARK and raw[16:48].hex() == name.rsplit("/", 1)[1].removesuffix(".zdict")
    listed = {r.path.rsplit("/", 1)[1] for r in blocks_of(spark, folder).collect()}
    with open(f"{folder}/part-00000-0000-lost.ids", "wb") as file:  # of an attempt that was lost
        file.write(MARK)
    assert {r.path.rsplit("/", 1)[1] for r in blocks_of(spark, folder).collect()} == listed
    assert read_ids(spark, folder).count() == 40


def test_dictionary_of_few_samples():
    assert train_dictionary([]) == b"" and train_dictionary([b"ab", b"c"]) == b"abc"


def test_repeated_ids_stay_documents(spark, make, tokenizer):
    docs = make([], [(1, f"text {i % 3}", "en", "s", 6) for i in range(300)])
    rows = by_place(read_ids(spark, write_ids(docs, tokenizer("word_bpe_49k.json"))).collect())
    assert len(rows) == 300 and {r.id for r in rows} == {1}


def test_query(spark, tables, library):
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect())
    at, want = 0, []
    for i, text in texts:
        made = library(text)
        want.append((i, at, len(made), zlib.crc32(np.array(made, "<u4").tobytes())))
        at += len(made)
    assert sorted(tuple(r) for r in QUERIES["op12_id_files"](spark, tables).collect()) == want
    assert QUERIES["op12_id_files"](spark, tables).agg(F.count("ids_crc32")).first()[0] == len(want)


def test_ids_of_a_column_are_those_of_whole_texts(tokenizer):
    path = tokenizer("word_bpe_49k.json")
    words, whole = _words(path), Tokenizer.from_file(path)
    texts = ["", " ", " Two  words.\n", "a\x1cb\x1f c", "no\xa0break here \x85 x", "ΣΊΣΥΦΟΣ Σ", "\t\r\x0b\x0c", "Two words. Two", "İstanbul ﬁn %%% 12ab"]
    for column in (pa.array(texts), pa.array(["skipped", *texts]).slice(1), pa.array([], pa.string())):
        got = [ids.tolist() for ids in words.ids_of_column(column)]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in column.to_pylist()]
