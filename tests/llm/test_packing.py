import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadflow.llm.packing import OpenWindows, _Words, best_fit_decreasing, pack


@pytest.fixture(scope="module")
def library(tokenizer):
    return Tokenizer.from_file(tokenizer("word_bpe_49k.json"))


def test_tightest_window():
    tree = OpenWindows(10)
    for capacity, name in ((3, 1), (7, 2), (7, 3), (10, 4)):
        tree.add(capacity, name)
    assert tree.take_tightest(4)[0] == 7 and tree.take_tightest(4)[0] == 7
    assert tree.take_tightest(4) == (10, 4) and tree.take_tightest(4) is None
    assert tree.take_tightest(1) == (3, 1) and tree.take_tightest(1) is None


def test_best_fit_decreasing_fills_windows():
    lengths = [6, 4, 5, 5, 3, 7, 10, 1]
    windows = best_fit_decreasing(lengths, 10)
    assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in w) <= 10 for w in windows) and len(windows) == 5


def test_word_ids_are_those_of_the_whole_text(library, tokenizer):
    words = _Words(tokenizer("word_bpe_49k.json"))
    for text in [
        "ΣΑΣ Σ σς ΟΔΟΣ. İi DŽ straße ﬁ", "a'sb it's' don't'", "<|endoftext|> x<|startoftext|>y", "é́ é ́a Å K", "",
        "a\x1cb\x85c\xa0d　e ​ f﻿", "漢字한국어 각 가", "1234 a1b2 ½ ²x٣", "ªº ᵃ ｆｕｌｌ", "_x_ a_b.", "ǅ ß ẞ ŉ", "Word, word! WORD...",
    ]:
        assert words.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def check(pieces, docs, library, window, padding):
    """Every id once and in order; sequences without gaps; padding small."""
    want = defaultdict(list)
    for r in docs:
        want[r.doc_id].append(library.encode(r.text or "", add_special_tokens=False).ids + [2])
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length
    assert by_doc.keys() == want.keys()
    for name, ids in want.items():
        if len(ids) > 1:
            assert sum(p.length for p in by_doc[name]) == sum(map(len, ids))
            continue
        at = 0
        for p in sorted(by_doc[name], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[0])
            assert np.frombuffer(p.ids, "<u4").tolist() == ids[0][at : at + p.length]
            at += p.length
        assert at == len(ids[0])
    for members in sequences.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and (window - at <= padding or at & (at - 1) == 0)


@pytest.mark.parametrize("buffer", [200, 1_000_000])
def test_odd_rows(odd, library, tokenizer, buffer):
    pieces = pack(odd, tokenizer("word_bpe_49k.json"), window=64, max_padding=2, buffer_tokens=buffer).collect()
    check(pieces, odd.collect(), library, 64, 2)


def test_empty_table(make, tokenizer):
    assert pack(make([]), tokenizer("word_bpe_49k.json")).collect() == []


def test_query(spark, tables, library, tokenizer):
    from leadflow.llm.queries import QUERIES

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    pieces = pack(docs, tokenizer("word_bpe_49k.json")).collect()
    check(pieces, docs.collect(), library, 4096, 32)
    got = {(r.doc_id, r.start): r.ids_crc32 for r in QUERIES["op9_packing"](spark, tables).collect()}
    assert got == {(p.doc_id, p.start): zlib.crc32(p.ids) for p in pieces}


def test_very_long_text_streams(make, library, tokenizer, monkeypatch):
    from leadflow.llm import packing

    monkeypatch.setattr(packing, "_SLICE_CHARS", 1000)
    docs = make(["some words to pack " * 400, "b" * 3000])
    check(pack(docs, tokenizer("word_bpe_49k.json"), window=128).collect(), docs.collect(), library, 128, 32)
    assert docs.select(F.max("n_chars")).first()[0] > 1000


def test_words_are_cut_at_signs_as_the_library_cuts_them(library, tokenizer):
    texts = [
        "x<|endoftext|>y <|EndOfText|> <|ENDOFTEXT|>", "The the THE. the, the's THE'S 'tis''s x'really", "H\u0331 h\u0331 I\u0307. a\u0301b",
        "\u0958| \u0958, \u0958", "\u03a3\uac00\u0130'- \u03a3\u03b1\u03a3. \u0130. \u0130", "a1b2,c", "\u00e4. \u2014. \u2014,x", "", " ", "a\x1cb.\x1c c",
    ]
    words = _Words(tokenizer("word_bpe_49k.json"))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for some in (texts, texts[1:], texts[1:2], [""]):  # with and without special strings
        got = words.ids_of_column(pa.array(some, pa.string()))
        assert [ids.tolist() for ids in got] == [want[texts.index(t)] for t in some]
    assert [words.ids(t).tolist() for t in texts] == want


def test_letters_are_looked_up_without_case_and_signs(tokenizer):
    """What the time depends on: one word for a run of letters however it is written."""
    words = _Words(tokenizer("word_bpe_49k.json"))
    list(words.ids_of_column(pa.array(["Word word, WORD. (word) word's", "wOrd!"])))
    assert [w for w in words.words.young if "word" in w.lower()] == ["word", "(word"]


def test_small_caches_give_the_same_ids(library, tokenizer, monkeypatch):
    from leadflow.llm import packing

    monkeypatch.setattr(packing, "_CACHED_WORDS", 3)
    monkeypatch.setattr(packing, "_CACHED_STEMS", 2)
    words = _Words(tokenizer("word_bpe_49k.json"))
    for i in range(12):
        texts = [f"{chr(97 + i)}alpha b\u00eat{chr(97 + i // 2)}. b\u00eat{chr(97 + i // 2)}! gamma", "delta gamma, \u00fcber."]
        got = [ids.tolist() for ids in words.ids_of_column(pa.array(texts))]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(words.words.young) < 12


def test_caches_are_bounded_by_characters_too(library, tokenizer, monkeypatch):
    from leadflow.llm import packing

    monkeypatch.setattr(packing, "_CACHED_WORDS", 100)
    words = _Words(tokenizer("word_bpe_49k.json"))
    for i in range(20):
        text = chr(97 + i) * 2000
        assert words.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(map(len, words.words.young)) <= 5200 and sum(map(len, words.words.old)) <= 5200


@pytest.mark.parametrize("size", [60, 1_000_000])
def test_slices_give_the_same_pieces(odd, library, tokenizer, monkeypatch, size):
    from leadflow.llm import packing

    monkeypatch.setattr(packing, "_SLICE_BYTES", size)
    check(pack(odd, tokenizer("word_bpe_49k.json"), window=64, max_padding=2).collect(), odd.collect(), library, 64, 2)
