import random

import pytest
import sentencepiece
from check import plain

from leadflow.llm.tokens import count_tokens

random.seed(1)
HARD = [
    "a" * 5000, "ab" * 4000, "x y " * 2000, " " * 5000, "漢字" * 3000, "\U0001f600" * 3000, "aaab" * 999 + "\n\n" * 700, "1" * 4444,
    "".join(random.choice("abcdefé 漢字\U0001f600▁ ") for _ in range(6000)), "".join(random.choice("ab") for _ in range(5000)),
    "<s> </s> <unk> " * 300, "short", "",
]


@pytest.fixture(scope="module")
def model(tokenizer):
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))


@pytest.mark.parametrize(("chunk", "overlap"), [(300, 8), (1000, 64), (100_000, 256)])
def test_spliced_counts_are_those_of_the_library(make, model, tokenizer, chunk, overlap):
    got = count_tokens(make(HARD), tokenizer("piece_bpe_32k.model"), chunk_chars=chunk, overlap=overlap).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(model.encode(t)) for i, t in enumerate(HARD)}


def test_odd_rows(odd, model, tokenizer):
    got = count_tokens(odd, tokenizer("piece_bpe_32k.model"), keep=("doc_id", "lang"), chunk_chars=1000, overlap=32)
    want = [(r.doc_id, r.lang, len(model.encode(r.text or ""))) for r in odd.collect()]
    assert sorted(map(plain, map(tuple, got.collect())), key=repr) == sorted(want, key=repr)


def test_empty_table(make, tokenizer):
    assert count_tokens(make([]), tokenizer("piece_bpe_32k.model")).collect() == []


def test_query(spark, tables, model):
    from leadflow.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op4_token_counts"](spark, tables).collect()}
    for r in spark.read.parquet(f"{tables}/documents.parquet").collect():
        n = len(model.encode(r.text or ""))
        assert tuple(got[r.doc_id]) == (r.doc_id, len((r.text or "").encode()), n, n > 4096)
