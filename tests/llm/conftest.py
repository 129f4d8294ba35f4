import public_tokenizers
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tables():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tokenizer():
    return public_tokenizers.path


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, ids counted from 0, with a null text, a row without id and a repeated row."""

    def made(texts, extra=()):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame([*rows, *extra], DOCS)

    return made


@pytest.fixture(scope="session")
def odd(make):
    """Null and empty texts, no id, equal rows, one very long word, many short ones."""
    repeated = (900, "same row twice, word for word", "en", "s", 29)
    return make(
        ["", " ", "one", "Two words", "a" * 30_000, "x y " * 8_000, "é 漢字 \U0001f600 mixed"],
        [(901, None, None, None, None), (None, "no id here at all", "en", "s", 3), (None, None, None, None, None), repeated, repeated],
    )


def count(df):
    return df.agg(F.count(F.lit(1))).first()[0]
