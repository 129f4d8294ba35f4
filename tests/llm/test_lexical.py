"""Ranked search against scores computed document by document."""

import math
import random
import re
from collections import Counter

import pytest

from leadflow.llm.lexical import build_index, search, terms
from leadflow.llm.queries import QUERIES

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items, k):
    """Sorted (item, rank, doc, score); null ids last among equal scores."""
    held = [(i, Counter(words_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            n = sum(c.values())
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = 0
            for t in words_of(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i, score))
        scored.sort(key=lambda s: (s[0], s[1], s[2] if s[2] is not None else 0))
        out += [(item, r, i, score) for r, (_, _, i, score) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k, **index):
    rows, counts = search(spark, build_index(docs, **index), items, k=k, id_col="item_id")
    return sorted((tuple(r) for r in rows.collect()), key=repr), counts.first()


def test_terms_are_those_of_the_pattern():
    for text in ("Zwölf Größen, a_b-c 1.5e3 É x y \x85 ﻿z", "", None, "AbC\x7f[d]", "漢字 ﬁ İ"):
        assert [t.decode() for t in terms(text)] == words_of(text)


@pytest.mark.parametrize(("seed", "segment", "k"), [(1, 5, 3), (2, 64, 20), (3, 17, 1)])
def test_against_brute_force(spark, make, seed, segment, k):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    # many equal texts: equal scores go by the id
    texts = [" ".join(draw.choices(vocabulary, weights, k=draw.choice([0, 1, 3, 8, 30]))) for _ in range(180)]
    texts += draw.choices(texts, k=60)
    docs = make(texts)
    items = [(f"q{i}", " ".join(draw.choices(vocabulary, k=draw.choice([1, 2, 5, 9])))) for i in range(12)]
    items += [("rep", "w1 w1 w7 w1 W7"), ("none", "absent words"), ("blank", ""), (None, "w3 w4"), ("null", None)]
    asked = spark.createDataFrame(items, "item_id string, text string")
    got, counts = found(spark, docs, asked, k, segment_docs=segment)
    assert got == brute(list(enumerate(texts)), items, k)
    assert counts.segments >= 13 and (segment > 5 or counts.skipped > 0)


def test_blocks_of_queries_and_text_ids(spark):
    draw = random.Random(9)
    docs = [(f"d{i:03}", " ".join(draw.choices("abcdefgh", k=draw.randint(1, 12)))) for i in range(120)]
    items = [(i, " ".join(draw.choices("abcdefgh", k=4))) for i in range(9)]
    index = build_index(spark.createDataFrame(docs, "name string, body string"), id_col="name", text_col="body", segment_docs=16)
    asked = spark.createDataFrame(items, "item_id int, text string")
    for block_terms in (3, 20_000):
        rows, _ = search(spark, index, asked, k=4, block_terms=block_terms)
        assert sorted((tuple(r) for r in rows.collect()), key=repr) == brute(docs, items, 4)


def test_odd_rows(spark, odd):
    items = [("a", "same row twice"), ("b", "y X"), ("c", "é 漢字 no"), ("d", "id")]
    asked = spark.createDataFrame([(*i, "clash", 1) for i in items], "item_id string, text string, score string, rank int")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got, _ = found(spark, odd.withColumnRenamed("lang", "score"), asked, 5, segment_docs=2)
    assert got == brute(docs, items, 5)


def test_empty_tables(spark, make):
    asked = spark.createDataFrame([("a", "x")], "item_id string, text string")
    for docs, items in ((make([]), asked), (make(["", "--", None]), asked), (make(["x"]), asked.limit(0)), (make(["x"]), asked.filter("text = ''"))):
        rows, counts = search(spark, build_index(docs), items, k=3)
        assert rows.columns == ["query_id", "rank", "id", "score"] and rows.collect() == []
        assert tuple(counts.first()) == (0, 0)


def test_a_pair_that_never_meets_is_skipped_by_its_joint_bound(spark, make):
    # two rare words, each with a high impact, never in one text, but for a segment that has both together
    texts = ["alpha filler"] * 8 + ["beta filler"] * 8 + ["alpha beta"] * 4 + ["filler words"] * 200
    items = [("q", "alpha beta")]
    docs = make(texts).coalesce(1)
    got, counts = found(spark, docs, spark.createDataFrame(items, "item_id string, text string"), 4, segment_docs=4)
    assert got == brute(list(enumerate(texts)), items, 4)
    alone = (8 + 8) // 4  # these segments hold one of the two words, none can reach both
    assert counts.skipped >= alone


def test_query(spark, tables):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_lexical_search"](spark, tables).collect()), key=repr)
    assert got == brute(docs, items, 20)
