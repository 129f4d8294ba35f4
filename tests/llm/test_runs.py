"""Runs against brute force over every period and place."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadflow.llm.queries import QUERIES
from leadflow.llm.runs import CommonExtensions, _numbered, find_runs, runs_of


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(words, least=24, repeats=3):
    """(start, length, period) of the maximal stretches of every period, the smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([1, 6, 24]))
def test_runs_against_brute_force(seed, least):
    draw = random.Random(seed)
    texts = []
    for _ in range(draw.randint(1, 5)):
        n, kinds = draw.choice([0, 1, 5, 40, 150]), draw.choice([1, 2, 3, 5])
        words = [b"%d" % draw.randrange(kinds) for _ in range(n)]
        if n and draw.random() < 0.7:
            a = draw.randrange(n)
            p = 1 + (n - a) // draw.randint(3, 10)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        texts += [words] * draw.randint(1, 2)
    symbols, starts, sizes = _numbered(texts)
    got = runs_of(symbols, starts, sizes, least_words=least, repeats=3)
    want = [(s + b, s + b + n, q) for b, t in zip(starts, texts, strict=True) for s, n, q in brute(t, least)]
    assert sorted(map(tuple, got.tolist())) == sorted(want)


def test_common_extensions():
    draw = random.Random(3)
    for symbols in ([draw.randrange(2) for _ in range(90)], [0] * 70, [0, 1] * 40, [5]):
        at = CommonExtensions(np_array([*symbols, 9]))
        pairs = [(i, j) for i in range(len(symbols)) for j in range(i + 1, len(symbols))]
        if not pairs:
            continue
        left, right = (np_array(p) for p in zip(*pairs, strict=True))
        for i, j, n in zip(left, right, at.of(left, right), strict=True):
            want = 0
            while j + want < len(symbols) and symbols[i + want] == symbols[j + want]:
                want += 1
            assert n == want


def np_array(values):
    import numpy as np

    return np.array(values, np.int64)


def test_whole_texts_and_odd_rows(spark, make, odd):
    found = {(r.doc_id, r.text): r.periodic for r in find_runs(odd.withColumnRenamed("lang", "periodic")).collect()}
    assert len(found) == odd.dropDuplicates(["doc_id", "text"]).count()
    for (_, text), got in found.items():
        words = words_of(text)
        want = [(0, 16_000, 2)] if (text or "").startswith("x y") else brute(words)
        assert got.n_words == len(words) and [tuple(r) for r in got.runs] == want
        assert got.collapsed == collapsed(words, want)
    assert find_runs(make([])).collect() == [] and find_runs(odd).count() == odd.count()
    with pytest.raises(ValueError, match="three periods"):
        list(runs_of(np_array([0]), np_array([0]), np_array([0]), least_words=1, repeats=2))


def test_words_are_told_byte_by_byte(spark, make):
    # blanks beyond ASCII belong to words; case counts
    text = "a b\x1cc " * 30 + "A a " * 3
    got = find_runs(make([text])).first().periodic
    assert got.n_words == 36 and [tuple(r) for r in got.runs] == [(0, 30, 1)]
    assert got.collapsed == "a b\x1cc A a A a A a"


def expected(doc_id, text):
    """The query's digest columns by the contract's words."""
    words = words_of(text)
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words) if n < 1500 else None
    if runs is None:
        return None
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (
        len(runs), *(best or (None, None, None)), None if best is None else 1000 * best[1] // best[2],
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest(),
    )


def test_query(spark, tables):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    rows = QUERIES["op13_periodic_runs"](spark, tables).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    checked = planted = 0
    for r in rows:
        want = expected(r.doc_id, texts[r.doc_id])
        if want is not None:
            got = (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
            assert got == want
            checked, planted = checked + 1, planted + (r.n_runs > 0)
    assert checked > 150 and planted > 5


def test_query_odd_rows(spark, make, odd, tmp_path):
    extra = make([], [(7, "a b c " * 20, "en", "s", 1), (7, "a b c " * 20, "en", "s", 1), (None, None, None, None, None)])
    odd.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    assert len(rows) == odd.count() + 3
    for r in rows:
        if r.n_words == 0:
            assert (r.n_runs, r.start, r.exponent_milli) == (0, None, None)
            assert r.runs_sha256 == r.collapsed_sha256 == hashlib.sha256(b"").hexdigest()
