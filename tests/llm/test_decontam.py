import hashlib
import re

import pytest

from leadflow.llm.decontam import drop_contaminated, find_passages

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def brute(docs, items, window):
    wins = {}
    for name, text in items:
        w = WORD.findall(lower(text))
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[a : a + n]), set()).update([] if name is None else [str(name)])
    out = []
    for name, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in {len(k) for k in wins}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in wins:
                    hit.update(range(a, a + n))
                    found |= wins[tuple(w[a : a + n])]
        out.append((name, len(w), len(hit), sorted(found)))
    return out


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "one Two, three four five six"), (2, "Two-three four"), (3, ""), (4, None), (5, "漢字 É x"), (2, "zwei"), (None, "mixed")]
    return spark.createDataFrame(rows, "item_id long, text string")


TEXTS = ["zero one TWO three; four five six seven", "two three four two three four", "é 漢字 É x 漢字 É x", "zwei", "ZWEI! drei zweizwei", "nothing"]


@pytest.mark.parametrize("automaton_bytes", [64 << 20, 2000])
def test_against_brute_force(make, odd, benchmark, automaton_bytes):
    docs = make(TEXTS).unionByName(odd)
    found = find_passages(docs, benchmark, window=3, max_automaton_bytes=automaton_bytes).collect()
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    want = brute([(r.doc_id, r.text) for r in docs.collect()], items, 3)
    got = [(r.doc_id, r.passages.n_words, r.passages.n_hit, r.passages["items"]) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for r in found:
        # the words inside the spans of the original are the hit words
        inside = [w for a, b in r.passages.spans for w in WORD.findall(lower(r.text[a:b]))]
        assert len(inside) == r.passages.n_hit
    assert set(found[0].asDict()) == {*docs.columns, "passages"}


def test_clashing_column_and_drop(make, benchmark):
    docs = make(TEXTS).withColumnRenamed("lang", "passages")
    assert find_passages(docs, benchmark, window=3).columns.count("passages") == 1
    kept = drop_contaminated(make(TEXTS), benchmark, window=3)
    assert [r.text for r in kept.collect()] == ["nothing"] and kept.columns == make([]).columns


def test_an_item_without_an_id_hits_but_has_no_name(spark, make):
    bench = spark.createDataFrame([(None, "alpha beta gamma"), (7, "gamma delta")], "item_id long, text string")
    docs = make(["x Alpha, beta gamma delta", "clean"])
    found = {r.doc_id: r.passages for r in find_passages(docs, bench, window=3).collect()}
    assert (found[0].n_hit, found[0]["items"]) == (4, ["7"]) and found[1].n_hit == 0
    assert [r.doc_id for r in drop_contaminated(docs, bench.filter("item_id IS NULL"), window=3).collect()] == [1]


def test_empty_tables(make, benchmark):
    assert find_passages(make([]), benchmark).collect() == []
    none = find_passages(make(TEXTS), benchmark.limit(0)).collect()
    assert [r.passages.n_hit for r in none] == [0] * len(TEXTS)


def test_query(spark, tables):
    from leadflow.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    want = {
        d: (n, h, len(i), hashlib.sha256(",".join(sorted(i)).encode()).hexdigest(), h > 0) for d, n, h, i in brute(docs, items, 10)
    }
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op5_decontaminate"](spark, tables).collect()}
    assert got == want and any(v[-1] for v in got.values())
