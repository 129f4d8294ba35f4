import gc
import random
import re
import weakref
from itertools import combinations

import pytest

from leadflow.llm.neardup import Settings, connected, drop_near_duplicates, near_duplicates, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k):
    """Component of each row number; rows without an id or words stay alone."""
    sets = [shingle_set(t, k) if i is not None else frozenset() for i, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return [(i, len(shingle_set(t, k)), least[find(n)] if i is not None else None) for n, (i, t) in enumerate(rows)]


def family(draw, words, size, edits):
    """A text and copies of copies with some words changed: chains whose ends are unlike."""
    text = [draw.choice(words) for _ in range(60)]
    out = [" ".join(text)]
    for _ in range(size):
        for _ in range(edits):
            text[draw.randrange(len(text))] = draw.choice(words)
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_against_brute_force(make, odd, words):
    draw = random.Random(words)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [t for _ in range(12) for t in family(draw, vocabulary, 6, draw.choice([0, 1, 2]))]
    texts += ["A B\tC\nd", "a  b c D", "a b c", "one", "ONE", ""]
    draw.shuffle(texts)
    docs = make(texts).unionByName(odd).withColumnRenamed("source", "node")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in near_duplicates(docs, settings=Settings(words=words)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, words), key=repr)


def test_a_group_without_a_common_head(make):
    """Many texts that share half of their words, and pairs among them that are close."""
    draw = random.Random(9)
    shared = [f"s{i}" for i in range(100)]
    texts = []
    for i in range(40):
        own = [f"o{i}_{j}" for j in range(60)]
        texts.append(" ".join(shared + own))
        own[draw.randrange(60)] = "changed"
        texts.append(" ".join(shared + own))
    found = near_duplicates(make(texts)).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(i, i - i % 2) for i in range(80)}


def test_dropping_keeps_one_of_each_group(make, odd):
    texts = ["a b c d e f", "A b c d  e f", "g h i j k l m", "one"]
    docs = make(texts)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    again = drop_near_duplicates(odd).collect()
    assert sum(r.doc_id == 900 for r in again) == 1 and sum(r.doc_id is None for r in again) == 2
    assert {r.doc_id for r in again} >= {0, 1, 2, 3, 4, 5, 6, 901}


def test_an_id_with_unlike_texts(make):
    rows = [
        (0, "a b c d e f g"), (1, "h i j k l m n"), (1, "o p q r s t u"),  # both texts of 1 are their own groups
        (2, "a b c d e f g"), (2, "v w x y z"),  # one text of 2 repeats that of 0
        (3, "1 2 3 4 5 6"), (3, "1 2 3 4 5 6 "), (3, "1 2 3 4 5 6"),  # one group
        (4, ""), (4, None), (4, ""),
    ]
    docs = make([], [(i, t, "en", "s", 0) for i, t in rows])
    kept = [(r.doc_id, r.text and r.text.strip()) for r in drop_near_duplicates(docs).collect()]
    want = [rows[0], rows[1], rows[2], rows[4], rows[5], (4, ""), (4, None)]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_empty_table(make):
    assert near_duplicates(make([])).collect() == [] and drop_near_duplicates(make([])).collect() == []


def test_long_chains_fold(spark):
    links = spark.range(300).selectExpr("id AS x", "id + 1 AS y").union(spark.sql("SELECT 1000L, 1001L"))
    got = {r.node: r.comp for r in connected(links).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_shingles_do_not_depend_on_parts(monkeypatch):
    from leadflow.llm import neardup

    text = "some words\tand more\x0cwords " * 2000
    whole = shingles(text, 3).tolist()
    real = neardup._parts
    monkeypatch.setattr(neardup, "_parts", lambda raw, size: real(raw, 100))
    assert shingles(text, 3).tolist() == whole


def test_word_ids_of_another_step_are_given_up(tokenizer):
    """Workers go on to other steps: what packing held took 200 MB of each beside the near-duplicates."""
    from leadflow.llm.packing import _words

    path = tokenizer("word_bpe_49k.json")
    held = weakref.ref(_words(path))
    assert _words(path) is held()  # once loaded, kept for the step
    shingles("some words of the next step", 2)
    gc.collect()
    assert held() is None and _words(path).ids("two words").tolist()


def test_nodes_are_spread_before_they_become_keys(make, monkeypatch):
    """Few tasks read the nodes, and each had all its keys, 144 a node, in one table of its memory."""
    from leadflow.llm import neardup

    plans, real = {}, neardup.written

    def written(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, label)

    monkeypatch.setattr(neardup, "written", written)
    assert near_duplicates(make(["a b c d", "a b c d e f g"])).count() == 2
    for label in ("heads", "members"):
        made = plans[label].split("Generate ")[1].split("Relation ")[0]
        assert "RepartitionByExpression" in made


def test_query(spark, tables):
    from leadflow.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    got = QUERIES["op8_near_duplicates"](spark, tables).collect()
    want = [(i, n, c, i == c) for i, n, c in brute(rows, 2)]
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted(want)
