import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from leadflow.llm.pii import BASE, find_pii, listed, mask_pii

# The base patterns as they are stated
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in double) % 10 == 0


def base(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


random.seed(3)
FUZZ = ["".join(random.choice("ab1234567890..--  ++()@%_é\U0001f600\n4111") for _ in range(random.randint(0, 120))) for _ in range(1500)]
HARD = [
    "a@b.c_d@e.f.g", "x@y.z@w.v", "1.2.3.4.5.6.7.8 +1 (234) 567-8901", "4111 1111 1111 1111 0", "000.001.0255.3 1.2.3.99999999999999999999",
    "é a@b.co " * 700, "+1 " * 3000 + "(", "a@b" + ".c" * 20_000, "a" * 200_000, "1" * 50_000,
]


def test_base_spans_against_stated_patterns(make, odd):
    docs = make(FUZZ + HARD).unionByName(odd)
    spans = listed(F.filter("pii", lambda s: s["kind"].isin(*BASE)))
    got = find_pii(docs).select("text", spans.alias("got")).collect()
    # the plain pattern takes quadratic time on one long run without a match
    assert all(r.got == (joined(base(r.text)) if len(r.text or "") < 100_000 else "") for r in got)


def test_checks_and_context(make):
    texts = [
        "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000", "DE88370400440532013000", "my SSN 123-45-6789", "lot 123-45-6789",
        "call +1 555 123 4567", "row +1 555 123 4567",
    ]
    got = [[(s.kind, s.start, s.end, round(s.score, 2)) for s in r.pii] for r in find_pii(make(texts)).orderBy("doc_id").collect()]
    assert got == [
        [("iban", 5, 32, 1.0), ("iban", 37, 59, 0.7)], [], [("ssn", 7, 18, 0.8)], [], [("phone", 5, 20, 0.9)], [("phone", 4, 19, 0.6)],
    ]


def mask(text):
    merged = []
    for a, b, k in sorted((a, b, k) for k, a, b in base(text)):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    out, at = "", 0
    for a, b, k in merged:
        out, at = out + text[at:a] + f"<{k.upper()}>", b
    return out + text[at:]


def test_masking(make, odd):
    docs = make(FUZZ)
    masked = {r.doc_id: r.text for r in mask_pii(docs).collect()}
    assert masked == {i: mask(t) for i, t in enumerate(FUZZ)}
    same = mask_pii(odd)
    assert same.columns == odd.columns
    assert sorted(same.collect(), key=repr) == sorted(odd.collect(), key=repr)


def test_clashing_column_and_empty_table(make):
    docs = make(["a@b.co"]).withColumnRenamed("lang", "pii")
    assert [s.kind for s in find_pii(docs).first().pii] == ["email"]
    assert find_pii(make([])).collect() == [] and mask_pii(make([])).collect() == []


def test_no_python_runs(make):
    plan = mask_pii(make(["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query(spark, tables):
    from leadflow.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op6_pii"](spark, tables).collect()}
    for r in spark.read.parquet(f"{tables}/documents.parquet").collect():
        want = base(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in want) for k in BASE]
        assert not want or joined(want) in got[r.doc_id].spans


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 600])
def test_places_in_long_lists(make, n):
    got = find_pii(make(["ü a@b.co" * n])).first().pii
    assert [(s.start, s.end) for s in got] == [m.span() for m in EMAIL.finditer("ü a@b.co" * n)]


def test_masks_of_many_spans(make):
    import time


    def cut(text):
        out, end = [], 0
        merged = []
        for kind, a, b in sorted(all_spans(text), key=lambda s: (s[1], s[2], s[0])):
            if merged and a < merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], b)
            else:
                merged.append([kind, a, b])
        for kind, a, b in merged:
            out += [text[end:a], f"<{kind.upper()}>"]
            end = b
        return "".join(out) + text[end:]

    def all_spans(text):
        row = find_pii(make([text])).first()
        return [(s.kind, s.start, s.end) for s in row.pii]

    many = " ".join(f"é{i} a{i}@b.org 1.2.3.{i % 256} +1 555 {i:07d}" for i in range(700)) + " tail"
    few = "x" * 5000 + " me@here.org " + "y" * 3000 + "\U0001f600 1.2.3.4"
    for text in (many, few, "a@b.co", "+1 555 1234567 4111111111111111"):
        assert mask_pii(make([text])).first().text == cut(text)
    long = " ".join(f"a{i}@b.org" for i in range(15_000))
    start = time.time()
    found = find_pii(make([long])).selectExpr("size(pii) AS n").first().n
    finding, start = time.time() - start, time.time()
    assert found == 15_000 and mask_pii(make([long])).first().text.count("<EMAIL>") == found
    assert time.time() - start < 3 * finding + 10  # not with the square of the spans
