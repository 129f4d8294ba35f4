import pytest
from check import compare, connection

from leadflow.llm import conversations
from leadflow.llm.conversations import render_chats

SCHEMA = "conv_id long, turn long, role string, text string, part int"


def rows_of(spark, convs):
    return spark.createDataFrame([(c, n, r, t, 0) for c, turns in convs for n, r, t in turns], SCHEMA)


def turns(*texts):
    return [(n, "user" if n % 2 == 0 else "assistant", t) for n, t in enumerate(texts)]


def brute(convs):
    whole = {}
    for c, ts in convs:
        if c is not None:
            whole.setdefault(c, []).extend(ts)
    order = lambda t: tuple((v is not None, v if v is not None else 0) for v in t)
    seqs = {c: tuple((r, t) for _, r, t in sorted(ts, key=order)) for c, ts in whole.items()}
    kept = {}
    for c, s in seqs.items():
        longer = any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values())
        same = [o for o, v in seqs.items() if v == s]
        if not longer and c == min(same):
            text = "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in s)
            kept[c] = (len(s), len(same), text)
    return kept


CONVS = [
    (1, turns("a", "b")), (2, turns("a", "b", "c")), (3, turns("a")), (4, turns("x", "b")), (5, turns("a", "b", "c")),
    (6, turns(None, "b")), (7, turns("", "b")), (8, [(0, None, "a")]), (9, [(None, "user", "a"), (0, "user", "a"), (0, "user", "a")]),
    (10, turns(*"abcdefghij" * 90)), (11, turns(*("abcdefghij" * 90)[:700])), (None, turns("a", "b")), (12, turns("c", "b", "a")),
    (13, [(900, "user", "a"), (-5, "user", "b")]),
]


@pytest.mark.parametrize("block", [2, 256])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "TURNS_PER_BLOCK", block)
    found = {}
    for r in sorted(render_chats(rows_of(spark, CONVS)).collect(), key=lambda r: (r.conv_id, r.part)):
        n, copies, text = found.get(r.conv_id, (r.n_turns, r.copies, ""))
        assert (n, copies) == (r.n_turns, r.copies)
        found[r.conv_id] = (n, copies, text + r.text)
    assert found == brute(CONVS)


def test_empty_table(spark):
    assert render_chats(rows_of(spark, [])).collect() == []


def test_query_against_sql(spark, tables):
    from leadflow.llm.queries import ORACLES, QUERIES

    name = "op2_chat_format"
    ok, note, _ = compare(spark, connection(tables), name, QUERIES[name], ORACLES[name], tables)
    assert ok, note
