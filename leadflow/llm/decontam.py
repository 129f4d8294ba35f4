"""Find benchmark passages in documents with one Aho-Corasick automaton over normalised words.

Normalised text is its words joined by single blanks, with a blank at either end, so that a window can only
match at word bounds. Each text is scanned once; a found window maps back to word numbers, and those to code
points of the original. The automaton is sent to the tasks, so the benchmark is measured first: beyond
``max_automaton_bytes`` its windows are dealt into parts that are scanned one after another.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.llm.common import process_cache, text_slices, written

#: ASCII letters, digits and every byte above ASCII are parts of words; the rest are breaks
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SLICE_CHARS = 4_000_000

HITS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("words", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
])


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct (passage, items): runs of ``window`` words of an item, or all words of a shorter one.

    The text of a passage is lower case with single blanks. Items without words have none; one without an id has
    passages that name no item.
    """
    lower = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = benchmark.select(
        F.col(item_col).cast("string").alias("item"), F.regexp_extract_all(lower, F.lit(f"({_WORD_RE})"), 1).alias("w")
    ).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    passage = words.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, window), " "))).alias("passage"))
    return passage.groupBy("passage").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _automaton(rows: list[tuple[str, list[str]]]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for passage, items in rows:
        raw = passage.encode("utf-8").decode("latin-1")
        made.add_word(f" {raw} ", (raw.count(" ") + 1, tuple(items)))
    if rows:
        made.make_automaton()
    return made


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _found(automaton, text: str, before: dict | None) -> dict:
    words = words_of(text)
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits, items = [list(s) for s in (before or {}).get("words", [])], set((before or {}).get("items", []))
    blanks: list[int] | None = None
    if len(automaton) and words:
        for end, (n, names) in automaton.iter(joined):
            if blanks is None:
                blanks = [i for i, c in enumerate(joined) if c == " "]
            last = bisect_right(blanks, end) - 1  # the blank behind the window has the number of the word after it
            hits.append([last - n, last])
            items.update(names)
    hits = _merge(hits)
    spans = []
    if hits:
        places = [m.span() for m in _WORD.finditer(text)]
        spans = [[places[a][0], places[b - 1][1]] for a, b in hits]
    return {"n_words": len(words), "n_hit": sum(b - a for a, b in hits), "items": sorted(items), "words": hits, "spans": spans}


def _scan(docs: DataFrame, rows: list[tuple[str, list[str]]], text: str, out: str) -> DataFrame:
    """Add or renew the hits column from one automaton."""
    sent, name = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex
    again = out in docs.columns
    kept = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, HITS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = process_cache("passages")
        if cache.get("decontam", (None,))[0] != name:
            cache["decontam"] = (name, _automaton(sent.value))
        automaton = cache["decontam"][1]
        kind = None
        for batch in batches:
            names = batch.schema.names
            at = names.index(text)
            for a, b, texts in text_slices(batch.column(at), _SLICE_CHARS):
                part = batch.slice(a, b - a)
                before = part.column(names.index(out)).to_pylist() if again else [None] * (b - a)
                hits = [_found(automaton, t or "", x) for t, x in zip(texts, before, strict=True)]
                columns = [part.column(i) for i, n in enumerate(names) if n != out]
                kind = kind or pa.struct([
                    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                    ("words", pa.list_(pa.list_(pa.int64()))), ("spans", pa.list_(pa.list_(pa.int64()))),
                ])
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, kind)], names=schema.names)

    return docs.mapInArrow(run, schema)


def find_passages(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 10, out: str = "passages", max_automaton_bytes: int = 64 << 20,
) -> DataFrame:
    """The documents with a struct ``out``: n_words; n_hit (words inside a found window); items (sorted as
    strings); words and spans (merged [start, end) ranges in word numbers and in code points of the text).

    A null text has no words. Items that are null, empty or without words find nothing; the words of an item with a
    null id are hit, but it is not among the items; equal items are all named. An input column called ``out`` is replaced, other columns stay; equal rows are judged one by one;
    an empty table stays empty. Texts are scanned whole. One task's memory holds one automaton.
    """
    passages = written(item_windows(benchmark, item_col, item_text_col, window), "passages")
    # a state takes some tens of bytes for each byte of a passage
    names = F.octet_length(F.array_join("items", ","))
    weight = passages.agg(F.coalesce(F.sum(F.octet_length("passage") + names + 64), F.lit(0))).first()[0]
    parts = max(1, -(-weight * 16 // max_automaton_bytes))
    part: Column = F.pmod(F.xxhash64("passage"), F.lit(parts))
    docs = docs.drop(out)
    for i in range(parts):
        rows = [(r[0], r[1]) for r in passages.filter(part == i).collect()]  # bounded by the measure above
        docs = _scan(docs, rows, text_col, out)
        if i + 1 < parts:
            docs = written(docs, "passages-found")
    return docs


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of a benchmark item occurs, with their columns as they were."""
    out = "__passages"
    found = find_passages(docs, benchmark, out=out, **options)
    return found.filter(F.col(out)["n_hit"] == 0).drop(out)
