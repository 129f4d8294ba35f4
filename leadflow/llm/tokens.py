"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced where they agree.

Byte-pair encoding is decided pair by pair: a row of tokens is the encoding of its text exactly if every two
neighbours are the encoding of their own text. So where one chunk has a bound before a token y, and the next
chunk has a bound at the same place before the same y, the first chunk's tokens up to there and the second's
from there on have only neighbours that already stood beside each other in an encoding: the splice is the
encoding of the whole. Where two chunks never agree, the overlap is doubled for that document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadflow.llm.common import process_cache, text_slices, written

_SLICE_CHARS = 2_000_000
_MARKS = "array<struct<pos:bigint,id:int,before:bigint>>"


def _model(path: str):
    cache = process_cache("pieces")
    if ("pieces", path) not in cache:
        import sentencepiece

        cache["pieces", path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return cache["pieces", path]


def _counted(keep: Sequence[str], path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            counts: list[int] = []
            for _, _, texts in text_slices(batch.column(batch.num_columns - 1), _SLICE_CHARS):
                counts += map(len, model.encode([t or "" for t in texts], num_threads=1))
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    return run


def text_key(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8")).digest()


def _split(step: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                key = text_key(text)
                starts, at = range(0, max(1, len(text) - overlap), step), 0
                for a in range(0, len(starts), 64):
                    some = starts[a : a + 64]
                    bytes_at = []
                    for s in some:
                        bytes_at.append(at)
                        at += len(text[s : s + step].encode("utf-8"))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key] * len(some), pa.binary()), pa.array(range(a, a + len(some)), pa.int64()),
                            pa.array(bytes_at, pa.int64()), pa.array([text[s : s + step + overlap] for s in some], pa.string()),
                        ],
                        names=["key", "i", "start", "chunk"],
                    )

    return run


def _marks(pieces, start: int, low: int, high: int) -> list[dict]:
    """First token at each place in [low, high): its place, id and the number of tokens before it."""
    out: list[dict] = []
    for n, piece in enumerate(pieces):
        pos = start + piece.begin
        if pos >= high:
            break
        if pos >= low and (not out or out[-1]["pos"] != pos):
            out.append({"pos": pos, "id": piece.id, "before": n})
    return out


def _encoded(path: str, step: int, overlap: int):
    kind = pa.list_(pa.struct([("pos", pa.int64()), ("id", pa.int32()), ("before", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            rows = []
            for start, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                pieces = model.encode(text, return_type="proto").pieces
                # places are in bytes; at its very start a chunk has the blank that the library puts before a text
                shared = start + len(text[:overlap].encode("utf-8"))
                nxt, end = start + len(text[:step].encode("utf-8")), start + len(text.encode("utf-8"))
                rows.append((len(pieces), _marks(pieces, start, start + 1, shared), _marks(pieces, start, nxt + 1, end)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], kind),
                ],
                names=["key", "i", "n", "head", "tail"],
            )

    return run


def _spliced(texts: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """(key, n_tokens, aligned) of each distinct text."""
    chunks = texts.mapInArrow(_split(step, overlap), "key binary, i bigint, start bigint, chunk string").dropDuplicates(["key", "i"])
    found = chunks.select("key", "i", "start", "chunk").mapInArrow(
        _encoded(path, step, overlap), f"key binary, i bigint, n bigint, head {_MARKS}, tail {_MARKS}"
    )
    nxt = F.lead("head").over(Window.partitionBy("key").orderBy("i"))
    pairs = found.withColumn("next", nxt)
    place = lambda marks: F.transform(marks, lambda m: F.struct(m["pos"], m["id"]))
    common = F.array_min(F.array_intersect(place(F.col("tail")), place(F.col("next"))))["pos"]
    pairs = pairs.withColumn("at", common)
    before = lambda marks: F.get(F.filter(marks, lambda m: m["pos"] == F.col("at")), F.lit(0))["before"]
    twice = F.when(F.col("next").isNull(), 0).otherwise(F.col("n") - before("tail") + before("next"))
    return pairs.groupBy("key").agg(
        F.sum(F.col("n") - F.coalesce(twice, F.lit(0))).alias("n_tokens"),
        F.min(F.col("next").isNull() | F.col("at").isNotNull()).alias("aligned"),
    )


def count_tokens(
    docs: DataFrame, model_path: str, *, keep: Sequence[str] = ("doc_id",), text_col: str = "text",
    chunk_chars: int = 65_536, overlap: int = 256,
) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the length of the library's encoding of the whole text.

    Texts of up to ``chunk_chars`` code points are encoded at once. Longer ones are cut into chunks that
    overlap, which other tasks encode, and spliced; equal texts are encoded once. A null text counts as empty,
    which has no tokens. Rows with equal or null ids are counted one by one; an input column ``n_tokens`` may
    not be in ``keep`` under that name; an empty table stays empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*[F.col(c) for c in keep], text.alias("__text"))
    long = F.char_length("__text") > chunk_chars
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    short = rows.filter(~long).mapInArrow(_counted(keep, model_path), f"{fields}, n_tokens bigint")
    key = F.unhex(F.sha2("__text", 256))
    huge = rows.filter(long).withColumn("__key", key)

    step, parts, left = chunk_chars, [], huge.select("__text")
    while True:
        found = written(_spliced(left, model_path, step, overlap), "token-counts")
        parts.append(found.filter("aligned").select(F.col("key").alias("__key"), "n_tokens"))
        unaligned = found.filter("NOT aligned").select(F.col("key").alias("__key"))
        if unaligned.isEmpty():
            break
        overlap *= 2
        step = max(step, 2 * overlap)  # in the end one chunk holds the whole text
        left = huge.join(unaligned, "__key", "left_semi").select("__text")
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    return short.unionByName(huge.drop("__text").join(counts, "__key").select(*keep, "n_tokens"))
