"""Quality scores by voting of the nearest labelled documents in a latent space.

A text becomes counts of hashed words, of word shapes (which kinds of signs a word holds, begins and ends with)
and of how far back each word last occurred. A bounded, class-balanced sample of labelled rows gives the latent
axes (a truncated singular value decomposition) and the labelled vectors; both are sent to the tasks. Every
document is projected, its cosines with all labelled vectors are computed in blocks, and its nearest ones vote,
weighted by cosine over the share of their label, so that a rare label is not outvoted by number alone. A score
depends on the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.llm.common import give_back, text_slices
from leadflow.llm.neardup import word_hashes

_SLICE_CHARS = 1_000_000
_PART_BYTES = 1 << 20
WORD_TERMS, SHAPE_TERMS = 1024, 512
#: a word's last occurrence lies at most so many words back; beyond, or never: two more terms
REPEATS = (1, 4, 16, 64, 256)
FEATURES = WORD_TERMS + SHAPE_TERMS + len(REPEATS) + 2
_BLOCKS = (slice(0, WORD_TERMS), slice(WORD_TERMS, WORD_TERMS + SHAPE_TERMS), slice(WORD_TERMS + SHAPE_TERMS, FEATURES))
_WEIGHTS = (0.5, 1.0, 1.0)


def _kinds() -> np.ndarray:
    """Bit of each byte: lower case, upper case, digit, end of sentence, comma and the like, bracket, other sign,
    beyond ASCII. Blanks have none."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        out[b] = (
            128 if b >= 128 else 0 if c in " \t\n\r\x0b\x0c" else 1 if c.islower() else 2 if c.isupper() else 4 if c.isdigit()
            else 8 if c in ".!?" else 16 if c in ",;:'\"-" else 32 if c in "()[]{}<>|" else 64
        )
    return out


_KIND = _kinds()
_RANK = np.zeros(256, np.int64)
_RANK[[1 << i for i in range(8)]] = range(8)


def _shapes(raw: bytes) -> np.ndarray:
    """A number below ``SHAPE_TERMS`` for each word, from its kinds of signs, its first and its last."""
    kinds = _KIND[np.frombuffer(b" " + raw + b" ", np.uint8)]
    change = np.flatnonzero((kinds[1:] > 0) != (kinds[:-1] > 0)) + 1
    starts, ends = change[::2], change[1::2]
    if not len(starts):
        return np.empty(0, np.int64)
    held = np.bitwise_or.reduceat(kinds, starts).astype(np.int64)
    # an ending of two signs or more is told from one
    run = (kinds[ends - 2] == kinds[ends - 1]) & (ends - starts > 1) & (kinds[ends - 1] > 4) & (kinds[ends - 1] < 128)
    mixed = ((held * 8 + _RANK[kinds[starts]]) * 8 + _RANK[kinds[ends - 1]]) * 2 + run
    return (mixed * 2654435761 >> 8) % SHAPE_TERMS


def _cut(raw: bytes) -> Iterator[bytes]:
    start = 0
    while len(raw) - start > _PART_BYTES:
        cut = raw.find(b" ", start + _PART_BYTES)
        if cut < 0:
            break
        yield raw[start:cut]
        start = cut
    yield raw[start:] if start else raw


def _back(hashes: np.ndarray) -> np.ndarray:
    """Term of each word by how many words back it last occurred."""
    order = np.argsort(hashes, kind="stable")
    gap = np.full(len(hashes), np.iinfo(np.int64).max)
    same = hashes[order][1:] == hashes[order][:-1]
    gap[order[1:][same]] = (order[1:] - order[:-1])[same]
    term = np.searchsorted(REPEATS, gap)
    term[gap == np.iinfo(np.int64).max] = len(REPEATS) + 1
    return term


def features(texts: list[str | None]) -> np.ndarray:
    """One row a text: square roots of the terms' shares, each of the three blocks scaled to its weight."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in zip(out, texts, strict=True):
        raw = (text or "").encode("utf-8")
        hashes, shapes = [], []
        for part in _cut(raw):
            hashes.append(word_hashes(part.lower()))
            shapes.append(_shapes(part))
        words = np.concatenate(hashes) if len(hashes) > 1 else hashes[0]
        if not len(words):
            continue
        row[_BLOCKS[0]] = np.bincount((words >> np.uint64(40)).astype(np.int64) % WORD_TERMS, minlength=WORD_TERMS)
        row[_BLOCKS[1]] = np.bincount(np.concatenate(shapes), minlength=SHAPE_TERMS)
        row[_BLOCKS[2]] = np.bincount(_back(words), minlength=len(REPEATS) + 2)
        for block, weight in zip(_BLOCKS, _WEIGHTS, strict=True):
            row[block] = np.sqrt(row[block] / len(words)) * weight
    return out


@dataclass(frozen=True)
class Model:
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def project(self, rows: np.ndarray) -> np.ndarray:
        latent = rows @ self.axes
        size = np.linalg.norm(latent, axis=1, keepdims=True)
        return np.divide(latent, size, out=np.zeros_like(latent), where=size > 0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by cosine over the label's share; 0 for a text without words."""
        out = np.zeros(len(rows))
        voice = 1 / np.bincount(self.labels.astype(np.int64), minlength=2).clip(1)[self.labels.astype(np.int64)]
        k = min(self.neighbours, len(self.labels))
        for a in range(0, len(rows), 512):
            near = self.project(rows[a : a + 512]) @ self.vectors.T
            best = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k :]
            weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) * voice[best]
            total = weight.sum(axis=1)
            vote = (weight * self.labels[best]).sum(axis=1)
            out[a : a + 512] = np.divide(vote, total, out=np.zeros(len(total)), where=total > 0)
        return np.clip(out, 0, 1)


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    per_class: int = 2000, axes: int = 32, neighbours: int = 15,
) -> Model | None:
    """Fit on at most ``per_class`` labelled rows of either label, those with the smallest hashes of their ids.

    Features are computed in the tasks; the driver gets 6 KB a sampled row. None if no labelled row has a
    document. Labels that are null or neither 0 nor 1 are left out; of an id's labels the least counts.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).alias("label"))
    order = [F.xxhash64(id_col), F.col(id_col)]
    sample = None
    for label in (0, 1):
        some = known.filter(F.col("label") == label).orderBy(*order).limit(per_class)
        sample = some if sample is None else sample.unionByName(some)
    # at most twice per_class ids and labels
    chosen = docs.select(id_col, F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), id_col)
    chosen = chosen.select(F.col(id_col).cast("string").alias("id"), "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(2), _SLICE_CHARS):
                part = batch.slice(a, b - a)
                rows = [r.tobytes() for r in features(texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), pa.array(rows, pa.binary())], names=["id", "label", "row"])

    # repeated rows of an id count once
    rows = chosen.mapInArrow(run, "id string, label int, row binary").groupBy("id").agg(F.min("label").alias("label"), F.min("row").alias("row"))
    rows = sorted(rows.collect())
    if not rows:
        return None
    x = np.stack([np.frombuffer(r.row, np.float32) for r in rows])
    values, vectors = np.linalg.eigh(x.T.astype(np.float64) @ x)
    model = Model(vectors[:, np.argsort(-values)[:axes]].astype(np.float32), np.empty(0), np.array([r.label for r in rows], np.float64), neighbours)
    return Model(model.axes, model.project(x), model.labels, neighbours)


def score_quality(docs: DataFrame, model: Model | None, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """The rows with ``out``, from 0 to 1, higher where label 1 is likelier.

    A null text, or one without words, scores 0. Without a model (no labelled rows) every row scores 1. Equal
    texts score alike. An input column called ``out`` is replaced, others stay; an empty table stays empty.
    """
    docs = docs.drop(out)
    if model is None:
        return docs.withColumn(out, F.lit(1.0))
    # plain arrays: a worker without this package could not read a broadcast Model
    sent = docs.sparkSession.sparkContext.broadcast((model.axes, model.vectors, model.labels, model.neighbours))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            for a, b, texts in text_slices(batch.column(at), _SLICE_CHARS):
                part = batch.slice(a, b - a)
                scores = model.score(features(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, out])
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def keep_good(docs: DataFrame, model: Model | None, *, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """The documents that score ``least`` or more, with their columns as they were."""
    out = "__score"
    return score_quality(docs, model, text_col=text_col, out=out).filter(F.col(out) >= least).drop(out)
