"""Exact ranked search by words: an inverted index in segments, skipped by joint bounds of term pairs.

The index is a table of segments. A segment has some hundred documents in the order of their ids, its terms, and for
each term the documents that hold it with their counts; tasks build segments from the rows they read, so nothing is
shuffled. The ranked queries are the log from which term pairs are drawn: every query's terms, rarest first, are taken
two by two. For each pair and segment the list of documents with both terms and the largest joint impact of one of
them are computed beforehand and stored with the terms' own impacts.

No document of a segment can gain more from a pair than the larger of its joint maximum and the two terms' own maxima,
which is less than the sum of the two where they never meet. A query skips segments whose pair bounds do not add up to
the best known k-th score, and inside a segment takes as candidates only documents of the pairs without which that
score cannot be reached. First scores come from the lists of the best pairs, before any other document is looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.functions.workspace import workspace
from leadflow.llm.common import text_slices, written

_SLICE_CHARS = 1_000_000
_ROW_GROUP_BYTES = 16 << 20
#: letters and digits of ASCII and all bytes beyond; capitals become small, other signs blanks
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)
_SEGMENT = "lengths binary, vocabulary binary, df binary, docs binary, counts binary, n_docs bigint, n_terms bigint"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_FOLD).split()


def _ints(raw, kind: str) -> np.ndarray:
    return np.frombuffer(raw.as_buffer() if isinstance(raw, pa.Scalar) else raw, kind)


class _Segment:
    """Documents of a segment under way."""

    def __init__(self):
        self.names, self.lengths, self.found, self.size = [], [], [], 0

    def add(self, name, text: str | None) -> None:
        words = terms(text)
        if words:
            self.names.append(name)
            self.lengths.append(len(words))
            self.found.append(Counter(words))
            self.size += len(text)

    def row(self, id_type: pa.DataType, schema: pa.Schema) -> pa.RecordBatch:
        names = pa.array(self.names, id_type)
        order = pc.sort_indices(names, null_placement="at_end").to_numpy()
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(chain.from_iterable(self.found)))}
        sizes = [len(c) for c in self.found]
        total = sum(sizes)
        of_term = np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(self.found)), np.int64, total)
        counts = np.fromiter(chain.from_iterable(c.values() for c in self.found), np.int64, total)
        docs = np.repeat(number, sizes)
        by = np.argsort(of_term * len(number) + docs)
        lengths = np.array(self.lengths, np.int64)[order]
        columns = {
            "ids": pa.array([names.take(pa.array(order)).to_pylist()], pa.list_(id_type)),
            "lengths": lengths.tobytes(), "vocabulary": b" ".join(vocabulary), "df": np.bincount(of_term).astype("<u4").tobytes(),
            "docs": docs[by].astype("<u2").tobytes(), "counts": counts[by].astype("<u4").tobytes(),
            "n_docs": len(number), "n_terms": int(lengths.sum()),
        }
        arrays = [c if isinstance(c, pa.Array) else pa.array([c], f.type) for c, f in zip(columns.values(), schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _store(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").option("parquet.block.size", _ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.parquet(path)


def build_index(
    docs: DataFrame, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text",
    segment_docs: int = 512, segment_chars: int = 1_000_000,
) -> str:
    """Write the index of all whole texts, every term of theirs; returns its folder.

    A segment ends at ``segment_docs`` documents (65,536 at most) or with the text that takes it to ``segment_chars``
    characters. Texts without a term, null ones too, are in no segment. Rows of equal or null ids are documents each.
    """
    if not 0 < segment_docs <= 1 << 16:
        raise ValueError("a segment has 1 to 65,536 documents")
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), *T.StructType.fromDDL(_SEGMENT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, id_type, arrow = _Segment(), None, None
        for batch in batches:
            if arrow is None:
                id_type = batch.schema.field(0).type
                arrow = pa.schema([
                    ("ids", pa.list_(id_type)), *((n, pa.binary()) for n in ("lengths", "vocabulary", "df", "docs", "counts")),
                    ("n_docs", pa.int64()), ("n_terms", pa.int64()),
                ])
            names = batch.column(0).to_pylist()
            for a, b, texts in text_slices(batch.column(1), _SLICE_CHARS):
                for name, text in zip(names[a:b], texts, strict=True):
                    segment.add(name, text)
                    if len(segment.names) >= segment_docs or segment.size >= segment_chars:
                        yield segment.row(id_type, arrow)
                        segment = _Segment()
        if segment.names:
            yield segment.row(id_type, arrow)

    folder = folder or workspace(docs.sparkSession, "lexical-index")
    _store(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema), folder)
    return folder


@dataclass(frozen=True)
class _Block:
    """Some queries: their terms, and groups of one or two terms with how often the query has them."""

    terms: dict[bytes, int]
    weights: np.ndarray
    #: of each group: its query, two terms (the same one twice if alone) and their repeats (the second's 0 if alone)
    query: np.ndarray
    first: np.ndarray
    second: np.ndarray
    first_times: np.ndarray
    second_times: np.ndarray
    #: the distinct pairs, and of each group its pair or -1
    pairs: np.ndarray
    pair: np.ndarray
    n_queries: int
    n_docs: int
    n_terms: int

    def bounds(self, top: np.ndarray, joint: np.ndarray) -> np.ndarray:
        """Most that a document can gain from each group, by the terms' largest impacts and the pairs' joint ones."""
        own = np.maximum(self.first_times * self.weights[self.first] * top[self.first], self.second_times * self.weights[self.second] * top[self.second])
        return np.maximum(own, np.append(joint, 0)[self.pair])


def _block(queries: list[Counter], df: dict[bytes, int], n_docs: int, n_terms: int) -> _Block:
    known = {t: i for i, t in enumerate(sorted(df))}
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in known], np.int64)
    groups, pairs = [], {}
    for q, wanted in enumerate(queries):
        own = sorted((t for t in wanted if t in known), key=lambda t: (df[t], t))
        for a in range(0, len(own), 2):
            s = known[own[a]]
            if a + 1 < len(own):
                t = known[own[a + 1]]
                pair = (s, t, wanted[own[a]], wanted[own[a + 1]])
                groups.append((q, *pair, pairs.setdefault(pair, len(pairs))))
            else:
                groups.append((q, s, s, wanted[own[a]], 0, -1))
    columns = np.array(groups, np.int64).reshape(-1, 6).T
    return _Block(
        known, weights, columns[0], columns[1], columns[2], columns[3], columns[4],
        np.array(list(pairs), np.int64).reshape(-1, 4), columns[5], len(queries), n_docs, n_terms,
    )


def _impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A thousand times a thousand times the share of its weight that a term brings a document."""
    m = 75 + (25 * lengths * n_docs) // n_terms
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


class _Lists:
    """A segment's lists of the terms and pairs of a block."""

    def __init__(self, size: int, df: np.ndarray, docs: np.ndarray, impacts: np.ndarray):
        self.size, self.df, self.docs, self.impacts = size, df, docs, impacts
        self.ends = np.cumsum(df).tolist()

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        here = slice(self.ends[term - 1] if term else 0, self.ends[term])
        return self.docs[here], self.impacts[here]

    def gain(self, term: int, factor: int, docs: np.ndarray) -> np.ndarray:
        """What a term brings each of the documents."""
        held, impacts = self.of(term)
        out = np.zeros(len(docs), np.int64)
        if len(held):
            at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            hit = held[at] == docs
            out[hit] = impacts[at[hit]] * factor
        return out

    def top(self) -> np.ndarray:
        out = np.zeros(len(self.df), np.int64)
        held = np.flatnonzero(self.df)
        if len(held):
            out[held] = np.maximum.reduceat(self.impacts, (np.cumsum(self.df) - self.df)[held])
        return out


def _best(docs: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, equal scores by document."""
    return np.lexsort((docs, -scores))[:k]


def _group_gain(block: _Block, lists: _Lists, g: int, docs: np.ndarray) -> np.ndarray:
    s, t = int(block.first[g]), int(block.second[g])
    out = lists.gain(s, int(block.first_times[g] * block.weights[s]), docs)
    if block.second_times[g]:
        out += lists.gain(t, int(block.second_times[g] * block.weights[t]), docs)
    return out


def _projected(segment: dict, block: _Block, k: int) -> dict:
    """A segment's lists of the block's terms with impacts, its pair lists with joint maxima, and first scores."""
    vocabulary = segment["vocabulary"].split()
    df, lengths = _ints(segment["df"], "<u4").astype(np.int64), _ints(segment["lengths"], "<i8")
    ends = np.cumsum(df)
    docs, counts = _ints(segment["docs"], "<u2"), _ints(segment["counts"], "<u4")
    size = np.zeros(len(block.terms), np.int64)
    held = [(block.terms[t], i) for i, t in enumerate(vocabulary) if t in block.terms]
    held.sort()
    some_docs, some_counts = [], []
    for term, i in held:
        size[term] = df[i]
        some_docs.append(docs[ends[i] - df[i] : ends[i]])
        some_counts.append(counts[ends[i] - df[i] : ends[i]])
    docs = np.concatenate(some_docs).astype(np.int64) if held else np.empty(0, np.int64)
    counts = np.concatenate(some_counts).astype(np.int64) if held else np.empty(0, np.int64)
    lists = _Lists(len(lengths), size, docs, _impacts(counts, lengths[docs], block.n_docs, block.n_terms))
    joint, pair_sizes, pair_docs = np.zeros(len(block.pairs), np.int64), np.zeros(len(block.pairs), np.int64), []
    for p, (s, t, s_times, t_times) in enumerate(block.pairs.tolist()):
        if not (size[s] and size[t]):
            continue
        (a, fa), (b, fb) = lists.of(s), lists.of(t)
        both, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        if len(both):
            joint[p] = (s_times * block.weights[s] * fa[at_a] + t_times * block.weights[t] * fb[at_b]).max()
            pair_sizes[p] = len(both)
            pair_docs.append(both)
    lists_of_pairs = np.concatenate(pair_docs) if pair_docs else np.empty(0, np.int64)
    return {
        "ids": segment["ids"], "df": size.astype("<u4").tobytes(), "docs": docs.astype("<u2").tobytes(),
        "impacts": lists.impacts.astype("<u4").tobytes(), "joint": joint.astype("<i8").tobytes(),
        "pair_df": pair_sizes.astype("<u4").tobytes(), "pair_docs": lists_of_pairs.astype("<u2").tobytes(),
        "heads": _first_scores(block, lists, joint, pair_sizes, lists_of_pairs, k),
    }


def _first_scores(block: _Block, lists: _Lists, joint: np.ndarray, sizes: np.ndarray, docs: np.ndarray, k: int) -> list[dict]:
    """Whole scores of the documents in the list of each query's best pair: the k largest."""
    out, ends = [], np.cumsum(sizes)
    groups = np.flatnonzero(block.pair >= 0)
    groups = groups[np.lexsort((-joint[block.pair[groups]], block.query[groups]))]
    first = np.ones(len(groups), bool)
    first[1:] = block.query[groups[1:]] != block.query[groups[:-1]]
    for g in groups[first].tolist():
        p, q = int(block.pair[g]), int(block.query[g])
        if not joint[p]:
            continue
        some = docs[ends[p] - sizes[p] : ends[p]]
        scores = np.zeros(len(some), np.int64)
        for h in range(*np.searchsorted(block.query, [q, q + 1]).tolist()):
            scores += _group_gain(block, lists, h, some)
        out += [{"q": q, "score": s} for s in np.sort(scores)[::-1][:k].tolist()]
    return out


def _searched(block: _Block, lists: _Lists, groups: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a segment that score ``least`` or more in a query, with their scores.

    Groups go from the largest bound down. While those still to come can reach ``least`` by themselves, all documents
    of a group are candidates; from there on only candidates that can still reach it are kept.
    """
    groups = groups[np.argsort(-bounds[groups], kind="stable")]
    rest = np.append(np.cumsum(bounds[groups][::-1])[::-1], 0)
    dense, i = np.zeros(lists.size, np.int64), 0
    while i < len(groups) and rest[i] >= least:
        g = groups[i]
        for term, times in ((block.first[g], block.first_times[g]), (block.second[g], block.second_times[g])):
            if times:
                held, impacts = lists.of(int(term))
                dense[held] += impacts * int(times * block.weights[term])
        i += 1
    docs = np.flatnonzero((dense > 0) & (dense + rest[i] >= least))
    scores = dense[docs]
    while i < len(groups) and len(docs):
        scores = scores + _group_gain(block, lists, int(groups[i]), docs)
        i += 1
        on = scores + rest[i] >= least
        docs, scores = docs[on], scores[on]
    return docs, scores


def _document_counts(index: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """Number of documents that hold each of the terms."""
    asked = frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for vocabulary, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term, n in zip(vocabulary.split(), _ints(df, "<u4").tolist(), strict=True):
                    if term in asked:
                        total[term] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "df"])

    found = index.select("vocabulary", "df").mapInArrow(run, "term binary, df bigint")
    return {bytes(r.term): r.df for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def _numbered_queries(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = queries.select(F.col(id_col).alias("query_id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.withColumn("number", F.monotonically_increasing_id()), "lexical-queries")


def _blocks(queries: DataFrame, block_terms: int) -> Iterator[tuple[list[int], list[Counter]]]:
    """The queries in blocks of about ``block_terms`` terms, streamed to the driver one partition at a time."""
    numbers, wanted, held = [], [], 0
    for row in queries.toLocalIterator():
        found = Counter(terms(row.text))
        if found:
            numbers.append(row.number)
            wanted.append(found)
            held += len(found)
        if held >= block_terms:
            yield numbers, wanted
            numbers, wanted, held = [], [], 0
    if numbers:
        yield numbers, wanted


_PROJECTED = (
    "df binary, docs binary, impacts binary, joint binary, pair_df binary, pair_docs binary, heads array<struct<q:int,score:bigint>>"
)


def _project(index: DataFrame, block: _Block, k: int) -> DataFrame:
    schema = T.StructType([index.schema["ids"], *T.StructType.fromDDL(_PROJECTED).fields])
    cut = index.select("ids", "lengths", "vocabulary", "df", "docs", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = pa.list_(pa.struct([("q", pa.int32()), ("score", pa.int64())]))
        for batch in batches:
            kinds = pa.schema([batch.schema.field(0), *((n, pa.binary()) for n in ("df", "docs", "impacts", "joint", "pair_df", "pair_docs")), ("heads", heads)])
            for i in range(len(batch)):
                yield pa.RecordBatch.from_pylist([_projected(batch.slice(i, 1).to_pylist()[0], block, k)], kinds)

    return cut.mapInArrow(run, schema)


def _search(lists: DataFrame, block: _Block, least: list[int], k: int) -> DataFrame:
    """(q, id, score, segments, skipped): the best of every task; rows with q = -1 count segments and those skipped."""
    kind = lists.schema["ids"].dataType.elementType
    schema = T.StructType([
        T.StructField("q", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.LongType()),
        T.StructField("segments", T.LongType()), T.StructField("skipped", T.LongType()),
    ])
    cut = lists.select("ids", "df", "docs", "impacts", "joint")
    first = np.searchsorted(block.query, np.arange(block.n_queries + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.array(least, np.int64)
        best = [np.empty(0, np.int64) for _ in least]
        asked = np.flatnonzero(np.diff(first))
        for batch in batches:
            id_type = batch.schema.field(0).type.value_type
            for row in range(len(batch)):
                ids = batch.column(0)[row].values
                df, docs, impacts, joint = (_ints(batch.column(i)[row], t).astype(np.int64) for i, t in ((1, "<u4"), (2, "<u2"), (3, "<u4"), (4, "<i8")))
                found, skipped = _Lists(len(ids), df, docs, impacts), 0
                bounds = block.bounds(found.top(), joint)
                reach = np.add.reduceat(bounds, first[asked]) if len(asked) else np.empty(0, np.int64)
                q_out, doc_out, score_out = [], [], []
                for q, most in zip(asked.tolist(), reach.tolist(), strict=True):
                    if most < floor[q]:
                        skipped += 1
                        continue
                    some, scores = _searched(block, found, np.arange(first[q], first[q + 1]), bounds, int(floor[q]))
                    top = _best(some, scores, k)
                    if len(top):
                        q_out.append(np.full(len(top), q))
                        doc_out.append(some[top])
                        score_out.append(scores[top])
                        best[q] = -np.sort(-np.append(best[q], scores[top]))[:k]
                        if len(best[q]) == k:  # what the task has already found counts too
                            floor[q] = max(floor[q], best[q][-1])
                n = sum(map(len, q_out))
                column = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(column(q_out), -1), pa.int32()),
                        pa.concat_arrays([ids.take(pa.array(column(doc_out))), pa.nulls(1, id_type)]),
                        pa.array(np.append(column(score_out), 0)),
                        pa.array(np.append(np.zeros(n, np.int64), len(asked))), pa.array(np.append(np.zeros(n, np.int64), skipped)),
                    ],
                    names=schema.names,
                )

    return cut.mapInArrow(run, schema)


def _thresholds(lists: DataFrame, n_queries: int, k: int) -> list[int]:
    """The k-th best of the first scores of each query, 1 where there are fewer: no result scores less."""
    heads = lists.select(F.explode("heads").alias("h")).select("h.q", "h.score")
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("rank") <= k)
    kth = ranked.filter(F.col("rank") == k).select("q", "score").collect()  # one row a query of the block
    least = [1] * n_queries
    for row in kth:
        least[row.q] = max(1, row.score)
    return least


def search(
    spark: SparkSession, folder: str, queries: DataFrame, *, k: int = 20, id_col: str = "item_id", text_col: str = "text",
    block_terms: int = 20_000,
) -> tuple[DataFrame, DataFrame]:
    """The k best documents of every query over the index in ``folder``: (query_id, rank, id, score), and counts.

    Weights and impacts are integers of the whole index: see ``_block`` and ``_impacts``. Equal scores go by ascending
    id, a null one last; only scores above 0 count. A query without terms, or whose terms no text has, gives no rows.
    Rows of equal or null ids are queries each. An empty index or no queries give no rows.

    Queries go in blocks of about ``block_terms`` distinct terms, each with two passes over the index; what is sent to
    tasks or the driver is bounded by a block. The second table (segments, skipped) counts the pairs of a query and a
    segment, and those that the bounds skipped.
    """
    index = spark.read.parquet(folder)
    asked = _numbered_queries(queries, id_col, text_col)
    total = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    id_type = index.schema["ids"].dataType.elementType.simpleString()
    parts = []
    for numbers, wanted in _blocks(asked, block_terms) if total.docs else ():
        df = _document_counts(index, list(set().union(*wanted)))
        if not df:
            continue
        block = _block(wanted, df, total.docs, total.terms)
        lists = _store(_project(index, block, k), workspace(spark, "lexical-lists"))
        found = written(_search(lists, block, _thresholds(lists, block.n_queries, k), k), "lexical-found")
        number = spark.createDataFrame(list(enumerate(numbers)), "q int, number bigint")
        parts.append((found, number))
    rows = spark.createDataFrame([], f"number bigint, id {id_type}, score bigint")
    counts = spark.createDataFrame([], "segments bigint, skipped bigint")
    for found, number in parts:
        rows = rows.unionByName(found.filter("q >= 0").join(number, "q").select("number", "id", "score"))
        counts = counts.unionByName(found.filter("q < 0").select("segments", "skipped"))
    by = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    result = ranked.join(asked.select("number", "query_id"), "number").select("query_id", "rank", "id", "score")
    return result, counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns])
