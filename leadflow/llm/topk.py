"""Exact best-k inner products by three-phase uniform thresholds.

The dimensions are cut into ``lists`` groups; each gives a local score list of a query: the partial inner
product of every candidate. (1) Every tile of vectors takes its k best entries of each list, resolves those
candidates' whole scores and sends the k best; the k-th best of all that was gathered for a query is a safe
cutoff. (2) With ``lists`` groups, a score of at least the cutoff needs a partial score of at least
cutoff / lists in one of them, so every tile collects the entries that reach this uniform threshold in any
list. (3) What remains is resolved exactly, and the k best of those at or above the cutoff are the answer.

Vectors are packed into tiles of bounded size. A pair of a query tile and a candidate tile is the unit of
work, so memory is bounded and tasks are even whatever the table's keys look like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.llm.common import written

_TILE = "tile bigint, ids binary, sizes binary, vectors binary"
_LIST = "q_tile bigint, query_id bigint, found array<struct<score:bigint,vec_id:bigint>>"
_FOUND = pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))
_LARGEST = 2**63 - 1


def scaled(vector: str | Column, factor: int) -> Column:
    """floor(factor * x) of every component as long, null unless all are finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long")))


def _tiles(rows: DataFrame, tile_rows: int) -> DataFrame:
    """Pack (id, ints) rows into tiles; the number of a tile is its partition and place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, tile_rows):
                part = batch.slice(a, tile_rows)
                lists = part.column(1)
                ids = np.asarray(part.column(0).to_numpy(zero_copy_only=False), np.int64)
                sizes = np.diff(lists.offsets.to_numpy()).astype(np.int32)
                values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, sizes, values))],
                    names=["tile", "ids", "sizes", "vectors"],
                )
                n += 1

    return rows.mapInArrow(run, _TILE)


def _matrix(sizes: bytes, vectors: bytes, width: int) -> np.ndarray:
    sizes, values = np.frombuffer(sizes, np.int32), np.frombuffer(vectors, np.int64)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


class _Pair:
    """A query tile against a candidate tile: partial scores by group of dimensions, as exact numbers."""

    def __init__(self, row: dict, lists: int):
        width = max(1, *(int(np.frombuffer(row[s], np.int32).max(initial=0)) for s in ("q_sizes", "sizes")))
        q, c = _matrix(row["q_sizes"], row["q_vectors"], width), _matrix(row["sizes"], row["vectors"], width)
        self.query_ids, self.ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
        bound = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * width
        kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object  # all exact
        self.kind = np.int64 if bound < 2**63 else object
        cuts = np.linspace(0, width, min(lists, width) + 1).astype(int)
        q, c = q.astype(kind), c.astype(kind)
        self.parts = [q[:, a:b] @ c[:, a:b].T for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.own = self.query_ids[:, None] == self.ids[None, :]

    def resolve(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        total = self.parts[0][rows, columns]
        for part in self.parts[1:]:
            total = total + part[rows, columns]
        return total.astype(self.kind)

    def best(self, rows: np.ndarray, columns: np.ndarray, scores: np.ndarray, k: int) -> list[list[dict]]:
        """The k best (score, smaller id first) of each query among the given entries."""
        order = np.lexsort((self.ids[columns], -scores, rows))
        rows, columns, scores = rows[order], columns[order], scores[order]
        first = np.searchsorted(rows, np.arange(len(self.query_ids) + 1))
        out = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            b = min(b, a + k)
            out.append([
                {"score": max(-_LARGEST, min(_LARGEST, int(s))), "vec_id": int(i)}
                for s, i in zip(scores[a:b], self.ids[columns[a:b]], strict=True)
            ])
        return out


def _sent(row: dict, found: list[list[dict]]) -> pa.RecordBatch:
    ids = np.frombuffer(row["q_ids"], np.int64)
    tile = pa.array([row["q_tile"]] * len(ids), pa.int64())
    return pa.RecordBatch.from_arrays([tile, pa.array(ids, pa.int64()), pa.array(found, _FOUND)], names=["q_tile", "query_id", "found"])


def _local_lists(k: int, lists: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pair = _Pair(row, lists)
                n = len(pair.ids)
                marked = np.zeros(pair.own.shape, bool)
                for part in pair.parts:
                    part = np.where(pair.own, part.min() - 1, part)
                    top = np.argpartition(part, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), part.shape)
                    np.put_along_axis(marked, top, True, axis=1)
                rows, columns = np.nonzero(marked & ~pair.own)
                yield _sent(row, pair.best(rows, columns, pair.resolve(rows, columns), k))

    return run


def _sufficient(k: int, lists: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pair = _Pair(row, lists)
                cutoffs = dict(zip(row["cut_ids"] or [], row["cutoffs"] or [], strict=True))
                # a query for which fewer than k candidates were gathered has no cutoff
                cutoff = np.array([cutoffs.get(int(q), -_LARGEST) for q in pair.query_ids], object if pair.kind is object else np.int64)
                threshold = np.floor_divide(cutoff, len(pair.parts))[:, None]
                marked = pair.parts[0] >= threshold
                for part in pair.parts[1:]:
                    marked |= part >= threshold
                rows, columns = np.nonzero(marked & ~pair.own)
                scores = pair.resolve(rows, columns)
                enough = scores >= cutoff[rows]
                yield _sent(row, pair.best(rows[enough], columns[enough], scores[enough], k))

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best entries of each query with their rank; each task keeps k before the shuffle."""
    entry = found.select("q_tile", "query_id", F.explode("found").alias("f")).select("q_tile", "query_id", "f.score", "f.vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entry.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding",
    factor: int = 256, lists: int = 4, tile_rows: int = 4096, query_rows: int = 1024,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k highest integer inner products of each query with every
    other row's vector, all of them if there are fewer; ties go to the smaller id.

    Components become floor(factor * x). Vectors that are null or hold null or non-finite components take no
    part, on either side, nor do rows without an id. An empty vector scores 0; of vectors of different length
    the shorter counts as padded with zeros. Rows of equal id are candidates each; a query meets no row of its
    own id; equal query ids should not occur. Other columns are left out; empty tables give no rows. Scores
    beyond a long are clipped to it.
    """

    def ints(df: DataFrame) -> DataFrame:
        out = df.select(F.col(id_col).cast("long").alias("id"), scaled(vector_col, factor).alias("ints"))
        return out.filter("id IS NOT NULL AND ints IS NOT NULL")

    tiles = written(_tiles(ints(vectors), tile_rows), "topk-tiles")
    asked = written(
        _tiles(ints(queries).coalesce(8), query_rows).select(*[F.col(c).alias(f"q_{c}") for c in ("tile", "ids", "sizes", "vectors")]),
        "topk-queries",
    )
    # one number for each tile of vectors; every query tile goes to each of them
    numbers = F.sort_array(tiles.agg(F.collect_list("tile")).scalar())
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), vectors.sparkSession.sparkContext.defaultParallelism)
    sent = asked.withColumn("tile", F.explode(numbers)).repartition(tasks, "tile")
    work = tiles.repartition(tasks, "tile").join(sent, "tile")

    gathered = _ranked(work.mapInArrow(_local_lists(k, lists), _LIST), k)
    known = gathered.filter(F.col("rank") == k).groupBy("q_tile").agg(
        F.collect_list("query_id").alias("cut_ids"), F.collect_list("score").alias("cutoffs")
    )
    cutoffs = written(asked.join(known, "q_tile", "left"), "topk-cutoffs")
    sent = cutoffs.withColumn("tile", F.explode(numbers)).repartition(tasks, "tile")
    work = tiles.repartition(tasks, "tile").join(sent, "tile")
    exact = _ranked(work.mapInArrow(_sufficient(k, lists), _LIST), k)
    return exact.select("query_id", "rank", "vec_id", "score")
