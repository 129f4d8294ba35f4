"""Near-duplicate groups by MinHash with tensored banding and exact confirmation.

Two small collections of hash groups are drawn, each group a few minhashes. A table key is a pair of groups,
one of each collection, so ``groups`` squared keys come from only twice ``groups`` groups: the minhashes to
compute grow with the square root of the keys. Texts that share a key are candidates; a link is confirmed on
the full shingle sets.

Equal sets are one node from the start. Nodes that share a key are first tested against one node each, the
smallest that shares a key with them. Keys whose nodes are one component by then need no more. The nodes of all
others are dealt into blocks of bounded size by the largest key they share, and every two blocks with a common
key are compared in one step that returns only links between components. So all pairs of different components
that share a key are decided, but none is a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.llm.common import bounded_batches, give_back, process_cache, text_slices, written
from leadflow.llm.urlfilter import bloom_level

_SLICE_CHARS = 1_000_000
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0x9E3779B97F4A7C15
_BLOCK_NODES = 256
_BLOCK_SHINGLES = 400_000
_FILTER_BYTES = 64 << 20
_WRAP = 2**64


@dataclass(frozen=True)
class Settings:
    """``groups`` groups of ``rows`` minhashes in each collection: groups ** 2 keys of 2 * rows minhashes.

    With 12 groups of 3, two sets of similarity 0.8 miss each other with probability 0.0004, of 0.9 with 3e-7.
    """

    words: int = 2
    percent: int = 80
    groups: int = 12
    rows: int = 3
    seed: int = 1

    @property
    def hashes(self) -> int:
        return 2 * self.groups * self.rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    cache = process_cache("word hashes")
    if len(cache.get("powers", ((),))[0]) < n:
        up, down = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, _WRAP), np.uint64)
        up[0] = down[0] = 1
        cache["powers"] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return tuple(p[:n] for p in cache["powers"])


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of the bytes, words being what is between blanks."""
    codes = np.frombuffer(b" " + raw + b" ", np.uint8)
    blank = _BLANK[codes]
    change = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = change[::2], change[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers(len(codes))
    letters = _mix(np.arange(1, 257, dtype=np.uint64))[codes]
    sums = np.cumsum(letters * up)
    return _mix((sums[ends - 1] - sums[starts - 1]) * down[starts])


def _parts(raw: bytes, size: int) -> Iterator[bytes]:
    """Parts of about ``size`` bytes, cut at blanks."""
    start = 0
    while len(raw) - start > size:
        cut = min((p for p in (raw.find(bytes([b]), start + size) for b in (32, 10, 9, 11, 12, 13)) if p >= 0), default=-1)
        if cut < 0:
            break
        yield raw[start:cut]
        start = cut
    yield raw[start:] if start else raw


def shingles(text: str | None, words: int) -> np.ndarray:
    """The set of hashes of the text's runs of ``words`` words, sorted; a shorter text is one run."""
    raw = (text or "").encode("utf-8").lower()  # A-Z alone
    found = [word_hashes(part) for part in _parts(raw, 1 << 20)]
    hashed = np.concatenate(found) if len(found) > 1 else found[0]
    if not len(hashed):
        return hashed
    n = min(words, len(hashed))
    runs = np.full(len(hashed) - n + 1, n, np.uint64)
    for i in range(n):
        runs = _mix(runs * np.uint64(_ODD) + hashed[i : len(hashed) - n + 1 + i])
    return np.unique(runs)


class _Sketcher:
    def __init__(self, s: Settings):
        draw = np.random.default_rng(s.seed)
        self.s = s
        self.times = draw.integers(1, _WRAP, s.hashes, dtype=np.uint64) | np.uint64(1)
        self.plus = draw.integers(0, _WRAP, s.hashes, dtype=np.uint64)

    def sketch(self, found: np.ndarray) -> tuple[int, list[int], list[int], bytes]:
        """Fingerprint of the set, the two collections of group hashes, and a byte of each minhash."""
        least = np.full(self.s.hashes, _WRAP - 1, np.uint64)
        total = np.uint64(0)
        for i in range(0, len(found), 2048):
            part = found[i : i + 2048]
            total = total + _mix(part ^ np.uint64(_ODD)).sum(dtype=np.uint64)
            np.minimum(least, (part[:, None] * self.times + self.plus).min(axis=0), out=least)
        group = np.arange(2 * self.s.groups, dtype=np.uint64)
        for column in least.reshape(2 * self.s.groups, self.s.rows).T:
            group = _mix(group * np.uint64(_ODD) + column)
        groups = group.view(np.int64).tolist()
        print_ = int(_mix(np.array([total + np.uint64(len(found))])).view(np.int64)[0])
        return print_, groups[: self.s.groups], groups[self.s.groups :], (least >> np.uint64(20)).astype(np.uint8).tobytes()


def _sketches(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(id, print, n, node, ga, gb, sig) of every row; the last four are null for an empty set."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("id", id_type), T.StructField("print", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()),
        T.StructField("ga", T.ArrayType(T.LongType())), T.StructField("gb", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = _Sketcher(s)
        with np.errstate(over="ignore"):
            for batch in batches:
                for a, b, texts in text_slices(batch.column(1), _SLICE_CHARS):
                    sizes, rows = [], []
                    for text in texts:
                        found = shingles(text, s.words)
                        sizes.append(len(found))
                        rows.append(sketcher.sketch(found) if len(found) else (None,) * 4)
                    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
                        (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))]
                    ids, prints = batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([ids, prints, pa.array(sizes, pa.int64()), *columns], names=schema.names)
        give_back()

    return docs.select(F.col(id_col), F.col(text_col).cast("string"), _print(text_col)).mapInArrow(run, schema)


def _print(text_col: str) -> Column:
    """Tells the unlike texts of one id apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def _sets(docs: DataFrame, s: Settings) -> DataFrame:
    """(node, found): fingerprint and sorted shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = _Sketcher(s)
        with np.errstate(over="ignore"):
            for batch in batches:
                for _, _, texts in text_slices(batch.column(0), _SLICE_CHARS):
                    found = [shingles(t, s.words) for t in texts]
                    found = [f for f in found if len(f)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([sketcher.sketch(f)[0] for f in found], pa.int64()),
                            pa.array([f.tobytes() for f in found], pa.binary()),
                        ],
                        names=["node", "found"],
                    )
        give_back()

    return docs.mapInArrow(run, "node bigint, found binary").dropDuplicates(["node"])


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                _similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _least_agreement(s: Settings) -> int:
    """Minhash bytes that a pair at the threshold surely shares.

    Their number is binomial; this is six and a half deviations below its mean (a chance under one in a billion).
    """
    p = s.percent / 100
    return int(s.hashes * p - 6.5 * (s.hashes * p * (1 - p)) ** 0.5)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


class _Block:
    def __init__(self, members: list[dict], s: Settings):
        self.nodes = [m["node"] for m in members]
        self.comps = [m["comp"] for m in members]
        self.sets = [np.frombuffer(m["found"], np.uint64) for m in members]
        self.sizes = np.array([len(f) for f in self.sets])
        self.sigs = np.frombuffer(b"".join(m["sig"] for m in members), np.uint8).reshape(-1, s.hashes)


def _between(s: Settings):
    """(x, y) links between different components of two blocks, as many as join what can be joined."""

    def links(a: _Block, b: _Block) -> list[tuple[int, int]]:
        agree = np.zeros((len(a.nodes), len(b.nodes)), np.int16)
        for column in range(s.hashes):
            agree += a.sigs[:, column, None] == b.sigs[None, :, column]
        small, large = np.minimum(a.sizes[:, None], b.sizes[None, :]), np.maximum(a.sizes[:, None], b.sizes[None, :])
        comps = np.array(a.comps)[:, None] != np.array(b.comps)[None, :]
        rows, columns = np.nonzero((agree >= _least_agreement(s)) & (small * 100 >= large * s.percent) & comps)
        order = np.argsort(-agree[rows, columns], kind="stable")
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        out = []
        for i, j in zip(rows[order].tolist(), columns[order].tolist(), strict=True):
            x, y = find(a.comps[i]), find(b.comps[j])
            if x != y and _similar(a.sets[i], b.sets[j], s.percent):
                root[max(x, y)] = min(x, y)
                out.append((a.nodes[i], b.nodes[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = (_Block(batch.column(c)[r].as_py(), s) for c in (0, 1))
                found = links(a, b)
                yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in found], pa.int64()) for c in (0, 1)], names=["x", "y"])

    return run


def connected(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over ``links`` (x, y), for every node of a link.

    Each round takes the least label among neighbours and then the label of that label, so long chains fold up
    in few rounds. Labels are written each round; none is collected.
    """
    edges = written(links.select("x", "y").union(links.select(F.col("y"), F.col("x"))).distinct(), "links")
    labels = written(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("y"), "comp"), "y").select(F.col("x").alias("node"), "comp")
        low = near.union(labels).groupBy("node").agg(F.min("comp").alias("comp"))
        low = written(low, "labels-low")
        jump = low.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        nxt = written(low.join(jump, "comp", "left").select("node", F.coalesce("further", "comp").alias("comp")), "labels")
        changed = nxt.join(labels.select("node", F.col("comp").alias("was")), "node").filter("comp <> was")
        labels = nxt
        if changed.isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(),
) -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    Words are what blanks (space, tab, line and form feeds) separate, A-Z lower-cased. Two rows are linked if
    their shingle sets are similar enough; ``component_id`` is the smallest id reachable. A null text or one
    without words has no shingles and is linked with nothing. Rows without an id are compared with nothing and
    have no component. Repeated rows are in one component; other columns are left out; an empty table stays so.
    """
    found = _grouped(docs, id_col, text_col, settings)
    return found.select("id", "n", "component_id").withColumnsRenamed({"id": id_col, "n": "n_shingles"})


def _grouped(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(id, print, n, comp, component_id) of every row; ``comp`` tells groups apart that have the same smallest id."""
    bounded_batches(docs.sparkSession)  # a pair of sets or of blocks is one row
    rows = written(_sketches(docs, id_col, text_col, s), "sketches")
    comparable = rows.filter("node IS NOT NULL AND id IS NOT NULL")
    nodes = written(
        comparable.groupBy("node").agg(F.min("id").alias("first"), F.min(F.struct("n", "ga", "gb", "sig")).alias("r")).select("node", "first", "r.*"),
        "nodes",
    )
    labels = _components(docs, nodes, id_col, text_col, s)
    if labels is None:
        named = nodes.select("node", F.col("node").alias("comp"), F.col("first").alias("component_id"))
    else:
        of = nodes.select("node", "first").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        names = of.groupBy("comp").agg(F.min("first").alias("component_id"))
        named = of.select("node", "comp").join(names, "comp").select("node", "comp", "component_id")
    found = comparable.select("id", "print", "n", "node").join(written(named, "components"), "node").select("id", "print", "n", "comp", "component_id")
    alone = rows.filter("node IS NULL OR id IS NULL").select(
        "id", "print", "n", F.lit(None).cast("long").alias("comp"), F.col("id").alias("component_id")
    )
    return found.unionByName(alone)


def _components(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame | None:
    """(node, comp) of the linked nodes, None if nothing is linked."""
    keyed = _keyed(nodes, s)
    heads = keyed.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    heads = written(heads.select("key", "head"), "heads")
    members = written(keyed.join(heads, "key"), "members")  # (key, node, head) of keys that several nodes share
    candidates = members.select("node").distinct()
    wanted = written(nodes.join(candidates, "node").select(F.col("first").alias("key")).distinct(), "wanted")
    texts = _mostly(docs, id_col, wanted).join(wanted.toDF(id_col), id_col, "left_semi")
    sets = written(_sets(texts.select(F.col(text_col).cast("string")), s).join(candidates, "node", "left_semi"), "sets")
    lengths = nodes.select("node", "n")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links among the (x, y) pairs."""
        sized = pairs.join(lengths.toDF("x", "nx"), "x").join(lengths.toDF("y", "ny"), "y")
        fit = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * s.percent
        both = sized.filter(fit).select("x", "y").join(sets.toDF("x", "fx"), "x").join(sets.toDF("y", "fy"), "y")
        return both.select("x", "y", "fx", "fy").mapInArrow(_linked(s.percent), "x bigint, y bigint")

    # first each node with the smallest of all its heads, which most copies share
    first = members.filter("node <> head").groupBy(F.col("node").alias("y")).agg(F.min("head").alias("x")).select("x", "y")
    links = written(confirmed(first), "confirmed")
    labels = None if links.isEmpty() else connected(links)

    now = members.select("key", "node", F.col("node").alias("comp")) if labels is None else (
        members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    )
    now = written(now, "members-now")
    mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members"))
    left = written(now.join(mixed.filter("lo < hi").select("key", "members"), "key"), "members-left")
    if left.isEmpty():
        return labels
    more = written(_across(left, nodes, sets, s), "confirmed")
    return labels if more.isEmpty() else connected(links.union(more))


def _keyed(nodes: DataFrame, s: Settings) -> DataFrame:
    """(node, key): each key of each node.

    A node becomes groups ** 2 rows, and the table of nodes is read by few tasks, so it is spread first: what a
    task then combines has the size of a shuffle partition.
    """
    pairs = F.transform("ga", lambda x, i: F.transform("gb", lambda y, j: F.xxhash64(x, y, i * s.groups + j)))
    spread = nodes.select("node", "ga", "gb").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
    return spread.select("node", F.explode(F.flatten(pairs)).alias("key"))


def _mostly(docs: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """The documents that may be wanted: a Bloom filter drops most others before their texts are shuffled.

    It is sent to the tasks, so a list that would take more than ``_FILTER_BYTES`` is not filtered for.
    """
    n = wanted.count()
    if not 0 < n * 10 // 8 <= _FILTER_BYTES:
        return docs
    return docs.filter(bloom_level(wanted, n, 10, seed=9).holds(F.col(id_col)))


def _across(left: DataFrame, nodes: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links between components among the nodes that share a key: ``left`` has (key, node, comp, members)."""
    # the home of a node is the largest key it has; a home's nodes are dealt into blocks, those of its largest
    # component apart from the others
    homes = left.groupBy("node").agg(F.max(F.struct("members", "key")).alias("h"), F.first("comp").alias("comp"))
    homes = homes.join(nodes.select("node", "n"), "node").select("node", "comp", "n", F.col("h.key").alias("home"))
    largest = homes.groupBy("home", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("home").agg(F.max_by("comp", F.struct("c", "comp")).alias("most"))
    homes = homes.join(largest, "home").withColumn("main", F.col("comp") == F.col("most"))
    room = F.greatest(F.count(F.lit(1)) / _BLOCK_NODES, F.sum("n") / _BLOCK_SHINGLES)
    sizes = homes.groupBy("home", "main").agg(F.ceil(room).alias("blocks"))
    dealt = homes.join(sizes, ["home", "main"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = written(dealt.select("node", "comp", F.xxhash64("home", "main", "part").alias("block")), "blocks-of")
    full = dealt.join(nodes.select("node", "sig"), "node").join(sets, "node")
    packed = full.groupBy("block").agg(F.collect_list(F.struct("node", "comp", "sig", "found")).alias("held"))
    packed = written(packed, "blocks")
    met = left.select("key", "node").join(dealt, "node").groupBy("key", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    met = written(met, "blocks-met")
    # blocks wholly of the component that fills most of a key need no test among themselves
    fill = met.filter("lo = hi").groupBy("key", "lo").agg(F.count(F.lit(1)).alias("n"))
    most = fill.groupBy("key").agg(F.max_by("lo", F.struct("n", "lo")).alias("most"))
    odd = F.col("most").isNull() | (F.col("lo") != F.col("most")) | (F.col("hi") != F.col("most"))
    met = met.join(most, "key", "left").withColumn("odd", odd).drop("most")
    other = met.toDF("key", "other", "other_lo", "other_hi", "other_odd")
    # the same single component on both sides needs no test
    several = F.least("lo", "other_lo") < F.greatest("hi", "other_hi")
    once = ~F.col("other_odd") | (F.col("block") <= F.col("other"))
    pairs = met.filter("odd").join(other, "key").filter(several & once).select("block", "other").distinct()
    both = pairs.join(packed, "block").select("other", F.col("held").alias("a")).join(packed.toDF("other", "b"), "other")
    return both.select("a", "b").mapInArrow(_between(s), "x bigint, y bigint")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The documents with one of each group: that with the smallest id. Columns stay as they are.

    Rows without an id all stay. A row is told by its id and its text: of rows that repeat both one stays, unlike
    texts of one id are judged each in its own group.
    """
    found = _grouped(docs, id_col, text_col, settings)
    least = found.filter("id = component_id").groupBy("comp", "id", "print").agg(F.count(F.lit(1)).alias("rows"))
    # one text of a group; texts without words are groups of their own
    one = least.groupBy("comp", "id", F.when(F.col("comp").isNull(), F.col("print"))).agg(F.min(F.struct("print", "rows")).alias("k"))
    kept = written(one.select(F.col("id").alias(id_col), F.col("k.print").alias("__print"), F.col("k.rows").alias("__rows")), "kept")
    printed, row = docs.withColumn("__print", _print(text_col)), [id_col, "__print"]
    once = printed.join(kept.filter("__rows = 1").select(*row), row, "left_semi")
    repeated = printed.join(kept.filter("__rows > 1").select(*row), row, "left_semi").dropDuplicates(row)
    kept_rows = once.unionByName(repeated).select(*docs.columns)
    return kept_rows.unionByName(docs.filter(F.col(id_col).isNull()))
