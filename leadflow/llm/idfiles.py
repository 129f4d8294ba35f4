"""Token ids of documents in binary files: every document a zstandard frame of its own, one dictionary for all.

The dictionary is trained on the serialized ids of a bounded sample of short documents and lies beside the files
under its hash, which every file names. Documents are sorted by id over all files. A file is a head, the frames,
the index of them block by block, a directory of the blocks and a trailer that tells where the directory begins. So
one document is read by its entry and its frame, without the frames before it.

head:      8 bytes mark, 4 bytes width of an id (2 or 4), 4 bytes of zeros, 32 bytes SHA-256 of the dictionary
index:     for each block an Arrow stream (id, place, compressed length, number of ids)
directory: for each block 8 bytes place of its index and 8 bytes its length
trailer:   8 bytes place of the directory, 8 bytes number of blocks, 8 bytes mark (all numbers little-endian)
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.functions.workspace import workspace
from leadflow.llm.common import process_cache, slice_bounds
from leadflow.llm.packing import _words
from leadflow.llm.warc import _open

MARK = b"LFIDS\x00\x01\n"
_HEAD, _TRAILER = "<8sII32s", "<QQ8s"
_SLICE_BYTES = 1 << 20
_SENT_BYTES = 16 << 20
_DICTIONARY_BYTES = 112_640


def serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def train_dictionary(samples: list[bytes], size: int = _DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of the samples; of too few or too small ones their own bytes, of none nothing."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _whole(words, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text and the end id; a text too long for a slice comes alone and is encoded in parts."""
    end = np.array([end_id], "<u4")
    if len(texts) == 1:
        yield np.concatenate([*words.stream(texts[0].as_py()), end])
    else:
        for ids in words.ids_of_column(texts):
            yield np.concatenate([ids, end])


def _sampled(docs: DataFrame, path: str, end_id: int, width: int, sample_docs: int, sample_chars: int) -> list[bytes]:
    """Serialized ids of at most ``sample_docs`` texts of 1 to ``sample_chars`` characters, chosen by their hashes.

    Hashes below a bound that some twice as many rows keep go on, so what is sorted does not grow with the table.
    """
    rows = docs.count()
    if not rows or not sample_docs:
        return []
    place = F.shiftrightunsigned(F.xxhash64("text"), 1)
    short = docs.filter(place < min(2 * sample_docs * (1 << 63) // rows, (1 << 63) - 1)).filter(F.char_length("text").between(1, sample_chars))
    some = short.select("text", place.alias("h")).dropDuplicates(["h"]).orderBy("h").limit(sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            made = [serialized(ids, width) for ids in _whole(words, batch.column(0), end_id)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["ids"])

    return sorted(bytes(r.ids) for r in some.select("text").mapInArrow(run, "ids binary").collect())


class _File:
    """One file under way: frames go out as they come, the index at the end."""

    def __init__(self, store, path: str, shown: str, width: int, sha: bytes, id_type: pa.DataType, block_docs: int, block_ids: int):
        self.out, self.shown = store.open_output_stream(path, compression=None), shown
        self.out.write(struct.pack(_HEAD, MARK, width, 0, sha))
        self.at, self.block_docs, self.block_ids = struct.calcsize(_HEAD), block_docs, block_ids
        self.schema = pa.schema([("id", id_type), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64())])
        self.blocks: list[bytes] = []
        self.open: list[tuple] = []
        self.held = 0
        self.sizes: list[tuple[int, int]] = []

    def add(self, name, frame: bytes, n: int) -> None:
        self.out.write(frame)
        self.open.append((name, self.at, len(frame), n))
        self.at += len(frame)
        self.held += n
        if len(self.open) >= self.block_docs or self.held >= self.block_ids:
            self._block()

    def _block(self) -> None:
        if self.open:
            columns = [pa.array(c, t) for c, t in zip(zip(*self.open, strict=True), self.schema.types, strict=True)]
            index = pa.BufferOutputStream()
            with pa.ipc.new_stream(index, self.schema) as stream:
                stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
            self.blocks.append(index.getvalue().to_pybytes())
            self.sizes.append((len(self.open), self.held))
            self.open, self.held = [], 0

    def close(self) -> None:
        self._block()
        lengths = np.array([len(b) for b in self.blocks], np.int64)
        places = self.at + np.cumsum(lengths) - lengths
        for block in self.blocks:
            self.out.write(block)
        self.out.write(np.stack([places, lengths], axis=1).astype("<u8").tobytes())
        self.out.write(struct.pack(_TRAILER, self.at + int(lengths.sum()), len(lengths), MARK))
        self.out.close()


def write_ids(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 2, file_bytes: int = 128 << 20, block_docs: int = 1024, block_ids: int = 1 << 20, level: int = 1,
    sample_docs: int = 1000, sample_chars: int = 4096,
) -> str:
    """Write the ids of every whole text, each with ``end_id`` behind, in ascending order of the id; returns the folder.

    The folder gets the files, ``<SHA-256>.zdict`` (the dictionary, trained on at most ``sample_docs`` texts of up to
    ``sample_chars`` characters: 4 million characters) and ``blocks``, a table that lists the files' blocks in order.
    Files are listed for the attempt of a task that Spark commits; what lost attempts wrote is never read.

    A null text counts as empty and has the end id alone. Rows of a null id come first; rows of equal ids are documents
    each, in the order of their texts' hashes, so that no id needs one task. Other columns are left out. An empty table
    gives a folder without files. A text and its ids must fit in a task's memory.
    """
    spark = docs.sparkSession
    folder = folder or workspace(spark, "ids")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    largest = max(_words(tokenizer_path).tokenizer.get_vocab_size() - 1, end_id)
    width = 2 if largest < 1 << 16 else 4
    raw = train_dictionary(_sampled(rows, tokenizer_path, end_id, width, sample_docs, sample_chars))
    sha = hashlib.sha256(raw).digest()
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(posixpath.join(root, f"{sha.hex()}.zdict"), compression=None) as out:
        out.write(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer_path)
        store, root = _open(folder)
        shared = _dictionary(raw)
        if shared:
            shared.precompute_compress(level=level)
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared)
        task, made, file, n_files = TaskContext.get().partitionId(), [], None, 0

        def closed(file: _File, number: int) -> None:
            file.close()
            made.extend((task, number, k, file.shown, docs, ids) for k, (docs, ids) in enumerate(file.sizes))

        for batch in batches:
            names, id_type = batch.column(0).to_pylist(), batch.schema.field(0).type
            for a, b in slice_bounds(batch.column(1), _SLICE_BYTES):
                for name, ids in zip(names[a:b], _whole(words, batch.column(1).slice(a, b - a), end_id), strict=True):
                    if file is None:
                        part = f"part-{task:05d}-{n_files:04d}-{uuid.uuid4().hex}.ids"
                        file = _File(store, posixpath.join(root, part), f"{folder}/{part}", width, sha, id_type, block_docs, block_ids)
                    file.add(name, packer.compress(serialized(ids, width)), len(ids))
                    if file.at >= file_bytes:
                        closed(file, n_files)
                        file, n_files = None, n_files + 1
        if file is not None:
            closed(file, n_files)
        columns = list(zip(*made, strict=True)) or [()] * 6
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["task", "file", "block", "path", "docs", "ids"]
        )

    ordered = rows.withColumns({"h": F.xxhash64("text"), "i": F.monotonically_increasing_id()})
    ordered = ordered.repartitionByRange("id", "h", "i").sortWithinPartitions("id", "h", "i").select("id", "text")
    blocks = ordered.mapInArrow(run, "task int, file int, block int, path string, docs bigint, ids bigint")
    # the type of the ids goes along as an empty column
    blocks.withColumn("id", F.lit(None).cast(docs.schema[id_col].dataType)).write.parquet(f"{folder}/blocks")
    return folder


class _Reader:
    """An open file of ids: entries of its blocks and the ids behind them."""

    def __init__(self, path: str):
        store, place = _open(path)
        self.path, self.file = path, store.open_input_file(place)
        mark, self.width, _, sha = struct.unpack(_HEAD, self.file.read(struct.calcsize(_HEAD)))
        size = struct.calcsize(_TRAILER)
        self.file.seek(self.file.size() - size)
        at, blocks, end = struct.unpack(_TRAILER, self.file.read(size))
        if mark != MARK or end != MARK:
            raise ValueError(f"{path} is no file of ids, or it is cut off")
        self.directory = np.frombuffer(self.bytes_at(at, 16 * blocks), "<u8").reshape(-1, 2).tolist()
        self.unpacker = self._unpacker(store, posixpath.dirname(place), sha)

    @staticmethod
    def _unpacker(store, root: str, sha: bytes):
        cache = process_cache("word ids")
        if ("zdict", sha) not in cache:
            with store.open_input_file(posixpath.join(root, f"{sha.hex()}.zdict")) as file:
                raw = file.read()
            if hashlib.sha256(raw).digest() != sha:
                raise ValueError(f"the dictionary {sha.hex()} was changed")
            cache["zdict", sha] = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        return cache["zdict", sha]

    def entries(self, block: int) -> pa.RecordBatch:
        return pa.ipc.open_stream(self.bytes_at(*self.directory[block])).read_next_batch()

    def bytes_at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def ids(self, frame: bytes, n: int) -> bytes:
        """Little-endian unsigned 32-bit ids of a frame."""
        raw = self.unpacker.decompress(frame)
        if len(raw) != n * self.width:
            raise ValueError(f"{self.path}: a frame holds {len(raw)} bytes for {n} ids")
        return raw if self.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def _readers():
    """Gives the reader of a path; the last one stays open."""
    last: list[_Reader] = []

    def reader(path: str) -> _Reader:
        if not last or last[0].path != path:
            for old in last:
                old.file.close()
            last[:] = [_Reader(path)]
        return last[0]

    return reader


def blocks_of(spark: SparkSession, folder: str) -> DataFrame:
    """(path, block, docs, ids, start) of the blocks; ``start`` counts the ids of all documents before a block."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # one row per task that wrote
    tasks = blocks.groupBy("task").agg(F.sum("ids").alias("ids")).select("task", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("task").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("inside", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(tasks, "task")
    return placed.select("path", "block", "docs", "ids", (F.col("first") + F.col("inside")).alias("start"))


def _spread(rows: DataFrame, *order: str) -> DataFrame:
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *order).sortWithinPartitions(*order)


def _id_type(spark: SparkSession, folder: str) -> T.DataType:
    return spark.read.parquet(f"{folder}/blocks").schema["id"].dataType


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids) of every document in the files; ``ids`` are little-endian unsigned 32-bit.

    ``start`` counts the ids of all documents before. Tasks read blocks of documents, with one read each.
    """
    schema = T.StructType([
        T.StructField("id", _id_type(spark, folder)), *T.StructType.fromDDL("start bigint, n_tokens bigint, ids binary").fields,
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _readers()
        for batch in batches:
            for path, block, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                file = reader(path)
                entries = file.entries(block)
                offset, length, n = (entries.column(i).to_numpy() for i in (1, 2, 3))
                starts = start + np.cumsum(n) - n
                base = int(offset[0])
                raw = memoryview(file.bytes_at(base, int(offset[-1] + length[-1]) - base))
                a, made, held = 0, [], 0
                for k in range(len(n)):
                    at = int(offset[k]) - base
                    made.append(file.ids(raw[at : at + int(length[k])], int(n[k])))
                    held += len(made[-1])
                    if held >= _SENT_BYTES or k + 1 == len(n):
                        yield pa.RecordBatch.from_arrays(
                            [entries.column(0).slice(a, k + 1 - a), pa.array(starts[a : k + 1]), pa.array(n[a : k + 1]), pa.array(made, pa.binary())],
                            names=schema.names,
                        )
                        a, made, held = k + 1, [], 0

    return _spread(blocks_of(spark, folder).select("path", "block", "start"), "path", "block").mapInArrow(run, schema)


def index_of(spark: SparkSession, folder: str) -> DataFrame:
    """(id, path, offset, length, start, n_tokens) of every document: the files' indexes alone are read."""
    schema = T.StructType([
        T.StructField("id", _id_type(spark, folder)),
        *T.StructType.fromDDL("path string, offset bigint, length bigint, start bigint, n_tokens bigint").fields,
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _readers()
        for batch in batches:
            for path, block, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                entries = reader(path).entries(block)
                n = entries.column(3).to_numpy()
                starts = pa.array(start + np.cumsum(n) - n)
                paths = pa.array([path] * len(n), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [entries.column(0), paths, entries.column(1), entries.column(2), starts, entries.column(3)], names=schema.names
                )

    return _spread(blocks_of(spark, folder).select("path", "block", "start"), "path", "block").mapInArrow(run, schema)


def fetch_ids(spark: SparkSession, folder: str, wanted: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of the documents whose id ``wanted`` names; only their frames are read.

    Every document of a wanted id comes once, however often it is wanted; null and unknown ids give no rows.
    """
    found = index_of(spark, folder).join(wanted.select(F.col(id_col).alias("id")), "id", "left_semi")
    schema = T.StructType([found.schema["id"], *T.StructType.fromDDL("start bigint, n_tokens bigint, ids binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _readers()
        for batch in batches:
            made = []
            for path, offset, length, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 5)), strict=True):
                file = reader(path)
                made.append(file.ids(file.bytes_at(offset, length), n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(5), pa.array(made, pa.binary())], names=schema.names)

    return _spread(found.select("id", "path", "offset", "length", "start", "n_tokens"), "path", "offset").mapInArrow(run, schema)
