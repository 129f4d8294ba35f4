"""Write pages as WARC archives and read them back by byte ranges.

An archive is a row of gzip members, one record each, so it can be read from any member on. A split is a byte
range of a file: its task looks for the gzip magic from the range's start, takes a place for a member only if
it decodes to a record header there, and owns the records that start inside the range, reading the last one
past its end. Files go through Arrow's file systems, so any store both Spark and Arrow know will do.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.functions.workspace import workspace
from leadflow.llm.common import bounded_batches, written

_MAGIC = b"\x1f\x8b\x08"
_BLOCK = 1 << 20
_HEAD_BYTES = 1 << 16
_SENT_BYTES = 4 << 20
RECORDS = (
    "path string, offset bigint, length bigint, record_type string, record_id string, target_uri string, "
    "refers_to string, payload_digest string, payload_bytes bigint, payload binary, payload_ok boolean"
)
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _open(path: str):
    """(file system, path there) of a URI or a plain path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def record(record_id: str, uri: str | None, payload: bytes, sha1: str, refers_to: str | None, level: int) -> bytes:
    """One gzip member: a response with its payload, or a revisit that refers to the response's record."""
    body = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>",
        f"WARC-Target-URI: {_one_line(uri)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_REVISIT_PROFILE}"]
    raw = "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def with_originals(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "payload", least_bytes: int = 0) -> DataFrame:
    """Rows with ``payload_digest`` and ``refers_to``: of rows with equal payloads of at least ``least_bytes``
    that with the largest id is the original, which the others refer to.

    Only digests, lengths and ids are shuffled for the search; one row per payload and task goes out.
    """
    sha1 = F.sha1(F.col(payload_col))
    size = F.octet_length(payload_col)
    rows = pages.withColumns({"__sha1": sha1, "__size": size})
    groups = rows.filter(F.col("__size") >= least_bytes).groupBy("__sha1", "__size").agg(
        F.max(id_col).alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    repeated = groups.filter("__n > 1").drop("__n")
    found = rows.join(repeated, ["__sha1", "__size"], "left")
    refers = F.when(F.col(id_col).isNull() | (F.col(id_col) != F.col("__first")), F.col("__first"))
    return found.withColumn("refers_to", refers).drop("__sha1", "__size", "__first")


def write_archives(
    pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url",
    payload_col: str = "payload", least_bytes: int = 0, file_bytes: int = 256 << 20, level: int = 6,
) -> DataFrame:
    """Write a record per row; returns the files (path, length, records).

    Record ids are ``urn:page:<id>``. A null payload counts as empty, a null url as blank. Rows of equal or null
    id are records each. An empty table writes no file. Every attempt of a task writes files of its own; those
    of the attempt that Spark commits are the ones listed, so lost or repeated tasks leave nothing wrong behind.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or workspace(spark, "warc")
    payload = F.coalesce(F.col(payload_col), F.lit(b"")) if dict(pages.dtypes)[payload_col] == "binary" else F.coalesce(
        F.col(payload_col).cast("string"), F.lit("")
    ).cast("binary")
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.col(id_col).alias("__id"))
    marked = with_originals(rows, id_col="__id", least_bytes=least_bytes).select("id", "url", "payload", F.col("refers_to").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        made: list[tuple[str, int, int]] = []
        out, name, length, records = None, "", 0, 0
        for batch in batches:
            for name_, url, payload, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out, length, records = store.open_output_stream(posixpath.join(root, name), compression=None), 0, 0
                target = None if refers is None else f"urn:page:{refers}"
                member = record(f"urn:page:{name_}", url, payload, digest(payload), target, level)
                out.write(member)
                length, records = length + len(member), records + 1
                if length >= file_bytes:
                    out.close()
                    made.append((f"{folder}/{name}", length, records))
                    out = None
        if out is not None:
            out.close()
            made.append((f"{folder}/{name}", length, records))
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in made], pa.string()), *(pa.array([m[i] for m in made], pa.int64()) for i in (1, 2))],
            names=["path", "length", "records"],
        )

    return written(marked.mapInArrow(run, "path string, length bigint, records bigint"), "warc-files")


def list_archives(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length) of the files under ``paths``; contents are not read."""
    return spark.read.format("binaryFile").load(paths).select("path", "length")


class _Window:
    """Bytes of a file from any place on, read in blocks; keeps the block at hand."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def read(self, start: int, n: int) -> bytes:
        if not (self.at <= start and start + n <= self.at + len(self.data)):
            self.file.seek(start)
            self.at, self.data = start, self.file.read(min(max(n, _BLOCK), max(0, self.size - start)))
        return self.data[start - self.at : start - self.at + n]

    def find(self, mark: bytes, start: int) -> tuple[bool, int]:
        """Whether the bytes at hand from ``start`` hold the mark, and its place; else the place to go on from."""
        if len(self.read(start, len(mark))) < len(mark):
            return False, self.size
        place = self.data.find(mark, start - self.at)
        return (True, self.at + place) if place >= 0 else (False, self.at + len(self.data) - len(mark) + 1)


def _heads_record(window: _Window, at: int) -> bool:
    """Whether a gzip member that begins a record is at this place: it decodes to a whole record header with the fields
    that every record has."""
    unpacker, head = zlib.decompressobj(31), b""
    try:
        while b"\r\n\r\n" not in head and not unpacker.eof and len(head) < _HEAD_BYTES:
            raw = window.read(at, 512)
            if not raw:
                break
            head += unpacker.decompress(raw, _HEAD_BYTES)
            at += len(raw)
            if not head.startswith(b"WARC/"[: len(head)]):
                return False
    except zlib.error:
        return False
    names = {line.partition(b":")[0].strip().lower() for line in head.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]}
    return head.startswith(b"WARC/") and b"\r\n\r\n" in head and names >= {b"warc-type", b"warc-record-id", b"content-length"}


def _next_member(window: _Window, at: int, end: int) -> int | None:
    """First place in [at, end) that holds a record's member. Bytes at hand are searched before more are read."""
    while at < end:
        found, at = window.find(_MAGIC, at)
        if not found:
            continue
        if at >= end:
            return None
        if _heads_record(window, at):
            return at
        at += 1
    return None


def _member(window: _Window, at: int) -> tuple[bytes, int]:
    """Contents of the member at this place, and its length in the file."""
    unpacker, parts, place, step = zlib.decompressobj(31), [], at, 1 << 12
    while not unpacker.eof:
        block, step = window.read(place, min(step, window.size - place)), 1 << 16
        if not block:
            raise EOFError(f"the record at byte {at} is cut off")
        parts.append(unpacker.decompress(block))
        place += len(block)
    return b"".join(parts), place - len(unpacker.unused_data) - at


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, rest[: int(fields.get("content-length", 0))]


def read_archives(files: DataFrame, *, split_bytes: int = 16 << 20) -> DataFrame:
    """The records of the files (path, length): see ``RECORDS``.

    ``offset`` and ``length`` are the member's place in the file. ``payload_digest`` and ``payload_bytes`` are of
    the whole payload, for a revisit as its header gives them; ``payload`` is null there. ``payload_ok`` tells
    whether a response's payload has the digest of its header, null without one. Damaged stretches between
    records are passed over; a record that is cut off fails the task. Empty files and tables give no records.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    splits = files.select("path", F.col("length").alias("size"), starts.alias("start"))
    spark = files.sparkSession
    bounded_batches(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    splits = splits.repartition(tasks, "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
            ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
            ("payload", pa.binary()), ("payload_ok", pa.bool_()),
        ])
        for batch in batches:
            for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows, held = [], 0
                store, place = _open(path)
                with store.open_input_file(place) as file:
                    window, end = _Window(file, size), min(start + split_bytes, size)
                    at = _next_member(window, start, end)
                    while at is not None:
                        raw, length = _member(window, at)
                        rows.append(_row(path, at, length, raw))
                        held += len(raw)
                        if held >= _SENT_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                        at = _next_member(window, at + length, end)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return splits.mapInArrow(run, RECORDS)


def _row(path: str, offset: int, length: int, raw: bytes) -> dict:
    fields, payload = parse_record(raw)
    kind = fields.get("warc-type")
    given = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    named = {"record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to")}
    named = {k: v.strip("<>") if v is not None else None for k, v in named.items()}
    row = {"path": path, "offset": offset, "length": length, "record_type": kind, **named}
    if kind == "revisit":
        size = fields.get("warc-payload-length")
        return row | {"payload_digest": given, "payload_bytes": int(size) if size else None, "payload": None, "payload_ok": None}
    found = digest(payload)
    return row | {"payload_digest": found, "payload_bytes": len(payload), "payload": payload, "payload_ok": None if given is None else given == found}
