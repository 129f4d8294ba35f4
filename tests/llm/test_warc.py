import base64
import gzip
import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadflow.llm.warc import list_archives, read_archives, write_archives

PAGES = "page_id long, url string, payload binary, record_type string"
ROWS = [
    (1, "u\r\nx", bytes([31, 139, 8]) * 3000), (2, None, None), (3, "a", None), (4, "z", b"x" * 3_000_000), (5, "c", bytes([31, 139, 8, 0]) * 500_000),
    (6, "big", b"x" * 3_000_000), (7, "small", b"same"), (8, "small", b"same"), (9, "ü 漢", "ü 漢".encode()),
]


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload or b"").digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "clash") for r in ROWS], PAGES)


@pytest.mark.parametrize(("least", "split", "file_bytes"), [(0, 50, 2000), (0, 333, 1 << 20), (5, 100_000, 1 << 28)])
def test_round_trip(spark, pages, least, split, file_bytes):
    files = write_archives(pages, least_bytes=least, file_bytes=file_bytes)
    listed = list_archives(spark, files.first().path.rsplit("/", 1)[0])
    assert {r.length for r in listed.collect()} == {r.length for r in files.collect()}
    got = {r.record_id: r for r in read_archives(listed, split_bytes=split).collect()}
    assert len(got) == len(ROWS) == files.agg(F.sum("records")).first()[0]
    for i, url, payload in ROWS:
        payload = payload or b""
        same = [j for j, _, p in ROWS if (p or b"") == payload and len(payload) >= least]
        r = got[f"urn:page:{i}"]
        first = max(same, default=i)
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", f"urn:page:{first}"))
        assert (r.payload_digest, r.payload_bytes, r.target_uri) == (sha(payload), len(payload), " ".join((url or "").split()))
        assert r.payload == (payload if first == i else None) and r.payload_ok == (True if first == i else None)


def test_files_are_gzip_that_others_read(spark, pages):
    path = write_archives(pages.filter("page_id = 7")).first().path
    with gzip.open(path.removeprefix("file:")) as f:
        assert f.read().startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def test_repeated_and_null_ids(spark):
    rows = [(None, "u", b"p", ""), (4, "u", b"p", ""), (4, "u", b"p", "")]
    got = read_archives(write_archives(spark.createDataFrame(rows, PAGES))).collect()
    assert sorted((r.record_id, r.record_type) for r in got) == [("urn:page:4", "response")] * 2 + [("urn:page:None", "revisit")]


def test_empty_table(spark):
    files = write_archives(spark.createDataFrame([], PAGES))
    assert files.collect() == [] and read_archives(files).collect() == []


def test_damage_between_records_is_passed_over(spark, tmp_path):
    from leadflow.llm.warc import digest, record

    member = record("urn:page:1", "u", b"payload", digest(b"payload"), None, 6)
    (tmp_path / "a.warc.gz").write_bytes(member + b"\x1f\x8b\x08 noise \x1f\x8b\x08" + member + b"\x00" * 50)
    (tmp_path / "b.warc.gz").write_bytes(b"")
    got = read_archives(list_archives(spark, str(tmp_path)), split_bytes=97).collect()
    assert [r.payload for r in got] == [b"payload"] * 2


def test_query(spark, tables):
    from leadflow.llm.queries import QUERIES

    got = {r.page_id: r for r in QUERIES["op1_warc"](spark, tables).collect()}
    rows = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{tables}/pages.parquet").collect()]
    largest = {}
    for i, p in rows:
        largest[p] = max(i, largest.get(p, i))
    assert len(got) == len(rows)
    for i, p in rows:
        want = (len(p), sha(p), *(("response", None) if largest[p] == i else ("revisit", largest[p])))
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want


def test_query_with_a_null_id(spark, tmp_path):
    from leadflow.llm.queries import QUERIES

    rows = [(None, "u", "p"), (4, "u", "p"), (None, "v", "alone")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op1_warc"](spark, str(tmp_path)).collect()
    want = [(None, "revisit", 4), (4, "response", None), (None, "response", None)]
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)


class _Counted:
    def __init__(self, raw):
        self.raw, self.at, self.read_bytes = raw, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.raw[self.at : self.at + n]
        self.read_bytes += len(out)
        return out


def test_bytes_are_read_once():
    from leadflow.llm.warc import _member, _next_member, _Window, digest, record

    payloads = [bytes([i % 251]) * (i % 900) + i.to_bytes(4, "big") * 150 for i in range(6000)]
    raw = b"".join(record(f"urn:page:{i}", "u", p, digest(p), None, 6) for i, p in enumerate(payloads))
    file = _Counted(raw)
    window, records = _Window(file, len(raw)), 0
    at = _next_member(window, 0, len(raw))
    while at is not None:
        _, length = _member(window, at)
        records += 1
        at = _next_member(window, at + length, len(raw))
    assert records == 6000 and file.read_bytes < 1.2 * len(raw)


def test_only_whole_record_heads_count(spark, tmp_path):
    import gzip

    from leadflow.llm.warc import digest, record

    member = record("urn:page:1", "u", b"payload", digest(b"payload"), None, 6)
    false = [gzip.compress(b"WARC/1.1\r\nno fields\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n"), gzip.compress(b"WARC/")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join([false[0], member, false[1], false[2], member]))
    got = read_archives(list_archives(spark, str(tmp_path)), split_bytes=61).collect()
    assert [r.payload for r in got] == [b"payload"] * 2


def test_batches_to_python_are_bounded(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("abcdefghij"), 1000).alias("html"))
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"b": [b.nbytes]}) for b in batches), "b long")
    spark.conf.unset(limit)
    try:
        write_archives(spark.createDataFrame([], "page_id long, url string, payload string"))
        assert max(r.b for r in sizes.collect()) < 9 << 20  # all 30 MB at once without a limit
        spark.conf.set(limit, "1m")  # the session's own
        read_archives(spark.createDataFrame([], "path string, length long")).collect()
        assert spark.conf.get(limit) == "1m"
    finally:
        spark.conf.unset(limit)
