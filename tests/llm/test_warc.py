import hashlib
import io
import os
import random

import pyarrow as pa
import pytest

from truegauge.llm import warc


def want(rows):
    last = {}
    for k, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and k is not None:
            last[b] = max(k, last.get(b, k))
    out = []
    for k, _, h in rows:
        b = (h or "").encode()
        revisit = b in last and k != last[b]
        out.append((k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last[b] if revisit else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/\r\nX: y", "x" * 1500), (2, None, "x" * 1500), (2, "u", "x" * 1500), (None, "u", "x" * 1500),
    (3, "http://b/ü ", None), (4, "u", ""), (5, "u", "é" * 500), (6, "u", "é" * 500), (7, "u", "z" * 999), (8, "u", "z" * 999),
    (9, "u", "a\r\n\r\nb" * 40_000), (None, "n", "only null " * 200), (None, "n", "only null " * 200),
]


@pytest.mark.parametrize("size", [64, 1000, 1 << 24])
def test_odd_rows_come_back_once(spark, size):
    pages = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "page_id long, url string, html string, revisit int, last string").repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(pages, range_bytes=size).collect()), key=repr)
    assert got == want(ROWS)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_payload_and_address(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    archives = warc.write_archives(warc.mark_revisits(pages), f"file://{tmp_path}/w")
    rows = warc.read_archives(archives, 700, with_payload=True).collect()
    assert {r.key: r.payload for r in rows}["9"] == ("a\r\n\r\nb" * 40_000).encode()
    assert {r.url for r in rows if r.key == "1"} == {"http://a/%0D%0AX:%20y"}


def test_false_magic_is_no_record():
    rng = random.Random(3)
    members = [warc.record(i, "u", rng.randbytes(3000).hex().encode(), None, False) for i in range(20)]
    data = b"".join(m + warc.MAGIC + b"\x00junk" for m in members)
    archive = warc.Archive(pa.PythonFile(io.BytesIO(data), "r"), len(data))
    for step in (37, 1000, 5000):
        ids = [h["warc-record-id"] for s in range(0, len(data), step) for h, _ in archive.records(s, min(len(data), s + step))]
        assert ids == [f"<urn:page:{i}>" for i in range(20)]


def test_cut_archive_is_an_error():
    data = warc.record(1, "u", os.urandom(4000).hex().encode(), None, False)[:-50]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.Archive(pa.PythonFile(io.BytesIO(data), "r"), len(data)).records(0, len(data)))


def test_query_against_plain_pages(spark, data):
    from truegauge.llm.queries import QUERIES

    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    got = QUERIES["op6_warc"](spark, data).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == want(rows)


def test_very_long_address(spark):
    address = "data:;base64," + random.Random(5).randbytes(300_000).hex()
    pages = spark.createDataFrame([(1, "u", "a"), (2, address, "b"), (3, "u", "c")], "page_id long, url string, html string")
    assert sorted(r.page_id for r in warc.round_trip(pages).collect()) == [1, 2, 3]


def test_archives_of_other_writers(spark, tmp_path):
    import gzip

    def other(kind, block, *lines):
        head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}>", *lines, f"Content-Length: {len(block)}"])
        return gzip.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = "Content-Type: application/http; msgtype=response"
    data = other("warcinfo", b"software: x") + other("response", b"HTTP/1.1 200 OK\r\n\r\npage", http) + other("revisit", b"HTTP/1.1 200 OK\r\n\r\n", http)
    (tmp_path / "o.warc.gz").write_bytes(data)
    archives = spark.createDataFrame([(f"file://{tmp_path}/o.warc.gz", len(data))], "path string, bytes long")
    got = {r.key: (r.record_type, r.payload_bytes, r.payload_digest) for r in warc.read_archives(archives).collect()}
    sha = lambda b: hashlib.sha1(b).hexdigest()
    assert got == {
        "<urn:uuid:warcinfo>": ("warcinfo", 11, sha(b"software: x")),
        "<urn:uuid:response>": ("response", 4, sha(b"page")),
        "<urn:uuid:revisit>": ("revisit", None, None),
    }
