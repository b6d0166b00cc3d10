"""Archives give back what was written, and damage is noticed."""

import gzip
import hashlib
import io
import zlib

import pytest
from pyspark.sql import types as T

from postlake.llm.warc import Damaged, Reader, archive_folder, parsed, read, write

LONG = "ü" * 600


def test_round_trip(spark):
    rows = [(1, "http://a/ x\r\n", LONG), (2, None, LONG), (3, "http://b", LONG), (3, "http://b", LONG), (4, "u", "short"), (5, "u", "short"),
            (6, "u", None), (7, "u", ""), (None, "u", LONG), (8, "u", "x" * 300_000 + "\r\n\r\n"), (9, "u", "y" * 999), (10, "u", "y" * 999)]
    pages = spark.createDataFrame([(*r, b"z") for r in rows], "page_id long, url string, html string, payload binary")
    folder = archive_folder(spark)
    files = write(pages, folder, file_mb=0)
    assert sum(r.records for r in files.collect()) == len(rows)
    got = read(files, folder, T.LongType()).collect()
    assert all(r.valid for r in got)
    want = []
    for page, _, text in rows:
        payload = (text or "").encode()
        revisit = text == LONG and page != 3
        want.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response",
                     3 if revisit else None, None if revisit else payload))
    seen = [(r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is not None else None) for r in got]
    assert sorted(seen, key=repr) == sorted(want, key=repr)
    none = write(pages.limit(0), folder)
    assert none.count() == 0 and read(none, folder).count() == 0


def _archive(tmp=b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"):
    return gzip.compress(tmp)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_reader_frames_records(chunk):
    data = _archive() + _archive(b"WARC/1.0\r\nContent-Length: 0\r\nA: b:c\r\n\r\n\r\n\r\n")
    assert [(h["content-length"], b) for h, b in Reader(io.BytesIO(data), chunk)] == [("3", b"abc"), ("0", b"")]


@pytest.mark.parametrize("data", [
    _archive()[:-9], b"plain", _archive(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nabc\r\n\r\n"), _archive(b"WARC/1.1\r\nContent-Length: 4\r\n\r\nabc\r\n\r\n"),
    _archive(b"WARC/1.1\r\nX: 2\r\n\r\nabc\r\n\r\n"), _archive(b"HTTP\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), _archive() + b"\0",
    zlib.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")])
def test_damage(data):
    with pytest.raises(Damaged):
        list(Reader(io.BytesIO(data)))


def test_wrong_digest_is_not_valid(spark):
    folder = archive_folder(spark)
    files = write(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), folder)
    with open(files.first().path, "rb") as f:
        header, block = next(iter(Reader(f)))
    assert parsed(header, block)["valid"] and not parsed(header, block.replace(b"text", b"taxt"))["valid"]
