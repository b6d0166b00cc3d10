"""WARC archives: written one gzip member per record, read back record by record."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.shared import parts, scratch, stored

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
CHUNK = 1 << 16


class Damaged(ValueError):
    """An archive that breaks the format."""


def _record(page, url: str | None, payload: bytes, digest: bytes, refers_to, date: str) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url}')}>",
            "WARC-Date": date, "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
            "WARC-Payload-Digest": f"sha1:{base64.b32encode(digest).decode()}",
            "WARC-Block-Digest": f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"}
    if page is not None:
        head["Page-ID"] = str(page)
    if url is not None:
        head["WARC-Target-URI"] = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    if revisit:
        head |= {"WARC-Profile": PROFILE, "Refers-To-Page-ID": str(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode()
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", page: str = "html",
          least: int = 1000, file_mb: int = 64, date: str = EPOCH) -> DataFrame:
    """Write a record for each page into archives below ``folder``, which all executors reach.

    Of pages whose payloads (the UTF-8 of ``page``, null: empty) are equal and have ``least`` bytes or more, the one
    with the largest key is written whole, the others refer to it. Rows that repeat it and rows of such a
    payload whose keys are all null are written whole as well. A null url gives a record without one. Each task
    writes files of about ``file_mb`` MB of its own; a repeated attempt writes others. Returns the files that
    count (``path``, ``records``, ``bytes``), stored; no page gives no file.
    """
    rows = pages.select(F.col(key).alias("page"), F.col(url).alias("url"),
                        F.coalesce(F.col(page), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    same = (rows.where(F.octet_length("payload") >= least).groupBy("digest")
            .agg(F.max("page").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n"))
    refers = F.when(F.col("page").isNull() | (F.col("page") != F.col("keeper")), F.col("keeper"))
    joined = rows.join(same, "digest", "left").select("page", "url", "payload", "digest", refers.alias("refers_to"))

    def archive(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        out, path, n, size, number = None, "", 0, 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_pylist([{"path": path, "records": n, "bytes": size}])

        for batch in got:
            columns = (batch.column(c).to_pylist() for c in ("page", "url", "payload", "digest", "refers_to"))
            for values in zip(*columns, strict=True):
                record = _record(*values, date)
                if out is None:
                    store.create_dir(base, recursive=True)
                    path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    out, n, size, number = store.open_output_stream(path, compression=None), 0, 0, number + 1
                out.write(record)
                n, size = n + 1, size + len(record)
                if size >= file_mb << 20:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return stored(joined.mapInArrow(archive, "path string, records long, bytes long"), "archives")


class Reader:
    """Records of one archive in order, from a stream that is read forward in chunks.

    Each record must be one gzip member: a header, then as many bytes as its length says, then two line ends.
    """

    def __init__(self, stream, chunk: int = CHUNK):
        self.stream, self.chunk, self.raw = stream, chunk, b""

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while self._more():
            yield self._member()

    def _more(self) -> bool:
        self.raw = self.raw or self.stream.read(self.chunk)
        return bool(self.raw)

    def _member(self) -> tuple[dict[str, str], bytes]:
        inflate, head, header, body, left = zlib.decompressobj(31), bytearray(), None, bytearray(), 0
        while not inflate.eof:
            if not self._more():
                raise Damaged("the archive ends within a record")
            try:
                data = inflate.decompress(self.raw, CHUNK)
            except zlib.error as error:
                raise Damaged(f"not a gzip member: {error}") from None
            self.raw = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if header is None:
                head += data
                end = head.find(b"\r\n\r\n")
                if end < 0:
                    continue
                header = _header(bytes(head[:end]))
                left, data = int(header["content-length"]) + 4, bytes(head[end + 4:])
            if len(data) > left:
                raise Damaged("a record is longer than its length says")
            body += data
            left -= len(data)
        if header is None or left or body[-4:] != b"\r\n\r\n":
            raise Damaged("a record is shorter than its length says")
        return header, bytes(body[:-4])


def _header(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise Damaged("a record does not begin with its version")
    found = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise Damaged(f"not a header line: {line[:80]!r}")
        found[name.strip().lower()] = value.strip()
    if not found.get("content-length", "").isdigit():
        raise Damaged("a record without a length")
    return found


def _digest(text: str) -> str:
    kind, _, value = text.partition(":")
    if kind.lower() != "sha1":
        raise Damaged(f"a digest of kind {kind}")
    return base64.b32decode(value).hex()


def parsed(header: dict[str, str], block: bytes) -> dict:
    """A record as a row; ``valid``: its digests are those of what it holds."""
    kind = header.get("warc-type")
    http, split, payload = block.partition(b"\r\n\r\n")
    length = next((int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")), None)
    if kind not in ("response", "revisit") or not split or length is None:
        raise Damaged(f"a record that is neither a response nor a revisit of one: {kind}")
    digest = _digest(header["warc-payload-digest"])
    valid = hashlib.sha1(block).hexdigest() == _digest(header["warc-block-digest"])
    if kind == "response":
        valid = valid and hashlib.sha1(payload).hexdigest() == digest and len(payload) == length
    return {"page": header.get("page-id"), "url": header.get("warc-target-uri"), "record_type": kind, "payload_bytes": length,
            "payload_digest": digest, "refers_to": header.get("refers-to-page-id"),
            "payload": payload if kind == "response" else None, "valid": valid}


def read(files: DataFrame, folder: str, key_type: T.DataType | None = None, payload: bool = True) -> DataFrame:
    """Records of the archives listed in ``path``, each archive read forward once in chunks.

    Returns ``page`` and ``refers_to`` (of ``key_type``), ``url``, ``record_type``, ``payload_bytes``, ``payload_digest`` (of
    the full payload, also for revisits), ``payload`` (null for revisits; left out unless asked for) and ``valid``. An
    archive that breaks the format fails the job; a digest that does not fit its content makes its row not valid.
    """
    names = ["page", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "valid"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.bool_()]
    shape = pa.schema([(n, k) for n, k in zip(names, kinds, strict=True) if payload or n != "payload"])

    def records(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in got:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for header, block in Reader(stream):
                        rows.append(parsed(header, block))
                        size += len(block) if payload else 200
                        if size >= 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, shape)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, shape)

    text = "page string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, "
    spread = files.select("path").repartition(max(parts(files), files.sparkSession.sparkContext.defaultParallelism), "path")
    found = spread.mapInArrow(records, text + ("payload binary, " if payload else "") + "valid boolean")
    kind = key_type or T.StringType()
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page", "refers_to")})


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared one, as an address that tasks can open."""
    path = scratch(spark, "warc")
    return path if "://" in path else f"file://{path}"
