"""Operator 8: WARC archives written and read as a table of record chunks."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, filesystem, shared_folder

PIECE = 1 << 16  # bytes of payload that are in memory at once
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def _pieces(payload: str) -> Iterator[bytes]:
    for i in range(0, len(payload), PIECE):
        yield payload[i : i + PIECE].encode("utf-8", "surrogatepass")


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(folder)
        # A name of its own for each attempt: only files whose rows came back are read, so a lost task leaves no half archive.
        name = f"{top}/{uuid.uuid4().hex}.warc.gz"
        n, out = 0, None
        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                out = out or fs.open_output_stream(name, compression=None)
                html, sha1, size = html or "", hashlib.sha1(), 0
                for x in _pieces(html):
                    sha1.update(x)
                    size += len(x)
                revisit = refers is not None
                head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page is None else page}>", f"WARC-Date: {date}"]
                head += [f"WARC-Target-URI: {''.join(url.split())}"] if url and url.strip() else []
                head += [f"WARC-Payload-Digest: sha1:{_base32(sha1)}", f"WARC-Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
                head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                length = len(HTTP) + (0 if revisit else size)
                out.write(z.compress("\r\n".join([*head, f"Content-Length: {length}", "", ""]).encode("utf-8", "replace") + HTTP))
                for x in () if revisit else _pieces(html):
                    out.write(z.compress(x))
                out.write(z.compress(b"\r\n\r\n") + z.flush())
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rpartition('/')[2]}"], "records": [n]})

    return run


def write_warc(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes one record for each row of ``pages(page_id, url, html)``; returns the manifest ``path, records``.

    Of rows with equal payloads (by SHA-1) of ``min_bytes`` or more, that with the largest page_id is a response and the others
    revisit it; smaller payloads are all responses. Each task writes one archive of gzip members to the shared folder
    and holds one piece of a payload at a time. A null html is an empty payload. Rows that repeat the largest page_id
    are responses too; rows with a null id never become the response of others. An empty table gives no archive. Pages have no time of
    their own, so each record's WARC-Date is ``date``; a record's id is its page's, so pages that repeat an id share one.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("big", F.octet_length("html") >= min_bytes)
    first = cut(p.where("big").groupBy("sha1").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    refers = F.when(F.col("big") & (F.col("page_id").isNull() | (F.col("page_id") != F.col("top"))), F.col("top"))
    rows = p.join(first, "sha1", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    return cut(rows.mapInArrow(_write(shared_folder(spark, "warc"), date), "path string, records long"))


class _Lines:
    """The uncompressed bytes of a file of gzip members, a piece at a time."""

    def __init__(self, stream):
        self.stream, self.z, self.held, self.raw = stream, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
            self.raw = self.raw or self.stream.read(PIECE)
            if not self.raw:
                return False
            got = self.z.decompress(self.raw, PIECE)
            self.raw = b"" if self.z.eof else self.z.unconsumed_tail
            if got:
                self.held += got
                return True

    def head(self) -> dict[str, str] | None:
        """The next record's header lines; none at the end."""
        while b"\r\n\r\n" not in self.held or self.held[:2] == b"\r\n":
            if self.held[:2] == b"\r\n":
                self.held = self.held[2:]
            elif not self._more():
                return None
        block, _, self.held = self.held.partition(b"\r\n\r\n")
        return dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n")[1:])

    def take(self, n: int) -> bytes:
        """At most n bytes, at least one unless the file ends."""
        if not self.held and not self._more():
            raise EOFError("a record ends before its length")
        got, self.held = self.held[:n], self.held[n:]
        return got


def _read(with_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    lines = _Lines(stream)
                    while (h := lines.head()) is not None:
                        left, sha1, size, k = int(h["Content-Length"]), hashlib.sha1(), 0, 0
                        skip = len(HTTP)
                        ident = lambda s: None if s is None or "null" in s else int(s.rpartition(":")[2].rstrip(">"))
                        about = (ident(h["WARC-Record-ID"]), h["WARC-Type"], ident(h.get("WARC-Refers-To")), h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["WARC-Payload-Length"]))
                        while True:
                            data = b""
                            while left and len(data) < PIECE:
                                x = lines.take(min(left, PIECE - len(data) + skip))
                                left -= len(x)
                                data, skip = data + x[skip:], max(0, skip - len(x))
                            sha1.update(data)
                            size += len(data)
                            rows.append((*about, k, size, _base32(sha1), not left, data if with_data else None))
                            held, k = held + len(data), k + 1
                            if not left:
                                break
                        if about[1] == "response" and (rows[-1][7], size) != about[3:]:
                            raise ValueError(f"record {about[0]} of {path} does not have the payload that its digest is of")
                        if held > 64 * PIECE or len(rows) > 5000:
                            yield _table(rows)
                            rows, held = [], 0
                yield _table(rows)

    return run


COLUMNS = {"page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "header_digest": pa.string(), "header_length": pa.int64(), "chunk_no": pa.int32(), "bytes_so_far": pa.int64(), "digest_so_far": pa.string(), "last": pa.bool_(), "data": pa.binary()}
SCHEMA = "page_id long, record_type string, refers_to long, header_digest string, header_length long, chunk_no int, bytes_so_far long, digest_so_far string, last boolean, data binary"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows) if rows else [()] * len(COLUMNS), COLUMNS.values())], list(COLUMNS))


def read_warc(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The record chunks of a manifest's archives: a row for each 64 KB of a payload, numbered from 0, at least one a record.

    ``digest_so_far`` is the SHA-1 of the payload up to and with the chunk, so the row where ``last`` is true has that of all.
    Archives are read as streams; no record is ever whole in memory. A response that doesn't have its digest raises.
    """
    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(_read(with_data), SCHEMA)


def records(manifest: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``: a row for each record, from its last chunk.

    A revisit has no payload; its digest and length are those of its header.
    """
    own = F.col("record_type") == "response"
    last = read_warc(manifest, with_data=False).where("last")
    return last.select("page_id", F.when(own, F.col("bytes_so_far")).otherwise(F.col("header_length")).alias("payload_bytes"), F.when(own, F.col("digest_so_far")).otherwise(F.col("header_digest")).alias("payload_digest"), "record_type", "refers_to")
