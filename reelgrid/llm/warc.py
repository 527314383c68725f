"""WARC archives written from and read back to tables of record chunks.

A payload travels as rows (record, chunk number, bytes), so neither the writer
nor the reader holds a whole record: the writer compresses chunk after chunk,
the reader inflates a few kilobytes at a time and every chunk row carries the
digest of the payload up to its end.  The last chunk's digest is the record's.

Each task writes archives of its own and returns one index row per record
(path, offset, stored bytes).  The index is a table written by Spark, so files
of attempts that failed are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace

CHUNK = 1 << 16
ARCHIVE = 1 << 30
DATE = "1970-01-01T00:00:00Z"
_RECORD = "<urn:page:{}>"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder named as Spark names it."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, n, sha1 (hex), refers_to: of records with equal payloads
    of at least ``least`` bytes, all but the smallest page_id refer to it."""
    own = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("n", F.length("payload"))
    own = own.withColumn("same", F.sha2("payload", 256))
    groups = own.where(F.col("n") >= least).groupBy("same", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1 and first is not null")
    joined = own.join(groups.select("same", "n", "first"), ["same", "n"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "n", F.sha1("payload").alias("sha1"), refers.alias("refers_to"))


def chunk_rows(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row per chunk of a record's payload, in order; an empty payload and that of
    a revisit are one empty chunk."""
    sent = F.when(F.col("refers_to").isNull(), F.col("n")).otherwise(F.lit(0))
    last = F.greatest(F.ceil(sent / size).cast("int") - 1, F.lit(0))
    out = records.withColumn("last", last).withColumn("sent", sent)
    out = out.select("page_id", "url", "sha1", "refers_to", "sent", "last", "payload", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk"))
    return out.select("page_id", "url", "sha1", "refers_to", "sent", "last", "chunk", F.when(F.col("sent") > 0, F.substring("payload", F.col("chunk") * size + 1, F.lit(size))).otherwise(F.lit(b"")).alias("data"))


def _field(value: str) -> str:
    """A header value without control characters."""
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m.group()):02X}", value)


def _head(record: str, url: str | None, sha1: str, refers_to: int | None, sent: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {sent}\r\n\r\n" if refers_to is None else "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(sha1))}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_RECORD.format(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http.encode()) + sent}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


_INDEX = "path string, offset long, stored long"


def write_archives(chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE, level: int = 4) -> DataFrame:
    """Write chunk rows, whole records in order per partition, to ``folder``; returns the
    index (path, offset, stored).  Keep it as a table before it is used twice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = None, ""
        out = pack = None
        at = begin = 0
        index: list[tuple[str, int, int]] = []
        for batch in batches:
            names = ("page_id", "url", "sha1", "refers_to", "sent", "last", "chunk", "data")
            for page, url, sha1, refers, sent, last, chunk, data in zip(*(batch.column(c) for c in names)):
                chunk = chunk.as_py()
                if chunk == 0:
                    if system is None:
                        system, root = file_system(folder)
                        system.create_dir(root, recursive=True)
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        path, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(path, compression=None)
                    begin, digest = at, hashlib.sha1()
                    page_id = page.as_py()
                    record = _RECORD.format(page_id if page_id is not None else f"none-{uuid.uuid4().hex}")
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    packed = pack.compress(_head(record, url.as_py(), sha1.as_py(), refers.as_py(), sent.as_py()))
                    at += out.write(packed) or len(packed)
                raw = data.as_py()
                digest.update(raw)
                packed = pack.compress(raw)
                if chunk == last.as_py():
                    if refers.as_py() is None and digest.hexdigest() != sha1.as_py():
                        raise ValueError(f"chunks of record {record} are not its payload")
                    packed += pack.compress(b"\r\n\r\n") + pack.flush()
                out.write(packed)
                at += len(packed)
                if chunk == last.as_py():
                    index.append((path, begin, at - begin))
        if out is not None:
            out.close()
        if index:
            yield pa.record_batch([pa.array(x) for x in zip(*index)], names=["path", "offset", "stored"])

    return chunks.mapInArrow(run, _INDEX)


class _Inflate:
    """Bytes of one compressed record, read a little at a time."""

    def __init__(self, file, offset: int, stored: int, step: int):
        file.seek(offset)
        self.file, self.rest, self.step, self.z, self.have = file, stored, step, zlib.decompressobj(31), b""

    def more(self) -> bool:
        while True:
            out = self.z.decompress(self.z.unconsumed_tail, self.step) if self.z.unconsumed_tail else b""
            if not out:
                if not self.rest or self.z.eof:
                    return False
                raw = self.file.read(min(self.step, self.rest))
                self.rest -= len(raw)
                out = self.z.decompress(raw, self.step)
            if out:
                self.have += out
                return True

    def until(self, mark: bytes) -> bytes:
        while mark not in self.have:
            if not self.more():
                raise ValueError("a record ends inside its header")
        head, _, self.have = self.have.partition(mark)
        return head

    def take(self, n: int) -> bytes:
        while len(self.have) < n and self.more():
            pass
        out, self.have = self.have[:n], self.have[n:]
        return out


_CHUNKS = "page_id long, record_type string, refers_to long, declared string, chunk int, last boolean, bytes long, digest string"


def read_chunks(index: DataFrame, folder: str, size: int = CHUNK, data: bool = True) -> DataFrame:
    """The records of archives as chunk rows: page_id, record_type, refers_to, declared
    (the digest in the header), chunk, last, bytes (of the payload so far), digest (of
    the payload so far) and, if wanted, data."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        path, file, rows, held = None, None, [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), *([pa.binary()] if data else [])]
            names = ["page_id", "record_type", "refers_to", "declared", "chunk", "last", "bytes", "digest", *(["data"] if data else [])]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for own, offset, stored in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "stored"))):
                if own != path:
                    if file is not None:
                        file.close()
                    path, file = own, system.open_input_file(own)
                part = _Inflate(file, offset, stored, size)
                fields = dict(line.split(": ", 1) for line in part.until(b"\r\n\r\n").decode().split("\r\n")[1:])
                http = part.until(b"\r\n\r\n")
                left = int(fields["Content-Length"]) - len(http) - 4
                number = lambda text: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", text or "")) else None
                head = (number(fields["WARC-Record-ID"]), fields["WARC-Type"], number(fields.get("WARC-Refers-To")), fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                digest, done, chunk = hashlib.sha1(), 0, 0
                while True:
                    raw = part.take(min(size, left))
                    if len(raw) < min(size, left):
                        raise ValueError(f"record {fields['WARC-Record-ID']} is cut short")
                    digest.update(raw)
                    left -= len(raw)
                    done += len(raw)
                    rows.append((*head, chunk, left == 0, done, base32(digest.copy().digest()), *([raw] if data else [])))
                    held += len(raw) if data else 100
                    if held > 1 << 22:
                        yield batch_of(rows)
                        rows, held = [], 0
                    chunk += 1
                    if left == 0:
                        break
        if file is not None:
            file.close()
        if rows:
            yield batch_of(rows)

    return index.mapInArrow(run, _CHUNKS + (", data binary" if data else ""))


def spread(index: DataFrame, run_bytes: int = 1 << 25) -> DataFrame:
    """Index rows dealt to tasks by stretches of an archive, in the order of the file.

    The number of tasks follows the bytes stored, not those of the index."""
    stored = index.agg(F.sum("stored")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-stored // run_bytes))
    return index.repartition(tasks, "path", F.floor(F.col("offset") / run_bytes)).sortWithinPartitions("path", "offset")


def round_trip(pages: DataFrame, least: int = 0, size: int = CHUNK) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder and read
    them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, a null url leaves out the target.  A row without
    page_id is written and read with none; it can be a revisit, never what others
    refer to.  Rows that repeat the smallest page_id of equal payloads are all
    responses.  Records of fewer than ``least`` bytes are responses.  A digest that
    differs from the one in its header is an error.  No rows in give no rows out.
    """
    ws = Workspace(pages.sparkSession)
    folder = ws.path("warc")
    index = ws.keep(write_archives(chunk_rows(decide(pages, least), size), folder))
    records = ws.keep(read_chunks(spread(index), folder, size, data=False).where("last").drop("last", "chunk"))
    of = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("digest").alias("declared")).agg(F.max("bytes").alias("full"))
    found = records.join(of, ["refers_to", "declared"], "left")
    bad = (F.col("record_type") == "response") & (F.col("digest") != F.col("declared")) | (F.col("record_type") == "revisit") & F.col("full").isNull()
    digest = F.when(bad, F.raise_error(F.concat(F.lit("record does not match its digest: "), F.col("declared"))).cast("string")).otherwise(F.col("declared"))
    return found.select("page_id", F.coalesce("full", "bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
