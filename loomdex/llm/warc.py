"""WARC archives as a chunked record table.

Each page becomes one WARC/1.1 record. An archive is a table of rows (record, chunk, last, data, sha1): the data of a
record's chunks in order are its bytes, CHUNK of them at most in a row, and all rows in order are a WARC file. sha1 is the
digest of the payload so far. Writing and reading hold one chunk and one digest state, never a whole record. Reading follows
chunks as they come; records that a split of the table tears apart are read once more, brought together by name. A record's
name holds the task that wrote it and its number there, so equal pages, whatever their payloads, never mix.

Of records with equal payloads of MIN_PAYLOAD bytes at least, that with the smallest page_id is a response; others are
revisits without payload, which carry its length and digest in their headers. Copies are found by SHA-1 of the whole
payload, computed by Spark; a hot payload costs one row of its smallest page_id. Digests alone are grouped; up to
MOST_COPIED copied ones (counted) meet the payloads by broadcast, more by a shuffle, whose hot keys Spark splits.

A null html is an empty payload, a null url is about:blank. Rows with a null page_id are responses unless a page_id has
the same payload. Repeated rows keep a record each, all of them responses if they are the smallest page_id; of rows with one
page_id and different payloads each is a record as well. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

CHUNK, MIN_PAYLOAD = 1 << 16, 0
DATE = "1970-01-01T00:00:00Z"
_CHUNKS = pa.schema([("record", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()), ("data", pa.binary()), ("sha1", pa.binary())])
_CHUNKS_DDL = "record string, chunk long, last boolean, data binary, sha1 binary"
_ROWS, MOST_NAMES, MOST_COPIED = 64, 100_000, 100_000


def _id(page) -> str:
    return f"urn:x-page:{'null' if page is None else page}"


def _head(page, url: str | None, sha1: bytes, size: int, first) -> bytes:
    """WARC and HTTP headers of a record; first: the page_id that it revisits."""
    where = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    kind = "response" if first is None else "revisit"
    extra = "" if first is None else f"WARC-Refers-To: <{_id(first)}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
    length = len(http) + (size if first is None else 0)
    digest = base64.b32encode(sha1).decode()
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{_id(page)}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {where}\r\nWARC-Payload-Digest: sha1:{digest}\r\n{extra}Content-Type: application/http; msgtype=response\r\nContent-Length: {length}\r\n\r\n{http}".encode("utf-8", "surrogatepass")


def _write(batches):
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    out = {f.name: [] for f in _CHUNKS}

    def rows():
        batch = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _CHUNKS], schema=_CHUNKS)
        for v in out.values():
            v.clear()
        return batch

    count = 0
    for b in batches:
        for k, (page, url, sha1, first) in enumerate(zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True)):
            buffer = b.column(2)[k].as_buffer()
            payload = memoryview(buffer) if buffer is not None else memoryview(b"")
            head = _head(page, url, bytes.fromhex(sha1), len(payload), first)
            body = payload if first is None else payload[:0]
            state, at, chunk = hashlib.sha1(), 0, 0
            record = f"{_id(page)}#{part}.{count}"  # repeated rows stay apart, also those of other tasks
            count += 1
            while True:
                piece = body[at : at + CHUNK - (len(head) if not chunk and len(head) < CHUNK // 2 else 0)]
                at += len(piece)
                state.update(piece)
                last = at >= len(body)
                data = b"".join((head if not chunk else b"", piece, b"\r\n\r\n" if last else b""))
                for name, v in zip(out, (record, chunk, last, data, state.digest()), strict=True):
                    out[name].append(v)
                chunk += 1
                if len(out["data"]) >= _ROWS:
                    yield rows()
                if last:
                    break
    yield rows()


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record", pa.string())])
_READ_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record string"


class Record:
    """Reads one record chunk by chunk."""

    def __init__(self, data: bytes):
        top, _, rest = data.partition(b"\r\n\r\n")
        self.fields = dict(x.split(": ", 1) for x in top.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        http, _, payload = rest.partition(b"\r\n\r\n")
        self.size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        self.revisit = self.fields["WARC-Type"] == "revisit"
        self.left = int(self.fields["Content-Length"]) - len(http) - 4
        self.got, self.state = 0, hashlib.sha1()
        self.add(payload)

    def add(self, data: bytes) -> None:
        part = memoryview(data)[: self.left]
        self.state.update(part)
        self.left -= len(part)
        self.got += len(part)

    def row(self) -> tuple:
        page = lambda x: None if (n := re.search(r"urn:x-page:(-?\d+|null)", x)[1]) == "null" else int(n)
        told = self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if self.left or not self.revisit and (self.got != self.size or base64.b32encode(self.state.digest()).decode() != told):
            raise ValueError(f"{self.fields['WARC-Record-ID']}: damaged payload")
        size, digest = (self.size, told) if self.revisit else (self.got, base64.b32encode(self.state.digest()).decode())
        refers = page(self.fields["WARC-Refers-To"]) if self.revisit else None
        return page(self.fields["WARC-Record-ID"]), size, digest, self.fields["WARC-Type"], refers, self.fields["WARC-Target-URI"]


def _read(batches):
    """A row for each record that is whole and in order; of others, which a split has torn, only the name."""
    cols = _READ.names

    def rows(done, torn):
        n, m = len(done), len(torn)
        values = [[*(r[i] for r in done), *[None] * m] for i in range(len(cols) - 1)] + [[*[None] * n, *torn]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _READ, strict=True)], schema=_READ)

    record = now = None
    after = 0
    for b in batches:
        done, torn = [], []
        name, chunk, last, sha1 = (b.column(i).to_pylist() for i in (0, 1, 2, 4))
        for k in range(b.num_rows):
            if record is not None and (name[k] != now or chunk[k] != after):
                torn.append(now)
                record = None
            if chunk[k] == 0:
                record, now, after = Record(b.column(3)[k].as_buffer().to_pybytes()), name[k], 1
            elif record is not None:
                record.add(b.column(3)[k].as_buffer())
                after += 1
            else:
                torn.append(name[k])
                continue
            if record.left and not record.revisit and record.state.digest() != sha1[k]:
                raise ValueError(f"{now}: chunk {after - 1} is damaged")
            if last[k]:
                done.append(record.row())
                record = None
        if done or torn:
            yield rows(done, sorted(set(torn)))
    if record is not None:
        yield rows([], [now])


def _read_whole(batches):
    """As _read, of records that are brought together: one that still isn't whole has lost a chunk."""
    for b in _read(batches):
        lost = [x for x in b.column("record").to_pylist() if x is not None]
        if lost:
            raise ValueError(f"{lost[0]}: damaged, chunks are missing or repeated")
        yield b


def write_archive(pages: DataFrame, label: str = "warc") -> DataFrame:
    """The archive of pages(page_id, url, html), written to the shared folder: a chunk table."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html"))
    same = pages.select(F.col("page_id").cast("long").alias("page_id"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("html")).where(F.length("html") >= MIN_PAYLOAD)
    copies = same.groupBy(F.sha1("html").alias("sha1")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("sha1", "first")
    copies = materialise(copies, "warc-copies")
    # first: only where it is another page's
    rows = rows.join(F.broadcast(copies) if copies.count() <= MOST_COPIED else copies, "sha1", "left").select("page_id", "url", "html", "sha1", F.when(F.col("page_id").isNull() | (F.col("first") != F.col("page_id")), F.col("first")).alias("first"))
    archive = materialise(rows.mapInArrow(_write, _CHUNKS_DDL), label)
    discard(copies)
    return archive


def read_archive(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record of a chunk table."""
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    chunks = archive.select(*_CHUNKS.names)
    got = materialise(chunks.mapInArrow(_read, _READ_DDL), "warc-read")
    whole = got.where("record is null").select(*cols)
    names = got.where("record is not null").select("record").distinct()
    count = names.count()
    if not count:
        return whole
    # two names a split at most; up to MOST_NAMES go to every task, more are joined by shuffle
    torn = chunks.join(F.broadcast(names) if count <= MOST_NAMES else names, "record", "left_semi")
    torn = torn.repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(_read_whole, _READ_DDL)
    return whole.unionByName(torn.select(*cols))


def export_files(archive: DataFrame, path: str, files: int = 16) -> DataFrame:
    """Writes an archive as .warc files below path, a URI of a folder that all executors reach; file, records, bytes of each.

    A record lies in one file. A file appears under its name by a rename when it is complete, so a task that runs again
    replaces what a lost one wrote.
    """

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base)
        task = TaskContext.get()
        name = f"{base.rstrip('/')}/part-{task.partitionId():05d}.warc"
        records = size = 0
        with store.open_output_stream(f"{name}.{task.taskAttemptId()}") as out:
            for b in batches:
                for chunk, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    records += chunk == 0
                    size += out.write(data.as_buffer())
        store.move(f"{name}.{task.taskAttemptId()}", name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

    rows = archive.repartition(files, "record").sortWithinPartitions("record", "chunk").select("chunk", "data")
    return rows.mapInArrow(run, "file string, records long, bytes long")
