"""WARC archives: written as one gzip stream, normalised to a member per record, indexed, read back.

``write_monolithic`` writes each slice of a table as one WARC file compressed as
a single gzip stream, the form in which no record can be reached alone.
``normalise`` inflates such a stream once, front to back, rewrites every record
as a gzip member of its own and writes a sidecar index (record id, offset,
length) beside the new archive, itself gzipped lines of text.  ``read_archives``
goes by the index: every record is one member at a known offset.

Records with equal payloads of at least ``MIN_REVISIT`` bytes are stored once: the one
with the smallest id is the response, the others are revisit records that name
it.  Which one is found by SHA-256 digests with a grouped minimum, so a payload
that fills a third of the table is one row per map task.

Files go through ``pyarrow.fs`` to the shared folder under a name of their own
and are moved into place, so a repeated or lost task leaves whole files only.

Defined results: null html is an empty payload; null urls are stored as an empty
target.  Rows that share an id are records of their own, ordered by url; rows
equal in all three columns are treated alike.  Ids must not be null (such rows
are left out).
Extra columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftcast.llm.common import BROADCAST_IDS, ship_package, store

MIN_REVISIT = 100
#: Payload bytes of a slice after which a new archive begins.
ARCHIVE_BYTES = 32_000_000
_NAME = "urn:shiftcast:page:"


# ---------------------------------------------------------------- one record

def record_bytes(page: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_NAME}{page}>"),
            ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("WARC-Payload-Length", len(payload))]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{_NAME}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        payload = b""
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length doesn't match its header")
    return fields, rest[:size]


def split_records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Records of an inflated stream, whatever the blocks it comes in; holds one record at a time."""
    have = bytearray()
    need = None
    for block in blocks:
        have += block
        while True:
            if need is None:
                at = have.find(b"\r\n\r\n")
                if at < 0:
                    break
                head = bytes(have[:at]).decode().split("\r\n")
                size = next(int(x.split(": ", 1)[1]) for x in head if x.startswith("Content-Length: "))
                need = at + 4 + size + 4
            if len(have) < need:
                break
            yield bytes(have[:need])
            del have[:need]
            need = None
    if have:
        raise ValueError("archive ends within a record")


# ---------------------------------------------------------------- files

def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class _Out:
    """A file that appears under its name only when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = _place(uri)
        self.own = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.file = self.fs.open_output_stream(self.own, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        self.file.write(data)
        self.size += len(data)
        return len(data)

    def done(self) -> None:
        self.file.close()
        self.fs.move(self.own, self.path)


def write_monolithic(uri: str, records: Iterator[bytes]) -> None:
    """All records in one gzip stream."""
    out = _Out(uri)
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    for r in records:
        out.write(pack.compress(r))
    out.write(pack.flush())
    out.done()


def _inflated(uri: str, block: int = 1 << 18) -> Iterator[bytes]:
    place, path = _place(uri)
    with place.open_input_stream(path, compression=None) as file:
        inflate = zlib.decompressobj(31)
        while data := file.read(block):
            while data:
                yield inflate.decompress(data)
                data = inflate.unused_data
                if inflate.eof:
                    inflate = zlib.decompressobj(31)
                else:
                    break


def normalise(source: str, target: str) -> tuple[int, int]:
    """Rewrite ``source`` with a gzip member per record; the index goes to ``target`` + ``.idx``.

    Returns the numbers of records and of bytes written.
    """
    out, index, n = _Out(target), io.BytesIO(), 0
    with gzip.GzipFile(fileobj=index, mode="wb", mtime=0) as lines:
        for r in split_records(_inflated(source)):
            at = out.size
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.write(pack.compress(r) + pack.flush())
            name = parse_record(r)[0]["WARC-Record-ID"]
            lines.write(f"{name}\t{at}\t{out.size - at}\n".encode())
            n += 1
    out.done()
    side = _Out(f"{target}.idx")
    side.write(index.getvalue())
    side.done()
    return n, out.size


def read_indexed(target: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record of a normalised archive, each by its index entry."""
    place, path = _place(target)
    with place.open_input_stream(f"{path}.idx", compression=None) as file:
        entries = gzip.decompress(file.read()).decode().splitlines()
    with place.open_input_file(path) as file:
        for line in entries:
            name, at, size = line.split("\t")
            file.seek(int(at))
            fields, payload = parse_record(zlib.decompress(file.read(int(size)), 31))
            if fields["WARC-Record-ID"] != name:
                raise ValueError(f"index points to another record: {name}")
            yield fields, payload


# ---------------------------------------------------------------- Spark side

def _archive_rows(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        rows = (r for b in batches for k in range(0, b.num_rows, 100) for r in b.slice(k, 100).to_pylist())
        pending = next(rows, None)
        while pending is not None:
            name = f"{folder}/part-{part:06d}-{count:05d}.warc.gz"

            def some() -> Iterator[bytes]:
                nonlocal pending
                size = 0
                while pending is not None and size < limit:
                    r = pending
                    payload = (r["html"] or "").encode()
                    size += len(payload)
                    digest = hashlib.sha256(payload).hexdigest()
                    yield record_bytes(r["page_id"], r["url"], payload, digest, r["refers_to"])
                    pending = next(rows, None)

            write_monolithic(f"{name}.mono", some())
            n, size = normalise(f"{name}.mono", name)
            place, path = _place(f"{name}.mono")
            place.delete_file(path)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())],
                                             ["archive", "records", "bytes"])
            count += 1
    return run


def _record_rows(batches: Iterator[pa.RecordBatch], payloads: bool = True) -> Iterator[pa.RecordBatch]:
    def number(x: str | None) -> int | None:
        return int(x[1:-1].removeprefix(_NAME)) if x else None

    for batch in batches:
        for name in batch.column(0).to_pylist():
            got: list[dict] = []
            for f, payload in read_indexed(name):
                got.append({"page_id": number(f["WARC-Record-ID"]), "url": f["WARC-Target-URI"],
                            "payload_bytes": int(f["WARC-Payload-Length"]),
                            "payload_digest": f["WARC-Payload-Digest"].removeprefix("sha256:"),
                            "record_type": f["WARC-Type"], "refers_to": number(f.get("WARC-Refers-To")),
                            "payload": payload if payloads else None})
                if f["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != got[-1]["payload_digest"]:
                    raise ValueError(f"payload of {f['WARC-Record-ID']} doesn't match its digest")
                if len(got) == 200:
                    yield pa.RecordBatch.from_pylist(got, _RECORDS)
                    got = []
            if got:
                yield pa.RecordBatch.from_pylist(got, _RECORDS)


_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                      ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def write_archives(pages: DataFrame, folder: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to ``folder``; returns (archive, records, bytes), written once."""
    ship_package(pages.sparkSession)
    place, path = _place(folder)
    place.create_dir(path, recursive=True)
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    key = [F.col("page_id"), F.xxhash64("url").alias("u"), F.xxhash64("html").alias("h")]
    keyed = rows.select(*key, F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n"))
    first = keyed.where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(
        F.min(F.struct("page_id", "u")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    again = store(keyed.join(first, "digest").where(F.struct("page_id", "u") != F.col("first"))
                  .select("page_id", "u", "h", F.col("first.page_id").alias("refers_to")).distinct(), "revisits")
    if again.count() <= BROADCAST_IDS:
        again = F.broadcast(again)
    marked = (rows.withColumns({"u": key[1], "h": key[2]}).join(again, ["page_id", "u", "h"], "left")
              .select("page_id", "url", "html", "refers_to"))
    return store(marked.mapInArrow(_archive_rows(folder, limit), "archive string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives listed in ``archives(archive)``; a revisit's payload is empty.

    Every payload is held against its digest; ``payloads=False`` leaves the column null.
    """
    ship_package(archives.sparkSession)
    n = max(1, archives.count())
    spread = archives.select("archive").repartition(min(n, 10_000))
    return spread.mapInArrow(lambda b: _record_rows(b, payloads), "page_id long, url string, payload_bytes long, payload_digest string, "
                             "record_type string, refers_to long, payload binary")
