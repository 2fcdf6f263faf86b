"""WARC archives: a sequential reader, and a writer of response and revisit records.

An archive is a run of gzip members with one record each.  The reader takes
and inflates a member piece by piece, cuts the record's block by its
Content-Length, hashes block and payload on the way and compares the digests
with those declared.  Small archives may travel as rows with a binary column
(:func:`read_archives`); :func:`read_files` opens archive files in the tasks and
holds 64 KB of them at a time, whatever their size.

Defined results: a null archive has no records.  A record that is damaged is
reported with ``error`` set; after a member that can't be inflated the rest of
its archive is skipped, since where the next member begins isn't known.
``digest_ok`` is null where no payload digest could be verified (no payload in
the archive, as for a revisit, or no digest declared), and false where that or
the block's digest is wrong.  A revisit's ``payload_bytes`` is what its
``X-Payload-Length`` field says, which this writer adds (null in archives
without it).  Heads of a record, and of the HTTP response in it, may have 1 MB
at most; a record with a longer one has an error.  Repeated rows make repeated
records; extra columns are never read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
import hashlib
import io
from typing import BinaryIO
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PIECE = 1 << 16
_MOST_HEAD = 1 << 20
_DATE = "2020-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:scrubjay:record:"
RECORD_SCHEMA = (
    "archive string, offset long, length long, record_type string, record_id string, target_uri string, refers_to string, "
    "content_length long, payload_bytes long, payload_digest string, digest_ok boolean, payload binary, error string"
)
_NAMES = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
_ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD_SCHEMA.split(", "))])


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(record_id: str, uri: str, payload: bytes, refers_to: str | None = None, level: int = 6) -> bytes:
    """One gzip member: a response with the payload, or a revisit without."""
    digest = digest_text(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <{_ID}{record_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_clean(uri)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_text(hashlib.sha1(block).digest())}",
    ]
    if refers_to:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{_ID}{refers_to}>", f"X-Payload-Length: {len(payload)}"]
    head.append(f"Content-Length: {len(block)}")
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


class _Source:
    """What is left of an archive: bytes handed back, then those of ``read``."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.back, self.at = read, b"", 0

    def take(self) -> bytes:
        piece, self.back = self.back or self.read(_PIECE), b""
        self.at += len(piece)
        return piece

    def hand_back(self, piece: bytes) -> None:
        self.back, self.at = piece + self.back, self.at - len(piece)


class _Member:
    """Inflates the next gzip member of a source, on demand."""

    def __init__(self, source: _Source):
        self.source, self.inflate, self.held = source, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Inflate another piece; False at the member's end."""
        while not self.inflate.eof:
            tail = self.inflate.unconsumed_tail or self.source.take()
            if not tail:
                raise ValueError("the archive ends within a record")
            got = self.inflate.decompress(tail, _PIECE * 4)
            if self.inflate.eof:
                self.source.hand_back(self.inflate.unused_data)
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with a mark."""
        seen = 0
        while (found := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark))
            if len(self.held) > _MOST_HEAD or not self.more():
                raise ValueError("the record has no end of its head")
        out, self.held = self.held[: found + len(mark)], self.held[found + len(mark) :]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.held and not self.more():
                raise ValueError("the record is shorter than its Content-Length")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece

    def end(self) -> None:
        """Go to the member's end, before which nothing may be left but the record's end."""
        while self.more():
            if len(self.held) > 4:
                break
        if self.held != b"\r\n\r\n":
            raise ValueError("the record isn't followed by its end and the member's")

    def skip(self) -> None:
        """Go to the member's end, whatever is left in it."""
        self.held = b""
        while self.more():
            self.held = b""


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("the record doesn't begin with WARC/")
    return {k.strip().lower(): v.strip() for k, sep, v in (line.partition(":") for line in lines[1:]) if sep}


def _one(member: _Member, keep_payload: bool) -> dict:
    fields = _fields(member.until(b"\r\n\r\n"))
    found = {
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id", "").strip("<>").removeprefix(_ID) or None,
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to", "").strip("<>").removeprefix(_ID) or None,
        "payload_digest": fields["warc-payload-digest"].rpartition(":")[2] if "warc-payload-digest" in fields else None,
    }
    if not fields.get("content-length", "").isdecimal():
        return found | {"error": "the record has no Content-Length"}
    size = int(fields["content-length"])
    found["content_length"] = size
    has_head = "application/http" in fields.get("content-type", "")
    whole, own, kept, head, in_head, n = hashlib.sha1(), hashlib.sha1(), [], bytearray(), has_head, 0
    try:
        for piece in member.exactly(size):
            whole.update(piece)
            if in_head:
                seen = max(0, len(head) - 3)
                head += piece
                if (cut := head.find(b"\r\n\r\n", seen)) < 0:
                    if len(head) > _MOST_HEAD:
                        raise ValueError("the response has no end of its head")
                    continue
                piece, in_head = bytes(head[cut + 4 :]), False
            own.update(piece)
            n += len(piece)
            if keep_payload:
                kept.append(piece)
    except ValueError as e:
        return found | {"error": str(e)}
    if found["record_type"] == "revisit":
        length = fields.get("x-payload-length", "")
        found |= {"payload_bytes": int(length) if length.isdecimal() else None}
    else:
        found |= {"payload_bytes": n, "payload": b"".join(kept) if keep_payload else None}
        if found["payload_digest"]:
            found["digest_ok"] = found["payload_digest"].upper() == digest_text(own.digest())
    block = fields.get("warc-block-digest", "").rpartition(":")[2]
    if block and block.upper() != digest_text(whole.digest()):
        found["digest_ok"] = False
    return found


def read_stream(read: Callable[[int], bytes], keep_payload: bool = False) -> Iterator[dict]:
    """The records of an archive, one after another; ``read`` gives its next bytes, as many as asked for at most."""
    source = _Source(read)
    while first := source.take():
        source.hand_back(first)
        at = source.at
        member, found = _Member(source), {}
        try:
            found = _one(member, keep_payload)
            if found.get("error"):
                member.skip()
            else:
                member.end()
        except (ValueError, zlib.error) as e:
            found["error"] = found.get("error") or str(e)
            try:
                member.skip()
            except (ValueError, zlib.error):
                while source.take():  # where the next member begins isn't known
                    pass
        yield found | {"offset": at, "length": source.at - at}


def read_archive(data: bytes, keep_payload: bool = False) -> Iterator[dict]:
    """The records of an archive in memory."""
    return read_stream(io.BytesIO(data).read, keep_payload)


def read_archives(archives: DataFrame, name: str = "archive", data: str = "data", keep_payload: bool = False) -> DataFrame:
    """One row per record (``RECORD_SCHEMA``) of a table with an archive in each row."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict]]:
        for batch in batches:
            for own, value in zip(batch.column(0), batch.column(1), strict=True):
                if value.is_valid:
                    yield from ((own.as_py(), found) for found in read_archive(value.as_py(), keep_payload))

    return archives.select(F.col(name).cast("string").alias("archive"), F.col(data).alias("data")).mapInArrow(lambda batches: _batched(records(batches)), RECORD_SCHEMA)


def _batched(records: Iterator[tuple[str, dict]], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size."""
    rows: list[dict] = []
    held = 0
    for archive, found in records:
        rows.append({n: found.get(n) for n in _NAMES} | {"archive": archive})
        held += 200 + len(found.get("payload") or b"")
        if held > most_bytes:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)
            rows, held = [], 0
    yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _open(path: str):
    """A file of any store that Arrow reads, as a stream."""
    system, place = pafs.FileSystem.from_uri(path)
    return system.open_input_stream(place, compression=None)


def read_files(spark: SparkSession, path: str, keep_payload: bool = False, opener: Callable[[str], BinaryIO] = _open) -> DataFrame:
    """Records of ``.warc.gz`` files, each read as a stream by the task that has its path.

    Spark lists the files; ``opener`` opens one by its path in a task, by
    Arrow's file systems if nothing else is given.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict]]:
        for batch in batches:
            for own in batch.column(0).to_pylist():
                with opener(own) as stream:
                    yield from ((own, found) for found in read_stream(stream.read, keep_payload))

    paths = spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"))  # names only
    return paths.repartition("archive").mapInArrow(lambda batches: _batched(records(batches)), RECORD_SCHEMA)


def write_archives(pages: DataFrame, record_id: str, uri: Column, payload: Column, least_bytes: int = 0, archive_bytes: int = 8 << 20, level: int = 6) -> DataFrame:
    """Archives (archive, data, n_records) with a record per row of ``pages``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, that with
    the largest id is stored as response and the others revisit it; rows tied
    on that id are responses, and so are all rows of a payload that has only
    null ids.  The payloads are shuffled once, by their digest; a digest that
    many rows share is a skewed join key, which Spark splits.
    """
    rows = pages.select(F.col(record_id).alias("id"), F.coalesce(uri, F.lit("")).alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("n", F.octet_length("payload"))
    first = pages.select(F.col(record_id).alias("id"), payload.alias("payload")).select("id", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").alias("n"))
    first = first.groupBy("digest", "n").agg(F.max("id").alias("first"))
    revisit = (F.col("n") >= least_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    chosen = rows.join(first, ["digest", "n"]).select(F.col("id").cast("string"), "uri", "payload", F.when(revisit, F.col("first").cast("string")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.record_batch({"archive": [f"{part:06d}-{number:06d}"], "data": pa.array([b"".join(held)], pa.binary()), "n_records": pa.array([len(held)], pa.int64())})

        for batch in batches:
            for own, link, data, other in zip(*batch.columns, strict=True):
                held.append(record(own.as_py() or "", link.as_py(), data.as_py(), other.as_py(), level))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield out()
                    number, held, size = number + 1, [], 0
        if held:
            yield out()

    return chosen.mapInArrow(write, "archive string, data binary, n_records long")
