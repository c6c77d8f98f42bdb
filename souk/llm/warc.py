"""WARC archives (11): a writer, a normaliser of monolithic gzip files, and random access.

``archive`` puts a record for each page into files of one gzip member each. Such a
file can only be read from its beginning. ``normalise`` inflates each file's stream
once, rewrites every record as a member of its own, and writes a sidecar index beside
it (a JSON line for each record: file, offset, length, id, type, URI, date, digest,
what it refers to). ``index`` reads the sidecars as a table, and ``records`` fetches any
rows of it by offset, each member inflated alone.

Records with equal payloads of at least ``at_least`` bytes: that with the largest
page_id is a response, the others are revisits of it (profile identical-payload-digest)
without the payload. Payloads are compared by SHA-256; the digest that records carry is
SHA-1 in base32, as is usual in such files.

A task holds a slice of pages, or one chunk of a stream, never a file. It writes under
a name of its attempt and renames at the end, so a task that runs twice leaves one file.

Edge cases: a null html is an empty payload; a null page_id is smaller than any other,
and is read back as null; rows that tie for the largest page_id of equal payloads are all
responses; repeated rows give repeated records; a null url leaves out the field, blanks
and control characters of a url are percent-encoded; payloads may hold anything, blank
lines and records of their own too, since lengths are followed; an empty table gives no
file and no row; columns beside page_id, url and html aren't read, whatever their
names. A stream that ends within a record or a member, or that isn't WARC, raises an
error that names the file.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.common import scratch, slices, text_of

#: Compressed bytes read from a stream at a time; bytes of records in a file; tasks that normalise at most.
CHUNK, FILE_BYTES, TASKS = 16 << 10, 256 << 20, 10_000
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
ENTRY = "file string, offset long, length long, id string, type string, uri string, date string, digest string, refers_to string"


def decided(pages: DataFrame, at_least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, n_bytes, sha1 (hex), response_id (of rows that revisit it, else null).

    The group table has a row for each payload that occurs more than once; a payload of a
    third of all rows is one row there, and Spark splits its side of the join.
    """
    payload = text_of(html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("n_bytes"), F.sha1(payload.cast("binary")).alias("sha1"), F.unhex(F.sha2(payload, 256)).alias("_key"))
    groups = rows.filter(F.col("n_bytes") >= at_least).groupBy("_key").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).filter("_n > 1 and _last is not null")
    revisits = F.coalesce(F.col("page_id") < F.col("_last"), F.col("_last").isNotNull())
    return rows.join(groups, "_key", "left").select("page_id", "url", "payload", "n_bytes", "sha1", F.when(revisits, F.col("_last")).alias("response_id"))


def record_id(page_id: int | None, digest: str, kind: str) -> str:
    return f"<urn:x-{kind}:{'null' if page_id is None else page_id}:{digest}>"


def page_of(identifier: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-\w+:(-?\d+):\w+>", identifier or "")
    return int(found[1]) if found else None


def _head(fields: list[tuple[str, str | None]]) -> bytes:
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, n_bytes: int, sha1: str, response_id: int | None, date: str) -> bytes:
    """A whole response, or a revisit with the headers of its page alone."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    kind = "response" if response_id is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + payload if response_id is None else http
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest, kind)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if response_id is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(response_id, digest, "response"))]
    return _head([*fields, ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def _own_name() -> tuple[int, str]:
    context = TaskContext.get()
    return (context.partitionId(), str(context.taskAttemptId())) if context else (0, uuid.uuid4().hex)


def archive(rows: DataFrame, out: str, date: str = DATE, level: int = 6) -> DataFrame:
    """Writes rows of ``decided`` into files of one gzip member each under ``out``, a
    folder that all machines see; returns their names: file, n_records."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(out)
        part, attempt = _own_name()
        made: list[tuple[str, int]] = []
        sink = gz = None
        size = n = 0

        def close() -> None:
            name = f"part-{part:08d}-{len(made):05d}.warc.gz"
            sink.write(gz.flush())
            sink.close()
            fs.move(f"{folder}/_{part}-{attempt}", f"{folder}/{name}")
            made.append((name, n))

        for batch in slices(batches, "payload"):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, payload, n_bytes, sha1, response_id = row
                if sink is None:
                    fs.create_dir(folder)
                    sink, gz, n = fs.open_output_stream(f"{folder}/_{part}-{attempt}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0
                    told = b"software: souk\r\n"
                    first = _head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{part}:{len(made)}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(told)))]) + told + b"\r\n\r\n"
                    sink.write(gz.compress(first))
                    size = len(first)
                data = record(page_id, url, payload.encode(), n_bytes, sha1, response_id, date)
                sink.write(gz.compress(data))
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    close()
                    sink = None
        if sink is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["file", "n_records"])

    columns = rows.select("page_id", "url", "payload", "n_bytes", "sha1", "response_id")
    return _listed(columns, work, out, "file string, n_records long")


def _listed(rows: DataFrame, work: Callable, out: str, kinds: str) -> DataFrame:
    """What ``work`` tells of its files, in a table beside them."""
    rows.mapInArrow(work, kinds).write.parquet(f"{out}/_manifest")
    return rows.sparkSession.read.schema(kinds).parquet(f"{out}/_manifest")


class Stream:
    """The bytes of a gzip file, inflated once from its beginning to its end; it may have
    any number of members. 16 KiB of deflated bytes hold at most 17 MB."""

    def __init__(self, source, name: str):
        self.source, self.name = source, name
        self.z, self.begun, self.held = zlib.decompressobj(31), False, b""

    def _more(self) -> bool:
        while True:
            data = self.z.unused_data if self.z.eof else b""
            data = data or self.source.read(CHUNK)
            if not data:
                if self.begun and not self.z.eof:
                    raise ValueError(f"{self.name}: the stream ends within a member")
                return False
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            self.begun = True
            try:
                got = self.z.decompress(data)
            except zlib.error as error:
                raise ValueError(f"{self.name}: {error}") from error
            if got:
                self.held += got
                return True

    def line(self) -> bytes | None:
        """Up to and without the next line's end; null at the end of the stream."""
        seen = 0
        while (at := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held)
            if not self._more():
                if self.held:
                    raise ValueError(f"{self.name}: the stream ends within a record's head")
                return None
        out, self.held = self.held[:at], self.held[at + 1 :]
        return out.removesuffix(b"\r")

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in chunks."""
        while n:
            if not self.held and not self._more():
                raise ValueError(f"{self.name}: the stream ends within a record's block")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part

    def head(self) -> tuple[bytes, dict[str, str]] | None:
        """The next record's head as written, and its fields by lower-case name."""
        while (line := self.line()) == b"":
            pass
        if line is None:
            return None
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{self.name}: no WARC record begins with {line[:20]!r}")
        lines = [line]
        while line := self.line():
            lines.append(line)
        if line is None:
            raise ValueError(f"{self.name}: the stream ends within a record's head")
        return b"\r\n".join(lines) + b"\r\n\r\n", fields_of(lines[1:])


def fields_of(lines: list[bytes]) -> dict[str, str]:
    """Named fields; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t"):
            out[name] = f"{out.get(name, '')} {text.strip()}".strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def normalise(spark: SparkSession, source: str, files: DataFrame, out: str, level: int = 6) -> DataFrame:
    """Rewrites the named files of the folder ``source`` into ``out``, each with its
    sidecar: file, n_records. A file is one task's, since a stream has one beginning;
    records pass through it in chunks."""

    def rewrite(fs, folder: str, name: str, stream: Stream, attempt: str) -> int:
        data, side = (f"{folder}/_{attempt}-{name}{end}" for end in ("", ".index"))
        n = at = 0
        with fs.open_output_stream(data, compression=None) as sink, fs.open_output_stream(side, compression=None) as sidecar:
            while found := stream.head():
                head, fields = found
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                parts = [gz.compress(head)]
                size = sum(map(len, parts))
                sink.write(parts[0])
                for chunk in stream.take(int(fields.get("content-length") or 0)):
                    got = gz.compress(chunk)
                    size += len(got)
                    sink.write(got)
                got = gz.compress(b"\r\n\r\n") + gz.flush()
                sink.write(got)
                size += len(got)
                told = {"file": name, "offset": at, "length": size, "id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "digest": fields.get("warc-payload-digest"), "refers_to": fields.get("warc-refers-to")}
                sidecar.write(json.dumps(told).encode() + b"\n")
                n, at = n + 1, at + size
        fs.move(data, f"{folder}/{name}")
        fs.move(side, f"{folder}/{name}.index")
        return n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (origin, inside), (fs, folder) = pyarrow.fs.FileSystem.from_uri(source), pyarrow.fs.FileSystem.from_uri(out)
        _, attempt = _own_name()
        for batch in batches:
            for name in batch.column("file").to_pylist():
                fs.create_dir(folder)
                with origin.open_input_stream(f"{inside}/{name}", compression=None, buffer_size=1 << 20) as raw:
                    n = rewrite(fs, folder, name, Stream(raw, name), attempt)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["file", "n_records"])

    names = files.select("file")
    return _listed(names.repartition(max(1, min(TASKS, names.count()))), work, out, "file string, n_records long")


def index(spark: SparkSession, out: str) -> DataFrame:
    """The sidecars of a folder as a table."""
    return spark.read.schema(ENTRY).json(f"{out}/*.index")


def records(entries: DataFrame, out: str) -> DataFrame:
    """The response and revisit records that rows of ``index`` name, each read at its
    offset alone: page_id, url, record_type, payload_bytes, payload_digest, refers_to (the
    response's page_id), payload (null of a revisit), sound (whether the payload has the
    digest and length that the record tells). A response's bytes and digest are counted
    anew; those of a revisit are what its headers tell."""

    def one(data: bytes, entry: dict) -> tuple:
        head, _, block = zlib.decompress(data, 31).partition(b"\r\n\r\n")
        fields = fields_of(head.split(b"\r\n")[1:])
        http, _, payload = block[: int(fields.get("content-length", 0))].partition(b"\r\n\r\n")
        told = int(fields_of(http.split(b"\r\n")[1:]).get("content-length", 0))
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        page, refers = page_of(fields.get("warc-record-id")), page_of(fields.get("warc-refers-to"))
        if entry["type"] == "revisit":
            return page, fields.get("warc-target-uri"), "revisit", told, digest, refers, None, True
        own = base64.b32encode(sha1_of(payload)).decode()
        return page, fields.get("warc-target-uri"), "response", len(payload), own, None, payload, (own, len(payload)) == (digest, told)

    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "sound"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(out)
        name = source = None

        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            held, size = [], 0
            for entry in batch.to_pylist():
                if entry["file"] != name:
                    if source is not None:
                        source.close()
                    name, source = entry["file"], fs.open_input_file(f"{folder}/{entry['file']}")
                source.seek(entry["offset"])
                held.append(one(source.read(entry["length"]), entry))
                size += held[-1][3]
                if size >= 4 << 20:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)
        if source is not None:
            source.close()

    wanted = entries.filter("type in ('response', 'revisit')").select("file", "offset", "length", "type")
    return wanted.mapInArrow(work, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, sound boolean")


def sha1_of(data: bytes) -> bytes:
    from hashlib import sha1

    return sha1(data).digest()


def round_trip(pages: DataFrame, at_least: int = 0, date: str = DATE) -> DataFrame:
    """``records`` of all pages, through monolithic files, normalised files and their index."""
    spark = pages.sparkSession
    raw, out = scratch(spark, "warc-raw"), scratch(spark, "warc")
    files = archive(decided(pages, at_least), raw, date)
    if files.isEmpty():
        return records(spark.createDataFrame([], ENTRY), out)
    normalise(spark, raw, files, out)
    return records(index(spark, out), out)
