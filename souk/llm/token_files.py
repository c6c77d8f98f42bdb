"""Token-ID files (2): fixed-width bit packing.

A file holds documents in ascending order of their ids. Each token id takes the
fewest bits that hold every id of the vocabulary; blocks of ``BLOCK`` ids start
at byte offsets kept in the footer, so a block is found and unpacked alone, in
one vectorised step. Layout, little-endian:

    b"SOUKTOK1" | blocks | footer | footer's length uint64 | b"SOUKTOK1"
    footer: bits uint32, block uint32, n_docs uint64, n_tokens uint64, n_blocks uint64,
            doc ids int64[n_docs], token starts uint64[n_docs], block offsets uint64[n_blocks + 1]

Both directions hold one block row of a file at a time: a writer puts out blocks as
they fill, a reader opens a file by its path, reads its footer, and then the blocks
of about a million tokens at once.

Edge cases: a null or empty text is the end id alone; a null doc_id sorts first
and is read back as null; repeated rows are documents of their own, those of one
id ordered by a hash of the text and the text; a text of any length is one
document, encoded whole; an empty table gives no file and no row; columns beside
the id and the text aren't read, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souk.llm.common import scratch, slices, text_of
from souk.llm.token_cache import library_encoder, vocabulary_size

MAGIC = b"SOUKTOK1"
BLOCK = 4096
#: Tokens after which a task begins a further file, and those that a reader unpacks at a time.
FILE_TOKENS, READ_TOKENS = 64 << 20, 1 << 20
#: Tasks that read files at most.
READERS = 10_000
NO_ID = -(1 << 63)


def width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, ``bits`` each, least significant bit first."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    padded = np.zeros((n, 32), np.uint8)
    padded[:, :bits] = planes
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Writes one file; blocks leave memory as they fill."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits = sink, bits
        self.docs: list[int] = []
        self.starts: list[int] = []
        self.offsets = [len(MAGIC)]
        self.pending: list[np.ndarray] = []
        self.waiting = self.n_tokens = 0
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.starts.append(self.n_tokens)
        self.n_tokens += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 64 * BLOCK:
            self.flush(self.waiting // BLOCK * BLOCK)

    def flush(self, n: int) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        for at in range(0, n, BLOCK):
            packed = pack(ids[at : min(at + BLOCK, n)], self.bits)
            self.sink.write(packed)
            self.offsets.append(self.offsets[-1] + len(packed))
        self.pending, self.waiting = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self.flush(self.waiting)
        footer = struct.pack("<IIQQQ", self.bits, BLOCK, len(self.docs), self.n_tokens, len(self.offsets) - 1)
        footer += np.array(self.docs, "<i8").tobytes() + np.array(self.starts, "<u8").tobytes() + np.array(self.offsets, "<u8").tobytes()
        self.sink.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.sink.close()


class Reader:
    """Random access to a file: the footer is read at once, blocks when asked for.
    ``source`` can seek, tell and read."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        tail = self._read(max(0, size - 16), 16)
        if size < 24 or tail[8:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        (length,) = struct.unpack("<Q", tail[:8])
        footer = self._read(size - 16 - length, length)
        self.bits, self.block, n_docs, self.n_tokens, n_blocks = struct.unpack_from("<IIQQQ", footer)
        self.docs = np.frombuffer(footer, "<i8", n_docs, 32)
        self.starts = np.frombuffer(footer, "<u8", n_docs, 32 + 8 * n_docs).astype(np.int64)
        self.offsets = np.frombuffer(footer, "<u8", n_blocks + 1, 32 + 16 * n_docs).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids start .. end of the file; only the blocks they lie in are unpacked."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        origin = int(self.offsets[first])
        data = self._read(origin, int(self.offsets[last + 1]) - origin)
        cut = self.offsets[first : last + 2] - origin
        out = [unpack(data[cut[i] : cut[i + 1]], min(self.block, self.n_tokens - (first + i) * self.block), self.bits) for i in range(last - first + 1)]
        return np.concatenate(out)[start - first * self.block : end - first * self.block]

    def ends(self) -> np.ndarray:
        return np.append(self.starts[1:], self.n_tokens)


def write(docs: DataFrame, out: str, vocabulary_path: str, end_id: int = 2, vocabulary: int | None = None, special: tuple[str, ...] = ("<|endoftext|>",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes ``docs`` into files under ``out`` (a folder that all machines
    see); returns the manifest: part, piece, file, n_docs, n_tokens, base (tokens
    of all files before). ``vocabulary``: its number of ids, by default that of the file.

    One range shuffle of the texts by id. Each task writes under a name of its
    attempt and renames at the end, so a task that runs twice leaves one file.
    """
    bits = width(max(vocabulary or vocabulary_size(vocabulary_path), end_id + 1))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary_path, special, words=False)
        fs, folder = pyarrow.fs.FileSystem.from_uri(out)
        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, uuid.uuid4().int)
        made: list[tuple] = []
        writer = None

        def close() -> None:
            name = f"{folder}/part-{part:08d}-{len(made):05d}"
            writer.close()
            fs.move(f"{folder}/_{part}-{attempt}", f"{name}.tok")
            made.append((part, len(made), f"part-{part:08d}-{len(made):05d}.tok", len(writer.docs), writer.n_tokens))

        for batch in slices(batches):
            ids, starts = encoder.encode(batch.column("text"))
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                if writer is None:
                    fs.create_dir(folder)
                    writer = Writer(fs.open_output_stream(f"{folder}/_{part}-{attempt}"), bits)
                writer.add(doc_id, np.append(ids[starts[i] : starts[i + 1]], np.uint32(end_id)))
                if writer.n_tokens >= FILE_TOKENS:
                    close()
                    writer = None
        if writer is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["part", "piece", "file", "n_docs", "n_tokens"])

    manifest = f"{out}/_manifest"
    kinds = "part long, piece long, file string, n_docs long, n_tokens long"
    rows.mapInArrow(work, kinds).write.parquet(manifest)
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not for each document
    return docs.sparkSession.read.schema(kinds).parquet(manifest).withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """The documents of the files under ``out``: doc_id, start (tokens of all
    documents before), ids (binary, little-endian 32-bit), n_tokens. Tasks get
    names of files and open them by path."""
    files = manifest.select("file", "base").repartition(max(1, min(READERS, manifest.count())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(out)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_file(f"{folder}/{name}") as source:
                    reader = Reader(source)
                    ends = reader.ends()
                    at = 0
                    while at < len(ends):
                        to = max(at + 1, int(np.searchsorted(ends, reader.starts[at] + READ_TOKENS, "right")))
                        ids = reader.tokens(int(reader.starts[at]), int(ends[to - 1])).astype("<u4").tobytes()
                        cuts = 4 * (ends[at:to] - reader.starts[at])
                        binary = [ids[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
                        docs = reader.docs[at:to]
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=docs == NO_ID), pa.array(base + reader.starts[at:to]), pa.array(np.diff(cuts, prepend=0) // 4), pa.array(binary, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                        at = to

    return files.mapInArrow(work, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, vocabulary_path: str, **more) -> DataFrame:
    out = scratch(docs.sparkSession, "token-files")
    manifest = write(docs, out, vocabulary_path, **more)
    if manifest.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    return read(docs.sparkSession, out, manifest)

