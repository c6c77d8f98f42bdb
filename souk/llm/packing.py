"""Packing (8): bounded-space online packing.

Each partition keeps at most ``OPEN`` windows. A piece goes to the window that it
fills best; if none has room, the fullest is emitted and a new one opened. What
is open at the end are leftovers; those of up to ``GROUP`` partitions are merged,
the emptiest filling the gaps of the fullest, until one window of all is short.

Edge cases: null and empty texts are the end id alone; a text longer than a
sequence is cut into pieces, however many; repeated rows are packed each by itself,
null ids too; of windows that a piece fits equally well the oldest takes it; an
empty table gives no row; columns beside the id and the text aren't read, whatever
their names. Ids stay in order within a document, and each lies in one piece.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import slices, text_of, written
from souk.llm.token_cache import library_encoder

SIZE = 4096
OPEN = 64
GROUP = 16
#: doc_id's type is put before.
_REST = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, closed boolean"
_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "closed"]


class Windows:
    """The open windows of a partition. A piece is any tuple; ``place`` and
    ``rest`` give windows that are over, as (number, [(piece, offset)])."""

    def __init__(self, size: int = SIZE, n_open: int = OPEN):
        self.size, self.n_open = size, n_open
        self.room: list[tuple[int, int]] = []  # (room, number), ascending
        self.held: dict[int, list] = {}
        self.made = 0

    def close(self, at: int):
        _, number = self.room.pop(at)
        return number, self.held.pop(number)

    def place(self, piece, length: int) -> Iterator[tuple]:
        at = bisect.bisect_left(self.room, (length, -1))  # the least room that suffices
        if at == len(self.room):
            if len(self.room) == self.n_open:
                yield self.close(0)
            room, number = self.size, self.made
            self.made += 1
            self.held[number] = []
        else:
            room, number = self.room.pop(at)
        self.held[number].append((piece, self.size - room))
        left = (room - length, number)
        bisect.insort(self.room, left)
        if not left[0]:
            yield self.close(0)

    def rest(self) -> Iterator[tuple]:
        while self.room:
            yield self.close(0)


def merge_leftovers(pieces: list[dict], size: int = SIZE) -> list[dict]:
    """Moves the pieces of the emptiest windows into the gaps of the fullest,
    cutting them to fit. All windows but one become full, and are closed."""
    by: dict[int, list[dict]] = {}
    for piece in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        by.setdefault(piece["sequence_id"], []).append(piece)
    windows = sorted(by.values(), key=lambda w: (-sum(p["length"] for p in w), w[0]["sequence_id"]))
    used = [sum(p["length"] for p in w) for w in windows]
    out, low, high = [], 0, len(windows) - 1
    while low <= high:
        target, number = windows[low], windows[low][0]["sequence_id"]
        while used[low] < size and high > low:
            piece = windows[high].pop()
            gap = size - used[low]
            if piece["length"] > gap:  # the gap takes the piece's end, its start stays
                keep = piece["length"] - gap
                windows[high].append(piece | {"length": keep, "ids": piece["ids"][: 4 * keep]})
                piece = piece | {"start": piece["start"] + keep, "length": gap, "ids": piece["ids"][4 * keep :]}
            used[high] -= piece["length"]
            target.append(piece | {"sequence_id": number, "offset": used[low]})
            used[low] += piece["length"]
            if not windows[high]:
                high -= 1
        out += [p | {"closed": used[low] == size} for p in target]
        low += 1
    return out


def pack(docs: DataFrame, vocabulary_path: str, end_id: int = 2, size: int = SIZE, n_open: int = OPEN, special: tuple[str, ...] = ("<|startoftext|>", "<|endoftext|>"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, start, length, ids (binary, little-endian
    32-bit), doc_tokens, sequence_id, offset, closed (false for the pieces of the one
    window that stays short).

    The texts are not shuffled: each task encodes and packs what it reads. Only
    the leftovers (at most ``n_open`` windows a partition) move.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kinds = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {_REST}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary_path, special, words=True)
        windows = Windows(size, n_open)
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 32
        kind: list[pa.DataType] = [pa.int64()]

        def rows(windows, closed: bool) -> list[tuple]:
            return [(*piece, first + number, offset, closed) for number, pieces in windows for piece, offset in pieces]

        def batch_of(made: list[tuple]) -> pa.RecordBatch:
            types = [kind[0], pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=_NAMES)

        for batch in slices(batches):
            kind[0] = batch.column("doc_id").type
            made: list[tuple] = []
            encoded, starts = encoder.encode(batch.column("text"))
            data, end = encoded.astype("<u4").tobytes(), np.array([end_id], "<u4").tobytes()
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                ids = data[4 * starts[i] : 4 * starts[i + 1]] + end
                n = len(ids) // 4
                for start in range(0, n, size):
                    length = min(size, n - start)
                    made += rows(windows.place((doc_id, start, length, ids[4 * start : 4 * (start + length)], n), length), True)
            if made:
                yield batch_of(made)
        if last := rows(windows.rest(), False):
            yield batch_of(last)

    def merge(group: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(merge_leftovers(group.to_pylist(), size), schema=group.schema)

    packed = written(source.mapInArrow(work, kinds), "packed")
    done, rest = packed.filter("closed"), packed.filter("not closed")
    last = rest.agg(F.max(F.shiftright("sequence_id", 32))).first()[0] or 0
    shift = GROUP.bit_length() - 1
    while True:  # as many rounds as the number of partitions has hexadecimal digits
        merged = written(rest.groupBy(F.shiftright("sequence_id", 32 + shift)).applyInArrow(merge, kinds), "leftovers")
        done, rest = done.unionByName(merged.filter("closed")), merged.filter("not closed")
        if not last >> shift:
            return done.unionByName(rest).withColumnRenamed("doc_id", id_col)
        shift += GROUP.bit_length() - 1


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence: sequence_id, used, ids (binary). A sequence
    has a bounded number of ids."""
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("pieces")).select("sequence_id", "used", F.aggregate("pieces", F.lit(b""), lambda done, p: F.concat(done, p["ids"])).alias("ids"))
