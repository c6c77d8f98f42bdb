"""Byte-level BPE encoding and decoding (3).

Pieces of one length bucket form a padded matrix of symbols. In each round all
rows merge their leftmost pair of least rank at once; the pair's rank comes
from a hash table in numpy arrays, and the row is compacted. A row of n symbols takes
n rounds over n cells, so pieces over ``LONG`` bytes merge through a heap instead,
in the same order and with the same ids, in n log n.

Edge cases: null and empty texts have no ids; a text of any length is encoded
whole; repeated rows each give a row; null ids stay; an empty table gives no row;
columns beside the id and the text aren't read, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import mix, slices, text_of
from souk.llm.token_cache import Encoder, shared_encoder

NONE = np.int32(2**31 - 1)
LONG = 512
#: Cells of a matrix; longer lists of pieces are cut.
CELLS = 1 << 21


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """(left id, right id) -> id of the merged token, open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        size = 1 << max(4, int(2 * len(left)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.values = np.full(size, NONE)
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slots, open_ = mix(keys) & self.mask, np.arange(len(keys))
        while len(open_):  # each round the first of those that want a free slot takes it
            free = self.keys[slots[open_]] == np.uint64(2**64 - 1)
            _, first = np.unique(slots[open_[free]], return_index=True)
            takers = open_[free][first]
            self.keys[slots[takers]] = keys[takers]
            self.values[slots[takers]] = merged[takers]
            open_ = np.setdiff1d(open_, takers, assume_unique=True)
            slots[open_] = (slots[open_] + np.uint64(1)) & self.mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where the pair doesn't merge; so does any negative id."""
        keys = (left.astype(np.uint32).astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64)
        out = np.full(keys.shape, NONE)
        slots = mix(keys) & self.mask
        at = np.flatnonzero((left >= 0) & (right >= 0))
        while len(at):
            seen = self.keys[slots[at]]
            hit = seen == keys[at]
            out[at[hit]] = self.values[slots[at[hit]]]
            at = at[~hit & (seen != np.uint64(2**64 - 1))]
            slots[at] = (slots[at] + np.uint64(1)) & self.mask
        return out


class Codec:
    """Ranks are ids: a token of lower rank merges first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = (np.array(x, np.int32) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int32),) * 3
        self.table = PairTable(left, right, merged)
        self.pairs = {(a, b): c for a, b, c in pairs}

    @classmethod
    def from_file(cls, path: str) -> Codec:
        return cls(read_ranks(path))

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = np.array([whole], np.int32)
            elif len(p) > LONG:
                out[i] = self.merge_long(p)
            elif p:
                buckets.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
        for wide, members in buckets.items():
            step = max(1, CELLS // wide)
            for at in range(0, len(members), step):
                some = members[at : at + step]
                for i, ids in zip(some, self.merge([pieces[i] for i in some], wide), strict=True):
                    out[i] = ids
        return out

    def merge(self, pieces: list[bytes], wide: int) -> list[np.ndarray]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), np.uint8).reshape(n, wide)
        lengths = np.array([len(p) for p in pieces])
        symbols = np.where(np.arange(wide) < lengths[:, None], self.byte[raw], np.int32(-1))
        ranks = self.table(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, wide - 1)
        result = np.full((n, wide), -1, np.int32)
        alive = np.arange(n)
        while len(alive):
            at = ranks.argmin(axis=1)  # the leftmost of the least
            best = ranks[np.arange(len(alive)), at]
            over = best == NONE
            if over.any():
                result[alive[over], : symbols.shape[1]] = symbols[over]
                keep = ~over
                alive, symbols, ranks, at, best = alive[keep], symbols[keep], ranks[keep], at[keep], best[keep]
                if not len(alive):
                    break
            width = symbols.shape[1]
            rows = np.arange(len(alive))
            symbols[rows, at] = best
            columns = np.arange(width - 1)
            symbols = np.take_along_axis(symbols, columns + (columns > at[:, None]), axis=1)  # compaction
            if width == 2:
                result[alive, :1] = symbols
                break
            columns = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            left = np.maximum(at - 1, 0)
            has_left, has_right = at > 0, at < width - 2
            r = rows[has_left]
            ranks[r, left[has_left]] = self.table(symbols[r, left[has_left]], symbols[r, at[has_left]])
            r = rows[has_right]
            ranks[r, at[has_right]] = self.table(symbols[r, at[has_right]], symbols[r, at[has_right] + 1])
        return [x[: np.count_nonzero(x >= 0)] for x in result]

    def merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(c, i, ids[i], ids[i + 1]) for i in range(n - 1) if (c := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (c := self.pairs.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (c, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int32)


class Decoder:
    """The bytes of all tokens in one array."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (1 + max(ranks.values(), default=-1))
        for token, i in ranks.items():
            tokens[i] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.data[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


@cache
def decoder(path: str) -> Decoder:
    """One for each Python worker."""
    return Decoder(read_ranks(path))


#: The pattern whose pieces the units of ``token_cache`` are made of: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def unit_encoder(codec: Codec, pattern: str) -> Encoder:
    """Units are cut into pieces by the pattern, and the pieces of all units
    encoded together. With another pattern each text is a unit."""
    cut = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall

    def encode_units(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [cut(u) for u in units]
        ids = codec.encode_pieces([p.encode() for u in pieces for p in u])
        sizes = np.array([len(x) for x in ids], np.int64)
        bounds = np.cumsum([0, *(len(u) for u in pieces)])
        totals = np.concatenate([[0], np.cumsum(sizes)])
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)).astype(np.uint32), np.diff(totals[bounds])

    return Encoder(encode_units, lambda text: encode_units([text])[0], cut=pattern == PATTERN)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, ids (binary, little-endian unsigned
    32-bit). A narrow map."""
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(("byte_bpe", ranks_path, pattern), lambda: unit_encoder(Codec.from_file(ranks_path), pattern))
        for batch in slices(batches):
            ids, starts = encoder.encode(batch.column("text"))
            data = ids.astype("<u4").tobytes()
            binary = [data[4 * a : 4 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(binary, pa.binary())], names=["id", "ids"])

    return source.mapInArrow(work, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, text_bytes (binary) and the ids in decimals (``ids_text``)."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = decoder(ranks_path)
        for part in slices(batches, "ids"):
            arrays = [np.frombuffer(x.as_buffer(), "<u4") if x.is_valid and len(x.as_buffer()) else np.zeros(0, np.uint32) for x in part.column("ids")]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x) for x in arrays], pa.int64()), pa.array([bytes_of(x).tobytes() for x in arrays], pa.binary()), pa.array([" ".join(map(str, x.tolist())) for x in arrays], pa.string())], names=["id", "n_tokens", "text_bytes", "ids_text"])

    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(work, f"id {kind}, n_tokens long, text_bytes binary, ids_text string").withColumnRenamed("id", id_col)

