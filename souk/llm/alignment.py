"""Cross-tokenizer alignment (12).

Two tokenizers cut the same bytes. Where tokens of both end, the bytes are cut into
groups; within a group every token of A is linked with every token of B. All of it is
arithmetic on arrays over many documents at once: cumulated lengths are ends, common
ends are cuts, a search among the cuts labels each token with its group, and repeated
indexes expand groups to links.

Corpus-wide counts (how many documents hold a pair of ids linked) are summed in tasks,
then by pair and salt, then by pair. Documents keep their distinct pairs in a stored
table, so texts are encoded once. Counts come back to documents by a lookup: tasks
read the count table from the shared folder while it has at most ``LOOKUP`` rows; beyond
that the documents' pairs are joined with it by shuffle. Both ways give the same rows.

Edge cases: texts that are null or empty, and those whose tokens don't join to a space
and the text (such as a text with U+2581, which B reads as a blank), have no tokens:
zeros, empty groups, no pairs; strings of special tokens are plain text; a null doc_id
is kept; repeated rows are documents of their own and count each; a group of any size is
expanded in parts; an empty table gives no row; columns beside the id and the text aren't
read, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import scratch, slices, text_buffer, text_of
from souk.llm.token_cache import Encoder, library_units, shared_encoder

#: Rows of the count table that each worker holds at most; links and pairs worked on at a time; salts.
LOOKUP, AT_ONCE, SALTS = 4_000_000, 4_000_000, 16
#: A blank in pieces of B.
BLANK = "▁"


class Vocabulary:
    """The bytes of each id, one after another, and their decimal digits."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.bits = max(1, (len(entries) - 1).bit_length())
        digits = [str(i).encode() for i in range(len(entries))]
        self.n_digits = np.array([len(d) for d in digits])
        wide = int(self.n_digits.max())
        self.digits = np.frombuffer(b"".join(d.ljust(wide, b"\0") for d in digits), np.uint8).reshape(-1, wide)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.repeat(self.starts[ids] - ends + n, n) + np.arange(total)]


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 stands
    for itself, the other bytes for the code points from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


@cache
def byte_level(path: str) -> Vocabulary:
    """Of a byte-level vocabulary of the tokenizers library."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    letters = _byte_letters()
    by_id = {i: bytes(letters[c] for c in entry) for entry, i in told["model"]["vocab"].items()}
    by_id |= {t["id"]: t["content"].encode() for t in told["added_tokens"] if t["id"] not in by_id}
    return Vocabulary([by_id.get(i, b"") for i in range(max(by_id) + 1)])


@cache
def _pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, [model.id_to_piece(i) for i in range(model.get_piece_size())]


@cache
def piece_level(path: str) -> Vocabulary:
    """Of a sentencepiece model: pieces in UTF-8, their blanks as spaces, <0xHH> as byte HH."""
    entries = []
    for piece in _pieces(path)[1]:
        is_byte = len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">")
        entries.append(bytes([int(piece[3:5], 16)]) if is_byte else piece.replace(BLANK, " ").encode())
    return Vocabulary(entries)


class PieceEncoder(Encoder):
    """Units begin with the blanks before a word. No piece goes from a word into the blanks
    after it (looked up in the model; else texts aren't cut), so units are encoded alone."""

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        blank = raw == 32
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
        return cut


def _piece_encoder(path: str) -> Encoder:
    """Of texts that begin with a space, which the model itself would add."""

    def make() -> Encoder:
        model, pieces = _pieces(path)
        blank = [model.piece_to_id(BLANK)]

        def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = model.encode([t[1:] for t in texts], num_threads=1)
            ids = [own if t != " " else blank for own, t in zip(ids, texts, strict=True)]  # the model adds no blank to nothing
            return np.array([i for own in ids for i in own], np.uint32), np.array([len(own) for own in ids], np.int64)

        return PieceEncoder(units, lambda t: units([t])[0], cut=not any(BLANK in p.lstrip(BLANK) for p in pieces))

    return shared_encoder(("alignment", path), make)


def _byte_encoder(path: str) -> Encoder:
    return shared_encoder(("plain", path), lambda: Encoder(*library_units(path, plain=True)))


class Side:
    """The tokens of one tokenizer in the texts of a slice."""

    def __init__(self, encoder: Encoder, vocabulary: Vocabulary, texts: pa.Array):
        ids, first = encoder.encode(texts)
        self.vocabulary, self.ids, self.n = vocabulary, ids.astype(np.int64), np.diff(first)
        total = np.concatenate([[0], np.cumsum(vocabulary.lengths[self.ids])])[first]
        self.n_bytes = np.diff(total)

    def keep(self, kept: np.ndarray) -> None:
        """Only the texts of ``kept`` hold tokens from now on."""
        self.ids = self.ids[np.repeat(kept, self.n)]
        self.n = np.where(kept, self.n, 0)


def cut_groups(a: Side, b: Side, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Takes the tokens of texts out whose bytes aren't those of both sides; returns the
    ends of groups in the bytes of the texts that stay, one after another."""
    n_bytes = np.diff(offsets)
    kept = (a.n_bytes == n_bytes) & (b.n_bytes == n_bytes) & (n_bytes > 1)
    for side in (a, b):
        side.keep(kept)
        there, owner = np.repeat(kept, n_bytes), np.repeat(np.arange(len(n_bytes)), np.where(kept, n_bytes, 0))
        wrong = np.unique(owner[side.vocabulary.bytes_of(side.ids) != raw[there]])
        if len(wrong):
            kept[wrong] = False
            a.keep(kept)
            b.keep(kept)
    ends = [np.cumsum(side.vocabulary.lengths[side.ids]) for side in (a, b)]
    cuts = np.intersect1d(*ends, assume_unique=True)
    for side, own in zip((a, b), ends, strict=True):
        side.group = np.searchsorted(cuts, own)
        side.in_group = np.bincount(side.group, minlength=len(cuts))
        side.before = np.cumsum(side.in_group) - side.in_group
    return cuts


def written_groups(a: Side, b: Side) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text: decimal ids in order."""
    n = len(a.ids) + len(b.ids)
    wide = max(s.vocabulary.digits.shape[1] for s in (a, b)) + 1
    cells, sizes = np.zeros((n, wide), np.uint8), np.zeros(n, np.int64)
    places = (np.arange(len(a.ids)) + b.before[a.group], np.arange(len(b.ids)) + (a.before + a.in_group)[b.group])
    for side, at, mark in ((a, places[0], ord("|")), (b, places[1], ord(";"))):
        last = np.append(side.group[1:] != side.group[:-1], True)[: len(side.group)]
        cells[at, : side.vocabulary.digits.shape[1]] = side.vocabulary.digits[side.ids]
        sizes[at] = side.vocabulary.n_digits[side.ids] + 1
        cells[at, sizes[at] - 1] = np.where(last, mark, ord(","))
    flat = cells[cells > 0].tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(a.n + b.n)])].tolist()
    return [flat[x : max(x, y - 1)] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def distinct_links(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, links): a row for each distinct pair of ids of a text, in order; a pair is
    the id of A before that of B in bits. Links are expanded ``AT_ONCE`` at a time."""
    bits = b.vocabulary.bits
    text = np.repeat(np.arange(len(a.n)), a.n)
    reps = b.in_group[a.group]
    ends = np.cumsum(reps)
    keys, counts, at = [], [], 0
    while at < len(reps):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        own = reps[at:to]
        mine = np.repeat(np.arange(at, to), own)
        other = np.repeat(b.before[a.group[at:to]] - np.cumsum(own) + own, own) + np.arange(len(mine))
        pair = (a.ids[mine] << bits) | b.ids[other]
        order = np.lexsort((pair, text[mine])) if a.vocabulary.bits + bits + len(a.n).bit_length() > 63 else np.argsort((text[mine] << (a.vocabulary.bits + bits)) | pair)
        rows, n = _summed(np.stack([text[mine][order], pair[order]]), np.ones(len(order), np.int64))
        keys.append(rows)
        counts.append(n)
        at = to
    if not keys:
        none = np.zeros(0, np.int64)
        return none, none, none
    rows, n = keys[0], counts[0]
    if len(keys) > 1:
        rows, n = np.concatenate(keys, axis=1), np.concatenate(counts)
        order = np.lexsort((rows[1], rows[0]))
        rows, n = _summed(rows[:, order], n[order])
    return rows[0], rows[1], n


def _summed(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal neighbours as one."""
    if not len(n):
        return rows, n
    new = np.flatnonzero(np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)))
    return rows[:, new], np.add.reduceat(n, new)


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: row (an id of the row, fixed once the result is written),
    doc_id, n_a, n_b, n_groups, n_links, groups, and its distinct linked pairs: pairs
    (little-endian 64-bit, A's id shifted left by B's bits, or B's id) and links (32-bit,
    how many of its links are of each). Narrow. ``byte_path`` and ``piece_path`` are the
    vocabularies of A and B."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.concat(F.lit(" "), text_of(text_col)).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies, encoders = (byte_level(byte_path), piece_level(piece_path)), (_byte_encoder(byte_path), _piece_encoder(piece_path))
        context = TaskContext.get()
        at = (context.partitionId() if context else 0) << 40
        for batch in slices(batches):
            texts = batch.column("text")
            a, b = (Side(e, v, texts) for e, v in zip(encoders, vocabularies, strict=True))
            cuts = cut_groups(a, b, *text_buffer(texts))
            first = np.concatenate([[0], np.cumsum(a.n)])
            last_group = np.concatenate([[0], np.cumsum(np.bincount(a.group, minlength=len(cuts)) > 0)])  # groups so far
            group_ends = last_group[np.concatenate([[0], a.group + 1])[first]] if len(cuts) else np.zeros(len(first), np.int64)
            per_group = np.concatenate([[0], np.cumsum(a.in_group * b.in_group)])
            text, pair, links = distinct_links(a, b)
            edges = np.searchsorted(text, np.arange(len(a.n) + 1)).tolist()
            pairs, n_links = pair.astype("<i8").tobytes(), links.astype("<u4").tobytes()
            spans = list(zip(edges[:-1], edges[1:], strict=True))
            columns = [
                pa.array(np.arange(at, at + len(a.n))), batch.column("doc_id"), pa.array(a.n), pa.array(b.n), pa.array(np.diff(group_ends)), pa.array(np.diff(per_group[group_ends])),
                pa.array(written_groups(a, b), pa.binary()).cast(pa.string()), pa.array([pairs[8 * x : 8 * y] for x, y in spans], pa.binary()), pa.array([n_links[4 * x : 4 * y] for x, y in spans], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links"])
            at += len(a.n)

    shift = piece_level(piece_path).bits
    out = rows.mapInArrow(work, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, links binary")
    return out.withColumn("shift", F.lit(shift))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether no pair of its A id has a
    higher n), of a stored result of ``align``. Tasks sum before the shuffle, then pairs meet
    by salt, then alone; the highest counts have a row for each id of A at most."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = 0

        def merge() -> None:
            nonlocal keys, counts, size
            new, n = np.unique(np.concatenate(held), return_counts=True)
            rows, all_n = np.concatenate([keys, new]), np.concatenate([counts, n])
            order = np.argsort(rows, kind="stable")
            merged, counts = _summed(rows[order][None, :], all_n[order])
            keys, size = merged[0], 0
            held.clear()

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

        for batch in batches:
            data, _ = text_buffer(batch.column("pairs"))
            held.append(np.frombuffer(data.tobytes(), "<i8"))
            size += len(held[-1])
            if size >= AT_ONCE:
                merge()
                if len(keys) >= AT_ONCE:
                    yield batch_of()
                    keys, counts = keys[:0], counts[:0]
        if held:
            merge()
        if len(keys):
            yield batch_of()

    parts = aligned.select("pairs").mapInArrow(summed, "pair long, n long").withColumn("salt", F.spark_partition_id() % SALTS)
    sums = parts.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))
    shift = aligned.select("shift").first()
    sums = _stored(sums, "pair-sums")
    own = F.shiftright("pair", shift[0] if shift else 0)
    highest = sums.groupBy(own.alias("_a")).agg(F.max("n").alias("_most"))  # as many rows as A has ids, at most
    joined = sums.join(F.broadcast(highest), own == F.col("_a"))
    return joined.select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(_put(df, name))


def _put(df: DataFrame, name: str) -> str:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return path


_tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stored count table in order of its pairs; a worker holds the latest one."""
    if path not in _tables:
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        told = pyarrow.dataset.dataset(folder, filesystem=fs, format="parquet").to_table(columns=["pair", "n", "best"])
        pair, n, best = (told.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        _tables.clear()
        _tables[path] = pair[order], n[order], best[order]
    return _tables[path]


def scored(aligned: DataFrame, counts: DataFrame, lookup: int = LOOKUP) -> DataFrame:
    """A stored result of ``align`` with n_best (links whose pair is the best of its A id)
    and count_sum (over links, the count of their pair)."""
    path = _put(counts, "pair-counts")
    counts = aligned.sparkSession.read.schema("pair long, n long, best boolean").parquet(path)
    columns = [c for c in aligned.columns if c not in ("row", "pairs", "links", "shift")]
    if counts.count() <= lookup:
        return _looked_up(aligned, path).select(*columns, "n_best", "count_sum")
    sums = aligned.select("row", "pairs", "links").mapInArrow(_exploded, "row long, pair long, k long").join(counts, "pair")
    by_row = sums.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.drop("pairs", "links").join(by_row, "row", "left").select(*columns, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


def _pairs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row's place in the batch, pair, links) of all its pairs."""
    data, offsets = text_buffer(batch.column("pairs"))
    more, _ = text_buffer(batch.column("links"))
    return np.repeat(np.arange(batch.num_rows), np.diff(offsets) // 8), np.frombuffer(data.tobytes(), "<i8"), np.frombuffer(more.tobytes(), "<u4").astype(np.int64)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "pairs"):
        at, pair, k = _pairs_of(batch)
        yield pa.RecordBatch.from_arrays([pa.array(batch.column("row").to_numpy()[at]), pa.array(pair), pa.array(k)], names=["row", "pair", "k"])


def _looked_up(aligned: DataFrame, path: str) -> DataFrame:
    kinds = aligned.drop("pairs", "links").schema.add("n_best", "long").add("count_sum", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = _table(path)
        for batch in slices(batches, "pairs"):
            at, pair, k = _pairs_of(batch)
            found = np.searchsorted(pairs, pair)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], at, np.where(best[found], k, 0))
            np.add.at(sums[1], at, k * n[found])
            told = batch.drop_columns(["pairs", "links"])
            yield pa.RecordBatch.from_arrays([*told.columns, *map(pa.array, sums)], names=[*told.schema.names, "n_best", "count_sum"])

    return aligned.mapInArrow(work, kinds)
