"""MinHash near-dedup (5): BagMinHash.

A text is the multiset of its shingles (five consecutive words; a text of fewer
words is one shingle). Two texts are near copies if the weighted Jaccard
similarity of their multisets is at least the threshold; a class is what such
links connect.

A shingle's count is discretised into the levels [0,1), [1,2), [2,4), [4,8) ...
and each level of each shingle has a Poisson process of its own, seeded by the
shingle and the level. A process over several cells splits at its earliest point:
a coin says which half has that point, and the other half's process goes on from
there. Halves above the count are dropped, so of a count of many cells only those
are reached that have early points: as many as there are points, times the
logarithm of the count. Points of single cells fall on random registers, and the
earliest point of each register is the signature: two texts agree in a register
with a probability of their weighted Jaccard similarity. Points are made in order
of time, and only up to the time by which all registers are filled, so a long text
costs little more than hashing.

Texts of equal words (by a 128-bit cryptographic hash of the words in order) are one
entry. Bands of the signature give buckets; of
buckets with the same members one stays. In its bucket an entry carries its
shingles, and overlaps are counted exactly, block by block: what leaves a block
is an edge for each member of a class found there, never its pairs. A bucket is
cut into blocks by the shingles it holds, so no task takes an unbounded group.

Edge cases: null and empty texts and rows of a null id are classes of their own;
repeated rows of an id each give a row; pairs exactly at the threshold are linked;
texts of any length are compared whole; an empty table gives no row; columns beside
the id and the text aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import mix, segment_hash, slices, text_of, words_of, written
from souk.llm.components import connected

SHINGLE = 5
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Shingles and entries of a block, columns of the matrix that counts overlaps.
BLOCK_SHINGLES, BLOCK, COLUMNS = 400_000, 1024, 2048
#: Ids that may be broadcast (8 bytes each); more are joined.
BROADCAST = 1_000_000
_COEFFICIENTS = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_ONE, _TWO = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def shingles(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles, by text and hash."""
    n_texts = len(words.first) - 1
    lengths = np.diff(words.first)
    per = np.where(lengths >= SHINGLE, lengths - SHINGLE + 1, 0)
    text = np.repeat(np.arange(n_texts), per)
    start = words.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    h = np.zeros(len(text), np.uint64)
    for k in range(SHINGLE):
        h += words.hashes[start + k] * _COEFFICIENTS[k]
    h = mix(h)
    short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
    if len(short):
        text = np.append(text, short)
        h = np.append(h, segment_hash(words.hashes, words.first[short], words.first[short + 1]))
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def signatures(text: np.ndarray, h: np.ndarray, count: np.ndarray, n_texts: int, registers: int = REGISTERS) -> np.ndarray:
    """The identity of the earliest point in each register: texts x registers;
    zeros for a text without shingles."""
    # a process for each level that a count reaches
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0) + 1
    owner = np.repeat(np.arange(len(h)), levels)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    size = np.where(level > 0, low, 1)
    total = np.bincount(text, weights=count, minlength=n_texts)
    until = (np.log(registers) + 3) / np.maximum(total, 1)
    seed = _process(h[owner], low, size)
    time = _gap(mix(seed + _ONE)) / (registers * size)
    single = size == 1
    cells = Cells(text[owner[single]], seed[single], time[single])
    wide = Intervals(owner[~single], low[~single], size[~single], time[~single])
    earliest, identity = np.full(n_texts * registers, np.inf), np.zeros(n_texts * registers, np.uint64)
    filled = total == 0
    while not filled.all():
        while (early := wide.time <= until[text[wide.owner]]).any():
            wide, found = wide.split(early, h, count, registers)
            cells = cells.and_(Cells(text[found.owner], _process(h[found.owner], found.low, found.size), found.time))
        active = np.flatnonzero(cells.time <= until[cells.doc])
        while len(active):
            p, doc, time = mix(cells.point[active] ^ _TWO), cells.doc[active], cells.time[active]
            slot = doc * registers + (p % np.uint64(registers)).astype(np.int64)
            np.minimum.at(earliest, slot, time)
            first = earliest[slot] == time
            identity[slot[first]] = p[first]
            cells.advance(active, registers)
            active = active[cells.time[active] <= until[doc]]
        filled = (total == 0) | np.isfinite(earliest.reshape(n_texts, registers)).all(axis=1)
        until = np.where(filled, -1.0, 2 * until)
    return identity.reshape(n_texts, registers)


def _gap(points: np.ndarray) -> np.ndarray:
    """Exponential waiting times of rate 1."""
    return -np.log(((points >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def _process(h: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The seed of a shingle's process over the cells low .. low + size: the same in every text."""
    return mix(h ^ mix((low.astype(np.uint64) << np.uint64(32)) ^ size.astype(np.uint64)))


@dataclass
class Cells:
    """Processes over one cell, each at a point."""

    doc: np.ndarray
    seed: np.ndarray
    time: np.ndarray

    def __post_init__(self):
        self.number = np.zeros(len(self.seed), np.uint64)
        self.point = mix(self.seed + _ONE)

    def and_(self, more: Cells) -> Cells:
        if not len(more.doc):
            return self
        out = Cells(*(np.concatenate(x) for x in ((self.doc, more.doc), (self.seed, more.seed), (self.time, more.time))))
        out.number, out.point = np.concatenate([self.number, more.number]), np.concatenate([self.point, more.point])
        return out

    def advance(self, at: np.ndarray, registers: int) -> None:
        """To the next point."""
        self.number[at] += np.uint64(1)
        self.point[at] = mix(self.seed[at] + (self.number[at] + np.uint64(1)) * _ONE)
        self.time[at] += _gap(self.point[at]) / registers


@dataclass
class Intervals:
    """Processes over several cells, each at its earliest point. ``owner``: the shingle."""

    owner: np.ndarray
    low: np.ndarray
    size: np.ndarray
    time: np.ndarray

    def split(self, which: np.ndarray, h: np.ndarray, count: np.ndarray, registers: int) -> tuple[Intervals, Intervals]:
        """(the processes left over several cells, new ones over one cell): those of
        ``which`` are halved, and halves above the shingle's count dropped."""
        owner, half, time = self.owner[which], self.size[which] // 2, self.time[which]
        upper = (mix(_process(h[owner], self.low[which], self.size[which]) ^ _TWO) & np.uint64(1)).astype(bool)  # has the point
        kept = [(self.owner[~which], self.low[~which], self.size[~which], self.time[~which])]
        for side in (False, True):
            low = self.low[which] + half * side
            later = time + _gap(mix(_process(h[owner], low, half) + _ONE)) / (registers * half)
            below = low < count[owner]
            kept.append((owner[below], low[below], half[below], np.where(upper == side, time, later)[below]))
        made = [np.concatenate(x) for x in zip(*kept, strict=True)]
        single = made[2] == 1
        return Intervals(*(x[~single] for x in made)), Intervals(*(x[single] for x in made))


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key1 and key2 (of the words in order), total (shingles), bands. A
    narrow map."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = words_of(batch.column("text"))
            text, h, count = shingles(words)
            n = batch.num_rows
            sig = signatures(text, h, count, n)
            bands = np.tile(mix(np.arange(BANDS, dtype=np.uint64)), (n, 1))
            for k in range(ROWS):
                bands = mix(bands ^ sig[:, k * BANDS : (k + 1) * BANDS])
            keys = words.keys()
            total = np.bincount(text, weights=count, minlength=n).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS), pa.int32()), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(total), lists], names=["id", "key1", "key2", "total", "bands"])

    return source.mapInArrow(work, "id long, key1 long, key2 long, total long, bands array<long>")


def elements(docs: DataFrame) -> DataFrame:
    """rep, set (binary, 64-bit hashes): the k-th occurrence of a shingle is an
    element, so that the overlap of two sets is that of the multisets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, h, count = shingles(words_of(batch.column("text")))
            number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            sets = mix(np.repeat(h, count) ^ (number.astype(np.uint64) * _ONE)).tobytes()
            ends = 8 * np.cumsum(np.bincount(text, weights=count, minlength=batch.num_rows).astype(np.int64))
            cut = [sets[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(cut, pa.binary())], names=["rep", "set"])

    return docs.mapInArrow(work, "rep long, set binary")


def links_of(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the linked pairs between two lists of rows, by exact overlaps."""
    sizes = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    row, values = row[order], values[order]
    new = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # what one row alone holds is in no overlap
    row, column = row[shared], column[shared]
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1 if len(column) else column
    overlap = np.zeros((len(first), len(second)), np.float32)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + COLUMNS + 1, COLUMNS))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            part = np.zeros((len(sets), COLUMNS), np.float32)
            part[row[a:b], column[a:b] % COLUMNS] = 1
            overlap += part[first] @ part[second].T
    union = sizes[first][:, None] + sizes[second][None, :] - overlap.astype(np.float64)
    i, j = np.nonzero(overlap >= threshold * union)
    i, j = first[i], second[j]
    return i[i != j], j[i != j]


def spanning(i: np.ndarray, j: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id of its class) for the rows of a block that are linked."""
    label = reps.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
        if (label == before).all():
            break
    rows = np.flatnonzero(label != reps)
    return reps[rows], label[rows]


def bucket_links(posts: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b: edges that connect what is linked within a bucket. ``posts``: bucket,
    rep, blocks."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = posts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("rep", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own")
    cells = dealt.join(sets, "rep").groupBy("bucket", "low", "high").agg(F.collect_list(F.struct("rep", "own", "set")).alias("members")).filter(F.size("members") > 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = batch.column("low").to_numpy(), batch.column("high").to_numpy()
            for c in range(batch.num_rows):
                m = batch.column("members")[c].values
                rep, own = m.field("rep").to_numpy(), m.field("own").to_numpy()
                first, second = np.flatnonzero(own == low[c]), np.flatnonzero(own == high[c])
                if not len(first) or not len(second):
                    continue  # one block is empty; pairs within the other have their own cell
                sets = [np.frombuffer(x, np.uint64) for x in m.field("set").to_pylist()]
                ids, roots = spanning(*links_of(sets, first, second, threshold), rep)
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots)], names=["a", "b"])

    return cells.mapInArrow(work, "a long, b long").distinct()


def classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, class_id (the least id of the class),
    kept (whether the row's id is that)."""
    found = written(features(docs, id_col, text_col), "bag-features")
    fine = found.filter("id is not null and total > 0")
    entries = written(fine.groupBy("key1", "key2").agg(F.min("id").alias("rep"), F.first("total").alias("total"), F.first("bands").alias("bands")), "bag-entries")
    posts = entries.select("rep", "total", F.explode("bands").alias("bucket"))
    members = F.struct(F.count("*").alias("n"), F.min("rep").alias("least"), F.max("rep").alias("most"), F.bit_xor(F.xxhash64("rep")).alias("all"))
    buckets = posts.groupBy("bucket").agg(members.alias("members"), F.sum("total").alias("shingles")).filter("members.n > 1")
    buckets = buckets.groupBy("members").agg(F.min("bucket").alias("bucket"), F.max("shingles").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("shingles") / BLOCK_SHINGLES, F.col("members.n") / BLOCK)).cast("int")
    posts = written(posts.join(buckets.select("bucket", blocks.alias("blocks")), "bucket").select("bucket", "rep", "blocks"), "bag-posts")
    wanted = posts.select("rep").distinct()
    if posts.select("rep").distinct().count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), text_of(text_col).alias("text")).join(wanted, "rep", "left_semi")
    links = written(bucket_links(posts, elements(texts), threshold), "bag-links")
    labels = connected(links, "bag")
    by_entry = entries.select("key1", "key2", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("key1", "key2", F.coalesce("component", "rep").alias("class_id"))
    joined = fine.select("id", "key1", "key2").join(by_entry, ["key1", "key2"]).select("id", "class_id")
    alone = found.filter("id is null or total = 0").select("id", F.col("id").alias("class_id"))
    return joined.unionByName(alone).select(F.col("id").alias(id_col), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))
