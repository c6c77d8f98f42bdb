"""Approximate nearest neighbours (9): permutation index.

A vector is represented by the order of its nearest pivots. It is posted in the
inverted files of its ``POSTED`` nearest pivots; a query reads the files of its
nearest ones, ranks what it finds there by Spearman's footrule between the orders,
and reranks the best share of each file by cosine with the original vectors.

The number of pivots grows with the root of the number of vectors. How many files a
query reads, and which share of each file's own rows is reranked, is fitted on a bounded
sample of ``SAMPLE`` rows: the least that finds ``FOUND`` of the true neighbours of
``PROBES`` rows there. A query whose own ``OWN`` nearest rows of the sample need more reads
more, and each reads on until its files hold ``FLOOR`` postings for each answer, so stray
rows beside dense clusters find theirs. Where vectors have clusters a query then reads few
files; where they point everywhere alike no order of pivots tells much, and it has to read
a good part of the table. The index holds every row.

A file is read in blocks of about ``BLOCK`` postings, and the queries of a file
in blocks too, so a common pivot doesn't make a large task; a block gives each
query its few best, never the pairs. Equal vectors are one entry, with as many
of their least ids as an answer can need.

Edge cases: vectors that are null, zero, or hold null or non-finite components
take no part, nor do rows without an id; vectors of another length than that of
most are searched among themselves; ties go to the smaller id; repeated rows of an
id count once; a query with fewer candidates gets all of them; an empty table gives
no row; columns beside the id and the vector may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm.common import written
from souk.llm.vectors import matrix, sample, unit, usable

#: Least and most pivots, files that hold a vector, pivots of its order that are kept.
LEAST, MOST, POSTED, KEPT = 128, 4096, 8, 256
#: Rows of a block that are reranked at least.
AT_LEAST = 64
BLOCK, QUERY_BLOCK = 4096, 512
SAMPLE, PROBES, NEIGHBOURS, FOUND = 10_000, 256, 5, 0.97
#: Of its neighbours among the sample a query reads so as to find this many.
OWN = 12
#: Postings that a query's files hold at least, for each row that is asked for.
FLOOR = 64


def pivots_for(n: int) -> int:
    """About the root of ``n``, as a power of two."""
    return min(MOST, max(LEAST, 1 << round(math.log2(max(1, n)) / 2)))


def choose_pivots(x: np.ndarray, n: int = LEAST, seed: int = 3) -> np.ndarray:
    """Rows of the sample, no two nearly alike: a row that is close to a chosen
    pivot is passed over as long as others are left. If those are too few, the rows
    passed over fill up, the one farthest from all pivots first."""
    order = np.random.default_rng(seed).permutation(len(x))
    chosen: list[int] = []
    for i in order:
        if len(chosen) < n and (not chosen or (x[chosen] @ x[i]).max() < 0.9):
            chosen.append(int(i))
    nearest = (x @ x[chosen].T).max(axis=1)
    while len(chosen) < n and nearest.min() < 1 - 1e-12:  # else all directions are pivots
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
        nearest[chosen[-1]] = 1.0
    return x[chosen]


def orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of the ``KEPT`` nearest pivots of each row, nearest first."""
    near = -(x @ pivots.T)
    if KEPT < len(pivots):
        some = np.argpartition(near, KEPT - 1, axis=1)[:, :KEPT]
        some.sort(axis=1)
        return np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, axis=1), axis=1, kind="stable"), axis=1).astype(np.uint16)
    return np.argsort(near, axis=1, kind="stable").astype(np.uint16)


def places_of(order: np.ndarray, n: int) -> np.ndarray:
    """Of each row the place of each of the ``n`` pivots; those that an order doesn't
    hold share the place after its last."""
    out = np.full((len(order), n), order.shape[1], np.int16)
    np.put_along_axis(out, order.astype(np.int64), np.arange(order.shape[1], dtype=np.int16)[None, :], axis=1)
    return out


class Sample:
    """The sampled rows with their orders and files: what a query would have to read to find
    its nearest among them."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray):
        self.x, self.order = x, orders(x, pivots)
        self.place = places_of(self.order, len(pivots))
        self.posted = self.order[:, :POSTED]
        self.sizes = np.bincount(self.posted.ravel(), minlength=len(pivots))
        self.by_file = np.argsort(self.posted.ravel(), kind="stable") // self.posted.shape[1]
        self.ends = np.cumsum(self.sizes)

    def near(self, q: np.ndarray, place: np.ndarray, n: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows nearest to a query (but itself), the place of the first file that each is
        in, and the footrules of all rows."""
        cosine = self.x @ q
        cosine[cosine > 1 - 1e-12] = -2
        near = np.argpartition(-cosine, min(n, len(cosine) - 1))[:n]
        near = near[cosine[near] > -2]
        return near, place[self.posted[near]].min(axis=1) + 1, np.abs(self.place - place).sum(axis=1, dtype=np.int32)

    def shares(self, near: np.ndarray, footrule: np.ndarray, files: np.ndarray) -> np.ndarray:
        """The share of a file's own rows that must be reranked to find each of ``near`` in one
        of ``files``; 1 for rows that are in none."""
        best = np.ones(len(near))
        for f in files:
            inside = (self.posted[near] == f).any(axis=1)
            if inside.any():
                own = self.by_file[self.ends[f] - self.sizes[f] : self.ends[f]]
                best = np.where(inside, np.minimum(best, np.searchsorted(np.sort(footrule[own]), footrule[near], "right") / len(own)), best)
        return best


@dataclass(frozen=True)
class Reading:
    """How many files most queries read, which share of a table they rerank in all, and the
    share of each file's own rows that is reranked."""

    files: int
    share: float
    of_file: float


def fit_reading(x: np.ndarray, pivots: np.ndarray, probes: int = PROBES, seed: int = 4) -> Reading:
    """The least that finds ``FOUND`` of the neighbours of some rows among the sample, by a
    search as it is done: a neighbour counts as found in a file that is read if it is among
    the share of that file's own rows that are reranked."""
    sampled, seen = Sample(x, pivots), []
    for i in np.random.default_rng(seed).permutation(len(sampled.x))[:probes]:
        near, first, footrule = sampled.near(sampled.x[i], sampled.place[i])
        if len(near):
            seen.append((i, near, first, footrule))
    if not seen:
        return Reading(1, 1.0, 1.0)
    files = int(min(np.quantile(np.concatenate([s[2] for s in seen]), FOUND, method="higher"), sampled.order.shape[1]))
    needed = [sampled.shares(near, footrule, sampled.order[i, :files]) for i, near, _, footrule in seen]
    of_file = float(np.quantile(np.concatenate(needed), FOUND, method="higher"))
    postings = np.mean([sampled.sizes[sampled.order[s[0], :files]].sum() for s in seen])
    return Reading(files, float(min(1.0, of_file * postings / len(x))), of_file)


def read_by(reading: Reading, sampled: Sample, q: np.ndarray, order: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Files that each query reads, and the share of each that it reranks: what most queries
    need, or what its own neighbours among the sample need, if that is more; so a stray row
    reads as it must. It reads on until its files hold ``least`` postings (``sizes``: those of
    each file), or all it has."""
    met = np.cumsum(sizes[order], axis=1)
    files = np.maximum(reading.files, np.where(met[:, -1] >= least, (met >= least).argmax(axis=1) + 1, order.shape[1]))
    share = np.full(len(q), reading.of_file)
    places = places_of(order, sampled.place.shape[1])
    for i in range(len(q)):
        near, first, footrule = sampled.near(q[i], places[i], OWN)
        if len(near):
            files[i] = min(max(files[i], first.max()), order.shape[1])
            share[i] = max(share[i], sampled.shares(near, footrule, order[i, : files[i]]).max())
    return files, share


def search_block(places: np.ndarray, x: np.ndarray, reps: np.ndarray, q_places: np.ndarray, q: np.ndarray, k: int, share: np.ndarray | float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, cosines) of the ``k`` best of a block for each query. Rows with
    the footrule of the last one that is reranked are reranked with it."""
    share = np.broadcast_to(share, len(q))
    for i in range(len(q)):
        keep = min(len(x), max(AT_LEAST, math.ceil(len(x) * share[i])))
        footrule = np.abs(places - q_places[i]).sum(axis=1, dtype=np.int32)
        near = np.flatnonzero(footrule <= np.partition(footrule, keep - 1)[keep - 1]) if keep < len(x) else np.arange(len(x))
        cosine = (x[near] * q[i]).sum(axis=1)
        best = np.lexsort((reps[near], -cosine))[:k]
        yield i, near[best], cosine[best]


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the neighbour's id, score. ``is_query``: a column
    over the id column that marks the queries. Repeated rows of an id count once."""
    rows = usable(vectors.withColumn("_q", F.coalesce(is_query, F.lit(False))).select(F.struct(id_col, "_q").alias("_id"), vector_col), "_id", vector_col)
    rows = rows.filter(F.col(f"id.{id_col}").isNotNull()).select(F.col(f"id.{id_col}").alias("id"), F.col("id._q").alias("asks"), "vector")
    entries = written(rows.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max("asks").alias("asks")), "ann-entries")
    kind = vectors.schema[id_col].dataType.simpleString()
    # components that came as floats are held as floats: the same numbers in half the bytes
    narrow = isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    parts = [_of_length(entries.filter(F.size("vector") == d), n, k + 1, "<f4" if narrow else "<f8") for d, n in entries.groupBy(F.size("vector")).count().collect()]
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    # the ids of an entry; no answer needs more than k + 1 of them
    several = rows.join(entries.filter("copies > 1").select("vector", "rep"), "vector").groupBy("rep", "id").agg(F.max("asks").alias("asks"))
    single = entries.filter("copies = 1").select("rep", F.col("rep").alias("id"), "asks")
    members = several.unionByName(single)
    first = members.withColumn("_n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("_n") <= k + 1).select(F.col("rep").alias("near"), "id")
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "id")
    answers = found.distinct().join(first, "near").withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1).select("rep", "score", "id")
    out = members.filter("asks").select("rep", F.col("id").alias("query_id")).join(answers, "rep").filter("id <> query_id")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _of_length(entries: DataFrame, n: int, k: int, held: str) -> DataFrame:
    """rep (of a query's entry), near (of an answer's), score: the ``k`` best of
    each block for each query that reads it. ``held``: the type of a component."""
    some = sample(entries, SAMPLE)
    pivots = choose_pivots(some, pivots_for(n))
    reading = fit_reading(some, pivots)
    shared = entries.sparkSession.sparkContext.broadcast((pivots, some))  # at most MOST and SAMPLE vectors
    kept, number = min(KEPT, len(pivots)), "<u1" if len(pivots) <= 256 else "<u2"
    as_bytes = lambda m, kind: pa.array([r.tobytes() for r in np.ascontiguousarray(m, kind)], pa.binary())

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = matrix(batch.column("vector"))
                nearest = orders(unit(x), shared.value[0])
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("asks"), as_bytes(x, held), as_bytes(nearest, number), pa.array(nearest[:, :POSTED].astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["rep", "asks", "vector", "order", "nearest"])

    ordered = written(entries.mapInArrow(order, "rep long, asks boolean, vector binary, order binary, nearest array<int>"), "ann-orders")
    sizes = lambda posts: {p: c for p, c in posts.groupBy("pivot").count().collect()}  # noqa: E731  a row for each pivot
    index = ordered.select("rep", "vector", "order", F.lit(0.0).alias("share"), F.explode("nearest").alias("pivot"))
    posted = sizes(index)
    in_file = np.array([posted.get(p, 0) for p in range(len(pivots))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampled = Sample(shared.value[1], shared.value[0])
        for batch in batches:
            if batch.num_rows:
                x = unit(np.frombuffer(b"".join(batch.column("vector").to_pylist()), held).reshape(batch.num_rows, -1).astype(np.float64))
                order = np.frombuffer(b"".join(batch.column("order").to_pylist()), number).reshape(batch.num_rows, kept)
                files, share = read_by(reading, sampled, x, order, in_file, FLOOR * k * POSTED)
                lists = [order[i, : files[i]].astype(np.int32).tolist() for i in range(len(x))]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("vector"), batch.column("order"), pa.array(share), pa.array(lists, pa.list_(pa.int32()))], names=["rep", "vector", "order", "share", "files"])

    asked = written(ordered.filter("asks").select("rep", "vector", "order").mapInArrow(read, "rep long, vector binary, order binary, share double, files array<int>"), "ann-queries")
    queries = asked.select("rep", "vector", "order", "share", F.explode("files").alias("pivot"))
    blocks = lambda counts, size: F.array(*(F.lit(-(-counts.get(p, 0) // size)) for p in range(len(pivots))))
    index_blocks, query_blocks = blocks(posted, BLOCK), blocks(sizes(queries), QUERY_BLOCK)
    own = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    each = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    n_index, n_query = F.get(index_blocks, F.col("pivot")), F.get(query_blocks, F.col("pivot"))
    left = index.select("pivot", own(n_index).alias("block"), each(n_query).alias("asked"), F.struct(F.lit(False).alias("asks"), "rep", "vector", "order", "share").alias("m"))
    right = queries.filter(n_index > 0).select("pivot", each(n_index).alias("block"), own(n_query).alias("asked"), F.struct(F.lit(True).alias("asks"), "rep", "vector", "order", "share").alias("m"))
    cells = left.unionByName(right).groupBy("pivot", "block", "asked").agg(F.collect_list("m").alias("members"))
    n_pivots = len(pivots)

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            for i in range(batch.num_rows):
                m = lists[i].values
                asks, reps = m.field("asks").to_numpy(zero_copy_only=False), m.field("rep").to_numpy()
                if asks.all() or not asks.any():
                    continue
                x = unit(np.frombuffer(b"".join(m.field("vector").to_pylist()), held).reshape(len(m), -1).astype(np.float64))
                share = m.field("share").to_numpy()[asks]
                places = places_of(np.frombuffer(b"".join(m.field("order").to_pylist()), number).reshape(len(m), kept), n_pivots)
                found = [(np.full(len(rows), reps[asks][j]), reps[~asks][rows], cosine) for j, rows, cosine in search_block(places[~asks], x[~asks], reps[~asks], places[asks], x[asks], k, share)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["rep", "near", "score"])

    return cells.mapInArrow(seek, "rep long, near long, score double")
