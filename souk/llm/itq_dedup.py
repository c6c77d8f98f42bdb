"""Embedding near-dedup (4): iterative quantisation.

Rotations learnt on a bounded sample turn vectors into balanced binary codes.
The code is cut into substrings, one for each hash table: vectors that agree in
a substring meet in that table's bucket (multi-index Hamming search). Tables hold ids
and codes; in a bucket, those stay that have another one within the Hamming radius
of their whole codes. Only they fetch their original vectors, which decide: a link is
a cosine of at least the threshold in double precision. So many tables are made that
a pair exactly at the threshold meets with probability ``RECALL`` if its bits are
independent; closer pairs meet more surely. What counts is the angle that such a pair has
once the mean is taken off, at the row nearest to the mean: the more direction the vectors
share, the wider it is. Rows much nearer to the mean than others (``INNER`` of the norm
that one in a hundred is under) don't widen it.

Tables alone leave pairs out: one in a thousand at the threshold, more where few
dimensions matter and rotations coincide, and those of rows near the mean. So an exact
check follows (``_rest``): blocks of rows by the first bits of their code, each with a
centre and a radius, and all pairs of blocks that the triangle inequality can't exclude.
In these, half-precision copies of the vectors, with a bound for what they are off, find the
pairs that no table has brought together, and again the original vectors decide. Where an
angle needs more than ``MOST`` tables, which only vectors do that nearly all point one way,
there are no tables and the check has all pairs. The radius is the distance of the codes of a
pair at the threshold on average and ``SPREAD`` standard deviations more.

Equal vectors are one entry with a count. A bucket that holds more than ``BLOCK``
entries is dealt out as pairs of blocks, so no task takes an unbounded group, and
no bucket gives out its pairs: a block gives, for each entry, how many links it
found first there, and the least entry that these links reach from it.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; rows of a null id are kept, unlinked, with a null
component; vectors of another length than most are compared among themselves;
pairs exactly at the threshold are linked: a cosine that rounding could move across it is
dot / sqrt(square * square), each summed from the first component on, as in SQL;
repeated rows each give a row, and of equal vectors the least id stands for all; an empty
table gives no row; columns beside the id and the vector aren't read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import written
from souk.llm.components import connected
from souk.llm.vectors import distinct_vectors, matrix, prepared, sample, unit, usable

SAMPLE = 10_000
ROUNDS = 30
RECALL = 0.999
#: Entries that a bucket has on average if codes are balanced.
BUCKET = 64
BLOCK = 2048
#: What a row posted in a table costs, in pairs compared.
POST = 64
#: Tables at most, and the share of a low norm under which a row is apart.
MOST, INNER = 1000, 0.8
#: Least rows and most bytes of a block that the exact check compares with others.
REST, REST_BYTES = 4096, 8 << 20
SIFTED = "table int, key int, low int, high int, rep long, code binary, own int"
#: A cosine of unit vectors this near to the threshold is computed again.
SLACK = 1e-10
#: Standard deviations by which codes at the threshold may be farther apart than on average.
SPREAD = 6.0


def learn_rotation(x: np.ndarray, random: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Alternates between the signs of the rotated sample and the rotation that
    fits them best (orthogonal Procrustes)."""
    d = x.shape[1]
    rotation = np.linalg.qr(random.standard_normal((d, d)))[0]
    for _ in range(rounds):
        signs = np.where(x @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(x.T @ signs)
        rotation = left @ right
    return rotation


def centred_angle(threshold: float, least: float) -> float:
    """The widest angle from the mean between two unit vectors at the threshold
    that are both at least ``least`` away from it: their chord seen from there."""
    return 2 * math.asin(min(1.0, math.sqrt((1 - threshold) / 2) / max(least, 1e-12)))


def tables_for(bits: int, angle: float) -> float:
    """Tables in one of which a pair at ``angle`` agrees with probability ``RECALL``."""
    agree = (1 - angle / math.pi) ** bits
    return math.inf if agree < 1e-9 else 1 if agree >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - agree))


def inner_norm(norms: np.ndarray) -> float:
    """The distance from the mean under which a row is apart."""
    return INNER * float(np.quantile(norms, 0.01)) if len(norms) else 0.0


def plan(centred: np.ndarray, rotation: np.ndarray, n: int, threshold: float) -> tuple[int, int]:
    """(bits of a substring, tables) for ``n`` entries: the cheapest that keep ``RECALL`` for
    rows that aren't apart, in pairs compared and rows posted for each entry. No bits and
    one table are all pairs, for vectors that no ``MOST`` tables bring together."""
    norms = np.linalg.norm(centred, axis=1)
    angle = centred_angle(threshold, norms[norms >= inner_norm(norms)].min())
    signs = np.where(centred[:1000] @ rotation >= 0, 1.0, -1.0)
    same = (1 + signs @ signs.T / signs.shape[1])[np.triu_indices(len(signs), 1)] / 2  # share of bits in which a pair agrees
    best, least = (0, 1), math.inf
    for bits in range(6, int(min(24, max(6, math.ceil(math.log2(max(2, n / BUCKET)))))) + 1):
        tables = tables_for(bits, angle)
        cost = tables * (POST + n / 2 * max((same**bits).mean() if len(same) else 1.0, 2.0**-bits))
        if tables <= MOST and cost < least:
            best, least = (bits, tables), cost
    return best


@dataclass(frozen=True)
class Codes:
    """How vectors become codes: less the mean, projected on the columns, signs. The
    code is cut into ``tables`` substrings of ``bits`` bits."""

    mean: np.ndarray
    columns: np.ndarray
    bits: int
    tables: int
    radius: float
    inner: float = 0.0  # rows nearer to the mean are apart: tables don't bring them together surely

    @property
    def last(self) -> int:
        """How many tables there are, and the number of the exact check."""
        return self.tables if self.bits else 0

    def apart(self, x: np.ndarray) -> np.ndarray:
        return np.linalg.norm(x - self.mean, axis=1) < self.inner if self.bits else np.zeros(len(x), bool)

    def signs(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.columns >= 0

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """The substrings of each row's code: rows x tables."""
        return (signs.reshape(len(signs), self.tables, self.bits) * (1 << np.arange(self.bits))).sum(axis=2).astype(np.int32)

    def packed(self, codes: bytes) -> np.ndarray:
        """The bytes of codes: rows x bytes of a code (at least one, so that no bits have rows, too)."""
        return np.frombuffer(codes, np.uint8).reshape(-1, max(1, -(-self.bits * self.tables // 8)))

    def unpacked(self, packed: np.ndarray) -> np.ndarray:
        return np.unpackbits(packed, axis=1, count=self.bits * self.tables).astype(bool)


def fit(entries: np.ndarray, n: int, threshold: float, seed: int = 5) -> Codes:
    """Each rotation gives as many bits as the vectors have components; the sample is
    centred, so that the codes are balanced."""
    random = np.random.default_rng(seed)
    d = entries.shape[1]
    mean = entries.mean(axis=0)
    first = learn_rotation(entries - mean, random)
    bits, tables = plan(entries - mean, first, n, threshold)
    more = -(-bits * tables // d) - 1
    columns = np.concatenate([r[:, random.permutation(d)] for r in (first, *(learn_rotation(entries - mean, random) for _ in range(more)))], axis=1)
    total = bits * tables
    norms = np.linalg.norm(entries - mean, axis=1)
    inner = inner_norm(norms)
    apart = centred_angle(threshold, norms[norms >= inner].min()) / math.pi  # share of bits in which a pair differs
    return Codes(mean, columns[:, :total], bits, tables, total * apart + SPREAD * math.sqrt(total * apart * max(0.0, 1 - apart)), inner)


def near_codes(signs: np.ndarray, keys: np.ndarray, side: np.ndarray, table: int, radius: float) -> np.ndarray:
    """Rows of a block, or of two, that have another row within the radius which no
    earlier table has brought together with them."""
    first, second = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    code = np.where(signs, np.float32(1), np.float32(-1))
    found = np.zeros(len(signs), bool)
    for at in range(0, len(first), 512):
        rows = first[at : at + 512]
        i, j = np.nonzero(code[rows] @ code[second].T >= signs.shape[1] - 2 * radius)  # agreements less differences
        i, j = rows[i], second[j]
        keep = (i != j) & ~(keys[i, :table] == keys[j, :table]).any(axis=1)
        found[i[keep]] = found[j[keep]] = True
    return np.flatnonzero(found)


def met(codes: Codes, packed: np.ndarray, keys: np.ndarray, i: np.ndarray, j: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the codes of each pair are within the radius, and whether it shares the
    key of one of the first ``table`` tables. Tables have the pairs that do both."""
    near, shared = np.zeros(len(i), bool), np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        near[at : at + len(a)] = np.bitwise_count(packed[a] ^ packed[b]).sum(axis=1, dtype=np.int64) <= codes.radius
        left = np.arange(len(a))
        for t in range(table):
            agree = keys[a[left], t] == keys[b[left], t]
            shared[at + left[agree]] = True
            left = left[~agree]
            if not len(left):
                break
    return near, shared


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of ``x`` with that of ``y``. Scaled by powers of two, which round nothing."""
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) for v in (x, y))
    total = lambda v: np.cumsum(v, axis=1)[:, -1]
    return total(x * y) / np.sqrt(total(x * x) * total(y * y))


def join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (of each row the first of those that links reach) with the links i, j added."""
    while True:
        apart = root[i] != root[j]
        if not apart.any():
            return root
        i, j = i[apart], j[apart]
        a, b = root[i], root[j]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def compare(vectors: np.ndarray, codes: Codes, packed: np.ndarray, copies: np.ndarray, reps: np.ndarray, side: np.ndarray, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links within a block (all sides equal) or between two that ``table`` is the first to
    have; the number after the last is the exact check's, which has what no table has. For the
    entries that have any, (row, links, least entry that they reach)."""
    x, keys, last = unit(vectors), codes.keys(codes.unpacked(packed)), table == codes.last
    first, second = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    within = side.min() == side.max()
    count, root = np.zeros(len(x), np.int64), np.arange(len(x))
    for at in range(0, len(first), 512):  # a strip of the matrix at a time
        rows = first[at : at + 512]
        product = x[rows] @ x[second].T
        i, j = np.nonzero(product >= threshold - SLACK)
        unsure = np.flatnonzero(product[i, j] <= threshold + SLACK)
        i, j = rows[i], second[j]
        keep = i != j
        for start in range(0, len(unsure), 1 << 14):
            part = unsure[start : start + (1 << 14)]
            keep[part] &= cosine(vectors[i[part]], vectors[j[part]]) >= threshold
        i, j = i[keep], j[keep]
        near, shared = met(codes, packed, keys, i, j, table)
        keep = ~(near & shared) if last else near & ~shared
        i, j = i[keep], j[keep]
        root = join(root, i, j)
        for a, b in ((i, j),) if within else ((i, j), (j, i)):
            count += np.bincount(a, weights=copies[b], minlength=len(x)).astype(np.int64)
    found = np.flatnonzero(count)
    least = np.full(len(x), np.iinfo(np.int64).max)
    np.minimum.at(least, root, reps)
    return found, count[found], least[root[found]]


def link(vectors: DataFrame, threshold: float = 0.9, sample_rows: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each row of ``vectors``: id, n_links, component_id, kept."""
    entries = written(distinct_vectors(usable(vectors, id_col, vector_col)), "itq-entries")
    parts = [_of_length(entries.filter(F.size("vector") == d), n, threshold, sample_rows) for d, n in entries.groupBy(F.size("vector")).count().collect()]
    bad = prepared(vectors, id_col, vector_col).filter("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    if not parts:
        return bad.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))
    links = parts[0]
    for more in parts[1:]:
        links = links.unionByName(more)
    links = written(links, "itq-links")
    groups = connected(links.select(F.col("rep").alias("a"), F.col("near").alias("b")).distinct(), "itq")
    counted = links.groupBy("rep").agg(F.sum("links").alias("links"))
    per_entry = entries.join(counted, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    per_entry = per_entry.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # a copy finds its entry by the vector; a vector that many rows hold is a skewed join, which Spark splits
    found = usable(vectors, id_col, vector_col).join(per_entry, "vector").select("id", "n_links", "component_id")
    return found.unionByName(bad).select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


def _of_length(entries: DataFrame, n: int, threshold: float, sample_rows: int) -> DataFrame:
    """rep, links, near: what each block found."""
    model = fit(sample(entries, sample_rows), n, threshold)
    shared = entries.sparkSession.sparkContext.broadcast(model)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = unit(matrix(batch.column("vector")))
                signs = shared.value.signs(x)
                packed = [r.tobytes() or b"\0" for r in np.packbits(signs, axis=1)]
                half = [r.tobytes() for r in x.astype(np.float16)]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(packed, pa.binary()), pa.array(shared.value.keys(signs).tolist(), pa.list_(pa.int32())), pa.array(half, pa.binary())], names=["rep", "code", "keys", "half"])

    coded = written(entries.mapInArrow(code, "rep long, code binary, keys array<int>, half binary"), "itq-codes")
    cell = ["table", "key", "low", "high"]
    dealt = _rest(coded, n, model, shared, threshold)
    if model.bits:
        posted = coded.select("rep", "code", F.posexplode("keys").alias("table", "key"))
        sizes = posted.groupBy("table", "key").count()
        large = sizes.filter(F.col("count") > BLOCK).select("table", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
        posted = posted.join(large, ["table", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("rep"), "blocks").cast("int")
        posted = posted.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        posted = posted.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
        held = posted.groupBy(*cell).agg(F.collect_list(F.struct("rep", "code", "own")).alias("members")).filter(F.size("members") > 1)
        dealt = dealt.unionByName(written(held.mapInArrow(_sift(shared), SIFTED), "itq-near"))
    fetched = dealt.join(entries.select("rep", "copies", "vector"), "rep")
    cells = fetched.groupBy(*cell).agg(F.collect_list(F.struct("rep", "copies", "vector", "code", "own")).alias("members")).filter(F.size("members") > 1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        for batch in batches:
            out: list[np.ndarray] = []
            for table, crossing, m in _members(batch):
                reps, copies, side = (m.field(f).to_numpy() for f in ("rep", "copies", "own"))
                if crossing and side.min() == side.max():
                    continue  # one of the blocks is empty; the pairs within are judged in their own cell
                packed = codes.packed(b"".join(m.field("code").to_pylist()))
                rows, count, near = compare(matrix(m.field("vector")), codes, packed, copies, reps, side, table, threshold)
                if len(rows):
                    out.append(np.stack([reps[rows], count, near]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], names=["rep", "links", "near"])

    return cells.mapInArrow(judge, "rep long, links long, near long")


def half_error(d: int) -> float:
    """How far the product of two unit vectors of ``d`` components can be from that of their
    half-precision copies, summed in single precision."""
    off = 2.0**-11 + 2.0**-25 * math.sqrt(d)
    return 2 * off + off * off + d * 2.0**-22


def _rest(coded: DataFrame, n: int, model: Codes, shared, threshold: float) -> DataFrame:
    """Cells, as a table after the last, of all rows that may have a link which no table has."""
    d, bytes_of_code = len(model.mean), model.packed(b"").shape[1]
    size = max(1, min(max(REST, n // 8), REST_BYTES // (2 * d + bytes_of_code + 8)))
    bits = min(model.bits, max(0, math.ceil(math.log2(n / size))))
    prefixed = coded.withColumn("prefix", F.col("keys")[0].bitwiseAND(F.lit((1 << bits) - 1)))
    first, numbers = 0, []
    for prefix, count in prefixed.groupBy("prefix").count().orderBy("prefix").collect():  # not more than blocks
        numbers.append((prefix, max(1, round(count / size)), first))
        first += numbers[-1][1]
    places = F.broadcast(coded.sparkSession.createDataFrame(numbers, "prefix int, blocks int, first int"))
    block = (F.col("first") + F.pmod(F.xxhash64("rep"), "blocks")).cast("int")
    members = prefixed.join(places, "prefix").groupBy(block.alias("block")).agg(F.collect_list(F.struct("rep", "code", "half")).alias("members"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m = batch.column("members")[i].values
                code, half = (b"".join(m.field(f).to_pylist()) for f in ("code", "half"))
                x = np.frombuffer(half, np.float16).reshape(-1, d).astype(np.float64)
                centre = x.mean(axis=0)
                radius = float(np.linalg.norm(x - centre, axis=1).max())
                row = [[batch.column("block")[i].as_py()], [m.field("rep").to_numpy().tobytes()], [code], [half], [centre.tolist()], [radius]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.float64()), strict=True)], names=["block", "reps", "codes", "halves", "centre", "radius"])

    blocks = written(members.mapInArrow(pack, "block int, reps binary, codes binary, halves binary, centre array<double>, radius double"), "itq-blocks")
    a, b = (blocks.select(F.col("block").alias(x), F.col("centre").alias(f"{x}_centre"), F.col("radius").alias(f"{x}_radius")) for x in ("low", "high"))
    apart = F.sqrt(F.aggregate(F.zip_with("low_centre", "high_centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 4 * half_error(d)  # between two linked vectors
    pairs = a.crossJoin(b).filter((F.col("low") <= F.col("high")) & (apart <= F.col("low_radius") + F.col("high_radius") + reach))
    sides = pairs.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    parts = min(4096, first * (first + 1) // 2)
    both = blocks.select("block", "reps", "codes", "halves").join(F.broadcast(sides), "block").repartition(parts, "low", "high")
    both = both.groupBy("low", "high").agg(F.collect_list(F.struct("block", "reps", "codes", "halves")).alias("sides"))
    return written(both.mapInArrow(_check(shared, threshold, size), SIFTED), "itq-rest")


def _check(shared, threshold: float, size: int) -> Callable:
    """Of two blocks, or of one with itself, the rows that may have links which no table
    has, in cells of ``BLOCK`` rows a side."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        d = len(codes.mean)
        least = np.float32(threshold - half_error(d))
        for batch in batches:
            for sides in batch.column("sides"):
                held = sorted(sides.as_py(), key=lambda s: s["block"])
                reps = [np.frombuffer(s["reps"], np.int64) for s in held]
                packed = np.concatenate([codes.packed(s["codes"]) for s in held])
                half = [np.frombuffer(s["halves"], np.float16).reshape(-1, d) for s in held]
                x, ids = np.concatenate(half).astype(np.float32), np.concatenate(reps)
                keys = codes.keys(codes.unpacked(packed))
                middle = len(reps[0]) if len(held) > 1 else 0  # rows of the second side begin here
                number = lambda row: held[0]["block"] * (1 << 12) + row // BLOCK if row < middle or not middle else held[1]["block"] * (1 << 12) + (row - middle) // BLOCK
                for at in range(0, len(reps[0]), BLOCK):
                    to = min(at + BLOCK, len(reps[0]))
                    for other in range(middle, len(ids), BLOCK) if middle else range(at, len(ids), BLOCK):
                        end = min(other + BLOCK, len(ids))
                        found = np.zeros(len(ids), bool)
                        for start in range(at, to, 256):
                            i, j = np.nonzero(x[start : min(start + 256, to)] @ x[other:end].T >= least)
                            i, j = i + start, j + other
                            ahead = i < j
                            i, j = i[ahead], j[ahead]
                            near, together = met(codes, packed, keys, i, j, codes.last)
                            left = ~(near & together)
                            found[i[left]] = found[j[left]] = True
                        rows = np.flatnonzero(found)
                        if len(rows):
                            low, high = number(at), number(other)
                            place = [pa.array(np.full(len(rows), v, np.int32)) for v in (codes.last, 0, low, high)]
                            own = np.where((rows >= at) & (rows < to), low, high).astype(np.int32)
                            yield pa.RecordBatch.from_arrays([*place, pa.array(ids[rows]), pa.array([r.tobytes() for r in packed[rows]], pa.binary()), pa.array(own)], names=["table", "key", "low", "high", "rep", "code", "own"])

    return check


def _members(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, pa.StructArray]]:
    """(table, whether the cell is of two blocks, members) of each cell."""
    crossing = batch.column("low").to_numpy() != batch.column("high").to_numpy()
    for i, (table, two) in enumerate(zip(batch.column("table").to_pylist(), crossing.tolist(), strict=True)):
        yield table, two, batch.column("members")[i].values


def _sift(shared) -> Callable:
    """Of each cell the members that have another one within the Hamming radius."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        for batch in batches:
            for i, (table, crossing, m) in enumerate(_members(batch)):
                side = m.field("own").to_numpy()
                if crossing and side.min() == side.max():
                    continue
                signs = codes.unpacked(codes.packed(b"".join(m.field("code").to_pylist())))
                rows = near_codes(signs, codes.keys(signs), side, table, codes.radius)
                if len(rows):
                    kept = m.take(pa.array(rows))
                    place = [pa.array(np.full(len(rows), batch.column(c)[i].as_py(), np.int32)) for c in ("table", "key", "low", "high")]
                    yield pa.RecordBatch.from_arrays([*place, *(kept.field(c) for c in ("rep", "code", "own"))], names=["table", "key", "low", "high", "rep", "code", "own"])

    return sift
