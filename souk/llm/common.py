"""What the operators of this subpackage share: tables, scratch space in the
folder that all machines see, and vectorised word hashing over Arrow buffers."""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import blake2b
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; bounds the memory of a Python worker.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="souk-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only where it
    is unset and one machine does all the work (tests) a folder of this process's
    own is made."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines see")
    return (named or _own_folder()).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, and
    readable after an executor is lost."""
    path = scratch(df.sparkSession, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def doc_crc(column: str = "doc_id"):
    """crc32 of the id as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, n: int, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """At most ``n`` labelled ids of ``docs``, picked by their hash, and the rows of
    ``docs`` with them: its columns and a column for the label, whose name is
    returned, too.

    Ids are picked from ids alone. What is broadcast has at most ``n`` rows, so
    the texts aren't shuffled.
    """
    own, told = unused(docs, "_id"), unused(docs, "_label")
    known = labels.select(F.col(id_col).alias(own), F.col(label).alias(told)).filter(F.col(told).isNotNull()).groupBy(own).agg(F.max(told).alias(told))
    picked = docs.select(F.col(id_col).alias(own)).distinct().join(known, own).orderBy(F.xxhash64(own), own).limit(n)
    return docs.join(F.broadcast(picked), F.col(id_col) == F.col(own)).drop(own), told


def fitted(rows: DataFrame, learn: Callable[[pa.Table], Any]) -> Any:
    """What ``learn`` makes of ``rows``, a bounded sample, in one task of an
    executor. Only the model reaches the driver."""
    schema = rows.limit(0).toArrow().schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        model = learn(pa.Table.from_batches(held) if held else schema.empty_table())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = rows.coalesce(1).mapInArrow(work, "model binary").collect()
    return pickle.loads(made[0][0]) if made else learn(schema.empty_table())


def text_of(column: str = "text"):
    """The text as string, empty if null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column, without a Python object made."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the texts of each hold about ``limit`` bytes;
    a row is never cut, and empty batches are left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` 64-bit values that depend on ``seed`` alone."""
    start = np.uint64(seed * 0x632BE59BD9B4E019 % 2**64)
    return mix((np.arange(1, n + 1, dtype=np.uint64) + start) * np.uint64(0x9E3779B97F4A7C15))


#: Bytes of words: A-Z become a-z; everything up to 0x7F but digits and letters separates.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)
#: A hash of a sequence is a polynomial in a fixed odd base, modulo the prime 2 ** 61 - 1.
PRIME = 2**61 - 1
_BASE = 0x1B873593CC9E2D51 % PRIME
_INVERSE = pow(_BASE, -1, PRIME)
_P, _M29, _M31, _M32 = (np.uint64(x) for x in (PRIME, 2**29 - 1, 2**31 - 1, 2**32 - 1))
_3, _29, _31, _32, _61 = (np.uint64(x) for x in (3, 29, 31, 32, 61))
_powers: dict[int, np.ndarray] = {}


def mod(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime; both are below it."""
    a_high, a_low, b_high, b_low = a >> _32, a & _M32, b >> _32, b & _M32
    middle, low = a_high * b_low + a_low * b_high, a_low * b_low
    return mod(((a_high * b_high) << _3) + (middle >> _29) + ((middle & _M29) << _32) + (low & _P) + (low >> _61))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo the prime."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.array([1], np.uint64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, multiply(have, np.full(1, pow(base, len(have), PRIME), np.uint64))])
        _powers[base] = have
    return have[:n]


def _sums(terms: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1 .. terms, modulo the prime; terms are below 2 ** 41."""
    out = np.zeros(len(terms) + 1, np.uint64)
    for at in range(0, len(terms), 1 << 20):
        part = out[at + 1 : at + 1 + (1 << 20)]
        np.cumsum(terms[at : at + (1 << 20)], out=part)
        part += out[at]
        part[:] = (part & _P) + (part >> _61)
    return out


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each segment (order counts). ``values`` are
    bytes or 64-bit numbers; starts ascend."""
    out = np.empty(len(starts), np.uint64)
    small = values.dtype == np.uint8
    at = 0
    while at < len(starts):  # blocks keep the tables of powers small
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 19), "left")))
        low = int(starts[at])
        high = int(ends[at:to].max(initial=low))
        base = powers(_BASE, high - low)
        if small:
            own = values[low:high].astype(np.uint64) + np.uint64(1)
            parts, shift = (own * (base >> _32), own * (base & _M32)), 32
        else:
            own = multiply(mod(values[low:high]), base)
            parts, shift = (own >> _31, own & _M31), 31
        s, e = starts[at:to] - low, ends[at:to] - low
        first, second = (mod(sums[e] + _P + _P - sums[s]) for sums in map(_sums, parts))
        total = mod(multiply(first, np.full(1, 1 << shift, np.uint64)) + second)
        out[at:to] = multiply(total, powers(_INVERSE, high - low + 1)[s]) ^ ((e - s).astype(np.uint64) << np.uint64(40))
        at = to
    return mix(out)


@dataclass
class Words:
    """The words of a slice of texts: byte places in ``folded``, hashes, and for
    each text the range of its words."""

    folded: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # of text i: words first[i] .. first[i + 1]

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def keys(self) -> np.ndarray:
        """A 128-bit cryptographic hash of each text's words in order, as two 64-bit numbers."""
        kept = self.folded > 0
        kept[1:] |= kept[:-1].copy()  # one separator after each word
        out = np.empty((len(self.first) - 1, 2), np.int64)
        for i, (a, b) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)):
            span = slice(int(self.starts[a]), int(self.ends[b - 1])) if b > a else slice(0, 0)
            out[i] = np.frombuffer(blake2b(self.folded[span][kept[span]].tobytes(), digest_size=16).digest(), "<i8")
        return out

    def heads(self, n: int) -> np.ndarray:
        """Hashes of the first ``n`` bytes of each word."""
        return segment_hash(self.folded, self.starts, np.minimum(self.ends, self.starts + n))


def words_of(texts: pa.Array) -> Words:
    """Words are maximal runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased."""
    raw, offsets = text_buffer(texts)
    folded = FOLD[raw]
    inside = folded > 0
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    before[edges] = False
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(folded, starts, ends, segment_hash(folded, starts, ends), np.searchsorted(starts, offsets))
