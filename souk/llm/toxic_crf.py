"""Toxicity (10): a linear-chain conditional random field over words.

Labels are of documents, the field's of words: words (and beginnings of words)
that stand in far more toxic documents than chance allows are labelled toxic
there, and the field learns from those spans - the word, its beginnings and its
neighbours as features, hashed, and how labels follow each other. Forward-backward
marginals give spans with their places; a logistic curve over their sums gives
the document's score.

Training runs in one task of an executor, over a bounded sample.

Edge cases: null and empty texts have no spans and the score of a document
without any; texts of any length are tagged whole, cut into segments for the
recursions alone; null labels aren't learnt from; repeated texts are learnt from
once; repeated rows each give a row, null ids too; without rows of both labels the
score is the smoothed share of toxic rows; an empty table gives no row; columns
beside the id and the text aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm.bag_minhash import shingles
from souk.llm.common import fitted, labelled_sample, mix, slices, text_buffer, text_of, words_of

#: Labelled rows to learn from at most (the first by a hash of the id), and of them for the field.
SAMPLE, FIELD_SAMPLE = 10_000, 2_000
#: Slots of the feature table, and passes over the field's rows.
SLOTS, PASSES = 1 << 18, 25
#: Words of a segment: documents are cut into rows of so many for the recursions.
SEGMENT = 256
SLICE = 1 << 20
_SEEDS = [np.uint64(x * 0x9E3779B97F4A7C15 % 2**64) for x in range(1, 6)]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, object]:
    """(slots: words x 5, first word of each text, words)."""
    words = words_of(texts)
    h = words.hashes
    n = len(h)
    inner_start = np.zeros(n, bool)
    inner_start[words.first[:-1][words.first[:-1] < n]] = True
    before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    before[1:] = h[:-1]
    before[inner_start] = 0
    after[:-1] = h[1:]
    last = words.first[1:][words.first[1:] > 0] - 1
    after[last] = 0
    units = [h, words.heads(5), words.heads(4), before, after]
    slots = np.stack([(mix(u ^ s) & np.uint64(SLOTS - 1)).astype(np.int32) for u, s in zip(units, _SEEDS, strict=True)], axis=1)
    return slots, words.first, words


class Lattice:
    """Words of many documents as rows of segments, so that a recursion over
    all of them takes ``SEGMENT`` vectorised steps."""

    def __init__(self, first: np.ndarray):
        counts = np.diff(first)
        pieces = -(-counts // SEGMENT)
        owner = np.repeat(np.arange(len(counts)), pieces)
        self.number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.start = first[owner] + self.number * SEGMENT
        self.length = np.minimum(SEGMENT, first[owner + 1] - self.start) if len(owner) else np.zeros(0, np.int64)
        self.width = int(self.length.max(initial=0))
        self.last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
        self.rows = np.repeat(np.arange(len(owner)), self.length)
        self.columns = np.arange(len(self.rows)) - np.repeat(np.cumsum(self.length) - self.length, self.length)

    def run(self, energy: np.ndarray, trans: np.ndarray, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of label 1; the sums over all words of those of the four label
        pairs (of the word before and itself; a text's first word has none)."""
        n, width = len(self.start), self.width
        if not n:
            return np.zeros(0), np.zeros(4)
        e = np.ones((width, n))
        e[self.columns, self.rows] = np.exp(np.clip(energy, -30, 30))
        on = np.arange(width)[:, None] < self.length
        t = np.exp(trans)
        begin = self.number == 0
        # products of the segments' matrices; the matrix of a text's first word forgets what was before
        p = np.zeros((4, n))
        p[0] = p[3] = 1
        for k in range(width):
            a, b, c, d = (np.where(begin, 1.0, x) for x in t.ravel()) if k == 0 else t.ravel()
            q = np.stack([p[0] * a + p[1] * c, (p[0] * b + p[1] * d) * e[k], p[2] * a + p[3] * c, (p[2] * b + p[3] * d) * e[k]])
            q /= q.sum(axis=0)
            p = np.where(on[k], q, p)
        v, u = np.full((2, n), 0.5), np.full((2, n), 0.5)
        for k in range(1, int(self.number.max()) + 1):  # from segment to segment, all texts at once
            at = np.flatnonzero(self.number == k)
            x = v[:, at - 1]
            y = np.stack([x[0] * p[0, at - 1] + x[1] * p[2, at - 1], x[0] * p[1, at - 1] + x[1] * p[3, at - 1]])
            v[:, at] = y / y.sum(axis=0)
        for k in range(int(self.number.max()) - 1, -1, -1):
            at = np.flatnonzero((self.number == k) & ~self.last)
            x = u[:, at + 1]
            y = np.stack([p[0, at + 1] * x[0] + p[1, at + 1] * x[1], p[2, at + 1] * x[0] + p[3, at + 1] * x[1]])
            u[:, at] = y / y.sum(axis=0)
        forward = np.empty((width, n))  # share of label 1 after word k
        x = v[1].copy()
        entering = x.copy()
        for k in range(width):
            a, b, c, d = (np.where(begin, 1.0, z) for z in t.ravel()) if k == 0 else t.ravel()
            low, high = (1 - x) * a + x * c, ((1 - x) * b + x * d) * e[k]
            x = np.where(on[k], high / (low + high), x)
            forward[k] = x
        marginal = np.empty((width, n))
        pairs = np.zeros(4)
        y = u[1].copy()  # share of label 1 in the message from the right
        for k in range(width - 1, -1, -1):
            f = forward[k]
            one = f * y
            marginal[k] = one / (one + (1 - f) * (1 - y))
            x = forward[k - 1] if k else entering
            right0, right1 = 1 - y, e[k] * y
            if with_pairs:
                cell = np.stack([(1 - x) * t[0, 0] * right0, (1 - x) * t[0, 1] * right1, x * t[1, 0] * right0, x * t[1, 1] * right1])
                pairs += (cell / cell.sum(axis=0))[:, on[k] & ~(begin & (k == 0))].sum(axis=1)
            a, b, c, d = (np.where(begin, 1.0, z) for z in t.ravel()) if k == 0 else t.ravel()
            m0, m1 = a * right0 + b * right1, c * right0 + d * right1
            y = np.where(on[k], m1 / (m0 + m1), y)
        return marginal[self.columns, self.rows], pairs


@dataclass
class ToxicModel:
    weights: np.ndarray  # of the feature slots
    bias: float
    trans: np.ndarray
    curve: np.ndarray  # intercept, of the largest marginal, of log(1 + their sum)

    def marginals(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        return Lattice(first).run(sum(self.weights[slots[:, i]] for i in range(slots.shape[1])) + self.bias, self.trans, with_pairs=False)[0]

    def scores(self, marginals: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(summary(marginals, first) @ self.curve)))


def summary(marginals: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1, the largest marginal and log(1 + their sum), for each document."""
    out = np.zeros((len(first) - 1, 3))
    out[:, 0] = 1
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full, 1] = np.maximum.reduceat(marginals, first[full])
        out[full, 2] = np.log1p(np.add.reduceat(marginals, first[full]))
    return out


def fresh(parts: list[pa.Array]) -> np.ndarray:
    """Which texts are no near copies of an earlier one: copies of one document
    would make all of its words look telling. A text is a copy if it shares one of
    three least shingles with an earlier text."""
    seen: set[tuple[int, int]] = set()
    out: list[bool] = []
    for part in parts:
        text, h, _ = shingles(words_of(part))
        own = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, np.int64)
        least = [np.minimum.reduceat(mix(h ^ seed), own) if len(own) else h for seed in _SEEDS[:3]]
        keys: list[list[tuple[int, int]]] = [[] for _ in range(len(part))]
        for k, values in enumerate(least):
            for i, v in zip(text[own].tolist(), values.tolist(), strict=True):
                keys[i].append((k, v))
        for mine in keys:
            out.append(not any(x in seen for x in mine))
            seen.update(mine)
    return np.array(out, bool)


class Associations:
    """Of each slot of one kind of unit: the documents, and the toxic ones, that hold it."""

    def __init__(self):
        self.total, self.toxic = np.zeros(SLOTS), np.zeros(SLOTS)

    def add(self, slots: np.ndarray, first: np.ndarray, labels: np.ndarray) -> None:
        doc = np.repeat(np.arange(len(labels)), np.diff(first))
        pairs = np.unique(doc.astype(np.int64) * SLOTS + slots)
        units, owner = pairs % SLOTS, pairs // SLOTS
        self.total += np.bincount(units, minlength=SLOTS)
        self.toxic += np.bincount(units, weights=labels[owner], minlength=SLOTS)

    def telling(self) -> np.ndarray:
        """Slots that toxic documents hold far more often than chance allows: the
        log likelihood ratio beats that of the best of all units."""
        total, toxic = self.total, self.toxic
        prior = min(max(toxic.sum() / max(total.sum(), 1), 1e-9), 1 - 1e-9)
        share = toxic / np.maximum(total, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(toxic > 0, toxic * np.log(share / prior), 0) + np.where(total > toxic, (total - toxic) * np.log((1 - share) / (1 - prior)), 0)
        return (share > 0.8) & (gain > np.log(max(2, np.count_nonzero(total))) + 2)


def fit_field(slots: np.ndarray, first: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Maximum likelihood with a small ridge, by Adagrad over all rows at once."""
    weights, bias, trans = np.zeros(SLOTS), -2.0, np.zeros((2, 2))
    lattice = Lattice(first)
    followers = np.ones(len(tags), bool)
    followers[first[:-1][first[:-1] < len(tags)]] = False
    seen = np.bincount(2 * np.append(0, tags[:-1])[followers].astype(int) + tags[followers].astype(int), minlength=4) if len(tags) else np.zeros(4)
    g_w, g_b, g_t = np.full(SLOTS, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    used = np.unique(slots)
    for _ in range(PASSES):
        marginal, pairs = lattice.run(weights[slots].sum(axis=1) + bias, trans)
        miss = tags - marginal
        grad = sum(np.bincount(slots[:, i], weights=miss, minlength=SLOTS) for i in range(slots.shape[1])) - 0.01 * weights
        g_w[used] += grad[used] ** 2
        weights[used] += 0.7 * grad[used] / np.sqrt(g_w[used])
        grad_b, grad_t = miss.sum(), (seen - pairs).reshape(2, 2)
        g_b += grad_b**2
        g_t += grad_t**2
        bias += 0.5 * grad_b / np.sqrt(g_b)
        trans += 0.2 * grad_t / np.sqrt(g_t)
        trans -= trans[0, 0]
    return weights, float(bias), trans


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - 0.5 * w)
    return w


def learn(texts: pa.Array, labels: np.ndarray) -> ToxicModel:
    labels = labels.astype(np.float64)
    flat = ToxicModel(np.zeros(SLOTS), -30.0, np.zeros((2, 2)), np.array([0.0, 0.0, 0.0]))
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    if not len(labels) or labels.min() == labels.max():
        flat.curve[0] = np.log(share / (1 - share))
        return flat
    parts = []  # texts are read again for each purpose, a slice at a time: the driver holds no features of all
    at = 0
    for batch in slices(iter([pa.RecordBatch.from_arrays([texts], names=["_text"])]), "_text", SLICE):
        parts.append((batch.column("_text"), labels[at : at + batch.num_rows], at))
        at += batch.num_rows
    new = fresh([part for part, _, _ in parts])
    kinds = [Associations() for _ in range(3)]
    for part, own, at in parts:
        alone = new[at : at + len(own)]
        own, (slots, first, _) = own[alone], features(part.filter(pa.array(alone)))
        for kind, found in enumerate(kinds):
            found.add(slots[:, kind], first, own)
    telling = [k.telling() for k in kinds]
    some = np.zeros(len(labels), bool)  # toxic rows up to half of the field's sample, then others
    for value in (1, 0):
        some[np.flatnonzero((labels == value) & new)[: FIELD_SAMPLE // 2]] = True
    field = [(part.filter(pa.array(some[at : at + len(own)])), own[some[at : at + len(own)]]) for part, own, at in parts]
    collected = [(*features(part)[:2], own) for part, own in field if len(own)]
    tags = [np.logical_or.reduce([telling[k][slots[:, k]] for k in range(3)]) & (np.repeat(own, np.diff(first)) > 0) for slots, first, own in collected]
    counts = np.concatenate([np.diff(first) for _, first, _ in collected])
    weights, bias, trans = fit_field(np.concatenate([slots for slots, _, _ in collected]), np.append(0, np.cumsum(counts)), np.concatenate(tags).astype(np.float64))
    model = ToxicModel(weights, bias, trans, flat.curve)
    sums = [summary(model.marginals(slots, first), first) for slots, first, _ in (features(part) for part, _, _ in parts)]
    model.curve = fit_curve(np.concatenate(sums), labels)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """Learns from the labelled rows of ``docs``, at most ``sample`` of them, picked
    by the hash of their ids; near copies are told from once."""
    rows, told = labelled_sample(docs, labels, label, sample, id_col)
    rows = rows.select(F.xxhash64(id_col).alias("_order"), text_of(text_col).alias("_text"), F.col(told).alias("_label"))
    return fitted(rows.orderBy("_order", "_text").limit(sample), learn_table)


def learn_table(rows: pa.Table) -> ToxicModel:
    """From _text and _label; the first of equal texts counts."""
    seen: set[bytes] = set()
    new = []
    for text in rows["_text"]:
        key = blake2b(text.as_buffer() or b"", digest_size=16).digest()
        new.append(key not in seen)
        seen.add(key)
    rows = rows.filter(pa.array(new, pa.bool_()))
    return learn(rows["_text"].combine_chunks(), rows["_label"].to_numpy())


def tag(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", level: float = 0.5, whole: bool = False) -> DataFrame:
    """A row for each row of ``docs``: id, score (0 to 1), n_words, spans (array of
    start and end in characters, score: runs of words whose marginal is at least
    ``level``); if ``whole``, _row, too, a struct of all columns of ``docs``. A narrow
    map over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed: SLOTS weights
    if whole:
        source = docs.select(F.col(id_col).alias("_id"), F.struct(*(F.col(c) for c in docs.columns)).alias("_row"))
    else:
        source = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    carried = ["_row"] if whole else []
    place = docs.columns.index(text_col)
    out = T.StructType([f for f in source.schema if f.name != "_text"]).add("score", "double").add("n_words", "long").add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("score", "double")))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The text out of the row, which holds it once."""
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_row"), b.column("_row").field(place).cast(pa.string())], names=["_id", "_row", "_text"]) if whole else b

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(texts(batches), "_text", SLICE):
            slots, first, words = features(batch.column("_text"))
            marginals = model.marginals(slots, first)
            hit = np.flatnonzero(marginals >= level)
            doc = np.searchsorted(first, hit, "right") - 1
            new = np.ones(len(hit), bool)
            new[1:] = (np.diff(hit) != 1) | (np.diff(doc) != 0)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            if len(hit):
                opened = np.flatnonzero(new)
                closed = np.append(opened[1:], len(hit)) - 1
                # a character begins at each byte that doesn't continue one; separators are folded to 0
                raw, offsets = text_buffer(batch.column("_text"))
                chars = np.cumsum((raw & 0xC0) != 0x80) - 1
                bases = chars[np.minimum(offsets[:-1], len(raw) - 1)]
                best = np.maximum.reduceat(marginals[hit], opened)
                for i, a, b, s in zip(doc[opened].tolist(), words.starts[hit[opened]], words.ends[hit[closed]], best.tolist(), strict=True):
                    spans[i].append({"start": int(chars[a] - bases[i]), "end": int(chars[b - 1] - bases[i] + 1), "score": s})
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(batch.column(c) for c in carried), pa.array(model.scores(marginals, first)), pa.array(np.diff(first), pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))], names=["_id", *carried, "score", "n_words", "spans"])

    return source.mapInArrow(work, out).withColumnRenamed("_id", id_col)

