"""Quality classifier (7): a sparse rule ensemble.

Statistics of a text are Spark columns. Small trees grown on labelled rows give
paths, each a conjunction of comparisons; a lasso logistic regression leaves few
of them a weight, and those are compiled back into one Spark column, so scoring
is a narrow map without Python.

Rules are grown and weighed in one task of an executor, over the statistics of a
bounded sample.

Edge cases: null and empty texts have statistics of 0 and a score; statistics are
of whole texts, however long; labels that are null are not learnt from; repeated
rows each give a row, null ids too; of rules that hold for the same rows the first
stays; without rows of both labels, or with too few to split, the score is the smoothed share of label 1; an
empty table gives no row; columns of ``docs`` may have the names of statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import fitted, labelled_sample, text_of

#: Labelled rows to learn from at most (the first by a hash of the id).
SAMPLE = 20_000
TREES, DEPTH, LEAF, BINS = 40, 3, 12, 32
PENALTY = 0.002
PASSES = 400

SYMBOLS = "!#$%&*+/<=>@\\^_`{|}~"


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """id, the columns of ``keep`` (name: column of ``docs``) and a column for each statistic."""
    out = docs.select(*(c.alias(name) for name, c in (keep or {}).items()), F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    out = out.withColumns({"_words": F.split(F.trim("_text"), r"\s+"), "_lines": F.split("_text", "\n"), "_n": F.length("_text").cast("double")})
    out = out.withColumn("_w", F.size("_words").cast("double"))
    count = lambda c: F.col("_n") - F.length(c)
    out = out.withColumns({
        "log_chars": F.log1p("_n"),
        "log_words": F.log1p("_w"),
        "word_length": _share(F.col("_n"), F.col("_w")),
        "distinct_words": _share(F.size(F.array_distinct("_words")).cast("double"), F.col("_w")),
        "distinct_lines": _share(F.size(F.array_distinct("_lines")).cast("double"), F.size("_lines").cast("double")),
        "line_words": _share(F.col("_w"), F.size("_lines").cast("double")),
        "symbols": _share(count(F.translate("_text", SYMBOLS, "")), F.col("_n")),
        "stops": _share(count(F.translate("_text", ".,;:?", "")), F.col("_w")),
        "digits": _share(count(F.translate("_text", "0123456789", "")), F.col("_n")),
        "capitals": _share(count(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")), F.col("_n")),
        "vowels": _share(count(F.translate("_text", "aeiouAEIOU", "")), F.col("_n")),
    })
    # a generated row: what reads the statistics later can't make Spark compute them again in a pushed filter
    made = out.select("_id", *(keep or {}), F.inline(F.array(F.struct(*FEATURES))))
    return made.withColumnRenamed("_id", id_col)


FEATURES = ["log_chars", "log_words", "word_length", "distinct_words", "distinct_lines", "line_words", "symbols", "stops", "digits", "capitals", "vowels"]

#: A comparison: (feature's number, True for <=, threshold). A rule: comparisons that all hold.
Rule = tuple[tuple[int, bool, float], ...]


def grow(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """The paths to all nodes of small trees, each grown on a resample and, at
    each node, on some of the features."""
    random = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    coded = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    rules: set[Rule] = set()

    def split(rows: np.ndarray, path: Rule) -> None:
        if path:
            rules.add(tuple(sorted(path)))
        if len(path) == DEPTH or len(rows) < 2 * LEAF:
            return
        best = (1e-9, -1, 0)
        own = y[rows]
        for f in random.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False):
            n = np.bincount(coded[rows, f], minlength=len(cuts[f]) + 1).cumsum()[:-1]
            s = np.bincount(coded[rows, f], weights=own, minlength=len(cuts[f]) + 1).cumsum()[:-1]
            m, t = len(rows) - n, own.sum() - s
            ok = (n >= LEAF) & (m >= LEAF)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(n, 1) + t**2 / np.maximum(m, 1) - own.sum() ** 2 / len(rows), -1)
                if gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        _, f, at = best
        if f >= 0:
            left = coded[rows, f] <= at
            split(rows[left], (*path, (int(f), True, float(cuts[f][at]))))
            split(rows[~left], (*path, (int(f), False, float(cuts[f][at]))))

    for _ in range(TREES):
        split(random.integers(0, len(x), len(x)), ())
    return sorted(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] <= t) == below for f, below, t in rule])


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, passes: int = PASSES) -> tuple[float, np.ndarray]:
    """Intercept and weights; accelerated proximal gradient."""
    step = 4.0 / (1 + np.linalg.norm(x, 2) ** 2 / len(x))
    b, w = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), np.zeros(x.shape[1])
    pb, pw, t = b, w, 1.0
    for _ in range(passes):
        slope = (1 / (1 + np.exp(-np.clip(x @ pw + pb, -30, 30))) - y) / len(y)
        nw = pw - step * (x.T @ slope)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb, nt = pb - step * slope.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score, over the columns of ``statistics``."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            condition = F.lit(True)
            for f, below, t in rule:
                condition = condition & ((F.col(FEATURES[f]) <= t) if below else (F.col(FEATURES[f]) > t))
            total = total + F.when(condition, F.lit(float(weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def learn(stats: np.ndarray, labels: np.ndarray) -> RuleModel:
    rules = grow(stats, labels) if len(labels) and labels.min() < labels.max() else []
    if not rules:  # nothing to tell apart, or too few rows for a leaf
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return RuleModel(float(np.log(share / (1 - share))), [])
    matrix = np.stack([holds(r, stats) for r in rules], axis=1).astype(np.float64)
    seen: dict[bytes, int] = {}
    for i in range(len(rules)):  # of rules that hold for the same rows the first stays
        seen.setdefault(matrix[:, i].tobytes(), i)
    own = sorted(seen.values())
    intercept, weights = lasso_logistic(matrix[:, own], labels)
    return RuleModel(float(intercept), [(rules[i], float(w)) for i, w in zip(own, weights, strict=True) if abs(w) > 1e-9])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """Learns from the labelled rows of ``docs``, at most ``sample`` of them, picked
    by the hash of their ids."""
    rows, told = labelled_sample(docs, labels, label, sample, id_col)
    made = statistics(rows, id_col, text_col, keep={"_label": F.col(told)}).withColumn("_order", F.xxhash64(id_col))
    picked = made.orderBy("_order", *FEATURES).limit(sample).select("_label", *FEATURES)
    return fitted(picked, lambda t: learn(np.stack([t[c].to_numpy() for c in FEATURES], axis=1).astype(np.float64), t["_label"].to_numpy().astype(np.float64)))


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """id, the columns of ``keep``, score (0 to 1)."""
    return statistics(docs, id_col, text_col, keep).select(id_col, *(keep or {}), model.column().alias("score"))
