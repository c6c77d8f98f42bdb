"""Recall of the permutation index on tables that it finds hard, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from souk.llm import permutation_index as P
from souk.llm.vectors import unit


def table_of(name: str, n: int, d: int = 48) -> np.ndarray:
    rng = np.random.default_rng(5)
    g = lambda *shape: rng.standard_normal(shape)
    if name == "isotropic":
        return g(n, d)
    if name == "cone":
        mean = g(1, d)
        return 3 * mean / np.linalg.norm(mean) + g(n, d) / np.sqrt(d)
    if name == "strays":  # every 25th row points anywhere
        x = g(10, d)[rng.integers(0, 10, n)] + 0.02 * g(n, d)
        x[::25] = g(len(x[::25]), d)
        return x
    clusters, spread = name.split("/")
    return g(int(clusters), d)[rng.integers(0, int(clusters), n)] + float(spread) * g(n, d)


def recall(x: np.ndarray, asks: np.ndarray, answers: dict[int, list[int]], k: int = 5) -> float:
    u = unit(x)
    cosine = u[asks] @ u.T
    cosine[np.arange(len(asks)), asks] = -2
    true = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
    return float(np.mean([len(set(t) & set(answers.get(int(q), []))) / k for q, t in zip(asks, true.tolist(), strict=True)]))


@pytest.mark.parametrize("name", ["isotropic", "cone", "200/0.02", "20/0.03", "10/0.01", "10/0.05"])
def test_search_of_one_block_a_file(name):
    """The search as it is done, without Spark: fit on a half, all files of one block."""
    x = unit(table_of(name, 6000))
    some = x[::2]
    pivots = P.choose_pivots(some, P.pivots_for(len(x)))
    order = P.orders(x, pivots)
    place, posted = P.places_of(order, len(pivots)), order[:, : P.POSTED]
    asks = np.arange(0, len(x), 50)
    sizes = np.bincount(posted.ravel(), minlength=len(pivots))
    files, share = P.read_by(P.fit_reading(some, pivots), P.Sample(some, pivots), x[asks], order[asks], sizes, P.FLOOR * 5 * P.POSTED)
    answers = {}
    for j, q in enumerate(asks.tolist()):
        got: dict[int, float] = {}
        for f in order[q, : files[j]]:
            rows = np.flatnonzero((posted == f).any(axis=1))
            for _, near, cosine in P.search_block(place[rows], x[rows], rows, place[[q]], x[[q]], 6, share[j : j + 1]):
                got.update(zip(rows[near].tolist(), cosine.tolist(), strict=True))
        got.pop(q, None)
        answers[q] = sorted(got, key=lambda r: -got[r])[:5]
        assert len(answers[q]) == 5
    assert recall(x, asks, answers) >= 0.95


def test_stray_rows_find_theirs(spark):
    """Rows far from all others among dense clusters, in Spark; every query gets five."""
    x = table_of("strays", 5000)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    answers: dict[int, list[int]] = {}
    for r in P.search(frame, F.col("vec_id") % 25 == 0).collect():
        answers.setdefault(r.query_id, []).append(r.vec_id)
    strays = np.arange(0, len(x), 25)
    assert all(len(a) == 5 for a in answers.values()) and len(answers) == len(strays)
    assert recall(x, strays, answers) >= 0.9


def test_clustered_rows_find_theirs(spark):
    x = table_of("10/0.01", 5000)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    answers: dict[int, list[int]] = {}
    for r in P.search(frame, F.col("vec_id") % 50 == 0).collect():
        answers.setdefault(r.query_id, []).append(r.vec_id)
    assert recall(x, np.arange(0, len(x), 50), answers) >= 0.95
