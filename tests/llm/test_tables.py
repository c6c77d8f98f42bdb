"""The tables of operator 4 in Spark, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from souk.llm import itq_dedup
from souk.llm.vectors import unit
from tests.llm.test_groups import classes_of


def shared_direction(n: int, d: int, shared: float, seed: int = 7) -> np.ndarray:
    """Unit vectors whose mean has about the norm ``shared``; half have a partner just above 0.9."""
    choose = np.random.default_rng(seed)
    apart = choose.normal(size=(n, d))
    apart[:, 0] = 0
    apart /= np.linalg.norm(apart, axis=1, keepdims=True)
    like = (0.905 - shared**2) / (1 - shared**2)
    apart[n // 2 :] = like * apart[: n // 2] + (1 - like**2) ** 0.5 * apart[n // 2 :]
    x = (1 - shared**2) ** 0.5 * apart / np.linalg.norm(apart, axis=1, keepdims=True)
    x[:, 0] = shared
    return x


def links_of(spark, x: np.ndarray) -> dict[int, int]:
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    return {r["vec_id"]: r["n_links"] for r in itq_dedup.link(frame).collect()}


def all_pairs(x: np.ndarray) -> np.ndarray:
    close = unit(x) @ unit(x).T >= 0.9
    np.fill_diagonal(close, False)
    return close.sum(axis=1)


@pytest.mark.parametrize(("shared", "strays"), [(0.0, 0), (0.5, 0), (0.7, 3)])
def test_tabled_links(spark, shared, strays):
    """With rows at the mean, and many about them, as with none."""
    x = shared_direction(2400, 64, shared)
    mean = unit(x.mean(axis=0, keepdims=True))
    if strays:
        x = np.concatenate([x, np.repeat(mean, strays, 0) + 1e-3 * np.random.default_rng(1).normal(size=(strays, 64))])
    model = itq_dedup.fit(unit(x), len(x), 0.9)
    assert model.bits >= 6 and model.tables > 1
    assert int(model.apart(unit(x)).sum()) == strays
    want = all_pairs(x)
    got = links_of(spark, x)
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.995 * want.sum() and want.sum() >= 1200
    assert all(got[i] == want[i] for i in range(2400, 2400 + strays))  # those apart miss none


def test_links_of_rows_apart_in_blocks(spark, monkeypatch):
    """Blocks of rows apart with each other and with the rest."""
    monkeypatch.setattr(itq_dedup, "BLOCK", 5)
    x = shared_direction(300, 16, 0.7)
    mean = unit(x.mean(axis=0, keepdims=True))
    near = np.repeat(mean, 3, 0) + 0.02 * np.random.default_rng(2).normal(size=(3, 16))
    x = np.concatenate([x, near])
    monkeypatch.setattr(itq_dedup, "inner_norm", lambda norms: 0.35)
    model = itq_dedup.fit(unit(x), len(x), 0.9)
    apart = model.apart(unit(x))
    assert model.bits and apart.sum() >= 3
    got, want = links_of(spark, x), all_pairs(x)
    assert all(got[i] == want[i] for i in np.flatnonzero(apart))
    assert sum(got.values()) >= 0.99 * want.sum()


def test_a_row_at_the_mean_adds_no_tables():
    """Tables for 10 ** 8 rows with and without it."""
    x = shared_direction(8000, 64, 0.7)
    stray = np.concatenate([x, unit(x.mean(axis=0, keepdims=True))])
    with_it, without = (itq_dedup.fit(y, 10**8, 0.9) for y in (stray, x))
    assert (with_it.bits, with_it.tables) == (without.bits, without.tables) and without.bits


@pytest.mark.parametrize("n", [200, 500, 2000])
def test_small_tables_are_coded(n):
    x = unit(np.random.default_rng(3).normal(size=(n, 64)))
    assert itq_dedup.fit(x, n, 0.9).bits >= 6


def whole(spark, x: np.ndarray, close: np.ndarray) -> None:
    """Each row's links and component are those of ``close``, all of them."""
    np.fill_diagonal(close, False)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in itq_dedup.link(frame).collect()}
    reached = classes_of(range(len(x)), np.argwhere(close).tolist())
    assert got == {i: (int(close[i].sum()), reached[i]) for i in range(len(x))} and close.any()


@pytest.mark.parametrize("d", [2, 8])
def test_no_link_is_left_out(spark, d):
    """In two dimensions rotations coincide; in eight, links are chains."""
    x = np.random.default_rng(11).normal(size=(900, d))
    whole(spark, x, unit(x) @ unit(x).T >= 0.9)


def test_no_link_of_wide_groups_is_left_out(spark):
    """Groups whose members are at the threshold from each other on average."""
    choose = np.random.default_rng(11)
    x = unit(choose.normal(size=(15, 64)))[choose.integers(0, 15, 1200)] + 0.31 * unit(choose.normal(size=(1200, 64)))
    whole(spark, x, unit(x) @ unit(x).T >= 0.9)


def test_links_exactly_at_the_threshold(spark):
    """Nine of ten ones in common, whatever the lengths: the counts of ones decide, in whole numbers."""
    choose, ones = np.random.default_rng(3), np.zeros((200, 24), np.int64)
    for i in range(0, 200, 2):
        at = choose.permutation(24)
        ones[i, at[:10]] = ones[i + 1, at[1:11]] = 1
    x = ones * choose.integers(1, 9, size=(200, 1))
    assert ((ones @ ones.T) == 9).sum() >= 200
    whole(spark, x.astype(float), ones @ ones.T >= 9)


@pytest.mark.parametrize("groups", [0, 4])
def test_the_exact_check_in_blocks(spark, monkeypatch, groups):
    """With one table that finds little, in many blocks; with groups far apart, some pairs of blocks are left out."""
    monkeypatch.setattr(itq_dedup, "BLOCK", 16)
    monkeypatch.setattr(itq_dedup, "REST", 40)
    monkeypatch.setattr(itq_dedup, "plan", lambda *_: (12, 1))
    choose = np.random.default_rng(5)
    x = choose.normal(size=(400, 6))
    if groups:
        x = np.eye(6)[choose.integers(0, groups, 400)] * 5 + x
    whole(spark, x, unit(x) @ unit(x).T >= 0.9)


def test_what_links_reach_from_a_row():
    """A chain whose ends each have their least neighbour next to them."""
    x = np.array([[np.cos(a), np.sin(a)] for a in np.radians([0, 75, 50, 25])])
    x = x[[0, 2, 3, 1]]  # 0, 50, 25 and 75 degrees
    codes = itq_dedup.Codes(np.zeros(2), np.zeros((2, 0)), 0, 1, 0.0)
    rows, count, least = itq_dedup.compare(x, codes, np.zeros((4, 1), np.uint8), np.ones(4, np.int64), np.array([1, 3, 4, 2]), np.zeros(4, np.int64), 0, 0.9)
    assert rows.tolist() == [0, 1, 2, 3] and count.tolist() == [1, 2, 2, 1] and least.tolist() == [1, 1, 1, 1]
