"""Stable groups: claims against the sequential rule, passes that change nothing, names
that change, versions and seeds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from souk.operators import regroup as R


def in_sequence(edges, share=0.5):
    """New groups from the largest down, each taking its best old one that is free."""
    used = {new: u for new, _, _, u in edges}
    out, taken = set(), set()
    for new in sorted(used, key=lambda x: (-used[x], x)):
        for _, old, n, u in sorted((e for e in edges if e[0] == new), key=lambda e: (-e[2], e[1])):
            if n < share * u:
                break
            if old not in taken:
                taken.add(old)
                out.add((new, old))
                break
    return out


@pytest.mark.parametrize("share", [0.5, 0.05])
def test_claims_are_those_of_the_sequential_rule(spark, share):
    """With chains: at a small share a group's second and third choice come into play."""
    rng = random.Random(7)
    edges = []
    for new in range(60):
        olds = rng.sample(range(max(0, new // 2 - 4), new // 2 + 5), 4)
        counts = [rng.choice([1, 2, 2, 3, 5, 8]) for _ in olds]
        edges += [(f"n{new:02d}", f"o{old:02d}", n, sum(counts)) for old, n in zip(olds, counts, strict=True)]
    df = spark.createDataFrame(edges, "new string, old string, n long, used long")
    found = {(r.new, r.old) for r in R.claims(df, share).collect()}
    assert found == in_sequence(edges, share)
    assert len({o for _, o in found}) == len(found)


def test_a_group_left_without_its_first_choice_takes_its_second(spark):
    df = spark.createDataFrame([("a", "x", 6, 10), ("b", "x", 4, 8), ("b", "y", 4, 8), ("c", "y", 3, 6), ("c", "z", 3, 6), ("d", "z", 1, 9)], "new string, old string, n long, used long")
    assert {(r.new, r.old) for r in R.claims(df).collect()} == {("a", "x"), ("b", "y"), ("c", "z")}


def titles_of(spark, names):
    rows = [(100 * i + k, "bag", f"s{k}", name) for i, (name, n) in enumerate(names.items()) for k in range(n)]
    return spark.createDataFrame(rows, "listing_id long, product_type string, seller string, title string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], R.GROUPS), spark.createDataFrame([], "listing_id long, group_id string")


NAMES = {"speed hunters": 8, "track": 9, "track led": 6, "moon bag": 7, "rare one": 2}


@pytest.fixture(scope="module")
def first(spark, empty):
    return R.regroup(titles_of(spark, NAMES), *empty, 1)


def told(groups):
    return {r.group_id: (r.phrase, r.retired) for r in groups.collect()}


def test_a_second_pass_changes_nothing(spark, first):
    groups, placed = first
    again, placed_again = R.regroup(titles_of(spark, NAMES), groups, placed, 2)
    assert sorted(map(str, groups.collect())) == sorted(map(str, again.collect()))
    assert sorted(placed.collect()) == sorted(placed_again.collect())
    assert told(groups)["bag:track@1"] == ("track", False)
    by_phrase = {r.phrase: r for r in groups.collect()}
    assert by_phrase["track led"].parent_id == "bag:track@1"
    ids = {r.listing_id: r.group_id for r in placed.collect()}
    assert ids[400] == "bag:_none" and ids[200] == "bag:track-led@1"


def test_a_respelt_phrase_keeps_its_id_and_its_old_name(spark, first):
    groups, placed = first
    after, moved = R.regroup(titles_of(spark, {"speed hunters": 8, "xtrack": 9, "track led": 6, "moon bag": 7, "rare one": 2}), groups, placed, 2)
    found = {r.group_id: r for r in after.collect()}
    kept = found["bag:track@1"]
    assert (kept.phrase, kept.slug, kept.retired) == ("xtrack", "xtrack", False) and "track" in kept.aliases
    assert {r.group_id for r in moved.filter("listing_id between 100 and 108").collect()} == {"bag:track@1"}


def test_a_phrase_nobody_uses_retires_and_comes_back(spark, first):
    groups, placed = first
    less, placed = R.regroup(titles_of(spark, {**NAMES, "moon bag": 0}), groups, placed, 2)
    gone = [g for g, (p, retired) in told(less).items() if retired]
    assert gone == ["bag:moon-bag@1"]
    back, _ = R.regroup(titles_of(spark, NAMES), less, placed, 3)
    assert told(back)["bag:moon-bag@1"] == ("moon bag", False)


def test_a_pass_over_new_listings_mines_their_phrases_alone(spark, first):
    groups, placed = first
    more = titles_of(spark, {**NAMES, "sun hat": 6, "late coat": 6})
    scope = more.filter("title = 'sun hat'").select("listing_id")
    after, _ = R.regroup(more, groups, placed, 2, scope=scope)
    fresh = set(told(after)) - set(told(groups))
    assert any("sun-hat" in g for g in fresh) and not any("coat" in g for g in fresh)


def test_versions_are_made_once_and_found_again(spark, empty):
    base = [("bag:speed@1", "bag", "speed", "speed", [], "confirmed", "user", None, None, False), ("bag:x@1", "bag", "speed-#9", "speed #9", [], "ignored", "mined", None, None, False), ("bag:y@1", "bag", "speed-2", "speed 2", [], "auto", "mined", "bag:speed@1", None, True)]
    groups = spark.createDataFrame(base, R.GROUPS)
    wanted = spark.createDataFrame([(1, "bag", "mini speed", "bag:speed@1"), (2, "bag", "mini speed", "bag:speed@1"), (3, "bag", "speed #9", "bag:speed@1"), (4, "bag", "speed 2", "bag:speed@1")], "listing_id long, product_type string, version string, parent_id string")
    after, placed = R.on_demand(wanted, groups, 1)
    assert {r.listing_id: r.group_id for r in placed.collect()} == {1: "bag:mini-speed@1", 2: "bag:mini-speed@1", 3: None, 4: "bag:y@1"}
    assert told(after)["bag:y@1"] == ("speed 2", False)
    again, same = R.on_demand(wanted, after, 2)
    assert sorted(map(str, again.collect())) == sorted(map(str, after.collect())) and sorted(same.collect()) == sorted(placed.collect())
    names = spark.createDataFrame([("mini speed #2b", "speed", "Speed"), ("speed", "speed", "Speed"), ("other words", "speed", "Speed")], "v string, p string, n string")
    assert [r[0] for r in names.select(R.version_name(F.col("v"), F.col("p"), F.col("n"))).collect()] == ["Mini Speed #2B", "Speed", "Other Words"]


def test_seeds_take_over_mined_groups(spark):
    base = [("g1", "bag", "moon-bag", "moon bag", ["lune"], "auto", "mined", "g9", 9, True), ("g2", "bag", "track", "track", ["t"], "confirmed", "seed", None, None, True), ("g3", "bag", "no", "no", [], "ignored", "user", None, None, False)]
    groups = spark.createDataFrame(base, R.GROUPS)
    seeds = spark.createDataFrame([("bag", "Moon Bag", ["moonie"], "Track"), ("bag", "Track", ["runner"], None), ("bag", "No", [], None), ("bag", "Star", [], "Track")], "product_type string, name string, aliases array<string>, parent string")
    found = {r.group_id: r for r in R.sow(groups, seeds, 4).collect()}
    assert set(found) == {"g1", "g2", "g3", "bag:star@4"}
    assert (found["g1"].source, found["g1"].status, found["g1"].parent_id, found["g1"].aliases, found["g1"].retired) == ("seed", "confirmed", "g2", ["moonie", "lune"], False)
    assert found["g2"].aliases == ["runner", "t"] and not found["g2"].retired
    assert found["g3"].status == "ignored" and found["bag:star@4"].parent_id == "g2"
    again = {r.group_id: r for r in R.sow(R.sow(groups, seeds, 4), seeds, 5).collect()}
    assert {k: str(v) for k, v in again.items() if k != "g2"} == {k: str(v) for k, v in found.items() if k != "g2"}
