"""Product types, collaborations, descriptions and decisions against cases worked out by hand."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from souk.operators import decisions as D
from souk.operators import grouping as G
from souk.operators import partners as P
from souk.operators import products as K

TYPES = {"boots": ("shoes", "boot"), "sneakers": ("shoes", "low"), "jackets": ("tops", "outer"), "coats": ("tops", "outer"), "bags": ("bags", "bag"), "other": ("misc", "misc")}
RULE = "fixed string, any array<string>, fallback string"
CATEGORIES = [("footwear.boots", "boots", [], None), ("footwear.mixed", None, ["sneakers", "boots"], "boots")]
DEPARTMENTS = [("tops", None, ["coats", "jackets"], None), ("unknown", None, [], "other")]
DICTIONARY = [("sneakers", "track", 1, True, None, False, 9), ("boots", "track", 2, True, None, True, 1), ("boots", "hourglass", 3, True, None, False, 1), ("sneakers", "hour glass", 4, False, None, False, 1)]


def test_types_follow_category_title_and_models(spark):
    cases = [  # path, tokens, strong, weak -> type, method, known
        ("Footwear.Boots ", [], [], [], "boots", "category", True),
        ("footwear.boots", [], ["sneakers"], [], "boots", "category", True),  # of the same section
        ("footwear.boots", [], ["bags"], [], "review", "conflict", True),
        ("footwear.boots", [], ["bags"], ["boots"], "boots", "category", True),
        ("footwear.mixed", [], ["boots", "sneakers"], [], "sneakers", "title", True),  # in the order of the rule
        ("footwear.mixed", [], ["bags"], ["boots"], "review", "conflict", True),
        ("footwear.mixed", [], [], ["boots"], "boots", "weak", True),
        ("footwear.mixed", ["track"], [], [], "boots", "model", True),  # its model tells the type
        ("footwear.mixed", ["hour", "glass"], [], [], "sneakers", "model", True),  # of equal weight and cover the first
        ("footwear.mixed", ["nothing"], ["nosuch"], [], "boots", "fallback", True),
        ("tops.none", [], ["coats"], [], "coats", "title", False),
        ("tops.none", [], [], [], "review", "fallback", False),
        ("nowhere", [], [], ["nosuch", "bags"], "bags", "weak", False),
        (None, [], [], [], "other", "fallback", False),
    ]
    rows = spark.createDataFrame([(i, f"t{i}", *c[:4]) for i, c in enumerate(cases)], "i int, title string, category_path string, tokens array<string>, strong array<string>, weak array<string>")
    ruled = K.with_rule(rows, spark.createDataFrame(CATEGORIES, f"category string, {RULE}"), spark.createDataFrame(DEPARTMENTS, f"department string, {RULE}"))
    models = spark.createDataFrame(DICTIONARY, "product_type string, phrase string, key int, confirmed boolean, parent int, infer boolean, weight int")
    got = {r["i"]: (r["product_type"], r["method"], r["known"]) for r in K.product_types(ruled, TYPES, models).collect()}
    assert got == {i: tuple(c[4:]) for i, c in enumerate(cases)}
    assert {(r["category"], r["n"]) for r in K.unknown_categories(ruled).collect()} == {("tops.none", 2), ("nowhere", 1), ("—", 1)}


def test_phrases_of_partners_and_descriptions(spark):
    phrases = spark.createDataFrame([("croc", "_collab-croc", None, None, ["embossed"]), ("croc deluxe", "_collab-deluxe", None, None, ["embossed"]), ("gap", "_collab-gap", ["jackets"], None, None), ("wide leg", "_wide-leg", [], ["bags"], None)], "phrase string, slug string, only_types array<string>, except_types array<string>, stops array<string>")
    rows = [("a", "bags", ["croc", "embossed"]), ("b", "bags", ["croc", "deluxe", "embossed"]), ("c", "boots", ["gap", "croc"]), ("d", "jackets", ["gap", "croc"]), ("e", "jackets", ["gap", "wide", "leg"]), ("f", "bags", ["wide", "leg"]), ("g", "bags", [])]
    got = {r["title"]: r["slug"] for r in P.named(spark.createDataFrame(rows, "title string, product_type string, tokens array<string>"), phrases).collect()}
    assert got == {"b": "_collab-croc", "c": "_collab-croc", "d": "_collab-gap", "e": "_wide-leg"}
    more = phrases.unionByName(spark.createDataFrame([("gap", "_other", None, ["boots"], None)], phrases.schema))
    assert [(r["phrase"], r["product_type"], r["slugs"]) for r in P.clashes(more, ["jackets", "bags", "boots"]).collect()] == [("gap", "jackets", ["_collab-gap", "_other"])]


GROUP = "group_id int, brand_id int, product_type string, slug string, name string, aliases array<string>, parent_id int, status string, source string, retired_at timestamp_ntz"
OLD = datetime(2024, 1, 1)
GROUPS = [
    (1, 1, "boots", "track", "Track", ["tracks"], None, "auto", "mined", None), (2, 1, "boots", "trek", "Trek", None, None, "auto", "mined", None), (3, 1, "boots", "trek-2", "Trek 2", [], 2, "auto", "mined", None),
    (4, 1, "bags", "hour", "Hour", [], None, "confirmed", "seed", None), (5, 1, "boots", "_none", "No model", [], None, "confirmed", "system", None), (6, 1, "boots", "gone", "Gone", [], None, "auto", "mined", OLD),
    (7, 1, "boots", "track-3", "Track 3", [], 1, "confirmed", "user", None), (8, 2, "boots", "far", "Far", [], None, "auto", "mined", None), (9, 1, "boots", "dead", "Dead", [], None, "ignored", "mined", None),
]


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame(GROUPS, GROUP)


def rows(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select(*columns).collect()}


def test_merge_leaves_a_tombstone(spark, groups):
    held = spark.createDataFrame([(10, 2), (11, 4)], "listing_id int, group_id int")
    asked = spark.createDataFrame([(2, 1), (1, 1), (4, 1), (5, 1), (8, 1), (6, 1), (9, 1)], "source_id int, target_id int")
    after, moved = D.merge(groups, held, asked)
    got = rows(after, "group_id", "status", "parent_id", "aliases")
    assert got[1] == ("confirmed", None, ["tracks", "Trek"])
    assert got[2][:2] == ("ignored", None) and got[3][:2] == ("auto", 1) and got[7][:2] == ("confirmed", 1)
    assert [got[i][0] for i in (4, 5, 6, 8, 9)] == ["confirmed", "confirmed", "auto", "auto", "ignored"]
    assert rows(moved, "listing_id", "group_id") == {10: (1,), 11: (4,)}
    into_version, _ = D.merge(groups, held, spark.createDataFrame([(1, 7), (2, 7)], "source_id int, target_id int"))
    got = rows(into_version, "group_id", "parent_id", "status")
    assert got[7] == (None, "confirmed") and got[1] == (None, "ignored") and got[3] == (1, "auto")  # the target stood under a source; under the other it had a line
    chain, _ = D.merge(groups, held, spark.createDataFrame([(2, 1), (1, 7)], "source_id int, target_id int"))
    assert rows(chain, "group_id", "status")[2] == ("auto",)


def test_split_makes_or_revives_a_group(spark, groups):
    asked = [(1, "track-9", "Track 9", True), (7, "track-8", " Track 8 ", True), (5, "found", "Found", True), (1, "trek", "Trek", True), (1, "gone", "Gone again", False), (1, "dead", "Alive", True), (9, "no", "No", True), (1, None, "red", True), (1, "", "red", True)]
    after = D.split(groups, spark.createDataFrame(asked, "source_id int, slug string, name string, as_version boolean"))
    got = rows(after, "slug", "name", "parent_id", "status", "source", "retired_at")
    user = ("confirmed", "user", None)
    assert got["track-9"] == ("Track 9", 1, *user) and got["track-8"] == ("Track 8", 1, *user) and got["found"] == ("Found", None, *user)
    assert got["gone"] == ("Gone again", None, *user) and got["dead"] == ("Alive", 1, *user) and got["trek"] == ("Trek", None, "auto", "mined", None)
    assert len(got) == after.count() == len(GROUPS) + 3


def test_block_move_and_parents(spark, groups):
    after, phrases = D.block(groups, spark.createDataFrame([(1, "Track"), (1, "x")], "brand_id int, phrase string"), spark.createDataFrame([(1,), (5,), (1,)], "group_id int"))
    got = rows(after, "group_id", "status", "parent_id")
    assert got[1] == ("ignored", None) and got[7] == ("confirmed", None) and got[5][0] == "confirmed" and after.count() == len(GROUPS)
    assert {r["phrase"] for r in phrases.collect()} == {"Track", "x", "tracks"} and phrases.count() == 3
    listings = spark.createDataFrame([(i, 1) for i in range(10, 17)], "listing_id int, brand_id int")
    held = spark.createDataFrame([(10, 2), (11, 2), (12, 2)], "listing_id int, group_id int")
    moves = spark.createDataFrame([(10, None, 1), (11, 8, 1), (12, 1, 1), (12, 3, 2), (13, 5, 1), (14, 9, 1), (15, 99, 1), (77, 1, 1)], "listing_id int, group_id int, at int")
    assert rows(D.move(groups, held, listings, moves), "listing_id", "group_id") == {11: (2,), 12: (3,), 13: (5,)}
    asked = spark.createDataFrame([(3, None), (1, 2), (2, 2), (4, 1), (7, 9), (6, 3), (99, 1)], "group_id int, parent_id int")
    got = {k: v[0] for k, v in rows(D.apply_parents(groups, asked), "group_id", "parent_id").items()}
    assert got == {1: 2, 2: None, 3: None, 4: None, 5: None, 6: None, 7: 1, 8: None, 9: None}
    pins = D.pinned(groups, held, spark.createDataFrame([(8, 4)], "group_id int, parent_id int"))
    assert {r[0] for r in pins.collect()} == {1, 2, 4, 8}
    seeds, needed = spark.createDataFrame([("hour",)], "slug string"), spark.createDataFrame([("hour", "boots")], "slug string, product_type string")
    none = pins.filter(F.lit(False))
    assert [r[0] for r in D.idle_seeds(groups, seeds, needed, none).collect()] == [4] and D.idle_seeds(groups, seeds, needed, pins).count() == 0


def test_reposts_come_before_the_rule(spark):
    day = lambda d: datetime(2024, 1, d)
    data = [(1, "s", 1, "removed", day(1), day(5)), (2, "s", 1, "removed", day(6), day(8)), (3, "s", 1, "active", day(9), day(9)), (4, "t", 2, "active", day(10), day(10)), (5, "u", 3, "sold", day(1), day(2)), (6, "u", 3, "active", day(3), day(3)), (7, "v", 4, "active", day(3), day(3)), (8, "w", 5, "active", day(3), day(3)), (9, None, 1, "active", day(11), day(11))]
    frame = spark.createDataFrame(data, "listing_id long, seller string, group_id int, status string, listed_at timestamp_ntz, touched_at timestamp_ntz")
    links = spark.createDataFrame([(4, 2), (6, 5), (7, 8), (8, 7), (9, 4), (3, 3), (3, 99)], "listing_id long, original_id long")
    got = {r["listing_id"]: r["root_id"] for r in G.relists(frame, links).collect()}
    assert got == {2: 1, 4: 1, 9: 1}  # 2 is followed by 4, so 3 has none; a sold original and a circle count for nothing
    assert {r["listing_id"]: r["root_id"] for r in G.relists(frame).collect()} == {2: 1, 3: 1}
    long = spark.range(1, 40).select(F.col("id").alias("listing_id"), (F.col("id") - 1).alias("previous_id"))
    assert {r["root_id"] for r in G.chain_roots(long).collect()} == {0}
