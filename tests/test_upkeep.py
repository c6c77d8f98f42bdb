"""Refreshing, the list of deals, packed seasons, by hand."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from souk.operators import deals as D
from souk.operators import refresh as R
from souk.operators import seasons as N

NOW = datetime(2024, 3, 1)
HELD = "listing_id long, status string, last_seen timestamp_ntz, missing_at timestamp_ntz, price int, outcome_note string"


def test_missing_listings_are_marked_then_removed_and_never_sold(spark):
    old = NOW - timedelta(days=9)
    two_days, less = NOW - timedelta(hours=48), NOW - timedelta(hours=47)
    held = [
        (1, "active", old, None, 5, "a"), (2, "active", old, None, 5, "b"), (3, "active", old, None, 5, "c"), (4, "removed_pending", old, two_days, 5, "d"),
        (5, "removed_pending", old, less, 5, "e"), (6, "removed_pending", old, two_days, 5, "f"), (7, "sold", old, None, 5, "g"), (8, "active", NOW, None, 5, "h"), (9, "removed_pending", old, None, 5, "i"), (10, None, old, None, 5, None),
    ]
    held = spark.createDataFrame(held, HELD)
    active = spark.createDataFrame([(1, old, 1), (1, NOW, 7), (6, NOW, None), (7, NOW, 9), (99, NOW, 9)], "listing_id long, at timestamp_ntz, price int")
    sold = spark.createDataFrame([(1, NOW, 8), (2, NOW, 6)], "listing_id long, at timestamp_ntz, price int")
    now = F.lit(NOW).cast("timestamp_ntz")
    after = R.refresh(held, active, sold, now, ["price"], now)
    assert after.columns == [*held.columns, "outcome"]
    got = {r["listing_id"]: (r["status"], r["last_seen"], r["missing_at"], r["price"], r["outcome"]) for r in after.collect()}
    assert got == {
        1: ("active", NOW, None, 7, "active"), 2: ("sold", NOW, None, 6, "sold"), 3: ("removed_pending", old, NOW, 5, "pending"), 4: ("removed", old, two_days, 5, "removed"),
        5: ("removed_pending", old, less, 5, "waiting"), 6: ("active", NOW, None, 5, "active"), 7: ("sold", old, None, 5, None), 8: ("active", NOW, None, 5, None), 9: ("removed_pending", old, None, 5, "waiting"), 10: (None, old, None, 5, None),
    }
    assert tuple(R.refresh_counts(after).first()) == (7, 2, 1, 1, 1, 2)
    again = R.refresh(after.drop("outcome"), active, sold, now, ["price"], now)
    assert {r["listing_id"]: r["status"] for r in again.collect()}[4] == "removed"
    assert R.refresh(held.limit(0), active, sold, now, ["price"]).count() == 0


def test_deals_with_unknown_groups_are_left_out_and_pages_break_ties(spark):
    t = [NOW, NOW + timedelta(days=1)]
    deals = [(i, i, 10 + i % 2, 1.005 + i, 2.0, -0.25, float(i % 2), t[i % 2], v) for i, v in enumerate(["good", "bad", None, "other", None])] + [(9, 0, 77, 1.0, 1.0, 1.0, 1.0, t[0], None), (8, 50, 10, 1.0, 1.0, 1.0, 1.0, t[0], None)]
    deals = spark.createDataFrame(deals, "deal_id int, listing_id int, group_id int, price double, p50 double, net double, roi double, found_at timestamp_ntz, verdict string")
    deals = deals.withColumns({c: F.col(c).cast("decimal(14,3)") for c in ("price", "p50", "net")})
    listings = spark.createDataFrame([(i, f"t{i}", None, "raw", "is_new", "active" if i != 4 else "sold") for i in range(5)], "listing_id int, title string, size string, size_raw string, condition string, status string")
    groups = spark.createDataFrame([(10, "even", 1), (11, "odd", 2)], "group_id int, name string, brand_id int")
    brands = spark.createDataFrame([(1, "One")], "brand_id int, name string")
    rows = D.deal_rows(deals, listings, groups, brands)
    got = {r["deal_id"]: r for r in rows.collect()}
    assert set(got) == {0, 1, 2, 3}
    assert (got[0]["brand"], got[1]["brand"], got[0]["price"], got[0]["net"], got[0]["size"]) == ("One", None, 101, -25, "raw")
    assert (got[0]["verdict"], got[3]["verdict"]) == ("good", None)
    shown = lambda **how: {r["deal_id"] for r in D.deal_rows(deals, listings, groups, brands, **how).collect()}
    assert shown(inactive=True) == {0, 1, 2, 3, 4} and shown(verdict="unrated") == {2} and shown(verdict="bad") == {1}
    assert [r["deal_id"] for r in D.deals_page(rows, limit=3).collect()] == [3, 1, 2]
    assert [r["deal_id"] for r in D.deals_page(rows, "roi", limit=2, offset=1).collect()] == [1, 2]
    with pytest.raises(ValueError, match="no verdict"):
        D.deal_rows(deals, listings, groups, brands, verdict="maybe")
    scans = spark.createDataFrame([(1, NOW, 4, None), (5, NOW, 1, "x")], "brand_id int, scanned_to timestamp_ntz, hits int, error string")
    assert [tuple(r)[:2] for r in D.scanned(scans, brands).collect()] == [(1, "One")]


def test_brands_in_scope(spark):
    metrics = spark.createDataFrame([("model", 1, 10, 50.0), ("model", 2, 11, 49.9), ("line", 3, 12, 90.0), ("model", 4, None, 90.0), ("model", 5, 13, None)], "scope string, group_id int, brand_id int, liquidity_score double")
    watched = spark.createDataFrame([(2,), (2,), (5,), (3,)], "group_id int")
    assert [r[0] for r in D.in_scope(metrics).collect()] == [10]
    assert sorted(r[0] for r in D.in_scope(metrics, watched).collect()) == [11, 13]


def test_twelve_indices_and_the_profile_of_a_department_first(spark):
    point = "array<struct<month:int,si_abs:double>>"
    rows = spark.createDataFrame([("type", "Shoes", [(3, 1.5), (1, None), (13, 9.0), (3, None), (12, 0.5)]), ("department", "Shoes:men", [(1, 2.0)]), ("type", "Bags", []), ("brand", "Hats", [(1, 1.0)])], f"kind string, key string, months {point}")
    wanted = spark.createDataFrame([("Shoes", "men"), ("Shoes", "women"), ("Shoes", None), ("Bags", "men"), ("Hats", None), (None, "men"), ("Shoes", "men")], "product_type string, department string")
    got = {(r[0], r[1]): (r[2], list(r[3])) for r in N.overlay(wanted, rows).collect()}
    whole = [None, None, 1.5, *[None] * 8, 0.5]
    assert got == {("Shoes", "men"): ("Shoes:men", [2.0, *[None] * 11]), ("Shoes", "women"): ("Shoes", whole), ("Shoes", None): ("Shoes", whole), ("Bags", "men"): ("Bags", [None] * 12)}
