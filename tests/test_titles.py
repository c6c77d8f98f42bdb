"""Titles against cases worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from souk.operators import titles as T

LEXICON = [("boot", "strong", "boots"), ("ankle boot", "strong", "ankle_boots"), ("leather", "weak", "jackets"), ("black", "color", ""), ("rare", "noise", ""), ("new with tag", "noise", "")]
BRAND = [("rick owen", "brand", ""), ("rick", "brand", "")]
DICTIONARY = [("boots", "le cagole", 1, True, None), ("boots", "hourglass", 2, True, None), ("boots", "track", 3, True, None), ("boots", "cagole", 4, False, None), ("boots", "geobasket", 5, True, None), ("boots", "mega track", 6, True, 3), ("bags", "glass", 7, True, None)]


@pytest.fixture(scope="module")
def tables(spark):
    phrases = lambda rows: spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "phrase string, kind string, of string, rank int")
    return phrases(BRAND), phrases(LEXICON), spark.createDataFrame(DICTIONARY, "product_type string, phrase string, key int, confirmed boolean, parent int")


def test_titles_lose_what_names_no_model(spark, tables):
    brand, lexicon, _ = tables
    cases = {
        "Rick Owens Black Geobasket ankle boots size 42 2014": (["geobasket"], ["ankle_boots"], []),
        "NEW WITH TAGS Rick boots leather track2 EU42 o1bcso1str0226": (["track", "2"], ["boots"], ["jackets"]),
        "size M rare size rare 17.5 #5 ss18": (["#5"], [], []),
        "": ([], [], []),
    }
    got = {r["title"]: (r["tokens"], r["strong"], r["weak"]) for r in T.normalize(spark.createDataFrame([(t,) for t in cases] * 2, "title string"), brand, lexicon).collect()}
    assert got == cases


def test_models_are_found_as_written_glued_or_misspelt(spark, tables):
    _, _, dictionary = tables
    rows = [("a", "boots", ["le", "cagole", "x"]), ("b", "boots", ["hour", "glass", "y"]), ("c", "boots", ["geobaskt"]), ("d", "boots", ["super", "track", "2"]), ("e", "boots", ["mega", "track"]), ("f", "bags", ["hour", "glass"]), ("g", "boots", ["nothing"]), ("h", "boots", []), ("i", "boots", ["cagole", "track"]), ("j", "boots", ["geobasked"]), ("k", "boots", ["track", "#9"])]
    got = {r["title"]: (r["key"], r["matched"], r["fuzzy"], r["version"]) for r in T.match(spark.createDataFrame(rows, "title string, product_type string, tokens array<string>"), dictionary, protected=("super",), versions=("2", "3")).collect()}
    assert got == {"a": (1, "le cagole", False, None), "b": (2, "hourglass", False, None), "c": (5, "geobasket", True, None), "d": (3, "track", False, "super track 2"), "e": (6, "mega track", False, None), "f": (7, "glass", False, None), "i": (3, "track", False, None), "k": (3, "track", False, "track #9")}


def test_a_decision_comes_before_the_dictionary(spark, tables):
    _, _, dictionary = tables
    rows = spark.createDataFrame([("t", "boots", ["track"]), ("u", "boots", ["none"])], "title string, product_type string, tokens array<string>")
    listings = spark.createDataFrame([(1, "t", "boots"), (2, "t", "boots"), (3, "u", "boots"), (4, "t", "review")], "listing_id int, title string, product_type string")
    placed = T.place(listings, T.match(rows, dictionary), spark.createDataFrame([(2, 9)], "listing_id int, key int"))
    assert {r["listing_id"]: (r["key"], r["method"]) for r in placed.collect()} == {1: (3, "phrase"), 2: (9, "override"), 3: (None, "none"), 4: (None, "review")}
    assert T.match(rows.filter(F.lit(False)), dictionary).count() == 0
