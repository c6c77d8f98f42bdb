"""Folding against the rule, over all letters and marks of Unicode."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F

from souk.functions import text as T


def by_rule(text: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return bare.casefold().replace("'", "").replace("’", "")


def test_fold_is_the_rule_for_every_letter(spark):
    letters = [chr(c) for c in range(0x20, 0x110000) if unicodedata.category(chr(c))[0] in "LMN"]
    texts = [("".join(letters[i : i + 50]),) for i in range(0, len(letters), 50)] + [("",), ("Ö'Neil’s ﬁne ǅ ½",)]
    rows = spark.createDataFrame(texts, "x string").select("x", T.fold(F.col("x")).alias("y")).collect()
    assert [r["x"] for r in rows if r["y"] != by_rule(r["x"])] == []


def test_brand_key(spark):
    texts = ["Comme des Garçons", "ﬁlson & Co.", "Ⅳ 47", "", "  ", "東京", "A.P.C."]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "x string").select("x", T.brand_key(F.col("x")).alias("y")).collect()
    for r in rows:
        if r["x"] is None:
            assert r["y"] is None
        else:
            ascii_text = unicodedata.normalize("NFKD", r["x"]).encode("ascii", "ignore").decode()
            assert r["y"] == re.sub("[^a-z0-9]+", "", ascii_text.casefold())
