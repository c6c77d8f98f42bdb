"""Brand names against brute force."""

from __future__ import annotations

import random
from datetime import datetime

from pyspark.sql import functions as F

from souk.operators import brands as B
from souk.operators import fuzzy
from souk.operators.grouping import fuzzy_match


def rng_names(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_similar_of_any_length_is_brute_force(spark):
    rng = random.Random(3)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(60)})
    texts = set(terms)
    for t in terms:
        for _ in range(4):
            chars = list(t)
            for _ in range(rng.randint(0, 1 + len(t) // 6)):
                at = rng.randint(0, len(chars))
                chars[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
            texts.add("".join(chars))
    for least in (92.0, 85.0):
        found = fuzzy.similar(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(t,) for t in terms], "term string"), [], least, off=None)
        want = {(a, b) for a in texts for b in terms if a and fuzzy.ratio(a, b) >= least}
        assert {(r["text"], r["term"]) for r in found.collect()} == want


def test_wrong_brand_is_brute_force(spark):
    names = [(i % 5, n) for i, n in enumerate(rng_names(1, 25))] + [(1, None), (None, "ab"), (2, "É"), (3, "STRASSE")]
    titles = [*rng_names(2, 120), "café É", "straße", None, "", "x" * 50_000 + "aab"]
    rows = [(i, i % 6 if i % 7 else None, t) for i, t in enumerate(titles)]
    got = B.wrong_brand(spark.createDataFrame(rows, "id int, brand_id int, title string"), spark.createDataFrame(names, "brand_id int, name string"))
    said = [(b, n.casefold()) for b, n in names if n and b is not None]

    def wrong(brand, title) -> bool:
        held = {b for b, n in said if title is not None and n in title.casefold()}
        return bool(held) and brand not in held

    assert {r["id"]: r["wrong_brand"] for r in got.collect()} == {i: wrong(b, t) for i, b, t in rows}
    assert got.filter("wrong_brand").count() > 0


def test_wrong_brand_without_names_or_rows(spark):
    rows = spark.createDataFrame([(1, 2, "a b")], "id int, brand_id int, title string")
    names = spark.createDataFrame([], "brand_id int, name string")
    assert [r["wrong_brand"] for r in B.wrong_brand(rows, names).collect()] == [False]
    assert B.wrong_brand(rows.limit(0), names).count() == 0


def test_mappings_are_never_unverified_and_rejected_ones_stay(spark):
    now, old = datetime(2024, 1, 2), datetime(2024, 1, 1)
    held = [(1, "a", 5, 0.9, True, None, "manual", old), (1, "b", 5, 0.9, False, old, "manual", old), (1, "c", 5, 0.8, False, None, "auto", old), (2, "d", 5, 0.8, False, None, "auto", old)]
    new = [(1, "a", 9, 0.8), (1, "b", 9, 0.99), (1, "c", 9, 0.95), (1, "e", 3, 0.75), (1, "f", 3, 0.7499), (2, "d", 9, 0.5), (3, "g", 1, 0.96)]
    held = spark.createDataFrame(held, "brand_id int, name string, listings int, score double, verified boolean, rejected_at timestamp_ntz, method string, updated_at timestamp_ntz")
    scored = spark.createDataFrame(new, "brand_id int, name string, listings int, score double")
    after = B.upsert_mappings(held, scored, F.lit(now).cast("timestamp_ntz"))
    rows = {(r["brand_id"], r["name"]): (r["listings"], r["score"], r["verified"], r["method"], r["updated_at"]) for r in after.collect()}
    assert rows == {
        (1, "a"): (9, 0.8, True, "manual", now), (1, "b"): (5, 0.9, False, "manual", old), (1, "c"): (9, 0.95, True, "auto", now),
        (1, "e"): (3, 0.75, False, "auto", now), (2, "d"): (5, 0.8, False, "auto", old), (3, "g"): (1, 0.96, True, "auto", now),
    }
    brands = spark.createDataFrame([(1,), (2,), (3,), (4,)], "brand_id int")
    assert tuple(B.mapping_summary(brands, after, scored).first()) == (4, 2, 2, 2)


def test_searches_are_merged_by_the_larger_count(spark):
    found = spark.createDataFrame([(1, "a", 3), (1, "a", 7), (2, "a", 1)], "brand_id int, name string, listings int")
    assert sorted(map(tuple, B.merged(found).collect())) == [(1, "a", 7), (2, "a", 1)]


def test_names_resolve_exactly_first_then_by_likeness(spark):
    names = spark.createDataFrame([(5, "Comme des Garçons"), (3, "comme-des garcons"), (4, "Examplabrand"), (2, "Exemplabrand"), (7, "??"), (8, None)], "brand_id int, name string")
    raw = spark.createDataFrame([("COMME DES GARCONS",), ("Exumplabrand",), ("Examplabrandd",), ("nothing",), ("!!",), (None,), ("nothing",)], "raw string")
    got = {r["raw"]: (r["brand_id"], r["suggested"]) for r in B.resolve(raw, names, suggest=85).collect()}
    assert got == {"COMME DES GARCONS": (3, 3), "Exumplabrand": (None, 2), "Examplabrandd": (4, 4), "nothing": (None, None), "!!": (None, None)}
    assert fuzzy_match(raw, names.select(F.col("name").alias("known"))).filter("raw = 'nothing'").count() == 0


def test_counters_add_up(spark):
    t = [datetime(2024, 1, d) for d in range(1, 6)]
    held = spark.createDataFrame([("A!", "a", 2, 1, 0.5, t[0], t[1]), ("B", "b", 1, None, None, t[0], t[0])], "raw string, key string, occurrences long, suggested int, score double, first_seen timestamp_ntz, last_seen timestamp_ntz")
    seen = spark.createDataFrame([("A!", 3, 0.9, t[2]), ("A!", None, None, t[3]), ("C", 4, 0.8, t[2]), ("C", 5, 0.8, t[2]), (None, 1, 1.0, t[2])], "raw string, suggested int, score double, at timestamp_ntz")
    rows = {r["raw"]: tuple(r)[1:] for r in B.count_unmatched(held, seen).collect()}
    assert rows == {"A!": ("a", 4, None, None, t[0], t[3]), "B": ("b", 1, None, None, t[0], t[0]), "C": ("c", 2, 5, 0.8, t[2], t[2])}
