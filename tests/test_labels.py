"""Similarity joins, labels, classes and draws against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from souk.operators import components, fuzzy, labels, sampling
from souk.operators.grouping import indel_ratio
from souk.plans import label_queries


def words(rng, n):
    base = ["maison margiela", "rick owens", "chrome hearts", "stone island", "acronym", "undercover", "visvim", "cp", "abc", "a"]
    out = set(base)
    while len(out) < n:
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            i = rng.randrange(len(w) + 1)
            if rng.random() < 0.5 and w:
                w.pop(min(i, len(w) - 1))
            else:
                w.insert(i, rng.choice("abcehimnorst "))
        if "".join(w).strip():
            out.add("".join(w))
    return sorted(out)


def test_common_subsequences():
    rng = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert fuzzy.ratio(a, b) == pytest.approx(indel_ratio(a, b))


@pytest.mark.parametrize("least", [85.0, 92.0])
def test_similar_pairs_are_those_of_all_pairs(spark, least):
    rng = random.Random(5)
    texts, terms = words(rng, 220), words(rng, 60)
    expected = {(a, b) for a in texts for b in terms if abs(len(a) - len(b)) <= 2 and indel_ratio(a, b) >= least}
    left = spark.createDataFrame([(k, t) for k in (1, 2) for t in texts], "g int, text string")
    right = spark.createDataFrame([(1, t) for t in terms], "g int, term string")
    found = fuzzy.similar(left, right, ["g"], least).collect()
    assert {(r.text, r.term) for r in found} == expected and {r.g for r in found} == {1}
    assert len(expected) > 50


def test_low_ratios_are_refused(spark):
    with pytest.raises(ValueError, match="short terms"):
        fuzzy.similar(spark.createDataFrame([("a",)], "text string"), spark.createDataFrame([("a",)], "term string"), [], 60.0)


def test_misspelt_terms_go(spark):
    """The first window of each term that is like it; titles without one stay."""
    titles = spark.createDataFrame(
        [(1, "t1", ["cheome", "hearts", "ring"]), (1, "t2", ["rick", "ownes", "x", "rick", "owens"]), (1, "t3", ["plain", "ring"]), (2, "t1", ["cheome", "hearts", "ring"]), (1, "t4", [])],
        "b int, title string, tokens array<string>",
    )
    terms = spark.createDataFrame([(1, "chrome hearts"), (1, "rick owens")], "b int, term string")
    found = {(r.b, r.title): r.tokens for r in fuzzy.without_misspelt(titles, terms, ["b"]).collect()}
    assert found == {(1, "t1"): ["ring"], (1, "t2"): ["x", "rick", "owens"], (1, "t3"): ["plain", "ring"], (2, "t1"): ["cheome", "hearts", "ring"], (1, "t4"): []}


def test_brand_typos_leave_the_name(spark, sf_dir):
    """Every title gets its own words back: slips of one letter are within the ratio of terms of four letters and more."""
    rows = label_queries.QUERIES["brand_typos"](spark, sf_dir).collect()
    names = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    assert len(rows) == len(names)
    wrong = [r for r in rows if r.rest != names[r.p_partkey]]
    terms = [r.n_name.lower() for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()]
    for r in wrong:  # a blank lost or won makes another number of words; else the ratio is too low
        term = terms[r.p_partkey % 25]
        n = len(term.split(" "))
        tokens = r.title.split()
        assert not any(abs(len(w) - len(term)) <= 2 and indel_ratio(w, term) >= 85 for w in (" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1))) or len(r.rest.split()) < len(tokens)
    assert len(wrong) < 0.2 * len(rows)


def test_classes_over_chains(spark):
    links = [(f"k{i:03d}", f"k{i + 1:03d}") for i in range(60)] + [("z", "y"), ("y", "x"), ("q", "q"), ("q", None)]
    found = {r["id"]: r["class"] for r in components.classes(spark.createDataFrame(links, "a string, b string")).collect()}
    assert set(found[f"k{i:03d}"] for i in range(61)) == {"k000"} and found["z"] == "x" and found["q"] == "q"
    assert components.classes(spark.createDataFrame([], "a string, b string")).count() == 0


def test_grammar_of_labels(spark):
    texts = [("none",), (" NONE ",), ("Descriptor",), ("descriptor: Wide Leg ",), ("Track > Track LED",), ("Track",), ("Track > ",), ("> x",), ("",), (None,), ("a > b > c",)]
    found = [tuple(r[0]) for r in spark.createDataFrame(texts, "t string").coalesce(1).select(labels.gold(F.col("t"))).collect()]
    assert found[:6] == [("none", None, None, None, None), ("none", None, None, None, None), ("descriptor", None, None, None, None), ("descriptor", "wide leg", None, None, None), ("model", None, "Track", "Track LED", None), ("model", None, "Track", "Track", None)]
    assert all(r[0] is None and r[4].startswith("Bad gold_model") for r in found[6:10]) and found[10][2:4] == ("a", "b > c")
    said = [tuple(r[0]) for r in spark.createDataFrame([("Model",), ("duplicate:Track",), ("duplicate: ",), ("odd",)], "t string").coalesce(1).select(labels.verdict(F.col("t"))).collect()]
    assert said[:2] == [("model", "", None), ("duplicate", "Track", None)] and all(r[2] for r in said[2:])


def test_spellings_of_spellings_are_one_name(spark):
    canon = spark.createDataFrame([("Speed Hunters", ["Speedhunter"]), ("speed-hunters!", ["SH 1"]), ("sh1", ["Es Aitch"]), ("Track", None)], "canon string, aliases array<string>")
    keys = {r.key: r["keys"] for r in labels.spellings(canon).collect()}
    assert keys["esaitch"] == keys["speedhunters"] == ["esaitch", "sh1", "speedhunter", "speedhunters"] and keys["track"] == ["track"]
    gold = spark.createDataFrame([(1, "shoe", "es aitch"), (2, "shoe", "Track > LED"), (3, "shoe", "Moon"), (4, "bag", "none")], "listing_id long, gold_type string, gold_model string")
    placed = spark.createDataFrame([(1, "shoe", "model", ["Speed Hunters"], ["Speed Hunters"]), (2, "shoe", "model", ["tracks"], ["track"]), (4, "shoe", "none", None, None)], "listing_id long, product_type string, kind string, line_names array<string>, leaf_names array<string>")
    found = {r.listing_id: (r.lenient, r.strict, r.type_right) for r in labels.judged(gold, placed, labels.spellings(canon)).collect()}
    assert found == {1: (True, True, True), 2: (True, False, True), 3: (False, False, False), 4: (False, False, False)}


def test_running_sums_and_draws(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 2, 5, 40])) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, w long")
    total, expected = 0, {}
    for k, w in rows:
        total += w
        expected[k] = total
    for n in (1, 7):
        found = {r.k: int(r.upto) for r in sampling.running_sums(df.repartition(n), "w", ["k"]).collect()}
        assert found == expected
    first = sorted((r.draw, r.k) for r in sampling.draws(df.repartition(1), "w", ["k"], 4000, 11).collect())
    again = sorted((r.draw, r.k) for r in sampling.draws(df.repartition(9), "w", ["k"], 4000, 11).collect())
    assert first == again and [d for d, _ in first] == list(range(1, 4001))
    seen, weight = Counter(dict(rows)[k] for _, k in first), Counter()
    for _, w in rows:
        weight[w] += w
    assert seen[0] == 0
    chi = sum((seen[w] - 4000 * weight[w] / total) ** 2 / (4000 * weight[w] / total) for w in (1, 2, 5, 40))
    assert chi < 16.3  # three degrees of freedom, one in a thousand
    other = sampling.draws(df, "w", ["k"], 4000, 12).count()
    assert other == 4000 and sampling.draws(df.filter("w < 0"), "w", ["k"], 5, 1).count() == 0
