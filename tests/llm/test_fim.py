"""Fill-in-middle against brute force."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from souk.llm import fim, queries

MARKED = ["a <P> b", "<M>", "ends in <", "<S", "S>M>P>", "x\r\n\r\ny  \t z", "é́日本🙂🙂 \x85 \xa0!", "🙂" * 70_000]


def by_hand(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@pytest.fixture
def many(spark, odd):
    rows = [(100 + i, t) for i, t in enumerate(MARKED * 9)] + [(None, "no id"), (777, "twice"), (777, "twice")]
    return odd.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)


def test_outputs_are_those_of_brute_force(many):
    found = fim.transform(many).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted((by_hand(r.doc_id, r.text) for r in many.collect()), key=key)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_texts_come_back(many):
    """Whatever the cut: every form of every seed gives the text back."""
    texts = {r.doc_id: r.text or "" for r in many.collect()}
    for seed in (1, 2, 3):
        out = fim.transform(many, plain_of_100=0, spm_of_100=50, seed=seed)
        for r in out.select("doc_id", "form", fim.restored(F.col("output"), F.col("form")).alias("text")).collect():
            assert r.text == texts[r.doc_id]


def test_other_units(spark):
    """Words and what lies between them as units: cuts fall on their ends."""
    docs = spark.createDataFrame([(i, "one two  three, four five") for i in range(40)], "doc_id long, text string")
    out = fim.transform(docs, plain_of_100=0, spm_of_100=0, pattern=r"\w+").collect()
    ends = {0, *(m.end() for m in re.finditer(r"\w+|\W+", "one two  three, four five"))}
    assert {r.n for r in out} == {9}
    assert all(r.prefix_chars in ends and r.prefix_chars + r.middle_chars in ends for r in out)


def test_empty_table(spark, odd):
    assert fim.transform(odd.limit(0)).collect() == []


def test_query_equals_its_sql(spark, sf_dir):
    from tests.compare import connect, same

    same(queries.op13_fill_in_middle(spark, sf_dir), connect(sf_dir), queries.ORACLE["op13_fill_in_middle"])
