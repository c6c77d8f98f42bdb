"""Near copies, vectors and the pipeline against brute force, and edge cases."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from souk.llm import bag_minhash, itq_dedup, permutation_index, queries
from souk.llm.common import table
from souk.llm.components import connected

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def classes_of(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def bag(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []
    return collections.Counter(runs)


def near(a, b):
    both = sum((a & b).values())
    return bool(a) and bool(b) and both >= 0.8 * (sum(a.values()) + sum(b.values()) - both)


def brute(rows):
    bags = {i: bag(t) for i, t in rows}
    ids = sorted(bags)
    return classes_of(ids, [(a, b) for n, a in enumerate(ids) for b in ids[:n] if near(bags[a], bags[b])])


def made(seed, n=160):
    """Texts with copies, near copies, repeated shingles and shared passages."""
    choose = random.Random(seed)
    word = lambda: "".join(choose.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(n):
        if texts and choose.random() < 0.5:
            words = choose.choice(texts).split()
            for _ in range(choose.randint(0, 3)):
                words[choose.randrange(len(words))] = word()
        else:
            words = [word() for _ in range(choose.randint(1, 60))] + (passage if choose.random() < 0.3 else []) + ["again", "and"] * choose.choice([0, 0, 20])
        texts.append(" ".join(words))
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [None, 60])
def test_near_copies_are_those_of_all_pairs(spark, monkeypatch, block):
    if block:  # many blocks in a bucket
        monkeypatch.setattr(bag_minhash, "BLOCK_SHINGLES", block)
    rows = [*made(1), (1000, None), (1001, ""), (1002, " ,"), (1003, "one two"), (1004, "One, two!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    got = bag_minhash.classes(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_near_copies_edge_cases(spark):
    docs = spark.createDataFrame([(1, "same text here"), (1, "same text here"), (None, "same text here"), (None, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["kept"]) for r in bag_minhash.classes(docs).collect()) == [("1", "1", True)] * 2 + [("None", "None", True)] * 2
    assert bag_minhash.classes(docs.filter("doc_id < 0")).count() == 0


def test_signatures_estimate_weighted_jaccard():
    """Unbiased for counts that a level covers in part, too."""
    h = np.arange(1, 61, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    choose = np.random.default_rng(2)
    a, b = choose.integers(1, 12, 60), choose.integers(1, 12, 60)
    text = np.repeat([0, 1], 60)
    sig = bag_minhash.signatures(text, np.concatenate([h, h]), np.concatenate([a, b]), 2, registers=4000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_large_counts_split_few_processes(monkeypatch):
    """As many as there are points, times the logarithm of the count."""
    made, split = [], bag_minhash.Intervals.split

    def counted(self, *a):
        left, found = split(self, *a)
        made.append(len(found.low))
        return left, found

    monkeypatch.setattr(bag_minhash.Intervals, "split", counted)
    h = np.arange(1, 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = np.array([1_000_000, 3, 1]), np.array([800_000, 3, 1])
    sig = bag_minhash.signatures(np.repeat([0, 1], 3), np.concatenate([h, h]), np.concatenate([a, b]), 2, registers=1000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(0.8, abs=0.04)
    assert sum(made) < 60_000


def test_texts_that_fool_powers_of_two(spark):
    rows = [(i, " ".join(("alpha", "beta")[(bin(k).count("1") + i) % 2] for k in range(1024))) for i in range(2)]
    got = {r["doc_id"]: r["class_id"] for r in bag_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r["id"]: r["component"] for r in connected(links).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected(links.filter("a < 0")).count() == 0


def vectors(seed=0, n=300, d=16):
    choose = np.random.default_rng(seed)
    x = choose.normal(size=(n, d))
    for i in range(n // 2, n):  # near copies of various closeness, and copies
        x[i] = x[choose.integers(0, n // 2)] + choose.normal(size=d) * choose.choice([0, 0.05, 0.15, 0.25])
    return [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]


BAD = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [float("inf")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, []), (1006, [1.0, 2.0]), (1007, [2.0, 4.0])]


def cosines(rows):
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


@pytest.mark.parametrize("block", [None, 20])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(itq_dedup, "BLOCK", block)
    rows = vectors()
    frame = spark.createDataFrame(rows + BAD, "vec_id long, embedding array<float>").withColumn("n_links", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in itq_dedup.link(frame).collect()}
    close = cosines(rows) >= 0.9
    np.fill_diagonal(close, False)
    want = classes_of(range(len(rows)), np.argwhere(close).tolist())
    missed = sum(got[i][0] != close[i].sum() for i in range(len(rows)))
    assert missed <= 2 and sum(got[i][1] != want[i] for i in range(len(rows))) <= 2
    assert {i: got[i] for i, _ in BAD} == {**{i: (0, i, True) for i, _ in BAD[:6]}, 1006: (1, 1006, True), 1007: (1, 1006, False)}
    assert itq_dedup.link(frame.filter("vec_id < 0")).count() == 0 and itq_dedup.link(frame.filter("vec_id = 1000")).count() == 1


@pytest.mark.parametrize("shared", [0.69, 0.87])
def test_links_of_vectors_that_share_a_direction(spark, shared):
    """Recall against all pairs; half of the rows have a partner just above the threshold."""
    choose, n, d = np.random.default_rng(7), 3000, 64
    apart = choose.normal(size=(n, d))
    apart[:, 0] = 0
    apart /= np.linalg.norm(apart, axis=1, keepdims=True)
    like = (0.905 - shared**2) / (1 - shared**2)
    apart[n // 2 :] = like * apart[: n // 2] + (1 - like**2) ** 0.5 * apart[n // 2 :]
    x = (1 - shared**2) ** 0.5 * apart / np.linalg.norm(apart, axis=1, keepdims=True)
    x[:, 0] = shared
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in itq_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    close = cosines(rows) >= 0.9
    np.fill_diagonal(close, False)
    assert close.sum() > 0.6 * n and sum(got.values()) >= 0.998 * close.sum()


def test_tables_hold_their_recall():
    """At the threshold, at the row nearest to the mean, or else all pairs."""
    for shared in (0.0, 0.5, 0.69, 0.87, 0.95):
        choose = np.random.default_rng(8)
        x = choose.normal(size=(2000, 64)) / 8 * (1 - shared**2) ** 0.5
        x[:, 0] += shared
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        codes = itq_dedup.fit(x, 50_000, 0.9)
        angle = itq_dedup.centred_angle(0.9, np.linalg.norm(x - codes.mean, axis=1).min())
        assert 1 - (1 - (1 - angle / np.pi) ** codes.bits) ** codes.tables >= 0.999 - 1e-9
        assert codes.bits or shared > 0.6


def test_rotation_balances_codes():
    x = np.random.default_rng(1).normal(size=(500, 8)) * np.arange(1, 9)
    rotation = itq_dedup.learn_rotation(x, np.random.default_rng(2))
    assert np.allclose(rotation @ rotation.T, np.eye(8)) and abs((x @ rotation >= 0).mean(axis=0) - 0.5).max() < 0.15


def test_neighbours_against_brute_force(spark):
    rows = vectors(3, 1500)
    frame = spark.createDataFrame(rows + BAD[:6], "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = permutation_index.search(frame, F.col("vec_id") % 50 == 0).collect()
    close, hits, total = cosines(rows), 0, 0
    for query in range(0, len(rows), 50):
        mine = sorted((r for r in got if r["query_id"] == query), key=lambda r: r["rank"])
        order = [int(i) for i in np.lexsort((np.arange(len(rows)), -np.round(close[query], 12))) if i != query][:5]
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(abs(r["score"] - close[query, r["vec_id"]]) < 1e-12 for r in mine)
        assert [(-round(r["score"], 12), r["vec_id"]) for r in mine] == sorted((-round(r["score"], 12), r["vec_id"]) for r in mine)
        hits, total = hits + len({r["vec_id"] for r in mine} & set(order)), total + 5
    assert hits / total >= 0.9 and {r["query_id"] for r in got} == set(range(0, len(rows), 50))


def test_neighbours_in_a_narrow_cone(spark):
    choose, n, d = np.random.default_rng(9), 6000, 64
    x = choose.normal(size=(n, d)) / 8 * 0.26
    x[:, 0] += 1
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    close = cosines(rows)
    assert close.min() > 0.8 and len(permutation_index.choose_pivots(np.array([v for _, v in rows]) / np.linalg.norm(x, axis=1, keepdims=True), 128)) == 128
    got = permutation_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    np.fill_diagonal(close, -1)
    hits = sum(len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-close[q])[:5].tolist())) for q in range(0, n, 50))
    assert hits / (n // 50 * 5) >= 0.9


def test_rows_tied_at_the_cut_are_reranked():
    """All orders alike: the whole block is reranked."""
    x = np.random.default_rng(4).normal(size=(2000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    places = np.zeros((2000, 3), np.int16)
    for i, rows, _ in permutation_index.search_block(places, x, np.arange(2000), places[:20], x[:20], 5, 0.05):
        assert rows.tolist() == np.argsort(-(x @ x[i]))[:5].tolist()


def test_neighbours_of_copies_and_few(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(0, 20)] + [(100, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = permutation_index.search(same, F.col("vec_id").isin(3, 100)).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {(3, k, v) for k, v in enumerate((0, 1, 2, 4, 5), 1)} | {(100, k, k - 1) for k in range(1, 6)}
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert {(r["query_id"], r["vec_id"]) for r in permutation_index.search(few, F.col("vec_id") % 50 == 0).collect()} == {(0, 50), (50, 0)}
    assert permutation_index.search(few.filter("vec_id < 0"), F.col("vec_id") == 0).count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").withColumn("score", F.lit(1)).withColumn("_kept", F.lit("x"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.columns == columns
        before, after = ({r["doc_id"] for r in df.select("doc_id").collect()} for df in (docs, out))
        assert after < before and len(after) > 0.7 * len(before), name
        if name == "near_copies":
            classes = {r["doc_id"]: r["class_id"] for r in bag_minhash.classes(docs).collect()}
            assert after == set(classes.values())
        docs = spark.createDataFrame(out.collect(), out.schema)
    pieces = corpus_pipeline.pack(spark, docs, sf).collect()
    assert {p["doc_id"] for p in pieces} == after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "packing"]


def test_reading_is_fitted_to_the_vectors():
    choose = np.random.default_rng(6)
    spread = choose.normal(size=(2000, 32))
    close = choose.normal(size=(40, 32))[choose.integers(0, 40, 2000)] + 0.3 * choose.normal(size=(2000, 32))
    few, many = (permutation_index.fit_reading(x, permutation_index.choose_pivots(x, 128)) for x in (y / np.linalg.norm(y, axis=1, keepdims=True) for y in (close, spread)))
    assert few.files < many.files and few.share < many.share
    assert [permutation_index.pivots_for(n) for n in (0, 10**4, 5 * 10**4, 10**6, 10**12)] == [128, 128, 256, 1024, 4096]


def test_orders_of_more_pivots_than_are_kept(monkeypatch):
    monkeypatch.setattr(permutation_index, "KEPT", 5)
    x = np.random.default_rng(2).normal(size=(50, 8))
    order = permutation_index.orders(x, x[:20])
    assert (order == np.argsort(-(x @ x[:20].T), axis=1)[:, :5]).all()
    places = permutation_index.places_of(order, 20)
    assert (places[np.arange(50)[:, None], order] == np.arange(5)).all() and (np.sort(places, axis=1)[:, 5:] == 5).all()


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11)) and "pipeline" in queries.QUERIES


def test_sql_of_chat_format(spark, sf_dir):
    from tests.compare import connect, same

    same(queries.op6_chat_format(spark, sf_dir), connect(sf_dir), queries.OP6_SQL)


def test_sql_of_vector_links(spark, sf_dir, tmp_path):
    """On the fixture, and on vectors that have links."""
    from tests.compare import connect, same

    same(queries.op4_itq_dedup(spark, sf_dir), connect(sf_dir), queries.OP4_SQL)
    frame = spark.createDataFrame(vectors(n=200) + BAD[:6], "vec_id long, embedding array<float>")
    frame.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = __import__("duckdb").connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    same(queries.op4_itq_dedup(spark, str(tmp_path)), con, queries.OP4_SQL)


def test_stages_keep_odd_rows(spark):
    """Null ids and texts stay; repeated rows of an id are kept once; no table, no rows."""
    rows = [(1, "same words in this text here"), (1, "same words in this text here"), (2, "same words in this text here"), (None, "same words in this text here"), (None, None), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "'x' AS class_id", "1 AS kept")
    got = corpus_pipeline.near_copies(spark, docs, "/root/testdata/sf0.001")
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == sorted([("1", rows[0][1]), ("None", rows[0][1]), ("None", "None"), ("3", "None"), ("4", "")])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("doc_id < 0"), "/root/testdata/sf0.001").count() == 0
