"""Alignment of two tokenizers against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from functools import cache

import public_tokenizers as tokens
import pytest
from pyspark.sql import functions as F

from souk.llm import alignment, queries
from souk.llm.common import table, written

A, B = tokens.path("byte_bpe_50k.json"), tokens.path("piece_bpe_32k.model")


@cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, decoders.ByteLevel(), sentencepiece.SentencePieceProcessor(model_file=B)


def tokens_of(text):
    """[(id, bytes)] of both, or nothing."""
    a, _, b = libraries()
    letters = alignment._byte_letters()
    first = [(i, bytes(letters[c] for c in t)) for i, t in ((i, a.id_to_token(i)) for i in a.encode(" " + text, add_special_tokens=False).ids)]
    second = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        second.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    if not text or any(b"".join(x for _, x in side) != (" " + text).encode() for side in (first, second)):
        return [], []
    return first, second


def groups_of(first, second):
    out, i, j = [], 0, 0
    while i < len(first):
        a, b, n, m = [first[i][0]], [second[j][0]], len(first[i][1]), len(second[j][1])
        i, j = i + 1, j + 1
        while n != m:
            if n < m:
                a, n, i = [*a, first[i][0]], n + len(first[i][1]), i + 1
            else:
                b, m, j = [*b, second[j][0]], m + len(second[j][1]), j + 1
        out.append((a, b))
    return out


def by_hand(rows):
    """Rows of the query, from (doc_id, text)."""
    found = [(d, groups_of(*tokens_of(t or ""))) for d, t in rows]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for _, g in found]
    count = Counter(p for own in links for p in own)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (d, g), own in zip(found, links, strict=True):
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()), sum(k for p, k in own.items() if count[p] == most[p[0]]),
                    sum(k * count[p] for p, k in own.items()), hashlib.sha256(told.encode()).hexdigest() if g else ""))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
MORE = ["a▁b", "▁", " ", "  two  blanks ", "tab\t\tand \r\n lines\n\n", "<|endoftext|> </s> <s> <unk> <0x41>", "é́ 日本語 🙂🙂 \x00\x01 �", "a b　c \x85", "x=1234567;y+=(z);", "https://a.example/b?c=d&e=f", "aaaa" * 900, "don't WON'T I'Ll"]


@pytest.fixture
def docs(spark, odd):
    rows = [(100 + i, t) for i, t in enumerate(MORE)] + [(None, "no id here"), (777, "twice the same"), (777, "twice the same")]
    return odd.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)


def key(r):
    return tuple((x is None, x) for x in r)


def run(df, lookup=alignment.LOOKUP):
    held = written(alignment.align(df, A, B), "test")
    out = alignment.scored(held, alignment.pair_counts(held), lookup)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return sorted((tuple(r) for r in out.select(*COLUMNS, digest.alias("groups_sha256")).collect()), key=key)


@pytest.mark.parametrize("lookup", [alignment.LOOKUP, 0])
def test_rows_are_those_of_brute_force(docs, lookup):
    """By lookup, and by the join that stands in for it beyond a size."""
    expected = sorted(by_hand([(r.doc_id, r.text) for r in docs.collect()]), key=key)
    assert run(docs, lookup) == expected
    assert sum(r[1] == 0 for r in expected) >= 4


def test_links_in_parts(docs, monkeypatch):
    """However few links are expanded at a time, and however often tasks empty their sums."""
    from souk.llm.alignment import Side, cut_groups, distinct_links
    from souk.llm.common import text_buffer
    import pyarrow as pa

    texts = pa.array([" " + (r.text or "") for r in docs.collect()])

    def links():
        a, b = Side(alignment._byte_encoder(A), alignment.byte_level(A), texts), Side(alignment._piece_encoder(B), alignment.piece_level(B), texts)
        cut_groups(a, b, *text_buffer(texts))
        return [x.tolist() for x in distinct_links(a, b)]

    whole = links()
    monkeypatch.setattr(alignment, "AT_ONCE", 7)
    assert links() == whole


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert sorted((tuple(r) for r in queries.op12_token_alignment(spark, sf_dir).collect()), key=key) == sorted(by_hand(rows), key=key)


def test_empty_table(docs):
    assert run(docs.limit(0)) == []
