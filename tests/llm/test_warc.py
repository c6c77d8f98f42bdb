"""WARC archives: whole round trips, the normaliser on streams of others, damaged files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import zlib
from collections import defaultdict

import pytest

from souk.llm import queries, warc
from souk.llm.common import scratch


def rows_of(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=lambda r: tuple((x is None, x) for x in r))


def by_hand(pages, at_least=0):
    groups = defaultdict(list)
    for page_id, html in pages:
        groups[(html or "").encode()].append(page_id)
    out = []
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        last = max((i for i in ids if i is not None), default=None)
        for i in ids:
            first = last is None or i == last or len(payload) < at_least
            out.append((i, len(payload), digest, "response" if first else "revisit", None if first else last))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


PAGES = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, None, "same"), (None, "http://a/n", "same"), (7, "http://a b/\r\nX: 1", ""), (8, "u", None), (9, "é", "WARC/1.1\r\n\r\n\r\n\r\nWARC-Type: x\r\nContent-Length: 5\r\n\r\n"),
         (10, "u", "é日本" * 50_000), (11, "u", "twice"), (11, "u", "twice"), (12, "u", "a\x00b"), (None, "u", "alone"), (-4, "u", "below zero"), (-9, "u", "below zero")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "x", 0.5) for r in PAGES], "page_id long, url string, html string, payload string, response_id double")


@pytest.mark.parametrize("at_least", [0, 1, 5])
def test_round_trip(pages, at_least):
    out = warc.round_trip(pages, at_least)
    assert rows_of(out) == by_hand([(r[0], r[2]) for r in PAGES], at_least)
    found = out.collect()
    assert all(r.sound for r in found)
    texts = defaultdict(list)
    for i, _, html in PAGES:
        texts[i].append((html or "").encode())
    assert all(bytes(r.payload) in texts[r.page_id] for r in found if r.record_type == "response")


def test_each_record_is_a_member_of_its_own(spark, pages):
    raw, out = scratch(spark, "raw"), scratch(spark, "out")
    files = warc.archive(warc.decided(pages.coalesce(1)), raw)
    warc.normalise(spark, raw, files, out)
    entries = [r.asDict() for r in warc.index(spark, out).collect()]
    assert len(entries) == len(PAGES) + files.count()
    for name in {e["file"] for e in entries}:
        whole = open(f"{raw.removeprefix('file://')}/{name}", "rb").read()
        z = zlib.decompressobj(31)
        plain = z.decompress(whole)
        assert z.eof and not z.unused_data  # one member before
        data = open(f"{out.removeprefix('file://')}/{name}", "rb").read()
        own = sorted((e["offset"], e["length"]) for e in entries if e["file"] == name)
        parts = [data[a : a + n] for a, n in own]
        assert b"".join(parts) == data
        assert b"".join(zlib.decompress(p, 31) for p in parts) == plain


def test_any_rows_of_the_index_can_be_fetched(spark, pages):
    raw, out = scratch(spark, "raw"), scratch(spark, "out")
    warc.normalise(spark, raw, warc.archive(warc.decided(pages), raw), out)
    some = warc.records(warc.index(spark, out).filter("uri = 'http://a/1'"), out).collect()
    assert [(r.page_id, r.record_type, r.refers_to) for r in some] == [(1, "revisit", 5)]


def other(*blocks: bytes) -> bytes:
    return b"".join(b"WARC/1.0\r\nWARC-Type: resource\r\nX-Long: a\r\n  b\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)


class Cut(io.BytesIO):
    """Gives few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(n, 7))


@pytest.mark.parametrize("data", [gzip.compress(other(b"one", b"", b"x" * 100_000)), gzip.compress(other(b"one")) + gzip.compress(other(b"", b"x" * 100_000)), gzip.compress(other(b"one", b"")[:60]) + gzip.compress(other(b"one", b"")[60:] + other(b"x" * 100_000))])
def test_streams_of_one_or_more_members(data):
    stream, found = warc.Stream(Cut(data), "f"), []
    while head := stream.head():
        assert head[1]["x-long"] == "a b"
        found.append(b"".join(stream.take(int(head[1]["content-length"]))))
    assert found == [b"one", b"", b"x" * 100_000]


@pytest.mark.parametrize("data", [gzip.compress(other(b"one"))[:-12], gzip.compress(other(b"one")[:-8]), gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n"), b"no gzip at all", gzip.compress(other(b"one")[:20])])
def test_damaged_streams_name_their_file(data):
    stream = warc.Stream(io.BytesIO(data), "the-file")
    with pytest.raises(ValueError, match="the-file"):
        while head := stream.head():
            list(stream.take(int(head[1]["content-length"])))


def test_empty_stream_and_empty_table(spark, pages):
    assert warc.Stream(io.BytesIO(b""), "f").head() is None
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_files_are_cut_at_their_size(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    raw, out = scratch(spark, "raw"), scratch(spark, "out")
    files = warc.archive(warc.decided(pages.coalesce(1)), raw)
    warc.normalise(spark, raw, files, out)
    assert files.count() > 2
    assert rows_of(warc.records(warc.index(spark, out), out)) == by_hand([(r[0], r[2]) for r in PAGES])
    lines = [json.loads(x) for x in open(f"{out.removeprefix('file://')}/{files.first().file}.index")]
    assert [e["offset"] for e in lines][0] == 0


def test_query_equals_its_sql(spark, sf_dir):
    from tests.compare import connect, same

    same(queries.op11_warc_normaliser(spark, sf_dir), connect(sf_dir), queries.ORACLE["op11_warc_normaliser"])
