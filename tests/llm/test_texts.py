"""Operators on texts against brute force, and their edge cases."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as tokens
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from souk.llm import byte_bpe, chat, license_scan, packing, quality_rules, queries, token_files, toxic_crf
from souk.llm.common import table, words_of
from souk.llm.token_cache import library_encoder

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def texts_of(spark, sf_dir, name="documents"):
    return {r["doc_id"]: r["text"] for r in table(spark, sf_dir, name).select("doc_id", "text").collect()}


def test_words_are_those_of_the_pattern(odd):
    texts = [r["text"] for r in odd.orderBy("doc_id").collect()]
    words = words_of(pa.array(texts))
    got = [[words.folded[a:b].tobytes().decode() for a, b in zip(words.starts[x:y], words.ends[x:y], strict=True)] for x, y in zip(words.first[:-1], words.first[1:], strict=True)]
    assert got == [WORD.findall(lower(t or "")) for t in texts]
    assert len(set(words.hashes.tolist())) == len({w for ws in got for w in ws})


@pytest.mark.parametrize("source", ["odd", "documents"])
def test_license_scan_finds_each_place(spark, sf_dir, odd, source):
    docs = odd if source == "odd" else table(spark, sf_dir, "documents")
    phrases = {tuple(k.split()): v for k, v in license_scan.BASE_PHRASES.items()}
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert len(got) == docs.count()
    for doc in docs.collect():
        words = WORD.findall(lower(doc["text"] or ""))
        places = [(i, v) for i in range(len(words)) for k, v in phrases.items() if tuple(words[i : i + len(k)]) == k]
        row = got[doc["doc_id"]]
        assert (row["n_words"], row["n_base"]) == (len(words), len(places))
        assert (row["first_word"], row["last_word"]) == (min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert row["base_labels"] == ",".join(sorted({v for _, v in places}))
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1


def test_license_expressions():
    labels, burden = license_scan.evaluate("MIT OR (Apache-2.0 AND GPL-2.0 WITH Classpath-exception)")
    assert labels == {"mit", "apache-2.0", "gpl-2.0"} and burden == pytest.approx(0.1)
    assert license_scan.evaluate("MIT AND GPL-3.0")[1] == pytest.approx(0.8)
    assert license_scan.evaluate("GPL-3.0 WITH x")[1] == pytest.approx(0.5)
    for broken in ("", "MIT OR", "(MIT", "MIT)", "OR MIT", "MIT GPL"):
        assert license_scan.evaluate(broken) is None


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_packed_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (token_files.unpack(data, 1001, bits) == ids).all()


def test_token_file_gives_random_access(tmp_path):
    random_ids = np.random.default_rng(1).integers(0, 50_000, 20_000).astype(np.uint32)
    with open(tmp_path / "f", "wb") as f:
        writer = token_files.Writer(f, 17)
        for i, part in enumerate(np.array_split(random_ids, 7)):
            writer.add(i if i else None, part)
        writer.close()
    reader = token_files.Reader(open(tmp_path / "f", "rb"))
    assert reader.docs[0] == token_files.NO_ID and (reader.tokens(0, 20_000) == random_ids).all()
    assert (reader.tokens(4000, 8300) == random_ids[4000:8300]).all() and not len(reader.tokens(5, 5))


@pytest.mark.parametrize("source", ["odd", "documents"])
def test_token_files_hold_the_librarys_ids(spark, sf_dir, odd, source):
    docs = odd if source == "odd" else table(spark, sf_dir, "documents")
    path = tokens.path("byte_bpe_50k.json")
    library, start = Tokenizer.from_file(path), 0
    got = {r["doc_id"]: r for r in token_files.round_trip(docs, path).collect()}
    for row in docs.orderBy("doc_id").collect():
        ids = [*library.encode(row["text"] or "", add_special_tokens=False).ids, 2]
        mine = got[row["doc_id"]]
        assert (mine["start"], mine["n_tokens"], np.frombuffer(mine["ids"], "<u4").tolist()) == (start, len(ids), ids)
        start += len(ids)
    assert len(got) == docs.count()


def test_empty_and_null_tables(spark, odd):
    none = odd.filter("doc_id < 0")
    assert token_files.round_trip(none, tokens.path("byte_bpe_50k.json")).count() == 0
    assert packing.pack(none, tokens.path("word_bpe_49k.json")).count() == 0
    assert license_scan.scan(none).count() == 0
    nulls = odd.limit(2).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r["doc_id"] for r in token_files.round_trip(nulls, tokens.path("byte_bpe_50k.json")).collect()] == [None, None]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_rules.score(odd, quality_rules.train(odd, labels)).collect()} == {0.5}
    assert {r["score"] for r in toxic_crf.tag(odd, toxic_crf.train(odd, labels)).collect()} == {0.5}


@pytest.mark.parametrize("words", [False, True])
def test_units_encode_as_the_library_does(words):
    path = tokens.path("word_bpe_49k.json" if words else "byte_bpe_50k.json")
    special = ("<|startoftext|>", "<|endoftext|>") if words else ("<|endoftext|>",)
    encoder, library, choose = library_encoder(path, special, words), Tokenizer.from_file(path), random.Random(3)
    texts = ["".join(choose.choice("abzAZ'sStTd019 .,!\n\t  éñß —日 ") for _ in range(choose.randint(0, 40))) for _ in range(1500)] + ["<|endoftext|> a", " ", ""]
    for at in range(0, len(texts), 40):
        ids, starts = encoder.encode(pa.array(texts[at : at + 40]))
        for i, text in enumerate(texts[at : at + 40]):
            assert ids[starts[i] : starts[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_byte_bpe_is_that_of_tiktoken(spark, sf_dir, odd):
    path = tokens.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd.select("doc_id", "text").unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    encoded = byte_bpe.encode(docs, path, tokens.PATTERN)
    got = {r["doc_id"]: r for r in byte_bpe.decode(encoded, path).collect()}
    for row in docs.collect():
        ids = theirs.encode_ordinary(row["text"] or "")
        mine = got[row["doc_id"]]
        assert (mine["n_tokens"], mine["ids_text"], bytes(mine["text_bytes"])) == (len(ids), " ".join(map(str, ids)), (row["text"] or "").encode())


def thue_morse(n, a, b):
    """Sequences on which polynomials modulo a power of two collide with their complements."""
    return [b if bin(i).count("1") % 2 else a for i in range(n)], [a if bin(i).count("1") % 2 else b for i in range(n)]


@pytest.mark.parametrize("n", [1024, 2048])
def test_no_sequence_is_taken_for_its_complement(n):
    letters = ["".join(x) for x in thue_morse(n, "a", "b")]
    codec = byte_bpe.Codec.from_file(tokens.path("byte_bpe_50k.tiktoken"))
    bytes_of, encoder = byte_bpe.decoder(tokens.path("byte_bpe_50k.tiktoken")), byte_bpe.unit_encoder(codec, tokens.PATTERN)
    ids, starts = encoder.encode(pa.array(letters))
    assert [bytes_of(ids[starts[i] : starts[i + 1]]).tobytes().decode() for i in range(2)] == letters
    for name, special, words in (("byte_bpe_50k.json", ("<|endoftext|>",), False), ("word_bpe_49k.json", ("<|startoftext|>", "<|endoftext|>"), True)):
        library = Tokenizer.from_file(tokens.path(name))
        ids, starts = library_encoder(tokens.path(name), special, words).encode(pa.array(letters))
        assert [ids[starts[i] : starts[i + 1]].tolist() for i in range(2)] == [library.encode(t, add_special_tokens=False).ids for t in letters]
    words = words_of(pa.array([" ".join(x) for x in thue_morse(n, "alpha", "beta")] + letters))
    assert len({tuple(k) for k in words.keys().tolist()}) == 4 and len({*words.hashes.tolist()}) == 4


def test_units_of_equal_numbers_differ():
    """Zero bytes count, and so does the length."""
    texts = ["a", "a\0", "\0", "\0\0", "a" * 15, "a" * 16, "a" * 17, "abcdefgh", "abcdefgh\0"]
    library, encoder = Tokenizer.from_file(tokens.path("byte_bpe_50k.json")), library_encoder(tokens.path("byte_bpe_50k.json"), ("<|endoftext|>",), False)
    ids, starts = encoder.encode(pa.array(texts * 3))
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts] * 3


def test_the_unit_table_is_bounded(monkeypatch):
    from souk.llm.token_cache import Encoder, UnitTable, library_units

    monkeypatch.setattr(UnitTable, "LIMIT", 50)
    path = tokens.path("byte_bpe_50k.json")
    library, encoder, choose = Tokenizer.from_file(path), Encoder(*library_units(path)), random.Random(9)
    for _ in range(30):
        texts = ["".join(choose.choice("abcdef   ") for _ in range(60)) for _ in range(5)]
        ids, starts = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert encoder.table.count < 50 + 300


def test_other_patterns_encode_by_whole_texts(spark, odd):
    path, pattern = tokens.path("byte_bpe_50k.tiktoken"), r"\p{L}+|\P{L}"
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = {r["doc_id"]: bytes(r["ids"]) for r in byte_bpe.encode(odd, path, pattern).collect()}
    assert all(np.frombuffer(got[r["doc_id"]], "<u4").tolist() == theirs.encode_ordinary(r["text"] or "") for r in odd.collect())


def test_long_pieces_merge_alike():
    codec = byte_bpe.Codec.from_file(tokens.path("byte_bpe_50k.tiktoken"))
    choose = random.Random(5)
    piece = "".join(choose.choice("abethsnoir") for _ in range(500)).encode()
    assert codec.merge([piece], 512)[0].tolist() == codec.merge_long(piece).tolist()


def test_packing_places_each_id_once(spark, sf_dir, odd):
    path = tokens.path("word_bpe_49k.json")
    docs = odd.select("doc_id", "text").unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc in docs.collect():
        pieces = sorted(by_doc[doc["doc_id"]], key=lambda r: r["start"])
        ids = [*library.encode(doc["text"] or "", add_special_tokens=False).ids, 2]
        assert [p["start"] for p in pieces] == [0, *np.cumsum([p["length"] for p in pieces])[:-1].tolist()]
        assert np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").tolist() == ids and {p["doc_tokens"] for p in pieces} == {len(ids)}
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == [0, *np.cumsum([p["length"] for p in pieces])[:-1].tolist()] and sum(p["length"] for p in pieces) <= 4096
    used = sum(r["length"] for r in rows)
    assert used / (4096 * len(by_sequence)) > 0.95
    assert sum(r["used"] for r in packing.sequences(packing.pack(odd, path)).collect()) == sum(r["length"] for r in packing.pack(odd, path).collect())


def test_windows_stay_bounded():
    windows, choose, closed = packing.Windows(100, 4), random.Random(1), []
    for i in range(500):
        closed += windows.place(i, choose.randint(1, 100))
        assert len(windows.room) <= 4
    closed += windows.rest()
    assert sorted(p for _, pieces in closed for p, _ in pieces) == list(range(500))


def test_chat_log_is_folded(spark):
    log = [(1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", None), (1, 3, "delta", 2, None, "Hel"), (1, 4, "delta", 2, None, "lo"), (1, 5, "message", 3, "user", "gone"), (1, 6, "regenerate", 2, None, None),
           (1, 7, "delta", 2, None, "Bye <|end|>\n␛1"), (1, 8, "edit", 1, None, "hey"), (2, 1, "message", 1, None, None)]
    messages = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string"))
    assert sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in messages.collect()) == [(1, 1, "user", "hey"), (1, 2, "assistant", "Bye <|end|>\n␛1"), (2, 1, "", "")]
    out = chat.render(messages).select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    rows = {r["conv_id"]: r for r in out.collect()}
    assert [tuple(t) for t in rows[1]["turns"]] == [("user", "hey"), ("assistant", "Bye <|end|>\n␛1")] and rows[1]["loss"] == "Bye <|end|>\n␛1"
    assert rows[1]["formatted"].count("<|end|>") == 2
    assert chat.fold(spark.createDataFrame([], "conv_id long, seq long, kind string, turn long, role string, text string")).count() == 0


ROLES = ["a|>b", "|>", ">x", "x<", "<|", "user", "", None, "␛2", "a|"]


def test_roles_and_texts_read_back(spark):
    rows = [(i, j, role, text) for i, text in enumerate(["hello", "|>hello", "<|end|>\n", "␛1␛0␛", "", None]) for j, role in enumerate(ROLES)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.render(chat.fold(chat.events_of(frame)))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert got == {i: [(r or "", text or "") for c, _, r, text in rows if c == i] for i in range(6)}


def test_the_log_has_all_kinds_of_events(spark, sf_dir):
    log = chat.events_of(table(spark, sf_dir, "conversations"))
    kinds = {r["kind"]: r["n"] for r in log.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and min(kinds.values()) > 10
    assert log.count() > table(spark, sf_dir, "conversations").count()
    assert log.groupBy("conv_id", "seq").count().filter("count > 1").isEmpty()


def test_conversations_read_back(spark, sf_dir):
    got = {r["conv_id"]: r for r in queries.op6_chat_format(spark, sf_dir).collect()}
    convs: dict = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").collect():
        convs.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        row = got[conv]
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def _held_out(rows, mod, rest):
    return [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % mod == rest]


def figures(rows, gold, label):
    """Precision, recall and the area under the curve over held-out labelled rows."""
    score = np.array([r["score"] for r in rows])
    true = np.array([gold[r["doc_id"]][label] for r in rows]) == 1
    predicted = np.array([r["predicted"] for r in rows]) == 1
    wins = (score[true][:, None] > score[~true]).mean() + 0.5 * (score[true][:, None] == score[~true]).mean()
    return (predicted & true).sum() / max(1, predicted.sum()), (predicted & true).sum() / true.sum(), wins


@pytest.mark.parametrize(("name", "label", "mod", "rest", "sf", "least"), [
    ("op7_quality_rules", "quality", 3, 1, "sf0.01", (0.95, 0.95, 0.97)),
    # of 14 held-out rows labelled toxic 5 hold none of the words that the other toxic rows share
    ("op10_toxic_crf", "toxic", 4, 2, "sf0.01", (0.9, 9 / 14, 0.85)),
    ("op10_toxic_crf", "toxic", 4, 2, "sf0.1", (0.9, 0.8, 0.9)),
])
def test_classifiers_on_held_out_rows(spark, name, label, mod, rest, sf, least):
    sf = f"/root/testdata/{sf}"
    rows = getattr(queries, name)(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) for r in rows)
    gold = {r["doc_id"]: r for r in table(spark, sf, "labels").collect()}
    got = figures([r for r in _held_out(rows, mod, rest) if r["doc_id"] in gold], gold, label)
    assert all(a >= b - 1e-9 for a, b in zip(got, least, strict=True)), got


@pytest.mark.parametrize("module", [quality_rules, toxic_crf])
def test_clashing_columns_and_null_ids(spark, odd, module):
    """Names that the operators use themselves."""
    docs = odd.withColumns({c: F.lit(1) for c in ("_id", "_label", "_row", "_order", "log_chars", "spans")}).unionByName(odd.limit(1).withColumn("doc_id", F.lit(None).cast("long")), allowMissingColumns=True)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], "doc_id long, quality int, toxic int").withColumn("_id", F.lit(0))
    model = module.train(docs, labels)
    out = (module.score if module is quality_rules else module.tag)(docs, model)
    assert out.count() == docs.count() and out.filter("score is null").isEmpty()


def test_field_marginals_are_those_of_all_paths():
    """Against the sum over all label sequences, across segments of a text."""
    import itertools

    energy, trans = np.random.default_rng(0).normal(size=9), np.array([[0.0, 0.4], [-0.7, 1.1]])
    first = np.array([0, 5, 5, 9])
    old, toxic_crf.SEGMENT = toxic_crf.SEGMENT, 2
    try:
        got, _ = toxic_crf.Lattice(first).run(energy, trans)
    finally:
        toxic_crf.SEGMENT = old
    for a, b in ((0, 5), (5, 9)):
        total, one = 0.0, np.zeros(b - a)
        for path in itertools.product((0, 1), repeat=b - a):
            weight = np.exp(sum(energy[a + i] * y for i, y in enumerate(path)) + sum(trans[x, y] for x, y in itertools.pairwise(path)))
            total += weight
            one += weight * np.array(path)
        assert np.allclose(got[a:b], one / total)


def test_spans_point_at_the_words(spark, odd):
    bad = "é you idiot there, clown"
    rows = [(i, f"{' '.join(f'é{i * k % 97}w{i}' for k in range(12))} {bad if i % 2 else 'fine text'} {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxic_crf.train(docs, labels)
    for r in toxic_crf.tag(docs, model, whole=True).collect():
        found = " ".join(r["_row"]["text"][s["start"] : s["end"]] for s in r["spans"])
        assert ("idiot" in found) == bool(r["doc_id"] % 2) and (r["score"] > 0.5) == bool(r["doc_id"] % 2)
    assert toxic_crf.tag(odd.withColumns({"_id": F.lit(1), "_label": F.lit(2), "_text": F.lit(3)}), model, whole=True).count() == odd.count()


def test_rules_hold_as_columns(spark, odd):
    model = quality_rules.RuleModel(0.1, [(((0, True, 3.0), (3, False, 0.2)), 1.5)])
    stats = quality_rules.statistics(odd)
    for r in stats.select("*", model.column().alias("p")).collect():
        x = np.array([[r[c] for c in quality_rules.FEATURES]])
        total = 0.1 + 1.5 * quality_rules.holds(model.rules[0][0], x)[0]
        assert r["p"] == pytest.approx(1 / (1 + np.exp(-total)))


