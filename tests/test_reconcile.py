"""Sheets of several versions, against a list worked by hand."""

from __future__ import annotations

from souk.operators import reconcile as N

FIELDS = [N.Field("id", "bigint", required=True), N.Field("gold", "string"), N.Field("score", "double"), N.Field("borderline", "boolean", default="false")]


def test_sheets_are_typed_and_faults_are_numbered(spark, tmp_path):
    (tmp_path / "v1.csv").write_bytes(b"\xef\xbb\xbfid,gold\r\n1,Track\r\n2,\"two\r\nlines, and a \"\"quote\"\"\"\r\nx,bad id\r\n1,again\r\n,none\r\n")
    (tmp_path / "v2.csv").write_bytes("id,score,gold,borderline,note\n3,0.5,é,true,n\n4,high, ,maybe,n\n5,,z,,n\n".encode())
    (tmp_path / "v3.csv").write_bytes(b"gold\nlost\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    good, faults = N.typed(N.sheets(spark, f"file://{tmp_path}/*.csv"), FIELDS, key="id")
    assert sorted(map(tuple, good.collect()), key=str) == [
        ("v1.csv", 2, 1, "Track", None, False), ("v1.csv", 4, 2, 'two\r\nlines, and a "quote"', None, False), ("v2.csv", 2, 3, "é", 0.5, True), ("v2.csv", 4, 5, "z", None, None),
    ]
    assert sorted(map(tuple, faults.collect())) == [
        ("v1.csv", 5, "id", "bad bigint: x"), ("v1.csv", 6, "id", "repeats line 2"), ("v1.csv", 7, "id", "id is empty"),
        ("v2.csv", 3, "borderline", "bad boolean: maybe"), ("v2.csv", 3, "score", "bad double: high"), ("v3.csv", 2, "id", "id is empty"),
    ]


def test_versions_are_united_by_name(spark):
    old = spark.createDataFrame([("7", "a"), ("x", "b")], "ID string, gold string")
    new = spark.createDataFrame([(8, 1, True, "?")], "id int, score int, borderline boolean, more string")
    none = spark.createDataFrame([("c",)], "gold string")
    found = sorted((r.version, r.id, r.gold, r.score, r.borderline, [tuple(f) for f in r.faults]) for r in N.united({"old": old, "new": new, "none": none}, FIELDS).collect() if r.id is not None)
    assert found == [("new", 8, None, 1.0, True, []), ("old", 7, "a", None, False, [])]
    wrong = {r.version: [tuple(f) for f in r.faults] for r in N.united({"old": old, "none": none}, FIELDS).collect() if r.faults}
    assert wrong == {"old": [("id", "bad bigint: x")], "none": [("id", "missing column id")]}
