"""The sheet sink: what files hold, retried tasks, aborted writes."""

from __future__ import annotations

import pytest
from pyspark.sql import Row

from souk.operators import reconcile as N
from souk.sources.sheet import SheetSink, SheetWriter


def files(folder):
    return sorted(p.name for p in folder.iterdir())


def test_a_file_is_what_spreadsheets_read(spark, tmp_path):
    spark.dataSource.register(SheetSink)
    rows = spark.createDataFrame([("1", 'a "b", c'), ("2", None), ("3", "x\r\ny")], "id string, text string").coalesce(1)
    save = lambda df, mode: df.write.format("souk_sheet").option("path", f"file://{tmp_path}/out").mode(mode).save()
    save(rows, "append")
    out = tmp_path / "out"
    (only,) = out.iterdir()
    assert only.read_bytes() == b'\xef\xbb\xbfid,text\r\n1,"a ""b"", c"\r\n2,\r\n3,"x\r\ny"\r\n'
    save(rows.repartition(2), "append")
    read = lambda: sorted((r.cells["id"], r.cells["text"]) for r in N.sheets(spark, f"file://{out}/*.csv").collect())
    assert len(read()) == 6 and len(set(read())) == 3
    save(rows.filter("id = '1'"), "overwrite")
    assert read() == [("1", 'a "b", c')] and all(n.startswith("sheet-") for n in files(out))
    with pytest.raises(Exception, match="text alone"):
        save(spark.range(1), "append")


def test_retried_tasks_leave_one_copy(tmp_path, monkeypatch):
    monkeypatch.setattr("souk.sources.sheet.CHUNK", 2)
    writer = SheetWriter(f"file://{tmp_path}", ["id"], False)
    rows = [Row(id=str(i)) for i in range(5)]
    lost, kept, empty = writer.write(iter(rows)), writer.write(iter(rows)), writer.write(iter([]))
    assert lost.name != kept.name and empty.name is None and kept.rows == 5

    def broken():
        yield rows[0]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    writer.commit([kept, empty])
    assert files(tmp_path) == ["sheet-000001-000000.csv"]
    assert (tmp_path / "sheet-000001-000000.csv").read_bytes() == b"\xef\xbb\xbfid\r\n0\r\n1\r\n2\r\n3\r\n4\r\n"


def test_an_aborted_write_leaves_what_was_there(tmp_path):
    first = SheetWriter(f"file://{tmp_path}", ["id"], False)
    first.commit([first.write(iter([Row(id="1")]))])
    second = SheetWriter(f"file://{tmp_path}", ["id"], True)
    second.write(iter([Row(id="2")]))
    second.abort([None])
    assert files(tmp_path) == ["sheet-000001-000000.csv"] and b"1\r\n" in (tmp_path / "sheet-000001-000000.csv").read_bytes()
