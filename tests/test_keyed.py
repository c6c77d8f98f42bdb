"""Keyed state: order within the lateness, rows at the watermark, forgetting."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from souk.streaming import keyed as K

START = datetime(2024, 1, 1, 10)
SCHEMA = "k string, at timestamp_ntz, price double, note string"


def told(spark, tmp_path, batches, **how):
    for i, rows in enumerate(batches):
        rows = [(k, START + timedelta(seconds=s) if s is not None else None, p, "x") for k, s, p in rows]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/in")
    out, held = K.drained(K.price_changes(stream, "k", "at", "price", **how), str(tmp_path / "work"))
    rows = [((r["at"] - START).total_seconds(), r["k"], r["price"], r["before"]) for r in out.collect()]
    return sorted(rows, key=str), held


def test_rows_out_of_order_are_told_in_order(spark, tmp_path):
    batches = [[("a", 30, 3.0), ("a", 10, 1.0)], [("a", 20, 2.0)], [("a", 40, 3.0), ("b", 500, 9.0)]]
    rows, _ = told(spark, tmp_path, batches, late="1 minute")
    assert rows == sorted([(10.0, "a", 1.0, None), (20.0, "a", 2.0, 1.0), (30.0, "a", 3.0, 2.0)], key=str)


def test_rows_up_to_the_watermark_are_told_and_later_ones_wait(spark, tmp_path):
    batches = [[("a", 0, 1.0), ("a", 0.001, 2.0), ("b", 60, 9.0)]]
    rows, held = told(spark, tmp_path, batches, late="1 minute")
    assert rows == [(0.0, "a", 1.0, None)]
    assert held["rows"] > 0


def test_rows_later_than_allowed_are_dropped_and_nulls_tell_nothing(spark, tmp_path):
    batches = [[("a", 0, 1.0), (None, 0, 1.0), ("a", None, 7.0), ("a", 1, None), ("b", 300, 9.0)], [("b", 301, 9.0)], [("a", 2, 5.0), ("a", 310, 4.0)], [("c", 900, 1.0)]]
    rows, _ = told(spark, tmp_path, batches, late="1 minute")
    assert rows == sorted([(0.0, "a", 1.0, None), (310.0, "a", 4.0, 1.0), (300.0, "b", 9.0, None)], key=str)


def test_rows_of_one_moment_go_by_price_and_repeats_are_silent(spark, tmp_path):
    batches = [[("a", 5, 2.0), ("a", 5, 1.0), ("a", 5, 2.0), ("a", 5, 1.0)], [("a", 6, 2.0), ("b", 300, 1.0)]]
    rows, _ = told(spark, tmp_path, batches, late="1 minute")
    assert rows == [(5.0, "a", 1.0, None), (5.0, "a", 2.0, 1.0)]


@pytest.mark.parametrize("cut", [1, 3])
def test_silent_keys_are_forgotten_wherever_batches_are_cut(spark, tmp_path, cut):
    day = 86_400
    rows = [(f"k{i}", i, 1.0) for i in range(20)] + [("z", 2 * day, 1.0), ("z", 2 * day + 200, 2.0), ("k0", 2 * day + 300, 1.0), ("z", 9 * day, 3.0), ("y", 10 * day, 1.0)]
    batches = [rows] if cut == 1 else [rows[:20], rows[20:23], rows[23:24], rows[24:]]
    found, held = told(spark, tmp_path, batches, late="1 minute", forget_days=1)
    want = [(float(i), f"k{i}", 1.0, None) for i in range(20)]
    want += [(2.0 * day, "z", 1.0, None), (2.0 * day + 200, "z", 2.0, 1.0), (2.0 * day + 300, "k0", 1.0, None), (9.0 * day, "z", 3.0, None)]
    assert found == sorted(want, key=str)
    if cut == 3:
        assert held["rows"] < 10 < 20 < held["most"]


def test_an_empty_table_tells_nothing(spark, tmp_path):
    assert told(spark, tmp_path, [[]])[0] == []
