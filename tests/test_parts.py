"""Tables made in parts hold what those made at once hold, and leave nothing but themselves."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from souk.plans import recompute_queries as R
from souk.plans import scan_queries as Q
from souk.sources import listings as L
from souk.sources import scratch


def plain(df):
    return sorted(str(r.asDict(True)) for r in df.collect())


@pytest.fixture
def again(sf_dir, tmp_path):
    """The same tables under another path: nothing held is used again."""
    os.symlink(sf_dir, tmp_path / "sf")
    return str(tmp_path / "sf")


def left(spark):
    """Shuffle files, and tables in the folder for those, by name without their own part."""
    files = [f for _, _, names in os.walk(spark.conf.get("spark.local.dir")) for f in names if f.startswith("shuffle_")]
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return set(files), set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_parts_hold_all_rows_once(spark, sf_dir, again, monkeypatch):
    monkeypatch.setattr(L, "PART", os.path.getsize(f"{sf_dir}/lineitem.parquet") // 3)
    assert L.parts(spark, again) > 3
    assert plain(L.kept(spark, again)) == plain(L.listings(spark, sf_dir))
    rows = L.kept(spark, again).withColumn("brand_id", F.when(F.col("brand_id") != 4, F.col("brand_id")))
    cut = L.by_brand(rows, 4)
    ids = [r[0] for part in cut for r in part.select("listing_id").collect()]
    assert len(cut) > 2 and sorted(ids) == sorted(r[0] for r in rows.select("listing_id").collect())
    assert len(L.by_brand(rows.filter("brand_id is null"), 4)) == len(L.by_brand(rows.limit(0), 4)) == 1


@pytest.mark.parametrize("name", ["recompute_rank", "recompute_months", "deals_stored", "backtest_outcomes"])
def test_parts_give_the_same(spark, sf_dir, again, monkeypatch, name):
    queries = {**R.QUERIES, **Q.QUERIES}
    whole = plain(queries[name](spark, sf_dir))
    monkeypatch.setattr(L, "PART", os.path.getsize(f"{sf_dir}/lineitem.parquet") // 2)
    assert plain(queries[name](spark, again)) == whole


def test_a_recomputation_leaves_its_tables_alone(spark, again):
    files, tables = left(spark)
    R.wide(spark, again)
    more, now = left(spark)
    assert not more - files  # shuffles ended with the queries that made them
    assert {t.rsplit("-", 1)[0] for t in now - tables} == {"listings", "facts", "wide"}


def test_a_setting_of_the_session_stays(spark):
    spark.conf.set(scratch._CLEANUP, "false")
    try:
        with scratch.tidy(spark):
            assert spark.conf.get(scratch._CLEANUP) == "true"
        assert spark.conf.get(scratch._CLEANUP) == "false"
    finally:
        spark.conf.unset(scratch._CLEANUP)


def test_the_first_batch_is_written_by_all_tasks(spark, sf_dir, monkeypatch):
    """Before, one task wrote each batch; a batch is still taken whole."""
    taken = []
    monkeypatch.setattr(Q.S.Scan, "step", lambda scan, batch, number: taken.append((number, batch.select(F.input_file_name()).distinct().count(), batch.count())))
    rows = R.market(spark, sf_dir)[0]
    monkeypatch.setattr(R, "market", lambda *_: (rows.repartition(3), None))
    Q.scanned(spark, sf_dir)
    assert [n for n, _, _ in taken] == [0, 1, 2] and all(files > 1 for _, files, _ in taken)
    assert [n for _, _, n in taken] == [b.count() for b in Q.observations(rows)]
