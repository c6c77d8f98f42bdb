"""Observations over time: upserts, price history, lifecycle, snapshots."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.exprs import half_even, ratio

#: Fixed values.
CONFIRM_HOURS, OVERLAP_HOURS = 48, 2


def last_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; equal to a sort and dropDuplicates, but ordered
    and without a window's single-key sort: an aggregate combines before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def merge(old: DataFrame, new: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """Upsert. A rule for each column: new (new unless null), keep (old unless
    null), most (the greater), always (the new row's value, null too). Adds change:
    inserted, updated or kept."""
    a, b = old.select(key, *(F.col(c).alias(f"_o_{c}") for c in rules)).withColumn("_old", F.lit(True)), new.select(key, *(F.col(c).alias(f"_n_{c}") for c in rules)).withColumn("_new", F.lit(True))
    o, n = lambda c: F.col(f"_o_{c}"), lambda c: F.col(f"_n_{c}")
    pick = {"new": lambda c: F.coalesce(n(c), o(c)), "keep": lambda c: F.coalesce(o(c), n(c)), "most": lambda c: F.greatest(n(c), o(c)), "always": lambda c: F.when(F.col("_new"), n(c)).otherwise(o(c))}
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").otherwise("updated")
    return a.join(b, key, "full_outer").select(key, *(pick[rule](c).alias(c) for c, rule in rules.items()), change.alias("change"))


def price_history(observed: DataFrame, key: str, at: str, price: str) -> DataFrame:
    """A row when a key is first seen and whenever its price changes."""
    before = F.lag(price).over(Window.partitionBy(key).orderBy(at, price))
    number = F.row_number().over(Window.partitionBy(key).orderBy(at, price))
    return observed.withColumns({"before": before, "_n": number}).filter((F.col("_n") == 1) | ~F.col(price).eqNullSafe(F.col("before"))).drop("_n")


def incremental(rows: DataFrame, at: str, watermark: Column) -> DataFrame:
    """Rows after the watermark less two hours, for what arrives late."""
    return rows.filter(F.col(at) > watermark - F.expr(f"INTERVAL '{OVERLAP_HOURS}' HOUR"))


def lifecycle(status: Column, missing_since: Column, now: Column) -> Column:
    """active -> removed_pending when missing -> removed after 48 hours."""
    confirmed = missing_since <= now - F.expr(f"INTERVAL '{CONFIRM_HOURS}' HOUR")
    return F.when((status == "active") & missing_since.isNotNull() & ~confirmed, "removed_pending").when(status.isin("active", "removed_pending") & confirmed, "removed").otherwise(status)


def snapshots(events: DataFrame) -> DataFrame:
    """A daily snapshot of each watched thing: user_id, day, n, value."""
    return events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value").cast("decimal(24,8)"), 4).alias("value"))


def as_of(watched: DataFrame, history: DataFrame, key: str, when: str, day: str) -> DataFrame:
    """To each watched row the last snapshot on or before its day, else the first
    after. ``history`` isn't windowed: both are aggregates of an equi-join."""
    rest = [c for c in history.columns if c != key]
    joined = watched.join(history, key, "left")
    past, future = F.col(day) <= F.col(when), F.col(day) > F.col(when)
    row = F.struct(*rest)
    out = joined.groupBy(*watched.columns).agg(F.max_by(F.when(past, row), F.when(past, F.col(day))).alias("_before"), F.min_by(F.when(future, row), F.when(future, F.col(day))).alias("_after"))
    chosen = out.withColumn("_row", F.coalesce("_before", "_after"))
    return chosen.select(*watched.columns, *(F.col(f"_row.{c}").alias(c) for c in rest), F.when(F.col("_before").isNotNull(), "before").when(F.col("_after").isNotNull(), "after").alias("side"))


def watch_changes(base: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """What changed from the baseline: difference of counts, ratio of values."""
    current = now.select(key, F.col("n").alias("n_now"), F.col("value").alias("value_now"))
    return base.join(current, key, "left").select(key, "day", "n", "value", "n_now", "value_now", (F.col("n_now") - F.col("n")).alias("n_change"), half_even(ratio(F.col("value_now"), F.nullif("value", F.lit(0))), 4).alias("value_ratio"))


def status_at(at: datetime | Column) -> Column:
    """The status a listing had at a moment; null if it wasn't listed yet."""
    from souk.functions.exprs import moment

    then = moment(at)
    return F.when(F.col("listed_at") > then, None).when((F.col("status") == "sold") & (F.col("sold_at") <= then), "sold").when((F.col("status") == "removed") & (F.col("touched_at") <= then), "removed").otherwise("active")
