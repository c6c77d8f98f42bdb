"""Bookkeeping of model groups: parents, inherited ids, retirement, deltas, reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.exprs import half_up, moment, ratio

#: Share of a group's listings that carries its id over; days until a
#: retired group goes; listings of a bulk seller; age at which raw payloads go.
INHERIT, RETIRE_DAYS, BULK, RAW_DAYS = 0.5, 90, 1000, 90


def kind(slug: Column, product_type: Column) -> Column:
    """review, none, collab, descriptor or model."""
    return F.when(product_type == "review", "review").when(slug == "_none", "none").when(slug.startswith("_collab-"), "collab").when(slug.startswith("_"), "descriptor").otherwise("model")


def partner(slug: Column) -> Column:
    return F.nullif(F.regexp_extract(slug, "^_collab-(.*)$", 1), F.lit(""))


def parents(phrases: DataFrame, lines: DataFrame, by: str, modifiers: tuple[str, ...] = ()) -> DataFrame:
    """The longest line that starts a phrase, after leading modifiers: an equi-join
    on the phrase's own runs, so lines are never compared with all phrases."""
    tokens = F.split("phrase", " ")
    skip = F.array(*map(F.lit, modifiers)) if modifiers else F.array().cast("array<string>")
    leading = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.forall(F.slice(tokens, 1, i), lambda t: F.array_contains(skip, t))), lambda x: x))
    starts = F.explode(F.sequence(F.lit(0), F.least(leading, F.size(tokens) - 1)))
    runs = phrases.select(by, "phrase", F.size(tokens).alias("n"), tokens.alias("tokens"), starts.alias("start")).filter("n > 1")
    runs = runs.withColumn("size", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).filter(F.col("start") + F.col("size") <= F.col("n"))
    runs = runs.withColumn("line", F.array_join(F.slice("tokens", F.col("start") + 1, F.col("size")), " "))
    found = runs.join(lines.select(by, "line"), [by, "line"])
    return found.groupBy(by, "phrase").agg(F.max_by("line", F.struct("size", "start")).alias("parent"))


def inherit(moved: DataFrame, share: float = INHERIT) -> DataFrame:
    """``moved``: listing_id, old, new. New groups that take at least that share of
    an old group's listings keep its id, one to one: each side's best choice."""
    pairs = moved.filter("old is not null and new is not null").groupBy("old", "new").agg(F.count("*").alias("n"))
    whole = moved.filter("old is not null").groupBy("old").agg(F.count("*").alias("whole"))
    good = pairs.join(whole, "old").filter(F.col("n") >= share * F.col("whole"))
    first = lambda side, other: F.row_number().over(Window.partitionBy(side).orderBy(F.desc("n"), other))
    return good.withColumns({"a": first("old", "new"), "b": first("new", "old")}).filter("a = 1 and b = 1").select("old", "new", "n")


def settle(groups: DataFrame, used: DataFrame, now: datetime) -> DataFrame:
    """Derived groups without listings retire now, revive when used again, and go
    after 90 days. ``groups``: group_id, derived, retired_at; ``used``: group_id."""
    joined = groups.join(used.select("group_id", F.lit(True).alias("_used")).distinct(), "group_id", "left")
    at = F.when(F.col("_used") | ~F.col("derived"), None).otherwise(F.coalesce("retired_at", moment(now)))
    out = joined.withColumn("retired_at", at).drop("_used")
    return out.filter(F.col("retired_at").isNull() | (F.col("retired_at") > moment(now) - F.expr(f"INTERVAL '{RETIRE_DAYS}' DAY")))


def input_hash(*columns: str) -> Column:
    """What a placement depends on; a listing is placed anew when it changes."""
    return F.sha2(F.concat_ws(chr(31), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def rules_hash(rules: DataFrame) -> DataFrame:
    """One hash of all rules, in any order: the rows' hashes are added up, so
    nothing is gathered in one row."""
    row = F.xxhash64(*rules.columns)
    return rules.agg(F.count("*").alias("n"), F.bit_xor(row).alias("mixed"), F.sum(F.pmod(row, F.lit(1_000_003))).alias("added")).select(F.sha2(F.concat_ws(":", "n", "mixed", "added"), 256).alias("rules_hash"))


def changed(rows: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value is new or differs."""
    return rows.join(before.select(key, F.col(value).alias("_before")), key, "left").filter(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def purge(rows: DataFrame, seen: str, raw: str, now: datetime, days: int = RAW_DAYS) -> DataFrame:
    """Raw payloads unseen for so long become empty; the rest of the row stays."""
    return rows.withColumn(raw, F.when(F.col(seen) < moment(now) - F.expr(f"INTERVAL '{days}' DAY"), "{}").otherwise(F.col(raw)))


def examples(listings: DataFrame, by: list[str], text: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` texts of each group in an order, as one string; Spark limits
    each group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    few = listings.withColumn("_n", place).filter(F.col("_n") <= n)
    return few.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(text).cast("string").alias("t")))), lambda x: x["t"]), " | ").alias("examples"))


def bulk_sellers(listings: DataFrame, least: int = BULK) -> DataFrame:
    """How many sellers have much stock, and their share of all listings."""
    per = listings.groupBy("seller").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("sellers"), F.count_if(F.col("n") >= least).alias("bulk"), half_up(ratio(F.sum(F.when(F.col("n") >= least, F.col("n")).otherwise(0)), F.sum("n")), 6).alias("share"))


def month_card(months: DataFrame, last: str, n: int = 12) -> DataFrame:
    """A row for each scope and each of its last ``n`` months, quiet ones too, with
    the sales of each condition as columns."""
    end = F.lit(last).cast("date")
    grid = months.select("scope_key").distinct().withColumn("month", F.explode(F.sequence(F.add_months(end, 1 - n), end, F.expr("INTERVAL '1' MONTH"))))
    wide = months.groupBy("scope_key", "month").pivot("bucket", ["all", "new", "used"]).agg(F.first("n"))
    return grid.join(wide, ["scope_key", "month"], "left").na.fill(0, ["all", "new", "used"])
