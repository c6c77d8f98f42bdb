"""Month statistics, season profiles and what follows from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.exprs import AS_OF, half_up, moment, month_of, quantile, ratio
from souk.operators.scopes import sale_price

#: Sales that a season needs, weight of the parent when mixing.
SEASON_MINIMUM, BLEND_PRIOR, PRESET = 50, 300, 1.15
SEASONS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11)}


def sales(listings: DataFrame, at: datetime = AS_OF) -> DataFrame:
    return listings.filter((F.col("status") == "sold") & (F.col("sold_at") <= moment(at))).withColumn("month", month_of(F.col("sold_at")))


def month_stats(scoped: DataFrame, at: datetime = AS_OF) -> DataFrame:
    """Sales, turnover and quartiles by scope, month and condition bucket."""
    bucket = F.explode(F.array(F.lit("all"), F.when(F.col("condition") == "is_new", "new").otherwise("used")))
    return sales(scoped, at).withColumn("bucket", bucket).groupBy("scope_key", "month", "bucket").agg(F.count("*").alias("n"), F.sum(sale_price()).cast("decimal(18,2)").alias("gmv"), *(quantile(sale_price(), q).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)))


def period_totals(months: DataFrame, first: str, last: str) -> DataFrame:
    """Of a month range, by scope: sales, and the mean of the monthly medians
    weighted by sales."""
    some = months.filter((F.col("bucket") == "all") & F.col("month").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    weight = F.when(F.col("p50").isNotNull(), F.col("n"))
    return some.groupBy("scope_key").agg(F.sum("n").alias("sold"), half_up(F.try_divide(F.sum(F.col("p50").cast("double") * weight), F.sum(weight)), 2).alias("price"))


def month_range(first: Column, last: Column) -> Column:
    """The months from first to last; none if they are the wrong way round."""
    return F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL '1' MONTH"))).otherwise(F.array().cast("array<date>"))


def covered_months(sold: DataFrame, at: datetime = AS_OF) -> DataFrame:
    """Of each brand, the whole months between that of its first sale and the
    running one: brand_id, month."""
    first = sold.groupBy("brand_id").agg(F.min("month").alias("first"))
    last = F.add_months(F.trunc(F.lit(at.date()), "MM"), -1)
    return first.select("brand_id", F.explode(month_range(F.add_months("first", 1), last)).alias("month"))


def month_coverage(sold: DataFrame, first: str, last: str) -> DataFrame:
    """For each month of a range: brands with sales then, brands not yet seen."""
    months = sold.sparkSession.range(1).select(F.explode(month_range(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("month"))
    start = sold.groupBy("brand_id").agg(F.min("month").alias("first"))
    seen = sold.select("brand_id", "month").distinct().groupBy("month").agg(F.count("*").alias("brands"))
    late = F.broadcast(months).join(start, F.col("first") > F.col("month")).groupBy("month").agg(F.count("*").alias("late"))
    return months.join(seen, "month", "left").join(late, "month", "left").select("month", F.coalesce("brands", F.lit(0)).alias("brands"), F.coalesce("late", F.lit(0)).alias("late"))


def grouped_months(sold: DataFrame, covered: DataFrame) -> DataFrame:
    """Month counts of the market, of types, of types by department and of types
    by brand, in one pass: kind, key, month, n."""
    inside = sold.join(covered, ["brand_id", "month"], "left_semi")
    sets = inside.groupingSets([["month"], ["product_type", "month"], ["product_type", "department", "month"], ["product_type", "brand_id", "month"]], "product_type", "department", "brand_id", "month").agg(F.count("*").alias("n"), *(F.grouping(c).alias(f"_{c}") for c in ("product_type", "department", "brand_id")))
    sets = sets.withColumn("g", 4 * F.col("_product_type") + 2 * F.col("_department") + F.col("_brand_id"))
    kind = F.when(F.col("g") == 7, "market").when(F.col("g") == 3, "type").when(F.col("g") == 1, "department").otherwise("brand")
    key = F.when(F.col("g") == 7, "market").otherwise(F.concat_ws(":", "product_type", "department", F.col("brand_id").cast("string")))
    return sets.select(kind.alias("kind"), key.alias("key"), "product_type", "month", "n")


def profiles(counts: DataFrame, months: DataFrame) -> DataFrame:
    """For each key and calendar month: mean sales over the covered months, the
    index over the key's own mean (si_abs) and over the market's share (si_rel)."""
    grid = counts.select("kind", "key").distinct().join(F.broadcast(months.select("month").distinct()))
    dense = grid.join(counts.select("kind", "key", "month", "n"), ["kind", "key", "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mean = dense.groupBy("kind", "key", F.month("month").alias("calendar")).agg(F.avg("n").alias("mean"), F.sum("n").alias("sales"))
    own = Window.partitionBy("kind", "key")
    share = F.try_divide(F.col("mean"), F.sum("mean").over(own))
    out = mean.withColumns({"si_abs": F.try_divide(F.col("mean"), F.avg("mean").over(own)), "_share": share})
    market = out.filter("kind = 'market'").select("calendar", F.col("_share").alias("_market"))
    return out.join(F.broadcast(market), "calendar").select("kind", "key", "calendar", "sales", half_up(F.col("mean"), 4).alias("mean"), half_up(F.col("si_abs"), 4).alias("si_abs"), half_up(F.try_divide("_share", "_market"), 4).alias("si_rel"))


def season_of(calendar: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        out = F.when(calendar.isin(*months), name).otherwise(out)
    return out


def seasons(profile: DataFrame, minimum: int = SEASON_MINIMUM) -> DataFrame:
    """Three months each: sales, mean index; none below the least sales."""
    by = profile.groupBy("kind", "key", season_of(F.col("calendar")).alias("season")).agg(F.sum("sales").alias("sales"), F.avg("si_abs").alias("index"))
    return by.select("kind", "key", "season", "sales", F.when(F.col("sales") >= minimum, half_up(F.col("index"), 4)).alias("index"))


def presets(season_rows: DataFrame, minimum: float = PRESET) -> DataFrame:
    """Types whose season is strong, best first."""
    strong = season_rows.filter((F.col("kind") == "type") & (F.col("index") >= minimum))
    place = F.row_number().over(Window.partitionBy("season").orderBy(F.desc("index"), "key"))
    return strong.select("season", "key", "index", place.alias("place"))


def pearson(x: str, y: str) -> Column:
    """Null where a side has no spread."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def year_over_year(counts: DataFrame, months: DataFrame) -> DataFrame:
    """Correlation of a key's last twelve covered months with the twelve before."""
    recent = months.select("month").distinct().orderBy(F.desc("month")).limit(24)
    order = recent.withColumn("back", F.row_number().over(Window.orderBy(F.desc("month"))) - 1)  # of 24 rows
    grid = counts.select("kind", "key").distinct().join(F.broadcast(order))
    dense = grid.join(counts.select("kind", "key", "month", "n"), ["kind", "key", "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    pairs = dense.groupBy("kind", "key", (F.col("back") % 12).alias("slot")).agg(F.max(F.when(F.col("back") < 12, F.col("n"))).alias("new"), F.max(F.when(F.col("back") >= 12, F.col("n"))).alias("old"))
    return pairs.groupBy("kind", "key").agg(F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull()).alias("slots"), half_up(pearson("new", "old"), 4).alias("stability")).select("kind", "key", F.when(F.col("slots") == 12, F.col("stability")).alias("stability"))


def blend(profile: DataFrame) -> DataFrame:
    """Brand profiles mixed with their type's: w = n / (n + 300) of own."""
    own = profile.filter("kind = 'brand'").withColumn("n", F.sum("sales").over(Window.partitionBy("key")))
    parent = profile.filter("kind = 'type'").select(F.col("key").alias("parent"), "calendar", F.col("si_abs").alias("parent_index"))
    w = F.col("n") / (F.col("n") + F.lit(float(BLEND_PRIOR)))
    mixed = w * F.coalesce(F.col("si_abs").cast("double"), F.lit(0.0)) + (1 - w) * F.col("parent_index").cast("double")
    return own.withColumn("parent", F.split("key", ":")[0]).join(parent, ["parent", "calendar"]).select("key", "calendar", half_up(mixed, 4).alias("si_abs"))


def forecast(profile: DataFrame, sold: DataFrame, target: int, at: datetime = AS_OF) -> DataFrame:
    """Sales of 30 days scaled by the season's level in the target month over
    now's; key, sold_30d, forecast."""
    level = profile.filter("kind = 'type'").groupBy("key").agg(F.max(F.when(F.col("calendar") == at.month, F.col("si_abs"))).alias("now"), F.max(F.when(F.col("calendar") == target, F.col("si_abs"))).alias("then"))
    recent = sold.filter(F.col("sold_at") >= moment(at) - F.expr("INTERVAL '30' DAY")).groupBy(F.col("product_type").alias("key")).agg(F.count("*").alias("sold_30d"))
    return level.join(recent, "key").select("key", "sold_30d", half_up(F.col("sold_30d") * ratio(F.col("then"), F.nullif("now", F.lit(0))), 2).alias("forecast"))


def packed(profile: DataFrame, season_rows: DataFrame) -> DataFrame:
    """A row a key: kind, key, months (array of month, sales, si_abs, si_rel in their order),
    seasons (map of name to sales and index, null where there are too few), sales_year."""
    point = F.struct(F.col("calendar").alias("month"), "sales", "si_abs", "si_rel")
    months = profile.groupBy("kind", "key").agg(F.array_sort(F.collect_list(point)).alias("months"), F.sum("sales").alias("sales_year"))  # twelve a key
    of = F.when(F.col("index").isNotNull(), F.struct("sales", "index"))
    by = season_rows.groupBy("kind", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("season", of.alias("of"))))).alias("seasons"))  # four a key
    return months.join(by, ["kind", "key"], "left").select("kind", "key", "months", "seasons", "sales_year")


def by_month(months: Column) -> Column:
    """Twelve indices, January first, from an array of month and si_abs; a month that is missing
    or out of range is null, and of a repeated one the last that isn't null counts."""

    def of(month: Column) -> Column:
        hits = F.filter(months, lambda p: (p["month"] == month) & p["si_abs"].isNotNull())
        return F.try_element_at(hits, F.lit(-1))["si_abs"].cast("double")

    return F.transform(F.sequence(F.lit(1), F.lit(12)), of)


def overlay(wanted: DataFrame, profiles: DataFrame) -> DataFrame:
    """To each distinct (product_type, department) the profile of that type's department, else of
    the type: product_type, department, profile_key, levels. ``profiles``: kind, key (type, or
    type and department joined by a colon), months."""
    rows = wanted.select("product_type", "department").distinct().filter("product_type is not null")
    known = profiles.select("kind", F.col("key").alias("profile_key"), by_month(F.col("months")).alias("levels"))
    own = known.filter("kind = 'department'").select("profile_key", F.col("levels").alias("_own"))
    whole = known.filter("kind = 'type'").select(F.col("profile_key").alias("product_type"), F.col("levels").alias("_whole"))
    key = F.when(F.col("department").isNotNull(), F.concat_ws(":", "product_type", "department"))
    both = rows.withColumn("profile_key", key).join(own, "profile_key", "left").join(whole, "product_type", "left")
    found = both.filter("_own is not null or _whole is not null")
    return found.select("product_type", "department", F.when(F.col("_own").isNotNull(), F.col("profile_key")).otherwise(F.col("product_type")).alias("profile_key"), F.coalesce("_own", "_whole").alias("levels"))
