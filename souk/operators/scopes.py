"""Aggregates over scopes: a brand, a type in a brand, a line and a model.

Every function takes listings, or listings fanned out to their scopes, and an
explicit moment; none reads the clock.
"""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.exprs import AS_OF, ago, between_ages, elapsed_days, half_even, half_up, moment, only, quantile, ratio, share, within

#: Fixed values.
WEEKS, VARIANTS, HOT_COHORT = 12, 12, 10
PERIODS = (7, 14, 30, 60, 90, 180, 365)
OUTLIER_SALES, OUTLIER_DAYS, OUTLIER_K, MAD_SCALE = 8, 90, 4.0, 1.4826
ENOUGH_PRICES = 5
P30_DAYS, COHORT_YOUNG, COHORT_OLD, PRIOR = 30, 30, 120, 20
WHOLESALE_STOCK, WHOLESALE_SHARE, WHOLESALE_DAYS, FRESH_DAYS = 200, 0.01, 365, 60


def sale_price() -> Column:
    """A sold price of zero falls back to the price asked."""
    return F.coalesce(F.nullif("sold_price", F.lit(0).cast("decimal(14,2)")), F.col("price"))


def fan_out(listings: DataFrame) -> DataFrame:
    """Each listing once for each scope it belongs to: level, scope_key. A column
    ``only_levels`` names the levels that are wanted of a row, where not all are."""
    key = lambda level, *parts: F.struct(F.lit(level).alias("level"), F.concat_ws(":", F.lit(level), *parts).alias("scope_key"))
    scopes = F.array(key("brand", "brand_id"), key("type", "brand_id", "product_type"), key("line", "brand_id", "product_type", "line"), key("model", "brand_id", "product_type", "model"))
    if "only_levels" in listings.columns:
        scopes = F.filter(scopes, lambda s: F.array_contains("only_levels", s["level"]))
    return listings.withColumn("_s", F.explode(scopes)).select("*", "_s.level", "_s.scope_key").drop("_s")


def sold(at: datetime, days: int) -> Column:
    return (F.col("status") == "sold") & within(F.col("sold_at"), at, days)


def days_to_sell() -> Column:
    return elapsed_days(F.col("listed_at"), F.col("sold_at"))


def window_counts(scoped: DataFrame, at: datetime = AS_OF) -> DataFrame:
    """sold_7d, sold_30d, sold_prev_30d, sold_90d, active_now, by scope."""
    return scoped.groupBy("level", "scope_key").agg(
        F.count_if(sold(at, 7)).alias("sold_7d"),
        F.count_if(sold(at, 30)).alias("sold_30d"),
        F.count_if((F.col("status") == "sold") & between_ages(F.col("sold_at"), at, 30, 60)).alias("sold_prev_30d"),
        F.count_if(sold(at, 90)).alias("sold_90d"),
        F.count_if(F.col("status") == "active").alias("active_now"),
        F.count_if((F.col("status") == "active") & (F.col("listed_at") >= ago(at, 14))).alias("new_14d"),
    )


def medians(scoped: DataFrame, at: datetime = AS_OF) -> DataFrame:
    """Median price, days to sell and likes of the sales of 30 and 90 days."""
    recent, quarter = sold(at, 30), sold(at, 90)
    sales = scoped.filter(quarter).groupBy("level", "scope_key").agg(
        quantile(only(recent, sale_price())).alias("median_price_30d"),
        quantile(sale_price()).alias("median_price_90d"),
        quantile(only(F.col("exact_sale"), days_to_sell())).alias("median_days_to_sell"),
        quantile(F.col("likes"), places=1).alias("median_likes"),
    )
    return scoped.select("level", "scope_key").distinct().join(sales, ["level", "scope_key"], "left")


def weekly_series(scoped: DataFrame, at: datetime = AS_OF) -> DataFrame:
    """scope_key, week (0 oldest .. 11 newest), n, median_price; weeks without a
    sale have n = 0 and no price."""
    age = F.floor(F.timestamp_diff("SECOND", F.col("sold_at"), moment(at)) / F.lit(86400.0 * 7)).cast("int")
    sales = scoped.filter((F.col("status") == "sold") & (F.col("sold_at") <= moment(at)) & (F.col("sold_at") > ago(at, 7 * WEEKS)))
    seen = sales.withColumn("week", F.lit(WEEKS - 1) - age).groupBy("scope_key", "week").agg(F.count("*").alias("n"), quantile(sale_price()).alias("median_price"))
    dense = seen.select("scope_key").distinct().withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(WEEKS - 1))))
    return dense.join(seen, ["scope_key", "week"], "left").select("scope_key", "week", F.coalesce("n", F.lit(0)).alias("n"), "median_price")


def period_windows(scoped: DataFrame, at: datetime = AS_OF) -> DataFrame:
    """A row for each period in which a scope has a sale: sold, price, days, likes."""
    sales = scoped.filter(sold(at, max(PERIODS)))
    periods = F.filter(F.array(*map(F.lit, PERIODS)), lambda p: F.timestamp_diff("SECOND", F.col("sold_at"), moment(at)) <= p * 86400)
    return sales.withColumn("period", F.explode(periods)).groupBy("scope_key", "period").agg(
        F.count("*").alias("sold"), quantile(sale_price()).alias("median_price"), quantile(only(F.col("exact_sale"), days_to_sell())).alias("median_days"), quantile(F.col("likes"), places=1).alias("median_likes")
    )


def clean_variant(value: Column) -> Column:
    """Lower-cased, blanks collapsed, "grey" as "gray", placeholders null."""
    folded = F.lower(F.trim(F.regexp_replace(value.cast("string"), r"\s+", " ")))
    return F.when(folded.isin("", "n/a", "na", "none", "unknown"), None).when(folded == "grey", "gray").otherwise(folded)


def variants(scoped: DataFrame, attribute: str, at: datetime = AS_OF, limit: int = VARIANTS) -> DataFrame:
    """Each scope's first ``limit`` values of an attribute by sales of 90 days."""
    counted = scoped.withColumn("variant", clean_variant(F.col(attribute))).filter("variant is not null").groupBy("scope_key", "variant").agg(F.count_if(sold(at, 90)).alias("sold_90d"), F.count_if(F.col("status") == "active").alias("active"))
    counted = counted.filter("sold_90d + active > 0").withColumn("sell_through", half_even(ratio(F.col("sold_90d"), F.col("sold_90d") + F.col("active")), 4))
    order = Window.partitionBy("scope_key").orderBy(F.desc("sold_90d"), F.desc("sell_through"), "variant")
    return counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def p30_counts(scoped: DataFrame, *more: str, at: datetime = AS_OF) -> DataFrame:
    """Listings of the cohort (30 to 120 days old) and those sold within 30 days."""
    cohort = (F.col("listed_at") <= ago(at, COHORT_YOUNG)) & (F.col("listed_at") >= ago(at, COHORT_OLD))
    quick = (F.col("status") == "sold") & (F.col("sold_at") <= moment(at)) & (F.col("sold_at") <= F.col("listed_at") + F.expr(f"INTERVAL '{P30_DAYS}' DAY"))
    return scoped.groupBy("level", "scope_key", *more).agg(F.count_if(cohort).alias("p30_cohort"), F.count_if(cohort & quick).alias("p30_sold"))


def hot_sizes(scoped: DataFrame, at: datetime = AS_OF) -> DataFrame:
    """P30 of each size of a scope; hot: enough listings and no worse than the scope."""
    own = p30_counts(scoped, "size", at=at).filter("p30_cohort > 0").withColumn("p30", share(F.col("p30_sold"), F.col("p30_cohort")))
    whole = p30_counts(scoped, at=at).select("scope_key", share(F.col("p30_sold"), F.col("p30_cohort")).alias("scope_p30"))
    return own.join(whole, "scope_key").select("scope_key", "size", "p30_cohort", "p30_sold", "p30", "scope_p30", ((F.col("p30_cohort") >= HOT_COHORT) & (F.col("p30") >= F.col("scope_p30"))).alias("hot"))


def majority(scoped: DataFrame, attribute: str) -> DataFrame:
    """The most frequent value of each scope, the smallest on a tie."""
    counted = scoped.filter(F.col(attribute).isNotNull()).groupBy("scope_key", attribute).agg(F.count("*").alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col(attribute).alias("value"))).alias("first")
    return counted.groupBy("scope_key").agg(first).select("scope_key", F.col("first.value").alias(attribute), (-F.col("first.n")).alias("n"))


def outliers(scoped: DataFrame, at: datetime = AS_OF) -> DataFrame:
    """Sales of 90 days whose log price is too far from their scope's median.

    Medians are joined back instead of a window, so a scope's rows needn't be in
    one task.
    """
    sales = scoped.filter(sold(at, OUTLIER_DAYS) & (sale_price() > 0)).select("scope_key", "listing_id", F.ln(sale_price().cast("double")).alias("log_price"))
    centre = sales.groupBy("scope_key").agg(F.count("*").alias("n"), F.percentile("log_price", F.lit(0.5)).alias("centre")).filter(F.col("n") >= OUTLIER_SALES)
    off = sales.join(centre, "scope_key").withColumn("off", F.abs(F.col("log_price") - F.col("centre")))
    mad = off.groupBy("scope_key").agg(F.percentile("off", F.lit(0.5)).alias("mad"))
    limit = F.greatest(F.lit(OUTLIER_K * MAD_SCALE) * F.col("mad"), F.lit(math.log(3)))
    return off.join(mad, "scope_key").filter(F.col("off") > limit).select("scope_key", "listing_id")


def pricing(scoped: DataFrame, at: datetime = AS_OF) -> DataFrame:
    """Prices of the sales of 90 days and of fresh asks, for all, new and used."""
    bucket = F.when(F.col("condition") == "is_new", "new").otherwise("used")
    sale = sold(at, 90)
    ask = (F.col("status") == "active") & (F.col("listed_at") <= moment(at)) & (F.col("listed_at") >= ago(at, FRESH_DAYS))
    enough = lambda n, value: F.when(F.col(n) >= ENOUGH_PRICES, value)
    offer = 1 - ratio(F.col("sold_price"), F.col("price"))
    markdown = 1 - ratio(sale_price(), F.col("price_initial"))
    rows = scoped.filter(sale | ask).withColumn("bucket", F.explode(F.array(F.lit("all"), bucket)))
    out = rows.groupBy("level", "scope_key", "bucket").agg(
        F.count_if(sale).alias("n"),
        F.sum(only(sale, sale_price())).cast("decimal(18,2)").alias("gmv"),
        *(quantile(only(sale, sale_price()), q).alias(f"p{int(100 * q)}") for q in (0.25, 0.5, 0.75)),
        quantile(only(sale, offer), places=4).alias("offer_discount"),
        quantile(only(sale, markdown), places=4).alias("total_markdown"),
        F.count_if(ask).alias("asks"),
        quantile(only(ask, F.col("price"))).alias("ask_p50"),
    )
    for name in ("p25", "p50", "p75", "offer_discount", "total_markdown"):
        out = out.withColumn(name, enough("n", F.col(name)))
    out = out.withColumn("ask_p50", enough("asks", F.col("ask_p50")))
    return out.withColumn("premium", half_up(ratio(F.col("ask_p50"), F.col("p50")) - 1, 4))


def wholesalers(listings: DataFrame, at: datetime = AS_OF, stock: int = WHOLESALE_STOCK) -> DataFrame:
    """Sellers of a brand with much stock that hardly sells: brand_id, seller."""
    year = F.count_if(sold(at, WHOLESALE_DAYS))
    return listings.groupBy("brand_id", "seller").agg(F.count_if(F.col("status") == "active").alias("active"), year.alias("sold_365")).filter((F.col("active") >= stock) & (F.col("sold_365") < WHOLESALE_SHARE * (F.col("sold_365") + F.col("active"))))


def supply(scoped: DataFrame, dormant: DataFrame, at: datetime = AS_OF) -> DataFrame:
    """active, effective (not of a dormant wholesaler) and fresh listings."""
    rows = scoped.filter("status = 'active'").join(dormant.select("brand_id", "seller", F.lit(True).alias("dormant")), ["brand_id", "seller"], "left")
    effective = F.col("dormant").isNull()
    fresh = effective & (F.greatest("listed_at", "touched_at") >= ago(at, FRESH_DAYS))
    return rows.groupBy("level", "scope_key").agg(F.count("*").alias("active"), F.count_if(effective).alias("effective"), F.count_if(fresh).alias("fresh"))


def trends(scoped: DataFrame, at: datetime = AS_OF) -> DataFrame:
    """growth (of 30 days over the 30 before), sell_through_30d, sold a day."""
    counts = window_counts(scoped, at)
    return counts.select(
        "level", "scope_key",
        half_up(ratio(F.col("sold_30d") - F.col("sold_prev_30d"), F.nullif("sold_prev_30d", F.lit(0))), 4).alias("growth"),
        half_even(ratio(F.col("sold_30d"), F.col("sold_30d") + F.col("active_now")), 6).alias("sell_through_30d"),
        half_up(F.col("sold_90d") / F.lit(90.0), 4).alias("sold_a_day"),
    )
