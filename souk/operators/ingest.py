"""Raw hits to typed listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.text import clean

#: Coverage of a scan that counts as complete, as partial.
COMPLETE, PARTIAL = 0.98, 0.70


def money(value: Column) -> Column:
    """Two places, half up; null if it is no number."""
    return F.round(value.cast("string").try_cast("decimal(38,10)"), 2).cast("decimal(14,2)")


def timestamp(value: Column) -> Column:
    """ISO text, or seconds or milliseconds since the epoch (over 1e11); else null."""
    number = value.try_cast("double")
    seconds = F.when(F.abs(number) > 1e11, number / 1000).otherwise(number)
    return F.when(number.isNotNull(), F.when(number > 0, F.timestamp_seconds(seconds))).otherwise(F.try_to_timestamp(value))


def flag(value: Column) -> Column:
    """Truthy, falsy, or neither."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("1", "true", "yes"), True).when(text.isin("0", "false", "no"), False)


def rating(value: Column) -> Column:
    number = value.cast("string").try_cast("decimal(10,3)")
    return F.when(number.between(0, 5), number)


def price_drops(path: Column) -> Column:
    """How often the price strictly fell along its path."""
    return F.when(F.size(path) < 2, F.lit(0)).otherwise(F.size(F.filter(F.arrays_zip(path.alias("a"), F.slice(path, 2, F.greatest(F.size(path), F.lit(1))).alias("b")), lambda p: p["1"] < p["0"])))


def first_of(payload: Column, *paths: str) -> Column:
    """The first path of a JSON text that isn't empty."""
    return F.coalesce(*(F.nullif(F.get_json_object(payload, p), F.lit("")) for p in paths))


def normalize(hits: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(typed listings, rejected rows with their reasons) of raw JSON hits."""
    raw = F.col(payload)
    typed = hits.select(
        "*",
        first_of(raw, "$.objectID", "$.id").try_cast("bigint").alias("listing_id"),
        clean(first_of(raw, "$.title")).alias("title"),
        clean(first_of(raw, "$.designers[0].name", "$.brand")).alias("brand"),
        money(first_of(raw, "$.price", "$.price_i")).alias("price"),
        money(first_of(raw, "$.sold_price")).alias("sold_price"),
        timestamp(first_of(raw, "$.created_at", "$.created_at_i")).alias("listed_at"),
        timestamp(first_of(raw, "$.sold_at", "$.sold_at_i")).alias("sold_at"),
        flag(first_of(raw, "$.makeoffer")).alias("offers"),
        rating(first_of(raw, "$.user.seller_score.rating_average")).alias("rating"),
    )
    reasons = F.array_compact(F.array(F.when(F.coalesce(F.col("listing_id"), F.lit(0)) <= 0, "id"), F.when(F.col("title").isNull(), "title"), F.when(F.col("brand").isNull(), "brand"), F.when(F.coalesce(F.col("price"), F.lit(0)) <= 0, "price")))
    typed = typed.withColumn("reasons", reasons)
    return typed.filter(F.size("reasons") == 0).drop("reasons"), typed.filter(F.size("reasons") > 0).select(payload, "reasons")


def coverage(collected: Column, expected: Column) -> Column:
    """complete, partial or poor; null if nothing was expected."""
    ratio = F.least(F.try_divide(collected.cast("double"), F.nullif(expected, F.lit(0)).cast("double")), F.lit(1.0))
    return F.when(ratio >= COMPLETE, "complete").when(ratio >= PARTIAL, "partial").when(ratio.isNotNull(), "poor")


def convert(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Prices in USD by the rate of the day; null without one. ``rates``: currency,
    day, rate."""
    joined = rows.join(rates, ["currency", "day"], "left")
    rate = F.when(F.col("currency") == "USD", F.lit(1).cast("decimal(18,8)")).otherwise(F.col("rate"))
    return joined.withColumn("price_usd", F.round(F.col("price") * rate, 2)).drop("rate")


def auto_map(candidates: DataFrame, brand: str = "brand_id", high: float = 0.95, low: float = 0.75) -> DataFrame:
    """0.7 of the likeness and 0.3 of the popularity within the brand: verified,
    candidate or dropped."""
    most = F.max("count").over(Window.partitionBy(brand))
    score = F.round((0.7 * F.col("likeness") / 100 + 0.3 * F.log1p("count") / F.log1p(most)).cast("decimal(24,8)"), 4)
    return candidates.withColumn("score", score).withColumn("verdict", F.when(F.col("score") >= high, "verified").when(F.col("score") >= low, "candidate").otherwise("dropped"))
