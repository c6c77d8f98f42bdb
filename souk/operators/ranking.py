"""Smoothed sale probabilities, the liquidity score and badges."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.exprs import AS_OF, half_up, ratio, share
from souk.operators.scopes import PRIOR, medians, p30_counts, window_counts


def mid_rank(value: Column, *pool: Column | str, lower_is_better: bool = False) -> Column:
    """(worse + half of the equal) / n within the pool."""
    order = value.desc() if lower_is_better else value.asc()
    worse = F.rank().over(Window.partitionBy(*pool).orderBy(order)) - 1
    equal = F.count("*").over(Window.partitionBy(*pool, value))
    return (worse + F.lit(0.5) * equal) / F.count("*").over(Window.partitionBy(*pool))


def average_rank(value: Column, *pool: Column | str) -> Column:
    """Ranks from 1; ties share their mean."""
    return F.rank().over(Window.partitionBy(*pool).orderBy(value)) + (F.count("*").over(Window.partitionBy(*pool, value)) - 1) / 2.0


def smooth(sold: Column, cohort: Column, parent: Column) -> Column:
    """(k + 20 p) / (n + 20) within 0 and 1, six places half up."""
    raw = (sold + F.lit(float(PRIOR)) * parent.cast("double")) / (cohort + F.lit(float(PRIOR)))
    return half_up(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 6)


def smoothed_p30(scoped: DataFrame, at: datetime = AS_OF) -> DataFrame:
    """Each brand and type shrinks to what is above it: brands to the overall
    rate, types to the type across brands, models to their type in their brand.

    ``scoped`` carries brand_id, product_type and model. Joins go from the top
    down; their sides are aggregates.
    """
    keyed = p30_counts(scoped.withColumns({"brand_id": F.col("brand_id"), "product_type": F.when(F.col("level") != "brand", F.col("product_type"))}), "brand_id", "product_type", at=at)
    brands = keyed.filter("level = 'brand'")
    overall = brands.agg(share(F.sum("p30_sold"), F.sum("p30_cohort")).alias("overall"))
    across = keyed.filter("level = 'type'").groupBy("product_type").agg(F.sum("p30_sold").alias("s"), F.sum("p30_cohort").alias("c"))
    across = across.join(F.broadcast(overall)).select("product_type", smooth(F.col("s"), F.col("c"), F.coalesce("overall", F.lit(0))).alias("parent"))
    out = lambda rows: rows.select("level", "scope_key", "brand_id", "product_type", "p30_sold", "p30_cohort", smooth(F.col("p30_sold"), F.col("p30_cohort"), F.coalesce("parent", F.lit(0))).alias("p30"))
    brand_rows = out(brands.join(F.broadcast(overall.withColumnRenamed("overall", "parent"))))
    type_rows = out(keyed.filter("level = 'type'").join(across, "product_type"))
    parents = type_rows.select("brand_id", "product_type", F.col("p30").alias("parent"))
    model_rows = out(keyed.filter("level = 'model'").join(parents, ["brand_id", "product_type"]))
    return brand_rows.unionByName(type_rows).unionByName(model_rows)


def expected_days(p30: Column) -> Column:
    """Of a constant hazard, within 7 and 365 days."""
    days = F.when(p30 <= 0, 365.0).when(p30 >= 1, 7.0).otherwise(F.lit(-30.0) / F.ln(1 - p30.cast("double")))
    return half_up(F.least(F.greatest(days, F.lit(7.0)), F.lit(365.0)), 2)


@dataclass(frozen=True)
class Policy:
    """Who is ranked, and by what: weights add up to 1."""

    min_sales_per_month: float = 5
    min_price: float = 150
    excluded: tuple[str, ...] = ()
    weights: dict[str, float] = field(default_factory=lambda: {"sales": 0.40, "speed": 0.25, "likes": 0.20, "price": 0.15})


def parse_weights(raw: dict[str, float]) -> dict[str, float]:
    """Scaled to a sum of 1 with four places; the largest takes the remainder."""
    if not raw or any(w < 0 for w in raw.values()) or not sum(raw.values()):
        raise ValueError("weights must be 0 or more and not all 0")
    total = sum(raw.values())
    scaled = {k: round(w / total, 4) for k, w in raw.items()}
    largest = max(scaled, key=scaled.get)
    scaled[largest] = round(scaled[largest] + 1 - sum(scaled.values()), 4)
    return scaled


def candidates(scoped: DataFrame, at: datetime = AS_OF) -> DataFrame:
    """What the rank reads, by scope."""
    return window_counts(scoped, at).join(medians(scoped, at).drop("level"), "scope_key").withColumn("sales_per_month", half_up(F.col("sold_90d") / 3.0, 1))


def liquidity(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The weighted sum of four mid-rank percentiles, of the eligible rows of a level."""
    fits = (F.col("sales_per_month") >= policy.min_sales_per_month) & (F.col("median_price_90d") >= policy.min_price) & F.col("median_days_to_sell").isNotNull()
    pool = rows.filter(fits & ~F.col("scope_key").isin(list(policy.excluded)) if policy.excluded else fits)
    w = policy.weights
    score = w["sales"] * mid_rank(F.col("sold_90d"), "level") + w["speed"] * mid_rank(F.col("median_days_to_sell"), "level", lower_is_better=True) + w["likes"] * mid_rank(F.coalesce("median_likes", F.lit(0)), "level") + w["price"] * mid_rank(F.col("median_price_90d"), "level")
    return pool.withColumn("liquidity_score", half_up(100 * score, 2))


#: Fixed values of the badges: least sales, of any badge and of two of them; least sample of a section; quantiles.
LOW_SALES, HOT_SALES, STABLE_SALES, SECTION_SAMPLE = 5, 10, 30, 20
QUANTILES = {"score_p90": ("liquidity_score", 0.9), "days_p75": ("median_days_to_sell", 0.75), "p30_p25": ("p30", 0.25), "saturation_p80": ("saturation", 0.8)}


def badges(rows: DataFrame, sample: int = SECTION_SAMPLE) -> DataFrame:
    """``rows``: section, sold_90d, liquidity_score, p30, median_days_to_sell,
    fresh, spread. Adds badges (sorted, comma-joined).

    Limits come from the rows with enough sales: of the section if it has
    ``sample`` of them, else of all. Limits of zero give no badge.
    """
    rows = rows.withColumn("saturation", ratio(F.col("fresh") * 3, F.nullif("sold_90d", F.lit(0))))
    good = rows.filter(F.col("sold_90d") >= LOW_SALES)
    limits = [half_up(F.percentile(F.col(c).cast("double"), F.lit(q)), 6).alias(name) for name, (c, q) in QUANTILES.items()]
    own = good.groupBy("section").agg(F.count("*").alias("_n"), *limits).filter(F.col("_n") >= sample).drop("_n")
    overall = good.agg(*[x.alias(f"all_{n}") for x, n in zip(limits, QUANTILES, strict=True)])
    out = rows.join(F.broadcast(overall)).join(own, "section", "left")
    out = out.withColumns({n: F.coalesce(n, f"all_{n}") for n in QUANTILES})
    enough = F.col("sold_90d") >= LOW_SALES
    over = lambda c, limit: enough & (F.col(c) > 0) & (F.col(c) >= F.col(limit))
    marks = F.array_compact(F.array(
        F.when(~enough, "low_data"),
        F.when((F.col("sold_90d") >= HOT_SALES) & over("liquidity_score", "score_p90"), "hot"),
        F.when((F.col("sold_90d") >= STABLE_SALES) & (F.col("spread") <= 0.35), "stable"),
        F.when(over("median_days_to_sell", "days_p75") & (F.col("p30") <= F.col("p30_p25")), "slow"),
        F.when(over("saturation", "saturation_p80"), "saturated"),
    ))
    return out.withColumn("badges", F.array_join(F.array_sort(marks), ",")).drop(*QUANTILES, *(f"all_{n}" for n in QUANTILES))
