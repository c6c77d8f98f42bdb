"""Flags of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
MAD_K, LOT_FACTOR, MAD_SCALE = 6.0, 1.5, 1.4826


def price_flags(listings: DataFrame, *by: str, k: float = MAD_K) -> DataFrame:
    """Adds price_outlier and dear (at least 1.5 times its group's median).

    Medians are aggregates joined back; groups needn't fit in one task.
    """
    price = F.col("price").cast("double")
    centre = listings.groupBy(*by).agg(F.percentile(price, F.lit(0.5)).alias("centre"))
    off = listings.join(centre, list(by)).withColumn("off", F.abs(price - F.col("centre")))
    mad = off.groupBy(*by).agg(F.percentile("off", F.lit(0.5)).alias("mad"))
    rows = off.join(mad, list(by))
    band = (price < F.col("centre") * 0.05) | (price > F.col("centre") * 20)
    outlier = F.when(F.col("mad") == 0, band).otherwise(F.col("off") > F.col("mad") * MAD_SCALE * k)
    return rows.withColumn("price_outlier", outlier).withColumn("dear", price >= F.col("centre") * LOT_FACTOR)
