"""Running sums and weighted draws without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.sources.scratch import stored

#: Bits of a draw.
BITS = 52


def running_sums(rows: DataFrame, value: str, order: list[str], name: str = "upto") -> DataFrame:
    """Adds the sum of ``value`` (whole numbers) up to and with each row in ``order``, which
    names each row once. Rows are dealt out by ranges of the order; each range is summed by
    itself, and what comes before it is a sum of ranges' totals, a row for each range."""
    dealt = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn("_own", within).join(F.broadcast(before), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("decimal(38,0)")).drop("_own", "_before")


def uniform(draw: Column, seed: int) -> Column:
    """A whole number below 2 ** ``BITS``, from the seed and the draw's number alone."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), draw.cast("string")), 256), 1, BITS // 4), 16, 10).cast("decimal(20,0)")


def draws(rows: DataFrame, weight: str, order: list[str], size: int, seed: int) -> DataFrame:
    """``size`` draws with replacement in proportion to ``weight`` (whole numbers; rows of none
    are never drawn): draw, and the row's columns. The same on any number of partitions.

    A draw is a point of the sums of all weights, and the row is the last that begins at or
    before it: points and beginnings are merged in order, a range of rows at a time."""
    summed = stored(running_sums(rows.filter(F.col(weight) > 0), weight, order), "sums")
    edges = summed.groupBy("_part").agg(F.min(F.col("upto") - F.col(weight)).alias("_low"), F.max("upto").alias("_high"))
    total = edges.agg(F.max("_high").alias("_total"))
    points = rows.sparkSession.range(1, size + 1).select(F.col("id").alias("draw")).join(F.broadcast(total)).filter("_total is not null")
    exact = F.expr(f"cast(_u * _total as decimal(38,0)) div {2**BITS}")
    points = points.withColumn("_u", uniform(F.col("draw"), seed)).withColumn("_at", exact.cast("decimal(38,0)")).select("draw", "_at")
    points = points.join(F.broadcast(edges), (F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_high"))).select("_part", "_at", "draw")  # a row for each range
    row = F.struct(*rows.columns)
    begins = summed.select("_part", (F.col("upto") - F.col(weight)).cast("decimal(38,0)").alias("_at"), F.lit(None).cast("long").alias("draw"), row.alias("_row"))
    both = begins.unionByName(points.withColumn("_row", F.lit(None).cast(begins.schema["_row"].dataType)))
    order_of = Window.partitionBy("_part").orderBy("_at", F.col("draw").isNotNull(), "draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_row", F.last("_row", ignorenulls=True).over(order_of)).filter("draw is not null").select("draw", "_row.*")
