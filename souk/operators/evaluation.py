"""Evaluation of placements and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.exprs import half_up


def wilson(hits: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The 95 % interval of a share; null without cases."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p = F.try_divide(hits.cast("double"), n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    centre = p + F.try_divide(F.lit(z * z), 2 * n)
    spread = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    return half_up((centre - spread) / scale, 6), half_up((centre + spread) / scale, 6)


def split_of(identity: Column) -> Column:
    """dev or holdout by sha256(id) mod 5: 16 is 1 modulo 5, so the sum of the
    hexadecimal digits decides."""
    digits = F.transform(F.split(F.sha2(identity.cast("string"), 256), ""), lambda d: F.conv(d, 16, 10).cast("int"))
    return F.when(F.aggregate(digits, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 5 < 2, "holdout").otherwise("dev")


def confusion(rows: DataFrame, gold: str, found: str, *by: str) -> DataFrame:
    """Precision and recall of a 0/1 column against another."""
    hit = (F.col(gold) == 1) & (F.col(found) == 1)
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.count_if(F.col(found) == 1).alias("found"), F.count_if(F.col(gold) == 1).alias("gold"))
    share = lambda a, b: half_up(F.try_divide(F.col(a).cast("double"), F.nullif(F.col(b), F.lit(0)).cast("double")), 6)
    return out.withColumns({"precision": share("hits", "found"), "recall": share("hits", "gold")})


def sample_order(identity: Column) -> Column:
    """A stable pseudo-random order."""
    return F.sha2(F.concat(F.lit("sample:"), identity.cast("string")), 256)
