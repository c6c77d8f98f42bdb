"""Classes of things that are linked, over any type of key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.sources.scratch import stored


def classes(links: DataFrame) -> DataFrame:
    """id, class (the least id that can be reached) of each id of ``links`` (a, b).

    In each round an id takes the least label of its neighbours, and then the label that the
    id of that name has, so chains get shorter by half. Rounds are tables; whether one changed
    anything is all that reaches the driver."""
    pairs = links.select("a", "b").filter("a is not null and b is not null")
    both = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("class")), "labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("b"), "class"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class").alias("_heard"))
        mid = labels.join(heard, "id").select("id", F.col("class").alias("_was"), F.least("class", "_heard").alias("_mid"))
        far = labels.select(F.col("id").alias("_mid"), F.col("class").alias("_far"))
        after = stored(mid.join(far, "_mid").select("id", F.least("_mid", "_far").alias("class"), "_was"), "labels")
        labels = after.select("id", "class")
        if after.filter("class <> _was").isEmpty():
            return labels
