"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import written


def connected(links: DataFrame, name: str = "components") -> DataFrame:
    """``links``: a, b (long). Returns id, component (the least id that can be
    reached) for each id in a link.

    Each round every node takes the least label among its neighbours' and then the
    label of its label, so that long chains halve. Labels and links stay in tables;
    a round is written to the shared folder, and only whether anything changed
    reaches the driver.
    """
    both = links.filter("a <> b").select("a", "b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), f"{name}-0")
    number = 0
    while True:
        number += 1
        heard = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, "id").select("id", F.col("component").alias("was"), F.least("component", "heard").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("component").alias("far"))
        step = written(nearer.join(jump, "mid").select("id", F.least("mid", "far").alias("component"), (F.least("mid", "far") < F.col("was")).alias("changed")), f"{name}-{number}")
        labels = step.select("id", "component")
        if step.filter("changed").isEmpty():
            return labels
