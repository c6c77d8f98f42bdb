"""Listings that were not seen for a while, looked for in two sources."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.operators.history import CONFIRM_HOURS

#: The states that are looked for.
OPEN = ("active", "removed_pending")


def refresh(held: DataFrame, active: DataFrame, sold: DataFrame, now: Column, values: list[str], unseen_since: Column | None = None, hours: int = CONFIRM_HOURS) -> DataFrame:
    """``held`` (listing_id, status, last_seen, missing_at, ``values``, others) after a look for
    its open listings, with ``outcome``: active, sold, pending, removed, waiting, or null for
    rows that were not looked for (closed ones, and those seen since ``unseen_since``).

    ``active`` and ``sold`` are what the sources hold: listing_id, at, ``values``; of several
    rows the latest counts, and the active source before the sold one. A listing that is found
    takes its status and the values that aren't null, loses its missing mark, and keeps all else. One
    that isn't found is marked, never sold; ``hours`` after its mark it is removed. Rows of
    either source that nobody looked for add nothing."""
    hits = active.select("listing_id", "at", *values, F.lit(1).alias("_first")).unionByName(sold.select("listing_id", "at", *values, F.lit(0).alias("_first")))
    row = F.struct("_first", *values)
    found = hits.groupBy("listing_id").agg(F.max_by(row, F.struct("_first", "at", *values)).alias("_hit"))
    asked = F.coalesce(F.col("status").isin(*OPEN), F.lit(False))
    if unseen_since is not None:
        asked = asked & F.coalesce(F.col("last_seen") < unseen_since, F.lit(False))
    rows = held.withColumn("_asked", asked).join(found, "listing_id", "left")
    hit = F.col("_asked") & F.col("_hit").isNotNull()
    late = F.coalesce(now - F.col("missing_at") >= F.lit(timedelta(hours=hours)), F.lit(False))
    outcome = F.when(hit, F.when(F.col("_hit._first") == 1, "active").otherwise("sold")).when(F.col("_asked"), F.when(F.col("status") == "active", "pending").when(late, "removed").otherwise("waiting"))
    rows = rows.withColumn("outcome", outcome)
    named = {"pending": "removed_pending", "removed": "removed", "active": "active", "sold": "sold"}
    status = F.col("status")
    for of, becomes in named.items():
        status = F.when(F.col("outcome") == of, becomes).otherwise(status)
    changed = {
        "status": status,
        "last_seen": F.when(hit, now).otherwise(F.col("last_seen")),
        "missing_at": F.when(hit, None).when(F.col("outcome") == "pending", now).otherwise(F.col("missing_at")),
        **{c: F.when(hit, F.coalesce(F.col(f"_hit.{c}"), F.col(c))).otherwise(F.col(c)) for c in values},
    }
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in held.columns), "outcome")


def refresh_counts(after: DataFrame) -> DataFrame:
    """asked, active, sold, pending, removed, waiting."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return after.agg(F.count("outcome").alias("asked"), *(count(o) for o in ("active", "sold", "pending", "removed", "waiting")))
