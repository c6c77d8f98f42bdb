"""Streams run to their end, held against their batch twins; the paged source."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.operators import ingest as I
from souk.plans.market_queries import register
from souk.sources.listings import table
from souk.sources.paged import PagedSource
from souk.sources.scratch import path
from souk.streaming import changes as X
from souk.streaming import keyed as K

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
q = lambda sql=None: register(QUERIES, ORACLE, sql)


def folder(spark) -> str:
    """For a stream's checkpoint and table."""
    return path(spark, "stream")


@q("""SELECT user_id, CAST(ts AS VARCHAR) AS ts, value, before FROM (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value)) WHERE k = 1 OR value <> before""")
def stream_price_changes(spark, sf_dir):
    out = X.run_once(X.price_changes(X.observed(spark, sf_dir)), folder(spark))
    return out.withColumn("before", F.when(~F.isnan("before"), F.col("before")))


@q("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def stream_dedup(spark, sf_dir):
    return X.run_once(X.once(X.observed(spark, sf_dir), late="60 days"), folder(spark)).select("event_id", "user_id", "event_type")


@q("""SELECT user_id, CAST(before AS VARCHAR) AS last_seen, round((epoch_us(ts) - epoch_us(before)) / 3.6e9::DOUBLE, 6) AS gap_hours FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE epoch_us(ts) - epoch_us(before) >= 10 * 3600000000""")
def stream_removal_timeout(spark, sf_dir):
    return X.run_once(X.silent(X.observed(spark, sf_dir), hours=10), folder(spark)).withColumn("gap_hours", F.round("gap_hours", 6))


@q("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert(spark, sf_dir):
    return X.upsert(X.observed(spark, sf_dir), "user_id", ["ts", "event_id"], folder(spark)).select("user_id", "event_id", "event_type", "value")


@q("""SELECT user_id, CAST(ts AS VARCHAR) AS last_seen, CAST(ts + INTERVAL 10 HOUR AS VARCHAR) AS removed_at FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS after, max(ts) OVER () AS most FROM events) WHERE coalesce(after, most) - ts >= INTERVAL 10 HOUR AND (after IS NOT NULL OR date_trunc('millisecond', ts) + INTERVAL 10 HOUR < date_trunc('millisecond', most))""")
def stream_removals(spark, sf_dir):
    """Several micro-batches; keys that never return are told by a timer."""
    where = folder(spark)
    return X.run_once(X.removed(X.in_parts(spark, sf_dir, f"{where}/events"), hours=10), where)


@q("""SELECT user_id, CAST(ts AS VARCHAR) AS ts, value, before FROM (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value)) WHERE k = 1 OR value <> before""")
def stream_price_changes_parts(spark, sf_dir):
    """The same changes over several micro-batches: the last price is carried as state."""
    where = folder(spark)
    out = X.run_once(X.price_changes(X.in_parts(spark, sf_dir, f"{where}/events")), where)
    return out.withColumn("before", F.when(~F.isnan("before"), F.col("before")))


@q("""WITH o AS (
  SELECT user_id, ts, value, lag(value) OVER w AS prior, lag(ts) OVER w AS seen, max(ts) OVER () AS most
  FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, value))
SELECT user_id, CAST(ts AS VARCHAR) AS ts, value, CASE WHEN ts - seen < INTERVAL 2 DAY THEN prior END AS before FROM o
WHERE (seen IS NULL OR ts - seen >= INTERVAL 2 DAY OR value <> prior)
  AND ts <= date_trunc('millisecond', most) - INTERVAL 2 HOUR""")
def stream_price_changes_late(spark, sf_dir):
    """Every row up to 90 minutes late, two hours allowed; keys silent for two days are
    forgotten. What the watermark hasn't passed at the end still waits."""
    where = folder(spark)
    changes = K.price_changes(K.arriving(spark, sf_dir, f"{where}/events"), "user_id", "ts", "value", forget_days=2)
    return K.drained(changes, where)[0]


@q("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert_buckets(spark, sf_dir):
    where = folder(spark)
    return X.upsert_buckets(X.in_parts(spark, sf_dir, f"{where}/events"), "user_id", ["ts", "event_id"], where).select("user_id", "event_id", "event_type", "value")


@q("SELECT p_partkey, p_name, p_brand, p_size FROM part")
def paged_scan(spark, sf_dir):
    spark.dataSource.register(PagedSource)
    return spark.read.format("souk_paged").option("path", f"{sf_dir}/part.parquet").option("key", "p_partkey").option("limit", 150).load().select("p_partkey", "p_name", "p_brand", "p_size")


@q("""SELECT e.event_id AS listing_id, e.event_type AS title, CAST(round(CAST(e.value AS DECIMAL(38,10)), 2) AS DOUBLE) AS price FROM events e WHERE event_type <> 'error' AND round(CAST(e.value AS DECIMAL(38,10)), 2) > 0 AND event_id > 0""")
def normalize_hits(spark, sf_dir):
    hits = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("objectID"), F.when(F.col("event_type") != "error", F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("title"), F.lit("b").alias("brand"), F.col("value").cast("string").alias("price"))).alias("payload"))
    typed, _ = I.normalize(hits)
    return typed.select("listing_id", "title", "price")


@q("""SELECT event_type, count(*) AS n, CASE WHEN n / 250.0 >= 0.98 THEN 'complete' WHEN n / 250.0 >= 0.7 THEN 'partial' ELSE 'poor' END AS level FROM events GROUP BY event_type""")
def coverage_levels(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("level", I.coverage(F.col("n"), F.lit(250)))


@q("""SELECT user_id, n, CAST(round(CAST(0.7 * (n % 100) / 100.0 + 0.3 * ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY user_id % 5)) AS DECIMAL(24,8)), 4) AS DOUBLE) AS score FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)""")
def auto_map(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("count")).withColumns({"brand_id": F.col("user_id") % 5, "likeness": F.col("count") % 100})
    return I.auto_map(rows).select("user_id", F.col("count").alias("n"), "score")
