"""Queries over groups of listings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from souk.functions.exprs import AS_OF
from souk.operators import groups as G
from souk.operators import seasons as N
from souk.plans.history_queries import _MONTHS
from souk.plans.market_queries import register, scoped
from souk.plans.sql import query, up
from souk.sources.listings import listings, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
q = lambda sql=None: register(QUERIES, ORACLE, sql)


@q(query("SELECT DISTINCT product_type, model AS phrase, CASE WHEN color = 'cold' THEN line ELSE color END AS parent FROM listings", scoped=False))
def parent_lines(spark, sf_dir):
    """Models under their first word, or under the word after a modifier."""
    rows = listings(spark, sf_dir).select("product_type", F.col("model").alias("phrase"), "line", "color").distinct()
    lines = rows.select("product_type", F.col("color").alias("line")).filter("line <> 'cold'").unionByName(rows.filter("color = 'cold'").select("product_type", "line")).distinct()
    return G.parents(rows.select("product_type", "phrase").distinct(), lines, "product_type", ("cold",))


@q(query("""SELECT old, new, n FROM (SELECT *, row_number() OVER (PARTITION BY old ORDER BY n DESC, new) AS a, row_number() OVER (PARTITION BY new ORDER BY n DESC, old) AS b
FROM (SELECT old, new, count(*) AS n FROM moved GROUP BY ALL) JOIN (SELECT old, count(*) AS w FROM moved GROUP BY old) USING (old) WHERE n >= 0.5 * w) WHERE a = 1 AND b = 1""", scoped=False,
         more="moved AS (SELECT listing_id, model AS old, CASE WHEN size > 15 THEN line || '-' || color ELSE product_type END AS new FROM listings)"))
def inherited_ids(spark, sf_dir):
    new = F.when(F.col("size") > 15, F.concat_ws("-", "line", "color")).otherwise(F.col("product_type"))
    return G.inherit(listings(spark, sf_dir).select("listing_id", F.col("model").alias("old"), new.alias("new")))


_RETIRED = datetime(1998, 1, 1)


@q(query("""SELECT g.model AS group_id, derived, CAST(CASE WHEN u.model IS NOT NULL OR NOT derived THEN NULL ELSE coalesce(retired_at, TIMESTAMP '1998-06-01') END AS VARCHAR) AS retired_at
FROM (SELECT DISTINCT model, length(model) % 2 = 0 AS derived, CASE WHEN length(model) % 3 = 0 THEN TIMESTAMP '1998-01-01' END AS retired_at FROM listings) g LEFT JOIN (SELECT DISTINCT model FROM listings WHERE status = 'active' AND size = 7) u USING (model)
WHERE u.model IS NOT NULL OR NOT derived OR retired_at IS NULL""", scoped=False))
def settled_groups(spark, sf_dir):
    rows = listings(spark, sf_dir)
    n = F.length("model")
    groups = rows.select(F.col("model").alias("group_id"), (n % 2 == 0).alias("derived"), F.when(n % 3 == 0, F.lit(str(_RETIRED)).cast("timestamp_ntz")).alias("retired_at")).distinct()
    return G.settle(groups, rows.filter("status = 'active' and size = 7").select(F.col("model").alias("group_id")), AS_OF)


@q(query("SELECT listing_id, sha256(model || chr(31) || department || chr(31) || size) AS hash FROM listings WHERE size > 40", scoped=False))
def delta_rows(spark, sf_dir):
    """What a second pass has to place again: here, all whose size was unknown before."""
    rows = listings(spark, sf_dir).select("listing_id", "size", G.input_hash("model", "department", "size").alias("hash"))
    return G.changed(rows, rows.withColumn("hash", F.when(F.col("size") <= 40, F.col("hash"))), "listing_id", "hash").select("listing_id", "hash")


@q(query("SELECT brand_id, product_type, string_agg(model, ' | ' ORDER BY k) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY brand_id, product_type ORDER BY sold_at DESC NULLS LAST, listing_id DESC) AS k FROM listings) WHERE k <= 5 GROUP BY ALL", scoped=False))
def group_examples(spark, sf_dir):
    return G.examples(listings(spark, sf_dir), ["brand_id", "product_type"], "model", 5, F.col("sold_at").desc_nulls_last(), F.col("listing_id").desc())


@q(query(f"SELECT count(*) AS sellers, count(*) FILTER (n >= 500) AS bulk, {up('coalesce(sum(n) FILTER (n >= 500), 0) / sum(n)::DOUBLE', 6)} AS share FROM (SELECT seller, count(*) AS n FROM listings GROUP BY seller)", scoped=False))
def bulk_sellers(spark, sf_dir):
    return G.bulk_sellers(listings(spark, sf_dir), 500)


@q(query("""SELECT scope_key, CAST(m AS VARCHAR) AS month, CAST(coalesce(max(n) FILTER (bucket = 'all'), 0) AS BIGINT) AS "all", CAST(coalesce(max(n) FILTER (bucket = 'new'), 0) AS BIGINT) AS new, CAST(coalesce(max(n) FILTER (bucket = 'used'), 0) AS BIGINT) AS used
FROM (SELECT DISTINCT scope_key FROM months WHERE scope_key LIKE 'brand:%') CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '1997-07-01', DATE '1998-06-01', INTERVAL 1 MONTH)) AS DATE) AS m) LEFT JOIN months USING (scope_key) WHERE month = m OR NOT EXISTS (SELECT 1 FROM months o WHERE o.scope_key = months.scope_key AND o.month = m) GROUP BY scope_key, m""".replace("max(n) FILTER (bucket", "max(n) FILTER (month = m AND bucket"), more=_MONTHS))
def month_card(spark, sf_dir):
    return G.month_card(N.month_stats(scoped(spark, sf_dir).filter("level = 'brand'")), "1998-06-01")


@q("SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN '{}' ELSE props END AS props FROM events")
def purged_payloads(spark, sf_dir):
    return G.purge(table(spark, sf_dir, "events"), "ts", "props", datetime(2024, 1, 30), 10).select("event_id", "props")
