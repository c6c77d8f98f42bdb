"""Listings looked for again, the list of deals, the brands to scan, season profiles as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.operators import deals as D
from souk.operators import refresh as R
from souk.operators import seasons as N
from souk.plans.history_queries import _SEASONS, _profile
from souk.plans.market_queries import register
from souk.plans.sql import query
from souk.sources.listings import listings

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
q = lambda sql=None: register(QUERIES, ORACLE, sql)

_NOW, _SINCE = "1998-06-01", "1998-05-30"


@q(query("""SELECT listing_id, CASE outcome WHEN 'pending' THEN 'removed_pending' WHEN 'waiting' THEN status ELSE coalesce(outcome, status) END AS status,
  CAST(CASE WHEN hit THEN now ELSE last_seen END AS VARCHAR) AS last_seen, CAST(CASE WHEN hit THEN NULL WHEN outcome = 'pending' THEN now ELSE missing_at END AS VARCHAR) AS missing_at, CAST(CASE WHEN hit THEN coalesce(found, price) ELSE price END AS DOUBLE) AS price, size, outcome
FROM (SELECT *, asked AND (a OR s) AS hit, CASE WHEN NOT asked THEN NULL WHEN a THEN 'active' WHEN s THEN 'sold' WHEN status = 'active' THEN 'pending' WHEN now - missing_at >= INTERVAL 48 HOUR THEN 'removed' ELSE 'waiting' END AS outcome
  FROM (SELECT *, status IN ('active', 'removed_pending') AND last_seen < TIMESTAMP '1998-05-30' AS asked FROM held))""", scoped=False, more="""
held AS (SELECT listing_id, CASE WHEN status = 'removed' THEN 'removed_pending' ELSE status END AS status, touched_at AS last_seen, CASE WHEN status = 'removed' AND size % 5 > 0 THEN touched_at + to_days(CAST(size AS INT) * 40) END AS missing_at, price, size,
  TIMESTAMP '1998-06-01' AS now, size % 3 = 0 AS a, size % 4 = 0 AS s, CASE WHEN size % 3 = 0 THEN CASE WHEN size % 2 = 0 THEN price * 2 END ELSE price * 3 END AS found FROM listings)"""))  # fmt: skip
def refresh_missing(spark, sf_dir):
    """Removed listings as those marked before; sources that hold some sizes, with other prices,
    and with an older row of each that doesn't count."""
    rows = listings(spark, sf_dir)
    marked = F.when((F.col("status") == "removed") & (F.col("size") % 5 > 0), F.timestamp_add("DAY", (F.col("size") * 40).cast("int"), F.col("touched_at")))
    held = rows.select("listing_id", F.when(F.col("status") == "removed", "removed_pending").otherwise(F.col("status")).alias("status"), F.col("touched_at").alias("last_seen"), marked.alias("missing_at"), F.col("price").cast("decimal(16,2)").alias("price"), "size")
    price = lambda by: (F.col("price") * by).cast("decimal(16,2)")
    active = rows.filter("size % 3 = 0").select("listing_id", F.col("touched_at").alias("at"), F.when(F.col("size") % 2 == 0, price(2)).alias("price"))
    older = rows.filter("size % 3 = 0").select("listing_id", F.col("listed_at").alias("at"), F.lit(None).cast("decimal(16,2)").alias("price"))
    sold = rows.filter("size % 4 = 0").select("listing_id", F.col("touched_at").alias("at"), price(3).alias("price"))
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return R.refresh(held, active.unionByName(older), sold, at(_NOW), ["price"], at(_SINCE)).withColumn("price", F.col("price").cast("double"))


_GROUPS = """offers AS (SELECT *, brand_id * 1000 + size AS group_id FROM listings),
groups AS (SELECT DISTINCT group_id, 'g' || group_id AS name, brand_id FROM offers WHERE group_id % 7 > 0), brands AS (SELECT DISTINCT brand_id, 'b' || brand_id AS name FROM offers WHERE brand_id % 5 > 0)"""


@q(query("""SELECT listing_id AS deal_id, listing_id, model AS title, CASE WHEN size % 9 > 0 THEN CAST(size AS VARCHAR) ELSE 'raw' END AS size, condition, status AS listing_status, b.name AS brand, group_id, g.name AS "group",
  CAST(round(price * 100) AS BIGINT) AS price, CAST(round(price_initial * 100) AS BIGINT) AS p50, CAST(round((price_initial - 2 * price) * 100) AS BIGINT) AS net, CAST(size AS DOUBLE) / 50 AS roi, CAST(listed_at AS VARCHAR) AS found_at,
  CASE WHEN size % 4 = 1 THEN 'good' WHEN size % 4 = 2 THEN 'bad' END AS verdict
FROM offers JOIN groups g USING (group_id) LEFT JOIN brands b ON b.brand_id = g.brand_id WHERE status = 'active'""", scoped=False, more=_GROUPS))  # fmt: skip
def deals_list(spark, sf_dir):
    """Every listing as a deal; some groups and brands aren't known."""
    offers, groups, brands = _offers(spark, sf_dir)
    verdict = F.when(F.col("size") % 4 == 1, "good").when(F.col("size") % 4 == 2, "bad").when(F.col("size") % 4 == 3, "odd")
    deals = offers.select(F.col("listing_id").alias("deal_id"), "listing_id", "group_id", "price", F.col("price_initial").alias("p50"), (F.col("price_initial") - 2 * F.col("price")).alias("net"), (F.col("size").cast("double") / 50).alias("roi"), F.col("listed_at").alias("found_at"), verdict.alias("verdict"))
    shown = offers.select("listing_id", F.col("model").alias("title"), F.when(F.col("size") % 9 > 0, F.col("size").cast("string")).alias("size"), F.lit("raw").alias("size_raw"), "condition", "status")
    return D.deal_rows(deals, shown, groups, brands)


def _offers(spark, sf_dir):
    offers = listings(spark, sf_dir).withColumn("group_id", F.col("brand_id") * 1000 + F.col("size"))
    groups = offers.select("group_id", F.concat(F.lit("g"), "group_id").alias("name"), "brand_id").distinct().filter("group_id % 7 > 0")
    brands = offers.select("brand_id", F.concat(F.lit("b"), "brand_id").alias("name")).distinct().filter("brand_id % 5 > 0")
    return offers, groups, brands


@q(query("""SELECT 'liquid' AS scope, brand_id FROM metrics WHERE score >= 50 GROUP BY brand_id
UNION ALL SELECT 'watched', brand_id FROM metrics JOIN watched USING (group_id) GROUP BY brand_id""", scoped=False, more=_GROUPS + """,
metrics AS (SELECT group_id, brand_id, round(100.0 * count(*) FILTER (status = 'sold') / count(*), 2) AS score FROM offers GROUP BY ALL),
watched AS (SELECT group_id FROM offers GROUP BY group_id HAVING max(likes) FILTER (status = 'removed') % 10 = 0)"""))  # fmt: skip
def scan_scope(spark, sf_dir):
    """The brands to scan by either rule; a group's score is its share of sold listings."""
    offers, _, _ = _offers(spark, sf_dir)
    score = F.round((100 * F.count_if(F.col("status") == "sold") / F.count("*")).cast("decimal(24,8)"), 2)
    metrics = offers.groupBy("group_id", "brand_id").agg(score.alias("liquidity_score")).withColumn("scope", F.lit("model"))
    watched = offers.groupBy("group_id").agg(F.max(F.when(F.col("status") == "removed", F.col("likes"))).alias("most")).filter("most % 10 = 0")
    return D.in_scope(metrics).select(F.lit("liquid").alias("scope"), "brand_id").unionByName(D.in_scope(metrics, watched).select(F.lit("watched").alias("scope"), "brand_id"))


_LEVELS = "array_to_string(list_transform(range(1, 13), lambda m: coalesce(CAST(CAST(levels[m] AS DECIMAL(12,4)) AS VARCHAR), '-')), '|')"
_PACKED = _SEASONS + """, packed AS (SELECT kind, key, CAST(count(*) AS INT) AS n_months, CAST(sum(sales) AS BIGINT) AS sales_year, map_from_entries(list((calendar, si_abs))) AS levels FROM profile GROUP BY kind, key)"""


def _shown(levels):
    return F.array_join(F.transform(levels, lambda x: F.coalesce(x.cast("decimal(12,4)").cast("string"), F.lit("-"))), "|")


@q(query(f"""SELECT kind, key, n_months, sales_year, {_LEVELS} AS levels, CASE WHEN w.index IS NOT NULL THEN w.sales END AS winter_sales, w.index AS winter FROM packed LEFT JOIN (FROM seasons WHERE season = 'winter') w USING (kind, key)""", scoped=False, more=_PACKED))
def season_packed(spark, sf_dir):
    profile = _profile(spark, sf_dir)[0]
    rows = N.packed(profile, N.seasons(profile, minimum=20))
    winter = F.try_element_at("seasons", F.lit("winter"))
    return rows.select("kind", "key", F.size("months").alias("n_months"), "sales_year", _shown(N.by_month(F.col("months"))).alias("levels"), winter["sales"].alias("winter_sales"), winter["index"].alias("winter"))


@q(query(f"""SELECT product_type, department, coalesce(own.key, product_type) AS profile_key, CASE WHEN own.key IS NOT NULL THEN own.shown ELSE whole.shown END AS levels
FROM wanted LEFT JOIN (FROM lines WHERE kind = 'department') own ON own.key = product_type || ':' || department LEFT JOIN (FROM lines WHERE kind = 'type') whole ON whole.key = product_type WHERE own.key IS NOT NULL OR whole.key IS NOT NULL""",
         scoped=False, more=_PACKED + f""", lines AS (SELECT kind, key, {_LEVELS} AS shown FROM packed),
wanted AS (SELECT DISTINCT product_type, CASE WHEN size % 3 = 0 THEN NULL WHEN size % 3 = 1 THEN 'OTHER' ELSE department END AS department FROM listings)"""))  # fmt: skip
def season_overlays(spark, sf_dir):
    """Each type's profile for its departments, for one that has none, and for no department."""
    profile = _profile(spark, sf_dir)[0]
    wanted = listings(spark, sf_dir).select("product_type", F.when(F.col("size") % 3 == 1, "OTHER").when(F.col("size") % 3 == 2, F.col("department")).alias("department"))
    found = N.overlay(wanted, N.packed(profile, N.seasons(profile)))
    return found.withColumn("levels", _shown(F.col("levels")))
