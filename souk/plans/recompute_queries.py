"""The recomputation and what reads its wide table, with SQL written from the rules."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.exprs import AS_OF, moment
from souk.operators import deals as D
from souk.operators import ranking as R
from souk.operators import recompute as W
from souk.operators import trends as T
from souk.plans.market_queries import register
from souk.plans.sql import NOW, even, over, quantile, sold, up
from souk.sources.listings import LISTINGS_SQL, by_brand, kept, parts
from souk.sources.scratch import gathered, held, stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
q = lambda sql=None: register(QUERIES, ORACLE, sql)

#: The fixture tables are small, so a smaller stock makes a wholesaler and fewer sales a rank.
STOCK, PERIOD = 5, 90
POLICY = R.Policy(min_sales_per_month=1)


def market(spark, sf_dir, anew: bool = False) -> tuple[DataFrame, DataFrame]:
    """Listings with flags, changes of price and bumps by rules of their ids, and the links
    of relists: of a seller's listings of a model every third belongs to the first."""
    rows, n = kept(spark, sf_dir, anew), F.col("listing_id")
    flags = F.array_compact(F.array(F.when(n % 23 == 0, W.LOT), F.when(n % 37 == 0, "price_outlier"), F.when(n % 41 == 0, W.REPLICA))).cast("array<string>")
    rows = rows.withColumns({"flags": flags, "price_updated_at": F.timestamp_add("DAY", (2 - n % 15).cast("int"), F.col("touched_at")), "bumped_at": F.when(n % 2 == 0, F.col("touched_at"))})
    return rows, relists(rows)


def relists(rows: DataFrame) -> DataFrame:
    first = F.first("listing_id").over(Window.partitionBy("brand_id", "product_type", "model", "seller").orderBy("listed_at", "listing_id"))
    return rows.select("listing_id", first.alias("root_id")).filter("listing_id % 3 = 0 and listing_id <> root_id")


def base_facts(spark, sf_dir, anew: bool = False) -> DataFrame:
    def build() -> list[Callable[[], DataFrame]]:
        return [lambda rows=rows: W.facts(rows, relists(rows), stock=STOCK) for rows in by_brand(market(spark, sf_dir, anew)[0], parts(spark, sf_dir))]

    return held(spark, sf_dir, "facts", build, anew)


def wide(spark, sf_dir, anew: bool = False) -> DataFrame:
    """Every scope's row, with section, rates, rank. Scopes lie within a brand, so their rows
    are made some brands at a time; rates and rank are taken over all of them."""
    def build() -> DataFrame:
        facts = base_facts(spark, sf_dir, anew)
        scopes = gathered(spark, [lambda rows=rows: W.wide(rows) for rows in by_brand(facts, parts(spark, sf_dir))], "scopes")
        return W.ranked(W.smoothed(scopes.withColumn("section", F.substr("product_type", F.lit(1), F.lit(1)))), POLICY, PERIOD)

    return held(spark, sf_dir, "wide", build, anew)


def months(spark, sf_dir) -> DataFrame:
    return held(spark, sf_dir, "months", lambda: [lambda rows=rows: W.month_stats(rows) for rows in by_brand(base_facts(spark, sf_dir), parts(spark, sf_dir))])


_FACTS = f"""{LISTINGS_SQL}, raw AS (SELECT *, listing_id % 23 = 0 AS is_lot, listing_id % 37 = 0 AS marked, listing_id % 41 = 0 AS replica, touched_at + to_days(CAST(2 - listing_id % 15 AS INT)) AS price_updated_at,
  CASE WHEN listing_id % 2 = 0 THEN touched_at END AS bumped_at, CASE WHEN listing_id % 3 = 0 THEN nullif(first_value(listing_id) OVER (PARTITION BY brand_id, product_type, model, seller ORDER BY listed_at, listing_id), listing_id) END AS root_id FROM listings),
dormant AS (SELECT brand_id, seller FROM raw GROUP BY ALL HAVING count(*) FILTER (status = 'active') >= {STOCK} AND count(*) FILTER ({sold(365)}) / count(*) FILTER (status = 'active' OR {sold(365)})::DOUBLE < 0.01),
facts AS (SELECT r.*, coalesce(o.listed_at, r.listed_at) AS item_listed_at, NOT r.is_lot AND NOT r.marked AS price_usable, NOT r.is_lot AND d.seller IS NULL AS effective, greatest(r.listed_at, coalesce(r.bumped_at, r.listed_at)) AS fresh_at,
  coalesce(nullif(r.sold_price, 0), r.price) AS sale_price, CASE WHEN r.condition = 'is_new' THEN 'new' ELSE 'used' END AS cond
  FROM raw r LEFT JOIN raw o ON o.listing_id = r.root_id LEFT JOIN dormant d ON d.brand_id = r.brand_id AND d.seller = r.seller WHERE NOT r.replica),
scoped AS (SELECT *, 'brand' AS level, 'brand:' || brand_id AS scope_key FROM facts UNION ALL SELECT *, 'type', 'type:' || brand_id || ':' || product_type FROM facts
  UNION ALL SELECT *, 'line', 'line:' || brand_id || ':' || product_type || ':' || line FROM facts UNION ALL SELECT *, 'model', 'model:' || brand_id || ':' || product_type || ':' || model FROM facts)"""
_MARKED = f"""recent AS (SELECT scope_key, listing_id, ln(CAST(sale_price AS DOUBLE)) AS v FROM scoped WHERE {sold(90)} AND price_usable AND sale_price > 0),
far AS (SELECT scope_key, listing_id, abs(v - c) AS off FROM recent JOIN (SELECT scope_key, median(v) AS c FROM recent GROUP BY scope_key HAVING count(*) >= 8) USING (scope_key)),
outliers AS (SELECT scope_key, listing_id FROM far JOIN (SELECT scope_key, median(off) AS mad FROM far GROUP BY scope_key) USING (scope_key) WHERE off > greatest(5.9304::DOUBLE * mad, ln(3))),
sales AS (SELECT s.*, price_usable AND o.listing_id IS NULL AS priced, greatest(epoch(sold_at - item_listed_at) / 86400.0, 0) AS days FROM scoped s LEFT JOIN outliers o USING (scope_key, listing_id) WHERE {sold(365)})"""


def _sql(body: str, *more: str) -> str:
    return "WITH " + ", ".join((_FACTS, *more)) + "\n" + body


_CHAINS = f"""chains AS (SELECT scope_key, coalesce(root_id, listing_id) AS chain, bool_or(root_id IS NULL AND effective) AS root, bool_or(status = 'sold' AND sold_at <= {NOW} AND sold_at - item_listed_at <= INTERVAL 30 DAY) AS hit,
  max(CASE WHEN root_id IS NULL THEN CAST(size AS VARCHAR) END) AS size FROM scoped WHERE item_listed_at BETWEEN {NOW} - INTERVAL 120 DAY AND {NOW} - INTERVAL 30 DAY GROUP BY ALL HAVING root),
rates AS (SELECT scope_key, count(*) FILTER (hit) AS p30_sold, count(*) AS p30_cohort FROM chains GROUP BY scope_key)"""
_MAJOR = "major AS (SELECT scope_key, department FROM (SELECT scope_key, department, count(*) AS n FROM scoped GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY scope_key ORDER BY n DESC, department) = 1)"
_COUNTED = f"""counted AS (SELECT level, scope_key, brand_id, CASE WHEN level <> 'brand' THEN min(product_type) END AS product_type, count(*) AS listings, {", ".join(f"count(*) FILTER ({sold(d)}) AS sold_{d}d" for d in (7, 30, 90))},
  count(*) FILTER (status = 'sold' AND sold_at < {NOW} - INTERVAL 30 DAY AND sold_at >= {NOW} - INTERVAL 60 DAY) AS sold_prev_30d, count(*) FILTER (status = 'active') AS active_now,
  count(*) FILTER (root_id IS NULL AND listed_at >= {NOW} - INTERVAL 14 DAY) AS new_listings_14d, min(listed_at) AS first_seen_at, count(*) FILTER (status = 'active' AND effective) AS active_effective,
  count(*) FILTER (status = 'active' AND effective AND fresh_at >= {NOW} - INTERVAL 60 DAY) AS active_fresh FROM scoped GROUP BY level, scope_key, brand_id)"""
_PRICED = f"""priced AS (SELECT scope_key, {", ".join(f"{quantile('sale_price', where=f'priced AND {sold(d)}')} AS median_price_{d}d" for d in (7, 30, 90))}, {quantile("days", where=f"exact_sale AND {sold(30)}")} AS median_days_to_sell,
  CAST(coalesce(sum(sale_price) FILTER (priced AND {sold(90)}), 0) AS DOUBLE) AS gmv_90d FROM sales GROUP BY scope_key)"""
_METRICS = f"""metrics AS (SELECT c.*, median_price_7d, median_price_30d, median_price_90d, median_days_to_sell, coalesce(gmv_90d, 0) AS gmv_90d, coalesce(p30_sold, 0) AS p30_sold, coalesce(p30_cohort, 0) AS p30_cohort, department,
  {up("(median_price_30d - median_price_90d) / nullif(median_price_90d, 0)", 4)} AS price_change, coalesce({even(over("sold_30d", "sold_30d + active_now"), 6)}, 0) AS sell_through_30d, first_seen_at >= {NOW} - INTERVAL 60 DAY AS is_new,
  {up("(sold_30d + 1)::DOUBLE / (sold_prev_30d + 1)", 4)} AS growth, {up("30.0::DOUBLE / (30 + median_days_to_sell)", 4)} AS speed FROM counted c LEFT JOIN priced USING (scope_key) LEFT JOIN rates USING (scope_key) LEFT JOIN major USING (scope_key))"""
_ALL = (_MARKED, _CHAINS, _MAJOR, _COUNTED, _PRICED, _METRICS)
SCALARS = "level scope_key brand_id product_type listings sold_7d sold_30d sold_90d sold_prev_30d active_now new_listings_14d first_seen_at active_effective active_fresh median_price_7d median_price_30d median_price_90d median_days_to_sell gmv_90d p30_sold p30_cohort department price_change sell_through_30d is_new growth speed".split()


@q(_sql(f"SELECT {', '.join(SCALARS)} FROM metrics".replace("first_seen_at,", "CAST(first_seen_at AS VARCHAR) AS first_seen_at,"), *_ALL))
def recompute(spark, sf_dir):
    """All scalar metrics of all scopes, computed anew; the queries below read them again."""
    return wide(spark, sf_dir, anew=True).select(*SCALARS)


@q(_sql(f"""SELECT scope_key, week, count(s.scope_key) AS n, {quantile("sale_price", where="priced")} AS price FROM (SELECT DISTINCT scope_key FROM counted) CROSS JOIN (SELECT unnest(range(12))::INT AS week)
LEFT JOIN (SELECT *, 11 - CAST(floor(epoch({NOW} - sold_at) / 604800.0) AS INT) AS week FROM sales) s USING (scope_key, week) GROUP BY scope_key, week""", _MARKED, _COUNTED))
def recompute_weeks(spark, sf_dir):
    """The twelve places of each scope's series."""
    rows = wide(spark, sf_dir).select("scope_key", F.posexplode(F.arrays_zip("weekly_sales", F.coalesce("weekly_median_price", F.array_repeat(F.lit(None).cast("decimal(18,2)"), 12)).alias("p"))).alias("week", "w"))
    return rows.select("scope_key", "week", F.col("w.weekly_sales").alias("n"), F.col("w.p").alias("price"))


@q(_sql(f"""SELECT scope_key, period, count(*) AS sold, {quantile("sale_price", where="price_usable")} AS price, {quantile("days", where="exact_sale")} AS days, {quantile("likes", places=1)} AS likes
FROM sales JOIN (SELECT unnest([7, 14, 30, 60, 90, 180, 365])::INT AS period) ON sold_at >= {NOW} - to_days(period) GROUP BY scope_key, period""", _MARKED))
def recompute_windows(spark, sf_dir):
    return wide(spark, sf_dir).select("scope_key", F.explode("windows").alias("period", "w")).select("scope_key", "period", "w.*")


_STATS = f"""sold_stats AS (SELECT scope_key, bucket, count(*) AS n, CAST(sum(sale_price) AS DOUBLE) AS gmv, {", ".join(f"{quantile('sale_price', z)} AS p{int(100 * z)}" for z in (0.25, 0.5, 0.75))},
  CASE WHEN count(offer) >= 5 THEN {quantile("offer", places=4)} END AS offer_discount, CASE WHEN count(markdown) >= 5 THEN {quantile("markdown", places=4)} END AS total_markdown, CASE WHEN count(final) >= 5 THEN {quantile("final")} END AS days_at_final_price
  FROM (SELECT *, unnest(['all', cond]) AS bucket, 1 - {over("sold_price", "price")} AS offer, 1 - {over("sale_price", "price_initial")} AS markdown, CASE WHEN exact_sale AND price_updated_at <= sold_at THEN epoch(sold_at - price_updated_at) / 86400.0 END AS final FROM sales WHERE priced AND {sold(90)}) GROUP BY ALL),
ask_stats AS (SELECT scope_key, bucket, count(*) AS fresh_n, CASE WHEN count(*) >= 5 THEN {quantile("price")} END AS fresh_ask_p50 FROM (SELECT *, unnest(['all', cond]) AS bucket FROM scoped WHERE status = 'active' AND price_usable AND effective AND fresh_at >= {NOW} - INTERVAL 60 DAY) GROUP BY ALL),
buckets AS (SELECT scope_key, bucket, coalesce(n, 0) AS n, coalesce(gmv, 0) AS gmv, {", ".join(f"CASE WHEN n >= 5 THEN {c} END AS {c}" for c in W.MEDIANS)}, coalesce(fresh_n, 0) AS fresh_n, fresh_ask_p50 FROM sold_stats FULL JOIN ask_stats USING (scope_key, bucket)),
prices AS (SELECT *, {up("fresh_ask_p50 / nullif(p50, 0) - 1", 4)} AS fresh_ask_premium FROM buckets)"""


@q(_sql("SELECT * FROM prices", _MARKED, _STATS))
def recompute_pricing(spark, sf_dir):
    return _plain(wide(spark, sf_dir).select("scope_key", F.explode("pricing").alias("bucket", "p")).select("scope_key", "bucket", "p.*"))


def _plain(rows):
    """Lays open what a struct holds of decimals, so that all engines compare alike."""
    return rows.select(*(F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in rows.dtypes))


@q(_sql(f"""SELECT v.scope_key, value, sold, active, {even("sold / (sold + active)::DOUBLE", 6)} AS sell_through, CAST(row_number() OVER (PARTITION BY v.scope_key ORDER BY sold DESC, sold / (sold + active)::DOUBLE DESC, value) AS INT) AS place, {up(over("s.k", "s.n"), 6)} AS p30, coalesce(s.n, 0) AS p30_n,
  coalesce(s.n >= 10 AND {up(over("s.k", "s.n"), 6)} >= {up(over("w.p30_sold", "w.p30_cohort"), 6)}, false) AS hot
FROM (SELECT scope_key, CAST(size AS VARCHAR) AS value, count(*) FILTER (status = 'sold') AS sold, count(*) FILTER (status = 'active') AS active FROM scoped WHERE status = 'active' OR {sold(90)} GROUP BY ALL) v
LEFT JOIN (SELECT scope_key, size AS value, count(*) FILTER (hit) AS k, count(*) AS n FROM chains GROUP BY ALL) s USING (scope_key, value) LEFT JOIN rates w ON w.scope_key = v.scope_key QUALIFY place <= 12""", _CHAINS))
def recompute_sizes(spark, sf_dir):
    """Each scope's first sizes, with the rate of the chains whose root has that size."""
    return wide(spark, sf_dir).select("scope_key", F.posexplode("sizes").alias("at", "s")).select("scope_key", (F.col("at") + 1).alias("place"), "s.*")


@q(_sql(f"""SELECT scope_key, color AS value, count(*) FILTER (status = 'sold') AS sold, count(*) FILTER (status = 'active') AS active, {even("count(*) FILTER (status = 'sold') / count(*)::DOUBLE", 6)} AS sell_through,
  CAST(row_number() OVER (PARTITION BY scope_key ORDER BY count(*) FILTER (status = 'sold') DESC, count(*) FILTER (status = 'sold') / count(*)::DOUBLE DESC, color) AS INT) AS place FROM scoped WHERE status = 'active' OR {sold(90)} GROUP BY scope_key, color QUALIFY place <= 12"""))
def recompute_colors(spark, sf_dir):
    return wide(spark, sf_dir).select("scope_key", F.posexplode("colors").alias("at", "s")).select("scope_key", (F.col("at") + 1).alias("place"), "s.*")


_MONTHLY = f"""monthly AS (SELECT *, CAST(date_trunc('month', sold_at) AS DATE) AS month FROM scoped WHERE status = 'sold' AND sold_at <= {NOW}),
month_recent AS (SELECT scope_key, month, listing_id, ln(CAST(sale_price AS DOUBLE)) AS v FROM monthly WHERE price_usable AND sale_price > 0),
month_far AS (SELECT scope_key, month, listing_id, abs(v - c) AS off FROM month_recent JOIN (SELECT scope_key, month, median(v) AS c FROM month_recent GROUP BY ALL HAVING count(*) >= 8) USING (scope_key, month)),
month_outliers AS (SELECT scope_key, listing_id FROM month_far JOIN (SELECT scope_key, month, median(off) AS mad FROM month_far GROUP BY ALL) USING (scope_key, month) WHERE off > greatest(5.9304::DOUBLE * mad, ln(3))),
month_rows AS (SELECT m.*, CASE WHEN price_usable AND o.listing_id IS NULL THEN sale_price END AS counted, unnest(['all', cond]) AS bucket FROM monthly m LEFT JOIN month_outliers o USING (scope_key, listing_id)),
months AS (SELECT scope_key, month, bucket, count(*) AS n, CAST(coalesce(sum(counted), 0) AS DOUBLE) AS gmv, {", ".join(f"{quantile('counted', z)} AS p{int(100 * z)}" for z in (0.25, 0.5, 0.75))} FROM month_rows GROUP BY ALL)"""


@q(_sql("SELECT scope_key, CAST(month AS VARCHAR) AS month, bucket, n, gmv, p25, p50, p75 FROM months", _MONTHLY))
def recompute_months(spark, sf_dir):
    return months(spark, sf_dir)


def _smooth(k: str, n: str, p: str) -> str:
    return up(f"least(greatest(({k} + 20.0::DOUBLE * {p}) / ({n} + 20.0::DOUBLE), 0), 1)", 6)


def _mid(x: str, lower: bool = False) -> str:
    return f"((rank() OVER (PARTITION BY level ORDER BY {x} {'DESC' if lower else 'ASC'}) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY level, {x})) / count(*) OVER (PARTITION BY level))"


_RANKED = f"""overall AS (SELECT coalesce(sum(p30_sold) / nullif(sum(p30_cohort), 0)::DOUBLE, 0) AS o FROM metrics WHERE level = 'brand'),
across AS (SELECT product_type, {_smooth("k", "n", "o")} AS a FROM (SELECT product_type, sum(p30_sold) AS k, sum(p30_cohort) AS n FROM metrics WHERE level = 'type' GROUP BY product_type) CROSS JOIN overall),
typed AS (SELECT brand_id, product_type, {_smooth("p30_sold", "p30_cohort", "a")} AS t FROM metrics JOIN across USING (product_type) WHERE level = 'type'),
rated AS (SELECT m.*, {_smooth("p30_sold", "p30_cohort", "CASE level WHEN 'brand' THEN o WHEN 'type' THEN a ELSE coalesce(t, a, o) END")} AS p30 FROM metrics m CROSS JOIN overall LEFT JOIN across USING (product_type) LEFT JOIN typed USING (brand_id, product_type)),
period AS (SELECT scope_key, count(*) AS period_sold, {quantile("sale_price", where="price_usable")} AS period_median_price, {quantile("days", where="exact_sale")} AS period_median_days, {quantile("likes", places=1)} AS period_median_likes FROM sales WHERE {sold(PERIOD)} GROUP BY scope_key),
scored AS (SELECT scope_key, {up(f"100 * (0.4::DOUBLE * {_mid('period_sold')} + 0.25::DOUBLE * {_mid('period_median_days', True)} + 0.2::DOUBLE * {_mid('coalesce(period_median_likes, 0)')} + 0.15::DOUBLE * {_mid('period_median_price')})", 2)} AS liquidity_score
  FROM counted JOIN period USING (scope_key) WHERE period_sold * 30 / {PERIOD}.0::DOUBLE >= 1 AND period_median_price >= 150 AND period_median_days IS NOT NULL),
ranked AS (SELECT r.*, substr(product_type, 1, 1) AS section, coalesce(period_sold, 0) AS period_sold, period_median_price, period_median_days, period_median_likes, {up(f"coalesce(period_sold, 0) * 30 / {PERIOD}.0::DOUBLE", 1)} AS sales_per_month, liquidity_score,
  {up("least(greatest(CASE WHEN p30 <= 0 THEN 365.0 WHEN p30 >= 1 THEN 7.0 ELSE -30.0::DOUBLE / ln(1 - p30) END, 7), 365)", 2)} AS expected_days FROM rated r LEFT JOIN period USING (scope_key) LEFT JOIN scored USING (scope_key))"""
_RANK = (*_ALL, _RANKED)
_RANK_COLUMNS = "level, scope_key, section, p30, expected_days, period_sold, period_median_price, period_median_days, period_median_likes, sales_per_month, liquidity_score"


@q(_sql(f"SELECT {_RANK_COLUMNS} FROM ranked", *_RANK))
def recompute_rank(spark, sf_dir):
    """Smoothed rates and the score over the policy's period."""
    return wide(spark, sf_dir).select(*_RANK_COLUMNS.split(", "))


_LIMIT_SQL = ", ".join(f"quantile_cont({c}, {z}) AS {n}" for n, (c, z) in {"hot": ("liquidity_score", 0.9), "slow_days": ("median_days_to_sell", 0.75), "slow_p30": ("p30", 0.25), "crowded": ("saturation", 0.8)}.items())
_BADGED = f"""shown AS (SELECT r.*, active_fresh * 3 / nullif(sold_90d, 0)::DOUBLE AS saturation, (p75 - p25) / nullif(p50, 0) AS spread FROM ranked r LEFT JOIN (SELECT * FROM prices WHERE bucket = 'all') USING (scope_key) WHERE level = 'brand' OR level = 'type'),
sampled AS (SELECT *, count(*) OVER (PARTITION BY level, section) AS held FROM shown WHERE sold_90d >= 5),
own AS (SELECT level, section, {_LIMIT_SQL} FROM sampled WHERE held >= 5 GROUP BY level, section),
whole AS (SELECT level, {_LIMIT_SQL} FROM sampled GROUP BY level),
limited AS (SELECT s.*, CASE WHEN o.level IS NULL THEN w.hot ELSE o.hot END AS hot, CASE WHEN o.level IS NULL THEN w.slow_days ELSE o.slow_days END AS slow_days, CASE WHEN o.level IS NULL THEN w.slow_p30 ELSE o.slow_p30 END AS slow_p30, CASE WHEN o.level IS NULL THEN w.crowded ELSE o.crowded END AS crowded
  FROM shown s LEFT JOIN own o ON o.level = s.level AND o.section = s.section LEFT JOIN whole w ON w.level = s.level)"""


@q(_sql("""SELECT scope_key, saturation, spread, concat_ws(',', CASE WHEN sold_90d >= 10 AND liquidity_score > 0 AND liquidity_score >= hot THEN 'hot' END, CASE WHEN sold_90d < 5 THEN 'low_data' END, CASE WHEN sold_90d >= 5 AND saturation > 0 AND saturation >= crowded THEN 'saturated' END,
  CASE WHEN sold_90d >= 5 AND median_days_to_sell > 0 AND median_days_to_sell >= slow_days AND p30 <= slow_p30 THEN 'slow' END, CASE WHEN sold_90d >= 30 AND spread <= 0.35 THEN 'stable' END) AS badges FROM limited""", *_RANK, _STATS, _BADGED))
def recompute_badges(spark, sf_dir):
    """Badges of brands and of types, the levels whose scopes have sales enough here."""
    rows = wide(spark, sf_dir)
    both = W.badged(rows.filter("level = 'brand'"), least=5).unionByName(W.badged(rows.filter("level = 'type'"), least=5))
    return both.select("scope_key", "saturation", "spread", F.array_join("badges", ",").alias("badges"))


_DEALS = f"""offered AS (SELECT f.listing_id, price, condition, f.brand_id, f.seller, is_lot OR marked AS flagged, r.liquidity_score, coalesce(p.n, 0) AS n, p.p25, p.p50, d.seller IS NOT NULL AS wholesale, f.product_type, f.line
  FROM facts f LEFT JOIN dormant d ON d.brand_id = f.brand_id AND d.seller = f.seller LEFT JOIN ranked r ON r.scope_key = 'type:' || f.brand_id || ':' || f.product_type LEFT JOIN prices p ON p.scope_key = r.scope_key AND p.bucket = f.cond WHERE f.status = 'active'),
netted AS (SELECT *, n >= 5 AND p25 > 0 AND p50 > 0 AND price > 0 AS known, round(CAST(p50 AS DECIMAL(14,4)) - round(greatest(CAST(p50 AS DECIMAL(14,4)) * CASE WHEN p50 >= 120 THEN 0.09 ELSE 0.06 END, 1.99), 2) - round(CAST(p50 AS DECIMAL(14,4)) * 0.0349 + 0.49, 2), 2) AS got FROM offered),
resold AS (SELECT *, CASE WHEN known THEN CAST(got AS DOUBLE) END AS net, CASE WHEN known THEN {up("CAST(got AS DOUBLE) / CAST(price + 9.5 AS DOUBLE) - 1", 4)} END AS roi FROM netted),
judged AS (SELECT listing_id, net, roi, list_filter([
  CASE WHEN line = 'rod' THEN 'fallback' END, CASE WHEN line <> 'rod' AND line = 'gear' THEN 'ignored_group' END, CASE WHEN line <> 'rod' AND length(line) = 4 THEN 'retired' END, CASE WHEN line <> 'rod' AND NOT (line = 'plate' OR product_type = 'SMALL' OR brand_id >= 10) THEN 'unproven_group' END, CASE WHEN line <> 'rod' AND coalesce(liquidity_score < 50, true) THEN 'illiquid' END,
  CASE WHEN wholesale THEN 'wholesaler' END, CASE WHEN NOT (seller % 9 >= 5 AND seller % 11 >= 5 OR seller % 7 = 0) THEN 'unrated_seller' END, CASE WHEN flagged THEN 'quality_flags' END, CASE WHEN NOT coalesce(known, false) THEN 'few_sales' END,
  CASE WHEN known AND price > p25 THEN 'above_p25' END, CASE WHEN known AND price < p50 * 0.3 THEN 'too_cheap' END, CASE WHEN known AND roi < 0.2 THEN 'thin_margin' END], lambda x: x IS NOT NULL) AS reasons FROM resold)"""
_DEAL_PARTS = (*_RANK, _STATS, _DEALS)


def judged(spark, sf_dir) -> DataFrame:
    return judge_rows(market(spark, sf_dir)[0], wide(spark, sf_dir))


def judge_rows(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Decisions on active listings by their type's row; what the tables lack comes from rules."""
    scopes = stored(scopes.filter("level = 'type'").select("brand_id", "product_type", "pricing", "liquidity_score"), "types")
    sellers = stored(W.wholesalers(rows, stock=STOCK).select("brand_id", "seller", F.lit(True).alias("wholesale")), "sellers")
    active = rows.filter((F.col("status") == "active") & ~F.array_contains("flags", W.REPLICA)).join(sellers, ["brand_id", "seller"], "left").join(scopes, ["brand_id", "product_type"], "left")
    n = F.col("seller")
    offers = active.withColumns({
        "wholesale": F.coalesce("wholesale", F.lit(False)), "shipping": D.money("9.5"), "kind": F.when(F.col("line") == "rod", "none").otherwise("model"),
        "group_status": F.when(F.col("line") == "gear", "ignored").when(F.col("line") == "plate", "confirmed").otherwise("auto"), "retired": F.length("line") == 4, "source": F.when(F.col("product_type") == "SMALL", "seed").otherwise("auto"), "support": F.col("brand_id"),
        "ratings": n % 9, "rating": 4 + (n % 11) / F.lit(10.0), "trusted": n % 7 == 0,
    })
    return D.decide(offers, sales=5)


@q(_sql("SELECT listing_id, net, roi, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS deal FROM judged", *_DEAL_PARTS))
def recompute_deals(spark, sf_dir):
    """Every active listing judged by the prices of its own condition."""
    return judged(spark, sf_dir).select("listing_id", "net", "roi", F.array_join("reasons", ",").alias("reasons"), "deal")


_HELD = f"""held AS (SELECT listing_id, 0.5::DOUBLE AS roi, TIMESTAMP '1998-05-01' AS found_at, CASE listing_id % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'bad' END AS verdict FROM facts WHERE listing_id % 7 = 0),
kept AS (SELECT listing_id, coalesce(CASE WHEN len(reasons) = 0 THEN j.roi END, h.roi) AS roi, coalesce(found_at, {NOW}) AS found_at, verdict FROM held h FULL JOIN (SELECT * FROM judged WHERE len(reasons) = 0 OR listing_id % 7 = 0) j USING (listing_id)
  WHERE verdict IS NOT NULL OR len(j.reasons) = 0)"""


def _stored_deals(spark, sf_dir) -> DataFrame:
    """A listing's brand stays, so the deals of some brands are stored at a time."""
    scopes, n = wide(spark, sf_dir), F.col("listing_id")

    def of(rows: DataFrame) -> DataFrame:
        fresh = stored(judge_rows(rows, scopes).select("listing_id", "roi", "deal"), "judged")
        raw = rows.filter(~F.array_contains("flags", W.REPLICA))
        before = raw.filter(n % 7 == 0).select("listing_id", F.lit(0.5).cast("decimal(24,4)").alias("roi"), moment(datetime(1998, 5, 1)).alias("found_at"), F.when(n % 3 == 0, "good").when(n % 3 == 1, "bad").alias("verdict"))
        return D.store_deals(before, fresh, raw.filter("status = 'active'"), moment(AS_OF))

    return gathered(spark, [lambda rows=rows: of(rows) for rows in by_brand(market(spark, sf_dir)[0], parts(spark, sf_dir))], "deals")


@q(_sql("SELECT listing_id, roi, CAST(found_at AS VARCHAR) AS found_at, verdict FROM kept", *_DEAL_PARTS, _HELD))
def deals_stored(spark, sf_dir):
    """Deals after a scan over those held before."""
    return _stored_deals(spark, sf_dir)


@q(_sql(f"SELECT count(*) AS deals, count(*) FILTER (verdict = 'good') AS good, count(*) FILTER (verdict = 'bad') AS bad, count(*) FILTER (verdict IS NULL) AS unrated, {up(over('count(*) FILTER (verdict = ' + chr(39) + 'good' + chr(39) + ')', 'count(verdict)'), 4)} AS hit_rate FROM kept", *_DEAL_PARTS, _HELD))
def deal_verdicts(spark, sf_dir):
    return D.verdicts(_stored_deals(spark, sf_dir))


_SNAPS = """snaps AS (SELECT scope_key, brand_id, DATE '1998-06-01' AS day, sold_90d, active_now, p30, liquidity_score FROM ranked WHERE level <> 'model' OR sold_90d >= 1 OR active_now >= 20),
older AS (SELECT scope_key, brand_id, d AS day, sold_90d + 1 AS sold_90d, active_now, p30, liquidity_score FROM ranked CROSS JOIN (SELECT unnest([DATE '1998-06-01', DATE '1998-05-31', DATE '1996-06-01', DATE '1996-05-01']) AS d) WHERE level = 'type')"""


@q(_sql("SELECT scope_key, brand_id, CAST(day AS VARCHAR) AS day, sold_90d, active_now, p30, liquidity_score FROM snaps UNION ALL SELECT scope_key, brand_id, CAST(day AS VARCHAR), sold_90d, active_now, p30, liquidity_score FROM older WHERE day NOT IN (DATE '1998-06-01', DATE '1996-05-01')", *_RANK, _SNAPS))
def snapshots_replaced(spark, sf_dir):
    """A day's snapshot written over the history: the day replaced, what is over two years old gone."""
    rows = wide(spark, sf_dir)
    fresh = W.snapshot(rows, AS_OF).select("scope_key", "brand_id", "day", "sold_90d", "active_now", "p30", "liquidity_score")
    days = F.explode(F.array(*(F.lit(d).cast("date") for d in ("1998-06-01", "1998-05-31", "1996-06-01", "1996-05-01"))))
    held = rows.filter("level = 'type'").select("scope_key", "brand_id", days.alias("day"), (F.col("sold_90d") + 1).alias("sold_90d"), "active_now", "p30", "liquidity_score")
    return W.replace_snapshot(held, fresh, AS_OF)


@q(_sql(f"""SELECT r.scope_key, p.n, p.gmv, {", ".join(f"CASE WHEN lent THEN t.{c} ELSE p.{c} END AS {c}" for c in W.MEDIANS)}, p.fresh_n, p.fresh_ask_p50, CASE WHEN lent AND p.fresh_ask_p50 IS NOT NULL THEN {even("p.fresh_ask_p50 / nullif(t.p50, 0) - 1 + 2", 4)} - 2 ELSE p.fresh_ask_premium END AS premium, lent AS approximate
FROM (SELECT *, CASE WHEN level IN ('model', 'line') THEN 'type:' || brand_id || ':' || product_type END AS parent FROM ranked) r JOIN prices p ON p.scope_key = r.scope_key AND p.bucket = 'used' LEFT JOIN prices t ON t.scope_key = parent AND t.bucket = 'used', LATERAL (SELECT p.p50 IS NULL AND t.p50 IS NOT NULL AS lent)""", *_RANK, _STATS))
def price_fallbacks(spark, sf_dir):
    """The used bucket of every scope, with the type's medians where the own are missing."""
    rows = W.price_bucket(wide(spark, sf_dir), "used").filter("price is not null").select("scope_key", "price.*").withColumnRenamed("fresh_ask_premium", "premium")
    return _plain(rows.withColumn("premium", F.round(F.col("premium").cast("double"), 4)))


_QUERY = T.TrendQuery(level="type", window=90, brand_ids=(1, 2, 3, 4, 5, 6, 7, 8), price_min=500, hide_low_data=True, condition="used", sort="speed", search="s")


@q(_sql("""SELECT scope_key, sold, price, median_days_to_sell, liquidity_score, label, place, total FROM (SELECT *, CAST(row_number() OVER (ORDER BY median_days_to_sell ASC NULLS LAST, sold_30d DESC, scope_key) AS INT) AS place, count(*) OVER () AS total
  FROM (SELECT r.*, sold_90d AS sold, median_price_90d AS price, r.product_type AS label FROM ranked r JOIN prices p ON p.scope_key = r.scope_key AND p.bucket = 'used' AND p.n > 0
  WHERE level = 'type' AND r.brand_id BETWEEN 1 AND 8 AND median_price_90d >= 500 AND sold_90d >= 5 AND liquidity_score IS NOT NULL AND lower(product_type) LIKE '%s%')) WHERE place BETWEEN 4 AND 13""", *_RANK, _STATS))
def trends_filtered(spark, sf_dir):
    """A page of the filtered list, fastest first, with the count of all that match."""
    return T.page(T.select(wide(spark, sf_dir).withColumn("label", F.col("product_type")), _QUERY), _QUERY, limit=10, offset=3).select("scope_key", "sold", "price", "median_days_to_sell", "liquidity_score", "label", "place", "total")


_BY_MONTH = T.TrendQuery(level="line", window=7, include_unranked=True, section="S", min_sales=2, new_only=False, months=("1998-01", "1998-04"), condition="new", sort="sales")


@q(_sql(f"""SELECT r.scope_key, t.sold, t.price, r.sold_7d, coalesce(r.median_price_7d, r.median_price_30d) AS shown_price FROM ranked r JOIN (SELECT scope_key, CAST(sum(n) AS BIGINT) AS sold, {up("sum(p50 * n) / sum(n) FILTER (p50 IS NOT NULL)", 2)} AS price FROM months WHERE bucket = 'new' AND month BETWEEN DATE '1998-01-01' AND DATE '1998-04-01' GROUP BY scope_key) t USING (scope_key)
WHERE level = 'line' AND section = 'S' AND t.sold >= 2""", *_RANK, _MONTHLY))
def trends_of_months(spark, sf_dir):
    """Lines by the sales of a range of months instead of a window."""
    found = T.select(wide(spark, sf_dir).withColumn("label", F.col("scope_key")), _BY_MONTH, months(spark, sf_dir))
    return found.select("scope_key", "sold", "price", "sold_7d", F.coalesce("median_price_7d", "median_price_30d").alias("shown_price"))
