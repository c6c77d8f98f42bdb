"""Queries over scopes and ranks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.operators import ranking as R
from souk.operators import scopes as S
from souk.plans.sql import DAYS, NOW, PRICE, even, over, quantile, query, sold, up
from souk.sources.listings import kept, listings
from souk.sources.scratch import stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and times as text: types that any engine compares alike."""
    return df.select(*(F.col(c).cast("double").alias(c) if kind.startswith("decimal") else F.col(c).cast("string").alias(c) if kind.startswith(("date", "timestamp")) else F.col(c) for c, kind in df.dtypes))


def register(queries: dict, oracle: dict, sql: str | None = None):
    def add(f):
        queries[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            oracle[f.__name__] = sql
        return f

    return add


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fan_out(listings(spark, sf_dir))


q = lambda sql=None: register(QUERIES, ORACLE, sql)

_COUNTS = f"""level, scope_key, count(*) FILTER ({sold(7)}) AS sold_7d, count(*) FILTER ({sold(30)}) AS sold_30d,
  count(*) FILTER (status = 'sold' AND sold_at < {NOW} - INTERVAL 30 DAY AND sold_at >= {NOW} - INTERVAL 60 DAY) AS sold_prev_30d,
  count(*) FILTER ({sold(90)}) AS sold_90d, count(*) FILTER (status = 'active') AS active_now,
  count(*) FILTER (status = 'active' AND listed_at >= {NOW} - INTERVAL 14 DAY) AS new_14d"""
_MEDIANS = f"""{quantile(PRICE, where=sold(30))} AS median_price_30d, {quantile(PRICE, where=sold(90))} AS median_price_90d,
  {quantile(DAYS, where=sold(90) + " AND exact_sale")} AS median_days_to_sell, {quantile("likes", places=1, where=sold(90))} AS median_likes"""


@q(query(f"SELECT {_COUNTS} FROM scoped GROUP BY level, scope_key"))
def scope_window_counts(spark, sf_dir):
    return S.window_counts(scoped(spark, sf_dir))


@q(query(f"SELECT level, scope_key, {_MEDIANS} FROM scoped GROUP BY level, scope_key"))
def scope_medians(spark, sf_dir):
    return S.medians(scoped(spark, sf_dir))


@q(query(f"""SELECT scope_key, week, coalesce(n, 0) AS n, median_price
FROM (SELECT DISTINCT scope_key FROM recent) CROSS JOIN (SELECT unnest(range(12))::INT AS week)
LEFT JOIN (SELECT scope_key, week, count(*) AS n, {quantile(PRICE)} AS median_price FROM recent GROUP BY scope_key, week) USING (scope_key, week)""",
         more=f"recent AS (SELECT *, 11 - CAST(floor(epoch({NOW} - sold_at) / 604800.0) AS INT) AS week FROM scoped WHERE status = 'sold' AND sold_at <= {NOW} AND sold_at > {NOW} - INTERVAL 84 DAY)"))
def scope_weekly_series(spark, sf_dir):
    return S.weekly_series(scoped(spark, sf_dir))


@q(query(f"""SELECT scope_key, period, count(*) AS sold, {quantile(PRICE)} AS median_price, {quantile(DAYS, where="exact_sale")} AS median_days, {quantile("likes", places=1)} AS median_likes
FROM scoped JOIN (SELECT unnest([7, 14, 30, 60, 90, 180, 365])::INT AS period) ON status = 'sold' AND sold_at <= {NOW} AND sold_at >= {NOW} - to_days(period) GROUP BY scope_key, period"""))
def period_windows(spark, sf_dir):
    return S.period_windows(scoped(spark, sf_dir))


@q(query(f"""SELECT scope_key, variant, sold_90d, active, sell_through, CAST(row_number() OVER (PARTITION BY scope_key ORDER BY sold_90d DESC, sell_through DESC, variant) AS INT) AS place
FROM (SELECT scope_key, color AS variant, count(*) FILTER ({sold(90)}) AS sold_90d, count(*) FILTER (status = 'active') AS active,
  {even(over(f"count(*) FILTER ({sold(90)})", f"count(*) FILTER ({sold(90)}) + count(*) FILTER (status = 'active')"), 4)} AS sell_through FROM scoped GROUP BY ALL)
WHERE sold_90d + active > 0 QUALIFY place <= 12"""))
def variant_topk(spark, sf_dir):
    return S.variants(scoped(spark, sf_dir), "color")


_COHORT = f"(listed_at <= {NOW} - INTERVAL 30 DAY AND listed_at >= {NOW} - INTERVAL 120 DAY)"
_QUICK = f"({_COHORT} AND status = 'sold' AND sold_at <= {NOW} AND sold_at <= listed_at + INTERVAL 30 DAY)"
_P30 = f"count(*) FILTER ({_COHORT}) AS p30_cohort, count(*) FILTER ({_QUICK}) AS p30_sold"


@q(query(f"SELECT level, scope_key, {_P30} FROM scoped GROUP BY level, scope_key"))
def p30_counts(spark, sf_dir):
    return S.p30_counts(scoped(spark, sf_dir))


@q(query(f"""SELECT scope_key, size, p30_cohort, p30_sold, p30, scope_p30, p30_cohort >= 10 AND p30 >= scope_p30 AS hot
FROM (SELECT *, {up(over("p30_sold", "p30_cohort"), 6)} AS p30 FROM (SELECT scope_key, size, {_P30} FROM scoped GROUP BY scope_key, size) WHERE p30_cohort > 0)
JOIN (SELECT scope_key, {up(over(f"count(*) FILTER ({_QUICK})", f"count(*) FILTER ({_COHORT})"), 6)} AS scope_p30 FROM scoped GROUP BY scope_key) USING (scope_key)"""))
def size_p30_hot(spark, sf_dir):
    return S.hot_sizes(scoped(spark, sf_dir))


@q(query("""SELECT scope_key, department, n FROM (SELECT scope_key, department, count(*) AS n FROM scoped GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY scope_key ORDER BY n DESC, department) = 1"""))
def majority_department(spark, sf_dir):
    return S.majority(scoped(spark, sf_dir), "department")


@q(query("""SELECT scope_key, listing_id FROM far JOIN (SELECT scope_key, quantile_cont(off, 0.5) AS mad FROM far GROUP BY scope_key) USING (scope_key) WHERE off > greatest(4 * 1.4826 * mad, ln(3))""",
         more=f"""priced AS (SELECT scope_key, listing_id, ln(CAST({PRICE} AS DOUBLE)) AS v FROM scoped WHERE {sold(90)} AND {PRICE} > 0),
far AS (SELECT scope_key, listing_id, abs(v - centre) AS off FROM priced JOIN (SELECT scope_key, quantile_cont(v, 0.5) AS centre FROM priced GROUP BY scope_key HAVING count(*) >= 8) USING (scope_key))"""))  # fmt: skip
def price_outliers_mad(spark, sf_dir):
    return S.outliers(scoped(spark, sf_dir))


_ASK = f"(status = 'active' AND listed_at <= {NOW} AND listed_at >= {NOW} - INTERVAL 60 DAY)"


@q(query(f"""SELECT *, {up("CAST(ask_p50 AS DOUBLE) / nullif(p50, 0) - 1", 4)} AS premium FROM (
SELECT level, scope_key, bucket, n, gmv, asks, {", ".join(f"CASE WHEN n >= 5 THEN {c} END AS {c}" for c in ("p25", "p50", "p75", "offer_discount", "total_markdown"))}, CASE WHEN asks >= 5 THEN ask_p50 END AS ask_p50 FROM (
SELECT level, scope_key, bucket, count(*) FILTER ({sold(90)}) AS n, CAST(sum({PRICE}) FILTER ({sold(90)}) AS DOUBLE) AS gmv,
  {", ".join(f"{quantile(PRICE, qq, where=sold(90))} AS p{int(100 * qq)}" for qq in (0.25, 0.5, 0.75))},
  {quantile("1 - " + over("sold_price", "price"), places=4, where=sold(90))} AS offer_discount, {quantile("1 - " + over(PRICE, "price_initial"), places=4, where=sold(90))} AS total_markdown,
  count(*) FILTER ({_ASK}) AS asks, {quantile("price", where=_ASK)} AS ask_p50
FROM (SELECT *, unnest(['all', CASE WHEN condition = 'is_new' THEN 'new' ELSE 'used' END]) AS bucket FROM scoped) GROUP BY level, scope_key, bucket) WHERE n + asks > 0)"""))
def pricing_buckets(spark, sf_dir):
    return S.pricing(scoped(spark, sf_dir))


_DORMANT = f"""dormant AS (SELECT brand_id, seller, count(*) FILTER (status = 'active') AS active, count(*) FILTER ({sold(365)}) AS sold_365 FROM listings GROUP BY brand_id, seller
HAVING count(*) FILTER (status = 'active') >= 5 AND count(*) FILTER ({sold(365)}) < 0.01 * (count(*) FILTER ({sold(365)}) + count(*) FILTER (status = 'active')))"""


@q(query("SELECT * FROM dormant", scoped=False, more=_DORMANT))
def dormant_wholesalers(spark, sf_dir):
    return S.wholesalers(listings(spark, sf_dir), stock=5)


@q(query(f"""SELECT level, scope_key, count(*) AS active, count(*) FILTER (d.seller IS NULL) AS effective, count(*) FILTER (d.seller IS NULL AND greatest(listed_at, touched_at) >= {NOW} - INTERVAL 60 DAY) AS fresh
FROM scoped s LEFT JOIN dormant d ON s.brand_id = d.brand_id AND s.seller = d.seller WHERE status = 'active' GROUP BY level, scope_key""", more=_DORMANT))
def supply_counts(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return S.supply(S.fan_out(rows), S.wholesalers(rows, stock=5))


@q(query(f"""SELECT level, scope_key, {up("(sold_30d - sold_prev_30d) / nullif(CAST(sold_prev_30d AS DOUBLE), 0)", 4)} AS growth, {even(over("sold_30d", "sold_30d + active_now"), 6)} AS sell_through_30d, {up("sold_90d / 90.0::DOUBLE", 4)} AS sold_a_day
FROM (SELECT {_COUNTS} FROM scoped GROUP BY level, scope_key)"""))
def growth_speed_sellthrough(spark, sf_dir):
    return S.trends(scoped(spark, sf_dir))


def _smooth(k: str, n: str, p: str) -> str:
    return up(f"least(greatest(({k} + 20.0::DOUBLE * {p}) / ({n} + 20.0::DOUBLE), 0), 1)", 6)


_SMOOTHED = f"""counted AS (SELECT level, scope_key, brand_id, CASE WHEN level <> 'brand' THEN product_type END AS product_type, {_P30} FROM scoped GROUP BY ALL),
overall AS (SELECT {up(over("sum(p30_sold)", "sum(p30_cohort)"), 6)} AS p FROM counted WHERE level = 'brand'),
across AS (SELECT product_type, {_smooth("s", "c", "coalesce(p, 0)")} AS p FROM (SELECT product_type, sum(p30_sold) AS s, sum(p30_cohort) AS c FROM counted WHERE level = 'type' GROUP BY product_type) CROSS JOIN overall),
types AS (SELECT counted.*, {_smooth("p30_sold", "p30_cohort", "p")} AS p30 FROM counted JOIN across USING (product_type) WHERE level = 'type'),
smoothed AS (SELECT counted.*, {_smooth("p30_sold", "p30_cohort", "coalesce(p, 0)")} AS p30 FROM counted CROSS JOIN overall WHERE level = 'brand'
  UNION ALL BY NAME SELECT * FROM types
  UNION ALL BY NAME SELECT m.*, {_smooth("m.p30_sold", "m.p30_cohort", "t.p30")} AS p30 FROM counted m JOIN types t ON m.brand_id = t.brand_id AND m.product_type = t.product_type WHERE m.level = 'model')"""
_EXPECTED = up("least(greatest(CASE WHEN p30 <= 0 THEN 365.0 WHEN p30 >= 1 THEN 7.0 ELSE -30.0::DOUBLE / ln(1 - p30) END, 7), 365)", 2)


@q(query(f"SELECT *, {_EXPECTED} AS expected_days FROM smoothed", more=_SMOOTHED))
def p30_smoothed(spark, sf_dir):
    return R.smoothed_p30(scoped(spark, sf_dir)).withColumn("expected_days", R.expected_days(F.col("p30")))


def _mid(x: str, lower: bool = False) -> str:
    return f"((rank() OVER (PARTITION BY level ORDER BY {x} {'DESC' if lower else 'ASC'}) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY level, {x})) / count(*) OVER (PARTITION BY level))"


_RANKED = f"""ranked AS (SELECT *, {up(f"100 * (0.4::DOUBLE * {_mid('sold_90d')} + 0.25::DOUBLE * {_mid('median_days_to_sell', True)} + 0.2::DOUBLE * {_mid('coalesce(median_likes, 0)')} + 0.15::DOUBLE * {_mid('median_price_90d')})", 2)} AS liquidity_score
FROM (SELECT {_COUNTS}, {_MEDIANS}, {up("count(*) FILTER (" + sold(90) + ") / 3.0::DOUBLE", 1)} AS sales_per_month FROM scoped GROUP BY level, scope_key)
WHERE sales_per_month >= 1 AND median_price_90d >= 150 AND median_days_to_sell IS NOT NULL)"""
#: The fixture tables are small, so fewer sales make a scope eligible.
POLICY = R.Policy(min_sales_per_month=1)


@q(query("SELECT * FROM ranked", more=_RANKED))
def liquidity_rank(spark, sf_dir):
    return R.liquidity(R.candidates(scoped(spark, sf_dir)), POLICY)


def badge_rows(spark, sf_dir):
    rows = kept(spark, sf_dir)
    by_scope = S.fan_out(rows).filter("level = 'model'")
    dormant = stored(S.wholesalers(rows, stock=5), "dormant")
    counts = S.window_counts(by_scope).join(S.medians(by_scope).drop("level"), "scope_key").join(S.supply(by_scope, dormant).drop("level", "active", "effective"), "scope_key", "left")
    p30 = R.smoothed_p30(S.fan_out(rows)).filter("level = 'model'").select("scope_key", "p30")
    score = R.liquidity(R.candidates(by_scope), POLICY).select("scope_key", "liquidity_score")
    price = S.pricing(by_scope).filter("bucket = 'all'").select("scope_key", ((F.col("p75") - F.col("p25")).cast("double") / F.nullif("p50", F.lit(0)).cast("double")).alias("spread"))
    out = counts.join(p30, "scope_key", "left").join(score, "scope_key", "left").join(price, "scope_key", "left")
    return out.select("scope_key", F.split("scope_key", ":")[2].alias("section"), "sold_90d", "liquidity_score", "p30", "median_days_to_sell", F.coalesce("fresh", F.lit(0)).alias("fresh"), "spread")


_LIMITS = {"score_p90": ("liquidity_score", 0.9), "days_p75": ("median_days_to_sell", 0.75), "p30_p25": ("p30", 0.25), "saturation_p80": ("saturation", 0.8)}
_LIMIT_SQL = ", ".join(f"{up(f'quantile_cont({c}, {qq})', 6)} AS {n}" for n, (c, qq) in _LIMITS.items())


@q(query(f"""SELECT scope_key, section, sold_90d, liquidity_score, p30, median_days_to_sell, fresh, spread, saturation, concat_ws(',',
  CASE WHEN sold_90d >= 10 AND liquidity_score > 0 AND liquidity_score >= score_p90 THEN 'hot' END,
  CASE WHEN sold_90d < 5 THEN 'low_data' END,
  CASE WHEN sold_90d >= 5 AND saturation > 0 AND saturation >= saturation_p80 THEN 'saturated' END,
  CASE WHEN sold_90d >= 5 AND median_days_to_sell > 0 AND median_days_to_sell >= days_p75 AND p30 <= p30_p25 THEN 'slow' END,
  CASE WHEN sold_90d >= 30 AND spread <= 0.35 THEN 'stable' END) AS badges
FROM (SELECT r.*, {", ".join(f"coalesce(o.{n}, a.{n}) AS {n}" for n in _LIMITS)} FROM facts r LEFT JOIN (SELECT section, {_LIMIT_SQL} FROM facts WHERE sold_90d >= 5 GROUP BY section HAVING count(*) >= 5) o USING (section) CROSS JOIN (SELECT {_LIMIT_SQL} FROM facts WHERE sold_90d >= 5) a)""",
         more=f"""{_DORMANT}, {_SMOOTHED}, {_RANKED},
facts AS (SELECT b.scope_key, split_part(b.scope_key, ':', 3) AS section, b.sold_90d, liquidity_score, p30, b.median_days_to_sell, coalesce(fresh, 0) AS fresh, spread, coalesce(fresh, 0) * 3 / nullif(CAST(b.sold_90d AS DOUBLE), 0) AS saturation
FROM (SELECT {_COUNTS}, {_MEDIANS} FROM scoped WHERE level = 'model' GROUP BY level, scope_key) b
LEFT JOIN (SELECT scope_key, count(*) FILTER (d.seller IS NULL AND greatest(listed_at, touched_at) >= {NOW} - INTERVAL 60 DAY) AS fresh FROM scoped s LEFT JOIN dormant d ON s.brand_id = d.brand_id AND s.seller = d.seller WHERE status = 'active' AND level = 'model' GROUP BY scope_key) USING (scope_key)
LEFT JOIN (SELECT scope_key, p30 FROM smoothed WHERE level = 'model') USING (scope_key)
LEFT JOIN (SELECT scope_key, liquidity_score FROM ranked WHERE level = 'model') USING (scope_key)
LEFT JOIN (SELECT scope_key, CASE WHEN count(*) >= 5 THEN ({quantile(PRICE, 0.75)} - {quantile(PRICE, 0.25)}) / nullif({quantile(PRICE)}, 0) END AS spread FROM scoped WHERE {sold(90)} AND level = 'model' GROUP BY scope_key) USING (scope_key))"""))  # fmt: skip
def badges(spark, sf_dir):
    return R.badges(badge_rows(spark, sf_dir), sample=5)
