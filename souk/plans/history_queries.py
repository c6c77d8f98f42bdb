"""Queries over months, seasons, snapshots, offers and the past."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from souk.functions.exprs import AS_OF, half_up, moment
from souk.operators import deals as D
from souk.operators import history as H
from souk.operators import ranking as R
from souk.operators import scopes as S
from souk.operators import seasons as N
from souk.plans.market_queries import _COUNTS, _DORMANT, _MEDIANS, _RANKED, POLICY, register, scoped
from souk.plans.sql import NOW, PRICE, even, over, quantile, query, sold, up
from souk.sources.listings import kept, listings, table
from souk.sources.scratch import stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
q = lambda sql=None: register(QUERIES, ORACLE, sql)

_SALES = f"sales AS (SELECT *, CAST(date_trunc('month', sold_at) AS DATE) AS month FROM listings WHERE status = 'sold' AND sold_at <= {NOW})"
_MONTHS = f"""months AS (SELECT scope_key, month, bucket, count(*) AS n, sum({PRICE}) AS gmv, {", ".join(f"{quantile(PRICE, x)} AS p{int(100 * x)}" for x in (0.25, 0.5, 0.75))}
FROM (SELECT *, CAST(date_trunc('month', sold_at) AS DATE) AS month, unnest(['all', CASE WHEN condition = 'is_new' THEN 'new' ELSE 'used' END]) AS bucket FROM scoped WHERE status = 'sold' AND sold_at <= {NOW}) GROUP BY ALL)"""


@q(query("SELECT scope_key, CAST(month AS VARCHAR) AS month, bucket, n, CAST(gmv AS DOUBLE) AS gmv, p25, p50, p75 FROM months", more=_MONTHS))
def month_stats(spark, sf_dir):
    return N.month_stats(scoped(spark, sf_dir))


@q(query(f"""SELECT scope_key, CAST(sum(n) AS BIGINT) AS sold, {up("sum(p50 * n) / sum(n)", 2)} AS price FROM months
WHERE bucket = 'all' AND month BETWEEN DATE '1997-01-01' AND DATE '1997-12-01' GROUP BY scope_key""", more=_MONTHS))
def period_totals(spark, sf_dir):
    return N.period_totals(N.month_stats(scoped(spark, sf_dir)), "1997-01-01", "1997-12-01")


@q(query("""SELECT CAST(month AS VARCHAR) AS month, (SELECT count(DISTINCT brand_id) FROM sales s WHERE s.month = g.month) AS brands, (SELECT count(*) FROM firsts WHERE first > g.month) AS late
FROM (SELECT CAST(unnest(generate_series(DATE '1994-11-01', DATE '1996-06-01', INTERVAL 1 MONTH)) AS DATE) AS month) g""", scoped=False, more=_SALES + ", firsts AS (SELECT brand_id, min(month) AS first FROM sales GROUP BY brand_id)"))
def month_coverage(spark, sf_dir):
    return N.month_coverage(N.sales(listings(spark, sf_dir)), "1994-11-01", "1996-06-01")


_GROUPED = (
    _SALES
    + """, covered AS (SELECT brand_id, CAST(unnest(generate_series(min(month) + INTERVAL 1 MONTH, DATE '1998-05-01', INTERVAL 1 MONTH)) AS DATE) AS month FROM sales GROUP BY brand_id),
inside AS (SELECT s.* FROM sales s SEMI JOIN covered c ON s.brand_id = c.brand_id AND s.month = c.month),
counts AS (SELECT 'market' AS kind, 'market' AS key, NULL AS product_type, month, count(*) AS n FROM inside GROUP BY month
  UNION ALL SELECT 'type', product_type, product_type, month, count(*) FROM inside GROUP BY product_type, month
  UNION ALL SELECT 'department', product_type || ':' || department, product_type, month, count(*) FROM inside GROUP BY product_type, department, month
  UNION ALL SELECT 'brand', product_type || ':' || brand_id, product_type, month, count(*) FROM inside GROUP BY product_type, brand_id, month)"""
)


def _counts(spark, sf_dir):
    sold_rows = N.sales(listings(spark, sf_dir))
    covered = N.covered_months(sold_rows)
    return N.grouped_months(sold_rows, covered), covered, sold_rows


@q(query("SELECT kind, key, product_type, CAST(month AS VARCHAR) AS month, n FROM counts", scoped=False, more=_GROUPED))
def season_groups(spark, sf_dir):
    return _counts(spark, sf_dir)[0]


_PROFILE = (
    _GROUPED
    + f""", dense AS (SELECT kind, key, month, coalesce(n, 0) AS n FROM (SELECT DISTINCT kind, key FROM counts) CROSS JOIN (SELECT DISTINCT month FROM covered) LEFT JOIN counts USING (kind, key, month)),
means AS (SELECT kind, key, month(month) AS calendar, avg(n) AS m, sum(n) AS sales FROM dense GROUP BY ALL),
shares AS (SELECT *, m / nullif(avg(m) OVER (PARTITION BY kind, key), 0) AS a, m / nullif(sum(m) OVER (PARTITION BY kind, key), 0) AS s FROM means),
profile AS (SELECT x.kind, x.key, CAST(x.calendar AS INT) AS calendar, CAST(x.sales AS BIGINT) AS sales, {up("x.m", 4)} AS mean, {up("x.a", 4)} AS si_abs, {up("x.s / nullif(k.s, 0)", 4)} AS si_rel FROM shares x JOIN shares k ON k.kind = 'market' AND k.calendar = x.calendar)"""
)


def _profile(spark, sf_dir):
    counts, covered, sold_rows = _counts(spark, sf_dir)
    return N.profiles(counts, covered), sold_rows


@q(query("SELECT * FROM profile", scoped=False, more=_PROFILE))
def season_profiles(spark, sf_dir):
    return _profile(spark, sf_dir)[0]


_SEASONS = _PROFILE + f""", seasons AS (SELECT kind, key, season, CAST(sum(sales) AS BIGINT) AS sales, CASE WHEN sum(sales) >= 20 THEN {up("avg(si_abs)", 4)} END AS index
FROM (SELECT *, CASE WHEN calendar IN (12, 1, 2) THEN 'winter' WHEN calendar IN (3, 4, 5) THEN 'spring' WHEN calendar IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season FROM profile) GROUP BY kind, key, season)"""


@q(query("SELECT * FROM seasons", scoped=False, more=_SEASONS))
def season_index(spark, sf_dir):
    return N.seasons(_profile(spark, sf_dir)[0], minimum=20)


@q(query("SELECT season, key, index, CAST(row_number() OVER (PARTITION BY season ORDER BY index DESC, key) AS INT) AS place FROM seasons WHERE kind = 'type' AND index >= 1.01", scoped=False, more=_SEASONS))
def season_presets(spark, sf_dir):
    return N.presets(N.seasons(_profile(spark, sf_dir)[0], minimum=20), 1.01)


@q(query(f"""SELECT kind, key, CASE WHEN count(*) = 12 AND stddev_pop(new) > 0 AND stddev_pop(old) > 0 THEN {up("corr(new, old)", 4)} END AS stability
FROM (SELECT a.kind, a.key, a.n AS new, b.n AS old FROM placed a JOIN placed b ON a.kind = b.kind AND a.key = b.key AND b.back = a.back + 12 WHERE a.back < 12) GROUP BY kind, key""",
         scoped=False, more=_GROUPED + """, last AS (SELECT month, row_number() OVER (ORDER BY month DESC) - 1 AS back FROM (SELECT DISTINCT month FROM covered) QUALIFY back < 24),
placed AS (SELECT kind, key, back, CAST(coalesce(n, 0) AS DOUBLE) AS n FROM (SELECT DISTINCT kind, key FROM counts) CROSS JOIN last LEFT JOIN counts USING (kind, key, month))"""))  # fmt: skip
def season_yoy_corr(spark, sf_dir):
    counts, covered, _ = _counts(spark, sf_dir)
    return N.year_over_year(counts, covered)


@q(query(f"""SELECT o.key, o.calendar, {up("o.n / (o.n + 300.0::DOUBLE) * coalesce(o.si_abs, 0) + (1 - o.n / (o.n + 300.0::DOUBLE)) * t.si_abs", 4)} AS si_abs
FROM (SELECT *, sum(sales) OVER (PARTITION BY key) AS n FROM profile WHERE kind = 'brand') o JOIN profile t ON t.kind = 'type' AND t.key = split_part(o.key, ':', 1) AND t.calendar = o.calendar""", scoped=False, more=_PROFILE))
def season_blend(spark, sf_dir):
    return N.blend(_profile(spark, sf_dir)[0])


@q(query(f"""SELECT key, sold_30d, {up("sold_30d * (max(si_abs) FILTER (calendar = 9) / nullif(max(si_abs) FILTER (calendar = 6), 0))", 2)} AS forecast
FROM profile JOIN (SELECT product_type AS key, count(*) AS sold_30d FROM sales WHERE sold_at >= {NOW} - INTERVAL 30 DAY GROUP BY product_type) USING (key) WHERE kind = 'type' GROUP BY key, sold_30d""", scoped=False, more=_PROFILE))
def season_forecast(spark, sf_dir):
    profile, sold_rows = _profile(spark, sf_dir)
    return N.forecast(profile, sold_rows, target=9)


_SNAPSHOTS = "snapshots AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, CAST(round(CAST(avg(value) AS DECIMAL(24,8)), 4) AS DOUBLE) AS value FROM events GROUP BY ALL)"
_WATCHED = "watched AS (SELECT DISTINCT user_id, DATE '2024-01-05' + CAST(user_id % 30 AS INT) AS added FROM events)"
_BASE = """base AS (SELECT w.user_id, w.added, coalesce(b.day, a.day) AS day, coalesce(b.n, a.n) AS n, coalesce(b.value, a.value) AS value, CASE WHEN b.day IS NOT NULL THEN 'before' WHEN a.day IS NOT NULL THEN 'after' END AS side
FROM watched w ASOF LEFT JOIN snapshots b ON w.user_id = b.user_id AND w.added >= b.day ASOF LEFT JOIN snapshots a ON w.user_id = a.user_id AND w.added < a.day)"""


def _watched(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    watched = events.select("user_id").distinct().withColumn("added", F.date_add(F.lit("2024-01-05").cast("date"), (F.col("user_id") % 30).cast("int")))
    return H.as_of(watched, H.snapshots(events), "user_id", "added", "day"), H.snapshots(events)


@q(f"WITH {_SNAPSHOTS}, {_WATCHED}, {_BASE} SELECT user_id, CAST(added AS VARCHAR) AS added, CAST(day AS VARCHAR) AS day, n, value, side FROM base")
def snapshot_asof(spark, sf_dir):
    return _watched(spark, sf_dir)[0]


@q(f"""WITH {_SNAPSHOTS}, {_WATCHED}, {_BASE}, now AS (SELECT user_id, max_by(n, day) AS n_now, max_by(value, day) AS value_now FROM snapshots GROUP BY user_id)
SELECT user_id, CAST(day AS VARCHAR) AS day, n, value, n_now, value_now, n_now - n AS n_change, {even(over("value_now", "nullif(value, 0)"), 4)} AS value_ratio FROM base LEFT JOIN now USING (user_id)""")
def watch_changes(spark, sf_dir):
    base, snapshots = _watched(spark, sf_dir)
    return H.watch_changes(base, H.last_of_each(snapshots, "user_id", "day"), "user_id")


_OBSERVED = "(SELECT user_id, event_type, ts, CAST(value AS DECIMAL(14,2)) AS price, event_id FROM events)"


def _observed(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type", "ts", F.col("value").cast("decimal(14,2)").alias("price"), "event_id")


@q(f"SELECT user_id, CAST(ts AS VARCHAR) AS ts, CAST(price AS DOUBLE) AS price, event_type, event_id FROM {_OBSERVED} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def dedup_last(spark, sf_dir):
    rows = _observed(spark, sf_dir)
    return H.last_of_each(rows, "user_id", "ts", "event_id")


@q(f"SELECT user_id, CAST(ts AS VARCHAR) AS ts, CAST(price AS DOUBLE) AS price, event_type, event_id FROM {_OBSERVED} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def dedup_first(spark, sf_dir):
    rows = _observed(spark, sf_dir)
    return H.first_of_each(rows, "user_id", "ts", "event_id")


@q(f"""WITH o AS {_OBSERVED}, old AS (SELECT * FROM o WHERE ts < TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
new AS (SELECT * FROM o WHERE ts >= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, CAST(coalesce(new.price, old.price) AS DOUBLE) AS price, coalesce(old.event_type, new.event_type) AS event_type, greatest(new.event_id, old.event_id) AS event_id,
  CASE WHEN old.user_id IS NULL THEN 'inserted' WHEN new.user_id IS NULL THEN 'kept' ELSE 'updated' END AS change FROM old FULL JOIN new USING (user_id)""")
def upsert_merge(spark, sf_dir):
    rows = _observed(spark, sf_dir)
    cut = moment(datetime(2024, 1, 15))
    old, new = (H.last_of_each(rows.filter(c), "user_id", "ts", "event_id") for c in (F.col("ts") < cut, F.col("ts") >= cut))
    return H.merge(old, new, "user_id", {"price": "new", "event_type": "keep", "event_id": "most"})


@q(f"""SELECT user_id, event_type, event_id, CAST(price AS DOUBLE) AS price, CAST(before AS DOUBLE) AS before FROM (SELECT *, lag(price) OVER w AS before, row_number() OVER w AS k FROM {_OBSERVED} WINDOW w AS (PARTITION BY user_id ORDER BY ts, price)) WHERE k = 1 OR price IS DISTINCT FROM before""")
def price_history(spark, sf_dir):
    return H.price_history(_observed(spark, sf_dir), "user_id", "ts", "price").drop("ts")


@q("SELECT event_id, user_id, event_type FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'purchase') - INTERVAL 2 HOUR")
def incremental_window(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    mark = events.filter("event_type = 'purchase'").agg(F.max("ts").alias("mark"))
    return H.incremental(events.join(F.broadcast(mark)), "ts", F.col("mark")).select("event_id", "user_id", "event_type")


@q(query(f"""SELECT status, now, count(*) AS n FROM (SELECT status, CASE WHEN status = 'active' AND touched_at < {NOW} AND touched_at > {NOW} - INTERVAL 48 HOUR THEN 'removed_pending' WHEN status = 'active' AND touched_at <= {NOW} - INTERVAL 48 HOUR THEN 'removed' ELSE status END AS now FROM listings) GROUP BY ALL""", scoped=False))
def lifecycle(spark, sf_dir):
    rows = listings(spark, sf_dir)
    missing = F.when(F.col("touched_at") < moment(AS_OF), F.col("touched_at"))
    return rows.withColumn("now", H.lifecycle(F.col("status"), missing, moment(AS_OF))).groupBy("status", "now").agg(F.count("*").alias("n"))


_PAST = "TIMESTAMP '1998-05-02'"
PAST = datetime(1998, 5, 2)


@q(query(f"""SELECT brand_id, was, status, count(*) AS n FROM (SELECT brand_id, status, CASE WHEN listed_at > {_PAST} THEN NULL WHEN status = 'sold' AND sold_at <= {_PAST} THEN 'sold' WHEN status = 'removed' AND touched_at <= {_PAST} THEN 'removed' ELSE 'active' END AS was FROM listings) GROUP BY ALL""", scoped=False))
def time_travel_status(spark, sf_dir):
    return listings(spark, sf_dir).withColumn("was", H.status_at(PAST)).groupBy("brand_id", "was", "status").agg(F.count("*").alias("n"))


_BACK_SQL = """past AS (SELECT scope_key, count(*) FILTER (status = 'sold' AND sold_at <= TIMESTAMP '1998-05-02' AND sold_at >= TIMESTAMP '1998-04-02') AS sold_30d,
  count(*) FILTER (status = 'sold' AND sold_at <= TIMESTAMP '1998-05-02' AND sold_at >= TIMESTAMP '1998-02-01') AS sold_90d,
  count(*) FILTER (listed_at <= TIMESTAMP '1998-05-02' AND NOT (status = 'sold' AND sold_at <= TIMESTAMP '1998-05-02') AND NOT (status = 'removed' AND touched_at <= TIMESTAMP '1998-05-02')) AS depth,
  count(*) FILTER (status = 'sold' AND sold_at > TIMESTAMP '1998-05-02' AND sold_at <= TIMESTAMP '1998-06-01') AS future FROM scoped WHERE level = 'type' GROUP BY scope_key HAVING depth >= 5)"""


def _ranked_sql(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}"


@q(query(f"""SELECT metric, n, rho, rho >= max(rho) OVER () - 0.02 AS passed FROM (SELECT metric, count(*) AS n, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(future) > 0 THEN {up("corr(x, future)", 4)} END AS rho
FROM (SELECT future, unnest(['sold_30d', 'sold_90d', 'depth']) AS metric, unnest([sold_30d, sold_90d, depth]) AS x FROM (SELECT {", ".join(map(_ranked_sql, ("sold_30d", "sold_90d", "depth", "future")))} FROM past)) GROUP BY metric)""", more=_BACK_SQL))
def backtest_spearman(spark, sf_dir):
    """How the state 30 days ago ranks types against the sales that followed."""
    rows = scoped(spark, sf_dir).filter("level = 'type'")
    later = (F.col("status") == "sold") & (F.col("sold_at") > moment(PAST)) & (F.col("sold_at") <= moment(AS_OF))
    then = rows.groupBy("scope_key").agg(F.count_if(S.sold(PAST, 30)).alias("sold_30d"), F.count_if(S.sold(PAST, 90)).alias("sold_90d"), F.count_if(H.status_at(PAST) == "active").alias("depth"), F.count_if(later).alias("future")).filter("depth >= 5")
    names = ("sold_30d", "sold_90d", "depth")
    # one row for each scope: the pool of a rank is an aggregate
    ranked = then.select(*(R.average_rank(F.col(c), F.lit(1)).alias(c) for c in (*names, "future")))
    long = ranked.select("future", F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("x")) for c in names))).alias("m")).select("future", "m.metric", "m.x")
    out = long.groupBy("metric").agg(F.count("*").alias("n"), half_up(N.pearson("x", "future"), 4).alias("rho"))
    return out.withColumn("passed", F.col("rho") >= F.max("rho").over(Window.partitionBy(F.lit(1))) - F.lit(0.02).cast("decimal(4,2)"))


_OFFERS = f"""offers AS (SELECT listing_id, CAST(price AS DECIMAL(14,4)) AS buy, l.brand_id % 5 = 0 AS abroad, d.seller IS NOT NULL AS wholesale, p.n, p.p50, r.liquidity_score, CAST(p.p50 AS DECIMAL(14,4)) AS expected, CAST(9.5 AS DECIMAL(14,4)) AS shipping
FROM listings l LEFT JOIN dormant d ON l.brand_id = d.brand_id AND l.seller = d.seller
LEFT JOIN (SELECT scope_key, count(*) AS n, CASE WHEN count(*) >= 5 THEN {quantile(PRICE)} END AS p50 FROM scoped WHERE level = 'type' AND {sold(90)} GROUP BY scope_key) p ON p.scope_key = 'type:' || l.brand_id || ':' || l.product_type
LEFT JOIN (SELECT scope_key, liquidity_score FROM ranked WHERE level = 'type') r ON r.scope_key = 'type:' || l.brand_id || ':' || l.product_type WHERE l.status = 'active'),
fees AS (SELECT *, round(greatest((expected + shipping) * CASE WHEN expected + shipping >= 120 THEN 0.09::DECIMAL(14,4) ELSE 0.06::DECIMAL(14,4) END, 1.99::DECIMAL(14,4)), 2) AS commission,
  round((expected + shipping) * CASE WHEN abroad THEN 0.0499::DECIMAL(14,4) ELSE 0.0349::DECIMAL(14,4) END + 0.49::DECIMAL(14,4), 2) AS processing FROM offers),
resold AS (SELECT *, expected + shipping - commission - processing - buy AS net, {up(over("expected + shipping - commission - processing - buy", "buy"), 4)} AS roi FROM fees)"""
_RESOLD = f"{_DORMANT}, {_RANKED}, {_OFFERS}"


def offers(spark, sf_dir):
    rows = kept(spark, sf_dir)
    by_type = S.fan_out(rows).filter("level = 'type'")
    # a row for each type or seller: small tables, which the optimizer can send to the listings
    price = stored(S.pricing(by_type).filter("bucket = 'all'").select("scope_key", "n", "p50"), "prices")
    score = stored(R.liquidity(R.candidates(by_type), POLICY).select("scope_key", "liquidity_score"), "scores")
    dormant = stored(S.wholesalers(rows, stock=5).select("brand_id", "seller", F.lit(True).alias("dormant")), "dormant")
    active = by_type.filter("status = 'active'").select("listing_id", "scope_key", "brand_id", "seller", F.col("price").cast("decimal(14,4)").alias("buy"))
    joined = active.join(dormant, ["brand_id", "seller"], "left").join(price, "scope_key", "left").join(score, "scope_key", "left")
    return joined.select("listing_id", "buy", (F.col("brand_id") % 5 == 0).alias("abroad"), F.col("dormant").isNotNull().alias("wholesale"), F.when(F.col("n") > 0, F.col("n")).alias("n"), "p50", "liquidity_score", F.col("p50").cast("decimal(14,4)").alias("expected"), D.money("9.5").alias("shipping"))


@q(query("SELECT listing_id, CAST(commission AS DOUBLE) AS commission, CAST(processing AS DOUBLE) AS processing, CAST(net AS DOUBLE) AS net, roi FROM resold", more=_RESOLD))
def fees_resale(spark, sf_dir):
    return D.resale(offers(spark, sf_dir), "buy", "expected", "shipping", "abroad").select("listing_id", "commission", "processing", "net", "roi")


_JUDGED = """judged AS (SELECT listing_id, roi, list_filter(['' || CASE WHEN p50 IS NULL THEN 'no_price' ELSE '' END, CASE WHEN coalesce(n, 0) < 5 THEN 'few_sales' ELSE '' END, CASE WHEN coalesce(liquidity_score, 0) < 50 THEN 'low_score' ELSE '' END,
  CASE WHEN wholesale THEN 'wholesaler' ELSE '' END, CASE WHEN coalesce(roi, -1) < 0.2 THEN 'low_margin' ELSE '' END], lambda x: x <> '') AS reasons FROM resold)"""


def _judged(spark, sf_dir):
    return D.judge(D.resale(offers(spark, sf_dir), "buy", "expected", "shipping", "abroad"), sales=5)


@q(query("SELECT listing_id, roi, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS deal FROM judged", more=f"{_RESOLD}, {_JUDGED}"))
def deal_judgements(spark, sf_dir):
    return _judged(spark, sf_dir).select("listing_id", "roi", F.array_join("reasons", ",").alias("reasons"), "deal")


@q(query("SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM judged) GROUP BY reason", more=f"{_RESOLD}, {_JUDGED}"))
def deal_reason_hist(spark, sf_dir):
    return D.reason_histogram(_judged(spark, sf_dir))


_TRENDS = f"""trends AS (SELECT b.*, liquidity_score FROM (SELECT {_COUNTS}, {_MEDIANS} FROM scoped GROUP BY level, scope_key) b LEFT JOIN ranked r USING (scope_key))"""
_TREND_COLUMNS = "level, scope_key, sold_30d, sold_90d, active_now, median_price_90d, liquidity_score"


def trend_rows(spark, sf_dir):
    rows = stored(R.candidates(S.fan_out(kept(spark, sf_dir))), "candidates")
    score = R.liquidity(rows, POLICY).select("scope_key", "liquidity_score")
    return rows.drop("sales_per_month").join(score, "scope_key", "left")


@q(query(f"SELECT {_TREND_COLUMNS} FROM trends WHERE level = 'model' AND lower(scope_key) LIKE '%widget%' AND sold_90d >= 1", more=f"{_RANKED}, {_TRENDS}"))
def trends_list(spark, sf_dir):
    rows = trend_rows(spark, sf_dir)
    return rows.filter((F.col("level") == "model") & F.lower("scope_key").contains("widget") & (F.col("sold_90d") >= 1)).select(*_TREND_COLUMNS.split(", "))


@q(query(f"""SELECT {_TREND_COLUMNS}, CAST(row_number() OVER (ORDER BY liquidity_score DESC NULLS LAST, sold_30d DESC, scope_key) AS INT) AS place FROM trends WHERE level = 'type' QUALIFY place BETWEEN 11 AND 30""", more=f"{_RANKED}, {_TRENDS}"))
def trends_page(spark, sf_dir):
    """The second and third ten: rows of a page, nulls last, ties by sales and key."""
    order = (F.col("liquidity_score").desc_nulls_last(), F.col("sold_30d").desc(), F.col("scope_key"))
    page = trend_rows(spark, sf_dir).filter("level = 'type'").orderBy(*order).limit(30)  # a top-k, not a global sort
    return page.withColumn("place", F.row_number().over(Window.orderBy(*order))).filter("place > 10").select(*_TREND_COLUMNS.split(", "), "place")


@q(query(f"""SELECT t.scope_key, coalesce(p.sold, 0) AS sold, p.price, liquidity_score FROM trends t LEFT JOIN (SELECT scope_key, CAST(sum(n) AS BIGINT) AS sold, {up("sum(p50 * n) / sum(n)", 2)} AS price FROM months WHERE bucket = 'all' AND month BETWEEN DATE '1998-01-01' AND DATE '1998-03-01' GROUP BY scope_key) p USING (scope_key) WHERE level = 'line'""", more=f"{_RANKED}, {_TRENDS}, {_MONTHS}"))
def trends_by_period(spark, sf_dir):
    totals = N.period_totals(N.month_stats(scoped(spark, sf_dir)), "1998-01-01", "1998-03-01")
    return trend_rows(spark, sf_dir).filter("level = 'line'").join(totals, "scope_key", "left").select("scope_key", F.coalesce("sold", F.lit(0)).alias("sold"), "price", "liquidity_score")
