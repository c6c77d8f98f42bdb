"""Reports over placements, lines, runs and scans, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.exprs import AS_OF, moment
from souk.operators import history as H
from souk.operators import reports as P
from souk.operators import scopes as S
from souk.plans.market_queries import register
from souk.plans.sql import NOW, over, query, up
from souk.sources.listings import listings, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
q = lambda sql=None: register(QUERIES, ORACLE, sql)

#: Placements by rules of the fixture's words: cold models are descriptions, new ones have no model.
_PLACED = """placed AS (SELECT listing_id, brand_id, product_type, line, model AS title, model AS group_id, model AS slug, status = 'sold' AS sold, seller, [color, line] AS designers,
  CASE color WHEN 'cold' THEN 'descriptor' WHEN 'new' THEN 'none' WHEN 'old' THEN 'review' ELSE 'model' END AS kind, CASE length(model) % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'auto' ELSE 'ignored' END AS group_status, CASE WHEN length(model) % 2 = 0 THEN 'seed' ELSE 'mined' END AS source FROM listings)"""
_LINES = "lines AS (SELECT *, CAST(row_number() OVER (ORDER BY sales DESC, listings DESC, product_type, line) AS INT) AS place FROM (SELECT product_type, line, count(*) FILTER (sold) AS sales, count(*) AS listings FROM placed WHERE kind = 'model' GROUP BY product_type, line))"
_VERDICTS = "verdicts AS (SELECT DISTINCT product_type, line, CASE length(product_type || line) % 4 WHEN 0 THEN 'not_model' WHEN 1 THEN 'duplicate' ELSE 'model' END AS verdict FROM listings WHERE line <> 'rod')"
_TOP, _AFTER, _DRAWS = 20, 10, 200


def _sql(body: str, *more: str) -> str:
    return query(body, scoped=False, more=", ".join((_PLACED, *more)))


def placed(spark, sf_dir) -> DataFrame:
    n = F.length("model")
    kind = F.when(F.col("color") == "cold", "descriptor").when(F.col("color") == "new", "none").when(F.col("color") == "old", "review").otherwise("model")
    return listings(spark, sf_dir).select(
        "listing_id", "brand_id", "product_type", "line", F.col("model").alias("title"), F.col("model").alias("group_id"), F.col("model").alias("slug"), (F.col("status") == "sold").alias("sold"), "seller", F.array("color", "line").alias("designers"), kind.alias("kind"),
        F.when(n % 3 == 0, "confirmed").when(n % 3 == 1, "auto").otherwise("ignored").alias("group_status"), F.when(n % 2 == 0, "seed").otherwise("mined").alias("source"),
    )


def verdicts(spark, sf_dir) -> DataFrame:
    n = F.length(F.concat("product_type", "line")) % 4
    return listings(spark, sf_dir).filter("line <> 'rod'").select("product_type", "line", F.when(n == 0, "not_model").when(n == 1, "duplicate").otherwise("model").alias("verdict")).distinct()


@q(_sql("SELECT * FROM lines", _LINES))
def line_ranking(spark, sf_dir):
    return P.rank_lines(placed(spark, sf_dir))


_BY_SALES = lambda test: f"coalesce(sum(sales) FILTER ({test}), 0)"


@q(_sql(f"""SELECT count(*) AS lines, CAST(sum(sales) AS BIGINT) AS sales, count(*) FILTER (verdict IS NULL) AS unlabeled, {up(over("count(*) FILTER (verdict = 'not_model')", "count(*)"), 4)} AS garbage_lines, {up(over(_BY_SALES("verdict = 'not_model'"), "sum(sales)"), 4)} AS garbage_sales,
{up(over("count(*) FILTER (verdict IN ('not_model', 'duplicate'))", "count(*)"), 4)} AS garbage_dup_lines, {up(over(_BY_SALES("verdict IN ('not_model', 'duplicate')"), "sum(sales)"), 4)} AS garbage_dup_sales FROM lines LEFT JOIN verdicts USING (product_type, line) WHERE place <= {_TOP}""", _LINES, _VERDICTS))
def phrase_garbage(spark, sf_dir):
    return P.phrase_metrics(P.rank_lines(placed(spark, sf_dir)), verdicts(spark, sf_dir), _TOP)


_DRAWN = f"""tail AS (SELECT *, sum(sales) OVER (ORDER BY place) AS high, sum(sales) OVER () AS total FROM lines WHERE place > {_AFTER}),
drawn AS (SELECT i AS draw, t.* FROM tail t JOIN (SELECT i, floor((i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE)) * (SELECT max(total) FROM tail)::DOUBLE) AS spot FROM (SELECT unnest(range(1, {_DRAWS} + 1)) AS i)) ON spot >= high - sales AND spot < high)"""


@q(_sql("SELECT draw, product_type, line, sales, listings, place FROM drawn", _LINES, _DRAWN))
def tail_draws(spark, sf_dir):
    return P.weighted_draws(P.rank_lines(placed(spark, sf_dir)).filter(F.col("place") > _AFTER), _DRAWS)


@q(_sql(f"""SELECT CAST(head AS BIGINT) AS head_sales, CAST(bad AS BIGINT) AS head_garbage_sales, CAST(tail AS BIGINT) AS tail_sales, {up("share", 4)} AS tail_garbage_share, {up("round(bad + share * tail) / nullif(head + tail, 0)::DOUBLE", 4)} AS garbage_share_of_model_sales, {up("round(bad + share * tail) / nullif(n, 0)::DOUBLE", 4)} AS garbage_share_of_all_sales
FROM (SELECT coalesce(sum(sales), 0) AS head, coalesce(sum(sales) FILTER (verdict = 'not_model'), 0) AS bad FROM lines LEFT JOIN verdicts USING (product_type, line) WHERE place <= {_AFTER}), (SELECT coalesce(sum(sales), 0) AS tail FROM lines WHERE place > {_AFTER}),
(SELECT coalesce(count(*) FILTER (verdict = 'not_model') / nullif(count(*), 0)::DOUBLE, 0) AS share FROM drawn JOIN verdicts USING (product_type, line)), (SELECT count(*) FILTER (sold) AS n FROM placed)""", _LINES, _VERDICTS, _DRAWN))
def garbage_extrapolation(spark, sf_dir):
    rows = placed(spark, sf_dir)
    return P.extrapolate(P.rank_lines(rows), verdicts(spark, sf_dir), rows, _AFTER, _DRAWS)


@q(_sql(f"""SELECT name, count(*) AS sales, count(*) FILTER (kind IN ('none', 'descriptor')) AS none_sales, {up(over("count(*) FILTER (kind IN ('none', 'descriptor'))", "count(*)"), 4)} AS none_share, count(*) FILTER (kind = 'model') AS model_sales
FROM (SELECT DISTINCT name, listing_id, kind FROM placed JOIN (VALUES ('a', 'cold'), ('a', 'gear'), ('b', 'hot'), ('b', 'rod')) w(name, designer) ON list_contains(designers, designer) WHERE sold) GROUP BY name"""))
def collab_watch(spark, sf_dir):
    return P.watched(placed(spark, sf_dir), spark.createDataFrame([("a", "cold"), ("a", "gear"), ("b", "hot"), ("b", "rod")], "name string, designer string"))


@q(_sql(f"""SELECT status, listings, sales, {up(over("listings", "sum(listings) OVER ()"), 4)} AS listings_share, {up(over("sales", "sum(sales) OVER ()"), 4)} AS sales_share, {up(over("coalesce(sum(sales) FILTER (status = 'none') OVER (), 0)", "sum(sales) OVER ()"), 4)} AS no_model_share, {up(over("coalesce(sum(sales) FILTER (status IN ('none', 'review')) OVER (), 0)", "sum(sales) OVER ()"), 4)} AS no_model_or_review_share
FROM (SELECT CASE WHEN kind <> 'model' THEN kind ELSE group_status END AS status, count(*) AS listings, count(*) FILTER (sold) AS sales FROM placed GROUP BY ALL)"""))
def placement_coverage(spark, sf_dir):
    return P.coverage(placed(spark, sf_dir))


_GROUPS = "grouped AS (SELECT DISTINCT group_id, group_status, source FROM placed UNION ALL SELECT group_id || '?', group_status, source FROM (SELECT DISTINCT group_id, group_status, source FROM placed WHERE kind = 'none'))"


@q(_sql("""SELECT group_status, source, count(*) AS groups, count(*) FILTER (n IS NULL) AS empty, count(*) FILTER (coalesce(k, 0) = 0) AS without_sales FROM grouped LEFT JOIN (SELECT group_id, count(*) AS n, count(*) FILTER (sold) AS k FROM placed WHERE kind <> 'review' GROUP BY group_id) USING (group_id) GROUP BY ALL""", _GROUPS))
def group_tally(spark, sf_dir):
    rows = placed(spark, sf_dir)
    groups = rows.select("group_id", "group_status", "source").distinct()
    more = rows.filter("kind = 'none'").select(F.concat("group_id", F.lit("?")).alias("group_id"), "group_status", "source").distinct()
    return P.group_tally(groups.unionByName(more), rows.filter("kind <> 'review'"))


@q(_sql(f"""SELECT {up("count(*) FILTER (listing_id % 5 > 0) / count(*)::DOUBLE", 4)} AS assignment_agreement, max(a) AS current_auto, max(b) AS scratch_auto, max(c) AS in_both
FROM placed, (SELECT count(DISTINCT (product_type, slug)) AS a FROM placed WHERE group_status = 'auto'), (SELECT count(DISTINCT (product_type, slug || CASE WHEN listing_id % 5 = 0 THEN '!' ELSE '' END)) AS b FROM placed WHERE group_status = 'auto'), (SELECT count(DISTINCT (product_type, slug)) AS c FROM placed WHERE group_status = 'auto' AND listing_id % 5 > 0)"""))
def history_agreement(spark, sf_dir):
    rows = placed(spark, sf_dir)
    other = rows.withColumn("slug", F.when(F.col("listing_id") % 5 == 0, F.concat("slug", F.lit("!"))).otherwise(F.col("slug")))
    return P.history(rows, other)


@q(_sql("""SELECT product_type, slug, count(*) AS lost_sales, coalesce(any_value(CASE WHEN length(slug) % 2 = 0 THEN 'loss' END), 'unlabeled') AS status FROM placed WHERE kind = 'model' AND sold AND length(slug) % 4 = 2 AND listing_id % 3 = 0 GROUP BY ALL"""))
def lost_groups(spark, sf_dir):
    rows = placed(spark, sf_dir)
    present = rows.filter("length(slug) % 4 <> 2").select("product_type", "slug").distinct()
    now = rows.withColumn("kind", F.when(F.col("listing_id") % 3 == 0, "none").otherwise("model"))
    marks = rows.filter("length(slug) % 2 = 0").select("product_type", "slug", F.lit("loss").alias("verdict")).distinct()
    return P.lost(rows, now, present, marks)


@q(_sql("""SELECT designer, count(*) AS listings, count(*) FILTER (sold) AS sales, CASE designer WHEN 'gear' THEN 'collab' WHEN 'hot' THEN 'label' ELSE 'unlabeled' END AS class FROM (SELECT listing_id, sold, unnest(list_distinct(designers)) AS designer FROM placed) GROUP BY designer"""))
def codesigners(spark, sf_dir):
    return P.codesigners(placed(spark, sf_dir), spark.createDataFrame([("gear", "collab"), ("hot", "label")], "designer string, class string"))


_WILSON = lambda k, n, sign: up(f"(({k} / {n}::DOUBLE) + 1.96 * 1.96 / (2 * {n}) {sign} 1.96 * sqrt(({k} / {n}::DOUBLE) * (1 - {k} / {n}::DOUBLE) / {n} + 1.96 * 1.96 / (4.0 * {n} * {n}))) / (1 + 1.96 * 1.96 / {n})", 6)


@q(f"""SELECT n, k AS agreed, {up("k / n::DOUBLE", 4)} AS share, {_WILSON("k", "n", "-")} AS low, {_WILSON("k", "n", "+")} AS high, (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM labels WHERE quality <> toxic ORDER BY doc_id LIMIT 5)) AS examples FROM (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS k FROM labels)""")
def label_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return P.agreement(rows.select("doc_id", F.col("quality").alias("label")), rows.select("doc_id", F.col("toxic").alias("label")), "doc_id", "label")


@q(f"""SELECT metric, bound, goal, point, n, coalesce(CASE WHEN bound = 'min' THEN point >= goal AND (n IS NULL OR low >= goal - 0.05) ELSE point <= goal AND (n IS NULL OR high <= goal + 0.05) END, false) AS passed
FROM (SELECT *, CASE WHEN n IS NOT NULL THEN {_WILSON("round(point * n)", "n", "-")} END AS low, CASE WHEN n IS NOT NULL THEN {_WILSON("round(point * n)", "n", "+")} END AS high FROM (SELECT source AS metric, CASE WHEN length(source) % 2 = 0 THEN 'min' ELSE 'max' END AS bound, 0.8::DOUBLE AS goal, avg(quality) AS point, CASE WHEN length(source) % 3 > 0 THEN count(*) END AS n FROM documents JOIN labels USING (doc_id) GROUP BY source))""")
def targets_checked(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.length("metric")
    values = rows.groupBy(F.col("source").alias("metric")).agg(F.avg("quality").alias("point"), F.count("*").alias("n"))
    return P.check_targets(values.select("metric", F.when(n % 2 == 0, "min").otherwise("max").alias("bound"), F.lit(0.8).alias("goal"), "point", F.when(n % 3 > 0, F.col("n")).alias("n")))


_TASKS = """tasks AS (SELECT o_orderkey % 40 AS run_id, CASE WHEN o_custkey % 11 > 0 THEN o_custkey % 7 END AS brand_id, o_orderkey % 1000 AS hits, CASE WHEN o_orderkey % 6 > 0 THEN 100 + o_orderkey % 1000 END AS expected,
  CASE WHEN o_orderkey % 40 < 5 THEN 'failed' WHEN o_orderkey % 40 < 10 THEN 'done' WHEN o_orderkey % 13 = 0 THEN 'truncated' WHEN o_orderkey % 17 = 0 THEN 'running' ELSE 'done' END AS status, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 100 / 100.0::DOUBLE END AS coverage, CASE WHEN o_custkey % 2 = 0 THEN 'estimated' ELSE 'exact' END AS expected_source FROM orders)"""


def tasks(spark, sf_dir) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(k % 40 < 5, "failed").when(k % 40 < 10, "done").when(k % 13 == 0, "truncated").when(k % 17 == 0, "running").otherwise("done")
    return table(spark, sf_dir, "orders").select(
        (k % 40).alias("run_id"), F.when(c % 11 > 0, c % 7).alias("brand_id"), (k % 1000).alias("hits"), F.when(k % 6 > 0, 100 + k % 1000).alias("expected"), status.alias("status"), F.when(c % 3 > 0, c % 100 / F.lit(100.0)).alias("coverage"), F.when(c % 2 == 0, "estimated").otherwise("exact").alias("expected_source")
    )


@q(f"""WITH {_TASKS} SELECT t.*, brands, brands_completed FROM (SELECT run_id, count(*) AS tasks, count(*) FILTER (status IN ('done', 'skipped', 'truncated')) AS tasks_done, CAST(sum(hits) AS BIGINT) AS hits,
  CASE WHEN count(*) FILTER (status = 'failed') > 0 AND count(*) FILTER (status IN ('done', 'skipped', 'truncated')) = 0 THEN 'failed' WHEN count(*) FILTER (status IN ('failed', 'truncated')) > 0 THEN 'partial' ELSE 'completed' END AS status, {up("avg(coverage)", 4)} AS coverage_avg,
  count(*) FILTER (coverage >= 0.7 AND coverage < 0.98) AS partial, count(*) FILTER (coverage < 0.7) AS poor, count(*) FILTER (status = 'truncated') AS truncated, count(*) FILTER (expected_source = 'estimated') AS estimated FROM tasks GROUP BY run_id) t
LEFT JOIN (SELECT run_id, count(*) AS brands, count(*) FILTER (whole) AS brands_completed FROM (SELECT run_id, brand_id, bool_and(status IN ('done', 'skipped', 'truncated')) AS whole FROM tasks WHERE brand_id IS NOT NULL GROUP BY ALL) GROUP BY run_id) USING (run_id)""")
def run_progress(spark, sf_dir):
    return P.run_state(tasks(spark, sf_dir))


@q(f"WITH {_TASKS} SELECT run_id, brand_id, {up('avg(coverage)', 4)} AS coverage FROM tasks WHERE brand_id IS NOT NULL AND coverage IS NOT NULL GROUP BY run_id, brand_id")
def run_brand_coverage(spark, sf_dir):
    return P.brand_coverage(tasks(spark, sf_dir))


@q(f"""WITH {_TASKS} SELECT run_id, CAST(e AS BIGINT) AS hits_expected, {up("CASE WHEN took >= 10 THEN got / took::DOUBLE ELSE 0 END", 4)} AS hits_per_second, CAST(CASE WHEN open = 0 THEN 0 WHEN took < 10 OR got = 0 OR open = unknown THEN NULL ELSE round_even(r / (got / took::DOUBLE), 0) END AS BIGINT) AS eta_seconds, open > 0 AND unknown > 0 AS is_lower_bound
FROM (SELECT run_id, sum(expected) AS e, count(*) FILTER (status NOT IN ('done', 'skipped', 'truncated', 'failed')) AS open, count(*) FILTER (status NOT IN ('done', 'skipped', 'truncated', 'failed') AND expected IS NULL) AS unknown,
  sum(greatest(coalesce(expected, 0) - hits, 0)) FILTER (status NOT IN ('done', 'skipped', 'truncated', 'failed')) AS r, max(run_id * 100) AS got, max(run_id) AS took FROM tasks GROUP BY run_id)""")
def eta_estimates(spark, sf_dir):
    return P.eta(tasks(spark, sf_dir).withColumns({"fetched": F.col("run_id") * 100, "elapsed": F.col("run_id")}), "fetched", "elapsed")


@q(f"""WITH {_TASKS} SELECT run_id, brand_id, hits, expected, {up("least(hits / nullif(expected, 0)::DOUBLE, 1)", 4)} AS ratio, CASE WHEN expected = 0 THEN 'skipped' WHEN hits / expected::DOUBLE >= 0.98 AND status <> 'truncated' THEN 'complete' WHEN hits / expected::DOUBLE >= 0.7 THEN 'partial' ELSE 'poor' END AS level FROM tasks WHERE expected IS NOT NULL""")
def task_coverage(spark, sf_dir):
    rows = tasks(spark, sf_dir).filter("expected is not null").withColumn("c", P.task_coverage(F.col("expected"), F.col("hits"), F.col("status") == "truncated"))
    return rows.select("run_id", "brand_id", "hits", "expected", "c.ratio", F.col("c.status").alias("level"))


_PAST = datetime(1998, 5, 2)


@q(query(f"""SELECT scope_key, count(*) AS active, CASE WHEN count(*) >= 5 THEN {up(over(f"count(*) FILTER (status = 'sold' AND sold_at > TIMESTAMP '1998-05-02' AND sold_at <= {NOW})", "count(*)"), 6)} END AS forward FROM scoped WHERE listed_at <= TIMESTAMP '1998-05-02' AND NOT (status = 'sold' AND sold_at <= TIMESTAMP '1998-05-02') AND NOT (status = 'removed' AND touched_at <= TIMESTAMP '1998-05-02') GROUP BY scope_key"""))
def forward_share(spark, sf_dir):
    rows = S.fan_out(listings(spark, sf_dir)).filter(H.status_at(_PAST) == "active")
    later = (F.col("status") == "sold") & (F.col("sold_at") > moment(_PAST)) & (F.col("sold_at") <= moment(AS_OF))
    return P.forward(rows, later)


_FIRSTS = "firsts AS (SELECT brand_id, min(CAST(sold_at AS DATE)) AS first FROM listings WHERE status = 'sold' GROUP BY brand_id), spans AS (SELECT min(first) AS f FROM firsts)"


@q(query("""SELECT CAST(m AS VARCHAR) AS month, CASE WHEN gone THEN 'missing' WHEN a > 1 OR b < day(last_day(m)) THEN 'partial' ELSE 'whole' END AS state, CAST(CASE WHEN NOT gone AND (a > 1 OR b < day(last_day(m))) THEN a END AS INT) AS from_day, CAST(CASE WHEN NOT gone AND (a > 1 OR b < day(last_day(m))) THEN b END AS INT) AS to_day,
  (SELECT count(*) FROM firsts WHERE date_trunc('month', first) > date_trunc('month', greatest(f, DATE '1993-12-01'))) AS late_brands
FROM (SELECT m, f, last_day(m) < f OR m > DATE '1998-06-01' AS gone, CASE WHEN m = date_trunc('month', f) THEN day(f) ELSE 1 END AS a, CASE WHEN m = DATE '1998-06-01' THEN 1 ELSE day(last_day(m)) END AS b FROM spans, (SELECT CAST(unnest(generate_series(DATE '1993-12-01', DATE '1998-08-01', INTERVAL 1 MONTH)) AS DATE) AS m))""", scoped=False, more=_FIRSTS))
def month_gaps(spark, sf_dir):
    """A range of months against the data: missing months, partial ones with their days."""
    months = spark.range(1).select(F.explode(P.months_of(F.lit("1993-12-01").cast("date"), F.lit("1998-08-01").cast("date"))).alias("month"))
    return P.covered(P.first_sales(listings(spark, sf_dir)), months, F.lit(AS_OF.date()))


@q(_sql("""SELECT partner, count(*) AS listings, count(*) FILTER (bare) AS unplaced, count(*) FILTER (bare AND sold) AS unplaced_sales, count(*) FILTER (kind = 'model') AS models, string_agg(title, ' | ' ORDER BY listing_id DESC) FILTER (k <= 5) AS examples
FROM (SELECT *, kind IN ('none', 'descriptor') AS bare, row_number() OVER (PARTITION BY partner ORDER BY listing_id DESC) AS k FROM (SELECT DISTINCT partner, listing_id, sold, kind, title FROM placed JOIN (VALUES ('x', 'cold'), ('x', 'rod'), ('y', 'plate')) n(partner, designer) ON list_contains(designers, designer))) GROUP BY partner"""))
def partner_report(spark, sf_dir):
    return P.partners(placed(spark, sf_dir), spark.createDataFrame([("x", "cold"), ("x", "rod"), ("y", "plate")], "partner string, designer string"))


@q(_sql(f"""SELECT k.*, mixed_titles, first_groups FROM (SELECT brand_id, count(*) AS listings, {up("count(*) FILTER (kind = 'model') / count(*)::DOUBLE", 4)} AS model_share, {up("count(*) FILTER (kind = 'none') / count(*)::DOUBLE", 4)} AS none_share FROM placed GROUP BY brand_id) k
JOIN (SELECT brand_id, count(*) FILTER (n > 1) AS mixed_titles FROM (SELECT brand_id, title, count(DISTINCT product_type) AS n FROM placed GROUP BY ALL) GROUP BY brand_id) USING (brand_id)
LEFT JOIN (SELECT brand_id, string_agg(title, ' | ' ORDER BY p) AS first_groups FROM (SELECT brand_id, title, row_number() OVER (PARTITION BY brand_id ORDER BY count(*) DESC, title) AS p FROM placed WHERE kind = 'model' GROUP BY brand_id, title) WHERE p <= 15 GROUP BY brand_id) USING (brand_id)"""))
def brand_report(spark, sf_dir):
    return P.brand_report(placed(spark, sf_dir), 15)


@q(_sql("SELECT title, brand_id, product_type FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY n DESC, brand_id, product_type) AS k FROM (SELECT title, brand_id, product_type, count(*) AS n FROM placed GROUP BY ALL)) WHERE k = 1"))
def majority_scopes(spark, sf_dir):
    return P.majority_scope(placed(spark, sf_dir))


@q("""WITH brands AS (SELECT n_nationkey AS brand_id, n_nationkey % 2 = 0 AS include_subbrands FROM nation), maps AS (SELECT s_nationkey AS brand_id, s_name AS name, s_suppkey % 5 > 0 AS verified, s_suppkey % 7 = 0 AS rejected, s_suppkey % 3 = 0 AS subbrand FROM supplier)
SELECT brand_id, names, CAST(coalesce(greatest(CASE WHEN brand_id % 3 > 0 THEN TIMESTAMP '1998-05-31 00:00:00' + to_hours(CAST(brand_id AS INT) * 2) - INTERVAL 5 MINUTE END, TIMESTAMP '1998-05-31'), TIMESTAMP '1998-05-31') AS VARCHAR) AS since
FROM (SELECT m.brand_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM maps m JOIN brands b USING (brand_id) WHERE verified AND NOT rejected AND (include_subbrands OR NOT subbrand) GROUP BY m.brand_id)""")
def scan_targets(spark, sf_dir):
    brands = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("brand_id"), (F.col("n_nationkey") % 2 == 0).alias("include_subbrands"))
    k = F.col("s_suppkey")
    maps = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("brand_id"), F.col("s_name").alias("name"), (k % 5 > 0).alias("verified"), (k % 7 == 0).alias("rejected"), (k % 3 == 0).alias("subbrand"))
    scanned = brands.filter("brand_id % 3 > 0").select("brand_id", F.timestamp_add("HOUR", (F.col("brand_id") * 2).cast("int"), moment(datetime(1998, 5, 31))).alias("scanned_to"))
    return P.scan_targets(brands, maps, scanned, moment(AS_OF))


@q("""WITH hits AS (SELECT user_id AS id, min(ts) AS created, max(ts) AS repriced FROM events GROUP BY user_id) SELECT id FROM hits WHERE (created > TIMESTAMP '2024-01-02' AND created <= TIMESTAMP '2024-01-04') OR (repriced > TIMESTAMP '2024-01-02' AND repriced <= TIMESTAMP '2024-01-29')""".replace("2024-01-29", "2024-01-04"))
def changed_window(spark, sf_dir):
    """Hits of a window, created or repriced in it, each once though the halves overlap."""
    hits = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("created"), F.max("ts").alias("repriced"))
    return P.changed_between(hits.unionByName(hits), moment(datetime(2024, 1, 2)), moment(datetime(2024, 1, 4))).select("id")


@q("""SELECT n_nationkey AS brand_id, index_type, CASE WHEN n_regionkey > 0 THEN 'pending' ELSE 'skipped' END AS status, CAST(CASE WHEN n_regionkey > 0 AND index_type = 'sold' AND n_nationkey % 4 > 0 THEN TIMESTAMP '1998-05-30' - INTERVAL 2 HOUR END AS VARCHAR) AS after FROM nation, (SELECT unnest(['active', 'sold']) AS index_type)""")
def run_tasks(spark, sf_dir):
    brands = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("brand_id"), (F.col("n_regionkey") > 0).alias("mapped"))
    marks = brands.filter("brand_id % 4 > 0").select("brand_id", F.explode(F.array(F.lit("sold"), F.lit("active"))).alias("index_type"), moment(datetime(1998, 5, 30)).alias("watermark"))
    return P.run_tasks(brands, marks)


@q(_sql("SELECT n_nationkey AS brand_id, n_name AS name, coalesce(n, 0) AS listings FROM nation LEFT JOIN (SELECT brand_id, count(*) AS n FROM placed WHERE brand_id % 3 > 0 GROUP BY brand_id) ON n_nationkey = brand_id"))
def brand_counts(spark, sf_dir):
    counted = placed(spark, sf_dir).filter("brand_id % 3 > 0").groupBy("brand_id").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("brand_id"), F.col("n_name").alias("name")).join(counted, "brand_id", "left").select("brand_id", "name", F.coalesce("n", F.lit(0)).alias("listings"))


@q(_sql("SELECT *, CAST(row_number() OVER (ORDER BY listings DESC, sales DESC, product_type, descriptor) AS INT) AS place FROM (SELECT product_type, title AS descriptor, count(*) AS listings, count(*) FILTER (sold) AS sales FROM placed WHERE kind = 'descriptor' GROUP BY ALL) QUALIFY place <= 12"))
def descriptor_top(spark, sf_dir):
    rows = placed(spark, sf_dir).filter("kind = 'descriptor'").groupBy("product_type", F.col("title").alias("descriptor")).agg(F.count("*").alias("listings"), F.count_if("sold").alias("sales"))
    order = (F.desc("listings"), F.desc("sales"), F.col("product_type"), F.col("descriptor"))
    return rows.orderBy(*order).limit(12).withColumn("place", F.row_number().over(Window.orderBy(*order)))


@q(_sql("SELECT product_type, listings, sales, n_lines, CAST(row_number() OVER (ORDER BY listings DESC, product_type) AS INT) AS place FROM (SELECT product_type, count(*) AS listings, count(*) FILTER (sold) AS sales, count(DISTINCT line) AS n_lines FROM placed WHERE kind IN ('none', 'review') GROUP BY product_type) QUALIFY place <= 20"))
def unknown_types(spark, sf_dir):
    """Totals of what found no place, by type, the first twenty."""
    rows = placed(spark, sf_dir).filter("kind in ('none', 'review')").groupBy("product_type").agg(F.count("*").alias("listings"), F.count_if("sold").alias("sales"), F.count_distinct("line").alias("n_lines"))
    order = (F.desc("listings"), F.col("product_type"))
    return rows.orderBy(*order).limit(20).withColumn("place", F.row_number().over(Window.orderBy(*order)))


@q(query(f"""SELECT listing_id, title, CAST(price AS DOUBLE) AS price, CAST(sold_at AS VARCHAR) AS sold_at, days, place FROM (SELECT l.listing_id, l.model AS title, coalesce(nullif(l.sold_price, 0), l.price) AS price, l.sold_at, {up("greatest(epoch(l.sold_at - coalesce(r.listed_at, l.listed_at)) / 86400.0, 0)", 2)} AS days,
CAST(row_number() OVER (ORDER BY l.sold_at DESC NULLS LAST, l.listing_id DESC) AS INT) AS place FROM listings l LEFT JOIN listings r ON r.listing_id = l.listing_id - 1 WHERE l.status = 'sold' AND l.line IN ('gear', 'rod')) WHERE place <= 25""", scoped=False))
def recent_sales(spark, sf_dir):
    """The last 25 sales of some groups, days from the listing of the chain's first."""
    rows = listings(spark, sf_dir)
    first = rows.select((F.col("listing_id") + 1).alias("listing_id"), F.col("listed_at").alias("first"))
    order = (F.col("sold_at").desc_nulls_last(), F.col("listing_id").desc())
    found = rows.filter("status = 'sold' and line in ('gear', 'rod')").orderBy(*order).limit(25).join(first, "listing_id", "left")
    days = F.round(F.greatest(F.timestamp_diff("SECOND", F.coalesce("first", "listed_at"), F.col("sold_at")) / F.lit(86400.0), F.lit(0.0)).cast("decimal(24,8)"), 2)
    return found.select("listing_id", F.col("model").alias("title"), F.coalesce(F.nullif("sold_price", F.lit(0).cast("decimal(14,2)")), "price").alias("price"), "sold_at", days.alias("days"), F.row_number().over(Window.orderBy(*order)).alias("place"))


@q(query("SELECT listing_id FROM listings WHERE brand_id = 7 AND status = 'active' AND touched_at < TIMESTAMP '1997-01-01' ORDER BY listing_id LIMIT 50", scoped=False))
def refresh_candidates(spark, sf_dir):
    """The first active listings of a brand that were not seen since a moment."""
    return listings(spark, sf_dir).filter("brand_id = 7 and status = 'active'").filter(F.col("touched_at") < moment(datetime(1997, 1, 1))).orderBy("listing_id").limit(50).select("listing_id")


@q("SELECT o_orderkey AS run_id, o_orderstatus AS status, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 10 OFFSET 5")
def runs_page(spark, sf_dir):
    """A page of runs, newest first, with the number of all."""
    runs = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    return runs.orderBy(F.desc("run_id")).offset(5).limit(10).join(F.broadcast(runs.agg(F.count("*").alias("total"))))


@q(_sql("SELECT group_id, group_status, n_brands, listings, total FROM (SELECT group_id, group_status, count(DISTINCT brand_id) AS n_brands, count(*) AS listings, count(*) OVER () AS total FROM placed WHERE group_status <> 'ignored' AND product_type = 'SMALL' AND lower(title) LIKE '%o%' GROUP BY group_id, group_status) ORDER BY listings DESC, group_id LIMIT 8 OFFSET 2"))
def group_list(spark, sf_dir):
    """A page of the groups of a type that match a search, with the number of all."""
    rows = placed(spark, sf_dir).filter("group_status <> 'ignored' and product_type = 'SMALL'").filter(F.lower("title").contains("o"))
    groups = rows.groupBy("group_id", "group_status").agg(F.count_distinct("brand_id").alias("n_brands"), F.count("*").alias("listings"))
    return groups.orderBy(F.desc("listings"), "group_id").offset(2).limit(8).join(F.broadcast(groups.agg(F.count("*").alias("total"))))


@q(query("SELECT listing_id, CAST(round(price * 100) AS BIGINT) AS cents, CASE WHEN status = 'sold' THEN CASE WHEN listing_id % 2 = 0 THEN CAST(size AS BIGINT) ELSE greatest(date_diff('day', listed_at, sold_at), 0) END WHEN status = 'active' THEN greatest(date_diff('day', listed_at, TIMESTAMP '1998-06-01'), 0) WHEN listing_id % 2 = 0 THEN CAST(size AS BIGINT) ELSE greatest(date_diff('day', listed_at, touched_at), 0) END AS days FROM listings", scoped=False))
def listing_details(spark, sf_dir):
    """Price in cents and whole days on the market; a stored number of days is preferred
    except for what is on sale."""
    stored = F.when(F.col("listing_id") % 2 == 0, F.col("size").cast("long"))
    whole = lambda end: F.greatest(F.timestamp_diff("DAY", F.col("listed_at"), end), F.lit(0).cast("long"))
    status = F.col("status")
    days = F.when(status == "sold", F.coalesce(stored, whole(F.col("sold_at")))).when(status == "active", whole(moment(AS_OF))).otherwise(F.coalesce(stored, whole(F.col("touched_at"))))
    return listings(spark, sf_dir).select("listing_id", F.round(F.col("price") * 100).cast("long").alias("cents"), days.alias("days"))
