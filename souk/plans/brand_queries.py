"""Names of brands: mappings, counters, resolution, titles that name another brand."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.operators import brands as B
from souk.plans.market_queries import register
from souk.plans.sql import query
from souk.plans.text_queries import _COMMON
from souk.sources.listings import listings, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
q = lambda sql=None: register(QUERIES, ORACLE, sql)

_NOW = "1998-06-01"


@q(query("""SELECT listing_id, coalesce(len(brands) > 0, false) AND NOT coalesce(list_contains(brands, brand_id), false) AS wrong_brand FROM marked LEFT JOIN named USING (title)""", scoped=False, more="""
names AS (SELECT DISTINCT brand_id, upper(color) AS name FROM listings WHERE size = 7 UNION SELECT DISTINCT brand_id, left(line, 2) FROM listings WHERE size = 11),
marked AS (SELECT listing_id, CASE WHEN listing_id % 10 = 0 THEN NULL ELSE brand_id END AS brand_id, model AS title FROM listings),
named AS (SELECT title, list(DISTINCT brand_id) AS brands FROM (SELECT DISTINCT title FROM marked) JOIN names ON contains(lower(title), lower(name)) GROUP BY title)"""))  # fmt: skip
def wrong_brand(spark, sf_dir):
    """Brands called by colours and by the first letters of lines; every tenth listing has no
    brand of its own."""
    rows = listings(spark, sf_dir)
    names = rows.filter("size = 7").select("brand_id", F.upper("color").alias("name")).unionByName(rows.filter("size = 11").select("brand_id", F.left("line", F.lit(2)).alias("name"))).distinct()
    marked = rows.select("listing_id", F.when(F.col("listing_id") % 10 != 0, F.col("brand_id")).alias("brand_id"), F.col("model").alias("title"))
    return B.wrong_brand(marked, names).select("listing_id", "wrong_brand")


@q(query("""SELECT brand_id, name, CASE WHEN takes THEN n ELSE listings END AS listings, CASE WHEN takes THEN score ELSE old_score END AS score,
  CASE WHEN takes THEN coalesce(verified, false) OR score >= 0.95 ELSE verified END AS verified, CAST(rejected_at AS VARCHAR) AS rejected_at, coalesce(method, 'auto') AS method, CAST(CASE WHEN takes THEN TIMESTAMP '1998-06-01' ELSE updated_at END AS VARCHAR) AS updated_at
FROM (SELECT *, n IS NOT NULL AND rejected_at IS NULL AS takes FROM held FULL JOIN fresh USING (brand_id, name))""", scoped=False, more="""
searched AS (SELECT brand_id, color AS name, count(*) AS n FROM listings GROUP BY ALL UNION ALL SELECT brand_id, color, count(*) FILTER (status = 'sold') FROM listings GROUP BY ALL),
fresh AS (SELECT *, (n % 100) / 100.0::DOUBLE AS score FROM (SELECT brand_id, name, max(n) AS n FROM searched GROUP BY ALL) WHERE (n % 100) / 100.0::DOUBLE >= 0.75),
held AS (SELECT brand_id, color AS name, count(*) AS listings, 0.8::DOUBLE AS old_score, min(size) % 2 = 0 AS verified, CASE WHEN count(*) % 3 = 0 THEN TIMESTAMP '1997-01-01' END AS rejected_at, 'manual' AS method, TIMESTAMP '1997-01-01' AS updated_at FROM listings WHERE status = 'removed' GROUP BY ALL)"""))  # fmt: skip
def brand_mappings(spark, sf_dir):
    """Colours as the names that searches found, removed listings as the mappings held."""
    rows, moment = listings(spark, sf_dir), F.lit("1997-01-01").cast("timestamp_ntz")
    by = rows.groupBy("brand_id", F.col("color").alias("name"))
    found = by.agg(F.count("*").alias("listings")).unionByName(by.agg(F.count_if(F.col("status") == "sold").alias("listings")))
    scored = B.merged(found).withColumn("score", F.col("listings") % 100 / F.lit(100.0))
    held = rows.filter("status = 'removed'").groupBy("brand_id", F.col("color").alias("name")).agg(F.count("*").alias("listings"), F.lit(0.8).alias("score"), (F.min("size") % 2 == 0).alias("verified"))
    held = held.select("*", F.when(F.col("listings") % 3 == 0, moment).alias("rejected_at"), F.lit("manual").alias("method"), moment.alias("updated_at"))
    return B.upsert_mappings(held, scored, F.lit(_NOW).cast("timestamp_ntz"))


@q("""WITH before AS (SELECT upper(event_type) || '!' AS raw, event_type AS key, count(*) AS n, min(ts) AS first, max(ts) AS last, arg_max(user_id, (ts, user_id)) AS suggested, arg_max(value, (ts, user_id)) AS score FROM events WHERE user_id % 2 = 0 GROUP BY event_type),
after AS (SELECT CASE WHEN user_id % 3 = 0 THEN event_type ELSE upper(event_type) || '!' END AS raw, event_type AS key, count(*) AS n, min(ts) AS first, max(ts) AS last,
  arg_max(user_id, (ts, coalesce(value, -1), user_id)) AS suggested, arg_max(value, (ts, coalesce(value, -1), user_id)) AS score FROM events WHERE user_id % 2 = 1 GROUP BY ALL)
SELECT raw, coalesce(b.key, a.key) AS key, coalesce(b.n, 0) + coalesce(a.n, 0) AS occurrences, CASE WHEN a.n IS NULL THEN b.suggested ELSE a.suggested END AS suggested, CASE WHEN a.n IS NULL THEN b.score ELSE a.score END AS score, CAST(coalesce(b.first, a.first) AS VARCHAR) AS first_seen, CAST(coalesce(a.last, b.last) AS VARCHAR) AS last_seen
FROM before b FULL JOIN after a USING (raw)""")
def unmatched_brands(spark, sf_dir):
    """Counters of one half of the users' events, then those of the other half on top."""
    events, shout = table(spark, sf_dir, "events"), F.concat(F.upper("event_type"), F.lit("!"))
    seen = events.withColumn("raw", F.when((F.col("user_id") % 2 == 1) & (F.col("user_id") % 3 == 0), F.col("event_type")).otherwise(shout))
    seen = seen.select("raw", F.col("user_id").alias("suggested"), F.col("value").alias("score"), F.col("ts").alias("at"))
    none = B.count_unmatched(spark.createDataFrame([], "raw string, key string, occurrences long, suggested long, score double, first_seen timestamp_ntz, last_seen timestamp_ntz"), seen.filter("suggested % 2 = 0"))
    return B.count_unmatched(none, seen.filter("suggested % 2 = 1"))


@q(f"""WITH RECURSIVE names AS (SELECT n_nationkey AS brand_id, n_name AS name FROM nation UNION ALL SELECT n_regionkey + 100, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
raws AS (SELECT n_name AS raw FROM nation UNION SELECT left(n_name, 3) || '-' || n_name[4:] FROM nation UNION SELECT n_name || 'X' FROM nation UNION SELECT n_name[2:] || 'AB' FROM nation UNION SELECT r_name FROM region),
ra AS (SELECT raw, regexp_replace(lower(raw), '[^a-z0-9]+', '', 'g') AS a FROM raws), kb AS (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS b, min(brand_id) AS suggested FROM names GROUP BY ALL),
pairs AS (SELECT DISTINCT a, b FROM ra, kb), {_COMMON},
best AS (SELECT raw, suggested, score FROM ra JOIN ratios USING (a) JOIN kb USING (b) WHERE score >= 85 QUALIFY row_number() OVER (PARTITION BY raw ORDER BY score DESC, suggested) = 1)
SELECT raw, CASE WHEN score >= 92 THEN suggested END AS brand_id, suggested, score FROM ra LEFT JOIN best USING (raw)""")
def brand_resolution(spark, sf_dir):
    """Nations and regions as brands, named right, with a hyphen, a letter more, and turned."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = nation.select(F.col("n_nationkey").alias("brand_id"), F.col("n_name").alias("name")).unionByName(region.select((F.col("r_regionkey") + 100).alias("brand_id"), F.col("r_name").alias("name")))
    n = F.col("n_name")
    spellings = F.array(n, F.concat(F.left(n, F.lit(3)), F.lit("-"), F.substring(n, 4, 99)), F.concat(n, F.lit("X")), F.concat(F.substring(n, 2, 99), F.lit("AB")))
    raws = nation.select(F.explode(spellings).alias("raw")).unionByName(region.select(F.col("r_name").alias("raw")))
    return B.resolve(raws, names, suggest=85)
