"""Queries over payloads and rewrites of stored rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.operators import payloads as J
from souk.plans.market_queries import register
from souk.plans.sql import up
from souk.sources.listings import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
q = lambda sql=None: register(QUERIES, ORACLE, sql)


def hits(spark, sf_dir):
    """Payloads of a marketplace, by rules of the events' ids."""
    n = F.col("event_id")
    text = F.concat(
        F.lit('{"id":'), n.cast("string"), F.lit(',"designers":[{"name":" A'), (n % 7).cast("string"), F.lit(' "},{"name":""},{"other":1},{"name":"b"}],"price_drops":['), (n % 90 + 20).cast("string"), F.lit(',"'), (n % 50 + 30).cast("string"), F.lit('.5",-1],"makeoffer":'),
        F.when(n % 3 == 0, "true").when(n % 3 == 1, '"no"').otherwise('"perhaps"'), F.lit(',"department":"d'), (n % 4).cast("string"), F.lit('","user":{"id":7,"rating":'), (n % 6).cast("string"), F.lit('.1239,"ratings":'), (n % 9 - 2).cast("string"), F.lit(',"username":"U'), n.cast("string"), F.lit('"},"location":"'), F.when(n % 2 == 0, "us").otherwise("Paris"), F.lit('","city":"X","items":[{"zip":1,"size":"L"}]}'),
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("payload"), F.when(n % 5 == 0, F.lit("0.5").cast("decimal(8,4)")).alias("fx_rate"), (n % 60 + 10).cast("decimal(14,2)").alias("price"))


@q("SELECT event_id, 'A' || (event_id % 7) || '|b' AS designers, CAST(event_id AS VARCHAR) AS id, 'd' || (event_id % 4) AS kind, 'none' AS fallback FROM events")
def json_paths(spark, sf_dir):
    """Elements of arrays by path, first paths that have a value, defaults."""
    p = F.col("payload")
    return hits(spark, sf_dir).select("event_id", F.array_join(J.each(p, "$.designers", "$.name"), "|").alias("designers"), J.first_value(p, "$.objectID", "$.id").alias("id"), J.first_value(p, "$.kind", "$.department").alias("kind"), J.first_value(p, "$.nothing", default="none").alias("fallback"))


_USD = lambda c: f"CAST(CASE WHEN event_id % 5 = 0 THEN round(CAST({c} AS DECIMAL(14,2)) * 0.5, 2) ELSE CAST({c} AS DECIMAL(14,2)) END AS DOUBLE)"


@q(f"""SELECT event_id, {_USD("event_id % 90 + 20")} AS price_initial, CAST((b < a)::INT + (p < b)::INT AS INT) AS price_drop_count, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS makeoffer, 'd' || (event_id % 4) AS department,
CASE WHEN event_id % 6 < 5 THEN {up("event_id % 6 + 0.124", 3)} END AS seller_rating_avg, CASE WHEN event_id % 9 >= 2 THEN event_id % 9 - 2 END AS seller_rating_count FROM (SELECT *, event_id % 90 + 20 AS a, event_id % 50 + 30.5 AS b, event_id % 60 + 10 AS p FROM events)""")
def market_fields(spark, sf_dir):
    out = J.market_fields(hits(spark, sf_dir))
    return out.select("event_id", "price_initial", "price_drop_count", "makeoffer", "department", "seller_rating_avg", "seller_rating_count")


@q("""SELECT event_id, '{"id":' || event_id || ',"designers":[{"name":" A' || (event_id % 7) || ' "},{"name":""},{"other":1},{"name":"b"}],"price_drops":[' || (event_id % 90 + 20) || ',"' || (event_id % 50 + 30) || '.5",-1],"makeoffer":' || CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN '"no"' ELSE '"perhaps"' END
|| ',"department":"d' || (event_id % 4) || '","user":{"rating":' || (event_id % 6) || '.1239,"ratings":' || (event_id % 9 - 2) || '}' || CASE WHEN event_id % 2 = 0 THEN ',"location":"US"' ELSE '' END || ',"items":[{"size":"L"}]}' AS payload FROM events""")
def scrubbed_payloads(spark, sf_dir):
    return J.without_persons(hits(spark, sf_dir)).select("event_id", "payload")


@q(r"""SELECT p_partkey, lower(CASE p_partkey % 4 WHEN 0 THEN p_type || '.' || p_brand WHEN 1 THEN p_brand || '.x' WHEN 2 THEN p_type || '.' || p_brand ELSE p_type END) AS path FROM part""")
def category_paths(spark, sf_dir):
    k = F.col("p_partkey") % 4
    sub = F.when(k == 1, F.concat("p_brand", F.lit(".x"))).when(k == 2, F.col("p_brand")).when(k == 3, F.concat("p_brand", F.lit(" y")))
    raw = F.when(k == 0, F.concat("p_type", F.lit("."), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", J.category_path(raw, F.col("p_type"), sub).alias("path"))


@q("SELECT c_custkey, sha256(lower(c_name) || chr(0) || 'salt') AS hashed, lower(c_name) AS plain, NULL::VARCHAR AS nothing FROM customer")
def pseudonyms(spark, sf_dir):
    name = F.concat(F.lit("  "), F.col("c_name"), F.lit(" \t"))
    return table(spark, sf_dir, "customer").select("c_custkey", J.pseudonym(name, "salt").alias("hashed"), J.pseudonym(name, None, "plain").alias("plain"), J.pseudonym(name, None, "none").alias("nothing"))


@q("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'x' WHEN p_partkey % 2 = 0 THEN 'possible_replica,x' ELSE '' END AS flags, p_partkey % 3 = 0 AS cleared FROM part")
def reflagged(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 2 == 0, F.concat("p_name", F.lit(" replica"))).otherwise(F.col("p_name")).alias("title"), F.lit(None).cast("string").alias("description"), F.lit("b").alias("brand"), F.when(k % 6 == 0, F.array(F.lit("possible_replica"), F.lit("x"))).when(k % 3 == 0, F.array(F.lit("x"), F.lit("possible_replica"))).when(k % 2 == 0, F.array(F.lit("possible_replica"), F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    rows = rows.withColumn("title", F.when(k % 6 == 0, F.lit("plain")).otherwise(F.col("title")))
    return J.reflag(rows).select("p_partkey", F.array_join("flags", ",").alias("flags"), "cleared")


@q("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'held' ELSE 'd' || (event_id % 4) END AS department FROM events")
def backfilled(spark, sf_dir):
    rows = hits(spark, sf_dir).withColumn("department", F.when(F.col("event_id") % 2 == 0, "held"))
    return J.backfill(rows, {"department": J.first_value(F.col("payload"), "$.department")}).select("event_id", "department")


@q("SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN quality ELSE toxic END AS INT) AS label FROM labels WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def sheet_import(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    held = rows.filter("doc_id % 2 = 0").select("doc_id", F.col("quality").cast("int").alias("label"))
    sheet = rows.filter("doc_id % 3 = 0").select("doc_id", F.col("toxic").cast("int").alias("label"))
    return J.import_sheet(held, sheet.unionByName(sheet), "doc_id")


@q("""SELECT count(*) FILTER (old IS NULL) AS inserted, count(*) FILTER (old IS NOT NULL) AS updated, count(*) FILTER (old IS NOT NULL AND new <> old) AS repriced FROM (SELECT user_id, max_by(value, ts) AS new FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id) LEFT JOIN (SELECT user_id, max_by(value, ts) AS old FROM events WHERE ts < TIMESTAMP '2024-01-15' AND user_id % 3 > 0 GROUP BY user_id) USING (user_id)""")
def upsert_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    held = rows.filter((F.col("ts") < cut) & (F.col("user_id") % 3 > 0)).groupBy("user_id").agg(F.max_by("value", "ts").alias("value"))
    return J.upsert_counts(held, rows.filter(F.col("ts") >= cut), "user_id", "value", "ts")


@q("SELECT s_suppkey, s_name || '|alias' || (s_suppkey % 3) AS names FROM supplier")
def merged_aliases(spark, sf_dir):
    alias = F.concat(F.lit("alias"), (F.col("s_suppkey") % 3).cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(J.merged_names(F.lit("the name"), F.array("s_name", F.lit(" "), F.lit("the  name")), F.array(alias, F.lit(None).cast("string"), F.col("s_name"))), "|").alias("names"))


@q(r"""SELECT p_partkey, color = 'cold' OR line = 'rod' OR (color = 'hot' AND line = 'gear') AS touched, (color = 'hot' AND line = 'gear') OR (color = 'cold' AND line = 'rod') AS whole, list_contains(['cold gear', 'hot rod'], p_name) AS run FROM (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS color, split_part(p_name, ' ', -1) AS line FROM part)""")
def forbidden_words(spark, sf_dir):
    """Tokens that generic words or phrases cover, in part and wholly; runs inside a title."""
    tokens = F.split(F.lower("p_name"), " ")
    words, phrases = ["cold", "rod"], [["hot", "gear"]]
    mask = J.covered_mask(tokens, words, phrases)
    longer = F.concat(F.array(F.lit("a")), tokens)
    run = J.contains_run(longer, F.array(F.lit("cold"), F.lit("gear"))) | J.contains_run(longer, F.array(F.lit("hot"), F.lit("rod")))
    return table(spark, sf_dir, "part").select("p_partkey", F.exists(mask, lambda x: x).alias("touched"), J.splits_into(tokens, words, phrases).alias("whole"), run.alias("run"))
