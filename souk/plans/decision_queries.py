"""Queries over product types, collaborations, descriptions and people's decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.operators import decisions as D
from souk.operators import grouping as G
from souk.operators import partners as P
from souk.operators import products as K
from souk.plans.market_queries import register
from souk.plans.sql import query
from souk.sources.listings import listings
from souk.sources.scratch import stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
q = lambda sql=None: register(QUERIES, ORACLE, sql)

_TYPES = {"gear": ("hard", "gear"), "rod": ("hard", "rod"), "plate": ("flat", "plate"), "ring": ("flat", "ring"), "review": ("review", "review")}
_RULE = "fixed string, any array<string>, fallback string"
_CATEGORIES = [("economy.gear", "gear", [], None), ("economy.rod", "plate", [], None), ("promo.bolt", None, ["rod", "ring"], "ring")]
_DEPARTMENTS = [("economy", None, ["gear", "plate"], "plate"), ("small", "rod", [], None), ("unknown", None, [], None)]


@q(query("""SELECT listing_id, coalesce(category, unknown, 'review') AS product_type, CASE WHEN category IS NULL AND unknown IS NULL THEN 'fallback' WHEN category = 'review' THEN 'conflict' ELSE how END AS method, p = 'economy' AND line IN ('gear', 'rod') OR p = 'promo' AND line = 'bolt' AS known FROM (SELECT *,
  CASE WHEN p = 'economy' AND line = 'gear' THEN 'gear' WHEN p = 'economy' AND line = 'rod' THEN CASE WHEN strong THEN 'review' ELSE 'plate' END WHEN p = 'economy' THEN 'plate' WHEN p = 'small' THEN CASE WHEN strong AND line IN ('plate', 'ring') THEN 'review' ELSE 'rod' END WHEN p = 'promo' AND line = 'bolt' THEN CASE WHEN color = 'old' THEN 'rod' ELSE 'ring' END END AS category,
  CASE WHEN strong OR weak THEN line END AS unknown,
  CASE WHEN p = 'small' OR p = 'economy' AND line IN ('gear', 'rod') THEN 'category' WHEN p = 'promo' AND line = 'bolt' THEN CASE WHEN color = 'old' THEN 'model' ELSE 'fallback' END WHEN p = 'economy' THEN CASE WHEN line = 'plate' AND strong THEN 'title' WHEN line = 'plate' AND weak THEN 'weak' ELSE 'fallback' END WHEN strong THEN 'title' ELSE 'weak' END AS how
FROM (SELECT *, lower(product_type) AS p, color IN ('hot', 'cold') AND line IN ('gear', 'rod', 'plate', 'ring') AS strong, color = 'new' AND line IN ('gear', 'rod', 'plate', 'ring') AS weak FROM listings))""", scoped=False))  # fmt: skip
def product_types(spark, sf_dir):
    """Every listing's type, from rules of categories and departments, words and models."""
    none = F.array().cast("array<string>")
    rows = listings(spark, sf_dir).select(
        "listing_id", F.concat(F.lower("product_type"), F.lit("."), "line").alias("category_path"), F.col("model").alias("title"), F.split("model", " ").alias("tokens"),
        F.when(F.col("color").isin("hot", "cold"), F.array("line")).otherwise(none).alias("strong"), F.when(F.col("color") == "new", F.array("line")).otherwise(none).alias("weak"),
    )
    ruled = K.with_rule(rows, spark.createDataFrame(_CATEGORIES, f"category string, {_RULE}"), spark.createDataFrame(_DEPARTMENTS, f"department string, {_RULE}"))
    models = spark.createDataFrame([("rod", "old bolt", 1, True, None, True, 2), ("ring", "old bolt", 3, True, None, False, 3)], "product_type string, phrase string, key int, confirmed boolean, parent int, infer boolean, weight int")
    return K.product_types(ruled, _TYPES, models).select("listing_id", "product_type", "method", "known")


_PHRASES = "phrase string, slug string, only_types array<string>, except_types array<string>, stops array<string>"


def _described(spark, sf_dir):
    rows = listings(spark, sf_dir).select("listing_id", "brand_id", F.col("model").alias("title"), "product_type", F.lit("_none").alias("slug"), F.lit("none").alias("method"))
    groups = spark.createDataFrame([(11, "LARGE", "_plate", "Plate", "ignored", "system", None), (12, "LARGE", "_plate", "Plate", "auto", "system", "1998-01-01"), (13, "NONE", "_red", "Red", "auto", "system", "1998-01-01")], "brand_id int, product_type string, slug string, name string, status string, source string, retired_at string")
    partners = spark.createDataFrame([("hot gear", "_collab-hot", ["ECONOMY", "SMALL"], None, None), ("cold", "_collab-cold", None, None, ["ring"])], _PHRASES)
    words = spark.createDataFrame([("red", "_red", [], ["PROMO"], None), ("plate", "_plate", None, None, None), ("blue plate", "_blue-plate", None, None, None)], _PHRASES)
    names = spark.createDataFrame([("_collab-hot", "Hot"), ("_collab-cold", "Cold"), ("_red", "Red"), ("_plate", "Plate"), ("_blue-plate", "Blue Plate")], "slug string, name string")
    titles = rows.select("title", "product_type").distinct().withColumn("tokens", F.split("title", " "))
    placed, lines = P.system_lines(rows, groups, P.named(titles, partners), names, "collab")
    return P.system_lines(placed, lines, P.named(titles, words), names, "descriptor")


_DESCRIBED_SQL = """described AS (SELECT listing_id, brand_id, product_type, CASE WHEN product_type IN ('ECONOMY', 'SMALL') AND model = 'hot gear' THEN '_collab-hot' WHEN color = 'cold' AND line <> 'ring' THEN '_collab-cold'
  WHEN model = 'blue plate' THEN '_blue-plate' WHEN color = 'red' AND product_type <> 'PROMO' THEN '_red' WHEN line = 'plate' AND NOT (brand_id = 11 AND product_type = 'LARGE') THEN '_plate' ELSE '_none' END AS slug FROM listings)"""


@q(query("SELECT listing_id, slug, CASE WHEN slug = '_none' THEN 'none' WHEN slug LIKE '_collab-%' THEN 'collab' ELSE 'descriptor' END AS method FROM described", scoped=False, more=_DESCRIBED_SQL))
def described_lines(spark, sf_dir):
    """Listings without a model, by the collaboration or else the description in their title."""
    return _described(spark, sf_dir)[0].select("listing_id", "slug", "method")


@q(query("""SELECT brand_id, product_type, slug, 'auto' AS status, CASE WHEN brand_id = 13 AND product_type = 'NONE' THEN '1998-01-01' END AS retired_at FROM (SELECT DISTINCT brand_id, product_type, slug FROM described WHERE slug <> '_none' UNION SELECT 12, 'LARGE', '_plate' WHERE EXISTS (SELECT 1 FROM described WHERE brand_id = 12 AND product_type = 'LARGE' AND slug = '_plate') UNION SELECT 13, 'NONE', '_red')
UNION ALL SELECT 12, 'LARGE', '_plate', 'auto', '1998-01-01' WHERE NOT EXISTS (SELECT 1 FROM described WHERE brand_id = 12 AND product_type = 'LARGE' AND slug = '_plate')
UNION ALL SELECT 11, 'LARGE', '_plate', 'ignored', NULL""", scoped=False, more=_DESCRIBED_SQL))  # fmt: skip
def system_groups(spark, sf_dir):
    """The groups of those lines: made, back from retirement, or left as they were."""
    return _described(spark, sf_dir)[1].select("brand_id", "product_type", "slug", "status", "retired_at")


def _groups(spark, sf_dir):
    """A line for each last word and a version for each model, by brand and type."""
    rows = listings(spark, sf_dir)
    key = lambda c: F.concat_ws(":", "brand_id", "product_type", c)
    common = (F.lit("auto").alias("status"), F.lit("mined").alias("source"), F.lit(None).cast("timestamp_ntz").alias("retired_at"))
    lines = rows.select(key("line").alias("group_id"), "brand_id", "product_type", F.col("line").alias("slug"), F.col("line").alias("name"), F.array(F.concat(F.lit("the "), "line")).alias("aliases"), F.lit(None).cast("string").alias("parent_id"), *common)
    models = rows.select(key("model").alias("group_id"), "brand_id", "product_type", F.replace("model", F.lit(" "), F.lit("-")).alias("slug"), F.col("model").alias("name"), F.array().cast("array<string>").alias("aliases"), key("line").alias("parent_id"), *common)
    return stored(lines.distinct().unionByName(models.distinct()), "groups"), rows


_GROUPS_SQL = """groups AS (SELECT DISTINCT brand_id || ':' || product_type || ':' || line AS group_id, brand_id, product_type, line AS slug, line AS name, ['the ' || line] AS aliases, NULL AS parent_id FROM listings
  UNION ALL SELECT DISTINCT brand_id || ':' || product_type || ':' || model, brand_id, product_type, replace(model, ' ', '-'), model, []::VARCHAR[], brand_id || ':' || product_type || ':' || line FROM listings)"""
_MERGES_SQL = """merges AS (SELECT a.group_id AS source, b.group_id AS target FROM groups a JOIN groups b USING (brand_id, product_type) WHERE a.slug = 'rod' AND b.slug = 'gear' OR a.slug LIKE 'hot-%' AND b.slug = 'new-' || a.slug[5:])"""


def _merged(spark, sf_dir):
    groups, rows = _groups(spark, sf_dir)
    lines = groups.filter("slug = 'rod'").select(F.col("group_id").alias("source_id"), F.concat_ws(":", "brand_id", "product_type", F.lit("gear")).alias("target_id"))
    models = groups.filter("slug like 'hot-%'").select(F.col("group_id").alias("source_id"), F.replace("group_id", F.lit(":hot "), F.lit(":new ")).alias("target_id"))
    overrides = rows.filter("listing_id % 7 = 0").select("listing_id", F.concat_ws(":", "brand_id", "product_type", "model").alias("group_id"))
    return D.merge(groups, overrides, lines.unionByName(models))


@q(query("""SELECT group_id, CASE WHEN s.source IS NOT NULL THEN 'ignored' WHEN t.target IS NOT NULL THEN 'confirmed' ELSE 'auto' END AS status, CASE WHEN s.source IS NULL THEN coalesce(p.target, parent_id) END AS parent_id,
array_to_string(CASE WHEN t.target IS NULL THEN aliases WHEN slug = 'gear' THEN ['the gear', 'rod', 'the rod'] ELSE ['hot ' || name[5:]] END, '|') AS aliases
FROM groups LEFT JOIN merges s ON s.source = group_id LEFT JOIN merges t ON t.target = group_id LEFT JOIN merges p ON p.source = parent_id""", scoped=False, more=f"{_GROUPS_SQL}, {_MERGES_SQL}"))  # fmt: skip
def merged_groups(spark, sf_dir):
    return _merged(spark, sf_dir)[0].select("group_id", "status", "parent_id", F.array_join("aliases", "|").alias("aliases"))


@q(query("SELECT listing_id, coalesce(target, brand_id || ':' || product_type || ':' || model) AS group_id FROM listings LEFT JOIN merges ON source = brand_id || ':' || product_type || ':' || model WHERE listing_id % 7 = 0", scoped=False, more=f"{_GROUPS_SQL}, {_MERGES_SQL}"))
def merged_overrides(spark, sf_dir):
    """Placements by hand follow the groups that are merged."""
    return _merged(spark, sf_dir)[1]


@q(query("""SELECT listing_id, CASE WHEN listing_id % 5 = 0 THEN brand_id || ':' || product_type || ':' || line ELSE brand_id || ':' || product_type || ':' || model END AS group_id FROM listings WHERE listing_id % 5 = 0 OR listing_id % 2 = 0 AND listing_id % 3 <> 0""", scoped=False))
def moved_listings(spark, sf_dir):
    """Even listings are placed; then every third goes back to the rules and every fifth to its line."""
    groups, rows = _groups(spark, sf_dir)
    key = lambda c: F.concat_ws(":", "brand_id", "product_type", c)
    held = rows.filter("listing_id % 2 = 0").select("listing_id", key("model").alias("group_id"))
    back = rows.filter("listing_id % 3 = 0").select("listing_id", F.lit(None).cast("string").alias("group_id"), F.lit(1).alias("at"))
    there = rows.filter("listing_id % 5 = 0").select("listing_id", key("line").alias("group_id"), F.lit(2).alias("at"))
    elsewhere = rows.filter("listing_id % 7 = 0 and listing_id % 5 <> 0 and listing_id % 3 <> 0").select("listing_id", F.lit("no group").alias("group_id"), F.lit(3).alias("at"))
    return D.move(groups, held, rows, back.unionByName(there).unionByName(elsewhere))


@q(query("SELECT DISTINCT brand_id, unnest(['rod', 'the rod', 'known']) AS phrase FROM listings WHERE line = 'rod'", scoped=False))
def blocked_phrases(spark, sf_dir):
    groups, rows = _groups(spark, sf_dir)
    known = rows.filter("line = 'rod'").select("brand_id", F.explode(F.array(F.lit("known"), F.lit("rod"))).alias("phrase")).distinct()
    return D.block(groups, known, groups.filter("slug = 'rod'").select("group_id"))[1]


@q(query("""SELECT group_id, CASE WHEN slug = 'rod' THEN 'ignored' ELSE 'auto' END AS status, CASE WHEN parent_id NOT LIKE '%:rod' THEN parent_id END AS parent_id FROM groups""", scoped=False, more=_GROUPS_SQL))
def blocked_groups(spark, sf_dir):
    groups, _ = _groups(spark, sf_dir)
    return D.block(groups, groups.select("brand_id", F.col("name").alias("phrase")), groups.filter("slug = 'rod'").select("group_id"))[0].select("group_id", "status", "parent_id")


@q(query("""SELECT brand_id, product_type, slug, CASE WHEN slug = 'super-gear' THEN 'user' ELSE 'mined' END AS source, parent_id FROM (SELECT brand_id, product_type, slug, parent_id FROM groups
UNION ALL SELECT brand_id, product_type, 'super-gear', group_id FROM groups WHERE slug = 'gear')""", scoped=False, more=_GROUPS_SQL))  # fmt: skip
def split_groups(spark, sf_dir):
    """A version of each gear; a phrase that a group has already is refused."""
    groups, _ = _groups(spark, sf_dir)
    gears = groups.filter("slug = 'gear'")
    asked = gears.select(F.col("group_id").alias("source_id"), F.explode(F.array(F.lit("super-gear"), F.lit("gear"), F.lit(""))).alias("slug"), F.lit(" Super Gear ").alias("name"), F.lit(True).alias("as_version"))
    return D.split(groups, asked).select("brand_id", "product_type", "slug", "source", "parent_id")


@q(query("""SELECT group_id, CASE WHEN slug LIKE 'red-%' THEN coalesce((SELECT min(g.group_id) FROM groups g WHERE g.brand_id = groups.brand_id AND g.product_type = groups.product_type AND g.slug = 'gear'), parent_id) WHEN slug LIKE 'old-%' THEN NULL ELSE parent_id END AS parent_id FROM groups""", scoped=False, more=_GROUPS_SQL))
def given_parents(spark, sf_dir):
    """Red models under the gear of their type, old ones under none; a version is no parent."""
    groups, _ = _groups(spark, sf_dir)
    red = groups.filter("slug like 'red-%'").select("group_id", F.concat_ws(":", "brand_id", "product_type", F.lit("gear")).alias("parent_id"))
    old = groups.filter("slug like 'old-%'").select("group_id", F.lit(None).cast("string").alias("parent_id"))
    bad = groups.filter("slug like 'hot-%'").select("group_id", F.replace("group_id", F.lit(":hot "), F.lit(":new ")).alias("parent_id"))
    return D.apply_parents(groups, red.unionByName(old).unionByName(bad)).select("group_id", "parent_id")


@q()
def relist_chains_linked(spark, sf_dir):
    """Chains with reposts told by the market: every ninth listing is one of the listing before it."""
    rows = listings(spark, sf_dir).withColumn("group_id", F.col("model"))
    return G.relists(rows, rows.filter("listing_id % 9 = 0").select("listing_id", (F.col("listing_id") - 1).alias("original_id")))
