"""Two mining passes over the fixture's titles: the second meets names spelt anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.operators import regroup as G
from souk.plans.market_queries import register
from souk.plans.sql import mined, ngrams
from souk.plans.text_queries import part_titles
from souk.sources.listings import LISTINGS_SQL

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
q = lambda sql=None: register(QUERIES, ORACLE, sql)

#: Sellers that a phrase of the small fixture needs; in the second pass types that begin with a
#: letter of ``TYPES`` write the first word of their titles with an x before it.
SELLERS, TYPES = 2, "EPS"


def respelt(titles: DataFrame) -> DataFrame:
    anew = F.instr(F.lit(TYPES), F.substring("product_type", 1, 1)) > 0
    return titles.withColumn("title", F.when(anew, F.concat(F.lit("x"), F.col("title"))).otherwise(F.col("title")))


def passes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    titles = part_titles(spark, sf_dir)
    none = spark.createDataFrame([], G.GROUPS), spark.createDataFrame([], "listing_id long, group_id string")
    first = G.regroup(titles, *none, 1, sellers=SELLERS)
    return G.regroup(respelt(titles), *first, 2, sellers=SELLERS)


def _pass_sql(title: str) -> str:
    """Placements of one pass from nothing: product_type, listing_id, model; and its phrases."""
    return f"""(WITH titles AS (SELECT listing_id, seller, product_type, {title} AS title FROM listings), {mined(SELLERS)},
hits AS (SELECT product_type, listing_id, arg_max(model, struct_pack(n := n_words, a := 0 - spot)) AS model FROM (SELECT product_type, listing_id, unnest(g) AS phrase, generate_subscripts(g, 1) AS spot FROM (SELECT product_type, listing_id, {ngrams("w")} AS g FROM split))
  JOIN (SELECT product_type, model, phrase, CAST(len(string_split(phrase, ' ')) AS INT) AS n_words FROM (SELECT product_type, phrase AS model, unnest(list_append(variants, phrase)) AS phrase FROM mined)) USING (product_type, phrase) GROUP BY product_type, listing_id)
SELECT t.product_type, t.listing_id, model FROM titles t LEFT JOIN hits USING (product_type, listing_id))"""


_PASSES = f"""WITH {LISTINGS_SQL}, first AS MATERIALIZED {_pass_sql("model")}, second AS MATERIALIZED {_pass_sql(f"CASE WHEN contains('{TYPES}', product_type[1]) THEN 'x' || model ELSE model END")},
fresh AS (SELECT product_type, model, count(*) AS used FROM second WHERE model IS NOT NULL GROUP BY ALL),
gone AS (SELECT DISTINCT product_type, model FROM first ANTI JOIN fresh USING (product_type, model) WHERE model IS NOT NULL),
moved AS (SELECT s.product_type, s.model AS new, f.model AS old, count(*) AS n FROM second s JOIN first f USING (product_type, listing_id) SEMI JOIN gone g ON g.product_type = f.product_type AND g.model = f.model ANTI JOIN first k ON k.product_type = s.product_type AND k.model = s.model WHERE s.model IS NOT NULL GROUP BY ALL),
kept AS (SELECT product_type, new, arg_max(old, struct_pack(n := n, o := -length(old))) AS old FROM moved JOIN fresh f USING (product_type) WHERE f.model = new AND 2 * n >= used GROUP BY product_type, new),
ids AS (SELECT s.listing_id, CASE WHEN s.model IS NULL THEN s.product_type || ':_none' WHEN EXISTS (SELECT 1 FROM first f WHERE f.product_type = s.product_type AND f.model = s.model) THEN s.product_type || ':' || replace(s.model, ' ', '-') || '@1'
  WHEN k.old IS NOT NULL THEN s.product_type || ':' || replace(k.old, ' ', '-') || '@1' ELSE s.product_type || ':' || replace(s.model, ' ', '-') || '@2' END AS group_id FROM second s LEFT JOIN kept k ON k.product_type = s.product_type AND k.new = s.model)"""


@q(f"{_PASSES} SELECT * FROM ids")
def regroup(spark, sf_dir):
    """Each listing's group after the second pass: names spelt anew keep their ids."""
    return passes(spark, sf_dir)[1]
