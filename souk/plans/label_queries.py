"""Gold labels against placements, seeded draws of lines, misspelt brand terms, rules of
tables, versions of a schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.operators import constraints as C
from souk.operators import fuzzy as Z
from souk.operators import labels as L
from souk.operators import reconcile as N
from souk.operators import sampling as A
from souk.plans.market_queries import register
from souk.plans.sql import over, up
from souk.sources.listings import LISTINGS_SQL, listings, table
from souk.sources.scratch import path, stored
from souk.sources.sheet import SheetSink

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
q = lambda sql=None: register(QUERIES, ORACLE, sql)

_KEY = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
_GOLD = """labelled AS (SELECT listing_id, product_type AS gold_type, line, model, CASE WHEN listing_id % 11 = 0 THEN ' None' WHEN listing_id % 13 = 0 THEN 'Descriptor: Color' WHEN listing_id % 17 = 0 THEN '> ' || model WHEN listing_id % 3 = 0 THEN upper(line) || ' > ' || replace(model, ' ', '-') WHEN listing_id % 5 = 0 THEN 'Old-' || line WHEN listing_id % 4 = 0 THEN 'ancient ' || line ELSE model END AS gold_model,
  CASE WHEN listing_id % 23 = 0 THEN 'other' ELSE product_type END AS placed_type, CASE WHEN listing_id % 19 = 0 THEN 'none' ELSE 'model' END AS found FROM listings)"""


@q(f"""WITH RECURSIVE {LISTINGS_SQL}, {_GOLD},
canon AS (SELECT DISTINCT line AS a, 'old ' || line AS b FROM listings UNION ALL SELECT DISTINCT 'old ' || line, 'ancient ' || line FROM listings),
pairs AS (SELECT {_KEY.format("a")} AS a, {_KEY.format("b")} AS b FROM canon UNION ALL SELECT {_KEY.format("b")}, {_KEY.format("a")} FROM canon),
reach AS (SELECT a, a AS b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
parsed AS (SELECT *, trim(gold_model) AS t, CASE WHEN lower(trim(gold_model)) = 'none' THEN 'none' WHEN lower(trim(gold_model)) LIKE 'descriptor%' THEN 'descriptor' WHEN trim(split_part(gold_model, '>', 1)) = '' THEN NULL ELSE 'model' END AS kind,
  {_KEY.format("split_part(gold_model, '>', 1)")} AS l, {_KEY.format("CASE WHEN contains(gold_model, '>') THEN split_part(gold_model, '>', 2) ELSE gold_model END")} AS v FROM labelled),
right_ones AS (SELECT *, coalesce(kind = 'model' AND found = 'model' AND (l = {_KEY.format("line")} OR EXISTS (SELECT 1 FROM reach WHERE a = l AND b = {_KEY.format("line")})), false) AS lenient,
  coalesce(kind = 'model' AND found = 'model' AND (v = {_KEY.format("model")} OR EXISTS (SELECT 1 FROM reach WHERE a = v AND b = {_KEY.format("model")})), false) AS strict FROM parsed)
SELECT gold_type, count(*) AS labels, {up(over("count(*) FILTER (lenient)", "count(*) FILTER (found = 'model')"), 6)} AS precision, {up(over("count(*) FILTER (lenient)", "count(*) FILTER (kind = 'model')"), 6)} AS recall, {up(over("count(*) FILTER (strict)", "count(*) FILTER (found = 'model')"), 6)} AS strict,
  {up(over("count(*) FILTER (found = 'none' AND kind = 'none')", "count(*) FILTER (found = 'none')"), 6)} AS none_precision, {up(over("count(*) FILTER (placed_type = gold_type)", "count(*)"), 6)} AS types FROM right_ones WHERE kind IS NOT NULL GROUP BY gold_type""")
def gold_labels(spark, sf_dir):
    """Shares of labels that placements meet; lines are known by spellings of spellings."""
    rows, n = listings(spark, sf_dir), F.col("listing_id")
    text = F.when(n % 11 == 0, " None").when(n % 13 == 0, "Descriptor: Color").when(n % 17 == 0, F.concat(F.lit("> "), "model")).when(n % 3 == 0, F.concat(F.upper("line"), F.lit(" > "), F.replace("model", F.lit(" "), F.lit("-"))))
    text = text.when(n % 5 == 0, F.concat(F.lit("Old-"), "line")).when(n % 4 == 0, F.concat(F.lit("ancient "), "line")).otherwise(F.col("model"))
    labels = rows.select("listing_id", F.col("product_type").alias("gold_type"), text.alias("gold_model"))
    placed = rows.select("listing_id", F.when(n % 23 == 0, "other").otherwise(F.col("product_type")).alias("product_type"), F.when(n % 19 == 0, "none").otherwise("model").alias("kind"), F.array("line").alias("line_names"), F.array("model").alias("leaf_names"))
    lines = rows.select("line").distinct()
    old = F.concat(F.lit("old "), "line")
    canon = lines.select(F.col("line").alias("canon"), F.array(old).alias("aliases")).unionByName(lines.select(old.alias("canon"), F.array(F.concat(F.lit("ancient "), "line")).alias("aliases")))
    return L.shares(L.judged(labels, placed, L.spellings(canon)), "gold_type")


@q(f"""WITH {LISTINGS_SQL}, lines AS (SELECT product_type, line, count(*) AS sales FROM listings WHERE status = 'sold' GROUP BY ALL),
sums AS (SELECT *, sum(sales) OVER (ORDER BY product_type, line) AS upto, sum(sales) OVER () AS total FROM lines),
points AS (SELECT i AS draw, CAST(CAST('0x' || substr(sha256('7:' || i), 1, 13) AS HUGEINT) * (SELECT max(total) FROM sums) // {2**A.BITS} AS BIGINT) AS spot FROM (SELECT unnest(range(1, 501)) AS i))
SELECT draw, product_type, line, sales FROM points JOIN sums ON spot >= upto - sales AND spot < upto""")
def seeded_draws(spark, sf_dir):
    """Lines drawn in proportion to their sales."""
    lines = listings(spark, sf_dir).filter("status = 'sold'").groupBy("product_type", "line").agg(F.count("*").alias("sales"))
    return A.draws(lines, "sales", ["product_type", "line"], 500, 7)


@q()
def brand_typos(spark, sf_dir):
    """Titles that name their brand (here: a nation) with a slip, without it."""
    terms = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("brand_id"), F.lower("n_name").alias("term"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_partkey") % 25).cast("int").alias("brand_id")).join(F.broadcast(terms), "brand_id")
    at = F.col("p_partkey") % F.length("term") + 1
    head, tail = F.substring("term", F.lit(1), at - 1), F.substring("term", at, F.length("term"))
    slip = F.when(F.col("p_partkey") % 3 == 0, F.concat(head, F.substring(tail, F.lit(2), F.length("term")))).when(F.col("p_partkey") % 3 == 1, F.concat(head, F.lit("x"), tail)).otherwise(F.col("term"))
    title = F.concat_ws(" ", F.substring_index("p_name", " ", 1), slip, F.substring("p_name", F.instr("p_name", " ") + 1, F.length("p_name")))
    rows = parts.select("p_partkey", "brand_id", title.alias("title"))
    titles = rows.select("brand_id", "title").distinct().withColumn("tokens", F.split("title", " +"))
    found = Z.without_misspelt(titles, terms, ["brand_id"])
    return rows.join(found, ["brand_id", "title"]).select("p_partkey", "title", F.array_join("tokens", " ").alias("rest"))


RULES = [
    C.Key("one name a type and size", "models", ("id",), columns=("name", "type", "size")),
    C.Reference("lines have a model", "sales", ("order_id", "place"), columns=("model",), to="small", there=("id",)),
    C.Bounds("sizes of the scale", "models", ("id",), column="size", low=2, high=49),
    C.Values("types of the taxonomy", "models", ("id",), column="type", allowed=("STANDARD", "SMALL", "MEDIUM", "LARGE")),
    C.Filled("lines have a name", "models", ("id",), column="line"),
    C.Acyclic("parents end", "models", ("id",), ident="id", parent="parent"),
    C.Exclusive("no line is a color", "models", ("id",), column="line", others="small", other="color"),
]

_MODELS = """models AS (SELECT p_partkey AS id, p_name AS name, p_type AS type, p_size AS size, CASE WHEN p_partkey % 53 = 0 THEN ' ' WHEN p_partkey % 59 = 0 THEN upper(split_part(p_name, ' ', 1)) ELSE split_part(p_name, ' ', -1) END AS line, split_part(p_name, ' ', 1) AS color,
  CASE WHEN p_partkey % 97 = 0 THEN p_partkey * 2 WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part), small AS (SELECT * FROM models WHERE size <= 45)"""


@q(f"""WITH RECURSIVE {_MODELS}, ended AS (SELECT id FROM models m WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM models o WHERE o.id = m.parent) UNION SELECT m.id FROM models m JOIN ended e ON m.parent = e.id)
SELECT 'one name a type and size' AS rule, 'models' AS table_name, CAST(id AS VARCHAR) AS row, n || ' rows' AS detail FROM models JOIN (SELECT name, type, size, count(*) AS n FROM models GROUP BY ALL HAVING n > 1) USING (name, type, size)
UNION ALL SELECT 'lines have a model', 'sales', l_orderkey || ':' || l_linenumber, CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_partkey NOT IN (SELECT id FROM small)
UNION ALL SELECT 'sizes of the scale', 'models', CAST(id AS VARCHAR), CAST(size AS VARCHAR) FROM models WHERE size < 2 OR size > 49
UNION ALL SELECT 'types of the taxonomy', 'models', CAST(id AS VARCHAR), type FROM models WHERE type NOT IN ('STANDARD', 'SMALL', 'MEDIUM', 'LARGE')
UNION ALL SELECT 'lines have a name', 'models', CAST(id AS VARCHAR), 'line' FROM models WHERE trim(line) = ''
UNION ALL SELECT 'parents end', 'models', CAST(id AS VARCHAR), CAST(parent AS VARCHAR) FROM models WHERE id NOT IN (SELECT id FROM ended)
UNION ALL SELECT 'no line is a color', 'models', CAST(id AS VARCHAR), lower(line) FROM models WHERE lower(line) IN (SELECT lower(color) FROM small)""")
def rule_violations(spark, sf_dir):
    """Every row of the tables that breaks one of the rules."""
    n, name = F.col("p_partkey"), F.col("p_name")
    line = F.when(n % 53 == 0, " ").when(n % 59 == 0, F.upper(F.substring_index(name, " ", 1))).otherwise(F.substring_index(name, " ", -1))
    parent = F.when(n % 97 == 0, n * 2).when(n > 1, F.floor(n / 2))
    models = table(spark, sf_dir, "part").select(n.alias("id"), name.alias("name"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), line.alias("line"), F.substring_index(name, " ", 1).alias("color"), parent.cast("long").alias("parent"))
    sales = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("model"))
    return C.violations({"models": models, "sales": sales, "small": models.filter("size <= 45")}, RULES)


FIELDS = [N.Field("id", "bigint", required=True), N.Field("name", "string"), N.Field("size", "int", default="0"), N.Field("fragile", "boolean", default="false")]


@q("""SELECT CASE p_partkey % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' ELSE 'v3' END AS version, p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 3 = 1 AND p_partkey % 10 = 1 THEN NULL ELSE p_size END AS size,
  p_partkey % 3 = 2 AND p_partkey % 2 = 0 AS fragile, CASE WHEN p_partkey % 3 = 1 AND p_partkey % 10 = 1 THEN 'size: bad int: ' || p_size || ' cm' ELSE '' END AS faults FROM part""")
def schema_versions(spark, sf_dir):
    """Parts as three versions of a table wrote them, read as one: ids that were text, sizes
    that came later and as text, a flag that came last, a column that nobody knows."""
    n, parts = F.col("p_partkey"), table(spark, sf_dir, "part")
    old = parts.filter(n % 3 == 0).select(n.cast("string").alias("ID"), F.col("p_name").alias("name"))
    size = F.when(n % 10 == 1, F.concat(F.col("p_size").cast("string"), F.lit(" cm"))).otherwise(F.col("p_size").cast("string"))
    middle = parts.filter(n % 3 == 1).select(n.cast("int").alias("id"), F.col("p_name").alias("name"), size.alias("size"))
    new = parts.filter(n % 3 == 2).select(n.alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("size"), (n % 2 == 0).alias("fragile"), F.col("p_brand").alias("unknown"))
    rows = N.united({"v1": stored(old, "v1"), "v2": stored(middle, "v2"), "v3": stored(new, "v3")}, FIELDS)
    return rows.withColumn("faults", F.array_join(F.transform("faults", lambda f: F.concat(f["column"], F.lit(": "), f["message"])), ", "))


@q("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || CASE p_partkey % 4 WHEN 0 THEN ', "' || p_brand || '"' WHEN 1 THEN chr(13) || chr(10) || p_brand ELSE '' END AS title, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS type FROM part""")
def sheet_round_trip(spark, sf_dir):
    """Parts written as sheets, in two writes, and read back."""
    n = F.col("p_partkey")
    more = F.when(n % 4 == 0, F.concat(F.lit(', "'), "p_brand", F.lit('"'))).when(n % 4 == 1, F.concat(F.lit("\r\n"), "p_brand")).otherwise("")
    rows = table(spark, sf_dir, "part").select(n.cast("string").alias("id"), F.concat("p_name", more).alias("title"), F.when(n % 5 > 0, F.col("p_type")).alias("type"))
    where = path(spark, "sheets")
    spark.dataSource.register(SheetSink)
    for part in (rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")):
        part.repartition(3).write.format("souk_sheet").option("path", where).mode("append").save()
    cells = N.sheets(spark, f"{where}/*.csv")
    return cells.select(*(F.try_element_at("cells", F.lit(c)).alias(c) for c in ("id", "title", "type")))
