"""Queries over titles, phrases, labels, payloads and the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from souk.functions import text as T
from souk.functions.exprs import half_up
from souk.operators import catalog as C
from souk.operators import evaluation as V
from souk.operators import grouping as G
from souk.operators import quality as Q
from souk.operators import schema as J
from souk.operators import titles as P
from souk.plans.market_queries import register
from souk.plans.sql import mined, ngrams, query, support, up, words
from souk.sources.listings import listings, table
from souk.sources.scratch import stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
q = lambda sql=None: register(QUERIES, ORACLE, sql)


@q("SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_partkey <= 900 AND p_partkey < 150 ORDER BY p_partkey DESC LIMIT 21")
def catalog_keyset(spark, sf_dir):
    return C.keyset_page(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey", 21, after=150, upto=900)


@q("SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '(^|[^a-z0-9])wid') AND regexp_matches(lower(p_name), '(^|[^a-z0-9])c')")
def catalog_fts(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(C.prefix_search(F.col("p_name"), ["wid", "c"])).select("p_partkey", "p_name")


@q(query("SELECT brand_id, product_type, count(*) FILTER (status = 'sold') AS sold, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'removed') AS removed FROM listings GROUP BY ALL", scoped=False))
def status_counts_pivot(spark, sf_dir):
    return C.status_counts(listings(spark, sf_dir), "brand_id", "product_type")


@q(query("""SELECT listing_id, price_outlier, CAST(price AS DOUBLE) >= centre * 1.5 AS dear FROM (SELECT *, CASE WHEN mad = 0 THEN CAST(price AS DOUBLE) < centre * 0.05 OR CAST(price AS DOUBLE) > centre * 20 ELSE off > mad * 1.4826 * 2 END AS price_outlier
FROM offs JOIN (SELECT brand_id, line, quantile_cont(off, 0.5) AS mad FROM offs GROUP BY brand_id, line) m USING (brand_id, line))""", scoped=False,
         more="""offs AS (SELECT l.*, centre, abs(CAST(price AS DOUBLE) - centre) AS off FROM listings l JOIN (SELECT brand_id, line, quantile_cont(CAST(price AS DOUBLE), 0.5) AS centre FROM listings GROUP BY brand_id, line) USING (brand_id, line))"""))
def quality_flags(spark, sf_dir):
    return Q.price_flags(listings(spark, sf_dir), "brand_id", "line", k=2).select("listing_id", "price_outlier", "dear")


@q(r"""SELECT doc_id, regexp_matches(text, '(?i)\b(rep|replica|1:1|unauthorized|dhgate)\b') OR regexp_matches(text, '(?i)\binspired\s+by\b') AS replica, regexp_matches(text, '(?i)\b(bundle|lot of|x\s?\d+|set of|read description)\b') AS lot FROM documents""")
def replica_regex(spark, sf_dir):
    return _marks(table(spark, sf_dir, "documents"))


@q(r"""SELECT doc_id, regexp_matches(text, '(?i)\b(rep|replica|1:1|unauthorized|dhgate)\b') OR regexp_matches(text, '(?i)\binspired\s+by\b') AS replica, regexp_matches(text, '(?i)\b(bundle|lot of|x\s?\d+|set of|read description)\b') AS lot FROM documents""")
def replica_regex_all(spark, sf_dir):
    return _marks(table(spark, sf_dir, "documents"))


def _marks(docs):
    return docs.select("doc_id", T.looks_replica(F.col("text"), F.lit(None).cast("string"), F.lit("")).alias("replica"), F.col("text").rlike(T.LOT).alias("lot"))


@q("""WITH names AS (SELECT DISTINCT p_type, p_name AS name FROM part), extra AS (SELECT * FROM names UNION SELECT p_type, replace(name, ' ', '') FROM names UNION SELECT p_type, name || 's' FROM names)
SELECT a.p_type, a.name AS left, b.name AS right, CASE WHEN replace(a.name, ' ', '') = replace(b.name, ' ', '') THEN 'spelling' ELSE 'typo' END AS reason
FROM extra a JOIN extra b ON a.p_type = b.p_type AND a.name < b.name WHERE replace(a.name, ' ', '') = replace(b.name, ' ', '') OR levenshtein(a.name, b.name) <= 1""")
def merge_pairs(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_type", F.col("p_name").alias("name")).distinct()
    more = names.unionByName(names.withColumn("name", F.replace("name", F.lit(" ")))).unionByName(names.withColumn("name", F.concat("name", F.lit("s"))))
    return G.merge_pairs(more, "p_type", "name")


def titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("listing_id"), F.col("source").alias("seller"), F.col("lang").alias("product_type"), F.col("text").alias("title"))


@q(r"""SELECT doc_id, CAST(len(w) AS INT) AS n_words, w[1] AS first, array_to_string(list_sort(list_distinct(w)), ' ') AS vocabulary FROM (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[a-z]+'),
  lambda t: CASE WHEN length(t) < 4 THEN t WHEN length(t) >= 5 AND t LIKE '%ies' THEN t[:-4] || 'y' WHEN regexp_matches(t, '(sses|shes|ches|xes)$') THEN t[:-3] WHEN t LIKE '%s' AND NOT regexp_matches(t, '(ss|us|is|os)$') THEN t[:-2] ELSE t END) AS w FROM documents)""")
def tokenize_words(spark, sf_dir):
    """Runs of a to z; ``tokenize_words_all`` has all words, by the operators' tokenizer."""
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), T.singular).alias("w"))
    return _vocabulary(tokens)


@q(f"""SELECT doc_id, CAST(len(w) AS INT) AS n_words, w[1] AS first, array_to_string(list_sort(list_distinct(w)), ' ') AS vocabulary FROM (SELECT doc_id, {words("text")} AS w FROM documents)""")
def tokenize_words_all(spark, sf_dir):
    """All documents, by the operators' tokenizer."""
    return _vocabulary(table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w")))


def _vocabulary(tokens):
    return tokens.select("doc_id", F.size("w").alias("n_words"), F.get("w", F.lit(0)).alias("first"), F.array_join(F.array_sort(F.array_distinct("w")), " ").alias("vocabulary"))


_TITLES_SQL = "WITH titles AS (SELECT doc_id AS listing_id, source AS seller, lang AS product_type, text AS title FROM documents)"


@q(f"{_TITLES_SQL}, {support('support')} SELECT * FROM support")
def ngram_support(spark, sf_dir):
    return G.phrase_support(titles(spark, sf_dir))


@q(f"""{_TITLES_SQL}, {support('support')},
sides AS MATERIALIZED (SELECT *, CASE WHEN n_words > 1 THEN array_to_string(string_split(phrase, ' ')[: n_words - 1], ' ') END AS head,
  CASE WHEN n_words > 1 THEN array_to_string(string_split(phrase, ' ')[2 :], ' ') END AS tail FROM support)
SELECT s.product_type, s.phrase, s.listings, s.sellers, s.n_words FROM sides s
LEFT JOIN support h ON h.product_type = s.product_type AND h.phrase = s.head LEFT JOIN support t ON t.product_type = s.product_type AND t.phrase = s.tail
WHERE s.sellers >= coalesce(0.5 * h.sellers, 0) AND s.sellers >= coalesce(0.5 * t.sellers, 0)""")
def phrase_collocation(spark, sf_dir):
    return G.collocations(G.phrase_support(titles(spark, sf_dir)))


@q(f"{_TITLES_SQL}, {mined(G.SELLERS, G.PHRASES)} SELECT * REPLACE (array_to_string(variants, '|') AS variants) FROM mined")
def mine_phrases(spark, sf_dir):
    return G.mine(titles(spark, sf_dir)).withColumn("variants", F.array_join("variants", "|"))


def part_titles(spark, sf_dir):
    return listings(spark, sf_dir).select("listing_id", "seller", "product_type", F.col("model").alias("title"))


@q(query("""SELECT product_type, phrase, count(*) AS listings, count(DISTINCT seller) AS sellers, CAST(len(string_split(phrase, ' ')) AS INT) AS n_words FROM (SELECT DISTINCT listing_id, product_type, seller, unnest([model, color, line]) AS phrase FROM (SELECT listing_id, product_type, seller, lower(model) AS model, lower(color) AS color, lower(line) AS line FROM listings)) GROUP BY product_type, phrase""", scoped=False))
def model_phrase_support(spark, sf_dir):
    return G.phrase_support(part_titles(spark, sf_dir))


@q(query(f"""SELECT product_type, listing_id, arg_max(model, struct_pack(n := n_words, a := 0 - spot)) AS model, max(n_words) AS n_words
FROM (SELECT product_type, listing_id, unnest(g) AS phrase, generate_subscripts(g, 1) AS spot FROM (SELECT product_type, listing_id, {ngrams("w")} AS g FROM split))
JOIN (SELECT product_type, model, phrase, CAST(len(string_split(phrase, ' ')) AS INT) AS n_words FROM (SELECT product_type, phrase AS model, unnest(list_append(variants, phrase)) AS phrase FROM mined)) USING (product_type, phrase) GROUP BY product_type, listing_id""",
         scoped=False, more=f"titles AS (SELECT listing_id, seller, product_type, model AS title FROM listings), {mined(2)}"))
def dictionary_match(spark, sf_dir):
    rows = part_titles(spark, sf_dir)
    return G.longest_match(rows, G.mine(rows, sellers=2))


@q(r"""SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS slug, upper(p_name[1]) || lower(split_part(p_name, ' ', 1)[2:]) AS display FROM part""")
def title_normalize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"), F.initcap(F.element_at(F.split("p_name", " "), 1)).alias("display"))


_MODELS = {"gear": 1, "rod": 2, "plate": 3, "hot gear": 4}


@q(query("""SELECT listing_id, CASE WHEN product_type = 'SMALL' THEN NULL WHEN color = 'hot' AND line = 'gear' THEN 4 WHEN listing_id % 10 = 0 THEN 3 ELSE CASE line WHEN 'gear' THEN 1 WHEN 'rod' THEN 2 WHEN 'plate' THEN 3 END END AS key, CASE WHEN listing_id % 10 = 0 THEN 'override' WHEN product_type = 'SMALL' OR line NOT IN ('gear', 'rod', 'plate') THEN 'none' ELSE 'phrase' END AS method FROM listings""".replace("WHEN product_type = 'SMALL' THEN NULL WHEN color = 'hot' AND line = 'gear' THEN 4 WHEN listing_id % 10 = 0 THEN 3", "WHEN listing_id % 10 = 0 THEN 3 WHEN product_type = 'SMALL' THEN NULL WHEN color = 'hot' AND line = 'gear' THEN 4"), scoped=False))
def placements(spark, sf_dir):
    """Every listing's model: its title without brand, colour and noise, in the dictionary of
    its type; every tenth listing was placed by a person."""
    rows = stored(listings(spark, sf_dir).select("listing_id", "product_type", F.concat(F.lit("Acme Works "), F.initcap("model"), F.lit(" Size M 2014")).alias("title")), "titles")
    phrases = lambda of: spark.createDataFrame(of, "phrase string, kind string, of string, rank int")
    names = P.normalize(rows, phrases([("acme work", "brand", "", 0)]), phrases([("cold", "color", "", 0), ("new", "noise", "", 1)]))
    types = rows.select("product_type").distinct().filter("product_type <> 'SMALL'")
    known = spark.createDataFrame([(phrase, key, True, None) for phrase, key in _MODELS.items()], "phrase string, key int, confirmed boolean, parent int")
    found = P.match(rows.select("title", "product_type").distinct().join(names, "title"), types.join(F.broadcast(known)))
    decided = rows.filter("listing_id % 10 = 0").select("listing_id", F.lit(3).alias("key"))
    return P.place(rows, found, decided).select("listing_id", "key", "method")


@q()
def relist_chains(spark, sf_dir):
    return G.relists(listings(spark, sf_dir).withColumn("group_id", F.col("model")))


#: Pairs of keys to their longest common subsequence, a letter of the first at a time; of a row
#: of lengths each is the largest up to its place.
_COMMON = """steps AS (
  SELECT a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: 0) AS r FROM pairs
  UNION ALL SELECT a, b, i + 1, list_transform(range(1, len(b) + 2), lambda j: list_max(list_transform(range(1, j + 1),
    lambda k: greatest(r[k], CASE WHEN k > 1 AND b[k - 1] = a[i + 1] THEN r[k - 1] + 1 ELSE 0 END)))) FROM steps WHERE i < len(a)),
ratios AS (SELECT a, b, 200.0::DOUBLE * r[-1] / (len(a) + len(b)) AS score FROM steps WHERE i = len(a))"""


@q(f"""WITH RECURSIVE raws AS (SELECT n_name AS raw FROM nation UNION SELECT n_name || 'S' FROM nation UNION SELECT r_name FROM region),
ra AS (SELECT raw, regexp_replace(lower(raw), '[^a-z0-9]+', '', 'g') AS a FROM raws), kb AS (SELECT DISTINCT n_name AS known, regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g') AS b FROM nation),
pairs AS (SELECT DISTINCT a, b FROM ra, kb WHERE a <> '' AND b <> ''), {_COMMON}
SELECT raw, known, score FROM ra JOIN ratios USING (a) JOIN kb USING (b) WHERE score >= 92 QUALIFY row_number() OVER (PARTITION BY raw ORDER BY score DESC, known DESC) = 1""")
def brand_fuzzy_match(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("known"))
    raw = names.select(F.col("known").alias("raw")).unionByName(names.select(F.concat("known", F.lit("S")).alias("raw"))).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("raw")))
    return G.fuzzy_match(raw, names)


@q(f"""WITH s AS (SELECT source, count(*) AS n, sum(quality) AS k FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, n, CAST(k AS BIGINT) AS hits, {up("k / n", 6)} AS share,
  {up("((k / n::DOUBLE) + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((k / n::DOUBLE) * (1 - k / n::DOUBLE) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)", 6)} AS low,
  {up("((k / n::DOUBLE) + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt((k / n::DOUBLE) * (1 - k / n::DOUBLE) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)", 6)} AS high FROM s""")
def wilson_shares(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("hits"))
    low, high = V.wilson(F.col("hits"), F.col("n"))
    return rows.select("source", "n", "hits", half_up(F.col("hits") / F.col("n").cast("double"), 6).alias("share"), low.alias("low"), high.alias("high"))


@q(f"""SELECT lang, n, hits, found, gold, {up("hits / nullif(found, 0)::DOUBLE", 6)} AS precision, {up("hits / nullif(gold, 0)::DOUBLE", 6)} AS recall FROM (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1 AND n_chars > 200) AS hits, count(*) FILTER (n_chars > 200) AS found, count(*) FILTER (quality = 1) AS gold FROM documents JOIN labels USING (doc_id) GROUP BY lang)""")
def label_confusion(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("found", F.when(F.col("n_chars") > 200, 1).otherwise(0))
    return V.confusion(rows, "quality", "found", "lang")


@q("""SELECT doc_id, CASE WHEN list_sum(list_transform(string_split(sha256(CAST(doc_id AS VARCHAR)), ''), lambda d: strpos('0123456789abcdef', d) - 1)) % 5 < 2 THEN 'holdout' ELSE 'dev' END AS split FROM documents""")
def split_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.split_of(F.col("doc_id")).alias("split"))


@q("SELECT doc_id FROM documents ORDER BY sha256('sample:' || doc_id) LIMIT 25")
def stable_sample(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(V.sample_order(F.col("doc_id"))).limit(25)


@q("""SELECT 'k' AS path, 'integer' AS type, count(*) AS n, 1.0::DOUBLE AS share FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def schema_paths(spark, sf_dir):
    return J.paths(table(spark, sf_dir, "events"), "props")


@q("SELECT unnest(['k', 'later.k']) AS path, unnest(['removed', 'added']) AS change, unnest(['high', 'info']) AS severity")
def schema_drift(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    old, new = J.paths(events.filter("event_id % 2 = 0"), "props"), J.paths(events.filter("event_id % 2 = 1").withColumn("props", F.concat(F.lit('{"later": '), "props", F.lit("}"))), "props")
    return J.drift(old, new)


@q("""SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '''=' || p_name ELSE p_name END AS name, CASE WHEN p_size > 25 THEN '1' ELSE '0' END AS large FROM part""")
def csv_cells(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("="), "p_name")).otherwise(F.col("p_name")).alias("name"), (F.col("p_size") > 25).alias("large"))
    return C.export(part)


@q("SELECT p_partkey, p_partkey AS position, NULL::BIGINT AS other FROM part")
def cursor_roundtrip(spark, sf_dir):
    asked = {"status": "sold"}
    tokens = table(spark, sf_dir, "part").select("p_partkey", C.cursor("catalog", F.col("p_partkey"), asked).alias("token"))
    return tokens.select("p_partkey", C.cursor_position(F.col("token"), "catalog", asked).alias("position"), C.cursor_position(F.col("token"), "catalog", {"status": "active"}).alias("other"))


@q(f"""WITH s AS (SELECT p_partkey, p_type, CASE p_size % 5 WHEN 0 THEN 'EU ' || (35 + p_size % 14) WHEN 1 THEN 'UK ' || (p_size % 18) WHEN 2 THEN (20 + p_size % 25)::VARCHAR WHEN 3 THEN 'large' ELSE ' one  size ' END AS raw, CASE WHEN p_size % 2 = 0 THEN 'footwear' ELSE 'bottoms' END AS category FROM part),
n AS (SELECT *, upper(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) AS u, TRY_CAST(nullif(regexp_extract(raw, '\\d+'), '') AS INT) AS k FROM s)
SELECT p_partkey, CASE WHEN u = 'LARGE' THEN 'L' WHEN u = 'ONE SIZE' THEN 'OS' WHEN category = 'bottoms' THEN CASE WHEN k BETWEEN 28 AND 40 THEN 'W' || k END
  ELSE CASE WHEN us BETWEEN 3 AND 18 THEN 'US ' || CASE WHEN us = floor(us) THEN CAST(CAST(us AS INT) AS VARCHAR) ELSE CAST(us AS VARCHAR) END END END AS size
FROM (SELECT *, CASE WHEN u LIKE '%EU%' THEN [3, 4, 5, 6, 7, 7.5, 8.5, 9, 10, 11, 12, 13, 14, 15][k - 34] WHEN u LIKE '%UK%' THEN k + 1 ELSE k END AS us FROM n)""")
def size_normalize(spark, sf_dir):
    size = F.col("p_size")
    raw = F.when(size % 5 == 0, F.concat(F.lit("EU "), (35 + size % 14).cast("string"))).when(size % 5 == 1, F.concat(F.lit("UK "), (size % 18).cast("string"))).when(size % 5 == 2, (20 + size % 25).cast("string")).when(size % 5 == 3, "large").otherwise(" one  size ")
    return table(spark, sf_dir, "part").select("p_partkey", T.normal_size(raw, F.when(size % 2 == 0, "footwear").otherwise("bottoms")).alias("size"))


@q(query("""SELECT brand_id, n_models, lines, CAST(no_model AS BIGINT) AS no_model, {share} AS share FROM (SELECT brand_id, count(DISTINCT model) AS n_models, count(DISTINCT line) AS lines, count(*) FILTER (size < 10) AS no_model, count(*) AS n FROM listings GROUP BY brand_id)""".replace("{share}", up("no_model / n::DOUBLE", 6)), scoped=False))
def no_model_share(spark, sf_dir):
    rows = listings(spark, sf_dir)
    out = rows.groupBy("brand_id").agg(F.count_distinct("model").alias("n_models"), F.count_distinct("line").alias("lines"), F.count_if(F.col("size") < 10).alias("no_model"), F.count("*").alias("n"))
    return out.select("brand_id", "n_models", "lines", "no_model", half_up(F.col("no_model") / F.col("n").cast("double"), 6).alias("share"))


@q(query("""SELECT brand_id, product_type, line, versions, CAST(row_number() OVER (PARTITION BY brand_id ORDER BY versions DESC, product_type, line) AS INT) AS place FROM (SELECT brand_id, product_type, line, count(DISTINCT model) AS versions FROM listings GROUP BY ALL) QUALIFY place <= 5""", scoped=False))
def version_counts(spark, sf_dir):
    """The five lines of each brand with most versions; ``version_counts_all`` has all."""
    place = Window.partitionBy("brand_id").orderBy(F.desc("versions"), "product_type", "line")
    return version_counts_all(spark, sf_dir).withColumn("place", F.row_number().over(place)).filter("place <= 5")


@q(query("SELECT brand_id, product_type, line, count(DISTINCT model) AS versions FROM listings GROUP BY ALL", scoped=False))
def version_counts_all(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("brand_id", "product_type", "line").agg(F.count_distinct("model").alias("versions"))


@q(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, 'href="')) AS INT) AS links FROM pages""")
def page_config(spark, sf_dir):
    """What a page's markup holds: title, number of links."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit('href="')).alias("links"))
