"""The listings of a resale market, as a view over the fixture tables."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souk.sources.scratch import held, stamp

#: Bytes of lines that are taken at a time where a table is made in parts; shuffle files of
#: whole listings take about ten times as much.
PART = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str, nth: int = 0, of: int = 1) -> DataFrame:
    """A listing for each line of an order.

    Numbers are given within an order, so no shuffle gathers all rows; the joins
    are left to the optimizer, which broadcasts part and customer while small. Orders
    meet their customers first, then the lines, which are dealt by order already; so
    beyond that size lines are shuffled twice, by order and by part. ``nth`` of ``of``:
    only the orders whose key hashes to it.
    """
    own = lambda name, key: table(spark, sf_dir, name).filter(F.pmod(F.xxhash64(key), F.lit(of)) == nth) if of > 1 else table(spark, sf_dir, name)
    lines = own("lineitem", "l_orderkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    orders = own("orders", "o_orderkey").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    price = F.col("l_extendedprice").cast("decimal(14,2)")
    sold = F.col("l_linestatus") == "F"
    bought = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = lines.withColumn("place", F.row_number().over(place)).join(bought, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        (F.col("l_orderkey") * 1000 + F.col("place")).alias("listing_id"),
        F.substr("p_brand", F.lit(7)).cast("int").alias("brand_id"),
        F.col("p_type").alias("product_type"),
        F.col("p_name").alias("model"),
        F.element_at(F.split("p_name", " "), -1).alias("line"),
        F.element_at(F.split("p_name", " "), 1).alias("color"),
        F.col("l_suppkey").alias("seller"),
        F.col("c_mktsegment").alias("department"),
        F.col("p_size").alias("size"),
        F.col("p_size").alias("likes"),
        F.when(sold, "sold").when(F.col("l_returnflag") == "R", "removed").otherwise("active").alias("status"),
        F.when(F.col("l_returnflag") == "N", "is_new").otherwise("is_used").alias("condition"),
        price.alias("price"),
        F.round(price * (F.lit(1).cast("decimal(4,2)") + F.col("l_tax").cast("decimal(4,2)")), 2).cast("decimal(14,2)").alias("price_initial"),
        F.when(sold, F.round(price * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")), 2)).cast("decimal(14,2)").alias("sold_price"),
        F.timestamp_add("DAY", -(F.col("l_quantity") * F.col("l_linenumber")).cast("int"), F.col("l_shipdate")).alias("listed_at"),
        F.when(sold, F.col("l_shipdate")).alias("sold_at"),
        F.col("l_shipdate").alias("touched_at"),
        (F.col("o_orderpriority") != "5-LOW").alias("exact_sale"),
    )


def parts(spark: SparkSession, sf_dir: str) -> int:
    """In how many parts tables of listings are made."""
    return max(1, -(-sum(size for _, size, _ in stamp(spark, f"{sf_dir}/lineitem.parquet")) // PART))


def kept(spark: SparkSession, sf_dir: str, anew: bool = False) -> DataFrame:
    """The listings as a table that the application's queries share, made some orders at a time."""
    n = parts(spark, sf_dir)
    if n == 1:
        return held(spark, sf_dir, "listings", lambda: listings(spark, sf_dir), anew)
    return held(spark, sf_dir, "listings", lambda: [lambda i=i: listings(spark, sf_dir, i, n).sortWithinPartitions("brand_id") for i in range(n)], anew)


def by_brand(rows: DataFrame, n: int) -> list[DataFrame]:
    """All rows, as up to ``n`` ranges of brands with about as many rows each."""
    if n == 1:
        return [rows]
    brand = F.col("brand_id")
    cuts = sorted(set(rows.agg(F.percentile_approx(brand, [i / n for i in range(1, n)])).first()[0] or []))
    if not cuts:
        return [rows]
    within = [(brand <= cuts[0]) | brand.isNull(), *((brand > low) & (brand <= high) for low, high in pairwise(cuts)), brand > cuts[-1]]
    return [rows.filter(w) for w in within]


#: The same view for the SQL checks.
LISTINGS_SQL = """
listings AS (
  SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS listing_id,
    CAST(substr(p_brand, 7) AS INT) AS brand_id, p_type AS product_type, p_name AS model,
    split_part(p_name, ' ', -1) AS line, split_part(p_name, ' ', 1) AS color,
    l_suppkey AS seller, c_mktsegment AS department, p_size AS size, p_size AS likes,
    CASE WHEN l_linestatus = 'F' THEN 'sold' WHEN l_returnflag = 'R' THEN 'removed' ELSE 'active' END AS status,
    CASE WHEN l_returnflag = 'N' THEN 'is_new' ELSE 'is_used' END AS condition,
    CAST(l_extendedprice AS DECIMAL(14,2)) AS price,
    CAST(round(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 + CAST(l_tax AS DECIMAL(4,2))), 2) AS DECIMAL(14,2)) AS price_initial,
    CAST(CASE WHEN l_linestatus = 'F' THEN round(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) END AS DECIMAL(14,2)) AS sold_price,
    l_shipdate - to_days(CAST(l_quantity * l_linenumber AS INT)) AS listed_at,
    CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS sold_at, l_shipdate AS touched_at,
    o_orderpriority <> '5-LOW' AS exact_sale
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
)"""
