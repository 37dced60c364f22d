"""The library's relations over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2001, 6, 30)
EVENTS_AS_OF = datetime(2024, 1, 30)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def title() -> Column:
    size = F.col("p_size").cast("string")
    return F.concat("p_brand", F.lit(" "), "p_name", F.lit(" "), size, F.lit("GB (2x"), size, F.lit("GB) DDR5-"), (4800 + F.col("p_size") * 40).cast("string"), F.lit(" CL"), (30 + F.col("p_size") % 20).cast("string"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("sku"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"),
        F.col("p_type").alias("segment"), F.col("p_type").alias("category"), F.col("p_size").alias("capacity_gb"), F.col("p_retailprice").alias("list_price"),
        F.concat_ws("|", "p_brand", "p_name").alias("family_id"), title().alias("title"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_returnflag") != "R").alias("in_stock"),
        F.col("l_shipdate").cast("timestamp").alias("fetched_at"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("id"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert for each line of an order; the target is a share of the list price that grows with the line number."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("created_at"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, "l_partkey")
    return joined.select(
        F.col("o_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("o_custkey").cast("string").alias("email"), F.col("l_partkey").alias("product_id"),
        (F.col("p_retailprice") * (0.5 + 0.25 * F.col("l_linenumber"))).alias("target_price"), "created_at", (F.col("o_orderstatus") != "P").alias("confirmed"), (F.col("o_orderstatus") == "F").alias("triggered"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' offers of a part."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("seller"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_linestatus") == "O").alias("in_stock"), F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("-"), F.format_string("%.2f", "l_extendedprice")).alias("feed_sku"),
    )


P_SQL = """p AS (SELECT p_partkey AS id, 'P' || p_partkey AS sku, p_brand AS brand, p_name AS name, p_type AS segment, p_type AS category, p_size AS capacity_gb, p_retailprice AS list_price,
  p_brand || '|' || p_name AS family_id,
  p_brand || ' ' || p_name || ' ' || p_size || 'GB (2x' || p_size || 'GB) DDR5-' || (4800 + p_size * 40) || ' CL' || (30 + p_size % 20) AS title FROM part)"""
H_SQL = """h AS (SELECT l_partkey AS product_id, l_extendedprice / l_quantity AS price, l_returnflag <> 'R' AS in_stock, l_shipdate AS fetched_at, l_orderkey AS o, l_linenumber AS n, l_extendedprice AS e FROM lineitem)"""
D_SQL = """d AS (SELECT product_id, CAST(fetched_at AS DATE) AS day, price, in_stock FROM (SELECT *, row_number() OVER (PARTITION BY product_id, CAST(fetched_at AS DATE) ORDER BY fetched_at DESC, o, n, e) AS r FROM h) WHERE r = 1)"""
A_SQL = """a AS (SELECT o_orderkey AS order_id, l_linenumber AS line, CAST(o_custkey AS VARCHAR) AS email, l_partkey AS product_id, p_retailprice * (0.5::DOUBLE + 0.25::DOUBLE * l_linenumber) AS target_price,
  o_orderdate AS created_at, o_orderstatus <> 'P' AS confirmed, o_orderstatus = 'F' AS triggered, l_extendedprice / l_quantity AS seen FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
NOW_SQL = """c AS (SELECT product_id, price, in_stock, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY fetched_at DESC, o, n, e) AS r FROM h WHERE fetched_at <= TIMESTAMP '2001-06-30') WHERE r = 1)"""
O_SQL = """x AS (SELECT l_partkey AS product_id, 'S' || l_suppkey AS seller, l_extendedprice / l_quantity AS price, l_linestatus = 'O' AS in_stock, l_orderkey || '-' || l_linenumber || '-' || format('{:.2f}', l_extendedprice) AS feed_sku FROM lineitem)"""
ROUND2 = "floor({} * 100 + 0.5) / 100"
