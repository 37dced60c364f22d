"""The scheduled price batch and reports on what the provider says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import text as T
from .series import at


def price_rows(catalog: DataFrame, provider: DataFrame, batch_at) -> DataFrame:
    """Rows to append to the price history, one for each catalog product that the provider offers at a price.

    catalog: id, sku, category. provider: asin, current and highest (dollars by price kind). A product without an offer gives
    no row, one that isn't in the catalog neither. All rows bear the batch's time.
    """
    joined = catalog.join(provider, F.col("sku") == F.col("asin"))
    priced = joined.withColumn("price", M.current_price(F.col("current"))).where("price is not null")
    return priced.select(F.col("id").alias("product_id"), "category", "price", M.highest_price(F.col("highest")).alias("regular_price"), F.lit(True).alias("in_stock"), at(batch_at).alias("fetched_at"))


def batch_counts(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """category, products in the catalog, prices saved."""
    return catalog.groupBy("category").agg(F.count(F.lit(1)).alias("products")).join(rows.groupBy("category").agg(F.count(F.lit(1)).alias("saved")), "category", "left").select("category", "products", F.coalesce("saved", F.lit(0)).cast("long").alias("saved"))


def not_returned(catalog: DataFrame, provider: DataFrame) -> DataFrame:
    """Catalog products that the provider didn't return."""
    return catalog.join(provider.select(F.col("asin").alias("sku")), "sku", "left_anti")


def parent_report(products: DataFrame, provider: DataFrame) -> DataFrame:
    """parent, members, capacities, family (two of each at least) of every parent that the provider names."""
    p = products.select("sku", F.coalesce("capacity_gb", T.total_capacity_gb(F.col("name"))).alias("capacity_gb")).join(provider.select(F.col("asin").alias("sku"), "parent"), "sku").where("parent is not null")
    return p.groupBy("parent").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("capacity_gb").alias("capacities")).withColumn("family", (F.col("members") >= 2) & (F.col("capacities") >= 2))


def history_facts(stats: DataFrame) -> DataFrame:
    """What a page says of a product's history: years tracked, low and high with their months, the move over 30 days (null: none worth a word)."""
    years = (F.unix_date("current_day") - F.unix_date("first_day")) / 365.25
    change = M.rounded(F.col("change30")).cast("long")
    moved = F.when(change != 0, F.when(F.col("change30") < 0, "fallen").otherwise("risen"))
    return stats.select(
        "product_id", F.when(years >= 2, M.rounded(years).cast("long").cast("string")).alias("years"), "days", M.money(F.col("low")).alias("low"), M.month_year(F.col("low_day")).alias("low_month"),
        F.when(F.col("high") != F.col("low"), M.money(F.col("high"))).alias("high"), moved.alias("moved"), F.when(moved.isNotNull(), F.abs(change).cast("string")).alias("percent"),
    )


def fitted(name: Column, prefix: str, suffix: Column, token: Column, target: int) -> Column:
    """prefix + name + token + suffix, the name cut at a word so that the whole has about target characters."""
    tok = F.coalesce(F.concat(F.lit(" "), token), F.lit(""))
    room = F.greatest(F.lit(6), F.lit(target - len(prefix)) - F.length(suffix) - F.length(tok))
    return F.concat(F.lit(prefix), T.cap_words(name, room), tok, suffix)
