"""Listings, facets, search and rankings."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.money import percent_change
from . import series
from .blocks import neighbours

ALIASES = {"wd": "western digital"}


def listing(products: DataFrame, history: DataFrame, as_of) -> DataFrame:
    """Every product with its newest price of the last 48 hours and its change, in percent, against the price nearest to 30 days ago (25 to 35).

    Readings later than as_of count as newest, as day stamps lie ahead of the clock.
    """
    mine = history.join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    now = series.latest(mine.where(F.col("fetched_at") >= series.at(as_of) - F.make_dt_interval(F.lit(0), F.lit(48))))
    was = series.nearest_days_ago(mine, as_of, 30, 5)
    joined = products.join(now.select(F.col("product_id").alias("id"), F.col("price"), F.col("in_stock")), "id", "left").join(was.select(F.col("product_id").alias("id"), F.col("price").alias("base30")), "id", "left")
    return joined.withColumn("change30", percent_change(F.col("price"), F.col("base30")))


def passes(label: str, value: str, category: str) -> Column:
    """One facet as a predicate on name, brand; a label that isn't known passes."""
    name, brand = F.col("name"), F.col("brand")
    if label == "type":
        return (T.ssd_type(name) == value) if category == "ssd" else F.contains(F.lower(name), F.lit(value.lower()))
    if label == "capacity":
        gb = T.total_capacity_gb(F.lit(value))
        total = T.total_capacity_gb(name)
        return (total >= gb) if "+" in value else (total == gb)
    if label == "speed":
        return T.speed_band(T.speed_mhz(name)) == value
    if label == "form factor":
        return T.has(name, r"m\.2") if "M.2" in value else name.contains("2.5")
    if label == "brand":
        return F.lower(brand) == ALIASES.get(value.lower(), value.lower())
    return F.lit(True)


def filtered(products: DataFrame, facets: Mapping[str, str | None], query: str = "", category: str = "ram") -> DataFrame:
    """Products that pass all facets (None: all pass) and whose name and brand match the query, if there is one."""
    tests = [F.coalesce(passes(k, v, category), F.lit(False)) for k, v in facets.items() if v is not None]
    if query:
        tests.append(T.matches_query(query, F.concat_ws(" ", "name", F.coalesce("brand", F.lit("")))))
    return products.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def sorted_by(products: DataFrame, how: str) -> DataFrame:
    """price-asc, price-desc and drop with nulls last; name by Unicode collation; then by id."""
    key = {"price-asc": F.asc_nulls_last("price"), "price-desc": F.desc_nulls_last("price"), "drop": F.asc_nulls_last("change30"), "name": F.collate("name", "UNICODE").asc()}[how]
    return products.orderBy(key, "id")


def biggest_drops(listed: DataFrame, lows: DataFrame, k: int = 4) -> DataFrame:
    """The k products that fell most in 30 days; places left go to those nearest to their all-time low (over 0)."""
    fell = listed.where("price is not null and change30 < 0").select("id", "price", "change30", F.lit(0).alias("mode"), F.col("change30").alias("key"))
    drops = fell.orderBy("key", "id").limit(k)
    rest = listed.where("price is not null").join(drops.select("id"), "id", "left_anti").join(lows.select(F.col("product_id").alias("id"), "all_time_low"), "id").where("all_time_low > 0")
    near = rest.select("id", "price", "change30", F.lit(1).alias("mode"), (F.col("price") / F.col("all_time_low")).alias("key")).orderBy("key", "id").limit(k)
    return drops.union(near).orderBy("mode", "key", "id").limit(k)


def majority_category(results: DataFrame) -> DataFrame:
    """One row: ssd if more results are ssd than not, else ram."""
    ssd = F.count_if(F.col("category") == "ssd")
    return results.agg(F.when(ssd > F.count(F.lit(1)) - ssd, "ssd").otherwise("ram").alias("category"))


def retailer_rows(offers: DataFrame) -> DataFrame:
    """offers (product_id, retailer, price, in_stock, ord) with place: in stock first, then price (null last), then ord."""
    order = W.partitionBy("product_id").orderBy(F.when(F.coalesce("in_stock", F.lit(False)), 0).otherwise(1), F.asc_nulls_last("price"), "ord")
    return offers.withColumn("place", F.row_number().over(order))


def related_products(priced: DataFrame, k: int = 3) -> DataFrame:
    """id, rid, place: the k others of a segment (null equals null) with the nearest price, ties by id.

    A segment's distinct prices, each with its k + 1 smallest ids, are placed in order by ranges; a price's nearest others lie among
    the ids of the k prices before it, of the k after it, and its own. Blocks of prices share k rows with the blocks beside them, so
    neither a segment nor a common price meets in one task, and no pair of the whole segment is made.
    """
    seg = priced.select("id", "price", "segment")
    first = F.row_number().over(W.partitionBy("segment", "price").orderBy("id"))
    prices = seg.withColumn("_r", first).where(F.col("_r") <= k + 1).groupBy("segment", "price").agg(F.collect_list(F.struct("price", "id")).alias("held"))
    around = neighbours(prices, ["segment"], ["price"], F.col("held"), k).select(F.col("segment").alias("_s"), F.col("price").alias("_p"), F.flatten("near").alias("near"))
    met = seg.join(around, F.col("segment").eqNullSafe(F.col("_s")) & (F.col("price") == F.col("_p")))
    others = F.filter("near", lambda o: o["id"] != F.col("id"))
    nearest = F.slice(F.array_sort(F.transform(others, lambda o: F.struct(F.abs(o["price"] - F.col("price")).alias("gap"), o["id"].alias("rid")))), 1, k)
    return met.select("id", F.posexplode(nearest).alias("at", "o")).select("id", F.col("o.rid").alias("rid"), (F.col("at") + 1).alias("place"))
