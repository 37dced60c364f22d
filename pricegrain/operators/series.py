"""Price series: latest and nearest prices, daily series, lows, highs, averages, gap filling, chart points.

A history has product_id, price, in_stock, fetched_at and id; id orders readings of one instant (the smaller first; any
orderable type). Every function takes the instant as_of instead of reading a clock. Windows and aggregations are by
product, so Spark shuffles a history once by product_id, with ranks limited before the shuffle.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage
from ..functions.money import OUTLIER_FACTOR, PRICE_FLOOR, dollars, minutes_to_timestamp, pairs, percent_change, round2
from . import blocks

def by():
    return W.partitionBy("product_id")


def at(as_of: datetime | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def latest(history: DataFrame, as_of=None, since_hours: int | None = None) -> DataFrame:
    """The newest reading of each product; of one instant the smallest id. as_of leaves out later readings, since_hours older ones."""
    h = history
    if as_of is not None:
        h = h.where(F.col("fetched_at") <= at(as_of))
    if since_hours is not None:
        h = h.where(F.col("fetched_at") >= at(as_of) - F.make_dt_interval(F.lit(0), F.lit(since_hours)))
    rank = F.row_number().over(by().orderBy(F.desc("fetched_at"), "id"))
    return h.withColumn("_r", rank).where(F.col("_r") == 1).drop("_r")


def nearest(history: DataFrame, target, low, high) -> DataFrame:
    """The reading of each product nearest to target in the closed window [low, high]; of equally near ones the smallest (time, id)."""
    distance = F.abs(F.unix_micros("fetched_at") - F.unix_micros(at(target)))
    rank = F.row_number().over(by().orderBy(distance, "fetched_at", "id"))
    return history.where(F.col("fetched_at").between(at(low), at(high))).withColumn("_r", rank).where(F.col("_r") == 1).drop("_r")


def nearest_days_ago(history: DataFrame, as_of, ago: int, within: int) -> DataFrame:
    return nearest(history, at(as_of) - days(ago), at(as_of) - days(ago + within), at(as_of) - days(ago - within))


def daily(history: DataFrame, later_id_wins: bool = False) -> DataFrame:
    """product_id, day, price, in_stock, fetched_at of the last reading of each UTC day."""
    day = F.to_date("fetched_at")
    rank = F.row_number().over(W.partitionBy("product_id", "day").orderBy(F.desc("fetched_at"), F.desc("id") if later_id_wins else F.asc("id")))
    h = history.withColumn("day", day).withColumn("_r", rank).where(F.col("_r") == 1)
    return h.select("product_id", "day", "price", "in_stock", "fetched_at")


def all_time_low(history: DataFrame) -> DataFrame:
    return history.groupBy("product_id").agg(F.min("price").alias("all_time_low"))


def stats(series: DataFrame, as_of) -> DataFrame:
    """Of each product's daily series: current price and day, low and high with the first day they were reached, the mean of the last 90 days, the price near 30 days ago and the change since, first day, number of days, limited (under 30 days)."""
    midnight = F.col("day").cast("timestamp")
    near = midnight.between(at(as_of) - days(35), at(as_of) - days(25))
    distance = F.when(near, F.struct(F.abs(F.unix_micros(midnight) - F.unix_micros(at(as_of) - days(30))).alias("d"), F.col("day"), F.col("price")))
    s = series.groupBy("product_id").agg(
        F.max(F.struct("day", "price")).alias("cur"), F.min(F.struct("price", "day")).alias("low"), F.max(F.struct(F.col("price"), (-F.unix_date("day")).alias("back"))).alias("high"),
        F.avg(F.when(midnight >= at(as_of) - days(90), F.col("price"))).alias("mean"), F.min(distance).alias("base"), F.min("day").alias("first_day"), F.count(F.lit(1)).alias("days"),
    )
    return s.select(
        "product_id", F.col("cur.price").alias("current"), F.col("cur.day").alias("current_day"), F.col("low.price").alias("low"), F.col("low.day").alias("low_day"),
        F.col("high.price").alias("high"), F.date_from_unix_date(-F.col("high.back")).alias("high_day"), round2(F.col("mean")).alias("avg90"), F.col("base.price").alias("base30"),
        round2(percent_change(F.col("cur.price"), F.col("base.price"))).alias("change30"), "first_day", "days", (F.col("days") < 30).alias("limited"),
    )


#: Days and minutes a block of a series: a carry along a product's series is worked out block by block.
BLOCK_DAYS, BLOCK_MINUTES = 1024, 1024 * 1440


def forward_filled(series: DataFrame) -> DataFrame:
    """A daily series whose gap days (price null) carry the last known price as out of stock; gaps before the first price go."""
    carried = blocks.last_known(series.select("product_id", "day", "price", F.col("price").isNotNull().alias("in_stock")), ["product_id"], F.floor(F.unix_date("day") / BLOCK_DAYS), ["day"], {"price": F.col("price")})
    return carried.select("product_id", "day", "price", "in_stock").where("price is not null")


def with_regular_price(series: DataFrame, as_of, trailing: int = 90) -> DataFrame:
    """Adds regular_price: the highest price in stock of the trailing days, the same for all rows of a product."""
    recent = series.where(F.col("in_stock") & (F.col("day").cast("timestamp") >= at(as_of) - days(trailing)))
    highest = recent.groupBy(F.col("product_id").alias("_p")).agg(F.max("price").alias("regular_price"))
    return series.join(highest, F.col("product_id") == F.col("_p"), "left").drop("_p")


def chart_key(day: Column, as_of) -> Column:
    """The bucket of a day: the day within a year, the epoch week (by year) within three, else the month."""
    t = day.cast("timestamp")
    week = F.floor(F.unix_date(day) / 7)
    return F.when(t >= at(as_of) - days(365), F.date_format(day, "yyyy-MM-dd")).when(t >= at(as_of) - days(1095), F.concat(F.date_format(day, "yyyy"), F.lit("-w"), week.cast("string"))).otherwise(F.date_format(day, "yyyy-MM"))


def chart_points(series: DataFrame, as_of, last_days: int | None = None) -> DataFrame:
    """product_id, day, price: the last day of each chart bucket; last_days keeps a trailing range."""
    last = series.withColumn("key", chart_key(F.col("day"), as_of)).groupBy("product_id", "key").agg(F.max(F.struct("day", "price")).alias("p"))
    out = last.select("product_id", F.col("p.day").alias("day"), F.col("p.price").alias("price"))
    return out if last_days is None else out.where(F.col("day").cast("timestamp") >= at(as_of) - days(last_days))


# ------------------------------------------------------------------------------------------------ provider series


def gap_filled(points: DataFrame) -> DataFrame:
    """One series from a primary and a secondary one: points has product_id, km (minutes), cents (negative: no offer) and source (0 primary, 1 secondary).

    A secondary point counts where the primary has no offer at that time, from the gap's start to before the next primary
    point; if the primary has no offer at all, the secondary series counts whole. Both series are sorted together and the
    primary's last state carried forward, block by block, so no range join is needed and no product is one task. Several
    primary points of one minute: a gap if any is one.
    """
    # asked seven times: what points are made of runs once
    points = storage.written(points, "points")
    states = points.where("source = 0").groupBy("product_id", "km").agg(F.bool_or(F.col("cents") < 0).alias("gap"))
    moments = points.where("source = 1").select("product_id", "km").distinct().withColumn("source", F.lit(1)).withColumn("gap", F.lit(None).cast("boolean"))
    both = states.select("product_id", "km", F.lit(0).alias("source"), "gap").unionByName(moments)
    carried = blocks.last_known(both, ["product_id"], F.floor(F.col("km") / BLOCK_MINUTES), ["km", "source"], {"gap": F.col("gap")}).where("source = 1")
    carried = carried.select(F.col("product_id").alias("_p"), F.col("km").alias("_k"), F.col("gap").alias("_gap"))
    offers = points.where("source = 0 and cents >= 0").select(F.col("product_id").alias("_o")).distinct()
    alone = points.where("source = 1").join(offers, F.col("product_id") == F.col("_o"), "left_anti")
    filled = points.where("source = 1 and cents >= 0").join(offers, F.col("product_id") == F.col("_o"), "left_semi").join(carried, (F.col("product_id") == F.col("_p")) & (F.col("km") == F.col("_k"))).where("_gap").select(*points.columns)
    return points.where("source = 0").join(offers, F.col("product_id") == F.col("_o"), "left_semi").unionByName(filled).unionByName(alone)


def judged(points: DataFrame, floor: float = PRICE_FLOOR, factor: float = OUTLIER_FACTOR) -> DataFrame:
    """points with outlier: a price (null: none) under floor or over factor times the product's median; no price is no outlier."""
    points = storage.written(points, "judged")  # read for the medians and again for what they judge
    middle = blocks.medians(points, "product_id", F.col("price")).select(F.col("product_id").alias("_p"), F.col("median").alias("_m"))
    out = (F.col("price") < floor) | F.coalesce(F.col("price") > F.col("_m") * factor, F.lit(False))
    return points.join(middle, F.col("product_id").eqNullSafe(F.col("_p")), "left").withColumn("outlier", F.coalesce(out, F.lit(False))).drop("_p", "_m")


def without_outliers(points: DataFrame, floor: float = PRICE_FLOOR, factor: float = OUTLIER_FACTOR) -> DataFrame:
    """Points whose price (null: none) is at least floor and at most factor times the product's median; points without a price stay."""
    return judged(points, floor, factor).where("not outlier").drop("outlier")


def outlier_counts(points: DataFrame, floor: float = PRICE_FLOOR, factor: float = OUTLIER_FACTOR) -> DataFrame:
    """product_id, primary and secondary (points of each source), dropped (outliers) of every product."""
    return judged(points, floor, factor).groupBy("product_id").agg(F.count_if(F.col("source") == 0).alias("primary"), F.count_if(F.col("source") == 1).alias("secondary"), F.count_if("outlier").alias("dropped"))


def parsed_history(products: DataFrame) -> DataFrame:
    """product_id, km, fetched_at, price, source from products (product_id, primary, secondary), whose arrays alternate minutes and cents."""
    side = lambda name, k: products.select("product_id", F.explode(pairs(F.col(name))).alias("p"), F.lit(k).alias("source"))
    points = side("primary", 0).union(side("secondary", 1)).select("product_id", F.col("p.t").alias("km"), F.col("p.v").alias("cents"), "source")
    priced = gap_filled(points).withColumn("price", dollars(F.col("cents")))
    return without_outliers(priced).select("product_id", "km", minutes_to_timestamp(F.col("km")).alias("fetched_at"), "price", "source")


def backfill_rows(history: DataFrame, as_of) -> DataFrame:
    """Daily rows from a parsed history: the last point of each day, gaps carried forward, regular price, stamped 23:59 UTC."""
    points = history.withColumn("in_stock", F.lit(True)).withColumn("id", F.struct("km", "source"))
    # both are read twice by the step after them: written, no task runs what comes before again beside its own sorts
    last = storage.written(daily(points, later_id_wins=True), "daily")
    filled = with_regular_price(storage.written(forward_filled(last), "filled"), as_of)
    stamp = F.col("day").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59))
    return filled.select("product_id", "price", "regular_price", "in_stock", stamp.alias("fetched_at"))


def without_day_stamps(history: DataFrame) -> DataFrame:
    """Readings that aren't stamped as a whole day's."""
    return history.where(F.date_format("fetched_at", "HH:mm:ss.SSS") != "23:59:00.000")


def newest_batch(history: DataFrame, as_of, hours: int = 36) -> DataFrame:
    """One row: the time of the newest batch of the last hours, day stamps aside."""
    recent = history.where(F.col("fetched_at").between(at(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours)), at(as_of)))
    return without_day_stamps(recent).agg(F.max("fetched_at").alias("batch_at"))


def head_tail(rows: DataFrame, key: str, *order: str, head: int = 5, tail: int = 5) -> DataFrame:
    """The first and the last rows of each key, with place (from 1) and omitted, how many rows lie between."""
    w = W.partitionBy(key)
    numbered = rows.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("n_rows", F.count(F.lit(1)).over(w))
    shown = numbered.where((F.col("place") <= head) | (F.col("place") > F.col("n_rows") - tail))
    return shown.withColumn("omitted", F.greatest(F.col("n_rows") - (head + tail), F.lit(0))).drop("n_rows")
