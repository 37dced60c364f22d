"""Statistics of market segments and where single prices stand in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import percent_change, round1, round2, value_word
from ..functions.text import SEGMENT_LABELS
from .blocks import medians


def market_pulse(products: DataFrame, current: DataFrame, baseline: DataFrame, segments: DataFrame) -> DataFrame:
    """segment, current and baseline median price, percent change and number of products, for every row of segments.

    Only products with both a current and a baseline price count. The change comes from the unrounded medians. A segment
    without products has nulls and a count of 0. Medians are exact: what meets in a segment's task is one counter for each
    distinct price, combined before the shuffle, and prices in cents have at most a million values up to $10,000.
    """
    both = (
        products.where("segment is not null").select(F.col("id").alias("product_id"), "segment")
        .join(current.select("product_id", F.col("price").alias("now")), "product_id")
        .join(baseline.select("product_id", F.col("price").alias("was")), "product_id")
    )
    stats = both.groupBy("segment").agg(F.median("now").alias("c"), F.median("was").alias("b"), F.count(F.lit(1)).alias("n"))
    return segments.join(stats, "segment", "left").select(
        "segment", round2(F.col("c")).alias("current_avg_price"), round2(F.col("b")).alias("baseline_avg_price"), round1(percent_change(F.col("c"), F.col("b"))).alias("pct_change"), F.coalesce("n", F.lit(0)).cast("long").alias("product_count")
    )


def labelled(pulse: DataFrame) -> DataFrame:
    """pulse with label, the segment's name for display; a segment without one shows as it is."""
    names = F.create_map(*[F.lit(x) for pair in SEGMENT_LABELS.items() for x in pair])
    return pulse.withColumn("label", F.coalesce(F.try_element_at(names, F.col("segment")), F.col("segment")))


def excluded(products: DataFrame) -> DataFrame:
    """Products outside all segments, by category."""
    return products.groupBy("category").agg(F.count_if(F.col("segment").isNull()).alias("excluded"), F.count(F.lit(1)).alias("products"))


def segment_value(products: DataFrame, current: DataFrame) -> DataFrame:
    """segment, median price per GB of products with a price and a capacity over 0."""
    priced = products.join(current.select(F.col("product_id").alias("id"), "price"), "id").where("capacity_gb > 0")
    # prices per GB are nearly all distinct, so counters of them would grow with the segment: the middle is selected instead
    return medians(priced, "segment", F.col("price") / F.col("capacity_gb")).select("segment", F.col("median").alias("median_per_gb"), F.col("n").alias("products"))


def value_of_products(products: DataFrame, current: DataFrame) -> DataFrame:
    """id, price per GB, the segment's median and the word for it; a null segment equals a null segment."""
    medians = segment_value(products, current).withColumnRenamed("segment", "_segment")
    priced = products.join(current.select(F.col("product_id").alias("id"), "price"), "id")
    joined = priced.join(medians, F.col("segment").eqNullSafe(F.col("_segment")), "left")
    return joined.select("id", F.when(F.col("capacity_gb") > 0, F.col("price") / F.col("capacity_gb")).alias("per_gb"), "median_per_gb", value_word(F.col("price"), F.col("capacity_gb"), F.col("median_per_gb")).alias("value"))
