"""Scans along long series in blocks, so that no key's series is one task.

A series is cut into blocks by a column that doesn't fall along it (a day or minute over a fixed span, say). Each block is worked
on alone, what it hands on is one row, those rows are scanned in order, and each block takes what came before it by a join on (key,
block). One key's rows are as many tasks' work as it has blocks; only one row a block meets in a window of the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to all tasks: narrow rows that cost much each may lie in one small file, which is one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def last_known(rows: DataFrame, keys: list[str], block: Column, order: list[str], values: dict[str, Column]) -> DataFrame:
    """rows with columns that hold, for each of values, its last one that isn't null up to each row (null: none yet).

    order must tell a key's rows apart within a block; block mustn't fall along order. Keys may be null.
    """
    cut = rows.withColumn("_block", block)
    for name, v in values.items():
        cut = cut.withColumn(f"_v_{name}", v)
    inner = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    within = cut.withColumns({f"_w_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inner) for n in values})
    at = F.struct(*order)
    ends = cut.groupBy(*keys, "_block").agg(*[F.max_by(F.struct(F.col(f"_v_{n}").alias("v")), F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_e_{n}") for n in values])
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), *[F.last(F.col(f"_e_{n}.v"), ignorenulls=True).over(before).alias(f"_c_{n}") for n in values])
    same = F.col("_block").eqNullSafe(F.col("_b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = within.join(carried, same, "left")
    return joined.select(*[F.col(c) for c in rows.columns if c not in values], *[F.coalesce(f"_w_{n}", f"_c_{n}").alias(n) for n in values])


def runs(cells: DataFrame, keys: list[str], starts: Column, span: int = 1024) -> DataFrame:
    """cells (keys, cell and other columns) with run: the cell in which the run of cells that each belongs to starts."""
    return last_known(cells, keys, F.floor(F.col("cell") / span), ["cell"], {"run": F.when(starts, F.col("cell"))})


# ------------------------------------------------------------------------------------------------ places


def placed(rows: DataFrame, groups: list[str], order: list[str], within: list[str] | None = None) -> DataFrame:
    """rows, written, with place (from 1) of each row in its group in the given order; null groups are groups, nulls come first.

    within: columns that settle ties of order, too long to cut ranges by (whole texts), as the ends of ranges pass the driver. All rows are dealt in ranges of (groups, order) and numbered range by range, so a group of any size is spread over the tasks. What
    meets in one task is one count a range, and what a group's first place is looked up by is (range, group), no hot key.
    """
    by = [F.asc_nulls_first(c) for c in [*groups, *order]]
    dealt = storage.written(storage.written(rows, "rows").repartitionByRange(*by).sortWithinPartitions(*by, *[F.asc_nulls_first(c) for c in within or []]).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    whole = F.col("_before") + F.col("_at") - F.shiftleft(F.col("_p"), 33)
    heads = dealt.groupBy(part.alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in groups]).agg(F.min("_at").alias("_at")).join(F.broadcast(starts), "_p")
    first = F.min(whole).over(W.partitionBy(*[f"_g_{g}" for g in groups])) if groups else F.lit(0)
    heads = heads.select("_p", *[f"_g_{g}" for g in groups], (first - F.col("_before")).alias("_first"))
    same = part == F.col("_p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    row = F.col("_at") - F.shiftleft(F.col("_p"), 33)
    return dealt.join(heads, same).select(*rows.columns, (row - F.col("_first") + 1).cast("long").alias("place"))


def neighbours(rows: DataFrame, groups: list[str], order: list[str], value: Column, k: int, size: int = 4096) -> DataFrame:
    """rows with near: the values of the k rows before and the k after each in its group, itself included, in order.

    A group's rows are cut into blocks of size places; each block also gets the first and the last k rows of the blocks beside it.
    """
    cut = placed(rows, groups, order).withColumn("_b", F.floor((F.col("place") - 1) / size).cast("long")).withColumn("_v", value)
    inside = (F.col("place") - 1) % size
    beside = F.explode(F.array_compact(F.array(F.col("_b"), F.when(inside < k, F.col("_b") - 1), F.when(inside >= size - k, F.col("_b") + 1))))
    halo = cut.withColumn("_to", beside)
    around = F.collect_list("_v").over(W.partitionBy(*groups, "_to").orderBy("place").rowsBetween(-k, k))
    return halo.withColumn("near", around).where("_to = _b").drop("_b", "_to", "_v", "place")


# ------------------------------------------------------------------------------------------------ selection

#: Ranges a pass counts for each group, and how many values may at last be sorted together.
RANGES, TOGETHER = 1024, 1 << 16


def medians(rows: DataFrame, group: str, value: Column, ranges: int = RANGES, together: int = TOGETHER) -> DataFrame:
    """group, median, n: the exact median of each group's finite values (the mean of the middle two); a null group is a group.

    Selection by counting: a pass counts a group's values in ranges between its smallest and largest one, prefix sums over the ranges
    tell which holds the middle, and only that range is counted again, until at most together values are left in it. No task holds
    more than ranges counters and together values of a group.
    """
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    held = storage.written(rows.where(finite).select(F.col(group).alias("g"), value.cast("double").alias("v")), "values")
    state = held.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")).withColumn("before", F.lit(0).cast("long")).withColumn("left", F.col("n"))
    done: list[DataFrame] = []
    while True:
        state = storage.written(state, "ranges")
        if state.where(F.col("left") > together).isEmpty():
            break
        of = state.select(F.col("g").alias("_g"), "low", "high", "n", "before", "left")
        wide = held.join(of.where(F.col("left") > together), F.col("g").eqNullSafe(F.col("_g"))).where(F.col("v").between(F.col("low"), F.col("high")))
        at = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") / ranges - F.col("low") / ranges) / (F.col("high") / ranges - F.col("low") / ranges) * ranges), F.lit(ranges - 1))).otherwise(0)
        counted = wide.groupBy("g", at.alias("at"), "n", "before").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("left"))
        below = F.coalesce(F.sum("left").over(W.partitionBy("g").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        first, second = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
        counted = counted.withColumn("before", F.col("before") + below).withColumn("over", F.col("before") + F.col("left"))
        counted = storage.written(counted.where((F.col("before") <= second) & (F.col("over") > first)), "counted")
        # where the middle two lie in different ranges, they are the ends of these
        pairs = counted.groupBy("g", "n").agg(F.count(F.lit(1)).alias("k"), F.max(F.when(F.col("over") == second, F.col("high"))).alias("a"), F.min(F.when(F.col("before") == second, F.col("low"))).alias("b"))
        done.append(pairs.where("k = 2").select("g", ((F.col("a") + F.col("b")) / 2).alias("median"), "n"))
        same = counted.where((F.col("before") <= first) & (F.col("over") > second))
        done.append(same.where("low = high").select("g", F.col("low").alias("median"), "n"))
        state = state.where(F.col("left") <= together).unionByName(same.where("low < high").select("g", "low", "high", "n", "before", "left"))
    last = held.join(state.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).where(F.col("v").between(F.col("low"), F.col("high")))
    few = last.groupBy("g", "n", "before").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    mid = lambda k: F.get("vs", (F.floor((F.col("n") - k) / 2) - F.col("before")).cast("int"))
    done.append(few.select("g", ((mid(1) + mid(0)) / 2).alias("median"), "n"))
    out = reduce(DataFrame.unionByName, done)
    return out.select(F.col("g").alias(group), "median", F.col("n").cast("long").alias("n"))
