"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document draws the exponential key -ln(u) / w, where u is a hash of its id and w its quality weight. Within a source
documents are sorted by key and their sizes summed up to the source's budget. A source whose target is at least its size
is first taken whole (complete epochs); only the rest of the target is drawn.

No window holds a whole source: keys fall in about n / ROWS_A_BUCKET ranges of a source's n rows, ranges are summed before
the shuffle, a window over the sums gives each range its offset, and only rows of one range are sorted together. Ranges are
even, since they are cut by the keys' distribution in the source: keys of weight w follow 1 - exp(-w key), and how many rows
have which weight (in BINS steps) is counted.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own, the last;
documents with equal keys follow id and text; rows that repeat an id are documents of their own; an empty table gives an
empty result; columns besides doc_id, text and source are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NARROW, Scratch, word_count

ROWS_A_BUCKET = 4096
BINS = 10
WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MOST = 2.0


def quality_weight() -> Column:
    """1 for texts whose mean word length is that of prose, else 0.5."""
    mean = F.length("text") / F.greatest(F.col("size"), F.lit(1))
    return F.when(mean.between(3.5, 12.0), F.lit(1.0)).otherwise(F.lit(0.5))


def uniform(doc_id: str = "doc_id") -> Column:
    """A number in (0, 1) that depends on the id alone."""
    digits = F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """sources (skey, source, source_size) with target: the words each source should give.

    The total is shared by weight; a target stops at most times the source's size, and what is over goes to the others by
    weight until none is above. Sorted by cap / weight, the capped sources come first, so prefix sums give the result at
    once. One row per source meets in this window.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    whole = W.partitionBy(F.lit(1))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest_t = F.sum("source_size").over(whole) * F.lit(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest_w = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("level", rest_t / rest_w).withColumn("k", F.row_number().over(order))
    s = s.withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    level = F.min(F.when(~F.col("capped"), F.struct("k", "level"))).over(whole)["level"]
    first_free = F.min(F.when(~F.col("capped"), F.col("k"))).over(whole)
    s = s.withColumn("at", level).withColumn("free", first_free)
    target = F.when(F.col("free").isNull() | (F.col("k") < F.col("free")), F.col("cap")).otherwise(F.col("at") * F.col("w"))
    return s.select("skey", "source", "source_size", "n", *[c for c in sources.columns if c == "steps"], target.alias("target"))


def mix(docs: DataFrame, scratch: Scratch, weight: Column | None = None, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: what the mix takes of each document.

    A document is taken in the drawn part if at least half of it fits the rest of the budget, so a source misses its
    target by half a document at most.
    """
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sized = docs.select("doc_id", "text", "source", skey.alias("skey"), word_count(F.col("text")).alias("size"))
    sized = sized.withColumn("w", weight if weight is not None else quality_weight())
    key = -F.log(uniform()) / F.col("w")
    step = F.least(F.greatest(F.ceil(F.col("w") * BINS), F.lit(1)), F.lit(BINS)).cast("int").alias("step")
    drawn = scratch.table(sized.select("doc_id", "source", "skey", "size", key.alias("key"), step, F.xxhash64("text").alias("tie")), NARROW)
    sums = drawn.groupBy("skey").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(F.col("step") == k + 1) for k in range(BINS)]).alias("steps"))
    goal = scratch.table(targets(sums, weights, total, most), NARROW)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.select("skey", "source_size", "target", "n", "steps", epochs.alias("epochs"))
    buckets = F.ceil(F.col("n") / F.lit(float(ROWS_A_BUCKET)))
    below = reduce(lambda a, b: a + b, [F.get("steps", F.lit(k)) * (1 - F.exp(-F.col("key") * ((k + 1) / BINS))) for k in range(BINS)]) / F.col("n")
    bucket = F.least(F.floor(below * buckets), buckets - 1).cast("long")
    rows = drawn.join(goal, "skey").withColumn("bucket", bucket).drop("steps", "step")
    offsets = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    up_to = W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = offsets.select("skey", "bucket", F.coalesce(F.sum("bucket_size").over(up_to), F.lit(0)).alias("offset"))
    inner = W.partitionBy("skey", "bucket").orderBy("key", "doc_id", "tie").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("sum", F.sum("size").over(inner)).join(offsets, ["skey", "bucket"])
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    fits = (F.col("offset") + F.col("sum") - F.col("size") / F.lit(2.0)) <= rest
    copies = F.col("epochs") + F.when(fits & (F.col("size") > 0), 1).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), F.when(F.col("size") > 0, copies).otherwise(0).cast("long").alias("copies"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import read

    out = mix(read(spark, sf_dir, "documents"), Scratch(spark))
    return out.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, text, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size
  FROM documents),
k AS (
  SELECT *, -ln((CAST(('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
    / CASE WHEN length(text)::DOUBLE / greatest(size, 1) BETWEEN 3.5::DOUBLE AND 12.0::DOUBLE THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS key
  FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT *, ([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
s2 AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - COALESCE(sum(cap) OVER b, 0.0::DOUBLE)) / (sum(w) OVER () - COALESCE(sum(w) OVER b, 0.0::DOUBLE)) AS level,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k
  FROM s1 WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(k) AS free FROM s2 WHERE cap > level * w),
t AS (
  SELECT source, source_size, CASE WHEN f.free IS NULL OR k < f.free THEN cap ELSE (SELECT level FROM s2 x WHERE x.k = (SELECT free FROM f)) * w END AS target
  FROM s2, f),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN size > 0 AND upto - size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
