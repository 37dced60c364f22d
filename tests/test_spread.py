"""Rows that cost much each are dealt to all tasks, though they lie in one small file."""

from pyspark.sql import functions as F

from pricegrain.functions import text as X
from pricegrain.plans import registry, tables


def test_titles_of_one_file_are_many_tasks(spark):
    sf = "/root/testdata/sf0.001"
    assert tables.products(spark, sf).rdd.getNumPartitions() == 1
    got = registry.queries()["line_signature"](spark, sf)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    whole = tables.products(spark, sf).select("id", X.line_key(F.lit("ram"), F.col("brand"), F.col("title")).alias("key"))
    assert sorted(map(tuple, got.select("id", "key").collect())) == sorted(map(tuple, whole.collect()))
