"""Bucketed tables: what a merge gives, which files it touches, and what readers see meanwhile."""

import pytest
from pyspark.sql import functions as F

from pricegrain import storage
from pricegrain.operators import merges, sinks

SCHEMA = "id long, name string, price double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark):
    old = spark.range(1000).select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit(1.0).alias("price"))
    return merges.Table(spark, storage.new_path(spark, "t")).create(old, ["id"], 32)


def test_an_upsert_touches_its_keys_buckets_alone(spark, table):
    before = table.version()
    new = spark.createDataFrame([(7, 2.0, 1), (7, 3.0, 2), (5000, 4.0, 1)], "id long, price double, at int")
    after = table.upsert(new, order="at")
    changed = {k for k in set(before.folders) | set(after.folders) if before.folders.get(k) != after.folders.get(k)}
    assert len(changed) <= 2 and after.number == 1
    assert sorted(set(after.folders[k] for k in changed)) == sorted(f for f in after.folders.values() if f not in before.folders.values())
    got = {r["id"]: (r["name"], r["price"]) for r in table.read().collect()}
    assert len(got) == 1001 and got[7] == ("n7", 3.0) and got[5000] == (None, 4.0) and got[8] == ("n8", 1.0)
    assert table.read(0).count() == 1000


def test_only_touched_buckets_are_read(spark, table):
    seen = []
    table.merge(spark.createDataFrame([(7,)], "id long"), lambda old, new: seen.append(old.inputFiles()) or old)
    assert len({f.split("bucket=")[1].split("/")[0] for f in seen[0]}) == 1


def test_each_kind_of_merge(spark, table):
    table.update(spark.createDataFrame([(1, 5.0, 1), (1, 6.0, 2), (7777, 9.0, 1)], "id long, price double, at int"), order="at")
    table.insert_if_absent(spark.createDataFrame([(1, "x", 0.0), (2000, "y", 0.0), (2000, "y", 0.0)], SCHEMA))
    table.replace(spark.createDataFrame([(2, "a", 1.0), (2, "b", 2.0)], SCHEMA))
    table.remove(spark.createDataFrame([(3,), (4444,)], "id long"))
    got = table.read()
    assert rows(got.where("id in (1, 2, 3, 2000, 7777)")) == [(1, "n1", 6.0), (2, "a", 1.0), (2, "b", 2.0), (2000, "y", 0.0)]
    assert got.count() == 1001


def test_a_batch_counts_once_and_empty_merges_change_nothing(spark, table):
    add = spark.createDataFrame([(1, 5.0)], "id long, price double")
    twice = lambda old, new: old.join(new.select("id", F.col("price").alias("by")), "id", "left").withColumn("price", F.col("price") + F.coalesce("by", F.lit(0.0)))
    for batch in (0, 1, 1, 0):
        table.merge(add, twice, batch)
    assert table.read().where("id = 1").first()["price"] == 11.0
    assert table.upsert(add.where("false")).folders == table.version(2).folders


def test_of_two_commits_on_one_version_the_second_fails(spark, table):
    v = table.version()
    table.remove(spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(merges.Conflict):
        table._publish(merges.Version(v.number + 1, v.keys, v.buckets, v.schema, v.folders, None))
    assert table.read().count() == 999


def test_a_merge_may_not_bring_other_keys(spark, table):
    with pytest.raises(ValueError, match="buckets"):
        table.merge(spark.createDataFrame([(1,)], "id long"), lambda old, new: old.withColumn("id", F.col("id") + 1))
    assert table.version().number == 0


def test_vacuum(spark, table):
    for price in (1.0, 2.0, 3.0):
        table.upsert(spark.range(1000).select("id", F.lit(price).alias("price")))
    assert table.vacuum(keep=1) == 3 and rows(table.read().select("price").distinct()) == [(3.0,)]


def test_keys_empty_and_null(spark):
    t = merges.Table(spark, storage.new_path(spark, "t")).create(spark.createDataFrame([], SCHEMA), ["id"], 4)
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([(1, "a", 1.0), (None, "z", 0.0)], SCHEMA))
    assert t.read().count() == 2
    t.remove(t.read().select("id"))
    assert rows(t.read()) == [(None, "z", 0.0)]


def test_update_with_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], SCHEMA)
    changes = spark.createDataFrame([(1, 3.0, 1), (1, 4.0, 2)], "id long, price double, at int")
    assert rows(sinks.update(old, changes, ["id"], "at")) == [(1, "a", 4.0), (2, "b", 2.0)]


def test_append_count_json(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([(1, "a", 1.0)], SCHEMA).write.parquet(path)
    both = sinks.append(spark.read.parquet(path), spark.createDataFrame([(2, "b")], "id long, name string"))
    assert rows(both) == [(1, "a", 1.0), (2, "b", None)] and sinks.exact_count(spark, path) == 1
    sinks.write_json(both, str(tmp_path / "dry"))
    sinks.write_json(both, str(tmp_path / "json"), commit=True)
    assert not (tmp_path / "dry").exists() and spark.read.schema(SCHEMA).json(str(tmp_path / "json")).count() == 2
