"""Scans, places, neighbours and medians in blocks against plain versions."""

import random
import re
import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pricegrain.operators import blocks, listing, market, series

rng = random.Random(12)


def test_last_known(spark):
    rows = sorted({(rng.choice(["a", "b", None]), rng.randrange(200)): rng.choice([None, None, 1, 2, 3]) for _ in range(300)}.items(), key=lambda x: (x[0][0] or "", x[0][1]))
    d = spark.createDataFrame([(k, t, v) for (k, t), v in rows], "k string, t long, v int")
    want, now = {}, {}
    for (k, t), v in rows:
        now[k] = v if v is not None else now.get(k)
        want[k, t] = now[k]
    for size in (1, 7, 1000):
        got = blocks.last_known(d, ["k"], F.floor(F.col("t") / size), ["t"], {"v": F.col("v")})
        assert {(r["k"], r["t"]): r["v"] for r in got.collect()} == want


def test_placed(spark):
    rows = [(rng.choice(["hot"] * 9 + ["a", None]), rng.randrange(50), i) for i in range(2000)]
    got = {r["i"]: r["place"] for r in blocks.placed(spark.createDataFrame(rows, "g string, x int, i int"), ["g"], ["x", "i"]).collect()}
    seen = {}
    for g, _, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        seen[g] = seen.get(g, 0) + 1
        assert got[i] == seen[g]


@pytest.mark.parametrize("size", [4, 5, 4096])
def test_neighbours(spark, size):
    rows = [(rng.choice("ab"), i) for i in range(60)]
    d = spark.createDataFrame(rows, "g string, i int")
    got = {r["i"]: r["near"] for r in blocks.neighbours(d, ["g"], ["i"], F.col("i"), 3, size).collect()}
    for g in "ab":
        ids = [i for h, i in rows if h == g]
        for n, i in enumerate(ids):
            assert got[i] == ids[max(0, n - 3) : n + 4]


@pytest.mark.parametrize("ranges, together", [(4, 3), (16, 10), (1024, 1 << 16)])
def test_medians(spark, ranges, together):
    data = {"a": [rng.random() * 10**rng.randrange(-8, 9) * rng.choice([1, -1]) for _ in range(333)], "b": [5.0] * 100, "c": [1.0, 2.0], "d": [7.5], "e": [0.0] * 50 + [1.0] * 50, None: [float(i % 17) for i in range(200)], "f": [-1e308, 1e308, 3.0, 4.0, 5.0]}
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("a", None), ("a", float("nan")), ("g", None)]
    got = {r["g"]: (r["median"], r["n"]) for r in blocks.medians(spark.createDataFrame(rows, "g string, v double"), "g", F.col("v"), ranges, together).collect()}
    assert got == {g: (statistics.median(v), len(v)) for g, v in data.items()}


def test_medians_of_nothing(spark):
    assert blocks.medians(spark.createDataFrame([], "g string, v double"), "g", F.col("v")).count() == 0


def plain_gaps(points):
    out = []
    for p in {x[0] for x in points}:
        first, second = sorted(x for x in points if x[0] == p and x[3] == 0), sorted(x for x in points if x[0] == p and x[3] == 1)
        if not any(x[2] >= 0 for x in first):
            out += second
            continue
        out += first
        for x in second:
            before = [y for y in first if y[1] <= x[1]]
            if x[2] >= 0 and before and before[-1][2] < 0:
                out.append(x)
    return sorted(out)


@pytest.mark.parametrize("minutes", [10, 1024 * 1440])
def test_gaps_of_long_series(spark, monkeypatch, minutes):
    monkeypatch.setattr(series, "BLOCK_MINUTES", minutes)
    keys = {(rng.randrange(5), rng.randrange(300), rng.randrange(2)) for _ in range(700)}
    points = [(p, km, -1 if p == 4 and s == 0 else rng.choice([-1, 500, 900]), s) for p, km, s in keys]
    got = series.gap_filled(spark.createDataFrame(points, "product_id long, km long, cents long, source int"))
    assert sorted(tuple(r) for r in got.select("product_id", "km", "cents", "source").collect()) == plain_gaps(points)


@pytest.mark.parametrize("days", [2, 1024])
def test_fill_of_long_series(spark, monkeypatch, days):
    monkeypatch.setattr(series, "BLOCK_DAYS", days)
    rows = [(p, date(2024, 1, 1) + timedelta(days=i), rng.choice([None, None, 1.0, 2.0])) for p in range(3) for i in range(40)]
    got = {(r["product_id"], r["day"]): (r["price"], r["in_stock"]) for r in series.forward_filled(spark.createDataFrame(rows, "product_id long, day date, price double")).collect()}
    now = {}
    for p, d, v in rows:
        now[p] = v if v is not None else now.get(p)
        assert got.get((p, d)) == (None if now[p] is None else (now[p], v is not None))


def test_outlier_counts(spark):
    points = [(1, 0, p) for p in (10.0, 11.0, 12.0, 999.0, 1.0, None)] + [(2, 1, None)]
    got = series.outlier_counts(spark.createDataFrame(points, "product_id long, source int, price double"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 6, 0, 2), (2, 0, 1, 0)]


def test_no_window_holds_a_whole_segment(spark):
    d = spark.createDataFrame([(i, float(i % 50), "s") for i in range(500)], "id long, price double, segment string")
    plan = listing.related_products(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(segment" in plan
    assert not re.findall(r"windowspecdefinition\(segment#\d+, \w+#\d+L? (?:ASC|DESC)", plan)  # by segment alone
    many = spark.range(1000).select(F.col("id"), F.lit("s").alias("segment"), (F.col("id") % 7 + 1).cast("int").alias("capacity_gb"))
    value = market.segment_value(many, many.select(F.col("id").alias("product_id"), (F.col("id") * 1.5).alias("price")))
    assert "percentile" not in value._jdf.queryExecution().optimizedPlan().toString()
