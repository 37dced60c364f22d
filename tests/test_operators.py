from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pricegrain.operators import alerts, catalog, listing, market, resolve, series, sinks

NOW = datetime(2024, 3, 1)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_parsed_history_golden(spark):
    p = spark.createDataFrame([(1, [1000, 41999, 2000, -1, 3000, 43999, 4000, 999999, 5000, 100], [2500, 42500, 3500, 42000])], "product_id long, primary array<bigint>, secondary array<bigint>")
    got = rows(series.parsed_history(p), "km", "price")
    assert [k for k, _ in got] == [1000, 2000, 2500, 3000] and dict(got)[2500] == 425.0 and dict(got)[2000] is None


def test_parsed_history_secondary_alone(spark):
    p = spark.createDataFrame([(1, [10, -1], [20, 5000, 30, -1])], "product_id long, primary array<bigint>, secondary array<bigint>")
    assert [(r["km"], r["price"]) for r in series.parsed_history(p).orderBy("km").collect()] == [(20, 50.0), (30, None)]


def test_forward_fill(spark):
    d = spark.createDataFrame([(1, i, p) for i, p in enumerate((None, 10.0, None, None, 12.0))], "product_id long, n int, price double").withColumn("day", F.expr("date_add(date'2024-01-01', n)"))
    got = [(r["price"], r["in_stock"]) for r in series.forward_filled(d).orderBy("day").collect()]
    assert got == [(10.0, True), (10.0, False), (10.0, False), (12.0, True)]


def history(spark, data):
    return spark.createDataFrame([(i, p, float(v), True, datetime.fromisoformat(t)) for i, (p, v, t) in enumerate(data)], "id long, product_id long, price double, in_stock boolean, fetched_at timestamp")


def test_latest_and_ties(spark):
    h = history(spark, [(1, 5, "2024-02-01"), (1, 6, "2024-02-01"), (1, 9, "2024-04-01")])
    assert rows(series.latest(h), "price") == [(9.0,)] and rows(series.latest(h, NOW), "price") == [(5.0,)]


def test_nearest_window_is_closed(spark):
    h = history(spark, [(1, 1, "2024-01-26"), (1, 2, "2024-02-06"), (2, 3, "2024-01-25T23:59:59")])
    assert rows(series.nearest_days_ago(h, NOW, 30, 5), "product_id", "price") == [(1, 1.0)]


def test_empty_segment_is_kept(spark):
    p = spark.createDataFrame([(1, "a")], "id long, segment string")
    price = spark.createDataFrame([(1, 10.0)], "product_id long, price double")
    got = market.market_pulse(p, price, price.where("false"), spark.createDataFrame([("a",), ("b",)], "segment string"))
    assert rows(got, "segment", "current_avg_price", "product_count") == [("a", None, 0), ("b", None, 0)]


def test_related_equals_brute_force(spark):
    data = [(i, float((i * 7) % 5), None if i % 4 == 0 else "s") for i in range(40)]
    got = rows(listing.related_products(spark.createDataFrame(data, "id long, price double, segment string")), "id", "place", "rid")
    want = []
    for i, p, s in data:
        for k, (_, r) in enumerate(sorted((abs(q - p), j) for j, q, t in data if j != i and t == s)[:3]):
            want.append((i, k + 1, r))
    assert got == sorted(want)


def test_unique_slugs(spark):
    p = spark.createDataFrame([(1, "c", "a", None), (2, "c", "a", None), (3, "c", "a-2", None), (4, "d", "a", None), (5, "c", "b", "b"), (6, "c", "b", None)], "id long, category string, base string, slug string")
    assert rows(catalog.unique_slugs(p), "id", "slug") == [(1, "a"), (2, "a-2"), (3, "a-2-2"), (4, "a"), (5, "b"), (6, "b-2")]


def plain_slugs(rows):
    """rows: (id, category, base, slug)."""
    taken, out = {(c, s) for _, c, _, s in rows if s is not None}, {}
    for i, c, base, slug in sorted(rows):
        n, made = 1, base if slug is None else slug
        while slug is None and (c, made) in taken:
            n += 1
            made = f"{base}-{n}"
        taken.add((c, made))
        out[i] = made
    return out


@pytest.mark.parametrize("seed", range(6))
def test_unique_slugs_against_a_plain_walk(spark, seed):
    """Bases that are numbers of other bases, chains of them, stored slugs in between, and numbers with zeros in front."""
    import random

    rng = random.Random(seed)
    bases = ["a", "a", "a", "a-2", "a-3", "a-4", "a-2-2", "a-2-3", "a-3-2", "a-02", "a-10", "b", "b-1", "b-2", "-2", "c"]
    rows = [(i, rng.choice("xy"), rng.choice(bases), rng.choice([None] * 9 + ["a-5", "a", "a-2-4", "b-3", "a-3-2"])) for i in rng.sample(range(1000), 150)]
    got = catalog.unique_slugs(spark.createDataFrame(rows, "id long, category string, base string, slug string"))
    assert {r["id"]: r["slug"] for r in got.collect()} == plain_slugs(rows)


def test_rate_limit(spark):
    minutes = (0, 1, 2, 3, 60, 61)
    r = spark.createDataFrame([("k", i, datetime(2024, 1, 1, m // 60, m % 60)) for i, m in enumerate(minutes)], "key string, id long, ts timestamp")
    assert [x["accepted"] for x in alerts.decided(r, 3, 60).orderBy("id").collect()] == [True, True, True, False, True, True]


def test_alerts(spark):
    a = spark.createDataFrame([(1, 1, 10.0, True, False), (2, 1, 9.0, True, False), (3, 2, 10.0, True, False), (4, 1, 99.0, False, False)], "id long, product_id long, target_price double, confirmed boolean, triggered boolean")
    prices = spark.createDataFrame([(1, 10.0), (2, 5.0)], "product_id long, price double")
    products = spark.createDataFrame([(1, "s", "n")], "id long, sku string, name string")
    lows = spark.createDataFrame([(1, 8.0)], "product_id long, all_time_low double")
    assert rows(alerts.hits(a, prices, products, lows), "id", "known") == [(1, True), (3, False)]


def test_near_misses_equal_brute_force(spark):
    keys = ["a-b-c", "a-b-d", "a-b", "a-b-c-c", "x-y", "a-b-c-d", "b-a-c", "a-a-b"]
    got = rows(resolve.near_misses(spark.createDataFrame([(k,) for k in keys], "key string")), "a", "b")
    want = []
    for x in keys:
        for y in keys:
            tx, ty = x.split("-"), y.split("-")
            left, right = [t for t in tx if t not in ty], [t for t in ty if t not in tx]
            if x < y and abs(len(tx) - len(ty)) <= 1 and len(left) <= 1 and len(right) <= 1 and len(left) + len(right) >= 1:
                want.append((x, y))
    assert got == sorted(want)


def test_clusters_ignore_row_order(spark):
    data = [(i, "ram", "Corsair", f"Vengeance RGB {8 * (i % 3 + 1)}GB DDR5", 8 * (i % 3 + 1), "P" if i < 2 else None) for i in range(6)]
    make = lambda d: rows(resolve.clustered(spark.createDataFrame(d, "id long, category string, brand string, name string, capacity_gb int, parent string")), "id", "family_id", "tier")
    assert make(data) == make(data[::-1])
    assert [t for _, _, t in make(data)] == [1, 1, 2, 2, 2, 2]


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, name string, price double")
    new = spark.createDataFrame([(2, 9.0, 1), (2, 8.0, 2), (3, 7.0, 1)], "id long, price double, n int")
    assert rows(sinks.upsert(old, new.drop("n").where("price < 9"), ["id"]), "id", "price") == [(1, 1.0), (2, 8.0), (3, 7.0)]
    assert rows(sinks.update(old, new.where("n = 2").select("id", "price"), ["id"]), "id", "name", "price") == [(1, "a", 1.0), (2, "b", 8.0)]
    kept, gone = sinks.delete(old, F.lit(None).cast("boolean"))
    assert kept.count() == 2 and gone.count() == 0
    table, inserted = sinks.insert_if_absent(old, old.withColumn("id", F.col("id") + 1), ["id"])
    assert rows(inserted, "id") == [(3,)] and table.count() == 3
    with pytest.raises(ValueError):
        sinks.guard(old.union(old), ["name"], ["id"])


def test_commit(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.commit(spark.range(3), path) is None
    assert sinks.commit(spark.range(3), path, commit=True) == 3
    assert sinks.commit(sinks.append(spark.read.parquet(path), spark.range(2)), path, commit=True) == 5


def test_catalog_funnel(spark):
    r = [("a", "X DDR5", "ram", "20", 0, 0), ("a", "Y DDR5", "ram", "30", 0, 1), ("b", "Z DDR5", "ram", "9.99", 0, 2), ("c", "USB DDR5", "ram", "20", 0, 3), ("d", "cable", "ram", "20", 1, 0), ("e", "E DDR5", "ram", "", 1, 1)]
    df = spark.createDataFrame(r, "asin string, name string, category string, min_price string, query_idx int, pos int").withColumn("price", F.lit(None).cast("string")).withColumn("max_price", F.lit(None).cast("string"))
    kept, rejects = catalog.built(df)
    assert rows(kept, "asin", "name", "amount") == [("a", "X DDR5", 20.0)] and rows(rejects, "reason", "n") == [("cheap", 1), ("external", 1), ("nameFilter", 1), ("noPrice", 1)]


def test_a_commit_that_broke_off_is_restored(spark, tmp_path):
    path = str(tmp_path / "table")
    assert sinks.commit(spark.range(3), path, commit=True) == 3 and sinks.commit(spark.range(5), path, commit=True) == 5
    (tmp_path / "table").rename(tmp_path / "table.old-x")
    assert sinks.restore(spark, path) and spark.read.parquet(path).count() == 5 and not sinks.restore(spark, path)


def test_repeated_keys_choose_the_same_row(spark):
    new = [(1, "b", 5), (1, "a", 5), (2, "c", 1), (2, "d", 2)]
    old = spark.createDataFrame([(3, "z", 0)], "k int, v string, at int")
    for order in (None, "at"):
        got = [rows(sinks.upsert(old, spark.createDataFrame(x, old.schema), ["k"], order), "k", "v", "at") for x in (new, new[::-1])]
        assert got[0] == got[1] and len(got[0]) == 3 and (order is None or (2, "d", 2) in got[0])


def test_lookup_by_a_unique_key(spark):
    d = spark.range(4)
    assert catalog.only_row(d.where("id = 9")) is None and catalog.only_row(d.where("id = 2"))["id"] == 2
    with pytest.raises(ValueError, match="several"):
        catalog.only_row(d)


@pytest.mark.parametrize("hot", [1, 3, 4096])
def test_frequent_words_and_places_are_dealt_to_tasks(spark, monkeypatch, hot):
    """Names and keys that nearly all share words, at every size of what counts as frequent, against all pairs."""
    import random

    monkeypatch.setattr(resolve, "HOT", hot)
    draw = random.Random(3)
    words = ["vengeance", "trident", "fury", "ripjaws", "royal"]
    title = lambda some: " ".join(sorted(some)) + " 16GB DDR5"
    ours = [(i, "ram", "Acme", "Acme " + title(draw.sample(words, draw.randint(1, 2)))) for i in range(12)]
    theirs = [(f"N{i}", "Acme" if i % 4 else None, "ram", ("Acme " if i % 8 else "") + title(draw.sample(words, draw.randint(1, 4))), float(i), "shop", True, "", "u") for i in range(40)]
    theirs += [theirs[5], ("N99", "Acme", None, None, 1.0, "shop", True, "", "u")]
    products = spark.createDataFrame(ours, "id long, category string, brand string, name string")
    feed = spark.createDataFrame(theirs, "feed_sku string, brand string, category string, name string, price double, seller string, in_stock boolean, mpn string, url string")
    from collections import Counter

    got = Counter((r["product_id"], r["feed_sku"]) for r in resolve.match_by_name(products, feed).collect())
    want = Counter((o[0], t[0]) for o in ours for t in theirs if t[3] and set(o[3].split()[1:]) <= set(t[3].split()) and "acme" in (t[1] or t[3]).lower())
    assert want and got == want

    keys = sorted({"-".join(draw.choices("abcd", k=draw.randint(1, 4))) for _ in range(60)})
    near = lambda x, y: (abs(len(x) - len(y)) <= 1, [t for t in x if t not in y], [t for t in y if t not in x])
    pairs = [(x, y, *near(x.split("-"), y.split("-"))) for x in keys for y in keys if x < y]
    found = spark.createDataFrame([(k,) for k in [*keys, keys[0], None]], "key string")
    assert rows(resolve.near_misses(found), "a", "b") == sorted((x, y) for x, y, size, l, r in pairs if size and len(l) <= 1 and len(r) <= 1 and len(l) + len(r) >= 1)


def test_points_are_made_once(spark):
    """Filling gaps and judging prices read their points several times, but work them out once."""
    from pricegrain.operators import series

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    points = spark.createDataFrame([(1, 0, 600, 0), (1, 9, -1, 0), (1, 12, 700, 1), (1, 20, 90000, 0), (2, 3, 800, 1)], "product_id long, km long, cents long, source int")
    priced = series.gap_filled(points.mapInArrow(count, points.schema)).withColumn("price", F.col("cents") / 100)
    assert rows(series.outlier_counts(priced), "product_id", "primary", "secondary", "dropped") == [(1, 3, 1, 2), (2, 0, 1, 0)]
    assert made.value == 5


def test_titles_of_many_rows_are_matched_once(spark, monkeypatch):
    """Rows of one title on both sides meet as classes: feed rows are ranked once for the title, not for each product."""
    seen, best = [], resolve.best_candidate
    monkeypatch.setattr(resolve, "best_candidate", lambda c, *more: seen.append(c.count()) or best(c, *more))
    title = "Acme Vengeance 16GB DDR5"
    products = spark.createDataFrame([(i, "ram", "Acme", title) for i in range(20)] + [(99, "ram", None, title)], "id long, category string, brand string, name string")
    feed = spark.createDataFrame([(f"N{i:02}", None, "ram", title, float(30 - i), "shop", i % 2 == 0, "", "u") for i in range(30)], "feed_sku string, brand string, category string, name string, price double, seller string, in_stock boolean, mpn string, url string")
    got = rows(resolve.match_by_name(products, feed), "product_id", "rank", "feed_sku")
    order = [f"N{i:02}" for i in sorted(range(30), key=lambda i: (i % 2, -i))]
    assert got == sorted((p, r + 1, sku) for p in [*range(20), 99] for r, sku in enumerate(order))
    assert seen == [60]
    # two products of one id have one ranking
    twice = products.where("id < 2").withColumn("id", F.lit(5).cast("long"))
    assert sorted(r["rank"] for r in resolve.match_by_name(twice, feed).collect()) == list(range(1, 61))


def test_part_numbers_are_read_once(spark, monkeypatch):
    """What part numbers leave over is matched by names several times, but worked out once."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    products = spark.createDataFrame([(1, "ram", "Acme", "Acme Fury 16GB DDR5 (CMK123456)"), (2, "ram", "Acme", "Acme Royal 16GB DDR5"), (3, "ram", "Acme", "Acme Fury 8GB DDR5")], "id long, category string, brand string, name string")
    feed = spark.createDataFrame([("N1", "Acme", "ram", "Acme Fury 16GB DDR5", 1.0, "shop", True, "cmk-123456", "u"), ("N2", "Acme", "ram", "Acme Royal 16GB DDR5", 1.0, "shop", True, "", "u")], "feed_sku string, brand string, category string, name string, price double, seller string, in_stock boolean, mpn string, url string")
    got = resolve.matched_offers(products.mapInArrow(count, products.schema), feed)
    assert rows(got, "product_id", "feed_sku", "method", "accepted") == [(1, "N1", "mpn", True), (2, "N2", "name", False)]
    assert read.value == 6  # for their part numbers, and for what is left


def test_backfill_works_its_days_out_once(spark):
    """What is returned reads written days: no window of the steps before is run again for the regular price."""
    h = spark.createDataFrame([(1, 10, datetime(2001, 6, 1, 9), 5.0, 0), (1, 11, datetime(2001, 6, 1, 10), 7.0, 0), (1, 12, datetime(2001, 6, 2, 9), None, 0)], "product_id long, km long, fetched_at timestamp, price double, source int")
    out = series.backfill_rows(h, datetime(2001, 6, 30))
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["price"], r["regular_price"], r["in_stock"], r["fetched_at"].hour) for r in out.collect()) == [(7.0, 7.0, False, 23), (7.0, 7.0, True, 23)]
