from datetime import datetime, timedelta

import pytest

from pricegrain.streaming import jobs


def land(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


def run(spark, stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_limiter(spark, tmp_path):
    jobs.with_state_store(spark)
    minutes = (0, 1, 2, 3, 60, 61)
    stream = land(spark, tmp_path, [("k", i, datetime(2024, 1, 1, m // 60, m % 60)) for i, m in enumerate(minutes)], "key string, id long, ts timestamp")
    got = sorted((r["id"], r["accepted"]) for r in run(spark, jobs.limited(stream), tmp_path, "limiter"))
    assert [a for _, a in got] == [True, True, True, False, True, True]


def test_alert_life(spark, tmp_path):
    jobs.with_state_store(spark)
    events = [("a", "create", 1), ("a", "confirm", 2), ("a", "trigger", 3), ("b", "create", 1), ("b", "confirm", 4), ("c", "create", 1), ("c", "unsubscribe", 2)]
    stream = land(spark, tmp_path, [(a, e, datetime(2024, 1, d)) for a, e, d in events], "alert string, event string, ts timestamp")
    got = {(r["alert"], r["event"]): r["after"] for r in run(spark, jobs.alert_lives(stream), tmp_path, "lives")}
    assert got == {("a", "create"): "pending", ("a", "confirm"): "confirmed", ("a", "trigger"): "triggered", ("b", "create"): "pending", ("b", "confirm"): "none", ("c", "create"): "pending", ("c", "unsubscribe"): "none"}


def test_sinks_are_isolated(spark, tmp_path):
    stream = land(spark, tmp_path, [(1, 2.0)], "product_id long, price double")
    seen = []

    def bad(batch, batch_id):
        raise ValueError("mail is down")

    q = jobs.run_batches(stream, {"bad": bad, "good": lambda b, i: seen.append(b.count())}, str(tmp_path / "cp"))
    with pytest.raises(Exception, match="bad"):
        q.awaitTermination(60)
    assert seen == [1]


def test_send_then_mark(spark, tmp_path):
    due = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    marked = jobs.send_then_mark(due, lambda a: a["id"] != 2, due.where("id = 3"), str(tmp_path / "done"))
    assert [r["id"] for r in marked.collect()] == [1]
    again = jobs.send_then_mark(due, lambda a: True, marked.union(due.where("id = 3")), str(tmp_path / "done"))
    assert sorted(r["id"] for r in again.collect()) == [1, 2]


def test_sent_counters(spark):
    """Repeated rows and marks count once, marks of earlier runs and of other alerts not at all."""
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    count = lambda *x: tuple(jobs.sent_counters(*x).first())
    assert count(ids(1, 2, 2, 3, 4), ids(3), ids(3, 2, 2, 9)) == (1, 2)
    assert count(ids(), ids(), ids(1)) == (0, 0) and count(ids(1), ids(), ids()) == (0, 1)


def test_silent_pending_alerts_expire(spark, tmp_path):
    """An alert without further events ends when the stream's time has passed 48 hours; its state is gone."""
    jobs.with_state_store(spark)
    schema = "alert string, event string, ts timestamp"
    for k, rows in enumerate(([("a", "create", 1), ("b", "create", 1), ("b", "confirm", 2)], [("z", "create", 6)], [("y", "create", 7)], [("a", "create", 8)])):
        spark.createDataFrame([(a, e, datetime(2024, 1, d)) for a, e, d in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r["alert"], r["event"], r["before"], r["after"]) for r in run(spark, jobs.alert_lives(stream), tmp_path, "silent"))
    assert ("a", "expire", "pending", "none") in got and ("a", "create", "none", "pending") in got
    assert not [x for x in got if x[:2] == ("b", "expire")] and len([x for x in got if x[:2] == ("a", "create")]) == 2


def test_pulse_at_each_watermark_equals_the_batch_query(spark, tmp_path):
    """After every run the counters give market_pulse at the watermark, for readings, silence, segments and products that come and go."""
    import random

    from pyspark.sql import functions as F

    from pricegrain.operators import market, merges, series
    from pricegrain.streaming import pulse

    jobs.with_state_store(spark)
    draw = random.Random(7)
    start = datetime(2024, 1, 1)
    schema = "product_id long, segment string, price double, fetched_at timestamp, id long"
    rows = [(p, "abc"[p % 3] if p != 8 else None, float(draw.randint(10, 40)), start + timedelta(hours=6 * draw.randint(0, 160)), k) for k, p in enumerate(draw.choices(range(12), k=150))]
    cuts = [start + timedelta(days=d) for d in (0, 9, 16, 17, 30, 48)]
    segments = spark.createDataFrame([("a",), ("b",), ("c",), ("none",)], "segment string")
    table = merges.Table(spark, str(tmp_path / "counters")).create(spark.createDataFrame([], pulse.COUNTERS), pulse.KEYS, 4)
    products = spark.createDataFrame([(p, "abc"[p % 3] if p != 8 else None) for p in range(12)], "id long, segment string")
    history = spark.createDataFrame(rows, schema).drop("segment").cache()
    for low, at in zip(cuts, cuts[1:], strict=False):
        # the last row of each batch has no price and moves time only
        part = [r for r in rows if (low < r[3] or low == start == r[3]) and r[3] <= at] + [(-1, None, None, at, -1)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changes = pulse.price_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ago_days=10, within_days=3)
        pulse.keep_counters(changes, table, str(tmp_path / "cp")).awaitTermination(120)
        target = at - timedelta(days=10)
        want = market.market_pulse(products, series.latest(history, at), series.nearest(history, target, target - timedelta(days=3), target + timedelta(days=3)), segments)
        assert sorted(pulse.pulse(table.read(), segments).collect()) == sorted(want.collect()), at
    assert table.read().where("n <= 0").count() == 0 and table.read().agg(F.sum("n")).first()[0] > 0


def test_next_change_of_a_pulse_is_never_late():
    from pricegrain.streaming.pulse import next_change, seen_at

    readings = [(u, k, float(k), "a") for k, u in enumerate((3, 3, 9, 14, 30, 31))]
    for at in range(80):
        moment = next_change(readings, at, 20, 6) or 80
        assert all(seen_at(readings, x, 20, 6) == seen_at(readings, at, 20, 6) for x in range(at, moment))


def test_a_group_of_products_is_seen_as_each_alone():
    import random

    import numpy as np

    from pricegrain.streaming import pulse

    draw = random.Random(5)
    rows = [(draw.randrange(6), draw.randrange(60), k, float(k), draw.choice(["a", None])) for k in draw.sample(range(200), 80)]
    held = pulse.unpacked(pulse.packed(pulse.pd.DataFrame(rows, columns=pulse.SEEN.names), pulse.SEEN), pulse.SEEN)
    for at in range(-2, 120):
        alone = {p: [(u, i, v, s) for q, u, i, v, s in rows if q == p] for p in range(6)}
        seen = {p: pulse.seen_at(r, at, 20, 6) for p, r in alone.items()}
        newest, baseline = pulse.all_seen_at(held, at, 20, 6)
        assert {held["product_id"][k]: held["id"][k] for k in newest} == {p: n[1] for p, (n, _) in seen.items() if n}
        assert {held["product_id"][k]: held["id"][k] for k in baseline} == {p: b[1] for p, (_, b) in seen.items() if b}
        moments = [m for m in (pulse.next_change(r, at, 20, 6) for r in alone.values()) if m is not None]
        assert pulse.first_change(held, at, 20, 6) == min(moments, default=None)
    none = pulse.unpacked(None, pulse.SEEN)
    assert pulse.first_change(none, 0, 20, 6) is None and not any(map(np.size, pulse.all_seen_at(none, 0, 20, 6)))
