"""Limits on requests against plain walks, with keys that are dense, silent for long, or hot."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricegrain.operators import alerts, blocks
from pricegrain.streaming import jobs

START = datetime(2024, 1, 1)


def plain(requests, limit, minutes):
    """requests: (key, seconds, id)."""
    seen, out = {}, {}
    for key, t, i in sorted(requests, key=lambda r: (r[1], r[2])):
        kept = [x for x in seen.get(key, []) if x > t - minutes * 60]
        out[i] = len(kept) < limit
        seen[key] = kept + [t] * out[i]
    return out


def requests(n=4000):
    rng = random.Random(1)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 0, 1, 30, 600, 3600, 3599, 9000])
        rows.append((rng.choice(["hot"] * 8 + ["a", "b", None]), t, i))
    return rows


@pytest.mark.parametrize("limit, minutes", [(1, 60), (3, 60), (7, 10)])
def test_decisions(spark, limit, minutes):
    rows = requests()
    d = spark.createDataFrame([(k, i, START + timedelta(seconds=t)) for k, t, i in rows], "key string, id long, ts timestamp")
    got = {r["id"]: r["accepted"] for r in alerts.decided(d, limit, minutes).collect()}
    assert got == plain(rows, limit, minutes)


def test_a_hot_key_is_cut_at_gaps(spark):
    """200,000 requests of one key in bursts: chunks lie a window apart, none is large, and walking them takes many tasks."""
    n, burst = 200_000, 100
    d = spark.range(n).select(F.lit("hot").alias("key"), "id", (F.floor(F.col("id") / burst) * 7200 * 1_000_000 + F.col("id") % burst * 1_000_000).alias("us"))
    cut = alerts.chunked(d, "key", "us", 3600 * 1_000_000)
    assert cut.groupBy("chunk").count().agg(F.max("count")).first()[0] == burst
    walked = alerts.decided(d.select("key", "id", F.timestamp_micros("us").alias("ts")), 3, 60)
    assert walked.where("accepted").count() == n // burst * 3
    assert walked.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_accepted_leaps():
    us = np.sort(np.random.default_rng(3).integers(0, 10_000, 3000))
    for limit, width in ((1, 100), (5, 333), (50, 5000)):
        want = plain([("k", int(t), i) for i, t in enumerate(us)], limit, width / 60)
        times, got = [], []
        for part in np.array_split(us, 7):
            got += alerts.accepted(part, times, limit, width).tolist()
        assert got == [want[i] for i in range(len(us))]


def test_runs_in_blocks(spark):
    rng = random.Random(9)
    cells = sorted({(k, rng.randrange(300)) for k in "ab" for _ in range(200)})
    rows = [(k, c, i == 0 or rows_before[0] != k or rng.random() < 0.1) for i, ((k, c), rows_before) in enumerate(zip(cells, [("", 0), *cells], strict=False))]
    want, now = {}, None
    for k, c, s in rows:
        now = c if s else now
        want[k, c] = now
    d = spark.createDataFrame(rows, "k string, cell long, s boolean")
    assert {(r["k"], r["cell"]): r["run"] for r in blocks.runs(d, ["k"], F.col("s"), 7).collect()} == want


def test_mails_under_the_global_cap(spark):
    rng = random.Random(4)
    created = sorted((int(rng.triangular(0, 20 * 86400, 5 * 86400)), i) for i in range(2500))
    log = sorted(rng.randrange(-86400, 10 * 86400) for _ in range(300))
    d = spark.createDataFrame([(i, t * 1_000_000) for t, i in created], "id long, us long")
    for cap in (5, 60, 400):
        sent, want = [(t, 0) for t in log], {}
        for t, i in created:
            recent = sum(1 for x, _ in sent if t - 86400 <= x and (x <= t if _ == 0 else True))
            want[i] = recent < cap
            if want[i]:
                sent.append((t, 1))
        got = {r["id"]: r["sent"] for r in alerts.sendable(d, spark.createDataFrame([(t * 1_000_000,) for t in log], "us long"), cap).collect()}
        assert got == want


def test_admission_against_a_plain_walk(spark):
    rng = random.Random(5)
    asked = []
    for i in range(1500):
        email = rng.choice(["a@x.co", " A@X.co\n", "b@x.co", "c@x.co", "d@x.co", "nobody", None])
        asked.append((i, START + timedelta(minutes=rng.randrange(60 * 24 * 12)), f"ip{rng.randrange(4)}" if rng.random() < 0.95 else None, rng.choice(["", "", "", "", None, "spam"]), rng.random() < 0.9, email, rng.choice(["10", "10", "0"]), f"P{rng.randrange(30)}"))
    table = [("d@x.co", p, True, False, START) for p in range(100, 111)] + [("c@x.co", 1, False, False, START), ("c@x.co", 2, False, None, START - timedelta(hours=1)), ("b@x.co", 3, None, False, START - timedelta(days=9))]
    log = [START + timedelta(hours=h) for h in range(0, 60, 2)]
    got = alerts.admitted(
        spark.createDataFrame(asked, "id long, ts timestamp, ip string, website string, human boolean, email string, price string, product string"),
        spark.createDataFrame([(i, f"P{i}") for i in range(1, 28)], "id long, sku string"),
        spark.createDataFrame(table, "email string, product_id long, confirmed boolean, triggered boolean, created_at timestamp"),
        spark.createDataFrame([(x,) for x in log], "sent_at timestamp"), send_cap=14,
    )
    got = {r["id"]: r["outcome"] for r in got.collect()}
    held, pairs = list(table), {(e, p) for e, p, *_ in table}
    sent, ips = list(log), {}
    for i, ts, ip, website, human, email, price, product in sorted(asked, key=lambda r: (r[1], r[0])):
        if website:
            want = "honeypot_tripped"
        elif not human:
            want = "turnstile_failed"
        else:
            recent = [t for t in ips.get(ip, []) if t > ts - timedelta(hours=1)]
            ips[ip] = recent + [ts] * (len(recent) < 3)
            address, number = (email or "").strip().lower(), int(product[1:])
            if len(recent) >= 3:
                want = "rate_limited"
            elif "@" not in address or price == "0":
                want = "invalid"
            elif not 1 <= number < 28:
                want = "product_not_found"
            elif sum(e == address and not c and ts - timedelta(hours=48) <= at <= ts for e, _, c, _, at in held) >= 3:
                want = "email_pending_cap"
            elif sum(e == address and bool(c) and not t for e, _, c, t, _ in held) >= 10:
                want = "email_active_cap"
            elif (address, number) in pairs:
                want = "deduped"
            else:
                pairs.add((address, number))
                held.append((address, number, False, False, ts))
                open_ = sum(ts - timedelta(hours=24) <= x <= ts for x in sent) < 14
                want = "created_sent" if open_ else "created_breaker_deferred"
                if open_:
                    sent.append(ts)
        assert got[i] == want, (i, want)
    assert len(Counter(got.values())) == 10


def test_silent_keys_leave_the_state(spark, tmp_path):
    jobs.with_state_store(spark)
    schema = "key string, id long, ts timestamp"
    for k, (key, hour) in enumerate((("a", 0), ("a", 1), ("b", 9), ("c", 20), ("d", 40))):
        spark.createDataFrame([(key, k, START + timedelta(hours=hour))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.limited(stream, 1, 60).writeStream.format("memory").queryName("silent_keys").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert {r["id"]: r["accepted"] for r in spark.table("silent_keys").collect()} == {0: True, 1: True, 2: True, 3: True, 4: True}
    state = spark.read.format("statestore").option("stateVarName", "times").option("flattenCollectionTypes", "true").load(str(tmp_path / "cp"))
    assert "a" not in {r["key"]["key"] if hasattr(r["key"], "key") else r["key"][0] for r in state.select("key").collect()}


def test_requests_are_walked_once(spark, monkeypatch):
    """Every request passes the rate limit's walk once, though its outcome is asked for at several steps."""
    seen, walk = spark.sparkContext.accumulator(0), alerts.decided

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def decided(requests, *rate):
        out = walk(requests, *rate)
        return out.mapInArrow(counted, out.schema)

    monkeypatch.setattr(alerts, "decided", decided)
    requests = spark.createDataFrame([(i, START + timedelta(hours=i), "a", "", True, "x@y.z", "5", "P1") for i in range(4)], "id long, ts timestamp, ip string, website string, human boolean, email string, price string, product string")
    table = spark.createDataFrame([], "email string, product_id long, confirmed boolean, triggered boolean, created_at timestamp")
    got = alerts.admitted(requests, spark.createDataFrame([(1, "P1")], "id long, sku string"), table, spark.createDataFrame([], "sent_at timestamp"))
    assert sorted((r["id"], r["outcome"]) for r in got.collect()) == [(0, "created_sent"), (1, "deduped"), (2, "deduped"), (3, "deduped")]
    assert seen.value == 4
