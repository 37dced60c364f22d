"""Price alerts: which fire, which requests are let in, and the limits in between."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import ship, storage
from ..functions import text as T
from . import blocks
from .series import at

PENDING_CAP, ACTIVE_CAP, SEND_CAP = 3, 10, 200
PENDING_HOURS, SEND_HOURS = 48, 24


def expired(alerts: DataFrame, as_of, hours: int = PENDING_HOURS):
    """Predicate: not confirmed and older than hours; null-safe."""
    return ~F.coalesce("confirmed", F.lit(False)) & F.coalesce(F.col("created_at") < at(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours)), F.lit(False))


def split_expired(alerts: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted) alerts."""
    gone = expired(alerts, as_of)
    return alerts.where(~gone), alerts.where(gone)


def active(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.coalesce("confirmed", F.lit(False)) & ~F.coalesce("triggered", F.lit(False)))


def hits(alerts: DataFrame, prices: DataFrame, products: DataFrame, lows: DataFrame) -> DataFrame:
    """Active alerts whose product costs at most their target, with the product (null if unknown) and its all-time low."""
    due = active(alerts).join(prices.select("product_id", F.col("price").alias("current")), "product_id").where(F.col("current") <= F.col("target_price"))
    named = due.join(products.select(F.col("id").alias("product_id"), "sku", "name"), "product_id", "left")
    return named.join(lows, "product_id", "left").withColumn("known", F.col("sku").isNotNull())


def job_counters(alerts: DataFrame, prices: DataFrame, products: DataFrame, as_of) -> DataFrame:
    """One row: alerts checked, matched, sendable (product known) and expired."""
    kept, gone = split_expired(alerts, as_of)
    checked = active(kept)
    due = checked.join(prices.select("product_id", F.col("price").alias("current")), "product_id").where(F.col("current") <= F.col("target_price"))
    sendable = due.join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    kinds = {"checked": checked, "matched": due, "sendable": sendable, "expired_cleaned": gone}
    seen = reduce(DataFrame.union, [d.select(F.lit(k).alias("kind")) for k, d in kinds.items()])
    return seen.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def admission(alerts: DataFrame, as_of) -> DataFrame:
    """Of each email: alerts pending in the last 48 hours, active ones, and whether either cap is reached."""
    recent = F.col("created_at") >= at(as_of) - F.make_dt_interval(F.lit(0), F.lit(PENDING_HOURS))
    confirmed, triggered = F.coalesce("confirmed", F.lit(False)), F.coalesce("triggered", F.lit(False))
    n = alerts.groupBy("email").agg(F.count_if(~confirmed & recent).alias("pending"), F.count_if(confirmed & ~triggered).alias("active"))
    return n.withColumn("blocked", (F.col("pending") >= PENDING_CAP) | (F.col("active") >= ACTIVE_CAP))


def send_breaker(log: DataFrame, as_of, cap: int = SEND_CAP) -> DataFrame:
    """One row: mails sent in the last 24 hours and whether the cap is reached."""
    recent = log.where((F.col("sent_at") >= at(as_of) - F.make_dt_interval(F.lit(0), F.lit(SEND_HOURS))) & (F.col("sent_at") <= at(as_of)))
    return recent.agg(F.count(F.lit(1)).alias("sent")).withColumn("deferred", F.col("sent") >= cap)


# ------------------------------------------------------------------------------------------------ limits on requests


def chunked(rows: DataFrame, key: str, us: str, width: int) -> DataFrame:
    """rows with chunk: requests of a key in different chunks lie at least width (microseconds) apart, so no limit of that width reaches across.

    Time is cut into cells of the width. Two cells can only be nearer than width if they are neighbours, so a join on (key, cell)
    finds where a gap lies, and the cells between gaps form a run. Neither step meets a key's requests in one task.
    """
    celled = rows.withColumn("cell", F.floor(F.col(us) / width).cast("long"))
    cells = celled.groupBy(key, "cell").agg(F.min(us).alias("_low"), F.max(us).alias("_high"))
    prior = cells.select(F.col(key).alias("_k"), (F.col("cell") + 1).alias("_next"), F.col("_high").alias("_prior"))
    met = cells.join(prior, (F.col(key).eqNullSafe(F.col("_k"))) & (F.col("cell") == F.col("_next")), "left")
    starts = F.col("_prior").isNull() | (F.col("_low") - F.col("_prior") >= width)
    labelled = blocks.runs(met.select(key, "cell", starts.alias("_start")), [key], F.col("_start")).select(F.col(key).alias("_k"), F.col("cell").alias("_c"), F.col("run").alias("chunk"))
    return celled.join(labelled, F.col(key).eqNullSafe(F.col("_k")) & (F.col("cell") == F.col("_c"))).drop("_k", "_c", "cell")


def accepted(us: np.ndarray, times: list[int], limit: int, width: int) -> np.ndarray:
    """Which of the sorted times us are accepted after the accepted times so far, which are brought up to date.

    Once limit of them lie in the window, all requests up to the oldest's end are rejected, so these are leapt over.
    """
    out, i = np.zeros(len(us), dtype=bool), 0
    while i < len(us):
        if len(times) >= limit:
            i = max(i, int(np.searchsorted(us, times[-limit] + width)))
            if i >= len(us):
                break
        out[i] = True
        times.append(int(us[i]))
        i += 1
    del times[:-limit]
    return out


def groups(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple[tuple, int, int]]:
    """(values of the columns, from, to) of each run of rows that agree in them."""
    change = np.zeros(len(batch), dtype=bool)
    lists = [batch.column(c).to_pylist() for c in columns]
    for values in lists:
        held = np.array(values, dtype=object)
        change[1:] |= held[1:] != held[:-1]
    cuts = [0, *np.flatnonzero(change).tolist(), len(batch)] if len(batch) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield tuple(v[a] for v in lists), a, b


def decided(requests: DataFrame, limit: int, window_minutes: int) -> DataFrame:
    """requests (key, ts, id) with accepted: at most limit accepted ones of a key in (ts - window, ts]; rejected ones don't count.

    A decision depends on the ones before, so requests are walked in order, but only from gap to gap: a key's chunks between gaps of
    a whole window are walked in different tasks. A walk holds at most limit times, whatever the length of its chunk.
    """
    width = window_minutes * 60_000_000
    ship(requests.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, times = None, []
        for batch in batches:
            us, out = batch.column("us").to_numpy(), np.zeros(len(batch), dtype=bool)
            for group, a, b in groups(batch, "key", "chunk"):
                if group != now:
                    now, times = group, []
                out[a:b] = accepted(us[a:b], times, limit, width)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), batch.column("us"), pa.array(out)], ["key", "id", "us", "accepted"])

    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    cut = chunked(rows, "key", "us", width).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "us", "id")
    return cut.mapInArrow(run, "key string, id long, us long, accepted boolean").select("key", "id", F.timestamp_micros("us").alias("ts"), "accepted")


def _pending_decisions(rows: DataFrame, cap: int, hours: int) -> DataFrame:
    """id, outcome of requests in the order of each email's rows: rows (email, us, id, product_id, active_cap, known, held).

    held marks alerts of the table that wait for confirmation: they count, but aren't decided. State is the last cap pending times
    and the products that the walk let in, at most cap of them every so many hours.
    """
    width = hours * 3600 * 1_000_000
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, times, let_in = None, [], set()
        for batch in batches:
            us, ids, outcomes = batch.column("us").to_numpy(), [], []
            product, capped, known, held, number = (batch.column(c).to_pylist() for c in ("product_id", "active_cap", "known", "held", "id"))
            for group, a, b in groups(batch, "email"):
                if group != now:
                    now, times, let_in = group, [], set()
                for i in range(a, b):
                    if held[i]:
                        times.append(int(us[i]))
                        del times[:-cap]
                        continue
                    if len(times) >= cap and times[-cap] >= us[i] - width:
                        outcome = "email_pending_cap"
                    elif capped[i]:
                        outcome = "email_active_cap"
                    elif known[i] or product[i] in let_in:
                        outcome = "deduped"
                    else:
                        outcome = "created"
                        let_in.add(product[i])
                        times.append(int(us[i]))
                        del times[:-cap]
                    ids.append(number[i])
                    outcomes.append(outcome)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(outcomes, pa.string())], ["id", "outcome"])

    return rows.repartition("email").sortWithinPartitions("email", "us", F.desc("held"), "id").mapInArrow(run, "id long, outcome string")


def sendable(created: DataFrame, log: DataFrame, cap: int = SEND_CAP, hours: int = SEND_HOURS) -> DataFrame:
    """created (id, us) with sent: at most cap mails in the hours before, those of log (us) included; mails held back don't count.

    Hours of time are cells. Where even all mails of the hours before and the cell itself stay under the cap, all of the cell are sent;
    prefix sums over the cells, one row an hour, tell that. Only the other cells are walked, in stretches, each with the hours before it,
    whose mails are known to be sent; stretches that share no hour are different tasks' work.
    """
    hour, width = 3600 * 1_000_000, hours * 3600 * 1_000_000
    ship(created.sparkSession)
    rows = created.select("id", "us", F.lit(False).alias("sure")).unionByName(log.select(F.lit(None).cast("long").alias("id"), "us", F.lit(True).alias("sure")))
    celled = rows.withColumn("cell", F.floor(F.col("us") / hour).cast("long"))
    counts = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.withColumn("most", F.sum("n").over(W.orderBy("cell").rangeBetween(-hours - 1, 0)))
    # an hour is walked itself, or its mails still count in one that is
    walked = seen.withColumn("_next", F.min(F.when(F.col("most") > cap, F.col("cell"))).over(W.orderBy("cell").rangeBetween(0, hours + 1)))
    marked = walked.where("_next is not null").withColumn("_gap", F.col("cell") - F.lag("cell").over(W.orderBy("cell")))
    stretch = F.last(F.when(F.coalesce(F.col("_gap") > hours + 1, F.lit(True)), F.col("cell")), ignorenulls=True).over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, 0))
    marked = marked.select("cell", stretch.alias("stretch"), (F.col("most") <= cap).alias("free"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, times = None, []
        for batch in batches:
            us, out = batch.column("us").to_numpy(), np.ones(len(batch), dtype=bool)
            for group, a, b in groups(batch, "stretch", "sure"):
                if group[0] != now:
                    now, times = group[0], []
                if group[1]:
                    times += us[a:b].tolist()
                    del times[:-cap]
                else:
                    out[a:b] = accepted(us[a:b], times, cap, width + 1)
            mine = pa.compute.is_valid(batch.column("id"))
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(mine), pa.array(out).filter(mine)], ["id", "sent"])

    joined = celled.join(marked, "cell", "left").withColumn("sure", F.col("sure") | F.coalesce("free", F.lit(True)))
    sent = joined.where("stretch is null and id is not null").select("id", F.lit(True).alias("sent"))
    order = ("stretch", "us", F.col("id").isNotNull(), "id")
    hard = joined.where("stretch is not null").select("id", "us", "sure", "stretch").repartition("stretch").sortWithinPartitions(*order).mapInArrow(run, "id long, sent boolean")
    return sent.unionByName(hard)


def admitted(requests: DataFrame, products: DataFrame, table: DataFrame, log: DataFrame, rate: tuple[int, int] = (3, 60), send_cap: int = SEND_CAP) -> DataFrame:
    """id, outcome, errors, email, product_id of each request for an alert of one batch, decided in order through all limits.

    requests: id (unique), ts, ip, website (a trap that people leave empty), human, email, price (text), product (sku). products: id, sku.
    table: the alerts there are (email, product_id, confirmed, triggered, created_at). log: mails sent (sent_at).

    In this order: honeypot_tripped, turnstile_failed, rate_limited (rate: so many an address in so many minutes), invalid,
    product_not_found, email_pending_cap, email_active_cap, deduped (the email has an alert for the product), and of those
    created created_sent or, with the breaker open, created_breaker_deferred. Only requests that come so far count in a limit.
    """
    trapped = F.when(F.coalesce("website", F.lit("")) != "", "honeypot_tripped").when(~F.coalesce("human", F.lit(False)), "turnstile_failed")
    told = requests.withColumn("first", trapped)
    limit = decided(told.where("first is null").select(F.coalesce("ip", F.lit("unknown")).alias("key"), "id", "ts"), *rate).select("id", "accepted")
    told = told.join(limit, "id", "left").withColumn("first", F.coalesce("first", F.when(~F.col("accepted"), "rate_limited")))
    fields = (F.col("email"), F.col("price"), F.col("product"))
    # errors and clean fields in one look at each request, though both go by the errors
    told = blocks.spread(told).withColumn("errors", T.alert_errors(*fields)).withColumn("clean", T.clean_alert(*fields, F.col("errors")))
    told = told.withColumn("first", F.coalesce("first", F.when(F.size("errors") > 0, "invalid")))
    told = told.select("id", "ts", "first", F.when(F.col("first") == "invalid", F.col("errors")).alias("errors"), F.col("clean.email").alias("email"), F.col("clean.product_id").alias("sku"))
    told = told.join(products.select("sku", F.col("id").alias("product_id")), "sku", "left").withColumn("first", F.coalesce("first", F.when(F.col("product_id").isNull(), "product_not_found")))
    told = storage.written(told, "told")  # asked three times: the walk of the rate limit runs once
    confirmed, triggered = F.coalesce("confirmed", F.lit(False)), F.coalesce("triggered", F.lit(False))
    live = table.where(confirmed & ~triggered).groupBy("email").agg(F.count(F.lit(1)).alias("_live"))
    pairs = table.select("email", "product_id", F.lit(True).alias("known")).distinct()
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("us")
    asked = told.where("first is null").join(live, "email", "left").join(pairs, ["email", "product_id"], "left")
    asked = asked.select("email", us("ts"), "id", "product_id", (F.coalesce("_live", F.lit(0)) >= ACTIVE_CAP).alias("active_cap"), F.coalesce("known", F.lit(False)).alias("known"), F.lit(False).alias("held"))
    waiting = table.where(~confirmed).select("email", us("created_at"), F.lit(None).cast("long").alias("id"), "product_id", F.lit(False).alias("active_cap"), F.lit(True).alias("known"), F.lit(True).alias("held"))
    waiting = waiting.join(asked.select("email").distinct(), "email", "left_semi")
    walked = storage.written(_pending_decisions(asked.unionByName(waiting), PENDING_CAP, PENDING_HOURS), "walked")
    times = told.select("id", us("ts"))
    mails = sendable(walked.where("outcome = 'created'").join(times, "id").select("id", "us"), log.select(us("sent_at")), send_cap)
    done = walked.join(mails, "id", "left").withColumn("outcome", F.when(F.col("outcome") == "created", F.when(F.col("sent"), "created_sent").otherwise("created_breaker_deferred")).otherwise(F.col("outcome")))
    out = told.join(done.select("id", "outcome"), "id", "left")
    return out.select("id", F.coalesce("first", "outcome").alias("outcome"), "errors", "email", "product_id")
