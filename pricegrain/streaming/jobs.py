"""Streaming forms: scheduled price batches, the request limiter, and the life of an alert.

Each batch has one time, given by its rows or by the caller, never by a clock. The stateful queries need the RocksDB state
store (see with_state_store).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .. import ship
from ..operators.alerts import accepted

DAY_US = 86_400_000_000
PENDING_US, FIRED_US = 2 * DAY_US, 90 * DAY_US


def with_state_store(spark: SparkSession) -> SparkSession:
    """Readies a session for the stateful queries; the package goes to the workers."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def run_batches(landed: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str):
    """Hands each micro-batch of a landed stream to every sink; stops when all that has landed is done.

    Sinks are isolated: one that fails doesn't keep the others from running; the first error is raised when all have run,
    so the batch is tried again. Sinks must be idempotent by batch id (at least once).
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        errors = []
        for name, sink in sinks.items():
            try:
                sink(batch, batch_id)
            except Exception as e:  # isolation: every sink gets its turn
                errors.append((name, e))
        batch.unpersist()
        if errors:
            raise RuntimeError(f"sinks failed: {[n for n, _ in errors]}") from errors[0][1]

    return landed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def send_then_mark(due: DataFrame, send: Callable[[dict], bool], done: DataFrame, mark: str) -> DataFrame:
    """Sends each alert that isn't marked done, in the tasks that hold them, and appends the ids to the Parquet table at mark.

    Returns the ids marked there. A failed alert is left for the next run, and so is one whose task was lost between sending
    and marking: mail goes out at least once, marks are never without mail.
    """
    waiting = due.join(done.select("id"), "id", "left_anti")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sent = [send(row) for row in rows.to_dict("records")]
            yield rows.loc[sent, ["id"]]

    waiting.mapInPandas(each, "id long").write.mode("append").parquet(mark)
    return due.sparkSession.read.schema("id long").parquet(mark)


def sent_counters(due: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: of the alerts that were due, how many a run sent (marked after it, not before) and how many failed (still not marked).

    before, after: the marks (id) as they were read before and after the run; marks of other alerts don't count.
    """
    ids = due.select("id").distinct().join(before.select("id").distinct(), "id", "left_anti")
    marked = ids.join(after.select("id").distinct().withColumn("marked", F.lit(True)), "id", "left")
    return marked.agg(F.count_if("marked").alias("sent"), F.count_if(F.col("marked").isNull()).alias("failed"))


class Limiter(StatefulProcessor):
    """Accepts a request if fewer than limit accepted ones lie in (t - window, t]; only accepted times are state.

    A timer of event time drops a key's state once a whole window has passed since its last accepted request, so keys that fall
    silent leave nothing behind.
    """

    def __init__(self, limit: int, window_minutes: int):
        self.limit, self.width = limit, window_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [t[0] for t in self.times.get()] if self.times.exists() else []
        asked = pd.concat(list(rows)).sort_values(["us", "id"])
        took = accepted(asked["us"].to_numpy(), kept, self.limit, self.width)
        if kept:
            self.times.put([(t,) for t in kept])
            if took.any():
                self.handle.registerTimer((kept[-1] + self.width) // 1000 + 1)
        yield pd.DataFrame({"key": key[0], "id": asked["id"], "us": asked["us"], "accepted": took})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = [t[0] for t in self.times.get()] if self.times.exists() else []
        if kept and (kept[-1] + self.width) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.times.clear()
        yield from ()

    def close(self) -> None:
        pass


def limited(requests: DataFrame, limit: int = 3, window_minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """A stream of requests (key, id, ts) with accepted; requests may come late by so much."""
    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Limiter(limit, window_minutes), outputStructType="key string, id long, us long, accepted boolean", outputMode="Append", timeMode="EventTime")


class AlertLife(StatefulProcessor):
    """pending -> confirmed -> triggered, by events of one alert; pending ones of more than 48 hours are gone, unsubscribed ones too.

    A timer of event time ends a pending alert that no event follows, and one that has fired is forgotten after 90 days, so neither
    stays in state for ever. Confirmed alerts wait for their price and stay.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([StructField("name", StringType()), StructField("since", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        name, since = self.state.get() if self.state.exists() else (None, 0)
        out = []
        events = pd.concat(list(rows)).sort_values(["us", "event"])
        for us, event in zip(events["us"], events["event"], strict=True):
            us = int(us)
            if name == "pending" and us - since > PENDING_US:
                name = None
            before = name
            if event == "create" and name is None:
                name, since = "pending", us
                self.handle.registerTimer((us + PENDING_US) // 1000 + 1)
            elif event == "confirm" and name == "pending":
                name, since = "confirmed", us
            elif event == "trigger" and name == "confirmed":
                name, since = "triggered", us
                self.handle.registerTimer((us + FIRED_US) // 1000 + 1)
            elif event == "unsubscribe":
                name = None
            out.append((key[0], us, event, before or "none", name or "none"))
        if name is None:
            self.state.clear()
        else:
            self.state.update((name, since))
        yield pd.DataFrame(out, columns=["alert", "us", "event", "before", "after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        name, since = self.state.get() if self.state.exists() else (None, 0)
        if name == "pending" and at - since > PENDING_US:
            self.state.clear()
            yield pd.DataFrame([(key[0], at, "expire", "pending", "none")], columns=["alert", "us", "event", "before", "after"])
        if name == "triggered" and at - since > FIRED_US:
            self.state.clear()

    def close(self) -> None:
        pass


def alert_lives(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of alert events (alert, event, ts) with the state before and after each; events may come late by so much."""
    rows = events.select(F.col("alert").cast("string").alias("alert"), "event", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("alert").transformWithStateInPandas(statefulProcessor=AlertLife(), outputStructType="alert string, us long, event string, before string, after string", outputMode="Append", timeMode="EventTime")
