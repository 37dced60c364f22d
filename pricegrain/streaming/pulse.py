"""The market pulse kept up to date by a stream of readings, so that no batch reads the history again.

Products are held in groups. A group's state holds each product's newest reading and those that may still become its baseline; what it adds to its segment (a
current and a baseline price) changes when a reading comes or when time passes. Each change takes back what was counted before
and counts the new prices, and only the buckets of the changed prices in a table of counters are written. Medians are read
from the counters.

Time is the stream's watermark: after a run the counters are those of the pulse at the watermark. Readings are held until the
watermark passes them, so the order within it doesn't matter; a reading that is older than the watermark when it comes is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.money import percent_change, round1, round2
from ..operators.merges import Table
from .jobs import DAY_US

AGO_DAYS, WITHIN_DAYS = 180, 15
#: Groups of products with one state each.
GROUPS = 4096
COUNTERS = "segment string, side string, price double, n long"
CHANGES = "product_id long, segment string, now double, was double, n long"
KEYS = ["segment", "side", "price"]


def seen_at(readings: list[tuple], at: int, ago: int, within: int) -> tuple[tuple | None, tuple | None]:
    """(newest, baseline) of readings (us, id, price, segment) at an instant; ties as in series.latest and series.nearest."""
    newest = max((r for r in readings if r[0] <= at), key=lambda r: (r[0], -r[1]), default=None)
    target = at - ago
    old = [r for r in readings if abs(r[0] - target) <= within]
    return newest, min(old, key=lambda r: (abs(r[0] - target), r[0], r[1]), default=None)


def next_change(readings: list[tuple], at: int, ago: int, within: int) -> int | None:
    """The first instant after at when seen_at may differ: a reading is reached, enters or leaves the baseline's window, or is nearer than another from then on."""
    times = sorted({r[0] for r in readings})
    moments = [t for u in times for t in (u, u + ago - within, u + ago + within + 1)]
    moments += [ago + (a + b) // 2 + 1 for a, b in zip(times, times[1:], strict=False)]
    return min((m for m in moments if m > at), default=None)


SEEN = pa.schema([("product_id", pa.int64()), ("us", pa.int64()), ("id", pa.int64()), ("price", pa.float64()), ("segment", pa.string())])
COUNTED = pa.schema([("product_id", pa.int64()), ("segment", pa.string()), ("now", pa.float64()), ("was", pa.float64())])


def packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_pandas(rows[schema.names], schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes | None, schema: pa.Schema) -> pd.DataFrame:
    return (pa.ipc.open_stream(data).read_all() if data else schema.empty_table()).to_pandas()


def all_seen_at(readings: pd.DataFrame, at: int, ago: int, within: int) -> tuple[np.ndarray, np.ndarray]:
    """seen_at for every product of readings (SEEN): the places of the newest reading and of the baseline, of products that have one."""
    product, us, number = (readings[c].to_numpy() for c in ("product_id", "us", "id"))
    firsts = lambda order: order[np.r_[True, np.diff(product[order]) != 0][: len(order)]]
    reached, off = np.flatnonzero(us <= at), np.abs(us - (at - ago))
    old = np.flatnonzero(off <= within)
    newest = reached[np.lexsort((number[reached], -us[reached], product[reached]))]
    baseline = old[np.lexsort((number[old], us[old], off[old], product[old]))]
    return firsts(newest), firsts(baseline)


def first_change(readings: pd.DataFrame, at: int, ago: int, within: int) -> int | None:
    """next_change over all products of readings (SEEN)."""
    product, us = readings["product_id"].to_numpy(), readings["us"].to_numpy()
    order = np.lexsort((us, product))
    product, us = product[order], us[order]
    between = ago + (us[:-1] + us[1:]) // 2 + 1
    moments = np.r_[us, us + ago - within, us + ago + within + 1, between[(product[1:] == product[:-1]) & (us[1:] != us[:-1])]]
    moments = moments[moments > at]
    return int(moments.min()) if len(moments) else None


class PriceSeen(StatefulProcessor):
    """A group's products: readings back to the start of the baseline's window, and the prices that are counted.

    Each is one value of Arrow bytes, so a group costs the same few calls to the state store however many products it holds.
    """

    def __init__(self, ago: int, within: int):
        self.ago, self.within = ago, within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        bytes_ = StructType([StructField("rows", BinaryType())])
        self.readings, self.counted = handle.getValueState("readings", bytes_), handle.getValueState("counted", bytes_)

    def _held(self, state, schema: pa.Schema) -> pd.DataFrame:
        value = state.get()
        return unpacked(bytes(value[0]) if value is not None else None, schema)

    def _settled(self, held: pd.DataFrame, at: int) -> pd.DataFrame:
        newest, baseline = all_seen_at(held, at, self.ago, self.within)
        now = held.iloc[newest]
        was = held.iloc[baseline][["product_id", "price"]].rename(columns={"price": "was"})
        after = now[now["segment"].notna()].rename(columns={"price": "now"})[["product_id", "segment", "now"]].merge(was, on="product_id")
        before = self._held(self.counted, COUNTED)
        keep = held["us"].to_numpy() >= at - self.ago - self.within
        keep[newest] = True
        left = held[keep]
        self.readings.update((packed(left, SEEN),))
        moment = first_change(left, at, self.ago, self.within)
        if moment is not None:  # the watermark counts milliseconds; a timer at the one that is reached fires
            self.handle.registerTimer(-(-moment // 1000))
        both = before.merge(after, how="outer", indicator=True)
        changed = both[both["_merge"] != "both"]
        if len(changed):
            self.counted.update((packed(after, COUNTED),))
        return changed.assign(n=np.where(changed["_merge"] == "left_only", -1, 1))[["product_id", "segment", "now", "was", "n"]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([part[SEEN.names] for part in rows])
        new = new[new["price"].notna()]
        if len(new):
            held = pd.concat([self._held(self.readings, SEEN), new], ignore_index=True)
            yield self._settled(held, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held(self.readings, SEEN)
        if len(held):
            yield self._settled(held, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def price_changes(readings: DataFrame, ago_days: int = AGO_DAYS, within_days: int = WITHIN_DAYS, late: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """A stream of what is counted anew (n = 1) and no longer (n = -1) of each product: segment, current and baseline price.

    readings: product_id, segment, price, fetched_at, id (long; orders readings of one instant). Rows without a price, a product or a time move time only. The
    segment is that of the newest reading; a product counts if it has one, and both prices. State is the readings of
    ago_days + within_days of the products of a group: the hash of their ids modulo groups, a number that a checkpoint keeps.
    Needs with_state_store.
    """
    rows = readings.select(F.col("product_id").cast("long").alias("product_id"), "segment", F.col("price").cast("double").alias("price"), F.col("fetched_at").cast("timestamp").alias("fetched_at"), F.col("id").cast("long").alias("id"))
    known = F.col("product_id").isNotNull() & F.col("fetched_at").isNotNull()
    rows = rows.withColumns({"price": F.when(known, F.col("price")), "product_id": F.coalesce("product_id", F.lit(-1)), "id": F.coalesce("id", F.lit(0))})
    rows = rows.withWatermark("fetched_at", late).withColumn("us", F.coalesce(F.unix_micros("fetched_at"), F.lit(0))).withColumn("group", F.pmod(F.xxhash64("product_id"), F.lit(groups)))
    return rows.groupBy("group").transformWithStateInPandas(statefulProcessor=PriceSeen(ago_days * DAY_US, within_days * DAY_US), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def counted(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Counters after changes; those that come to 0 go."""
    return old.unionByName(changes).groupBy(*KEYS).agg(F.sum("n").alias("n")).where("n <> 0")


def keep_counters(changes: DataFrame, counters: Table, checkpoint: str):
    """Adds the changes of each micro-batch to the table of counters, once; stops when all that has landed is done."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sides = F.explode(F.array(F.struct(F.lit("now").alias("side"), F.col("now").alias("price")), F.struct(F.lit("was").alias("side"), F.col("was").alias("price"))))
        net = batch.select("segment", "n", sides.alias("x")).groupBy("segment", "x.side", "x.price").agg(F.sum("n").alias("n")).where("n <> 0")
        counters.merge(net, counted, batch=batch_id)
        counters.vacuum()

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pulse(counters: DataFrame, segments: DataFrame) -> DataFrame:
    """The rows of market.market_pulse from counters: medians of prices weighted by how many products have them."""
    of = lambda side: F.when(F.col("side") == side, F.col("price"))
    stats = counters.groupBy("segment").agg(F.percentile(of("now"), 0.5, F.col("n")).alias("c"), F.percentile(of("was"), 0.5, F.col("n")).alias("b"), F.sum(F.when(F.col("side") == "now", F.col("n"))).alias("n"))
    return segments.join(stats, "segment", "left").select(
        "segment", round2(F.col("c")).alias("current_avg_price"), round2(F.col("b")).alias("baseline_avg_price"), round1(percent_change(F.col("c"), F.col("b"))).alias("pct_change"), F.coalesce("n", F.lit(0)).cast("long").alias("product_count")
    )
