"""The price provider as a Spark data source: one partition for each batch of ids. The fetch function is injected by name.

The provider gives out tokens at a rate and takes one for each id. Batches are paced by a schedule that is made once, with the
partitions: each batch has the time from which its tokens are there, counted from the start of the read, so tasks on many
executors keep to the rate without a shared counter. A batch that is refused for want of tokens waits as long as the provider
says and tries again; one that takes longer than the time limit does so after a pause.

Where the ids are a table of any size, fetched() walks them in lanes: a lane is one task, which takes its batches in order at its
share of the rate, so no more tasks wait for tokens than there are lanes, and no id passes the driver.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import ship

# fixed values: ids a call, tries, seconds a call may take, tokens a minute
BATCH, ATTEMPTS, TIMEOUT, PER_MINUTE = 100, 3, 30.0, 20.0


class Shortage(Exception):
    """Raised by a fetch function when the provider has too few tokens; seconds until it has enough."""

    def __init__(self, seconds: float):
        super().__init__(seconds)
        self.seconds = seconds

    def __reduce__(self):
        return Shortage, (self.seconds,)


class TokenBucket:
    """Waits until enough tokens have flowed in; clock and sleep are given, so tests need no time."""

    def __init__(self, per_minute: float, start: float, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.tokens, self.clock, self.sleep = per_minute / 60, start, clock, sleep
        self.at = clock()

    def take(self, n: float) -> float:
        """Takes n tokens; returns the seconds waited."""
        now = self.clock()
        self.tokens, self.at = self.tokens + (now - self.at) * self.rate, now
        wait = max(0.0, (n - self.tokens) / self.rate)
        if wait:
            self.sleep(wait)
            self.tokens, self.at = self.tokens + (self.clock() - self.at) * self.rate, self.clock()
        self.tokens -= n
        return wait


def schedule(bucket: TokenBucket, sizes: list[int]) -> list[float]:
    """Seconds from now at which each batch's tokens have flowed in, in order; nothing waits here."""
    waited: list[float] = []
    now = [bucket.at]
    bucket.clock, bucket.sleep = lambda: now[0], lambda s: now.__setitem__(0, now[0] + s)
    start = now[0]
    for n in sizes:
        bucket.take(n)
        waited.append(now[0] - start)
    return waited


def patient(fetch: Callable[[list[str]], list[dict]], ids: list[str], attempts: int = ATTEMPTS, timeout: float = TIMEOUT, sleep=time.sleep) -> list[dict]:
    """What fetch gives; a call that is too slow or short of tokens is made again, attempts times in all."""
    for k in range(attempts):
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(fetch, ids).result(timeout)
        except Shortage as e:
            if k == attempts - 1:
                raise
            sleep(e.seconds)
        except TimeoutError:
            if k == attempts - 1:
                raise
            sleep(float(2**k))
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
    return []


class Batch(InputPartition):
    def __init__(self, ids: list[str], begin: float):
        self.ids, self.begin = ids, begin


class ProviderSource(DataSource):
    """Options: ids (comma-separated), fetch ("module:function", ids -> list of dicts), attempts, timeout, per_minute and tokens (there at the start); per_minute 0: no pacing."""

    @classmethod
    def name(cls) -> str:
        return "price_provider"

    def schema(self) -> str:
        return "asin string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return ProviderReader(dict(self.options))


class ProviderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        ids = [x for x in self.options.get("ids", "").split(",") if x]
        listed = [ids[i : i + BATCH] for i in range(0, len(ids), BATCH)]
        rate = float(self.options.get("per_minute", PER_MINUTE))
        at = schedule(TokenBucket(rate, float(self.options.get("tokens", BATCH))), [len(x) for x in listed]) if rate else [0.0] * len(listed)
        return [Batch(x, time.time() + t) for x, t in zip(listed, at, strict=True)]

    def read(self, partition: Batch) -> Iterator[tuple]:
        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        time.sleep(max(0.0, partition.begin - time.time()))
        for product in patient(fetch, partition.ids, int(self.options.get("attempts", ATTEMPTS)), float(self.options.get("timeout", TIMEOUT))):
            yield product.get("asin"), json.dumps(product)


def lane(batches: Iterator[pa.RecordBatch], fetch: Callable[[list[str]], list[dict]], bucket: TokenBucket | None, size: int = BATCH, attempts: int = ATTEMPTS, timeout: float = TIMEOUT) -> Iterator[pa.RecordBatch]:
    """(asin, payload) of the ids of one lane, fetched size at a time, in order, each batch once its tokens are there; holds one batch of answers."""
    waiting: list[str] = []

    def call(ids: list[str]) -> pa.RecordBatch:
        if bucket:
            bucket.take(len(ids))
        found = patient(fetch, ids, attempts, timeout)
        return pa.RecordBatch.from_arrays([pa.array([x.get("asin") for x in found], pa.string()), pa.array([json.dumps(x) for x in found], pa.string())], ["asin", "payload"])

    for batch in batches:
        waiting += batch.column(0).to_pylist()
        while len(waiting) >= size:
            yield call(waiting[:size])
            del waiting[:size]
    if waiting:
        yield call(waiting)


def fetched(ids: DataFrame, fetch: Callable[[list[str]], list[dict]], lanes: int = 1, per_minute: float = PER_MINUTE, tokens: float = BATCH, size: int = BATCH, attempts: int = ATTEMPTS, timeout: float = TIMEOUT) -> DataFrame:
    """asin, payload: what fetch gives for the distinct ids in column asin (null and empty ones are not asked for).

    Each of lanes tasks has 1 / lanes of the rate and of the tokens that are there at the start, so that together they keep to the rate
    however their work is spread; per_minute 0: no pacing. A lane that is lost begins anew, and pays for its ids again. tokens / lanes
    should be a batch at least: until its first tokens have flowed in a lane waits.
    """
    ship(ids.sparkSession)
    dealt = ids.select(F.col("asin").cast("string").alias("asin")).where("asin <> ''").distinct()
    dealt = dealt.repartition(lanes, "asin").sortWithinPartitions("asin")
    return dealt.mapInArrow(lambda batches: lane(batches, fetch, TokenBucket(per_minute / lanes, tokens / lanes) if per_minute else None, size, attempts, timeout), "asin string, payload string")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ProviderSource)
