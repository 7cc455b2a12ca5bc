"""Structured Streaming: windowed counts, deduplication and quotas with state."""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fathom.operators.pages import last_wins
from fathom.sources.store import shared_folder


#: The state store that timers and lists of state need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_once(spark: SparkSession, sf_dir: str, table: str, plan: Callable[[DataFrame], DataFrame], mode: str, files: int | None = None, close: str | None = None) -> DataFrame:
    """Runs a stream over a table's files until they are used up; its sink is a table in the shared folder.

    In complete mode the last batch is the result, in append mode all batches are. With files so many are read in a
    batch. With close, a column of time, the stream is run again over one more row of a far later time and nothing
    else, by which all that waits for its watermark comes out.
    """
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    read = spark.readStream.schema(schema)
    rows = (read.option("maxFilesPerTrigger", files) if files else read).parquet(f"{sf_dir}/{table}.parquet*")
    if close:
        spark.createDataFrame([], schema).write.parquet(f"{base}/end/none")
        rows = rows.unionByName(spark.readStream.schema(schema).parquet(f"{base}/end/*"))
    result = plan(rows)

    spark.createDataFrame([], result.schema).write.parquet(f"{base}/out/batch=none")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={0 if mode == 'complete' else number}")

    def run() -> None:
        writer = result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        writer.foreachBatch(sink).start().awaitTermination()

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        run()
        if close:
            last = [F.to_timestamp_ntz(F.lit("2200-01-01 00:00:00")).alias(close) if f.name == close else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
            spark.range(1).select(*last).write.parquet(f"{base}/end/last")
            run()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(result.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


def upsert_sink(folder: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that keeps the last row of each key: every batch has a folder of its own by its number.

    A batch that is run again, as after a failure, takes the place of its first run, so it changes nothing.
    """

    def sink(batch: DataFrame, number: int) -> None:
        last_wins(batch.where(F.col(key).isNotNull()), key, order).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return sink


def upserted(spark: SparkSession, folder: str, key: str, order: str) -> DataFrame:
    """The last row of each key over all batches; equal orders go to the later batch."""
    return last_wins(spark.read.parquet(folder), key, order, "batch").drop("batch")


def compacted(spark: SparkSession, folder: str, into: str, key: str, order: str) -> DataFrame:
    """The same rows as one table in another folder, so that later reads need not go through all batches."""
    upserted(spark, folder, key, order).write.mode("overwrite").parquet(into)
    return spark.read.parquet(into)


def first_of_content(objects: DataFrame) -> DataFrame:
    """(file_hash): each content once, whatever file brings it; the state holds hashes only."""
    return objects.where("text is not null").select(F.md5("text").alias("file_hash")).dropDuplicates(["file_hash"])


def timed(events: DataFrame) -> DataFrame:
    """Event time as a timestamp with a watermark; late events of more than a day are dropped by a stream."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")


def window_counts(events: DataFrame) -> DataFrame:
    """(day, event_type, n, total) of tumbling days."""
    grouped = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


def punctual(events: DataFrame, delay: str) -> DataFrame:
    """Adds at, microseconds since 1970, and a watermark on it: events that come later than the delay are dropped."""
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)")
    return events.withColumn("at", at).withColumn("_time", F.timestamp_micros("at")).withWatermark("_time", delay)


class _InOrder(StatefulProcessor):
    """Holds the events of a user until the watermark has passed them, then handles them in order of time and id.

    Out-of-order events within the watermark's delay so give what ordered ones give. The state of a user is the events
    that are still open, in a list of blocks of whole numbers, and what a subclass keeps; one timer is set at a time.
    """

    #: Microseconds after an event at which nothing that comes can change what it is part of.
    settled = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "events binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = np.concatenate([np.stack([batch["at"].to_numpy(np.int64), batch["event_id"].to_numpy(np.int64)], 1) for batch in rows])
        self.open.appendValue((held.tobytes(),))
        self._wake(int(held[:, 0].min()))
        return iter([])

    def _wake(self, at: int) -> None:
        # In milliseconds, rounded up.
        due = -(-(at + self.settled) // 1000) + 1
        timers = list(self.handle.listTimers())
        if not timers or due < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = np.frombuffer(b"".join(bytes(r[0]) for r in self.open.get()), np.int64).reshape(-1, 2)
        held = held[np.lexsort((held[:, 1], held[:, 0]))]
        done, count = self.split(key, held[:, 0].tolist(), held[:, 1].tolist(), passed)
        self.open.clear()
        if count < len(held):
            self.open.appendValue((held[count:].tobytes(),))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self._wake(int(held[count, 0]))
        if len(done):
            yield done

    def split(self, key, times: list[int], ids: list[int], passed: int) -> tuple[pd.DataFrame, int]:
        """What is final at a watermark, and how many of the events that is; the others stay open."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Quota(_InOrder):
    def __init__(self, seconds: float, limit: int) -> None:
        self.span, self.limit = int(seconds * 1e6), limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.window = handle.getValueState("window", "anchor long, used long")

    def split(self, key, times, ids, passed):
        anchor, used = tuple(self.window.get()) if self.window.exists() else (None, 0)
        counts = []
        for at in times:
            if at > passed:
                break
            if anchor is None or at >= anchor + self.span:
                anchor, used = at, 0
            used += 1
            counts.append(used)
        if counts:
            self.window.update((anchor, used))
        found = np.array(counts, np.int64)
        return pd.DataFrame({"event_id": ids[: len(counts)], "user_id": key[0], "used": found, "allowed": found <= self.limit}), len(counts)


class _Batches(_InOrder):
    def __init__(self, seconds: float) -> None:
        self.settled = int(seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.number = handle.getValueState("number", "number long")

    def split(self, key, times, ids, passed):
        number, first, sizes, events = self.number.get()[0] if self.number.exists() else 0, 0, [], []
        while first < len(times) and times[first] + self.settled <= passed:
            end = bisect_left(times, times[first] + self.settled, first)
            sizes.append(end - first)
            events.append(ids[first:end])
            first = end
        if sizes:
            self.number.update((number + len(sizes),))
        return pd.DataFrame({"user_id": key[0], "number": range(number, number + len(sizes)), "n": sizes, "events": events}), first


def _per_user(events: DataFrame, processor: StatefulProcessor, result: str) -> DataFrame:
    # The test names the time, so that it is not moved below the watermark, which rows without a user advance, too.
    whole = F.when(F.col("_time").isNotNull(), F.col("user_id").isNotNull() & F.col("event_id").isNotNull()).otherwise(False)
    rows = events.where(whole).select("user_id", "event_id", "at", "_time")
    return rows.groupBy("user_id").transformWithStateInPandas(processor, result, "Append", "EventTime")


def quota(events: DataFrame, seconds: float, limit: int, delay: str = "1 day") -> DataFrame:
    """(event_id, user_id, used, allowed): the quota that starts anew a fixed time after its first call.

    Answers come when the watermark has passed a call, so calls that come out of order count as if they had not.
    """
    return _per_user(punctual(events, delay), _Quota(seconds, limit), "event_id long, user_id long, used long, allowed boolean")


def micro_batches(events: DataFrame, seconds: float, delay: str = "1 day") -> DataFrame:
    """(user_id, number, n, events): requests in batches that a timer flushes a fixed time after their first one."""
    return _per_user(punctual(events, delay), _Batches(seconds), "user_id long, number long, n long, events array<long>")
