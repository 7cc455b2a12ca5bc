"""Streams with state: events in any order of files give the batch result."""

import random
from datetime import datetime, timedelta

import pytest

from fathom.operators import serving
from fathom.streaming import streams


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = [(u, start + timedelta(minutes=rng.randrange(6 * 1440), microseconds=rng.randrange(3)), 1000 * u + i) for u in range(5) for i in range(60)]
    rows += [(1, start, 5001), (1, start, 5002), (None, start, 5003), (2, None, 5004)]
    rng.shuffle(rows)
    out = tmp_path_factory.mktemp("events")
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long").repartition(4).write.parquet(f"{out}/events.parquet")
    return str(out)


def test_quota_of_shuffled_files(spark, folder):
    want = {(r.event_id, r.user_id, r.used, r.allowed) for r in serving.anchored_windows(spark.read.parquet(f"{folder}/events.parquet"), 86_400, 3).collect()}
    got = [tuple(r) for r in streams.run_once(spark, folder, "events", lambda e: streams.quota(e, 86_400, 3, "30 days"), "append", files=1, close="ts").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_micro_batches_of_shuffled_files(spark, folder):
    calls = serving.anchored_windows(spark.read.parquet(f"{folder}/events.parquet"), 7200, 3).collect()
    want = {}
    for r in sorted(calls, key=lambda r: (r.ts, r.event_id)):
        want.setdefault((r.user_id, r.number), []).append(r.event_id)
    got = {(r.user_id, r.number): r.events for r in streams.run_once(spark, folder, "events", lambda e: streams.micro_batches(e, 7200, "30 days"), "append", files=1, close="ts").collect()}
    assert got == want


def test_without_closing_only_what_the_watermark_has_passed_comes_out(spark, folder):
    got = streams.run_once(spark, folder, "events", lambda e: streams.quota(e, 86_400, 3, "3 days"), "append").collect()
    rows = {r.event_id: r.ts for r in spark.read.parquet(f"{folder}/events.parquet").where("ts is not null").collect()}
    passed = max(rows.values()) - timedelta(days=3)
    assert 0 < len(got) and {r.event_id for r in got} <= {e for e, ts in rows.items() if ts <= passed}


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    table = f"{tmp_path}/table"
    sink = streams.upsert_sink(table, "k", "at")
    first = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 5, "c"), (None, 1, "x")], "k long, at long, v string")
    second = spark.createDataFrame([(1, 2, "late"), (2, 5, "same"), (3, 1, "new")], "k long, at long, v string")
    sink(first, 0)
    sink(second, 1)
    rows = lambda: sorted(map(tuple, streams.upserted(spark, table, "k", "at").collect()))
    want = [(1, 3, "b"), (2, 5, "same"), (3, 1, "new")]
    assert rows() == want
    sink(second, 1)
    sink(first, 0)
    assert rows() == want
    assert sorted(map(tuple, streams.compacted(spark, table, f"{tmp_path}/one", "k", "at").collect())) == want


def test_a_stream_restarted_without_its_last_commit(spark, tmp_path):
    import shutil

    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, at long, v string").write.parquet(f"{tmp_path}/in/0")
    schema = "k long, at long, v string"

    def run():
        rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        rows.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(streams.upsert_sink(f"{tmp_path}/table", "k", "at")).start().awaitTermination()
        return sorted(map(tuple, streams.upserted(spark, f"{tmp_path}/table", "k", "at").collect()))

    want = run()
    shutil.rmtree(f"{tmp_path}/state/commits")  # as if the driver was lost before it noted the batch as done
    assert run() == want == [(1, 1, "a"), (2, 1, "b")]


class _Kept:
    """A state value that holds what it is given."""

    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def test_batches_of_a_busy_user_take_linear_time():
    import time

    processor, n = streams._Batches(10), 200_000
    processor.number = _Kept()
    times, began = [i * 6_000_000 for i in range(n)], time.process_time()
    found, count = processor.split((7,), times, list(range(n)), times[-1])
    # Two events a batch; the batch of the last two may still change.
    assert count == n - 2 and processor.number.get() == (n // 2 - 1,)
    assert found["events"].iloc[-1] == [n - 4, n - 3] and set(found["n"]) == {2} and list(found["number"]) == list(range(n // 2 - 1))
    assert time.process_time() - began < 20
