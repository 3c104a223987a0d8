"""Streams with state and timers: keys that fall silent, batches by size and by time, and equality with the sequential rules."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming import feed, keyed

START = datetime(2024, 1, 1)


@pytest.fixture
def run(spark, tmp_path):
    """run(job, schema, batches of rows, until): what the stream of job(feed) gives, one micro-batch a batch of rows, until enough came."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    keyed.with_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def go(job, schema, batches, until, wait=40):
        source, got = f"{tmp_path}/in", []
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(source)
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = job(stream).writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="200 milliseconds").outputMode("append").start()
        sent = 0
        try:
            for rows in batches:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
                sent, end = sent + len(rows), time.time() + wait
                while sum(p["numInputRows"] for p in query.recentProgress) < sent and time.time() < end:  # with timers a stream is never idle
                    assert query.exception() is None
                    time.sleep(0.1)
            end = time.time() + wait
            while not until(got) and time.time() < end:
                assert query.exception() is None
                time.sleep(0.2)
        finally:
            query.stop()
        return got

    yield go
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def queue(rows, interval, most):
    """The sequential queue: (batch, key) -> (change_type, ts)."""
    out, number, pending, opened = {}, 0, {}, None
    for k, c, t in rows:
        if pending and (t - opened).total_seconds() * 1000 >= interval:
            out |= {(number, x): v for x, v in pending.items()}
            number, pending = number + 1, {}
        opened = opened if pending else t
        old = pending.get(k)
        if old is None or c == "deleted" or (old[0] != "deleted" and c == "updated"):
            pending[k] = (c, t)
        if len(pending) >= most:
            out |= {(number, x): v for x, v in pending.items()}
            number, pending = number + 1, {}
    return out | {(number, x): v for x, v in pending.items()}


def test_coalesce_by_size_time_and_silence(spark, run):
    rng = random.Random(3)
    rows, t = {"a": [], "b": []}, START
    for i in range(260):
        t += timedelta(milliseconds=rng.choice([1, 5, 40, 400]))
        rows[rng.choice("aab")].append((f"k{rng.randrange(30)}", rng.choice(["created", "created", "updated", "deleted"]), t))
    want = {(g, *k): v for g, r in rows.items() for k, v in queue(r, 3000, 12).items()}
    feed_rows = sorted(((g, *r) for g in rows for r in rows[g]), key=lambda r: r[3])
    batches = [feed_rows[:100], feed_rows[100:]]
    got = run(lambda f: keyed.coalesce_stream(f, 3000, 12), "group string, key string, change_type string, ts timestamp", batches, lambda g: len(g) >= len(want))
    assert {(r.group, r.batch, r.key): (r.change_type, r.ts) for r in got} == want and len(got) == len(want)


def test_stuck_and_failed_keys_go_back(spark, run):
    at = lambda s: START + timedelta(seconds=s)
    first = [("stuck", "in_progress", at(0)), ("busy", "in_progress", at(0)), ("once", "error", at(0)), ("often", "error", at(0)), ("often", "error", at(1)), ("often", "error", at(2)), ("fine", "done", at(0))]
    then = [("busy", "done", at(9)), ("stuck", "done", at(-5))]  # the second is older than what is known
    got = run(lambda f: keyed.due_stream(f, stuck_ms=6000, wait_ms=500), "key string, state string, ts timestamp", [first, then], lambda g: len(g) >= 2)
    assert sorted((r.key, r.reason, r.retries) for r in got) == [("once", "retry", 1), ("stuck", "stuck", 0)]


def test_untouched_keys_are_forgotten(spark, run):
    at = lambda s: START + timedelta(seconds=s)
    got = run(lambda f: keyed.retained_stream(f, 4000), "key string, ts timestamp", [[("a", at(0)), ("b", at(1))], [("a", at(2)), ("a", at(3))]], lambda g: sum(r.event == "forgotten" for r in g) >= 2)
    assert {(r.key, r.first_seen, r.last_access, r.n) for r in got if r.event == "forgotten"} == {("a", at(0), at(3), 3), ("b", at(1), at(1), 1)}


def test_coalesce_windows_equal_sequential_rule(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(40)}", rng.choice(["created", "created", "updated", "deleted"]), START + timedelta(milliseconds=i)) for i in range(300)]
    want = {k: v for (_, k), v in queue(rows, 10**9, 10**9).items()}
    assert any(c == "created" for c, _ in want.values())
    rng.shuffle(rows)
    got = feed.coalesce_changes(spark.createDataFrame(rows, "key string, change_type string, ts timestamp"), seconds=3600).collect()
    assert {r.key: (r.change_type, r.ts) for r in got} == want


def test_due_batch_form(spark):
    rows = [("a", "in_progress", START), ("b", "error", START + timedelta(minutes=10)), ("c", "done", START)]
    df = spark.createDataFrame(rows, "key string, state string, ts timestamp")
    assert {r.key for r in feed.due(df, F.lit("2024-01-01 00:10:00").cast("timestamp")).collect()} == {"a", "b"}
