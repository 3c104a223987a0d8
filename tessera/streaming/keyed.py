"""The change feed with state and timers for each key: what must happen although no new row comes.

These jobs need ``spark.sql.streaming.stateStore.providerClass`` set to Spark's RocksDB provider (``with_rocksdb``). Timers run on processing
time and fire in any trigger after they are due, also where a key, or the whole feed, has fallen silent.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """The session, with the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return spark


def merged(old: str | None, new: str) -> bool:
    """Whether a new change of a key replaces the pending one: a delete always, an update unless a delete is pending, a create never."""
    return old is None or new == "deleted" or (new == "updated" and old != "deleted")


class _Coalesce(StatefulProcessor):
    """Pending changes of a group. They are flushed as one batch when ``most`` keys are pending, when a change comes ``interval`` ms or more
    after the batch was opened, and when that time has passed without any."""

    def __init__(self, interval: int, most: int):
        self.interval, self.most = interval, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "key string", "change_type string, ts timestamp")
        self.batch = handle.getValueState("batch", "number long, opened timestamp, n int")

    def _flush(self, group: str, number: int, rows: dict[str, tuple]) -> list[tuple]:
        return [(group, number, k, c, t) for k, (c, t) in rows.items()]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "key", "change_type"], kind="stable")
        number, opened, _ = self.batch.get() if self.batch.exists() else (0, None, 0)
        rows_now = {k[0]: (v[0], v[1]) for k, v in self.pending.iterator()} if self.pending.exists() else {}
        out: list[tuple] = []
        for k, c, t in new[["key", "change_type", "ts"]].itertuples(index=False):
            if rows_now and (t - opened).total_seconds() * 1000 >= self.interval:
                out += self._flush(key[0], number, rows_now)
                number, rows_now = number + 1, {}
            if not rows_now:
                opened = t
            if merged(rows_now.get(k, (None,))[0], c):
                rows_now[k] = (c, t)
            if len(rows_now) >= self.most:
                out += self._flush(key[0], number, rows_now)
                number, rows_now = number + 1, {}
        self.pending.clear()
        for k, v in rows_now.items():
            self.pending.updateValue((k,), v)
        self.batch.update((number, opened if rows_now else None, len(rows_now)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rows_now:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.interval)
        if out:
            yield pd.DataFrame(out, columns=["group", "batch", "key", "change_type", "ts"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        number, _, n = self.batch.get()
        rows = {k[0]: (v[0], v[1]) for k, v in self.pending.iterator()} if n else {}
        self.pending.clear()
        self.batch.update((number + 1, None, 0))
        if rows:
            yield pd.DataFrame(self._flush(key[0], number, rows), columns=["group", "batch", "key", "change_type", "ts"])

    def close(self) -> None:
        pass


def coalesce_stream(feed: DataFrame, interval_ms: int = 1000, most: int = 100) -> DataFrame:
    """(group, batch, key, change_type, ts) of a feed (group, key, change_type, ts): for each group the batches of its queue, with one change a
    key: any delete (the last), else the last update, else the first create. A batch ends at ``most`` keys or after ``interval_ms``.

    State is one batch a group, so at most ``most`` keys. Groups without null; a null group should be named first."""
    return feed.select("group", "key", "change_type", "ts").groupBy("group").transformWithStateInPandas(
        _Coalesce(interval_ms, most), "group string, batch long, key string, change_type string, ts timestamp", outputMode="Append", timeMode="ProcessingTime"
    )


class _Retry(StatefulProcessor):
    def __init__(self, stuck: int, wait: int, most: int, busy: tuple[str, ...]):
        self.stuck, self.wait, self.most, self.busy = stuck, wait, most, busy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state string, ts timestamp, retries int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        _, seen, retries = self.last.get() if self.last.exists() else (None, None, 0)
        new = pd.concat(list(rows)).sort_values(["ts", "state"], kind="stable")
        new = new if seen is None else new[new["ts"] >= seen]  # what came late says nothing about the present
        if new.empty:
            return
        for state in new["state"]:
            retries = retries + 1 if state == "error" else 0 if state not in (*self.busy, "pending") else retries
        state = new["state"].iloc[-1]
        self.last.update((state, new["ts"].iloc[-1], retries))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        after = self.stuck if state in self.busy else self.wait if state == "error" and retries < self.most else None
        if after is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + after)
        return
        yield

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state, ts, retries = self.last.get()
        self.last.update(("pending", ts, retries))
        yield pd.DataFrame([(key[0], "retry" if state == "error" else "stuck", retries)], columns=["key", "reason", "retries"])

    def close(self) -> None:
        pass


def due_stream(feed: DataFrame, stuck_ms: int = 300_000, wait_ms: int = 0, most: int = 3, busy: tuple[str, ...] = ("in_progress",)) -> DataFrame:
    """(key, reason, retries) of keys that go back to pending, from a feed (key, state, ts): a key whose last state is one of ``busy`` and which
    sends nothing for ``stuck_ms`` (reason stuck), and one that failed fewer than ``most`` times in a row (reason retry, after ``wait_ms``).

    A failure counts until another state than a busy one or pending comes. Rows older than the last known one are ignored."""
    return feed.select("key", "state", "ts").groupBy("key").transformWithStateInPandas(
        _Retry(stuck_ms, wait_ms, most, busy), "key string, reason string, retries int", outputMode="Append", timeMode="ProcessingTime"
    )


class _Touch(StatefulProcessor):
    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first timestamp, last timestamp, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ts = pd.concat([r["ts"] for r in rows])
        old = self.seen.get() if self.seen.exists() else None
        first, last = ts.min() if old is None else min(old[0], ts.min()), ts.max() if old is None else max(old[1], ts.max())
        n = len(ts) + (0 if old is None else old[2])
        self.seen.update((first, last, n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep)
        yield pd.DataFrame([(key[0], "touched", first, last, n)], columns=["key", "event", "first_seen", "last_access", "n"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        first, last, n = self.seen.get()
        self.seen.clear()
        yield pd.DataFrame([(key[0], "forgotten", first, last, n)], columns=["key", "event", "first_seen", "last_access", "n"])

    def close(self) -> None:
        pass


def retained_stream(feed: DataFrame, keep_ms: int) -> DataFrame:
    """(key, event, first_seen, last_access, n) of a feed (key, ts): a row whenever a key is touched, and one, forgotten, when it was not for
    ``keep_ms``; its state is then gone, and a later touch is a first one again."""
    return feed.select("key", "ts").groupBy("key").transformWithStateInPandas(
        _Touch(keep_ms), "key string, event string, first_seen timestamp, last_access timestamp, n long", outputMode="Append", timeMode="ProcessingTime"
    )
