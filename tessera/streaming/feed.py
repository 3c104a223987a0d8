"""The change feed as Structured Streaming jobs; each also runs on a batch DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.stored import stored
from tessera.sources import buckets


def coalesce_changes(feed: DataFrame, key: str = "key", ts: str = "ts", seconds: int = 1, delay: str = "10 seconds") -> DataFrame:
    """(window_start, key, change_type, ts): one change a key and interval of a feed (key, change_type, ts).

    A delete wins, the last one; else an update, the last one; else it is the first create. The rule doesn't depend on order.
    ``keyed.coalesce_stream`` ends batches by their size, too."""
    feed = feed.withWatermark(ts, delay) if feed.isStreaming else feed
    t = F.col("change_type")
    g = feed.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), key).agg(*(f(F.when(t == k, F.col(ts))).alias(k) for k, f in (("deleted", F.max), ("updated", F.max), ("created", F.min))))
    kind = F.when(F.col("deleted").isNotNull(), "deleted").when(F.col("updated").isNotNull(), "updated").otherwise("created")
    return g.select(F.col("w.start").alias("window_start"), key, kind.alias("change_type"), F.coalesce("deleted", "updated", "created").alias("ts"))


def touched(feed: DataFrame, key: str = "key", ts: str = "ts") -> DataFrame:
    """First and last time and number of touches of each key (update mode on a stream)."""
    return feed.groupBy(key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_access"), F.count("*").alias("n"))


def running_statistics(feed: DataFrame) -> DataFrame:
    return feed.groupBy("change_type").agg(F.count("*").alias("n"))


def by_project(batch: DataFrame, project: str = "project_id") -> DataFrame:
    return batch.groupBy(F.coalesce(project, F.lit("_orphan")).alias("project")).agg(F.count("*").alias("n"))


def retained(rows: DataFrame, now, days: int, ts: str = "last_access") -> DataFrame:
    return rows.where(F.col(ts) >= now - F.expr(f"interval {days} days"))


def apply_batches(feed: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs what is available in micro-batches; ``apply`` must give the same result when a batch id comes twice."""
    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due(feed: DataFrame, now, minutes: int = 5, most: int = 3, key: str = "key", ts: str = "ts") -> DataFrame:
    """(key, state, retries) of those that go back to pending: in progress for longer than ``minutes``, or failed fewer than ``most``
    times, by the last state of each key in a feed (key, state, ts). ``keyed.due_stream`` is the form for streams, with timers."""
    last = feed.groupBy(key).agg(F.max_by("state", ts).alias("state"), F.max(ts).alias("at"), F.count_if(F.col("state") == "error").alias("retries"))
    stuck = (F.col("state") == "in_progress") & (F.col("at") < now - F.expr(f"interval {minutes} minutes"))
    return last.where(stuck | ((F.col("state") == "error") & (F.col("retries") < most))).select(key, "state", "retries")


def apply_to_snapshots(root: str, apply: Callable[[DataFrame, DataFrame], DataFrame], start: DataFrame) -> Callable[[DataFrame, int], None]:
    """A function for ``apply_batches``: batch n turns the snapshot of batch n - 1 (``start`` before the first) into that of batch n, in a
    folder of its own under ``root``; a batch that comes twice overwrites its own result only."""

    def run(batch: DataFrame, n: int) -> None:
        old = start if n == 0 else batch.sparkSession.read.parquet(f"{root}/batch={n - 1}")
        apply(old, batch).write.mode("overwrite").parquet(f"{root}/batch={n}")

    return run


def apply_to_buckets(spark: SparkSession, root: str, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """As ``apply_to_snapshots`` for a table in buckets (``sources.buckets``) under ``root``: a batch rewrites the buckets that it touches, and one
    that comes twice changes nothing."""

    def run(batch: DataFrame, n: int) -> None:
        buckets.merge(spark, root, stored(batch), apply, n)

    return run
