"""Joins whose sides grow with the input gather neither side on the driver, however small Spark thinks that they are."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import search as S
from tessera.operators.similar import similar


@pytest.fixture
def tables(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("mention"), F.concat(F.lit("zz/none-"), F.col("id"), F.lit(".rs")).alias("ref"), F.lit(0.5).alias("confidence"), F.concat(F.lit("src/p"), F.col("id"), F.lit(".py")).alias("path"))
    rows.write.parquet(f"{tmp_path}/rows")
    t = spark.read.parquet(f"{tmp_path}/rows")
    return t.select("mention", "ref", "confidence"), t.select("path")


def wide_broadcasts(df) -> list[str]:
    """Broadcast joins but for that of the letter pairs' counts, of which there are as many as letters allow."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [s for s in plan.splitlines() if "BroadcastHashJoin" in s and "BroadcastHashJoin [g#" not in s]


def test_loose_references_are_not_broadcast(tables):
    mentions, files = tables
    assert wide_broadcasts(S.resolve_loose(mentions.select("ref"), files)) == []


def test_pending_mentions_are_not_broadcast(tables):
    assert wide_broadcasts(S.resolve_mentions(*tables)[1]) == []


def test_resolved_mentions_are_not_broadcast(tables):
    assert wide_broadcasts(S.resolve_mentions(*tables)[0]) == []


def test_pairs_of_other_names_do_not_meet(spark):
    left, right = spark.createDataFrame([("none-at-all",)], "name string"), spark.createDataFrame([("p12345.py",), ("none-at-alt",)], "name string")
    assert [(r.a, r.b) for r in similar(left, right, 0.7).collect()] == [("none-at-all", "none-at-alt")]
