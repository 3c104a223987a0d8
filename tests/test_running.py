"""Two-level running sums against windows, and rules for nulls, repeated keys and pages past the end."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import incremental as I
from tessera.operators import ranking as R
from tessera.operators import search as S
from tessera.operators.running import ranked, running
from tessera.streaming import feed

START = datetime(2024, 1, 1)


def test_running_equals_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", None, "a", "b"]), rng.randrange(50), i, rng.choice([None, 1, 5, -2])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, id int, v long").repartition(5)
    order = [F.desc("o"), F.col("id").asc()]
    for by in (["g"], []):
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        want = Counter((r.id, r.s, r.n) for r in df.withColumns({"s": F.sum(F.coalesce("v", F.lit(0))).over(w), "n": F.row_number().over(w)}).collect())
        out = running(df, by, order, {"s": F.col("v"), "n": F.lit(1).cast("long")})
        assert Counter((r.id, r.s, r.n) for r in out.collect()) == want and out.columns == [*df.columns, "s", "n"]
    assert running(df.limit(0), ["g"], order, {"s": F.col("v")}).count() == 0


def test_a_hot_group_is_spread(spark):
    df = spark.range(20_000).select(F.lit("one").alias("g"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would make one of few rows
    try:
        out = ranked(df, ["g"], [F.col("id").asc()])
        parts = {r.p for r in out.select(F.spark_partition_id().alias("p")).distinct().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and out.agg(F.max("rank"), F.count_distinct("rank")).first() == (20_000, 20_000)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_pack_counts_null_as_nothing(spark):
    rows = [("a", i, None if i == 2 else 400) for i in range(12)]
    df = spark.createDataFrame(rows, "g string, i int, n int")
    got = [r.pack for r in R.pack(df, ["g"], ["i"], F.col("n"), 1000, base=0).orderBy("i").collect()]
    assert got == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5]
    assert sorted(r.i for r in R.budget_skip(df, "g", ["i"], "i", "n", 900).collect()) == [0, 1, 2]


def test_history_has_the_limit_asked_for(spark):
    df = spark.range(300).select(F.col("id"), (F.lit(START) + F.make_dt_interval(secs=F.col("id"))).alias("ts"), (F.col("id") % 2).alias("entity"), F.lit("x").alias("entity_type"), F.lit("updated").alias("change_type"), F.lit(1).alias("lines_added"), F.lit(0).alias("lines_removed"))
    assert I.history(df, F.lit(True), [F.desc("ts")], 200).count() == 200
    assert [f.count() for f in (I.user_history(df, F.col("entity") == 1, 200), I.user_recent(df, ["x"], 200), I.user_range(df, F.lit(START), F.lit(START + timedelta(seconds=99)), "updated", 200))] == [50, 50, 50]
    assert I.user_recent(df, ["y"]).count() == 0 and I.user_recent(df).count() == 20
    assert {(r.kind, r.name, r.n) for r in I.user_statistics(df, 1).collect()} == {("change_type", "updated", 300), ("entity_type", "x", 300), ("entity", "0", 150)}


def test_updates_of_one_id_apply_in_turn(spark):
    state = spark.createDataFrame([(1, "pending", 0, START, None), (2, "pending", 2, START, "old"), (3, "done", 0, START, None)], "id int, state string, retries int, changed_at timestamp, error string")
    at = lambda s: START + timedelta(seconds=s)
    updates = spark.createDataFrame([(1, "done", at(2), None), (1, "busy", at(1), None), (2, "error", at(2), "bad"), (2, "busy", at(1), None), (2, "done", at(3), None), (3, "busy", at(1), None), (9, "busy", at(1), None)], "id int, to string, at timestamp, message string")
    allowed = spark.createDataFrame([("pending", "busy"), ("busy", "done"), ("busy", "error")], "`from` string, `to` string")
    after, refused = I.transition(state, updates, allowed)
    assert sorted(map(tuple, after.collect())) == [(1, "done", 0, at(2), None), (2, "error", 3, at(2), "bad"), (3, "done", 0, START, None)]
    assert sorted(map(tuple, refused.collect())) == [(2, "error", "done"), (3, "done", "busy")]
    free, none = I.transition(state, updates, allowed, enforce=False)
    assert {r.id: r.state for r in free.collect()} == {1: "done", 2: "done", 3: "busy"} and none.count() == 0


def test_repeated_keys_of_one_upsert(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "z", 1)], "id int, name string, n int")
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 0), (3, "x", 1), (3, "x", 1)], "id int, name string, n int")
    assert sorted(map(tuple, I.upsert(old, new, ["id"]).collect())) == [(1, "c", 0), (2, "z", 1), (3, "x", 1)]
    assert sorted(map(tuple, I.upsert(old, new, ["id"], ["n"]).collect())) == [(1, "b", 1), (2, "z", 1), (3, "x", 1)]


def test_a_page_past_the_end_keeps_the_total(spark):
    hits = spark.createDataFrame([(i, i / 10) for i in range(9)], "id int, score double")
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(9)], "id int, path string")
    assert [tuple(r) for r in S.search(hits, None, rows, 5, 20).collect()] == [(None, None, None, 9)]
    assert [(r.id, r.total) for r in S.search(hits, None, rows, 2, 8).collect()] == [(0, 9)]
    assert [(r.id, r.total) for r in S.search(hits.limit(0), None, rows, 2).collect()] == [(None, 0)]


def test_hybrid_ranks_are_spread(spark):
    near = spark.createDataFrame([(i, 0.5) for i in range(0, 40, 4)], "id long, score double")
    text = spark.range(5000).select("id", (F.lit(1.0) / (F.col("id") + 1)).alias("score"))
    got = {r.id: r.score for r in S.hybrid(near, text, None).collect()}
    assert set(got) == set(range(0, 40, 4)) | {1, 2, 3, 5, 6} and abs(got[4] - 0.5 * (1 + 0.3 / 5**0.5)) < 1e-12 and got[1] == 0.4


def test_changes_of_a_feed_into_buckets(spark, tmp_path):
    from tessera.plans.stored import new_folder
    from tessera.sources import buckets as B

    root = new_folder(spark)
    schema = "key string, hash string, provider string, embedding array<double>"
    B.create(spark.createDataFrame([(f"k{i}", "h", "p", [float(i)]) for i in range(50)], schema), root, ["key"], 8)
    batch = spark.createDataFrame([("k1", "deleted", None, None, None), ("k2", "updated", "h", "p", None), ("k99", "created", "n", "p", None)], "key string, change_type string, hash string, provider string, embedding array<double>")
    batch.write.parquet(f"{tmp_path}/in")
    apply = feed.apply_to_buckets(spark, root, I.apply_batch)
    feed.apply_batches(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in"), apply, f"{tmp_path}/check").awaitTermination()
    now = B.Bucketed(spark, root)
    assert now.version == 1 and {r.key: r.embedding for r in now.read().collect() if r.key in ("k1", "k2", "k99")} == {"k2": [2.0], "k99": None} and now.read().count() == 50
    apply(batch, 0)
    assert B.Bucketed(spark, root).version == 1
