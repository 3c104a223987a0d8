"""Sharding by Karmarkar-Karp differencing of groups that must stay together."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.batches import written

#: Items that one task combines at a time.
BLOCK = 4096


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions, one a row of k sums: the two with the largest spread are combined again and again,
    the largest sum of one with the smallest of the other. Returns the k sums and, for each row, the place where each of its
    columns ended up. Ties go to the earlier row, so the result depends on the rows and their order alone."""
    n, k = parts.shape
    order = np.argsort(-parts, axis=1, kind="stable")
    sums: list = list(np.take_along_axis(parts, order, 1))
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    made = []  # (left, right, how the combined sums were put in order)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = sums[a] + sums[b][::-1]
        put = np.argsort(-total, kind="stable")
        made.append((a, b, put))
        sums.append(total[put])
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(sums[-1][0] - sums[-1][-1]), len(sums) - 1))
    places: list = [None] * len(sums)
    places[-1] = np.arange(k)
    for i in range(len(made) - 1, -1, -1):
        a, b, put = made[i]
        mine = np.empty(k, np.int64)
        mine[put] = places[n + i]  # sorted position of left column j -> final place
        places[a], places[b] = mine, mine[::-1]
        places[n + i] = None
    ended = np.empty((n, k), np.int64)
    for i in range(n):
        ended[i, order[i]] = places[i]
    return sums[-1], ended


def _blocks(groups: DataFrame, shards: int, block: int) -> DataFrame:
    """(key, block, place) of the groups, and of the blocks their sums, as rows of kind 0 and 1."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True], ignore_index=True)
        parts = np.zeros((len(pdf), shards), np.int64)
        parts[:, 0] = pdf["bytes"]
        sums, ended = difference(parts)
        head = pd.DataFrame({"key": None, "block": pdf["block"].iloc[:1], "place": 0, "sums": [sums]})
        return pd.concat([pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "place": ended[:, 0], "sums": None}), head], ignore_index=True)

    n = max(1, -(-groups.count() // block))
    spread = groups.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n)))
    return written(spread.groupBy("block").applyInPandas(f, "key string, block long, place int, sums array<long>"))


def _combine(blocks: DataFrame, shards: int, fan: int) -> DataFrame:
    """(block, ended): where each place of each block goes when all blocks are combined, fan of them at a time."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        sums, ended = difference(np.stack(pdf["sums"].to_numpy()).astype(np.int64))
        return pd.DataFrame({"block": pdf["block"], "parent": pdf["parent"], "ended": list(ended), "sums": [sums] + [None] * (len(pdf) - 1)})

    def level(now: DataFrame, n: int) -> DataFrame:
        up = now.withColumn("parent", F.col("block") % n)
        return written(up.groupBy("parent").applyInPandas(f, "block long, parent long, ended array<int>, sums array<long>"))

    now, n, steps = blocks, blocks.count(), []
    while n:
        n = -(-n // fan)
        done = level(now, n)
        steps.append(done.select("block", "parent", "ended"))
        now = done.where("sums is not null").select(F.col("parent").alias("block"), "sums")
        if n == 1:
            break
    if not steps:
        return blocks.select("block", F.col("sums").cast("array<int>").alias("ended"))
    out = steps[-1].select("block", "ended")
    for step in reversed(steps[:-1]):
        top = out.select(F.col("block").alias("parent"), F.col("ended").alias("above"))
        out = step.join(top, "parent").select("block", F.transform("ended", lambda p: F.element_at("above", p + 1)).alias("ended"))
    return out


def shard(df: DataFrame, shards: int = 40, overhead: int = 16, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, fan: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: documents in ``shards`` shards of nearly equal bytes.

    Documents of equal text form one group and share a shard. Groups are dealt by hash into blocks of about ``block``; each
    block is partitioned by Karmarkar-Karp differencing, and the blocks' partial partitions are combined in the same way, ``fan``
    at a time, so no task and not the driver holds all groups. A group larger than a shard's share cannot be split and makes its
    shard larger. slot counts from 0 in each shard. The law is ``bytes``; grown_shard is null.

    A null text has no bytes and goes with the empty texts. Null and repeated ids are rows like any other. An empty table gives
    no rows.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    raw = body.cast("binary")
    rows = written(
        df.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("key"))
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    placed = _blocks(groups, shards, block)
    ended = _combine(placed.where("key is null").select("block", "sums"), shards, fan)
    put = placed.where("key is not null").join(ended, "block").select("key", F.element_at("ended", F.col("place") + 1).alias("shard"))
    # a hot group's rows are many: number them in parts, and add what stands before each part
    out = written(rows.join(put, "key").withColumn("part", F.pmod(F.xxhash64("doc_id", "size"), F.lit(64))).drop("key"))
    before = out.groupBy("shard", "part").count().withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")) - 1
    return out.join(F.broadcast(before.drop("count")), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (own + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
