"""The trie of conversations' turns, built by bursting.

All conversations begin in one container under the root. A container with more turns than a limit bursts by its next turn: every turn
that comes next heads a container of its own, all containers of a level in one Spark step, until what is left fits. The remaining
containers are dealt over tasks, each one's suffixes are sorted, and one sweep over the sorted order gives its nodes. A node is known by its
smallest conversation and its depth; totals of the heads are summed upwards level by level.

Equal conversations are one sequence with a weight, found by a digest that Spark sums from turns, and one sequence alone that exceeds the
limit is a chain whose rows give its nodes directly. So neither a conversation nor a group of copies has to fit in a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.batches import written

#: Turns that a container may have before it bursts.
LIMIT = 1000
_NO_ONE = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_s long"


def _runs_of(column: pa.Array) -> np.ndarray:
    values = column.to_numpy()
    return np.flatnonzero(np.append(True, values[1:] != values[:-1]))


def ranked(df: DataFrame) -> DataFrame:
    """(conv_id, pos, tid, nb) of df (conv_id, turn, role, text): every turn's place in its conversation, from 0, by turn (null first),
    role and text; tid stands for its role and text, nb is its text's number of UTF-8 bytes.

    Turns are dealt by ranges, so a long conversation is spread over tasks; each task ranks what it has, and the places before each task's
    first conversation, one number a task, are added afterwards."""
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first()]
    dealt = df.repartitionByRange(*keys, F.substring("role", 1, 16), F.substring("text", 1, 32)).sortWithinPartitions(*keys, "role", "text")
    tid = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    dealt = dealt.select("conv_id", tid.alias("tid"), F.octet_length("text").cast("long").alias("nb"), F.spark_partition_id().alias("part"))

    def rank(batches):
        last, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv, start = b.column(0).to_numpy(), _runs_of(b.column(0))
            size = np.diff(np.append(start, len(conv)))
            pos = np.arange(len(conv)) - np.repeat(start, size)
            if conv[0] == last:
                pos[: size[0]] += n
            last, n = conv[-1], pos[-1] + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pos)], ["conv_id", "tid", "nb", "part", "pos"])

    local = written(dealt.mapInArrow(rank, "conv_id long, tid binary, nb long, part int, pos long"))
    ends = local.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max(F.struct("conv_id", "pos")).alias("hi")).orderBy("part").collect()  # a row a task
    before, last, n = [], None, 0
    for r in ends:
        here = n if r.lo == last else 0
        if here:
            before.append((r.part, r.lo, here))
        n = r.hi.pos + 1 + (here if r.hi.conv_id == r.lo else 0)
        last = r.hi.conv_id
    if before:
        more = df.sparkSession.createDataFrame(before, "part int, conv_id long, more long")
        local = local.join(F.broadcast(more), ["part", "conv_id"], "left").withColumn("pos", F.col("pos") + F.coalesce("more", F.lit(0)))
    return local.select("conv_id", "pos", "tid", "nb")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n_turns) and (conv_id, pos, tid, nb) of rebuilt conversations: the first h turns of conversation c - c % 5, then the turns of
    c after its own first h, with h = crc32 of c as text modulo 9. Remainders are not negative."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    known = own.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(5)))
    known = known.join(own.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base")), "base", "left")
    known = known.withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("n_turns", F.col("m") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
    known = written(known.select("conv_id", "base", "h", "m", "n_turns"))
    lead = turns.where("pos < 8").withColumnRenamed("conv_id", "base").join(known.where("m > 0"), "base").where("pos < h")
    rest = turns.join(known.select("conv_id", "h", "m"), "conv_id").where("pos >= h").withColumn("pos", F.col("m") + F.col("pos") - F.col("h"))
    cols = ["conv_id", "pos", "tid", "nb"]
    return known.select("conv_id", "n_turns"), written(lead.select(cols).unionByName(rest.select(cols)))


def _id_hashes(members: DataFrame) -> DataFrame:
    """(s, ends) for members (s, conv_id): SHA-256 of each s's ids in ascending order. Ids of a range are joined to pieces before they meet."""

    def pieces(batches):
        for b in batches:
            if b.num_rows:
                s, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
                cut = _runs_of(b.column(0))
                text = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(cut, [*cut[1:], len(s)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s[cut]), pa.array(ids[cut]), pa.array(text)], ["s", "low", "ids"])

    def hashes(batches):
        now, state = None, None
        for b in batches:
            out = []
            for s, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if s == now:
                    state.update(b",")
                else:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = s, hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out]), pa.array([x for _, x in out])], ["s", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["s", "ends"])

    parts = members.repartitionByRange("conv_id").sortWithinPartitions("s", "conv_id").mapInArrow(pieces, "s long, low long, ids string")
    return parts.repartition("s").sortWithinPartitions("s", "low").mapInArrow(hashes, "s long, ends string")


def sweep(container: list[tuple[int, int, list[bytes], list[int]]], top: int, depth: int) -> list[list]:
    """Nodes of a container below its head: rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, end_s), and
    first a row for the head with parent_conv_id None and what is below it. container: (s, weight, tids, bytes) of each suffix."""
    conv, level, parent, n, kids, leaves, saved, end, nb = [top], [depth], [-1], [0], [0], [0], [0], [None], [0]
    path, before = [0], []
    for s, w, tids, sizes in sorted(container, key=lambda x: x[2]):
        same = 0
        while same < len(before) and same < len(tids) and before[same] == tids[same]:
            same += 1
        del path[same + 1 :]
        for j in range(same, len(tids)):
            parent.append(path[-1])
            path.append(len(conv))
            conv.append(s)
            level.append(depth + j + 1)
            nb.append(sizes[j])
            for x in (n, kids, leaves, saved):
                x.append(0)
            end.append(None)
        n[path[-1]] += w
        end[path[-1]] = s
        conv[path[-1]] = min(conv[path[-1]], s)
        before = tids
    for i in range(len(conv) - 1, 0, -1):  # a node stands after its parent
        up = parent[i]
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * nb[i]
        conv[up] = min(conv[up], conv[i])
        n[up] += n[i]
        kids[up] += 1
        leaves[up] += leaves[i]
        saved[up] += saved[i]
    return [[conv[i], level[i], conv[parent[i]] if i else None, n[i], kids[i], leaves[i], saved[i], end[i]] for i in range(len(conv))]


def _swept(rows: DataFrame) -> DataFrame:
    """Nodes of all containers of rows (k, d, s, w, pos, tid, nb); a head's own row is the one without a parent."""

    def run(batches):
        key, held = None, {}

        def close(out):
            if key is not None:
                out += sweep([(s, *x) for s, x in held.items()], *key)

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], [x.split()[0] for x in _NODE.split(", ")])

        for b in batches:
            out: list[list] = []
            k, d, s, w, _, tid, nb = (c.to_pylist() for c in b.columns)
            for i in range(b.num_rows):
                if key is None or k[i] != key[0]:
                    close(out)
                    key, held = (k[i], d[i]), {}
                if s[i] not in held:
                    held[s[i]] = (w[i], [], [])
                held[s[i]][1].append(tid[i])
                held[s[i]][2].append(nb[i])
            if out:
                yield batch_of(out)
        out = []
        close(out)
        if out:
            yield batch_of(out)

    return rows.select("k", "d", "s", "w", "pos", "tid", "nb").repartition("k").sortWithinPartitions("k", "s", "pos").mapInArrow(run, _NODE)


def _chains(rows: DataFrame) -> DataFrame:
    """As _swept, for containers of one long sequence each: rows (k, d, s, w, n_turns, pos, nb). Sums of what follows go by blocks of rows."""
    rows = rows.withColumn("block", F.expr("pos div 4096"))
    after = Window.partitionBy("s").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("s", "block").agg(F.sum("nb").alias("here")).select("s", "block", F.coalesce(F.sum("here").over(after), F.lit(0)).alias("later"))
    inside = Window.partitionBy("s", "block").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    tail = rows.join(blocks, ["s", "block"]).withColumn("saved", (F.col("w") - 1) * (F.sum("nb").over(inside) + F.col("later")))
    last = F.col("pos") + 1 == F.col("n_turns")
    long = F.lit(1).cast("long")
    nodes = tail.select(
        F.col("s").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.col("s").alias("parent_conv_id"), F.col("w").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        long.alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.when(last, F.col("s")).alias("end_s"),
    )
    none = F.lit(None).cast("long")
    tops = tail.where("pos = d").select("s", F.col("d").alias("depth"), none.alias("up"), F.col("w"), long.alias("kids"), long.alias("leaves"), "saved", none.alias("e"))
    return nodes.union(tops)


def prefix_trie(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for every node of the trie of rebuilt
    conversations.

    Null roles and texts are empty; turns of equal number, repeated rows too, stand in the order of role and text, a null turn first. Rows
    without conv_id belong to no conversation and are left out. Other columns are not read. A conversation without turns ends at the
    root. An empty table has no nodes. limit sets when containers burst and has no influence on the result.
    """
    rows = df.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs, turns = rebuilt(ranked(rows))
    one, two = F.xxhash64("pos", "tid"), F.xxhash64(F.lit(1), "tid", "pos")
    digest = turns.groupBy("conv_id").agg(F.bit_xor(one).alias("d1"), F.bit_xor(two).alias("d2"))
    digest = written(convs.join(digest, "conv_id", "left").na.fill(0, ["d1", "d2"]))
    same = ["d1", "d2", "n_turns"]
    classes = digest.groupBy(*same).agg(F.min("conv_id").alias("s"), F.count("*").alias("w"))
    classes = written(classes)
    ends = _id_hashes(digest.join(classes, same).select("s", "conv_id"))
    seqs = classes.select("s", "w", "n_turns")
    turns = written(turns.withColumnRenamed("conv_id", "s").join(seqs.select("s"), "s", "left_semi").repartitionByRange("pos", "s").sortWithinPartitions("pos"))

    # a level: its nodes with what bursts further, and the sequences in them
    over = (F.col("turns") > limit) & (F.col("n_seqs") > 1)
    long = (F.col("turns") > limit) & (F.col("n_seqs") == 1)
    root = seqs.groupBy().agg(F.min("s").alias("k"), F.sum("w").alias("n_convs"), F.sum("n_turns").alias("turns"), F.count("*").alias("n_seqs"), F.max(F.when(F.col("n_turns") == 0, F.col("s"))).alias("end_s"))
    level = root.where("n_seqs > 0").select("k", F.lit(None).cast("long").alias("up"), "n_convs", F.lit(0).cast("long").alias("nb"), "end_s", over.alias("over"), long.alias("long"))
    level = written(level)
    top = level.first() or {"k": None, "over": False, "long": False}  # one row
    inside = seqs.select("*", F.lit(top["k"]).cast("long").alias("k"), F.lit(top["over"]).alias("over"), F.lit(top["long"]).alias("long"))
    levels, placed = [level], [inside.where("not over").withColumn("d", F.lit(0).cast("long"))]
    while not levels[-1].where("over").isEmpty():
        d = len(levels) - 1
        step = inside.where(F.col("over") & (F.col("n_turns") > d)).select("s", "w", "n_turns", F.col("k").alias("up"))
        step = written(step.join(turns.where(F.col("pos") == d).select("s", "tid", "nb"), "s"))
        heads = step.groupBy("up", "tid").agg(
            F.min("s").alias("k"), F.sum("w").alias("n_convs"), F.max("nb").alias("nb"), F.sum(F.col("n_turns") - d - 1).alias("turns"), F.count("*").alias("n_seqs"),
            F.max(F.when(F.col("n_turns") == d + 1, F.col("s"))).alias("end_s"),
        )
        heads = written(heads.select("up", "tid", "k", "n_convs", "nb", "end_s", over.alias("over"), long.alias("long")))
        inside = written(step.join(heads.select("up", "tid", "k", "over", "long"), ["up", "tid"]).select("s", "w", "n_turns", "k", "over", "long"))
        levels.append(heads.drop("tid"))
        placed.append(inside.where("not over").withColumn("d", F.lit(d + 1).cast("long")))

    members = placed[0]
    for more in placed[1:]:
        members = members.unionByName(more)
    suffixes = members.join(turns, "s").where("pos >= d")
    swept = written(_swept(suffixes.where("not long")).unionByName(_chains(suffixes.where("long"))))
    below = swept.where("parent_conv_id is null").select(F.col("conv_id").alias("k"), F.col("depth").alias("d"), "n_children", "n_leaves", F.col("saved_tokens").alias("below"))
    nodes, children = swept.where("parent_conv_id is not null"), None
    for d in range(len(levels) - 1, -1, -1):
        sums = below.where(F.col("d") == d).drop("d")
        if children is not None:
            sums = sums.unionByName(children.groupBy(F.col("parent_conv_id").alias("k")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below")))
        none = F.lit(0).cast("long")
        here = levels[d].join(sums, "k", "left").select(
            F.col("k").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.col("up").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", none).alias("n_children"),
            F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), (F.coalesce("below", none) + (F.col("n_convs") - 1) * F.col("nb")).alias("saved_tokens"), "end_s",
        )
        children = written(here)
        nodes = nodes.unionByName(children)
    nodes = nodes.join(ends.withColumnRenamed("s", "end_s"), "end_s", "left")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NO_ONE)).alias("ends_sha256"))
