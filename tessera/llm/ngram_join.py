"""Similarity join on word n-gram sets with count vectors in an R-tree.

Exact for any data. (1) Equal sets become one. (2) Sets of Jaccard >= t share one of their first n - ceil(t n) + 1 grams in any
order that is the same for all; frequent grams come last in it. The holders of a gram are a bucket, and each is paired with the
bucket's smallest; pairs are bounded by their count vectors and verified. (3) Buckets whose members are still in several parts,
each set of members once and those of two members too unless these were the pair tried, are searched for the links between these: small ones pair by pair, with the size and count-vector
bounds inside the join; large ones by an R-tree over count vectors, whose leaf boxes rule out an overlap by summed coordinate minima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import U64, Words, gram_hash, lists, map_texts, mix, runs, signed, span_hash, written
from tessera.llm.bitmap import maybe
from tessera.llm.components import components, roots
from tessera.llm.keyed import shared_keys

#: Coordinates of a count vector, and grams of an R-tree leaf's members together (or one larger member).
DIMS = 256
LEAF = 400_000
#: Leaves of a node; members of a part of a family that get leaves of their own.
FAN, CROWD = 32, 64
#: Members up to which a bucket is searched pair by pair.
SMALL = 32
#: Documents, those of smallest hash, whose grams tell which are frequent (held by FREQUENT_IN of them), and grams remembered at most.
#: This only sets the order of grams: it has no effect on the result.
SAMPLE, FREQUENT_IN, FREQUENT = 20_000, 4, 1 << 18


def gram_sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each document, ascending, and their number. A document of fewer words has its sequence as one gram."""
    words = Words(data, at)
    docs = len(at) - 1
    if not len(words.starts):
        return np.zeros(0, U64), np.zeros(docs, np.int64)
    own = words.hashes(fold=True)
    ok = words.within(n)
    grams, of = gram_hash(own, n)[ok], words.docs[: len(ok)][ok]
    few = np.flatnonzero((words.counts > 0) & (words.counts < n))
    grams = np.concatenate([grams, span_hash(own, words.first[few], words.first[few + 1])])
    of = np.concatenate([of, few])
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.append(True, (grams[1:] != grams[:-1]) | (of[1:] != of[:-1]))
    return grams[new], np.bincount(of[new], minlength=docs)


def prefix(grams: np.ndarray, sizes: np.ndarray, percent: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first grams of each set, of which a set that links with it has one among its own; and their number.

    In the order, grams that are frequent come after the others, and else the smaller hash comes first."""
    docs = np.repeat(np.arange(len(sizes)), sizes)
    late = np.zeros(len(grams), bool)
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams
    order = np.lexsort((late, docs))  # stable: hashes ascend already
    take = np.where(sizes > 0, sizes + (-percent * sizes) // 100 + 1, 0)
    return grams[order][runs(sizes) < np.repeat(take, sizes)], take


def vector(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Grams of each set in each of DIMS hashed groups."""
    docs = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(docs * DIMS + (mix(grams) % U64(DIMS)).astype(np.int64), minlength=len(sizes) * DIMS).reshape(-1, DIMS)


def needed(a, b, percent: int):
    """The smallest overlap of sets of sizes a and b for which 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def allowed(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> np.ndarray:
    """Whether each left and each right member lie in different parts and may link, as their count vectors bound the overlap."""
    va, vb = np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy())
    na, nb = va.sum(1), vb.sum(1)
    most = np.zeros((len(na), len(nb)), np.int32)
    for d in range(va.shape[1]):
        most += np.minimum(va[:, d, None], vb[None, :, d]).astype(np.int32)
    return (most >= needed(na[:, None], nb[None], percent)) & (left["part"].to_numpy()[:, None] != right["part"].to_numpy()[None])


def leaf_links(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between members of two leaves that join parts not yet joined: one is enough for each two parts.

    Of the pairs that the count vectors allow, each left set is counted into all right sets at once."""
    ok = allowed(left, right, percent)
    part_a, part_b = left["part"].to_numpy(), right["part"].to_numpy()
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    sizes = np.array([len(g) for g in right["grams"]])
    grams, owner = np.concatenate(right["grams"].to_numpy()), np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    ia, ib, found = left["doc_id"].to_numpy(), right["doc_id"].to_numpy(), []
    for i, own in enumerate(left["grams"]):
        if not ok[i].any():
            continue
        lo, hi = np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right")
        n = hi - lo
        both = np.bincount(owner[np.repeat(lo, n) + runs(n)], minlength=len(sizes))
        for j in np.flatnonzero(ok[i] & (100 * both >= percent * (len(own) + sizes - both))).tolist():
            x, y = root(int(part_a[i])), root(int(part_b[j]))
            if x != y:
                up[max(x, y)] = min(x, y)
                found.append((int(ia[i]), int(ib[j])))
    return found


def rtree_links(members: DataFrame, light: DataFrame, texts: DataFrame, n: int, percent: int, leaf: int = LEAF) -> DataFrame:
    """(a, b): links that join parts of a family, for members (family, part, doc_id), their sizes and vectors (doc_id, size, vec) and the
    texts (doc_id, text).

    Members of a family are packed in order: those of a large part together, the others by size; into leaves of about ``leaf`` grams
    and coordinates together, and FAN leaves into a node. A box, of a leaf or node, has the largest count in each coordinate and the
    range of sizes. From pairs of nodes of a family whose boxes allow a link and that do not lie in one same part the search goes down
    to pairs of leaves, and each such two are searched as one group of a task: first by count vectors alone, and then the members
    that still have a partner by their sets, which only these need. No family is sorted, paired or held by one task."""
    crowd = members.groupBy("family", "part").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("family", "part", F.col("part").alias("crowd"))
    placed = members.join(crowd, ["family", "part"], "left").join(light, "doc_id").select("family", "crowd", "size", "doc_id", "part", "vec")
    order = ["family", "crowd", "size", "doc_id"]
    packed = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = "family long, crowd long, size long, doc_id long, part long, vec array<int>, node long, leaf long"
    rows = written(packed.mapInArrow(lambda batches: _pack(batches, leaf), f"{kind}, box struct<lo:long,hi:long,p0:long,p1:long,most:array<int>>"))
    leaves = rows.where("box is not null").select("family", "node", "leaf", "box.*")  # each leaf's first row has its box
    box = "lo long, hi long, p0 long, p1 long, most array<int>"

    def node_box(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, pdf["lo"].min(), pdf["hi"].max(), pdf["p0"].min(), pdf["p1"].max(), np.stack(pdf["most"].to_numpy()).max(0)]])

    nodes = leaves.groupBy("family", "node").applyInPandas(node_box, f"family long, node long, {box}")

    def side(df: DataFrame, k: str) -> DataFrame:
        return df.select("family", *(F.col(c).alias(f"{c}_{k}") for c in df.columns if c != "family"))

    def may(level: str):
        fit = (F.col(f"{level}_x") <= F.col(f"{level}_y")) & (F.col("hi_x") * 100 >= F.col("lo_y") * percent) & (F.col("hi_y") * 100 >= F.col("lo_x") * percent)
        fit &= _overlap("most_x", "most_y") * (100 + percent) >= (F.col("lo_x") + F.col("lo_y")) * percent
        return fit & ~((F.col("p0_x") == F.col("p1_x")) & (F.col("p0_y") == F.col("p1_y")) & (F.col("p0_x") == F.col("p0_y")))

    upper = side(nodes, "x").join(side(nodes, "y"), "family").where(may("node")).select("family", "node_x", "node_y")
    pairs = upper.join(side(leaves, "x"), ["family", "node_x"]).join(side(leaves, "y"), ["family", "node_y"]).where(may("leaf")).select("family", F.col("leaf_x").alias("i"), F.col("leaf_y").alias("j"))
    sides = F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("leaf")
    work = pairs.select("family", "i", "j", sides).join(rows, ["family", "leaf"]).select("family", "i", "j", "leaf", "part", "doc_id", "vec")

    def candidates(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["leaf"] == pdf["i"]], pdf[pdf["leaf"] == pdf["j"]]
        ok = allowed(left, right, percent)
        return pdf[pdf["doc_id"].isin(left["doc_id"][ok.any(1)]) | pdf["doc_id"].isin(right["doc_id"][ok.any(0)])]

    some = written(work.groupBy("family", "i", "j").applyInPandas(candidates, work.schema))
    grams = gram_table(texts, some.select("doc_id").distinct(), n)

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        found = leaf_links(pdf[pdf["leaf"] == pdf["i"]], pdf[pdf["leaf"] == pdf["j"]], percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return some.join(grams.select("doc_id", "grams"), "doc_id").groupBy("family", "i", "j").applyInPandas(links, "a long, b long")


def _pack(batches: Iterator[pa.RecordBatch], leaf: int) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches (family, crowd, size, doc_id, part, vec) with the node and the leaf of each, and on the first row of
    each leaf its box: the ranges of sizes and parts, and the largest count in each coordinate."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    node, inside, last = number, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        family, crowd, size = (batch.column(i).fill_null(np.iinfo(np.int64).min).to_numpy() for i in range(3))
        new = np.append(True, (np.diff(family) != 0) | (np.diff(crowd) != 0))
        run = np.cumsum(size + DIMS)
        start = np.flatnonzero(new)
        which = (run - np.repeat((run - size - DIMS)[start], np.diff(np.append(start, len(new))))) // leaf
        head = new | np.append(True, np.diff(which) != 0)
        leaves = np.cumsum(head)
        nodes = np.zeros(leaves[-1], np.int64)
        for i, of in enumerate(family[head].tolist()):
            if of != last or inside == FAN:
                node, inside, last = node + 1, 0, of
            inside += 1
            nodes[i] = node
        at = np.flatnonzero(head)
        part, vec = batch.column(4).to_numpy(), batch.column(5).flatten().to_numpy().reshape(-1, DIMS)
        sides = [f.reduceat(x, at) for x in (size, part) for f in (np.minimum, np.maximum)]
        boxes = pa.StructArray.from_arrays([*map(pa.array, sides), lists(np.maximum.reduceat(vec, at).ravel(), np.full(len(at), DIMS))], ["lo", "hi", "p0", "p1", "most"])
        boxes = boxes.take(pa.array(np.where(head, leaves - 1, 0), mask=~head))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes[leaves - 1]), pa.array(number + leaves), boxes], [*batch.schema.names, "node", "leaf", "box"])
        number += int(leaves[-1])


def jaccard_components(df: DataFrame, n: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: documents link when 100 * |A and B| >= percent * |A or B| for their sets of n-word shingles
    (A-Z lower-cased; a shorter text is one shingle); component_id is the smallest doc_id that links lead to, itself included.

    A null text, or one without words, has no shingles and links with nothing. A row with a null id links with nothing and
    has a null component. Rows that share an id are one document with several texts: links of any of them count for all.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def make():
        def f(batch, data, at):
            grams, sizes = gram_sets(data, at, n)
            docs = np.repeat(np.arange(len(sizes)), sizes)
            a, b = np.zeros(len(sizes), U64), np.zeros(len(sizes), U64)
            np.add.at(a, docs, mix(grams + U64(1)))
            np.add.at(b, docs, mix(grams ^ U64(0x6C62272E07BB0142)))
            return [batch.column(0), pa.array(sizes), pa.array(signed(a)), pa.array(signed(b)), lists(vector(grams, sizes).ravel().astype(np.int32), np.full(len(sizes), DIMS))]

        return f

    each = written(map_texts(rows, make, "doc_id long, n_shingles long, h1 long, h2 long, vec array<int>"))
    # one document stands for all of equal sets; written, so that joins with it can split what very many copies share
    lead = written(each.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("lead")))

    valid = rows.where("doc_id is not null")
    frequent = valid.sparkSession.sparkContext.broadcast(frequent_grams(valid, n))

    def make_keys():
        late = frequent.value

        def f(batch, data, at):
            grams, sizes = gram_sets(data, at, n)
            keys, per = prefix(grams, sizes, percent, late)
            salt = np.zeros(len(keys), np.int32)
            if len(late):  # grams that several documents are known to hold are dealt by document, too
                known = late[np.minimum(np.searchsorted(late, keys), len(late) - 1)] == keys
                salt[known] = 1 + np.flatnonzero(known) % 255
            return [pa.array(signed(keys)), batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), per))), pa.array(salt)]

        return f

    held = written(shared_keys(map_texts(valid, make_keys, "key long, doc_id long, salt int"), with_first=True, salted=True).select("key", "doc_id"))
    # copies of one set stand behind their lead; buckets of the same members are one
    same = each.join(lead, ["h1", "h2"]).select("doc_id", "lead").distinct()
    member = held.join(same, "doc_id").select("key", "lead").distinct()
    mark = F.xxhash64("lead")
    bucket = member.groupBy("key").agg(F.min("lead").alias("hub"), F.count("*").alias("n"), F.sum(F.shiftright(mark, 16)).alias("s"), F.bit_xor(mark).alias("x")).where("n > 1")
    bucket = bucket.select("key", "hub", "n", F.xxhash64("n", "s", "x").alias("family"))
    once = bucket.groupBy("family").agg(F.min("key").alias("key"), F.first("hub").alias("hub"), F.first("n").alias("n"), F.count("*").alias("times"))
    members = written(member.join(once, "key").select("family", "lead", "hub", "n", "times"))
    close = members.where("lead <> hub").groupBy(F.col("hub").alias("a"), F.col("lead").alias("b")).agg(F.sum("times").alias("n"))
    # of a set's pairs with smaller ones, the one of most grams in common is tried first
    tried = written(close.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b"))
    light = written(each.join(lead, ["h1", "h2"]).where("doc_id = lead").dropDuplicates(["h1", "h2", "doc_id"]).select("doc_id", F.col("n_shingles").alias("size"), "vec"))
    proved = written(_verify(rows, _bounded(tried, light, percent), n, percent))
    # each set has one smaller partner at most: a forest
    parts = written(roots(proved))
    state = members.join(parts.select(F.col("node").alias("lead"), F.col("component").alias("part")), "lead", "left").select("family", "n", F.col("lead").alias("doc_id"), F.coalesce("part", "lead").alias("part"))
    ends = state.groupBy("family").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.max("n").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("p0 <> p1")
    # a bucket of two is done only if its one pair is the one that was tried
    done = tried.select("a", "b", F.lit(2).cast("long").alias("n"))
    split = ends.join(done, ["a", "b", "n"], "left_anti").select("family")
    open_ = written(state.join(split, "family", "left_semi"))
    # pairs by coarse vectors first, as these go with every member of every bucket; the few that are left by the whole ones
    coarse = light.select("doc_id", "size", _coarse(F.col("vec")).alias("vec"))
    near = _bounded(written(_near(open_.where(F.col("n") <= SMALL).join(coarse, "doc_id"), percent)), light, percent)
    large = open_.where(F.col("n") > SMALL).drop("n")
    more = written(_verify(rows, near, n, percent).unionByName(rtree_links(large, light, rows, n, percent)))
    # what is left to join are parts: by links found between their members, and by documents of one id with several texts
    part_of = same.join(parts.select(F.col("node").alias("lead"), "component"), "lead", "left").select("doc_id", F.coalesce("component", "lead").alias("part"))
    part_of = written(part_of.distinct())
    several = part_of.groupBy("doc_id").agg(F.min("part").alias("a"), F.max("part").alias("z")).where("a <> z").drop("z")
    ends = more
    for end in "ab":
        ends = ends.join(parts.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    final = components(ends.select("a", "b").unionByName(part_of.join(several, "doc_id").select("a", F.col("part").alias("b"))))
    placed = part_of.join(final.withColumnRenamed("node", "part"), "part", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "part")).alias("component"))
    return each.join(placed, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def frequent_grams(rows: DataFrame, n: int, sample: int = SAMPLE) -> np.ndarray:
    """Sorted hashes of grams that several of a bounded number of documents hold, at most FREQUENT of them."""
    picked = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = rows.join(F.broadcast(picked), "doc_id").select("text")

    def make():
        def f(batch, data, at):
            return [pa.array(signed(gram_sets(data, at, n)[0]))]

        return f

    count = map_texts(some, make, "gram long", text=0).groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT_IN)
    got = count.orderBy(F.desc("n"), "gram").limit(FREQUENT).select("gram").toArrow()
    return np.sort(got["gram"].to_numpy().view(U64))


def _near(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one small bucket in different parts that sizes and count vectors do not rule out."""
    x = members.select("family", F.col("doc_id").alias("a"), F.col("size").alias("nx"), F.col("vec").alias("vx"), F.col("part").alias("px"))
    y = members.select("family", F.col("doc_id").alias("b"), F.col("size").alias("ny"), F.col("vec").alias("vy"), F.col("part").alias("py"))
    fit = (F.col("a") < F.col("b")) & (F.col("px") != F.col("py")) & (F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)
    return x.join(y, "family").where(fit & (_overlap("vx", "vy") * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent)).select("a", "b").distinct()


def _coarse(vec: Column) -> Column:
    """A count vector of a quarter of the coordinates, each the sum of four: what it bounds an overlap by is never less."""
    return F.transform(F.sequence(F.lit(0), F.lit(DIMS - 4), F.lit(4)), lambda i: sum((F.get(vec, i + k) for k in range(1, 4)), F.get(vec, i)))


def _overlap(x: str, y: str):
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.least(p, q)), F.lit(0).cast("long"), lambda s, v: s + v)


def gram_table(rows: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, size, grams) of some documents. A bitmap of their ids, of fixed size, drops most other texts before the shuffle."""

    def make():
        def f(batch, data, at):
            grams, sizes = gram_sets(data, at, n)
            return [batch.column(0), pa.array(sizes), lists(signed(grams), sizes)]

        return f

    # an inner join, as a semi join would be moved below the bitmap's
    some = maybe(rows, docs, "doc_id").join(docs.distinct(), "doc_id").select("doc_id", "text")
    return written(map_texts(some, make, "doc_id long, size long, grams array<long>"))


def _bounded(pairs: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and count vectors do not rule out."""
    x = light.select(F.col("doc_id").alias("a"), F.col("size").alias("nx"), F.col("vec").alias("vx"))
    y = light.select(F.col("doc_id").alias("b"), F.col("size").alias("ny"), F.col("vec").alias("vy"))
    like = (F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent) & (_overlap("vx", "vy") * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent)
    return written(pairs.join(x, "a").join(y, "b").where(like).select("a", "b").distinct())


def _verify(rows: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their sets."""
    sets = gram_table(rows, pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), n)
    x, y = (sets.select(F.col("doc_id").alias(k), F.col("size").alias(f"n{k}"), F.col("grams").alias(f"g{k}")) for k in "ab")
    both = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(x, "a").join(y, "b").where(both * 100 >= (F.col("na") + F.col("nb") - both) * percent).select("a", "b").distinct()
