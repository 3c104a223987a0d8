"""A stored vector index: vectors in cells around centroids, of which a search reads the nearest few."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine, dot, vector
from tessera.operators.ranking import top_k

#: Rows that the centroids are fitted on, at most.
SAMPLE = 200_000
#: Rows of a cell, and queries that probe it, that one task compares at a time, about; and queries whose scores it holds together.
SLICE, ASKED, TOGETHER = 20_000, 4_096, 128


def _unit(field: str) -> Column:
    """The vector at length 1; a zero vector stays one, with a first entry so that it has a direction for its cell."""
    v = F.transform(field, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    scaled = lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x, i: F.when(i == 0, 1.0).otherwise(0.0)))
    # the norm is the one element of an array, so that it is computed once a vector and not once an entry
    return F.get(F.transform(F.array(norm), scaled), 0)


def build_cells(vectors: DataFrame, root: str, cells: int = 64, key: str = "id", field: str = "embedding", sample: int = SAMPLE, seed: int = 7) -> None:
    """Write vectors (id, embedding, ...) under root, partitioned by cell, with their norms; null vectors are left out.

    Centroids come from k-means by angle on at most ``sample`` rows (a fraction of all, drawn by hash of the key); every row is then given
    its cell. A cell goes to as many tasks as its size asks for. All vectors must have one length."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(field).isNotNull() & (F.size(field) > 0)).withColumnRenamed(key, "id").withColumnRenamed(field, "embedding")
    n = rows.count()
    share = min(1.0, sample / max(n, 1))
    unit = rows.withColumn("_unit", array_to_vector(_unit("embedding")))
    fit = unit if share == 1 else unit.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    if n == 0:
        raise ValueError("no vectors to build an index of")
    model = KMeans(k=max(2, min(cells, n)), distanceMeasure="cosine", maxIter=10, seed=seed, featuresCol="_unit", predictionCol="cell").fit(fit)
    model.write().overwrite().save(f"{root}/model")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    out = model.transform(unit).drop("_unit").withColumn("norm", norm)
    out.hint("rebalance", "cell").write.partitionBy("cell").mode("overwrite").parquet(f"{root}/cells")
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    spark.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{root}/centres")


def add_vectors(spark: SparkSession, root: str, vectors: DataFrame, key: str = "id", field: str = "embedding") -> None:
    """Append new rows to their cells; centroids stay. Ids must be new."""
    rows = vectors.where(F.col(field).isNotNull() & (F.size(field) > 0)).withColumnRenamed(key, "id").withColumnRenamed(field, "embedding")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    placed = KMeansModel.load(f"{root}/model").transform(rows.withColumn("_unit", array_to_vector(_unit("embedding")))).drop("_unit").withColumn("norm", norm)
    placed.hint("rebalance", "cell").write.partitionBy("cell").mode("append").parquet(f"{root}/cells")


def _centres(spark: SparkSession, root: str) -> np.ndarray:
    """One row a cell, in order of cells."""
    return np.array([r.centre for r in spark.read.parquet(f"{root}/centres").orderBy("cell").collect()])


def _nearest(centres: np.ndarray, query: Sequence[float], probes: int | None) -> list[int]:
    q = np.asarray(query, float)
    score = centres @ q / np.maximum(np.linalg.norm(centres, axis=1), 1e-300)
    order = np.lexsort((np.arange(len(score)), -score))
    return order[: len(order) if probes is None else probes].tolist()


def cell_search(spark: SparkSession, root: str, query: Sequence[float], k: int, probes: int | None = 8, least: float = -1.0, where: Column | None = None) -> DataFrame:
    """(id, score): the k nearest rows by cosine among those of the ``probes`` cells nearest to the query; without a number, of all cells, which
    is the exact result. Only folders of these cells are read, and a filter holds before ranking."""
    q = [float(x) for x in query]
    rows = spark.read.parquet(f"{root}/cells").where(F.col("cell").isin(_nearest(_centres(spark, root), q, probes)))
    rows = rows if where is None else rows.where(where)
    length = float(np.linalg.norm(q))
    same = (F.size("embedding") == len(q)) & (F.col("norm") > 0) if length else F.lit(False)
    score = F.when(same, dot("embedding", q) / (F.col("norm") * length)).otherwise(0.0)
    return top_k(rows.select("id", score.alias("score")), k, least=least)


def cell_search_fields(spark: SparkSession, root: str, query: Sequence[float], fields: list[str], k: int, probes: int | None = 8, least: float = -1.0) -> DataFrame:
    """Best score over the named vectors of an id, of an index of (id, field, embedding): ``multi_search`` among the nearest cells."""
    q = [float(x) for x in query]
    rows = spark.read.parquet(f"{root}/cells").where(F.col("cell").isin(_nearest(_centres(spark, root), q, probes)) & F.col("field").isin(*fields))
    best = rows.groupBy("id").agg(F.max(cosine(F.col("embedding"), vector(q))).alias("score"))
    return top_k(best, k, least=least)


def search_many(spark: SparkSession, root: str, queries: DataFrame, k: int, probes: int | None = 8) -> DataFrame:
    """(query, id, score): for each of queries (query, vector) what ``cell_search`` gives, in one pass: queries go to the cells they probe and
    meet the rows there; each cell keeps k rows a query before anything is gathered. Every pair of a cell's rows and queries is compared,
    in tiles of bounded size: a task's memory does not grow with either."""
    centres = _centres(spark, root)
    norms = np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    unit, most = centres / norms, len(centres) if probes is None else probes

    @F.pandas_udf("array<int>")
    def cells_of(v):
        m = np.stack(v.to_numpy()).astype(float)
        return pd.Series(list(np.argsort(-(m @ unit.T), axis=1, kind="stable")[:, :most].astype(np.int32)))

    asked = queries.select("query", "vector", F.explode(cells_of("vector")).alias("cell"))
    rows = spark.read.parquet(f"{root}/cells")
    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": [], "id": [], "score": []})]
        if len(q) and len(r):
            b, norm, ids, names = np.stack(r["embedding"]).astype(float), r["norm"].to_numpy(), r["id"].to_numpy(), q["query"].to_numpy()
            for lo in range(0, len(q), TOGETHER):
                a = np.stack(q["vector"].iloc[lo : lo + TOGETHER]).astype(float)
                score = a @ b.T / np.maximum(np.linalg.norm(a, axis=1)[:, None] * norm[None, :], 1e-300)
                for name, mine in zip(names[lo : lo + TOGETHER], score, strict=True):
                    top = np.lexsort((ids, -mine))[:k]
                    out.append(pd.DataFrame({"query": name, "id": ids[top], "score": mine[top]}))
        return pd.concat(out[1:] or out)

    # a cell's rows, and the queries that probe it, are cut into slices of bounded size, each of which meets each of the other kind
    count = lambda c, size: F.greatest(F.lit(1), F.ceil(F.col(c) / size)).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n")).join(asked.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    sizes = F.broadcast(sizes.select("cell", count("n", SLICE).alias("n"), count("m", ASKED).alias("m")))  # one row a cell
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    dealt = rows.join(sizes, "cell").select("id", "embedding", "norm", "cell", part("id", "n").alias("slice"), each(F.col("m")).alias("ask"))
    wide = asked.join(sizes, "cell").select("query", "vector", "cell", part("query", "m").alias("ask"), each(F.col("n")).alias("slice"))
    by = ["cell", "slice", "ask"]
    found = wide.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(best, "query long, id long, score double")
    ordered = found.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k).alias("top"))  # k rows a cell slice and query
    return ordered.select("query", F.explode("top").alias("t")).select("query", "t.id", (-F.col("t.s")).alias("score"))


def recall(spark: SparkSession, root: str, queries: DataFrame, k: int, probes: int) -> float:
    """The share of the exact k nearest rows of queries (query, vector) that probing so many cells finds."""
    exact, found = search_many(spark, root, queries, k, None), search_many(spark, root, queries, k, probes)
    r = exact.join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left").agg(F.count("hit").alias("h"), F.count("*").alias("n")).first()
    return r.h / r.n if r.n else 1.0


def probes_for(spark: SparkSession, root: str, queries: DataFrame, k: int, least: float = 0.9) -> int:
    """The number of cells to probe for a recall of ``least`` on the queries: doubled until it is reached."""
    n, probes = len(_centres(spark, root)), 1
    while probes < n and recall(spark, root, queries, k, probes) < least:
        probes *= 2
    return min(probes, n)
