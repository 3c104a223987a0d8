"""The relational tables read as a property graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LABELS = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name"), "customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name")}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def node_id(label: str, key) -> F.Column:
    return F.concat(F.lit(label + ":"), F.col(key).cast("string"))


def nodes(spark: SparkSession, d: str, labels: list[str] | None = None) -> DataFrame:
    """(id, label, name)."""
    parts = [table(spark, d, t).select(node_id(t, k).alias("id"), F.lit(t).alias("label"), F.col(n).alias("name")) for t, (k, n) in _LABELS.items() if labels is None or t in labels]
    if labels is None or "orders" in labels:
        parts.append(table(spark, d, "orders").select(node_id("orders", "o_orderkey").alias("id"), F.lit("orders").alias("label"), F.col("o_orderkey").cast("string").alias("name")))
    return reduce(DataFrame.unionByName, parts)


_EDGES = {
    "IN_REGION": ("nation", "nation", "n_nationkey", "region", "n_regionkey"),
    "IN_NATION": ("customer", "customer", "c_custkey", "nation", "c_nationkey"),
    "SUPPLIER_IN": ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"),
    "PLACED_BY": ("orders", "orders", "o_orderkey", "customer", "o_custkey"),
    "CONTAINS": ("lineitem", "orders", "l_orderkey", "part", "l_partkey"),
    "SUPPLIED_BY": ("lineitem", "part", "l_partkey", "supplier", "l_suppkey"),
}


def edges(spark: SparkSession, d: str, kinds: list[str] | None = None, unique: bool = True) -> DataFrame:
    """(src, dst, type), each triple once; without ``unique`` as often as rows name it, which spares a shuffle where it doesn't matter."""
    parts = []
    for kind, (t, a, ka, b, kb) in _EDGES.items():
        if kinds is None or kind in kinds:
            e = table(spark, d, t).select(node_id(a, ka).alias("src"), node_id(b, kb).alias("dst"), F.lit(kind).alias("type"))
            parts.append(e.distinct() if unique and t == "lineitem" else e)
    return reduce(DataFrame.unionByName, parts)
