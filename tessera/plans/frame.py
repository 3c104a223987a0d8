"""A fluent query over one lazy DataFrame of hits: filter, rank, expand, boost; nothing runs until the result is used."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.parts import map_parts
from tessera.operators import predicates, search, traverse
from tessera.operators.ranking import page, top_k


class Hits:
    """Hits (id, ..., score). Each step gives a new object. Filters before a ranking restrict what is ranked; an empty result stays empty."""

    def __init__(self, df: DataFrame, key: str = "id"):
        out = df if key == "id" else df.withColumnRenamed(key, "id")
        self.df = out if "score" in out.columns else out.withColumn("score", F.lit(1.0))

    def where(self, spec: dict[str, Any] | None = None, column: Column | None = None) -> Hits:
        df = self.df if spec is None else self.df.where(predicates.where_map(spec))
        return Hits(df if column is None else df.where(column))

    def pattern(self, field: str, regex: str, whole: bool = False) -> Hits:
        return Hits(self.df.where(predicates.where_pattern(field, regex, whole)))

    def keep(self, predicate: Callable[[pd.DataFrame], pd.Series]) -> Hits:
        """Rows for which a vectorised user predicate is true."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                yield p[predicate(p)]

        return Hits(map_parts(self.df, run, self.df.schema))

    def semantic(self, vectors: DataFrame, query: Sequence[float], k: int, least: float = -1.0) -> Hits:
        """Nearest hits; after an earlier ranking the scores are weighted 0.3 to 0.7."""
        found = search.vector_search(vectors.join(self.df.select("id"), "id", "left_semi"), query, k, least)
        rest = [c for c in self.df.columns if c not in ("id", "score")]
        return Hits(found.join(self.df.select("id", *rest), "id"))

    def refine(self, vectors: DataFrame, query: Sequence[float], k: int) -> Hits:
        return Hits(search.refine(self.df.select("id", "score"), vectors, query, k))

    def expand(self, edges: DataFrame, kind: str | None, depth: int = 1, direction: str = "out", target: DataFrame | None = None) -> Hits:
        """With related: an array of (id, depth) of what the edges lead to."""
        found = traverse.expand(self.df.select("id"), edges, kind, depth, direction, target)
        grouped = found.groupBy(F.col("start").alias("id")).agg(F.sort_array(F.collect_list(F.struct("depth", F.col("id").alias("related_id")))).alias("related"))
        return Hits(self.df.join(grouped, "id", "left"))

    def has(self, edges: DataFrame, nodes: DataFrame, kind: str, name: str, direction: str = "out") -> Hits:
        return Hits(traverse.related_to(self.df, edges, kind, name, direction) if "name" in self.df.columns and nodes is self.df else self.df.join(traverse.related_to(nodes, edges, kind, name, direction).select("id"), "id", "left_semi"))

    def evaluated(self, evaluations: DataFrame, strategy: str = "weighted") -> Hits:
        return Hits(search.merge_scores(self.df.select("id", "score"), evaluations, strategy))

    def scored(self, rows: DataFrame, fields: list[str], scorer: Callable[[pd.DataFrame], pd.Series], strategy: str = "weighted") -> Hits:
        """Re-scored by a user's function over batches of hits with fields of rows."""
        return Hits(search.evaluated(self.df.select("id", "score"), rows, fields, scorer, strategy))

    def top(self, k: int, least: float | None = None) -> DataFrame:
        return top_k(self.df, k, least=least)

    def page(self, limit: int, offset: int = 0, order: list[Column] | None = None) -> DataFrame:
        return page(self.df, order or [F.desc("score"), F.col("id")], limit, offset)

    def count(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("n"))


def embed(df: DataFrame, text: str, provider: Callable[[pd.Series], Any], out: str = "embedding") -> DataFrame:
    """A vector column from a user's function of a series of texts."""
    return df.withColumn(out, F.pandas_udf(provider, "array<float>")(F.col(text)))


def generate(packs: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, base: DataFrame, key: str, merge: str = "append") -> DataFrame:
    """Columns that a user's function makes for packed rows, joined back by key: append keeps the row's own values, replace takes the new."""
    made = map_parts(packs, fn, schema)
    both = [c for c in made.columns if c in base.columns and c != key]
    new = made.select(key, *(F.col(c).alias(f"_{c}") for c in made.columns if c != key))
    pick = lambda c: F.coalesce(*((F.col(c), F.col(f"_{c}")) if merge == "append" else (F.col(f"_{c}"), F.col(c)))).alias(c)
    return base.join(new, key, "left").select(*(pick(c) if c in both else F.col(c) for c in base.columns), *(F.col(f"_{c}").alias(c) for c in made.columns if c not in base.columns))


def describe(tables: dict[str, DataFrame]) -> DataFrame:
    """(label, field, type) of the tables."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema], "label string, field string, type string")


def register(tables: dict[str, DataFrame]) -> None:
    """Temporary views for raw SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def summarise(df: DataFrame, key: str, field: str, fn: Callable[[pd.Series], pd.Series], least: int, out: str = "summary") -> DataFrame:
    """df with a summary, by a user's function of a series of texts, of fields longer than ``least`` characters; null for the others."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({key: p[key], out: fn(p[field])})

    kind = df.schema[key].dataType.simpleString()
    return generate(df.where(F.length(field) > least).select(key, field), run, f"`{key}` {kind}, `{out}` string", df, key)


def examples(tables: dict[str, DataFrame]) -> DataFrame:
    """(label, field, type, example): the fields of the tables, each with its smallest value as text."""
    out = None
    for label, df in tables.items():
        fields = [F.struct(F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type"), F.min(F.col(f.name).cast("string")).alias("example")) for f in df.schema]
        now = df.agg(F.array(*fields).alias("f")).select(F.lit(label).alias("label"), F.inline("f"))
        out = now if out is None else out.unionByName(now)
    return out
