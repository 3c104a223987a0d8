"""Ordering, ranks and budgets: window work; what is filled row by row is in ``packing``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.packing import budget_skip, pack  # noqa: F401
from tessera.operators.running import ranked, running


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def top_k(df: DataFrame, k: int, score: str = "score", key: str = "id", least: float | None = None) -> DataFrame:
    """The k best rows, ties by key; a minimum score cuts first. Spark keeps k rows a task and merges them."""
    return (df if least is None else df.where(F.col(score) >= least)).orderBy(F.desc(score), key).limit(k)


def ranks(df: DataFrame, score: str = "score", key: str = "id", within: list[str] | None = None) -> DataFrame:
    """1-based rank by score, ties by key; groups, and a table without any, may be of any size."""
    return ranked(df, within or [], [F.desc(score), F.col(key).asc()])


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row of greatest order in each group."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*by, "r.*")


def budget_suffix(df: DataFrame, by: list[str], newest: list[Column], size: Column, budget: int) -> DataFrame:
    """The newest rows of each group whose sizes together fit: the first that doesn't fit ends the list. A null size counts 0."""
    return running(df, by, newest, {"used": size.cast("long")}).where(F.col("used") <= budget)


def budget_cut(df: DataFrame, by: list[str], best: list[Column], text: str, budget: int, least: int = 100) -> DataFrame:
    """Rows by rank while they fit; the first that doesn't is cut to what remains if that is more than ``least`` characters."""
    left = F.lit(budget) - F.col("used") + F.length(text)
    out = running(df, by, best, {"used": F.length(text).cast("long")}).withColumn("left", left).where((F.col("left") > 0) & ((F.col("used") <= budget) | (F.col("left") > least)))
    return out.withColumn(text, F.when(F.col("used") <= budget, F.col(text)).otherwise(F.concat(F.substring(F.col(text), F.lit(1), F.col("left").cast("int")), F.lit("...")))).drop("used", "left")


def batches(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    return ranked(df, by, [F.col(c).asc() for c in order], "batch").withColumn("batch", F.floor((F.col("batch") - 1) / n))


def lines_around(lines: DataFrame, hit: Column, before: int, after: int, key: str = "doc_id", line: str = "line") -> DataFrame:
    """Lines (key, line, text) that match, with the lines around them joined as context."""
    w = Window.partitionBy(key).orderBy(line).rowsBetween(-before, after)
    return lines.withColumn("context", F.array_join(F.collect_list("text").over(w), "\n")).where(hit)
