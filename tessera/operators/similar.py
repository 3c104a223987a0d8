"""Pairs of like names, without comparing all: candidates share one of their rarest letter pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import edit_similarity


def _pairs(name: Column) -> Column:
    """Neighbouring letters of a name with marks at its ends, each with how often it came before in the name."""
    padded = F.concat(F.lit("\x02"), F.lower(name), F.lit("\x03"))
    every = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))
    numbered = lambda e: F.transform(e, lambda g, i: F.concat(g, F.size(F.filter(F.slice(e, 1, i), lambda h: h == g)).cast("string")))
    # the pairs are the one element of an array, so that they are made once a name and not once a pair
    return F.flatten(F.transform(F.array(every), numbered))


def similar(left: DataFrame, right: DataFrame, least: float, by: list[str] | None = None) -> DataFrame:
    """(by, a, b, similarity): names of left (by, name) and right (by, name) of equal ``by`` whose edit similarity is at least ``least``.

    Complete: names of n letters within d edits share all but 2 d of their n + 1 letter pairs, so one of the 2 d + 1 pairs that come first
    in any one order. In the order used the rarest pairs of right come first, so what many names share is seldom looked at. Names meet by
    such a pair and a length of right that left can be similar to, so one pair's block is split by length, and no two names meet that their
    lengths keep apart. Null names match nothing; each two names are returned once. Needs ``least`` over 0.5."""
    by = by or []

    def distinct(df: DataFrame, c: str) -> DataFrame:
        return df.where(F.col("name").isNotNull()).select(*by, F.col("name").alias(c)).distinct()

    a, b = distinct(left, "a"), distinct(right, "b")
    seen = b.select(F.explode(_pairs(F.col("b"))).alias("g")).groupBy("g").agg(F.count("*").alias("df"))

    def first(df: DataFrame, c: str) -> DataFrame:
        # the other name has at most n / least letters
        edits = F.floor((1 - least) / least * F.length(c) + 1e-9)
        rank = F.row_number().over(Window.partitionBy(*by, c).orderBy(F.coalesce("df", F.lit(0)), "g"))
        grams = df.select(*by, c, edits.alias("d"), F.explode(_pairs(F.col(c))).alias("g")).join(seen, "g", "left")
        # a pair that right does not have counts among the first, but no name can be met by it
        return grams.withColumn("r", rank).where((F.col("r") <= 2 * F.col("d") + 1) & F.col("df").isNotNull()).select(*by, c, "g")

    n = F.length("a")
    lengths = F.explode(F.sequence(F.ceil(least * n - 1e-9), F.floor(n / least + 1e-9))).alias("_n")
    mine, theirs = first(a, "a").select(*by, "a", "g", lengths), first(b, "b").withColumn("_n", F.length("b").cast("long"))
    # pairs and lengths multiply the names, which Spark's guess of their size leaves out: a merge join gathers neither side on the driver
    found = mine.join(theirs.hint("merge"), [*by, "g", "_n"]).select(*by, "a", "b").distinct()
    return found.withColumn("similarity", edit_similarity(F.col("a"), F.col("b"))).where(F.col("similarity") >= least)
