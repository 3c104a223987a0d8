"""Searching lines through an index of trigrams: a pattern's literals name the texts that can match, and only these are read."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.search import fuzzy_grep, grep
from tessera.plans.stored import stored
from tessera.sources import buckets as B
from tessera.sources import text_index

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters within lines, A-Z in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(r"(?=([^\n]{3}))"), 1))


def _packed(texts: pd.Series) -> pd.Series:
    """The trigrams of each text, each followed by a line break, which none holds."""

    def one(text: str | None) -> str:
        c = np.frombuffer((text or "").encode("utf-32-le"), np.uint32).astype(np.int64)
        c += 32 * ((c >= 0x41) & (c <= 0x5A))
        runs = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
        runs = np.unique(runs[(c[:-2] != 10) & (c[1:-1] != 10) & (c[2:] != 10)])
        out = np.stack([runs >> 42, (runs >> 21) & 0x1FFFFF, runs & 0x1FFFFF, np.full(len(runs), 10)], axis=1)
        return out.astype("<u4").tobytes().decode("utf-32-le")

    return texts.map(one, na_action=None)


def _trigrams_of_many(text: Column) -> Column:
    """``trigrams`` of whole tables of texts: without a match of an expression at each place."""
    packed = F.pandas_udf(_packed, "string")(text)
    return F.filter(F.split(packed, "\n"), lambda g: g != "")


def build(docs: DataFrame, root: str, key: str = "doc_id", text: str = "text", buckets: int = 64) -> None:
    """Write ``grams`` (gram, key) by gram and ``texts``, all columns of docs, by key. Keys must be unique.

    A text's grams of one bucket are shuffled as one string; no gram holds a line break."""
    B.create(docs, f"{root}/texts", [key], buckets)
    dealt = B.by_bucket(docs.where(F.col(text).isNotNull()), [key], _trigrams_of_many(F.col(text)), "\n", buckets)
    B.create(dealt, f"{root}/grams", ["gram"], buckets, ["gram", key], lambda rows: rows.select(F.explode(F.split("packed", "\n")).alias("gram"), key, "bucket"))


def update(spark: SparkSession, root: str, changed: DataFrame, key: str = "doc_id", text: str = "text", batch: int | None = None) -> None:
    """Bring the index up to date with changed and new rows: grams of their old texts go, those of the new ones come."""
    changed = stored(changed)
    now = B.Bucketed(spark, f"{root}/texts")
    before = B.Bucketed(spark, f"{root}/texts", now.version - 1) if batch is not None and now.batch == batch and now.version else now
    hit = [r.b for r in changed.select(B.bucket_of([key], now.buckets).alias("b")).distinct().collect()]
    gram = lambda df: df.where(F.col(text).isNotNull()).select(F.explode(_trigrams_of_many(F.col(text))).alias("gram"), key)
    old = gram(before.read(hit).join(changed.select(key), key, "left_semi")).withColumn("_add", F.lit(False))
    new = gram(changed).withColumn("_add", F.lit(True))
    moved = stored(old.unionByName(new))
    cols = ["gram", key]
    B.merge(spark, f"{root}/grams", moved, lambda have, c: have.join(c.select(cols), cols, "left_anti").select(cols).unionByName(c.where("_add").select(cols)), batch, cols)
    B.merge(spark, f"{root}/texts", changed, lambda have, c: have.join(c.select(key), key, "left_anti").unionByName(c), batch)


def needed(pattern: str) -> list[str] | None:
    """Trigrams, A-Z in lower case, that every line matching a regular expression holds; None if none can be named.

    Only what must stand in a match counts: literal runs of the top level and of groups that occur at least once. Alternatives, classes and
    optional parts end a run. A pattern beyond Python's syntax, which may mean something else in Java's, names none."""
    if re.search(r"\\[^.\\/()\[\]{}*+?|^$\-\s\"'#&,:;<=>@_`~!%dDwWsSbBnt]|\(\?(?![:=!])|[*+?}][+]|\[[^\]]*(\[|&&)|\\Q", pattern):
        return None
    try:
        tree = re._parser.parse(pattern)  # type: ignore[attr-defined]
    except (re.error, OverflowError, RecursionError):
        return None
    runs: list[str] = [""]

    def walk(items) -> None:
        for op, arg in items:
            name = str(op)
            if name == "LITERAL" and arg != 10:
                runs[-1] += chr(arg).translate(str.maketrans(_UPPER, _LOWER))
            elif name == "SUBPATTERN":
                walk(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                walk(arg[2])
                if arg[1] != 1:
                    runs.append("")
                    if arg[0] == arg[1]:
                        walk(arg[2])
                        runs.append("")
            elif name != "AT":
                runs.append("")
            elif name == "AT":  # a place takes no character: a run goes on over it
                pass

    walk(tree)
    grams = sorted({run[i : i + 3] for run in runs for i in range(len(run) - 2)})
    return grams or None


def candidates(spark: SparkSession, root: str, grams: list[str], key: str = "doc_id") -> DataFrame:
    """(key) of the texts that hold all the trigrams."""
    table = B.Bucketed(spark, f"{root}/grams")
    return table.where_key(*grams).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(set(grams))).select(key)


def _texts(spark: SparkSession, root: str, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the texts with these keys; only their buckets are read."""
    table, ids = B.Bucketed(spark, f"{root}/texts"), stored(ids)
    hit = [r.b for r in ids.select(B.bucket_of([key], table.buckets).alias("b")).distinct().collect()]  # at most one row a bucket
    return table.read(hit).drop("bucket").join(ids, key, "left_semi")


def candidate_texts(spark: SparkSession, root: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """The rows that ``grep`` has to look at for a pattern: all of them if no trigram must be in a match."""
    grams = needed(pattern)
    return B.Bucketed(spark, f"{root}/texts").read().drop("bucket") if grams is None else _texts(spark, root, candidates(spark, root, grams, key), key)


def indexed_grep(spark: SparkSession, root: str, pattern: str, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``grep`` over the indexed texts, with its options."""
    return grep(candidate_texts(spark, root, pattern, key), pattern, key=key, **options)


def indexed_fuzzy_grep(spark: SparkSession, root: str, words: str, keywords: list[str], threshold: float = 0.7, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``fuzzy_grep``: a text index under ``words`` (by the same keys) names the texts that hold a like word."""
    ids = text_index.fuzzy_documents(spark, words, keywords, threshold).withColumnRenamed("id", key)
    return fuzzy_grep(_texts(spark, root, ids, key), keywords, threshold, key=key, **options)
