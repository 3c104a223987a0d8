"""A stored inverted index: postings in buckets of terms, a vocabulary for fuzzy words, a document table for upkeep.

A search reads the buckets of its terms. A change of documents rewrites the buckets of the terms that their old and new texts hold; the rest
of the index keeps its files. Postings of one term may be many: they are dealt by size, not to one task."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import edit_similarity
from tessera.operators.ranking import top_k
from tessera.operators.search import bm25, words_of
from tessera.plans.stored import stored
from tessera.sources import buckets as B


def build(docs: DataFrame, root: str, key: str = "id", text: str = "text", buckets: int = 64) -> None:
    """Write the index of docs under root: ``postings`` (term, id, tf, length) by term, ``terms`` (size, term, df) by the term's length and
    ``docs`` (id, length, terms, tfs) by id. Ids must be unique; a null text has no length and no postings.

    A text's words are counted where it is read; it is the counts in ``docs`` that the other two tables are made of, each by one shuffle.
    What is shuffled is one row for a document, or for its terms of one bucket, with the terms in one string."""
    held = B.create(_packed(_held(docs.select(F.col(key).alias("id"), F.col(text).alias("text")))), f"{root}/docs", ["id"], buckets, unpack=_unpacked).read()
    B.create(_dealt(held, buckets), f"{root}/postings", ["term"], buckets, ["term", "id"], _postings)
    B.create(_vocabulary(held), f"{root}/terms", ["size"], buckets, ["size", "term"])


def _vocabulary(held: DataFrame) -> DataFrame:
    seen = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return seen.select(F.length("term").alias("size"), "term", "df")


def _held(rows: DataFrame) -> DataFrame:
    """(id, length, terms, tfs): what the index holds of a document, which is what must go when it changes. Words are in order, tfs say how
    often each stands there."""

    # sorted words, and where their runs end, are each the one element of an array, so that they are computed once a text
    def runs(s: Column) -> Column:
        ends = F.filter(F.transform(s, lambda x, i: F.when(~F.get(s, i + 1).eqNullSafe(x), i + 1)), lambda e: e.isNotNull())
        return F.get(F.transform(F.array(ends), lambda e: counts(s, e)), 0)

    def counts(s: Column, ends: Column) -> Column:
        tfs = F.transform(ends, lambda e, j: e - F.coalesce(F.get(ends, j - 1), F.lit(0)))
        return F.struct(F.size(s).alias("length"), F.transform(ends, lambda e: F.get(s, e - 1)).alias("terms"), tfs.alias("tfs"))

    got = rows.select("id", F.explode(F.transform(F.array(F.sort_array(words_of("text"))), runs)).alias("h"))
    none = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as array<{kind}>)"))
    return got.select("id", "h.length", none(F.col("h.terms"), "string").alias("terms"), none(F.col("h.tfs"), "int").alias("tfs"))


def _packed(held: DataFrame) -> DataFrame:
    """Rows of ``docs`` with their terms, which hold no space, in one string: a fraction of an array's size."""
    return held.select("id", "length", F.concat_ws(" ", "terms").alias("words"), "tfs")


def _terms(words: Column) -> Column:
    return F.when(words == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(words, " "))


def _unpacked(packed: DataFrame) -> DataFrame:
    return packed.select("id", "length", _terms(F.col("words")).alias("terms"), "tfs", "bucket")


def _dealt(held: DataFrame, buckets: int) -> DataFrame:
    """(bucket, id, length, words, tfs): what the index holds of documents, a row for a document's terms of one bucket."""
    return B.by_bucket(held, ["id", "length"], F.col("terms"), " ", buckets, "tfs").withColumnRenamed("packed", "words")


def _postings(dealt: DataFrame) -> DataFrame:
    """(term, id, tf, length, bucket) of dealt rows."""
    each = dealt.select("id", "length", "bucket", F.explode(F.arrays_zip(_terms(F.col("words")).alias("terms"), "tfs")).alias("p"))
    return each.select(F.col("p.terms").alias("term"), "id", F.col("p.tfs").cast("long").alias("tf"), "length", "bucket")


def update(spark: SparkSession, root: str, changed: DataFrame, removed: DataFrame | None = None, key: str = "id", text: str = "text", batch: int | None = None) -> None:
    """Bring the index up to date with changed (and new) documents and removed ids: what ``docs`` holds of them is put in place of what it
    held, the terms' counts move by the difference, and the buckets of all terms that they had or have get their postings from ``docs``.

    Which terms a document had is read from the index itself. A batch number makes a repeated call count once; where a failure left only
    some of the three tables merged, the same call with the same number completes the others, as each knows its own last batch."""
    new = stored(_packed(_held(changed.select(F.col(key).alias("id"), F.col(text).alias("text")))))
    ids = new.select("id") if removed is None else new.select("id").unionByName(removed.select(F.col(key).alias("id")))
    ids = stored(ids.distinct())
    table = B.Bucketed(spark, f"{root}/docs")
    hit = [r.b for r in ids.select(B.bucket_of(["id"], table.buckets).alias("b")).distinct().collect()]
    before = _as_of(spark, f"{root}/docs", batch)
    gone = _packed(before.read(hit)).select("id", "words").join(ids, "id", "left_semi")
    each = lambda rows, by: rows.select(F.explode(_terms(F.col("words"))).alias("term"), F.lit(by).alias("by"))
    # a term that as many documents lost as gained has other postings all the same
    touched = stored(each(gone, -1).unionByName(each(new, 1)).groupBy("term").agg(F.sum("by").alias("by")))
    counts = touched.where("by <> 0").select(F.length("term").alias("size"), "term", "by")

    def terms_after(have: DataFrame, change: DataFrame) -> DataFrame:
        both = have.join(change, ["size", "term"], "full").select("size", "term", (F.coalesce("df", F.lit(0)) + F.coalesce("by", F.lit(0))).alias("df"))
        return both.where("df > 0")

    def docs_after(have: DataFrame, change: DataFrame) -> DataFrame:
        return _packed(have).join(change, "id", "left_anti").unionByName(new)

    now = B.merge(spark, f"{root}/docs", ids, docs_after, batch, unpack=_unpacked)
    buckets = B.Bucketed(spark, f"{root}/postings").buckets
    B.merge(spark, f"{root}/postings", touched, lambda have, change: _dealt(now.read(), buckets), batch, ["term", "id"], _postings)
    B.merge(spark, f"{root}/terms", counts, terms_after, batch, ["size", "term"])


def _as_of(spark: SparkSession, root: str, batch: int | None) -> B.Bucketed:
    """The table as it was before this batch, also if the batch was merged into it already."""
    now = B.Bucketed(spark, root)
    return B.Bucketed(spark, root, now.version - 1) if batch is not None and now.batch == batch and now.version else now


def like_terms(spark: SparkSession, root: str, near: Column, sizes: tuple[int, int]) -> DataFrame:
    """Terms (term, df) of the vocabulary for which near holds, of the stated lengths: only the buckets of these are read."""
    table = B.Bucketed(spark, f"{root}/terms")
    return table.where_key(*range(max(1, sizes[0]), sizes[1] + 1)).where(near).select("term", "df")


def search(spark: SparkSession, root: str, query: str, k: int, edits: int = 0, least: float | None = None) -> DataFrame:
    """(id, score): BM25 for the distinct words of a query, each within an edit distance, as ``fulltext_search`` gives it without an index.

    Exact words: their buckets alone are read. Fuzzy words: the vocabulary's terms of like length give the terms, and the postings of their
    buckets are joined with these."""
    table = B.Bucketed(spark, f"{root}/postings")
    words = sorted({w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()})
    if not words:
        return table.read([]).select("id", F.lit(0.0).alias("score"))
    if edits:
        found = [like_terms(spark, root, F.levenshtein("term", F.lit(w), edits) >= 0, (len(w) - edits, len(w) + edits)) for w in words]
        terms = stored(reduce(DataFrame.unionByName, found).select("term").distinct())
        hit = table.read([r.b for r in terms.select(B.bucket_of(["term"], table.buckets).alias("b")).distinct().collect()]).join(terms, "term", "left_semi")
    else:
        hit = table.where_key(*words)
    return top_k(bm25(hit, B.Bucketed(spark, f"{root}/docs").read()), k, least=least)


def fuzzy_documents(spark: SparkSession, root: str, keywords: list[str], threshold: float = 0.7) -> DataFrame:
    """(id) of the documents that hold a word of at least 3 characters like a keyword: those whose lines ``fuzzy_grep`` has to look at."""
    found = []
    for k in keywords:
        sizes = (max(3, math.ceil(threshold * len(k) - 1e-9)), math.floor(len(k) / threshold + 1e-9))
        found.append(like_terms(spark, root, edit_similarity(F.col("term"), F.lit(k)) >= threshold, sizes))
    terms = stored(reduce(DataFrame.unionByName, found).select("term").distinct())
    table = B.Bucketed(spark, f"{root}/postings")
    hit = table.read([r.b for r in terms.select(B.bucket_of(["term"], table.buckets).alias("b")).distinct().collect()])
    return hit.join(terms, "term", "left_semi").select("id").distinct()
