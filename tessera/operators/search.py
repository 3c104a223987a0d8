"""Vector, full-text and hybrid search, and score adjustments."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.parts import map_parts
from tessera.functions.text import edit_similarity
from tessera.functions.vectors import cosine, vector
from tessera.operators.predicates import glob_regex
from tessera.operators.ranking import page, ranks, top_k
from tessera.operators.similar import similar


def vector_search(vectors: DataFrame, query: Sequence[float] | Column, k: int, least: float = -1.0, where: Column | None = None, key: str = "id", field: str = "embedding") -> DataFrame:
    """(id, score) of the k nearest rows by cosine; filters hold before ranking, so none is lost to them."""
    rows = vectors.where(where) if where is not None else vectors
    q = query if isinstance(query, Column) else vector(query)
    scored = rows.where(F.col(field).isNotNull()).select(F.col(key).alias("id"), cosine(F.col(field), q).alias("score"))
    return top_k(scored, k, least=least)


def merge_max(hits: list[DataFrame]) -> DataFrame:
    """Several result lists (id, score) as one, with each id's largest score."""
    return reduce(DataFrame.unionByName, hits).groupBy("id").agg(F.max("score").alias("score"))


def multi_search(vectors: DataFrame, query: Sequence[float], fields: list[str], k: int, least: float = -1.0) -> DataFrame:
    """Best score over the named vectors of an id, for vectors (id, field, embedding), in one pass."""
    q = vector(query)
    best = vectors.where(F.col("field").isin(*fields)).groupBy("id").agg(F.max(cosine(F.col("embedding"), q)).alias("score"))
    return top_k(best, k, least=least)


def refine(previous: DataFrame, vectors: DataFrame, query: Sequence[float], k: int, weights: tuple[float, float] = (0.3, 0.7)) -> DataFrame:
    """A second search among the hits of the first; scores are weighted, hits without a vector drop."""
    found = previous.join(vectors.select(F.col("id"), "embedding"), "id").select("id", (weights[0] * F.col("score") + weights[1] * cosine(F.col("embedding"), vector(query))).alias("score"))
    return top_k(found, k)


def merge_filtered(rows: DataFrame, hits: DataFrame, keep: float = 0.3) -> DataFrame:
    """Rows (id, score) with the score of their hit, or ``keep`` times their own."""
    h = hits.select("id", F.col("score").alias("hit"))
    return rows.join(h, "id", "left").select("id", F.coalesce("hit", F.col("score") * keep).alias("score"))


def words_of(text: str | Column) -> Column:
    """Words of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(term, id, tf, length): words of letters and digits in lower case. Written once, it serves any number of searches."""
    words = docs.select(F.col(key).alias("id"), words_of(text).alias("w"))
    return words.select("id", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def fulltext_search(index: DataFrame, docs: DataFrame, query: str, k: int, edits: int = 0, least: float | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): BM25 over postings for the distinct words of the query, each within an edit distance.

    Only postings of matching terms are read; lengths come with them, the mean length from docs (id, length)."""
    terms = sorted({w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()})
    if not terms:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    near = reduce(lambda x, y: x | y, (F.levenshtein("term", F.lit(t), edits) >= 0 for t in terms)) if edits else F.col("term").isin(*terms)
    return top_k(bm25(index.where(near), docs, k1, b), k, least=least)


def bm25(hit: DataFrame, docs: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of postings (term, id, tf, length) of the terms of a query, among docs (length)."""
    stats = docs.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    j = hit.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return j.groupBy("id").agg(F.sum(part).alias("score"))


def text_search(docs: DataFrame, query: str, k: int, least: float | None = None, key: str = "id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): fulltext_search without an index, for the exact words of a query. Each text is read once and gives its length and
    its count of each query word; statistics and scores come from one shuffle of these few numbers."""
    terms = sorted({w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()})
    if not terms:
        return docs.select(F.col(key).alias("id"), F.lit(0.0).alias("score")).limit(0)
    low, letter = F.lower(text), r"[\p{L}\p{N}]"
    # the word's own letters come first, so that the look around is made only where they stand
    tf = [F.regexp_count(low, F.lit(f"{re.escape(t)}(?<!{letter}{re.escape(t)})(?!{letter})")) for t in terms]
    counted = docs.select(F.col(key).alias("id"), F.regexp_count(low, F.lit(letter + "+")).alias("length"), F.array(*tf).alias("tf")).repartition("id")
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))))
    j = counted.crossJoin(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        n, df, f = F.col("n"), F.col(f"df{i}"), F.col("tf")[i]
        return F.log(1 + (n - df + 0.5) / (df + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("length") / F.col("mean")))

    score = reduce(lambda x, y: x + y, (F.when(F.col("tf")[i] > 0, part(i)).otherwise(0.0) for i in range(len(terms))))
    return top_k(j.select("id", score.alias("score")).where("score > 0"), k, least=least)


def lengths(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.size(words_of(text)).alias("length"))


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, limit: int | None, boost: float = 0.3, extra: int = 5, extra_top: float = 0.4, extra_step: float = 0.05, least: float | None = None) -> DataFrame:
    """Vector hits boosted by 1 + boost / sqrt(full-text rank); the first ``extra`` text-only hits follow at 0.4, 0.35, ...

    A minimum score cuts at the end, appended hits too. Without a limit all hits are returned, in no order."""
    # ranks matter for hits of both kinds and the first others: at most all of vector_hits and as many more as are appended
    place = ranks(text_hits.select("id", "score")).select("id", "rank")
    both = vector_hits.join(place, "id", "left").select("id", (F.col("score") * F.when(F.col("rank").isNull(), 1.0).otherwise(1 + boost / F.sqrt("rank"))).alias("score"))
    only = place.join(vector_hits.select("id"), "id", "left_anti").orderBy("rank").limit(extra).withColumn("i", F.row_number().over(Window.orderBy("rank")))  # so many rows
    every = both.unionByName(only.select("id", (extra_top - extra_step * (F.col("i") - 1)).alias("score")))
    if limit is None:
        return every if least is None else every.where(F.col("score") >= least)
    return top_k(every, limit, least=least)


def keyword_boost(hits: DataFrame, fields: list[str], keywords: list[str], weight: float = 0.15, least: float = 0.6) -> DataFrame:
    """Hits whose named fields hold a keyword (1.0) or a word like it gain similarity * weight when that is at least ``least``."""
    words = F.array_distinct(F.flatten(F.array(*(F.filter(F.split(F.lower(F.coalesce(f, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2) for f in fields))))
    whole = reduce(lambda a, b: a | b, (F.lower(F.coalesce(f, F.lit(""))).contains(k.lower()) for f in fields for k in keywords))
    best = F.array_max(F.transform(words, lambda w: F.greatest(*(edit_similarity(w, F.lit(k)) for k in keywords)) if len(keywords) > 1 else edit_similarity(w, F.lit(keywords[0]))))
    sim = F.when(whole, 1.0).otherwise(F.coalesce(best, F.lit(0.0)))
    return hits.withColumn("similarity", sim).withColumn("score", F.col("score") + F.when(F.col("similarity") >= least, F.col("similarity") * weight).otherwise(0.0))


def entity_boost(hits: DataFrame, links: DataFrame, matches: DataFrame, weight: float = 0.05, least: float = 0.7) -> DataFrame:
    """Hits (id, score) gain the best score of the matched entities (entity, match) they are linked to (id, entity) times weight."""
    best = links.join(matches.where(F.col("match") >= least), "entity").groupBy("id").agg(F.max("match").alias("match"))
    return hits.join(best, "id", "left").select("id", (F.col("score") + F.coalesce(F.col("match") * weight, F.lit(0.0))).alias("score"))


def type_boost(hits: DataFrame, factors: dict[str, float], least: float) -> DataFrame:
    """Scores times the factor of their type, at most 1, cut again."""
    factor = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in factors.items() for x in kv)), F.col("type")), F.lit(1.0))
    return hits.withColumn("score", F.least(F.lit(1.0), F.col("score") * factor)).where(F.col("score") >= least)


def snippet(chunk: Column, content: Column) -> Column:
    return F.when(chunk.isNotNull(), F.substring(chunk, 1, 800)).otherwise(F.substring(content, 1, 500))


def merge_scores(results: DataFrame, evaluations: DataFrame, strategy: str = "weighted", weights: tuple[float, float] = (0.3, 0.7)) -> DataFrame:
    """Scores with those of an evaluations table (id, evaluation): weighted, multiplicative, or override (above 0.9, else the mean)."""
    s, e = F.col("score"), F.col("evaluation")
    merged = {"weighted": weights[0] * s + weights[1] * e, "multiplicative": s * e, "override": F.when(e > 0.9, e).otherwise((s + e) / 2)}[strategy]
    return results.join(evaluations, "id").select("id", merged.alias("score"))


def evaluated(hits: DataFrame, rows: DataFrame, fields: list[str], scorer: Callable[[pd.DataFrame], pd.Series], strategy: str = "weighted", weights: tuple[float, float] = (0.3, 0.7), batch: int = 1000) -> DataFrame:
    """Hits (id, score) re-scored by a user's function: it gets frames of id, score and the named fields of rows, of at most ``batch`` hits,
    and gives a score each. A null score leaves the hit its own; the others are merged as ``merge_scores`` does."""
    asked = hits.select("id", "score").join(rows.select("id", *fields), "id")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for lo in range(0, len(p), batch):
                cut = p.iloc[lo : lo + batch].reset_index(drop=True)
                yield pd.DataFrame({"id": cut["id"], "evaluation": pd.Series(scorer(cut)).astype("float64").to_numpy()})

    kind = hits.schema["id"].dataType.simpleString()
    given = map_parts(asked, run, f"id {kind}, evaluation double").where(F.col("evaluation").isNotNull() & ~F.isnan("evaluation"))
    new = merge_scores(hits, given, strategy, weights).withColumnRenamed("score", "_new")
    return hits.join(new, "id", "left").withColumn("score", F.coalesce("_new", "score")).drop("_new")


def search(vector_hits: DataFrame | None, text_hits: DataFrame | None, rows: DataFrame, limit: int, offset: int = 0, where: Column | None = None, glob: str | None = None, path: str = "path", least: float | None = None) -> DataFrame:
    """The front door: hits of one kind, or of both as ``hybrid`` ranks them, with the fields of rows (id, ...). Filters, a glob over the
    path and the minimum score hold before the page is cut; total is how many hits passed them. A page past the end is one row without an id."""
    if vector_hits is not None and text_hits is not None:
        hits = hybrid(vector_hits, text_hits, None)
    else:
        hits = (vector_hits if vector_hits is not None else text_hits).select("id", "score")
    passed = hits.join(rows, "id")
    for test in (where, None if glob is None else F.col(path).rlike(glob_regex(glob, path=True)), None if least is None else F.col("score") >= least):
        passed = passed if test is None else passed.where(test)
    total = passed.agg(F.count("*").alias("total"))
    shown = page(passed, [F.desc("score"), F.col("id")], limit, offset).withColumn("_there", F.lit(1))
    out = total.withColumn("_there", F.lit(1)).join(shown, "_there", "left")  # the one row of the total with the rows of a page
    return out.select(*passed.columns, "total")


def grep(docs: DataFrame, pattern: str, ignore_case: bool = False, key: str = "doc_id", text: str = "text", glob: str | None = None, path: str = "path", context: int = 0, most: int | None = None) -> DataFrame:
    """(key, line, text, match, n_lines): lines that match, trimmed and cut at 200 characters, with the first match. ``glob`` restricts the
    paths, ``context`` adds that many lines before and after as one text, ``most`` caps the rows, by key and line."""
    rx = ("(?i)" if ignore_case else "") + pattern
    docs = docs if glob is None else docs.where(F.col(path).rlike(glob_regex(glob, path=True)))
    if context:
        every = F.split(text, "\n")
        around = F.transform(every, lambda s, i: F.array_join(F.slice(every, F.greatest(i + 1 - context, F.lit(1)), F.least(i, F.lit(context)) + 1 + context), "\n"))
        found = docs.select(key, F.size(every).alias("n_lines"), F.posexplode(F.arrays_zip(every.alias("l"), around.alias("c"))).alias("i", "z")).where(F.col("z.l").rlike(rx))
        out = found.select(key, (F.col("i") + 1).alias("line"), F.substring(F.trim("z.l"), 1, 200).alias("text"), F.regexp_extract("z.l", rx, 0).alias("match"), "n_lines", F.col("z.c").alias("context"))
        return out if most is None else page(out, [F.col(key), F.col("line")], most)
    if most is not None:
        return page(grep(docs, pattern, ignore_case, key, text), [F.col(key), F.col("line")], most)
    lines = docs.select(key, F.size(F.split(text, "\n")).alias("n_lines"), F.posexplode(F.split(text, "\n")).alias("i", "l"))
    return lines.where(F.col("l").rlike(rx)).select(key, (F.col("i") + 1).alias("line"), F.substring(F.trim("l"), 1, 200).alias("text"), F.regexp_extract("l", rx, 0).alias("match"), "n_lines")


def fuzzy_grep(docs: DataFrame, keywords: list[str], threshold: float = 0.7, need_all: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, keyword, similarity) for each line word of at least 3 characters that resembles a keyword, the first such keyword."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("i", "l"))
    # by length alone most words can't reach the threshold, and the others are compared up to the distance that it allows
    near = lambda w, k: F.length(w).between(math.ceil(threshold * len(k) - 1e-9), math.floor(len(k) / threshold + 1e-9)) & (F.levenshtein(w, F.lit(k.lower()), math.floor((1 - threshold) * len(k) / threshold + 1e-9)) >= 0)
    able = lambda w: (F.length(w) >= 3) & reduce(lambda x, y: x | y, (near(w, k) for k in keywords))
    words = lines.select(key, (F.col("i") + 1).alias("line"), F.explode(F.array_distinct(F.filter(F.split(F.lower("l"), r"[^\p{L}\p{N}]+"), able))).alias("word"))
    first = F.coalesce(*(F.when(edit_similarity(F.col("word"), F.lit(k)) >= threshold, F.struct(F.lit(k).alias("keyword"), edit_similarity(F.col("word"), F.lit(k)).alias("similarity"))) for k in keywords))
    out = words.withColumn("m", first).where("m is not null").select(key, "line", "word", "m.*")
    if need_all:
        full = out.groupBy(key).agg(F.count_distinct("keyword").alias("k")).where(F.col("k") == len(set(keywords)))
        out = out.join(full, key, "left_semi")
    return out


def resolve_loose(refs: DataFrame, files: DataFrame, least: float = 0.7) -> DataFrame:
    """(ref, path, score) for loose references: a path suffix 1.0, a unique file name 0.95, an ambiguous one 0.7; else the similarity of a
    like name with the same extension, or 0.9 times that of the names without extensions. The best file wins, then the first path."""
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    ext = lambda c: F.regexp_extract(c, r"(\.[^.]*)$", 1)
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.call_function("substring_index", c, F.lit("/"), -i))
    # a tail or a name that many files share is one row before it meets a reference, with the first of their paths. Both grow with the files,
    # but Spark guesses their size from that of the stored columns: merge joins keep them from being gathered on the driver
    ends = files.select("path", F.explode(F.array_distinct(tails(F.col("path")))).alias("clean")).groupBy("clean").agg(F.min("path").alias("path")).hint("merge")
    names = files.select("path", F.lower(name(F.col("path"))).alias("name")).groupBy("name").agg(F.min("path").alias("path"), F.count("*").alias("n"))
    r = refs.select("ref", F.regexp_replace("ref", r"^\./", "").alias("clean")).withColumn("name", F.lower(name(F.col("clean")))).distinct()
    whole = r.join(ends, "clean").select("ref", "path", F.lit(1.0).alias("score"))
    same = r.join(names.hint("merge"), "name").select("ref", "path", F.when(F.col("n") == 1, 0.95).otherwise(0.7).alias("score"))
    left = r.join(names.hint("merge"), "name", "left_anti").select("ref", ext(F.col("name")).alias("ext"), "name")
    best = F.min_by(F.struct("path", "score"), F.struct((-F.col("score")).alias("s"), "path")).alias("b")

    def like(mine: DataFrame, theirs: DataFrame, least: float, by: list[str], weight: float) -> DataFrame:
        first = theirs.groupBy(*by, F.col("name").alias("b")).agg(F.min("path").alias("path"))
        near = similar(mine, theirs, least, by).join(first.hint("merge"), [*by, "b"]).withColumn("score", weight * F.col("similarity"))
        return mine.join(near.groupBy(*by, F.col("a").alias("name")).agg(best).hint("merge"), [*by, "name"]).select("ref", "b.path", "b.score")

    full = like(left, names.select("path", ext(F.col("name")).alias("ext"), "name"), least, ["ext"], 1.0)
    bare = like(left.select("ref", stem(F.col("name")).alias("name")), names.select("path", stem(F.col("name")).alias("name")), min(1.0, least / 0.9), [], 0.9)
    found = whole.unionByName(same).unionByName(full).unionByName(bare)
    return found.groupBy("ref").agg(best).select("ref", "b.path", "b.score")


def resolve_mentions(mentions: DataFrame, files: DataFrame, least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Mentions (mention, ref, confidence) of files: resolved ones (mention, path, confidence times match score), and those to try again."""
    found = resolve_loose(mentions.select("ref").distinct(), files, least).hint("merge")
    resolved = mentions.join(found, "ref").select("mention", "path", (F.coalesce("confidence", F.lit(0.5)) * F.col("score")).alias("confidence"))
    return resolved, mentions.join(found.select("ref").hint("merge"), "ref", "left_anti")
