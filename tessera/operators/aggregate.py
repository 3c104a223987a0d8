"""Grouped statistics over filtered tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import chunk_count, extension, file_kind

_AGGS = {"COUNT": F.count, "AVG": F.avg, "SUM": F.sum, "MIN": F.min, "MAX": F.max}


def aggregate(df: DataFrame, op: str, field: str | None = None, by: str | None = None, limit: int = 100) -> DataFrame:
    """COUNT, AVG, SUM, MIN or MAX as ``value``; with ``by`` one row a group, largest first. A null group is a group."""
    if field is None and op != "COUNT":
        raise ValueError(f"{op} needs a field")
    value = (F.count("*") if field is None else _AGGS[op](field)).alias("value")
    return df.agg(value) if by is None else df.groupBy(by).agg(value).orderBy(F.desc("value"), by).limit(limit)


def change_statistics(changes: DataFrame, kind: str = "change_type", entity: str = "entity_type", added: str = "lines_added", removed: str = "lines_removed") -> DataFrame:
    """(dimension, name, n, added, removed): by change type, by entity type, and in total, from one scan."""
    g = changes.groupingSets([[F.col(kind)], [F.col(entity)], []], F.col(kind), F.col(entity)).agg(F.count("*").alias("n"), F.sum(added).alias("added"), F.sum(removed).alias("removed"), F.grouping_id().alias("g"))
    return g.select(F.when(F.col("g") == 1, "change_type").when(F.col("g") == 2, "entity_type").otherwise("total").alias("dimension"), F.coalesce(kind, entity).alias("name"), "n", "added", "removed")


def most_modified(changes: DataFrame, key: str, ts: str, meta: str, n: int, tie: str) -> DataFrame:
    """The n keys with most changes, with the metadata of the latest one."""
    return changes.groupBy(key).agg(F.count("*").alias("n"), F.max_by(meta, F.struct(ts, tie)).alias("latest")).orderBy(F.desc("n"), key).limit(n)


def state_counts(df: DataFrame, states: list[str], state: str = "state") -> DataFrame:
    """Rows in each of the given states, 0 where there is none."""
    all_states = df.sparkSession.createDataFrame([(s,) for s in states], "state string")
    counts = df.groupBy(F.col(state).alias("state")).agg(F.count("*").alias("n"))
    return all_states.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def state_statistics(df: DataFrame, error: Column, error_type: Column, retries: Column, pending: Column, ts: Column) -> DataFrame:
    """Errors, error types, average retries of rows with retries, oldest pending time."""
    return df.agg(F.count_if(error).alias("errors"), F.count_distinct(F.when(error, error_type)).alias("error_types"), F.avg(F.when(retries > 0, retries)).alias("avg_retries"), F.min(F.when(pending, ts)).alias("oldest_pending"))


def progress(df: DataFrame, done: Column) -> DataFrame:
    """processed, total, percent (100 when there are no rows)."""
    return df.agg(F.count_if(done).alias("processed"), F.count("*").alias("total")).withColumn("percent", F.when(F.col("total") == 0, 100.0).otherwise(F.round(100 * F.col("processed") / F.col("total"))))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("node"))
    return n.unionByName(edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge")))


def histogram(df: DataFrame, *keys: str, limit: int | None = None) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), *keys).limit(limit) if limit else out


def usage(all_items: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """How often each item is used; unused items count 0."""
    return all_items.select(key).distinct().join(uses.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def coverage(df: DataFrame, has: Column) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(has).alias("covered")).withColumn("missing", F.col("total") - F.col("covered"))


def duplicates(df: DataFrame, key: str, name: str) -> DataFrame:
    """Keys of more than one row, with the number of rows and the smallest and largest name; no list grows with a group."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(name).alias("first"), F.max(name).alias("last")).where("n > 1")


def orphans(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    return nodes.join(edges.select(key), key, "left_anti")


def best_per_parent(children: DataFrame, parent: str, score: str, n: int) -> DataFrame:
    return children.groupBy(parent).agg(F.max(score).alias("score")).orderBy(F.desc("score"), parent).limit(n)


def kind_profile(paths: DataFrame, root: str = "root", path: str = "path", threshold: float = 0.7) -> DataFrame:
    """For each root: files of each kind, ratios of code and documents, and the kind that dominates (mixed if none does)."""
    p = paths.where(extension(F.col(path)) != "").withColumn("kind", file_kind(F.col(path)))
    out = p.groupBy(root).agg(F.count("*").alias("total"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("code", "document", "data")))
    code, doc = F.col("code") / F.col("total"), F.col("document") / F.col("total")
    out = out.withColumns({"other": F.col("total") - F.col("code") - F.col("document") - F.col("data"), "code_ratio": code, "document_ratio": doc})
    top = F.greatest("code_ratio", "document_ratio")
    return out.withColumn("dominant", F.when(top < threshold, F.when(top < 0.5, "mixed").when(code >= doc, "code").otherwise("document")).when(code >= doc, "code").otherwise("document"))


def section_chunks(sections: DataFrame, documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n): chunks of the documents of each section; a section without any has 0."""
    n = documents.groupBy(key).agg(F.sum(chunk_count(F.col(text))).alias("n"))
    return sections.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def vector_backlog(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(linked, dirty, needed): files (state) that wait for vectors, nodes (dirty) whose vectors are old, and whether there is any."""
    counts = files.select(F.lit("linked").alias("what"), (F.col("state") == "linked").alias("is")).unionByName(nodes.select(F.lit("dirty").alias("what"), F.col("dirty").alias("is")))
    out = counts.agg(*(F.count_if((F.col("what") == w) & F.col("is")).alias(w) for w in ("linked", "dirty")))
    return out.withColumn("needed", (F.col("linked") > 0) | (F.col("dirty") > 0))


def vector_progress(files: DataFrame) -> DataFrame:
    """(total, embedded, linked, embedding, error, percent) of files (state): rows with a state, some states, and the embedded share rounded,
    100 without any row."""
    out = files.agg(F.count("state").alias("total"), *(F.count_if(F.col("state") == s).alias(s) for s in ("embedded", "linked", "embedding", "error")))
    return out.withColumn("percent", F.when(F.col("total") == 0, 100.0).otherwise(F.round(100 * F.col("embedded") / F.col("total"))))
