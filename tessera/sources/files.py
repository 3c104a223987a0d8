"""Sources: files, JSON sections, web pages, directory trees; and snapshot sinks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import headings, hrefs, normalise_url, page_title, plain_text, url_host, url_path
from tessera.operators.predicates import glob_regex
from tessera.plans.stored import stored


def discover(paths: DataFrame, include: list[str], exclude: list[str] = (), path: str = "path") -> DataFrame:
    """Paths that match an include glob and no exclude glob."""
    any_of = lambda globs: reduce(lambda a, b: a | b, (F.col(path).rlike(glob_regex(g, path=True)) for g in globs), F.lit(False))
    return paths.where(any_of(include) & ~any_of(exclude))


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content) of text files under a root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return raw.select("path", F.col("content").cast("string").alias("content"))


def json_sections(df: DataFrame, col: str, keys: list[str], depth: int = 10) -> DataFrame:
    """(keys, path, key, depth, parent, type, value) of a JSON text, one row a value, down to a depth.

    One pass: at each level a container of the level before gives itself and its members, so a text is read and parsed once."""
    top = df.select(*keys, F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("depth"), F.lit("").alias("parent"), F.lit("OBJECT").alias("type"), F.try_parse_json(col).alias("value"))
    rows, old = top, ["path", "key", "depth", "parent", "type", "value"]
    for d in range(1, depth + 1):
        opened = (F.col("depth") == d - 1) & F.col("type").isin("OBJECT", "ARRAY")
        both = rows.select(*keys, *old, F.explode(F.when(opened, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("_in")) if d > 1 else rows.withColumn("_in", F.lit(True))
        parts = both.withColumnsRenamed({c: f"_{c}" for c in old}).lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.when(F.col("_in"), F.col("_value")).outer()))
        parts = parts.where("not _in or pos is not null")
        name = F.coalesce("key", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        new = {
            "path": F.when(F.coalesce("_path", F.lit("")) == "", name).otherwise(F.concat_ws(".", "_path", name)), "key": name, "depth": F.lit(d), "parent": F.coalesce("_path", F.lit("")),
            "type": F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0), "value": F.col("value"),
        }
        rows = parts.select(*keys, *(F.when(F.col("_in"), new[c]).otherwise(F.col(f"_{c}")).alias(c) for c in old))
    return rows.withColumn("value", F.col("value").cast("string"))


def pages(df: DataFrame) -> DataFrame:
    """(page_id, url, host, title, description, n_headings, n_links) of pages (page_id, url, html)."""
    return df.select("page_id", normalise_url(F.col("url")).alias("url"), url_host(F.col("url")).alias("host"), page_title(F.col("html")).alias("title"), F.substring(plain_text(F.col("html")), 1, 200).alias("description"), F.size(headings(F.col("html"))).alias("n_headings"), F.size(hrefs(F.col("html"))).alias("n_links"))


def absolute(link: Column, url: Column) -> Column:
    """A link seen on a page as a normalised URL."""
    site = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+", 0)
    return normalise_url(F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("/"), F.concat(site, link)).otherwise(F.concat(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "[^/]*$", ""), link)))


def page_links(df: DataFrame, inside: bool = True) -> DataFrame:
    """Distinct (src, dst) URLs of links; inside keeps those to another page of the table."""
    p = df.select(normalise_url(F.col("url")).alias("src"), F.explode(hrefs(F.col("html"))).alias("h"), "url")
    links = p.select("src", absolute(F.col("h"), F.col("url")).alias("dst")).distinct()
    return links.join(df.select(normalise_url(F.col("url")).alias("dst")), "dst", "left_semi").where("src <> dst").select("src", "dst") if inside else links


def sites(df: DataFrame) -> DataFrame:
    """(site, n_pages, first_url): hosts of pages (page_id, url, html), each with its number of distinct URLs and the first of them. URLs
    without a host belong to no site."""
    p = df.select(url_host(F.col("url")).alias("site"), normalise_url(F.col("url")).alias("url")).where("site <> ''").distinct()
    return p.groupBy("site").agg(F.count("*").alias("n_pages"), F.min("url").alias("first_url"))


def page_graph(df: DataFrame) -> DataFrame:
    """(src, dst, type), each once: a site has its pages, and a page links to other pages of the table."""
    has = df.select(url_host(F.col("url")).alias("src"), normalise_url(F.col("url")).alias("dst"), F.lit("HAS_PAGE").alias("type")).where("src <> ''").distinct()
    return has.unionByName(page_links(df).withColumn("type", F.lit("LINKS_TO")))


def crawl(links: DataFrame, start: str, depth: int, limit: int, include: str | None = None, exclude: str | None = None, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(url, depth) reached from a start URL over a link table (src, dst), breadth first; excludes win. ``limit`` is the page cap.

    Beyond two levels each one is stored (or kept by ``cut``), and an empty level ends the walk."""
    cut = cut or (stored if depth > 2 else None)
    ok = links
    if include:
        ok = ok.where(F.col("dst").rlike(include))
    if exclude:
        ok = ok.where(~F.col("dst").rlike(exclude))
    seen = links.sparkSession.createDataFrame([(start, 0)], "url string, depth int")
    front = seen.select("url")
    for d in range(1, depth + 1):
        front = front.join(ok, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti")
        front = cut(front) if cut else front
        if cut and front.isEmpty():
            break
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
    return seen.orderBy("depth", "url").limit(limit)


def directory_edges(paths: DataFrame, path: str = "path") -> DataFrame:
    """(child, parent, type): file to directory and directory to parent, each once."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, i + 1), "/").alias("child"), F.array_join(F.slice(parts, 1, i), "/").alias("parent"), F.when(i == F.size(parts) - 1, "IN_DIRECTORY").otherwise("PARENT_OF").alias("type")))
    return paths.where(F.size(parts) > 1).select(F.explode(ups).alias("e")).select("e.*").distinct()


def reassign(rows: DataFrame, projects: DataFrame, path: str = "path") -> DataFrame:
    """Rows with the project whose path is the longest prefix of theirs; the tails of a path are exploded, so it is an equi-join."""
    parts = F.split(path, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hit = rows.select(path, F.explode(tails).alias("prefix")).distinct().join(projects.select(F.col("path").alias("prefix"), F.col("project_id").alias("_p")), "prefix")
    best = hit.groupBy(path).agg(F.max_by("_p", F.length("prefix")).alias("_p"))
    return rows.join(best, path, "left").withColumn("project_id", F.coalesce("_p", "project_id")).drop("_p")


def write_snapshot(df: DataFrame, path: str, *by: str) -> None:
    """A new Parquet snapshot; the caller switches to it when it is complete."""
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)


__all__ = ["absolute", "crawl", "directory_edges", "discover", "json_sections", "page_graph", "page_links", "pages", "read_files", "reassign", "sites", "url_path", "write_snapshot"]
