"""Entities and tags: matching, merging, naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalise_tag
from tessera.operators.similar import similar


def unresolved(mentions: DataFrame, links: DataFrame, least: float = 0.6) -> DataFrame:
    return mentions.where(F.col("confidence") >= least).join(links.select("mention"), "mention", "left_anti").orderBy("type", "name")


def match(mentions: DataFrame, canonicals: DataFrame, least: float = 0.8) -> DataFrame:
    """(mention, type, name, canonical, similarity): the canonical of the same type with the most similar name; null where none is near
    enough. All names are compared in effect: see ``similar``."""
    close = similar(mentions, canonicals, least, ["type"])
    # names meet, not mentions and canonicals: of a name that many canonicals have the smallest id is taken first
    first = canonicals.groupBy("type", F.col("name").alias("b")).agg(F.min("canonical").alias("canonical"))
    best = F.min_by(F.struct("canonical", "similarity"), F.struct((-F.col("similarity")).alias("s"), "canonical")).alias("_b")
    found = close.join(first.hint("merge"), ["type", "b"]).groupBy("type", F.col("a").alias("name")).agg(best)
    return mentions.join(found.hint("merge"), ["type", "name"], "left").select("mention", "type", "name", "_b.canonical", "_b.similarity")


def name_rank(name: Column, kind: str) -> Column:
    """Sort key of which the smallest names an entity: tags short and hyphenated, persons with more words, organisations longer."""
    words = F.size(F.split(F.trim(name), r"\s+"))
    caps = F.when(name.rlike(r"^\p{Lu}"), 0).otherwise(1)
    shout = F.when(name == F.upper(name), 1).otherwise(0)
    keys = {"tag": (F.when(name == F.lower(name), 0).otherwise(1), F.length(name)), "person": (-words, caps, shout, -F.length(name)), "organisation": (caps, shout, -F.length(name))}.get(kind, (caps, -F.length(name)))
    return F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), name.alias("name"))


def canonicalise(mentions: DataFrame, kind: str = "other") -> DataFrame:
    """One canonical for each (normalised name, type): best name, other names as aliases, documents without duplicates."""
    g = mentions.groupBy(F.lower(F.trim("name")).alias("norm"), "type").agg(F.min_by("name", name_rank(F.col("name"), kind)).alias("name"), F.collect_set("name").alias("names"), F.sort_array(F.collect_set("doc")).alias("docs"))
    return g.withColumn("aliases", F.sort_array(F.array_except("names", F.array("name")))).drop("names")


def merge_duplicates(canonicals: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonicals of one normalised name and type become the one of smallest id; links (mention, canonical) move."""
    norm = F.lower(F.trim("name"))
    least = canonicals.groupBy(norm.alias("_norm"), F.col("type").alias("_type")).agg(F.min("canonical").alias("survivor"))
    mapped = canonicals.join(least, norm.eqNullSafe(F.col("_norm")) & F.col("type").eqNullSafe(F.col("_type")))
    moved = links.join(mapped.select("canonical", "survivor"), "canonical").select("mention", F.col("survivor").alias("canonical")).distinct()
    kept = mapped.groupBy(F.col("survivor").alias("canonical"), "type").agg(F.min_by("name", "canonical").alias("name"), F.count("*").alias("merged"))
    return kept, moved


def merge_tags(tags: DataFrame) -> DataFrame:
    """Tags (tag, usage, projects) of one normalised name: usage adds up, project lists are united."""
    return tags.groupBy(normalise_tag(F.col("tag")).alias("name")).agg(F.sum("usage").alias("usage"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("projects")))).alias("projects"))


def merge_groups(tags: DataFrame, groups: DataFrame) -> DataFrame:
    """Tags folded by a grouping table (tag, group): the most used one names the group, the others are aliases."""
    j = tags.join(groups, "tag", "left").withColumn("g", F.coalesce("group", "tag"))
    return j.groupBy("g").agg(F.min_by("tag", F.struct((-F.col("usage")).alias("u"), "tag")).alias("tag"), F.sum("usage").alias("usage"), F.collect_set("tag").alias("all")).select("tag", "usage", F.sort_array(F.array_except("all", F.array("tag"))).alias("aliases"))


def dedup_mentions(mentions: DataFrame, least: float = 0.6) -> DataFrame:
    """Per document, type and lower-cased name the mention of highest confidence, aliases united."""
    return mentions.where(F.col("confidence") >= least).groupBy("doc", "type", F.lower("name").alias("norm")).agg(F.max_by("name", F.struct("confidence", "name")).alias("name"), F.max("confidence").alias("confidence"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))


def merge_mention(mentions: DataFrame, canonicals: DataFrame, kind: str = "other") -> DataFrame:
    """Canonicals (canonical, name, aliases, docs) with the mentions (canonical, name, aliases, doc) that were matched to them: the best of
    all names, the others as aliases, documents united."""
    part = lambda df, docs: df.select("canonical", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array()))).alias("n"), docs.alias("d"))
    every = part(canonicals, F.col("docs")).unionByName(part(mentions.join(canonicals.select("canonical"), "canonical", "left_semi"), F.array("doc")))
    g = every.groupBy("canonical").agg(F.min_by("n", name_rank(F.col("n"), kind)).alias("name"), F.collect_set("n").alias("all"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("d")))).alias("docs"))
    return g.select("canonical", "name", F.sort_array(F.array_except("all", F.array("name"))).alias("aliases"), "docs")


def entity_text(name: Column, aliases: Column, kind: Column) -> Column:
    """What an entity's vector is made of: its name, aliases and type, a line each."""
    return F.concat_ws("\n", name, F.when(F.size(aliases) > 0, F.concat(F.lit("Aliases: "), F.array_join(aliases, ", "))), F.concat(F.lit("Type: "), kind))


def entity_vectors(entities: DataFrame, stored: DataFrame) -> DataFrame:
    """Entities (id, name, aliases, type) whose text has another hash than the stored one (id, hash), with text and hash."""
    t = entities.withColumn("text", entity_text(F.col("name"), F.col("aliases"), F.col("type"))).withColumn("hash", F.sha2("text", 256))
    return t.join(stored.select("id", F.col("hash").alias("_h")), "id", "left").where(~F.col("hash").eqNullSafe(F.col("_h"))).drop("_h")


def tag_usage(nodes: DataFrame) -> DataFrame:
    """(tag, usage) of nodes (tag), null tags left out: what a tag's usage count is set to."""
    return nodes.where("tag is not null").groupBy("tag").agg(F.count("*").alias("usage"))


def upsert_tags(tags: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tags (tag, name, category, projects, usage) after uses (node, name, category, project), and the links (node, tag).

    A tag is its normalised name. What is stored keeps its name and category, a new one takes the smallest name and the smallest category,
    ``other`` without any; each use counts one; projects grow by those not yet listed, in order. Null names are left out."""
    named = uses.where("name is not null").withColumn("tag", normalise_tag(F.col("name")))
    new = named.groupBy("tag").agg(
        F.min("name").alias("_name"), F.min("category").alias("_category"), F.sort_array(F.collect_set("project")).alias("_projects"), F.count("*").alias("_usage"),
    )
    none = F.expr("cast(array() as array<string>)")
    merged = tags.join(new, "tag", "full").select(
        "tag", F.coalesce("name", "_name").alias("name"),
        F.when(F.col("usage").isNull() & F.col("category").isNull(), F.coalesce("_category", F.lit("other"))).otherwise(F.col("category")).alias("category"),
        F.array_union(F.coalesce("projects", none), F.coalesce("_projects", none)).alias("projects"),
        (F.coalesce("usage", F.lit(0)) + F.coalesce("_usage", F.lit(0))).cast("long").alias("usage"),
    )
    return merged, named.where("node is not null").select("node", "tag").distinct()
