"""A training-data pipeline over documents: each stage reads what the one before it kept.

All stages take tables without rows and give such; rows with a null id stay, but for that the last stage encodes them like others. Rows that
share an id are judged by that id where a stage drops documents, and each by its own text where it changes texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, ngram_join, sentencepiece_codec, substring_dedup, toxicity
from tessera.llm.batches import written
from tessera.llm.queries import table, tokenizer

#: SQL cannot train the classifier of the first stage; tests compare run() with a brute-force version.
ORACLE_SQL = None


def _keep(docs: DataFrame, verdict: DataFrame, keep: str) -> DataFrame:
    """Rows of docs but for those whose id has a verdict against it; rows with a null id stay."""
    gone = verdict.where(f"not ({keep})").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among docs, does not reject. Null and empty texts
    are as toxic as no sentence makes them, which is not enough; without labelled rows nothing is rejected."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _keep(docs, toxicity.score(docs, model), "predicted = 0")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group that links of similarity 0.8 or more on 5-word shingles connect.
    Null and empty texts link with nothing and stay; of rows that share an id all stay or all go."""
    groups = ngram_join.jaccard_components(docs, n=5, percent=80)
    return _keep(docs, groups, "component_id is null or component_id = doc_id")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that a document of smaller id holds; n_chars follows the text.
    Null and empty texts stay as they are."""
    out = substring_dedup.strip(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*(f"`{c}`" for c in docs.columns)) if "n_chars" in docs.columns else out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none, and null or empty items are in no text."""
    return _keep(docs, decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")), "false")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document; a null text has none."""
    encoded = sentencepiece_codec.encode(docs, tokenizer("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_copies), ("substring_dedup", cut_repeats), ("decontamination", drop_leaks), ("sentencepiece", tokenise)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
