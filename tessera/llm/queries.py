"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, html_extraction, license_scan, lm_scoring, ngram_join, prefix_trie, quality_rules, sentencepiece_codec, sharding, substring_dedup, token_counts, toxicity, whitening
from tessera.llm.batches import fold_of
from tessera.llm.sql import ORACLE_SQL  # noqa: F401


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_score(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trusted = labels.where("quality = 1").select("doc_id")
    out = quality_rules.quality(docs, quality_rules.ratios(docs, quality_rules.texts_of(docs, trusted)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("trusted")).alias("kept"), "llr")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("piece_bpe_32k.model")
    encoded = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), path)
    decoded = sentencepiece_codec.decode(encoded, path)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), (F.crc32(F.col("decoded").cast("binary")) == F.col("text_crc32")).alias("round_trip"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = fold_of("doc_id", 3)
    model = toxicity.train(docs, labels.where(fold != 1))
    return toxicity.score(docs, model).select("doc_id", (fold == 1).alias("held_out"), "score", "predicted", "n_sentences", F.size("offending").alias("n_offending"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), window=50)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(table(spark, sf_dir, "pages"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_quality_rules, op3_license_scan, op4_sentencepiece, op5_ngram_join, op6_toxicity, op7_substring_dedup, op8_token_counts, op9_decontamination, op10_sharding, op11_html_extraction,
        op12_whitening, op13_prefix_trie, pipeline,
    )
}
