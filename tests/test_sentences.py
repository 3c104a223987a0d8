"""Sentences and the chunks that are packed from them keep every character but the spaces around a part."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T

#: Parts that begin or end with the digit of their own place, which must stay, and one with spaces around it, which go.
PARTS = ["A" * 90 + ".", "1 " + "B" * 99 + " 1", "2" + "C" * 99 + "22", "  D" + "d" * 99 + "3  ", "4" + "E" * 99 + "44"]


def test_sentences_keep_digits(spark):
    got = spark.createDataFrame([("\n".join(PARTS),)], "t string").select(T.sentences(F.col("t")).alias("s")).first().s
    assert got == [p.strip(" ") for p in PARTS]


def chunks_of(spark, text: str, strategy: str) -> list[str]:
    return [c.text for c in spark.createDataFrame([(text,)], "t string").select(T.chunks(F.col("t"), size=400, overlap=0, least=1, strategy=strategy).alias("c")).first().c]


def test_sentence_chunks_keep_digits(spark):
    assert " ".join(chunks_of(spark, "\n".join(PARTS), "sentence")) == " ".join(p.strip(" ") for p in PARTS)


def test_paragraph_chunks_keep_digits(spark):
    # a paragraph of over one and a half times the size is cut into sentences first
    long = "\n".join([*PARTS, *PARTS])
    got = chunks_of(spark, "Short 2.\n\n" + long, "paragraph")
    assert "".join("".join(got).split()) == "".join(("Short 2." + long).split())
