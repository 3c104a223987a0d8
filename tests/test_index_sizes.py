"""What stored indexes write, shuffle and hold in memory."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import buckets as B
from tessera.sources import line_index, text_index, vector_index

TEXTS = {1: "Red fox, red den. RED", 2: "", 3: None, 4: "den 12 ünd den\nÜnd", 5: "..."}


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_text_index_counts_words_where_they_are_read(spark, tmp_path, monkeypatch):
    def refused(df):
        raise AssertionError("an intermediate table is written")

    monkeypatch.setattr(text_index, "stored", refused)
    root = f"file://{tmp_path}/words"
    text_index.build(spark.createDataFrame(list(TEXTS.items()), "id long, text string"), root, buckets=4)
    got = {(r.term, r.id): (r.tf, r.length) for r in B.Bucketed(spark, f"{root}/postings").read().collect()}
    assert got == {(w, i): (n, len(words(t))) for i, t in TEXTS.items() for w, n in Counter(words(t)).items()}
    docs = {r.id: (r.length, list(zip(r.terms, r.tfs, strict=True))) for r in B.Bucketed(spark, f"{root}/docs").read().collect()}
    assert docs == {i: (None if t is None else len(words(t)), sorted(Counter(words(t)).items())) for i, t in TEXTS.items()}
    df = {r.term: r.df for r in B.Bucketed(spark, f"{root}/terms").read().collect()}
    assert df == Counter(w for t in TEXTS.values() for w in set(words(t)))


@pytest.fixture
def cells(spark, tmp_path):
    v = np.random.default_rng(3).normal(size=(400, 6)).round(3)
    rows = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, embedding array<float>")
    root = f"file://{tmp_path}/cells"
    vector_index.build_cells(rows, root, 3)
    return root, v.astype(np.float32).astype(float), rows


def test_many_searches_in_tiles(spark, cells, monkeypatch):
    """Tiles of a few queries and rows give what all pairs give, and no scores of more than TOGETHER queries are held at once."""
    root, v, rows = cells
    for name, size in (("SLICE", 50), ("ASKED", 20), ("TOGETHER", 7)):
        monkeypatch.setattr(vector_index, name, size)
    asked = rows.where("id % 4 = 0").selectExpr("id AS query", "embedding AS vector")
    found = vector_index.search_many(spark, root, asked, 5, None)
    assert "ask" in found._jdf.queryExecution().analyzed().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.query, []).append((-round(r.score, 9), r.id))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = unit @ unit.T
    assert got.keys() == set(range(0, 400, 4))
    for q, hits in got.items():
        assert sorted(i for _, i in hits) == sorted(np.lexsort((np.arange(400), -score[q]))[:5].tolist())


def test_a_bucket_gets_one_row_of_a_document(spark):
    """What is shuffled for postings is one row for a document's terms of one bucket, not one for each term."""
    texts = {1: " ".join(f"w{i} w{i % 7}" for i in range(300)), **{i + 1: t for i, t in TEXTS.items()}}
    held = text_index._held(spark.createDataFrame(list(texts.items()), "id long, text string"))
    dealt = text_index._dealt(held, 4)
    rows = dealt.collect()
    assert len({(r.id, r.bucket) for r in rows}) == len(rows) <= 4 * len(texts)
    got = {(r.term, r.id, r.bucket): (r.tf, r.length) for r in text_index._postings(dealt).collect()}
    terms = {w for t in texts.values() for w in words(t)}
    place = {r.w: r.b for r in spark.createDataFrame([(w,) for w in terms], "w string").select("w", B.bucket_of(["w"], 4).alias("b")).collect()}
    assert got == {(w, i, place[w]): (n, len(words(t))) for i, t in texts.items() for w, n in Counter(words(t)).items()}


def test_a_bucket_gets_one_row_of_a_text(spark, tmp_path, monkeypatch):
    """What is shuffled for trigrams is one row for a text's trigrams of one bucket."""
    create, given = B.create, {}

    def watched(df, root, *args):
        given[root.rsplit("/", 1)[1]] = df
        return create(df, root, *args)

    monkeypatch.setattr(B, "create", watched)
    root = f"file://{tmp_path}/lines"
    line_index.build(spark.createDataFrame(list(TEXTS.items()), "id long, text string"), root, "id", buckets=4)
    assert given["grams"].count() <= 4 * len(TEXTS)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lines = [(i, s.translate(low)) for i, t in TEXTS.items() for s in (t or "").split("\n")]
    want = {(s[j : j + 3], i) for i, s in lines for j in range(len(s) - 2)}
    rows = B.Bucketed(spark, f"{root}/grams").read().collect()
    assert {(r.gram, r.id) for r in rows} == want and len(rows) == len(want)


def test_index_trigrams_are_runs_of_whole_characters(spark):
    """Grams of an index are made without an expression's match at each place, which began one within a character beyond 16 bits, too."""
    texts = [(1, "ABcab\nab\r\nab\tABC"), (2, "ÄÜß\U0001f600x\U0001f600 Ünd\n\nZz"), (3, ""), (4, None), (5, "ab"), (6, "aaaa\u2028bbb")]
    made = line_index._trigrams_of_many(F.col("text"))
    assert "regexp" not in str(made)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r.id: sorted(r.g) for r in spark.createDataFrame(texts, "id long, text string").where("text is not null").select("id", made.alias("g")).collect()}
    assert got == {i: sorted({s[j : j + 3] for s in t.translate(low).split("\n") for j in range(len(s) - 2)}) for i, t in texts if t is not None}
