"""The registered queries on a table with all that can be odd: null and repeated ids, null, empty and long texts, copies, more columns."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import quality_rules, queries
from tessera.llm.batches import Words

MORE = ["score", "key", "tag", "_doc", "_text", "words", "first", "item_id", "label", "row", "part", "a.b"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    word = lambda: rng.choice(["sun", "low", "warm", "river", "#7", "stone", "A", "the", "of", "é", "blue", "idiot"])
    say = lambda n: " ".join(word() for _ in range(n))
    passage = " ".join(f"p{i}" for i in range(70))
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(5000)) for _ in range(110_000))
    texts = [None, "", " \n\t ", "one", "two words", long, passage, "MIT License, or GNU General Public License v3", "x" * 5000]
    texts += [say(rng.randrange(1, 140)) + ("\n" + say(3)) * rng.randrange(4) for _ in range(40)]
    texts += [say(10) + " " + passage + " " + say(10) for _ in range(4)] + [long + " end"]
    out = [(i * 3, t) for i, t in enumerate(texts)]
    out += [(200 + i, t) for i, t in enumerate(texts[9:20])]  # exact copies
    out += [(300 + i, t + " more") for i, t in enumerate(texts[9:20])]  # near copies
    return out + [(None, passage), (None, None), (None, "one"), out[12], out[12], (out[13][0], "other text here"), (out[50][0], passage + " " + say(60)), (out[50][0], "short")]


@pytest.fixture(scope="module")
def place(spark, rows, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), rows)


def write(spark, to, rows):
    items = [(1, " ".join(f"q{i}" for i in range(25))), (2, None), (None, "a b c d"), (3, ""), (1, " ".join(f"q{i}" for i in range(25)))]
    labels = [(d, q, x) for d, (q, x) in {d: (int(bool(t) and len(t) > 60), int("idiot" in (t or ""))) for d, t in rows if d is not None}.items()] + [(None, 1, 1), (3, None, None), (9999, 1, 0)]
    data = [(d, t, "en", "src", len(t) if t is not None else None, *MORE) for d, t in rows]
    spark.createDataFrame(data, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{c}` string" for c in MORE)])).repartition(3).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    return str(to)


def got(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_op1(spark, rows, place):
    out = queries.op1_lm_scoring(spark, place).toPandas()
    tokens = [(d, [*brute.WORD.findall(brute.lower(t or "")), None]) for d, t in rows]
    held = lambda d: d is not None and brute.crc(d) % 10 == 0
    count = Counter(x for d, ts in tokens if not held(d) for x in ts)
    n, v = sum(count.values()), len(count)
    want = Counter((d, held(d), len(ts), sum(count[x] > 0 for x in ts), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts), 3)) for d, ts in tokens)
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in out.itertuples()) == want
    assert np.isfinite(out.score).all() and (out.score < 0).all()


def test_op2(spark, rows, place):
    out = queries.op2_quality_rules(spark, place)
    trusted = {d for d, t in rows if d is not None and t and len(t) > 60}
    first = {}
    for d, t in rows:
        first.setdefault(d, int(bool(t) and len(t) > 60))
    trusted = {d for d, t in rows if d is not None}
    last = {d: int(bool(t) and len(t) > 60) for d, t in rows if d is not None}
    trusted = {d for d, q in last.items() if q}

    def buckets(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return quality_rules.ngrams(Words(data, np.array([0, len(data)])))[0].tolist()

    llr = brute.mean_log_ratio([t for _, t in rows], [t for d, t in rows if d in trusted], buckets, quality_rules.BUCKETS)
    want = Counter()
    for (d, t), x in zip(rows, llr, strict=True):
        n, *more, repeat = brute.quality_counts(t)
        failed = n < 50 or 100 * repeat > 50 * n
        want[d, n, *more, repeat, failed, not failed and x >= quality_rules.THRESHOLD, round(x, 4)] += 1
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert Counter((*(r[c] for c in names), round(r.llr, 4)) for r in out.collect()) == want


def test_op3(spark, rows, place):
    assert got(queries.op3_license_scan(spark, place), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == Counter((d, *brute.license_base(t)) for d, t in rows)


def test_op4(spark, rows, place):
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    assert got(queries.op4_sentencepiece(spark, place), "doc_id", "n_tokens", "round_trip") == Counter((d, len(lib.encode(t or "")), True) for d, t in rows)


def test_op5(spark, rows, place):
    assert got(queries.op5_ngram_join(spark, place), "doc_id", "n_shingles", "component_id") == Counter(brute.component_rows(rows, 3, 90))


def test_op6(spark, rows, place):
    out = queries.op6_toxicity(spark, place).collect()
    assert Counter((r.doc_id, r.held_out) for r in out) == Counter((d, d is not None and brute.crc(d) % 3 == 1) for d, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)


def test_op7(spark, rows, place):
    assert got(queries.op7_substring_dedup(spark, place), "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.dedup_rows(rows, 50))


def test_op8(spark, rows, place):
    lib = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    assert got(queries.op8_token_counts(spark, place), "doc_id", "n_bytes", "n_tokens", "over_limit") == Counter((d, len((t or "").encode()), n(t), n(t) > 1024) for d, t in rows)


def test_op9(spark, rows, place, tmp_path):
    items = " ".join(f"q{i}" for i in range(25))
    more = [*rows, (900, "before " + items + " after"), (901, items.replace("q7", "seven")), (None, items)]
    found = queries.op9_decontamination(spark, write(spark, tmp_path, more)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(900, 1), (901, 1), (None, 1)}


def test_op10(spark, rows, place):
    out = queries.op10_sharding(spark, place).toPandas()
    assert Counter(zip(out["size"], out.text_crc32, strict=True)) == Counter((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert out.shard.between(0, 39).all() and out.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all() and (out.law == "bytes").all()


def test_pipeline_run(spark, rows, place, tmp_path):
    """run() against its stages done plainly, on odd rows."""
    import corpus_pipeline

    from tessera.llm import toxicity

    items = " ".join(f"q{i}" for i in range(25))
    more = [*rows, (900, "before " + items + " after"), (None, "x y " + items)]
    to = write(spark, tmp_path, more)
    docs = queries.table(spark, to, "documents")
    bad = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, queries.table(spark, to, "labels"))).where("predicted = 1").collect()} - {None}
    now = [(d, t) for d, t in more if d not in bad]
    now = [x for x, (d, _, c) in zip(now, brute.component_rows(now, 5, 80), strict=True) if d is None or c == d]
    cut = []
    for (d, t), (_, _, gone, _) in zip(now, brute.dedup_rows(now, 50), strict=True):
        cut.append((d, t if not gone else brute.without(now, d, t, 50)))
    leaked = {d for i, (d, _) in enumerate(cut) if any(k == i for k, _ in brute.leaks([(i, cut[i][1])], [(1, items)], 0.6))} - {None}
    cut = [(d, t) for d, t in cut if d not in leaked]
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    assert got(corpus_pipeline.run(spark, to), "doc_id", "n_tokens") == Counter((d, len(lib.encode(t or ""))) for d, t in cut)


def test_pipeline_empty(spark, rows, tmp_path):
    import corpus_pipeline

    to = write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, to).count() == 0
    for name, f in queries.QUERIES.items():
        if name not in ("op11_html_extraction", "op12_whitening", "op13_prefix_trie"):  # of other tables: test_pages_vectors_trie.py
            assert f(spark, to).count() == 0


def test_overlaps_by_priority(spark):
    """Of A, B, C in order the last outranks both and overlaps both; D overlaps C only and E nothing."""
    from tessera.llm import license_scan

    spans = {"A": (0, 6, 50), "B": (2, 8, 50), "C": (5, 12, 90), "D": (11, 14, 60), "E": (13, 16, 40)}
    hits = [(k, p, False, i, [(a + 1, 1), (b - a, b - a)]) for i, (k, (a, b, p)) in enumerate(spans.items())]
    df = spark.createDataFrame([("t", hits)], "key string, hits array<struct<label:string,priority:int,base:boolean,rule:int,parts:array<struct<gap:int,n:int>>>>")
    assert {(r.label, r.start, r.end) for r in license_scan.resolved(df).collect()} == {("C", 5, 12), ("E", 13, 16)}


def test_long_items(spark):
    """An item of many words counts as a whole, not by a part of it."""
    from tessera.llm import decontamination

    for n in (203, 205, 1200):
        item = [f"w{i}" for i in range(n)]
        edited = [w if i % 8 else "x" for i, w in enumerate(item)]
        rows = [(1, "other text " + " ".join(item[-5:])), (2, " ".join(item[:50])), (3, "a b " + " ".join(item) + " c"), (4, " ".join(edited))]
        got = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
        assert {(r.doc_id, r.item_id) for r in got.collect()} == {(3, 7), (4, 7)} == brute.leaks(rows, [(7, " ".join(item))], 0.6)


def test_repeated_training_rows(spark):
    """Rows of one id, copies and other texts alike, leave room for the other documents."""
    from tessera.llm import toxicity

    rng = random.Random(4)
    clean = [(i, " ".join(rng.choice(["sun", "low", "tree", "river", "stone", "cloud"]) for _ in range(12))) for i in range(40)]
    toxic = [(100 + i, f"tree {i} cloud. you vile fool {i}! stone {i}") for i in range(40)]
    many = [(0, clean[0][1])] * 500 + [(0, f"sun tree {i} low sun") for i in range(30)]
    docs = spark.createDataFrame(clean + toxic + many, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d >= 100)) for d, _ in clean + toxic], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sample=60)
    ask = spark.createDataFrame([(1, "a calm river. you vile fool!"), (2, "a calm river and a tree")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score(ask, model).collect()}
    assert score[1] > 0.7 > 0.3 > score[2]
