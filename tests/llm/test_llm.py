from __future__ import annotations

import random
import zlib
from collections import Counter

import brute
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import decontamination, license_rules, license_scan, lm_scoring, ngram_join, quality_rules, queries, sentencepiece_codec, sharding, substring_dedup, token_counts, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, key string"
ODD = [None, "", "  \n\t", "a", "a b", "Ünï ▁ cödé 中文 \U0001f600 end", "<|endoftext|> x", "x" * 3000, "na " * 200, "same text here, twice over", "same text here, twice over"]


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + [(10_000 + i, t) for i, t in enumerate(ODD)]


@pytest.fixture(scope="module")
def table(spark, docs):
    """With columns whose names clash with results."""
    return spark.createDataFrame([(d, t, "s", "k") for d, t in docs], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) for r in df.collect()}


def test_quality_counts(table, docs, empty):
    got = by_id(quality_rules.quality(table, np.zeros(quality_rules.BUCKETS)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == {d: brute.quality_counts(t) for d, t in docs}
    assert quality_rules.quality(empty, quality_rules.ratios(empty, empty)).count() == 0


def test_license(table, docs, spark, empty):
    lines = ["Released under the MIT License.", "the GNU General Public License, version 3 or later; CC-BY 4.0", "apache license apache license", "mit licensed"]
    extra = spark.createDataFrame([(20_000 + i, t, "", "") for i, t in enumerate(lines)], SCHEMA)
    got = license_scan.license_scan(table.unionByName(extra))
    want = {d: brute.license_base(t) for d, t in docs + [(20_000 + i, t) for i, t in enumerate(lines)]}
    assert by_id(got, "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    labels = by_id(got.where("doc_id >= 20000"), "labels")
    assert labels[20_000] == ("mit",) and "gpl-3.0" in labels[20_001][0] and "cc-by-4.0" in labels[20_001][0]
    assert license_scan.license_scan(empty).count() == 0


def test_containment(spark):
    texts = spark.createDataFrame([("k", "gnu lesser general public license version 2.1")], "key string, text string")
    assert {r.label for r in license_scan.detections(texts).where("not base").collect()} == {"lgpl-2.1"}


def test_license_filters(spark):
    """Gate, lead and keyword let every alternative of every rule through."""
    cases = [(i, m, r) for i, r in enumerate(license_rules.RULES) for m in brute.alternatives(r["pattern"].removeprefix("(?<= )(?:").removesuffix(")(?= )")) if m == " ".join(m.split())]
    for _, m, r in cases:
        norm = f" {m} "
        assert any(" " + w in norm for w in license_rules.GATE) and " " + r["keyword"].split(" ")[0] in norm and r["keyword"] in norm, m
    texts = spark.createDataFrame([(i, m) for i, m, _ in cases], "rule int, text string")
    hits = license_scan.marked(license_scan.normalised(F.col("text")))
    assert texts.select("text", F.exists(F.coalesce(hits["rule"], F.array()), lambda x: x == F.col("rule")).alias("ok")).where("not ok").collect() == []
    lost = ["Noncommercial use only", "FreeBSD", "a FreeBSD license", "BigCode Open RAIL-M", "the dataset is licenced under terms"]
    found = by_id(license_scan.license_scan(spark.createDataFrame(list(enumerate(lost)), "doc_id long, text string")), "labels")
    assert [found[i][0] for i in range(5)] == ["non-commercial", "bsd-2", "bsd-2", "openrail-m", "unknown-license"]


def test_tokenizers_match_libraries(table, docs, empty):
    lib = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = by_id(token_counts.token_counts(table, queries.tokenizer("byte_bpe_50k.json")), "n_bytes", "n_tokens")
    assert got == {d: (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for d, t in docs}
    path = queries.tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = sentencepiece_codec.encode(table, path)
    assert by_id(encoded, "ids") == {d: (sp.encode(t or ""),) for d, t in docs}
    assert by_id(sentencepiece_codec.decode(encoded, path), "decoded") == {d: ((t or "").replace("▁", " "),) for d, t in docs}
    assert token_counts.token_counts(empty, queries.tokenizer("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (3, 50)])
def test_components(spark, docs, n, percent):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    near = [(30_000 + i, " ".join(w if rng.random() > 0.015 else f"e{rng.randrange(99)}" for w in base)) for i in range(150)]
    rows = docs + near
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent)
    assert by_id(got, "n_shingles", "component_id") == brute.jaccard_components(rows, n, percent)


def test_components_refuted_first(spark):
    """The set of most prefix grams in common is refuted, and the partner that links shares a bucket of two members."""
    rng = random.Random(8)
    rows = []
    for g in range(60):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(11)]
        more = f"g{g}x"
        other = [f"g{g}o{j}" for j in range(30)]
        rows += [(3 * g + 1, " ".join([*other, base[-2], base[-1], more])), (3 * g + 2, " ".join(base)), (3 * g + 3, " ".join([*base, more]))]
    want = brute.jaccard_components(rows, 3, 90)
    assert all(want[3 * g + 3][1] == 3 * g + 2 for g in range(60))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert by_id(got, "n_shingles", "component_id") == want


def test_components_nulls(spark, empty):
    rows = [(None, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, None), (4, "a b c d")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got.collect()) == [("2", "2"), ("2", "2"), ("3", "3"), ("4", "2"), ("None", "None")]
    assert ngram_join.jaccard_components(empty).count() == 0


def test_dedup(spark, docs, empty):
    rng = random.Random(9)
    shared = [" ".join(f"p{k}w{rng.randrange(1000)}" for _ in range(80)) for k in range(3)]
    rows = docs + [(40_000 + i, " ".join([f"u{i}a{j}" for j in range(i % 30)] + [shared[i % 3]] + [f"u{i}b{j}" for j in range(5)] + ([shared[(i + 1) % 3]] if i % 4 == 0 else []))) for i in range(60)]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 50)
    assert by_id(got, "n_words", "n_removed", "kept_sha256") == brute.dedup(rows, 50)
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    assert by_id(got, "n_words", "n_removed", "kept_sha256") == brute.dedup(rows, 4)
    assert substring_dedup.dedup(empty).count() == 0


def test_automaton():
    rng = random.Random(1)
    for _ in range(200):
        refs = [[rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(3)]
        seq = [rng.randrange(3) for _ in range(15)]
        inside = {tuple(r[i:j]) for r in refs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        want = [max([n for n in range(1, e + 1) if tuple(seq[e - n : e]) in inside], default=0) for e in range(1, len(seq) + 1)]
        assert list(substring_dedup.Automaton(refs).statistics(seq)) == want


def test_leaks(spark, empty):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for i, (_, t) in enumerate(items[:12]):
        words = t.split()
        for j in rng.sample(range(len(words)), len(words) // 10):
            words[j] = "edited"
        rows.append((50_000 + i, "some words before " + " ".join(words) + " and after"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute.leaks(rows, items, 0.6)
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(spark.createDataFrame(rows[:3], "doc_id long, text string"), bench.limit(0)).count() == 0


def test_leaks_edited(spark):
    """Edits up to the threshold, beside exact copies that make the lost seeds rarer than the kept ones."""
    rng = random.Random(11)
    items = [(k, " ".join(f"v{rng.randrange(60)}" if rng.random() < 0.3 else f"i{k}w{j}" for j in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 8, 10, 10, 13, 20, 30, 45])]
    items.append((99, " ".join("abcde")))
    texts = [t for _, t in items]
    for _, t in items * 20:
        words, rate = t.split(), rng.choice([0.1, 0.2, 0.3, 0.4])
        kind = rng.choice(["insert", "delete", "replace", "any"])
        out = []
        for w in words:
            do = rng.choice(["insert", "delete", "replace"]) if kind == "any" else kind
            if rng.random() < rate:
                out += {"insert": [f"x{rng.randrange(999)}", w], "delete": [], "replace": [f"x{rng.randrange(999)}"]}[do]
            else:
                out.append(w)
        texts.append(" ".join([f"v{rng.randrange(60)}" for _ in range(rng.randrange(30))] + out + [f"v{rng.randrange(60)}" for _ in range(rng.randrange(30))]))
    texts += [" ".join(x for w in t.split() for x in (w, "between")) for _, t in items]
    texts += [" ".join(x for j, w in enumerate(t.split()) for x in ((w, "between") if j % 2 else (w,))) for _, t in items]
    rows = list(enumerate(texts))
    got = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute.leaks(rows, items, 0.6)


def test_smith_waterman():
    rng = np.random.default_rng(2)
    a, b = rng.integers(2, 6, (40, 9)).astype(np.uint64), rng.integers(2, 6, (40, 14)).astype(np.uint64)
    assert decontamination.smith_waterman(a, b)[0].tolist() == [brute.smith_waterman(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]


def test_toxicity(spark, empty):
    rng = random.Random(6)
    text = lambda bad: ". ".join(" ".join(rng.choice(["the", "sun", "is", "warm", "and", "low"]) for _ in range(6)) + (" scum" if bad and i == 2 else "") for i in range(5))
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.where("doc_id < 300").select("doc_id", "toxic"))
    got = toxicity.score(df.unionByName(spark.createDataFrame([(900, None, 0), (901, "", 0)], df.schema)), model)
    assert {r.doc_id for r in got.where("predicted = 1").collect()} == {i for i, _, y in rows if y}
    one = got.where("doc_id = 0").first()
    body = rows[0][1].encode()
    assert len(one.offending) == 1 and body[one.offending[0].start : one.offending[0].end].endswith(b"scum")
    assert toxicity.score(empty, toxicity.train(empty, df)).count() == 0


def test_toxicity_plain_fit(spark):
    """The scores of the distributed fit are those of a plain one, with words that speak against a label too."""
    rng = random.Random(16)
    mild, harsh, calm = ["sun", "low", "tree", "river", "stone", "cloud", "wind"], ["vile", "fool", "scum"], ["please", "thanks"]

    def text(bad):
        parts = [" ".join(rng.choice(mild) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 5))]
        at = rng.randrange(len(parts))
        if bad or rng.random() < 0.1:  # a harsh word beside a calm one is no offence
            parts[at] += " " + rng.choice(harsh) + ("" if bad else " " + rng.choice(calm))
        elif rng.random() < 0.5:
            parts[at] += " " + rng.choice(calm)
        return rng.choice([". ", "!\n", "? "]).join(parts) + f" n{rng.randrange(10**6)} m{rng.randrange(10**6)}"

    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    model = toxicity.train(df, df.where("doc_id < 160").select("doc_id", "toxic"))
    assert (model.weights < 0).any() and (model.weights > 0).any()
    ask = [*((d, t) for d, t, _ in rows), (900, None), (901, ""), (902, "you vile fool"), (903, "VILE, please! thanks")]
    plain = brute.noisy_or_scores([(t, y) for d, t, y in rows if d < 160], [t for _, t in ask])
    mine = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(ask, "doc_id long, text string"), model).collect()}
    assert max(abs(mine[d] - p) for (d, _), p in zip(ask, plain, strict=True)) < 1e-4
    told = [(mine[d] >= 0.7) == y for d, _, y in rows if d >= 160]
    assert sum(told) >= 0.9 * len(told) and mine[902] > 0.7 > mine[903]


def test_differencing():
    rng = np.random.default_rng(0)
    parts = np.zeros((300, 7), np.int64)
    parts[:, 0] = rng.integers(1, 1000, 300)
    sums, ended = sharding.difference(parts)
    total = np.bincount(ended[:, 0], weights=parts[:, 0], minlength=7)
    assert total.tolist() == sums.tolist() and sums.max() - sums.min() <= 3


def test_sharding(table, docs, empty):
    p = sharding.shard(table, shards=5, block=64, fan=2).toPandas()
    text = {d: t or "" for d, t in docs}
    assert len(p) == len(docs) and all(p["size"] == [len(text[d].encode()) + 16 for d in p.doc_id]) and all(p.text_crc32 == [zlib.crc32(text[d].encode()) for d in p.doc_id])
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in p.groupby("shard"))
    assert (p.assign(t=p.doc_id.map(text)).groupby("t").shard.nunique() == 1).all()
    assert np.ptp(p.groupby("shard")["size"].sum()) < 0.05 * p["size"].sum()
    assert sharding.shard(empty).count() == 0


def test_lm_base(table, docs, empty):
    path = queries.tokenizer("byte_bpe_50k.tiktoken")
    got = lm_scoring.lm_score(table, path).toPandas().set_index("doc_id")
    for d, (n, known, train, score) in brute.base_scores(docs).items():
        r = got.loc[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, train, brute.crc(d) % 10 == 0)
        assert abs(r.base_score - score) <= 1e-6 * abs(score)
    assert np.isfinite(got.score).all() and (got.score < 0).all()
    assert lm_scoring.lm_score(empty, path).count() == 0


def trained(spark, texts, partitions=1):
    path = queries.tokenizer("byte_bpe_50k.tiktoken")
    _, end, leads = lm_scoring._encoding(path)
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(partitions)
    return lm_scoring.train(lm_scoring.gather(rows, path), end, leads)


def test_training_takes_all(spark):
    """Every document takes part in training, whatever its place, and every window of a long one."""
    texts = [f"the sun is warm and low {i}" for i in range(5)] + [" ".join(f"word{i} is here" for i in range(300))]
    whole = trained(spark, texts)[1]
    for k in (1, 4):
        assert not np.allclose(whole, trained(spark, [*texts[:k], "a cold wind blows here", *texts[k + 1 :]])[1], atol=1e-6)
    assert not np.allclose(whole, trained(spark, [*texts[:5], texts[5].replace("word170 is", "word170 was")])[1], atol=1e-6)


def test_lm_layout(spark, docs):
    """Scores don't depend on partitions; held-out text scores better than by the unigram."""
    path, rows = queries.tokenizer("byte_bpe_50k.tiktoken"), spark.createDataFrame(docs, "doc_id long, text string")
    one, many = (lm_scoring.lm_score(rows.repartition(n), path).toPandas().sort_values("doc_id") for n in (1, 7))
    assert np.allclose(one.score, many.score, rtol=1e-5, atol=1e-3)
    held = one[one.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_attention_gradients():
    rng = np.random.default_rng(3)
    shapes = lm_scoring.Attention.SHAPES
    flat = {k: rng.normal(size=s) * 0.5 for k, s in shapes.items()}
    make = lambda p: lm_scoring.Attention({k: v.copy() for k, v in p.items()})
    n = 3 * lm_scoring.STEP
    x, first = rng.integers(0, 50, n + lm_scoring.STEP), np.array([True, False, False])
    at = np.sort(rng.choice(n, n // 2, replace=False))
    y = rng.integers(0, lm_scoring.CLASSES, len(at))
    d, lo = make(flat).gradients(x, first, at, y), 0
    for k, s in shapes.items():
        size = int(np.prod(s))
        g, lo = d[lo : lo + size].reshape(s), lo + size
        i = np.unravel_index(np.abs(g).argmax(), s)
        loss = []
        for step in (1e-3, -1e-3):
            moved = {j: v.copy() for j, v in flat.items()}
            moved[k][i] += step
            loss.append(-make(moved).log_probs(x, first, at, y).astype(np.float64).sum())
        assert abs((loss[0] - loss[1]) / 2e-3 - g[i]) < 2e-2 * max(1, abs(g[i])), k


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = {r.doc_id: r.text for r in docs.collect()}
    stage = docs
    for name, f in P.STAGES:
        after = f(spark, stage, SF)
        if name != "sentencepiece":
            assert after.columns == docs.columns
        kept = {r.doc_id for r in after.collect()}
        if name == "toxicity":
            flags = toxicity.score(stage, toxicity.train(stage, spark.read.parquet(f"{SF}/labels.parquet")))
            want = {r.doc_id for r in flags.where("predicted = 0").collect()}
        elif name == "ngram_join":
            want = {d for d, (_, c) in brute.jaccard_components(sorted(now.items()), 5, 80).items() if c == d}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = set(now) - {d for d, _ in brute.leaks(list(now.items()), items, 0.6)}
        else:
            want = set(now)
        assert kept == want, name
        if name == "sentencepiece":
            break
        now = {r.doc_id: r.text for r in after.collect()}
        stage = spark.createDataFrame(pd.DataFrame([r.asDict() for r in after.collect()]), docs.schema)


def odd_repeats():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    rows = [(rng.randrange(60), say(rng.randrange(60))) for _ in range(90)] + [(None, say(30)), (3, None), (4, "")]
    return rows + [(200 + i, rows[i][1]) for i in range(10)] + [(300, "x y z " * 40), (301, "z x y " * 30), (5, rows[5][1])]


@pytest.mark.parametrize(("window", "shard"), [(4, 1000), (4, 2), (9, 3), (1, 1)])
def test_repeats_in_split_shards(spark, window, shard):
    """Shards too large for their anchor are split by longer ones, down to single windows; nothing changes."""
    rows = odd_repeats()
    spans = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), window, shard=shard)
    gone = Counter()
    for r in spans.collect():
        gone[r.doc_id] += sum(s.end - s.start for s in r.spans)
    want = {}
    for d, t, (_, _, n, _) in ((d, t, x) for (d, t), x in zip(rows, brute.dedup_rows(rows, window), strict=True)):
        if n:
            want.setdefault(d, {})[t] = n
    assert gone == Counter({d: sum(v.values()) for d, v in want.items()})


def test_repeats_come_from_the_automaton(monkeypatch):
    """Matching statistics alone decide: without them nothing goes, exact copies neither."""
    import pyarrow as pa

    words = [[1, 2, 3, 4, 5, 6], [9, 2, 3, 4, 5, 9], [9, 9, 2, 3, 4, 5]]
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 3), pa.array([1, 2, 3]), pa.array([10, 20, 20]), pa.array(words), pa.array([True, False, False])], ["key", "piece", "first", "words", "more"])
    spans = lambda: [tuple([(s["a"], s["b"]) for s in r[c]] for c in ("own", "others")) for b in substring_dedup._streamed(4)([batch]) for r in b.to_pylist()]
    assert spans() == [([], [(0, 6)]), ([(1, 5)], []), ([(2, 6)], [])]
    monkeypatch.setattr(substring_dedup.Automaton, "statistics", lambda self, seq: iter([0] * len(seq)))
    assert spans() == [([], []), ([], []), ([], [])]


@pytest.mark.parametrize("name", ["op5_ngram_join", "op7_substring_dedup"])
def test_sql_gives_the_same_rows(spark, name):
    import oracle

    d = "/root/testdata/sf0.001"
    assert oracle.compare(spark, oracle.connect(d), queries.QUERIES[name], queries.ORACLE_SQL[name], d) == ""
