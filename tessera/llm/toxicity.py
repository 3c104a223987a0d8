"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is (noisy-or)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import ALNUM, U64, Words, gram_hash, lists, map_texts, signed, span_hash, sums

#: Labelled documents that training reads at most: half of each class, those of smallest hash.
SAMPLE = 6_000
BUCKETS = 1 << 18
EPOCHS = 80

_STOPS = np.zeros(256, np.int64)
_STOPS[[0x0A, 0x21, 0x2E, 0x3F]] = 1  # a sentence ends at a line end, !, . or ?


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentences(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits + self.bias, -30, 30)))


def features(data: np.ndarray, at: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words (letters and digits, case folded), the bucket of each, and the number of each word's sentence.

    A sentence never spans documents; sentence numbers have no gaps."""
    words = Words(data, at, ALNUM)
    if not len(words.starts):
        return words, np.zeros(0, np.int64), np.zeros(0, np.int64)
    bucket = (words.hashes(fold=True) >> np.uint64(46)).astype(np.int64) % BUCKETS
    stops = np.cumsum(_STOPS[data])[words.starts]
    new = np.append(True, (np.diff(stops) > 0) | (np.diff(words.docs) > 0))
    return words, bucket, np.cumsum(new) - 1


def signatures(words: Words, n: int) -> np.ndarray:
    """The smallest hash of five words of each document, which most of its near copies have too."""
    own = words.hashes(fold=True)
    out = np.zeros(n, U64)
    ok = np.flatnonzero(words.within(5))
    if len(ok):
        docs = words.docs[ok]
        head = np.flatnonzero(np.append(True, np.diff(docs) > 0))
        out[docs[head]] = np.minimum.reduceat(gram_hash(own, 5)[ok], head)
    short = np.flatnonzero((out == 0) & (words.counts > 0))
    out[short] = span_hash(own, words.first[short], words.first[short + 1])
    return out


def noisy_or(p: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """1 - product of (1 - p) over each document's sentences; 0 for a document without one."""
    return -np.expm1(sums(np.log1p(-np.minimum(p, 1 - 1e-12)), docs, n))


def fit(buckets: np.ndarray, sentence: np.ndarray, doc: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, rate: float = 10.0, decay: float = 2e-4) -> Model:
    """Gradient steps on the log-likelihood of document labels under the noisy-or, the classes weighing alike.

    sentence and doc number the words and the sentences. Words that speak for either class start at a part of their log odds between
    the classes, those for the clean one below 0. Words that the classes hold about alike keep weight 0, and so that no document is
    learnt by heart, those of fewer than three documents, or than a hundredth of the toxic ones (of all, if they speak for the clean
    class). The order of rows has no effect but on rounding."""
    model = Model(np.zeros(BUCKETS), -5.5)
    n_sent, n = len(doc), len(label)
    # buckets and documents as one number each, so that only distinct pairs are counted
    pairs = buckets.astype(np.int64) * n
    pairs += doc[sentence]
    pairs = np.unique(pairs)
    toxic = label[pairs % n] == 1
    of = [np.bincount(pairs[k] // n, minlength=BUCKETS) for k in (toxic, ~toxic)]
    del pairs, toxic
    size = [max(1, int((label == k).sum())) for k in (1, 0)]
    odds = np.log((of[0] + 0.1) / (size[0] + 0.2)) - np.log((of[1] + 0.1) / (size[1] + 0.2))
    held = of[0] + of[1]
    used = np.flatnonzero((held >= max(3, 0.01 * size[0])) & ((odds > 2) | (odds < -1) & (held >= 0.01 * n)))
    w = np.where(odds[used] > 0, 1.4, 0.5) * odds[used]
    # other words have no weight: only the places of these take part
    spot = np.full(BUCKETS, -1, np.int32)
    spot[used] = np.arange(len(used))
    where = spot[buckets]
    sentence, where = sentence[where >= 0], where[where >= 0]
    # a step is the plain gradient, so a word moves as far as documents ask for it; the bias steps by its own size
    share = np.where(label == 1, 0.5 / size[0], 0.5 / size[1])
    bias = model.bias
    for _ in range(epochs):
        z = np.clip(np.bincount(sentence, weights=w[where], minlength=n_sent) + bias, -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))
        # d log-likelihood / dz: for label 1, p * clean / (1 - clean); for label 0, -p
        pull = np.where(label == 1, clean / np.maximum(1 - clean, 1e-9), -1.0) * share
        g = pull[doc] * p
        w += rate * (np.bincount(where, weights=g[sentence], minlength=len(used)) - decay * w)
        bias += min(0.1, max(-0.1, g.sum()))
    model.weights[used], model.bias = w, float(bias)
    return model


def train(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model of at most ``sample`` labelled documents, half of each class: of either, those whose id has the smallest hash.

    Rows with a null id, label or text are no training rows; an id labelled more than once counts as its largest label. Of near copies
    in one class (equal smallest hash of five words), those of one id included, one takes part: that of the smallest id, then of the
    smallest hash of its words. Of texts that are left, each class has at most half of ``sample``, those of smallest signature.
    Without a document of each class nothing is learnt and every score is near 0. The model is fitted by one task on these rows, whose
    number ``sample`` bounds; the driver gets the weights that are not 0, BUCKETS at most."""
    known = labels.where(f"`{doc_id}` is not null and `{label}` is not null").groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    half = [known.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for c in ("label > 0", "label <= 0")]
    picked = half[0].unionByName(half[1])  # at most ``sample`` rows of two numbers
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(picked), "doc_id").select("label", "text", "doc_id")

    def make():
        def f(batch, data, at):
            words, bucket, sentence = features(data, at)
            return [batch.column(0), batch.column(2), pa.array(signed(signatures(words, len(at) - 1))), lists(pa.array(bucket.astype(np.int32)), words.counts), lists(pa.array(sentence.astype(np.int32)), words.counts)]

        return f

    each = map_texts(rows, make, "label int, doc_id long, signature long, bucket array<int>, sentence array<int>")
    once = each.groupBy((F.col("label") > 0).cast("int").alias("label"), "signature").agg(F.min_by(F.struct("bucket", "sentence"), F.struct("doc_id", F.xxhash64("bucket"))).alias("t"))
    parts = [once.where(c).orderBy("signature").limit(sample // 2) for c in ("label = 1", "label = 0")]
    taken = parts[0].unionByName(parts[1]).select("label", "signature", "t.bucket", "t.sentence")

    def fitted(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        got = pa.Table.from_batches(held).sort_by([("label", "ascending"), ("signature", "ascending")]).combine_chunks()
        y = got["label"].to_numpy()
        if not 0 < y.sum() < len(y):
            return
        bucket, sentence = got["bucket"].combine_chunks(), got["sentence"].combine_chunks()
        counts = np.diff(np.asarray(bucket.offsets))
        doc, number = np.repeat(np.arange(len(y), dtype=np.int32), counts), np.asarray(sentence.flatten())
        new = np.append(True, (np.diff(doc) > 0) | (np.diff(number) != 0))[: len(doc)]
        model = fit(np.asarray(bucket.flatten()), np.cumsum(new, dtype=np.int32) - 1, doc[new], y)
        some = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(model.weights[some], model.bias))], ["bucket", "weight"])

    got = taken.coalesce(1).mapInArrow(fitted, "bucket long, weight double").toArrow()
    model = Model(np.zeros(BUCKETS), -5.0)
    if got.num_rows:
        bucket, weight = got["bucket"].to_numpy(), got["weight"].to_numpy()
        model.weights[bucket[bucket >= 0]], model.bias = weight[bucket >= 0], float(weight[bucket < 0][0])
    return model


def score(df: DataFrame, model: Model, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted (score >= threshold), n_sentences, and offending: (start, end, score) of each sentence whose own
    score is at least ``threshold``, start and end being byte offsets into the UTF-8 text.

    One row per input row in one pass without a shuffle; only the text is looked at. Null and empty texts, or texts without a
    word, score 0. The model's size is fixed by its number of buckets."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def make():
        own = Model(*shared.value)

        def f(batch, data, at):
            n = len(at) - 1
            words, bucket, sentence = features(data, at)
            if not len(bucket):
                none = pa.array(np.zeros(n))
                return [batch.column(0), none, pa.array(np.zeros(n, np.int32)), pa.array([[]] * n, pa.list_(_SPAN))]
            p = own.sentences(np.bincount(sentence, weights=own.weights[bucket]))
            head = np.flatnonzero(np.append(True, np.diff(sentence) > 0))
            last = np.append(head[1:], len(sentence)) - 1
            doc = words.docs[head]
            bad = np.flatnonzero(p >= threshold)
            spans = pa.StructArray.from_arrays([pa.array(words.starts[head[bad]] - at[doc[bad]]), pa.array(words.ends[last[bad]] - at[doc[bad]]), pa.array(p[bad])], fields=list(_SPAN))
            return [batch.column(0), pa.array(noisy_or(p, doc, n)), pa.array(np.bincount(doc, minlength=n).astype(np.int32)), lists(spans, np.bincount(doc[bad], minlength=n))]

        return f

    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = map_texts(source, make, "doc_id long, score double, n_sentences int, offending array<struct<start:long,end:long,score:double>>")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).select("doc_id", "score", "predicted", "n_sentences", "offending")


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
