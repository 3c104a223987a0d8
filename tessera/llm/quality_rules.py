"""Quality rules: a hashed n-gram log-likelihood ratio of trusted text against the whole corpus, beside plain counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import CODES, SPACED, U64, Words, gram_hash, map_texts, mix, span_hash, sums
from tessera.llm.bitmap import maybe

BUCKETS = 1 << 16
#: A document is kept if its mean log ratio per n-gram (natural logarithm) is at least this.
THRESHOLD = -0.25

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
#: Kinds of characters for word shapes: lower case and non-ASCII alike, capitals, digits; each other ASCII character by itself.
_KIND = np.arange(256)
_KIND[0x61:0x7B] = _KIND[0x80:] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x30:0x3A] = 3


def ngrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each n-gram: words, pairs of words, and triples of word shapes."""
    if not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = words.hashes()
    kind = _KIND[words.data]
    second = kind[np.minimum(words.starts + 1, words.ends - 1)]
    shape = mix((kind[words.starts] << 16 | second << 8 | kind[words.ends - 1]).astype(U64))
    found, docs = [one], [words.docs]
    for salt, unit, n in ((1, one, 2), (2, shape, 1), (3, shape, 3)):
        ok = words.within(n)
        found.append(mix(gram_hash(unit, n)[ok] + U64(salt)) if n > 1 else mix(unit + U64(salt)))
        docs.append(words.docs[: len(ok)][ok])
    return np.concatenate([(h >> U64(48)).astype(np.int64) % BUCKETS for h in found]), np.concatenate(docs)


def counts(df: DataFrame, text: str) -> np.ndarray:
    """How often each bucket occurs in all texts of df: partial sums by task, added up by Spark; BUCKETS numbers reach the driver."""

    def make():
        total = np.zeros(BUCKETS, np.int64)

        def f(batch, data, at):
            total[:] += np.bincount(ngrams(Words(data, at))[0], minlength=BUCKETS)

        def end():
            some = np.flatnonzero(total)
            yield [pa.array(some.astype(np.int32)), pa.array(total[some])]

        f.end = end
        return f

    got = map_texts(df.select(F.col(text).cast("string")), make, "bucket int, n long", text=0).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def texts_of(df: DataFrame, ids: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): the rows of df whose id is among the ids of ``ids`` (doc_id). A null id is among none; repeated ids count once.

    A bitmap of fixed size drops most other texts first; what is left meets the ids in one shuffle, whatever their number."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return maybe(rows, known, "doc_id").join(known.hint("shuffle_hash"), "doc_id").select("doc_id", "text")


def ratios(df: DataFrame, trusted: DataFrame, smooth: float = 1.0, text: str = "text") -> np.ndarray:
    """log(p_trusted / p_corpus) of each bucket, both multinomials smoothed by adding ``smooth``; zeros if nothing is trusted.

    trusted: rows whose text is trusted. All texts of both tables count."""
    target, raw = counts(trusted, text), counts(df, text)
    if not target.sum():
        return np.zeros(BUCKETS)
    # the corpus holds the trusted texts: smoothing in proportion keeps a bucket without any text at 0
    add = smooth * target.sum() / max(1.0, raw.sum())
    return np.log((target + add) / (target + add).sum()) - np.log((raw + smooth) / (raw + smooth).sum())


def line_repeats(data: np.ndarray, at: np.ndarray, words: Words) -> np.ndarray:
    """For each document, the lines that hold a word and equal an earlier line."""
    n = len(at) - 1
    cut = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], cut + 1]))
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(n, np.int64)
    ends = np.append(starts[1:], len(data))
    ends = np.where((ends > starts) & (data[ends - 1] == 0x0A), ends - 1, ends)
    docs = np.searchsorted(at, starts, "right") - 1
    held = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    h = mix(span_hash(CODES[data], starts, ends) + docs.astype(U64) * U64(0x9E3779B97F4A7C15))[held]
    _, first = np.unique(h, return_index=True)
    again = np.ones(len(h), bool)
    again[first] = False
    return np.bincount(docs[held][again], minlength=n)


def window_repeats(words: Words, n_docs: int, n: int = 3) -> np.ndarray:
    """For each document, the words in windows of n words that the document holds twice or more."""
    ok = words.within(n)
    if not ok.any():
        return np.zeros(n_docs, np.int64)
    where = np.flatnonzero(ok)
    h = mix(gram_hash(words.hashes(), n)[where] + words.docs[where].astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words.docs), bool)
    for i in range(n):
        covered[where[twice] + i] = True
    return np.bincount(words.docs[covered], minlength=n_docs)


def quality(df: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr (mean log ratio per n-gram), trusted (llr >= threshold).

    One row per input row, in one pass without a shuffle; every document is judged by the same threshold. A null text, or one
    without words, has zeros everywhere and llr 0. Null and repeated ids are passed on. Other columns are not read."""
    shared = df.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))

    def make():
        log_ratio = shared.value

        def f(batch, data, at):
            n = len(at) - 1
            words = Words(data, at)
            # a code point begins at every byte that is no continuation byte
            marks = np.concatenate([[0], np.cumsum(SPACED[data] & ((data & 0xC0) != 0x80))])
            signs = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
            bucket, docs = ngrams(words)
            total = np.maximum(1, np.bincount(docs, minlength=n))
            llr = sums(log_ratio[bucket], docs, n) / total
            ints = [words.counts, marks[at[1:]] - marks[at[:-1]], signs[at[1:]] - signs[at[:-1]], line_repeats(data, at, words), window_repeats(words, n)]
            return [batch.column(0), *(pa.array(x.astype(np.int64)) for x in ints), pa.array(llr)]

        return f

    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = map_texts(source, make, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double")
    return out.withColumn("trusted", F.col("llr") >= threshold)
