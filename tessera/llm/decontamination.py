"""Benchmark decontamination: rare words and word pairs find candidates, Smith-Waterman alignment scores them.

The candidates are complete. An alignment of M matches and X other columns scores 2 M - X, so one of score T has M >= (T + X) / 2
matches, and at least M - X - 1 pairs of neighbours in it are neighbours in the item too. Of n words any n - m + 1 hold one of m
matches, and of n - 1 pairs any n - b one of b. So for each number of columns x the rarest words for X > x and the rarest pairs for
X <= x find every alignment; each item takes the x of least document count. Seeds that no document holds count in these sums, as
no match falls on them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import ALNUM, U64, Words, gram_hash, map_texts, mix, runs

#: An alignment counts if its score is at least this share of the item's score with itself.
SIMILARITY = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items, and bytes of their texts, that are broadcast at a time, about; more are taken in rounds. One item is never cut.
ITEMS, ITEM_BYTES = 10_000, 1 << 23
#: Pairs of a place and a seed, and words of candidates, that are looked at together.
PAIRS = 1 << 20


@dataclass
class Items:
    """Benchmark items as arrays: word hashes, and the seeds as sorted keys with item and places."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    keys: np.ndarray
    item: np.ndarray
    low: np.ndarray  # first place of the seed
    high: np.ndarray  # last place
    need: np.ndarray  # words of the item that a candidate of this seed must hold; 1 and 2 tell words and pairs before the choice
    least: np.ndarray  # score of an alignment that counts

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def slack(self) -> np.ndarray:
        """Words that an alignment can hold beside the item's."""
        return MATCH * self.size - self.least


def seeds_of(own: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each word, then of each pair of words."""
    ok = np.flatnonzero(words.within(2))
    return np.concatenate([own, gram_hash(own, 2)[ok] if len(ok) else np.zeros(0, U64)]), np.concatenate([np.arange(len(own)), ok])


def read_items(rows: pa.Table, similarity: float = SIMILARITY) -> Items:
    """Items of (item_id, text)."""
    from tessera.llm.batches import buffers

    data, at = buffers(rows["text"])
    words = Words(data, at, ALNUM)
    own = words.hashes(fold=True)
    key, at = seeds_of(own, words)
    order = np.argsort(key, kind="stable")
    at, wide = at[order], np.where(order < len(own), 1, 2)
    item = words.docs[at] if len(at) else np.zeros(0, np.int64)
    place = at - words.first[item]
    least = np.maximum(1, np.ceil(similarity * MATCH * words.counts - 1e-6).astype(np.int64))
    return Items(rows["item_id"].to_numpy(), own, words.first, key[order], item, place, place, wide, least)


def rare(items: Items, seen: np.ndarray) -> Items:
    """The seeds of least document count together of which every alignment of an item's least score holds one."""
    order = np.lexsort((items.low, seen, items.need, items.item))
    begin = np.searchsorted(items.item[order], np.arange(len(items.ids) + 1))
    keep, need = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, (n, least) in enumerate(zip(items.size.tolist(), items.least.tolist(), strict=True)):
        if not n or least > MATCH * n:
            continue
        own = order[begin[k] : begin[k + 1]]
        words, pairs = own[:n], own[n:]
        x = np.arange(-1, MATCH * n - least + 1)  # pairs find alignments of up to x other columns, words those of more
        m = -(-(least + x + 1) // 2)
        b = np.append(n, np.minimum.accumulate(-(-(least + x[1:]) // 2) - 1 - x[1:]))
        cost = np.append(0, np.cumsum(seen[words]))[np.maximum(0, n - m + 1)] + np.append(0, np.cumsum(seen[pairs]))[np.clip(n - b, 0, n - 1)]
        best = int(np.argmin(np.where(b > 0, cost, np.iinfo(np.int64).max)))
        words, pairs = words[: max(0, n - int(m[best]) + 1)], pairs[: n - int(b[best])]
        keep += [words, pairs]
        need += [np.full(len(words), m[best]), np.full(len(pairs), -(-least // 2))]
    keep, need = np.concatenate(keep), np.concatenate(need)
    order = np.lexsort((items.low[keep], items.item[keep], items.keys[keep]))
    keep, need = keep[order], need[order]
    key, item = items.keys[keep], items.item[keep]
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (item[1:] != item[:-1]))[: len(keep)])
    low, high, need = (f.reduceat(v, new) if len(new) else v for f, v in ((np.minimum, items.low[keep]), (np.maximum, items.low[keep]), (np.minimum, need)))
    return Items(items.ids, items.words, items.first, key[new], item[new], low, high, need, items.least)


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores of rows of a with rows of b, and the column of b after which it ends. 0 pads a, 1 pads b."""
    cols = np.arange(b.shape[1]) * GAP
    h = np.zeros(b.shape, np.int32)
    best, end = np.zeros(len(a), np.int32), np.zeros(len(a), np.int64)
    for i in range(a.shape[1]):
        up = h + GAP
        h[:, 1:] = h[:, :-1].copy()
        h[:, 0] = 0
        h += np.where(a[:, i, None] == b, MATCH, MISMATCH)
        h = np.maximum(np.maximum(h, up), 0)
        h = np.maximum.accumulate(h - cols, axis=1) + cols  # gaps along b
        top = h.max(axis=1)
        more = top > best
        best[more] = top[more]
        end[more] = h[more].argmax(axis=1) + 1
    return best, end


def candidates(items: Items, words: Words, at: np.ndarray, lo: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Document, item, first and last word + 1, and words needed, of the places where seeds lo, lo + 1, ... lo + n - 1 begin at words ``at``."""
    seed, at = np.repeat(lo, n) + runs(n), np.repeat(at, n)
    doc, item = words.docs[at], items.item[seed]
    low, high = at - items.high[seed] - items.slack[item], at - items.low[seed] + items.size[item] + items.slack[item]
    order = np.lexsort((low, item, doc))
    doc, item, low, high, need = doc[order], item[order], low[order], high[order], items.need[seed[order]]
    pair = np.append(0, np.cumsum((np.diff(doc) != 0) | (np.diff(item) != 0))) * (high.max() - low.min() + 1)
    start = np.flatnonzero(np.append(True, (low + pair)[1:] > np.maximum.accumulate(high + pair)[:-1]))
    doc, item = doc[start], item[start]
    return [doc, item, np.maximum(words.first[doc], low[start]), np.minimum(words.first[doc + 1], np.maximum.reduceat(high, start)), np.minimum.reduceat(need, start)]


def holds(items: Items, own: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether so many of the item's words occur in own[lo:hi]."""
    out = np.zeros(len(item), bool)
    group = np.cumsum(hi - lo) // PAIRS
    for a, b in _ranges(group):
        salt, size = mix(np.arange(b - a).astype(U64)), items.size[item[a:b]]
        row, col = np.repeat(np.arange(b - a), hi[a:b] - lo[a:b]), np.repeat(np.arange(b - a), size)
        there = own[np.repeat(lo[a:b], hi[a:b] - lo[a:b]) + runs(hi[a:b] - lo[a:b])] + salt[row]
        sought = items.words[np.repeat(items.first[item[a:b]], size) + runs(size)] + salt[col]
        out[a:b] = np.bincount(col[np.isin(sought, there)], minlength=b - a) >= need[a:b]
    return out


def _ranges(group: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal values."""
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def align(items: Items, own: np.ndarray, words: Words, similarity: float) -> list[np.ndarray]:
    """Document, item, score share, first and last word + 1 of each item's best place in each document, where it reaches ``similarity``."""
    key, at = seeds_of(own, words)
    lo = np.searchsorted(items.keys, key, "left")
    n = np.searchsorted(items.keys, key, "right") - lo
    some = np.flatnonzero(n)
    empty = [np.zeros(0, np.int64)] * 5
    if not len(some):
        return empty
    some = some[np.argsort(at[some], kind="stable")]
    before, of = np.cumsum(n[some]), words.docs[at[some]]
    # documents stay whole
    found = [candidates(items, words, at[some[a:b]], lo[some[a:b]], n[some[a:b]]) for a, b in _ranges(before[np.searchsorted(of, of)] // PAIRS)]
    doc, item, lo, hi, need = (np.concatenate(x) for x in zip(*found, strict=True))
    ok = holds(items, own, item, lo, hi, need)
    doc, item, lo, hi = doc[ok], item[ok], lo[ok], hi[ok]
    if not len(doc):
        return empty
    share, end = np.zeros(len(lo)), np.zeros(len(lo), np.int64)
    order = np.argsort(hi - lo, kind="stable")
    for a, b in _ranges(np.cumsum((hi - lo)[order]) // (PAIRS >> 4)):
        o = order[a:b]
        share[o], end[o] = _scores(items, own, item[o], lo[o], hi[o])
    lo = np.maximum(lo, end - items.size[item] - items.slack[item])
    ok = share >= similarity
    doc, item, share, lo, end = doc[ok], item[ok], share[ok], lo[ok], end[ok]
    best = np.lexsort((lo, -share, items.ids[item], doc))
    first = np.append(True, (np.diff(doc[best]) > 0) | (np.diff(items.ids[item[best]]) != 0))[: len(best)]
    best = best[first]
    base = words.first[doc[best]]
    return [doc[best], item[best], share[best], lo[best] - base, end[best] - base]


def _scores(items: Items, own: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    def matrix(values, start, size, pad):
        out = np.full((len(size), int(size.max())), pad, U64)
        out[np.repeat(np.arange(len(size)), size), runs(size)] = values[np.repeat(start, size) + runs(size)]
        return out

    best, end = smith_waterman(matrix(items.words, items.first[item], items.size[item], 0), matrix(own, lo, hi - lo, 1))
    return best / (MATCH * items.size[item]), lo + end


def decontaminate(df: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, similarity, start, end: the documents that hold a benchmark item, exactly or edited, with each such item.

    Words are letters and digits with A-Z lower-cased. A document and an item are aligned wherever similarity can reach
    the bound, which is the Smith-Waterman score (match 2, mismatch and gap -1) over that of the item with itself; start and
    end bound the words of the alignment. A document without such an item has no row. Null or empty texts match nothing; rows
    with a null id are found like others; equal rows are found as often as they occur. Items are aligned
    whole, whatever their length. All items take part, about ITEMS or ITEM_BYTES at a time, so what is broadcast is bounded."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tests = benchmark.where(f"`{item_id}` is not null and `{text}` is not null").select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    size = tests.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    rounds = max(1, -(-size.n // ITEMS), -(-size.b // ITEM_BYTES))
    out = None
    for r in range(rounds):
        part = tests if rounds == 1 else tests.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r)
        found = _round(rows, read_items(part.toArrow(), similarity), similarity)
        out = found if out is None else out.unionByName(found)
    return out


def _round(rows: DataFrame, items: Items, similarity: float) -> DataFrame:
    context = rows.sparkSession.sparkContext
    distinct, where = np.unique(items.keys, return_inverse=True)
    all_keys = context.broadcast(distinct)

    def make_counts():
        keys = all_keys.value
        total = np.zeros(len(keys), np.int64)

        def f(batch, data, at):
            words = Words(data, at, ALNUM)
            key, place = seeds_of(words.hashes(fold=True), words)
            if len(keys):
                spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = np.flatnonzero(keys[spot] == key)
                total[:] += np.bincount(np.unique(words.docs[place[hit]] * len(keys) + spot[hit]) % len(keys), minlength=len(keys))

        def end():
            some = np.flatnonzero(total)
            yield [pa.array(some), pa.array(total[some])]

        f.end = end
        return f

    counted = map_texts(rows.select("text"), make_counts, "seed long, n long", text=0).groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(len(distinct), np.int64)
    seen[counted["seed"].to_numpy()] = counted["n"].to_numpy()
    seen = seen[where]
    chosen = context.broadcast(rare(items, seen))

    def make():
        items = chosen.value

        def f(batch, data, at):
            words = Words(data, at, ALNUM)
            doc, item, share, lo, hi = align(items, words.hashes(fold=True), words, similarity)
            if len(doc):
                return [batch.column(0).take(pa.array(doc)), pa.array(items.ids[item]), pa.array(share), pa.array(lo), pa.array(hi)]
            return None

        return f

    return map_texts(rows, make, "doc_id long, item_id long, similarity double, start long, end long")
