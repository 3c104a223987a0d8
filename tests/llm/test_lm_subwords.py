"""Every subword takes part in a text's score, which equals a plain forward pass, one place after the other."""

from __future__ import annotations

import zlib

import numpy as np

from tessera.llm import lm_scoring as L
from tessera.llm import queries

TEXTS = [f"warm winds unbelievably reconsidered the sunlight over zanzibar {i} times" for i in range(30)] + ["the sun is low"] * 3
#: Words that are known, and ones that are spelt only; over one window long.
ASKED = "the unbelievably quixotically reconsidered sunlight " * 5 + "over zanzibar"


def plain(voc, flat, members, ids: list[int], end: int):
    """For each place: natural log of the subword's class, of its share, and of all classes that begin a word."""
    p = {k: v.astype(float) for k, v in L.Attention.unpack(flat).p.items()}
    shown = [voc.input[end], *voc.input[ids[:-1]]]
    out = []
    for i, s in enumerate(ids):
        far = range(max(0, i // L.STEP * L.STEP - L.STEP), i + 1)
        scores = np.array([p["emb"][shown[i]] @ p["q"] @ p["k"].T @ p["emb"][shown[j]] * L.WIDTH**-0.5 + p["far"][i - j] for j in far])
        a = np.exp(scores - scores.max())
        h = np.concatenate([p["emb"][shown[i]], a @ p["val"][[shown[j] for j in far]] / a.sum(), [1.0]])
        e = np.exp(h @ p["out"])
        rank, share = voc.rank[s], voc.share[s] + members.rest[shown[i], voc.kind[s]]
        out.append((np.log(e[voc.kind[s]] / e.sum()), members.table[shown[i], rank] if rank < L.MEMBERS else share, np.log(e[: L.CLASSES - L.INNER].sum() / e.sum())))
    return out


def test_each_subword_is_scored(spark):
    path = queries.tokenizer("byte_bpe_50k.tiktoken")
    encoding, end, leads = L._encoding(path)
    voc, flat, members = L.train(L.gather(spark.createDataFrame([(t,) for t in TEXTS], "text string"), path), end, leads)
    asked = ASKED.split()
    spelling = [encoding.encode_ordinary(f" {w}") for w in asked] + [[end]]
    ids = [s for w in spelling for s in w]
    assert len(ids) > 2 * L.STEP and sum(len(w) > 1 for w in spelling) > 10
    got = plain(voc, flat, members, ids, end)

    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    train, held = [i for i in range(400) if fold(i)], next(i for i in range(400) if not fold(i))
    rows = [*zip(train, TEXTS, strict=False), (held, ASKED)]
    row = L.lm_score(spark.createDataFrame(rows, "doc_id long, text string"), path).where(f"doc_id = {held}").first()
    assert row.n_subwords == len(ids)

    count: dict[str | None, int] = {}
    for w in (w for t in TEXTS for w in [*t.split(), None]):
        count[w] = count.get(w, 0) + 1
    total, add = sum(count.values()), 0.1
    chance = lambda w: (count.get(w, 0) + add) / (total + add * (len(count) + 1))
    mass = np.zeros(L.CLASSES)
    for w in count:
        mass[voc.kind[end if w is None else encoding.encode_ordinary(f" {w}")[0]]] += chance(w)
    mass /= mass.sum()
    score, at = 0.0, 0
    for w, part in zip([*asked, None], spelling, strict=True):
        first, after = got[at], at + len(part)
        spelt = sum(c + m for c, m, _ in got[at:after]) - first[2] + (got[after][2] if after < len(ids) else 0)
        whole = (1 - L.MIX) + L.MIX * (1 - L.SPELT) * np.exp(first[0] - first[2]) / max(mass[voc.kind[part[0]]], 1e-300)
        score += np.log10(chance(w) * whole + L.MIX * L.SPELT * np.exp(spelt))
        at = after
    assert abs(row.score - score) < 1e-3 * abs(score)


def test_few_tasks_hand_on_sums(spark):
    """Sums are handed on by a few tasks a core, not by one for each small part of a table."""
    made = spark.sparkContext.accumulator(0)

    def make():
        made.add(1)
        return lambda ids, sizes: np.bincount(ids, minlength=10).astype(float)

    pack = lambda *ids: np.array(ids, "<i4").tobytes()
    rows = [(bytearray(pack(i % 10, 3)), bytearray(pack(2))) for i in range(100)]
    got = L.totals(spark.createDataFrame(rows, "ids binary, sizes binary").repartition(100), make, 10)
    assert got.tolist() == [10, 10, 10, 110, 10, 10, 10, 10, 10, 10]
    assert made.value <= L.TASKS * spark.sparkContext.defaultParallelism < 100


def test_frequent_words_are_found():
    """A word is found by its slot, or by a search if a more frequent one has that slot; others are not."""
    keys = np.sort(np.array([5, 5 + L.SLOTS, 5 - L.SLOTS, -9, 70, 2**62]))
    own = np.array([5, 5 + L.SLOTS, 5 - L.SLOTS, -9, 70, 2**62, 6, 5 + 2 * L.SLOTS, -10])
    spot, hit = L.Frequent(keys, np.log(np.arange(6) + 1.0))(own)
    assert hit.tolist() == [True] * 6 + [False] * 3 and keys[spot[hit]].tolist() == own[:6].tolist()
    assert not L.Frequent(keys[:0], keys[:0].astype(float))(own)[1].any()


def test_neighbours_stay_in_their_text():
    sizes = np.array([3, 0, 1, 5])
    got = {d: use.tolist() for use, d in L.after(np.array([0, 1, 2, 3, 4, 7, 8]), sizes, range(1, 4))}
    assert got == {1: [0, 1, 4, 7], 2: [0, 4], 3: [4]}


def test_subwords_are_counted_as_they_are_written(spark, monkeypatch):
    """No pass of its own counts the subwords, and their ids take two bytes where they fit."""
    path = queries.tokenizer("byte_bpe_50k.tiktoken")
    encoding, end, leads = L._encoding(path)
    packed = L.gather(spark.createDataFrame([(t,) for t in [*TEXTS, "", None]], "text string").repartition(3), path)
    want = [s for t in [*TEXTS, "", ""] for s in [*encoding.encode_ordinary("".join(f" {w}" for w in t.split())), end]]
    rows = packed.where("part >= 0").collect()
    assert L.id_type(end) == "<u2" and L.id_type(1 << 16) == "<i4"
    assert sorted(s for r in rows for s in np.frombuffer(r.ids, "<u2").tolist()) == sorted(want)
    passes, seen, totals = [], [], L.totals
    monkeypatch.setattr(L, "totals", lambda *a: passes.append(a[2]) or totals(*a))
    made = L.Vocabulary.__init__
    monkeypatch.setattr(L.Vocabulary, "__init__", lambda self, counts, *a: seen.append(counts) or made(self, counts, *a))
    L.train(packed, end, leads)
    assert passes == [(end + 1) * L.NEAR, L.INPUTS * (2 * L.CLASSES + L.MEMBERS)] + [L.Attention.SIZE + 1] * L.ROUNDS
    assert seen[0].tolist() == np.bincount(want, minlength=end + 1).tolist()
