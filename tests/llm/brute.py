"""Plain versions of the operators, row by row and pair by pair, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def lower(text: str) -> str:
    return text.translate(UPPER)


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def base_scores(docs: list[tuple[int, str | None]], add: float = 0.1) -> dict[int, tuple[int, int, int, float]]:
    tokens = {d: [*WORD.findall(lower(t or "")), None] for d, t in docs}
    count = Counter(x for d, ts in tokens.items() if crc(d) % 10 for x in ts)
    n, v = sum(count.values()), len(count)
    return {d: (len(ts), sum(count[x] > 0 for x in ts), n, sum(math.log10((count[x] + add) / (n + add * (v + 1))) for x in ts)) for d, ts in tokens.items()}


def quality_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def license_base(text: str | None) -> tuple[int, int, int | None, int | None, str]:
    words = ALNUM.findall(lower(text or ""))
    found = []
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def shingles(text: str | None, n: int) -> frozenset:
    words = WORD.findall(lower(text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < n else [tuple(words[i : i + n]) for i in range(len(words) - n + 1)])


def jaccard_components(docs: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t, n) for d, t in docs}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    by_gram: dict = {}
    for d, s in sets.items():
        for g in s:
            by_gram.setdefault(g, []).append(d)
    overlap: Counter = Counter()
    for ds in by_gram.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                overlap[min(a, b), max(a, b)] += 1
    for (a, b), o in overlap.items():
        if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def dedup(docs: list[tuple[int, str | None]], window: int) -> dict[int, tuple[int, int, str]]:
    words = {d: WORD.findall(t or "") for d, t in docs}
    first: dict = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, ws in words.items():
        gone = {i + j for i in range(len(ws) - window + 1) if first[tuple(ws[i : i + window])] < d for j in range(window)}
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out[d] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def smith_waterman(a: list, b: list) -> int:
    h, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, h[j - 1] + (2 if x == y else -1), h[j] - 1, new[-1] - 1))
        h, best = new, max(best, *new)
    return best


def leaks(docs: list[tuple[int, str | None]], items: list[tuple[int, str]], similarity: float) -> set[tuple[int, int]]:
    """All pairs aligned in full, whatever their seeds."""
    out = set()
    tests = [(i, ALNUM.findall(lower(t))) for i, t in items]
    for d, t in docs:
        words = ALNUM.findall(lower(t or ""))
        have = set(words)
        for i, item in tests:
            if item and sum(w in have for w in item) >= similarity * len(item) and smith_waterman(item, words) >= similarity * 2 * len(item):
                out.add((d, i))
    return out


def alternatives(pattern: str) -> list[str]:
    """A match for each choice that a pattern of words leaves, each repeat at its least and one more."""
    from re import _constants as k
    from re import _parser

    def build(tree) -> list[str]:
        out = [""]
        for op, arg in tree:
            if op is k.LITERAL:
                part = [chr(arg)]
            elif op is k.ANY:
                part = ["q"]
            elif op is k.IN:
                part = sorted({chr(c) for o, a in arg for c in ([a] if o is k.LITERAL else range(a[0], a[1] + 1))})
            elif op is k.SUBPATTERN:
                part = build(arg[3])
            elif op is k.BRANCH:
                part = [x for branch in arg[1] for x in build(branch)]
            elif op in (k.MAX_REPEAT, k.MIN_REPEAT):
                part = [x * arg[0] for x in build(arg[2])[:1]] + [x * (arg[0] + 1) for x in build(arg[2])]
            else:
                raise ValueError(op)
            out = [x + y for x in out for y in part]
        return out

    return sorted(set(build(_parser.parse(pattern))))


def dedup_rows(rows: list[tuple[int | None, str | None]], window: int) -> list[tuple[int | None, int, int, str]]:
    """dedup for rows with null and repeated ids: a row loses what a row of a smaller id holds; null ids take no part."""
    words = [WORD.findall(t or "") for _, t in rows]
    first: dict = {}
    for d, i in sorted((d, i) for i, (d, _) in enumerate(rows) if d is not None):
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), d)
    out = []
    for (d, _), ws in zip(rows, words, strict=True):
        starts = range(len(ws) - window + 1) if d is not None else ()
        gone = {i + j for i in starts if first[tuple(ws[i : i + window])] < d for j in range(window)}
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def component_rows(rows: list[tuple[int | None, str | None]], n: int, percent: int) -> list[tuple[int | None, int, int | None]]:
    """jaccard_components for rows with null and repeated ids: rows of one id are one document with several texts."""
    tagged = [(i, t) for i, (d, t) in enumerate(rows) if d is not None]
    linked = jaccard_components(tagged, n, percent)
    up: dict = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i, _ in tagged:
        x, y = root(rows[i][0]), root(rows[linked[i][1]][0])
        up[max(x, y)] = min(x, y)
    return [(d, len(shingles(t, n)), None if d is None else root(d)) for d, t in rows]


def mean_log_ratio(docs: list[str | None], trusted: list[str | None], buckets, n_buckets: int) -> list[float]:
    """Mean log ratio of each document, from plain counts; buckets(text) lists the buckets of a text's n-grams."""
    raw, target = Counter(), Counter()
    for t in docs:
        raw.update(buckets(t))
    for t in trusted:
        target.update(buckets(t))
    a, b = sum(raw.values()), sum(target.values())
    if not b:
        return [0.0] * len(docs)
    add = b / max(1, a)
    ratio = lambda k: math.log((target[k] + add) / (b + add * n_buckets)) - math.log((raw[k] + 1) / (a + n_buckets))
    return [sum(map(ratio, g)) / max(1, len(g)) for g in map(buckets, docs)]


def without(rows: list[tuple[int | None, str | None]], doc_id: int, text: str, window: int) -> str:
    """The text of one row with repeated words cut, the kept ones joined by spaces."""
    have = {tuple(w[j : j + window]) for d, t in rows if d is not None and d < doc_id for w in [WORD.findall(t or "")] for j in range(len(w) - window + 1)}
    words = WORD.findall(text)
    gone = {i + j for i in range(len(words) - window + 1) if tuple(words[i : i + window]) in have for j in range(window)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def toxic_sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence that has one; a sentence ends at a line end, !, . or ?."""
    return [w for s in re.split(r"[\n!.?]", text or "") if (w := ALNUM.findall(lower(s)))]


def noisy_or_scores(train: list[tuple[str, int]], ask: list[str | None], epochs: int = 80, rate: float = 10.0, decay: float = 2e-4) -> list[float]:
    """Scores of texts by the noisy-or model of labelled texts, fitted word by word; weights of words that speak for either class."""
    docs = [(toxic_sentences(t), y) for t, y in train]
    size = {k: max(1, sum(y == k for _, y in docs)) for k in (0, 1)}
    held = {k: Counter(w for s, y in docs if y == k for w in {w for x in s for w in x}) for k in (0, 1)}
    weight = {}
    for w in held[0] | held[1]:
        n = held[0][w] + held[1][w]
        odds = math.log((held[1][w] + 0.1) / (size[1] + 0.2)) - math.log((held[0][w] + 0.1) / (size[0] + 0.2))
        if n >= max(3, 0.01 * size[1]) and (odds > 2 or (odds < -1 and n >= 0.01 * len(docs))):
            weight[w] = (1.4 if odds > 0 else 0.5) * odds
    bias = -5.5
    p_of = lambda x: 1 / (1 + math.exp(-max(-30, min(30, sum(weight.get(w, 0) for w in x) + bias))))
    for _ in range(epochs):
        step, pull_sum = Counter(), 0.0
        for sentences, y in docs:
            ps = [p_of(x) for x in sentences]
            clean = math.prod(1 - p for p in ps)
            pull = (clean / max(1 - clean, 1e-9) if y else -1.0) * 0.5 / size[y]
            for x, p in zip(sentences, ps, strict=True):
                pull_sum += pull * p
                for w in x:
                    step[w] += pull * p
        for w in weight:
            weight[w] += rate * (step[w] - decay * weight[w])
        bias += min(0.1, max(-0.1, pull_sum))
    return [1 - math.prod(1 - p_of(x) for x in toxic_sentences(t)) for t in ask]
