"""Language-model scores: a causal self-attention model on subword ids beside an add-0.1 unigram over words.

The network scores every subword and the end once, in two steps: it tells how likely each class of subwords is, given those before, and
within its class a subword has a share that depends on the one before it. A word is spelt so, subword by subword up to its end, or it
comes whole, with its unigram share of the class of its first subword; its probability is a fixed mixture of both. The texts are encoded once for training: one pass writes the subword ids of the training documents, dealt into ROUNDS by a hash of the
text, and the counts of words. From these ids Spark sums integer counts, which give subword classes, shares and the start of the network,
and then one gradient a round: every window of every training document takes part once, in one step that all tasks make together, so
partitions, tasks and the order of rows have no effect but on rounding. Nothing that grows with the vocabulary reaches one place: the
counts of the most frequent words, a fixed number, are broadcast, and the others are joined.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import U64, Memo, Words, fold_of, lists, map_texts, runs, shared_dir, signed, written

#: Words whose counts are broadcast at most; the counts of others are joined.
FREQUENT = 1 << 17
#: Slots of the table that finds them.
SLOTS = 1 << 19
#: Tokens that a window moves on by; each sees itself, what stands before it in its step, and the step before.
STEP = 16
#: Size of embeddings, classes of subwords, those of one subword, those of subwords inside words, embeddings of inputs, and subwords whose
#: neighbourhood tells classes apart.
WIDTH, CLASSES, OWN, INNER, INPUTS, NEAR = 8, 64, 24, 16, 1024, 32
#: Most frequent subwords that are counted after each input; the others have one share of their class after all inputs. How many places the latter is worth.
MEMBERS, BELIEF = 2048, 2.0
#: Steps of windows that are worked on together.
BATCH = 128
#: Tokens of several rows of ids that are worked on together.
TOGETHER = 1 << 20
#: Tasks a core at most that add up sums.
TASKS = 3
#: Gradient steps, each on its own part of the documents, and their size.
ROUNDS, RATE = 8, 0.05
#: The network's part in a word's probability; the rest is the smoothed unigram's.
MIX = 0.95
#: The part of spelt words in the network's part.
SPELT = 0.2
END_KEY = -1  # in the word counts, for the end of a text
COUNTS, PLAIN = -1, -2  # in the written table, instead of a round: counts of words, and of subwords


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"[^\n]+|\n"  # words come one a line
    leads = np.zeros(len(ranks) + 1, bool)
    leads[[i for x, i in ranks.items() if x.startswith(b" ")]] = leads[len(ranks)] = True
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), len(ranks), leads


class Subwords:
    """Subword ids of words in lower case with a space before them; id ``end`` ends a text. ``leads`` tells the ids that begin a word, and the end."""

    def __init__(self, path: str):
        self.encoding, self.end, self.leads = _encoding(path)
        self.line = self.encoding.encode_ordinary("\n")[0]
        self.known = Memo(1 << 20, 1 << 22)

    def __call__(self, data: np.ndarray, words: Words, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words one after the other, and the number of each word's."""

        def encode(one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            size = words.ends[one] - words.starts[one] + 2
            ends = np.cumsum(size)
            out = np.full(ends[-1], 0x20, np.uint8)
            inner = np.ones(len(out), bool)
            inner[ends - 1] = inner[ends - size] = False
            raw = data[np.repeat(words.starts[one], size - 2) + runs(size - 2)]
            out[inner] = raw + 32 * ((raw >= 0x41) & (raw <= 0x5A)).astype(np.uint8)
            out[ends - 1] = 0x0A
            ids = np.array(self.encoding.encode_ordinary(out.tobytes().decode("utf-8", "replace")), np.int32)
            line = np.flatnonzero(ids == self.line)
            return np.delete(ids, line), np.diff(line, prepend=-1) - 1

        return self.known.look(keys.view(U64), encode)


def word_keys(words: Words) -> np.ndarray:
    """Signed keys of case-folded words; none is END_KEY or 0."""
    keys = signed(words.hashes(fold=True))
    return np.where((keys == END_KEY) | (keys == 0), END_KEY - 1, keys)


def sequences(subwords: Subwords, data: np.ndarray, at: np.ndarray, words: Words, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subword ids of all documents, each followed by the end id, the number of each document's with its end, and of each word's."""
    ids, counts = subwords(data, words, keys)
    before = np.concatenate([[0], np.cumsum(counts)])[words.first]
    per_doc = np.diff(before)
    return np.insert(ids, before[1:], subwords.end), per_doc + 1, counts


def gather(df: DataFrame, path: str) -> DataFrame:
    """(part, ids, sizes, key, n, lead) of the texts of df (text), written to the shared folder: in part COUNTS, partial counts of words
    and ends with the first subword of each; in part PLAIN, partial counts of subwords, by id; in the part of a round, the subword ids of
    some documents one after the other (``id_type``) and the size of each, as little-endian numbers."""

    def make():
        reuse_memory()
        subwords = Subwords(path)
        kind, plain = id_type(subwords.end), np.zeros(subwords.end + 1, np.int64)
        held: list[tuple[np.ndarray, ...]] = []

        def counted():
            one = [np.array([len(held[0][0])])] * 3
            out = [pa.array([COUNTS], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *map(lists, held[0], one)]
            held.clear()
            return out

        def squeeze():
            keys, counts, leads = (np.concatenate(x) for x in zip(*held, strict=True))
            key, at, where = np.unique(keys, return_index=True, return_inverse=True)
            held[:] = [(key, np.bincount(where, weights=counts).astype(np.int64), leads[at])]

        def f(batch, data, at):
            words = Words(data, at)
            keys = word_keys(words)
            seq, size, _ = sequences(subwords, data, at, words, keys)
            plain[:] += np.bincount(seq, minlength=len(plain))
            leads = seq[subwords.leads[seq]]
            key, place, n = np.unique(np.insert(keys, words.first[1:], END_KEY), return_index=True, return_counts=True)
            held.append((key, n, leads[place]))
            part = np.asarray(batch.column(1))
            of = np.repeat(part, size)
            own = np.unique(part)
            out = [[pa.array(own, pa.int32()), pa.array([seq[of == r].astype(kind).tobytes() for r in own], pa.binary()), pa.array([size[part == r].astype("<i4").tobytes() for r in own], pa.binary()), *(pa.nulls(len(own), pa.list_(x)) for x in (pa.int64(), pa.int64(), pa.int32()))]]
            if len(held) >= 8:
                squeeze()
            if len(held[0][0]) > 500_000:  # a task's memory stays bounded: Spark adds up what was handed on before
                squeeze()
                out.append(counted())
            return [pa.concat_arrays(x) for x in zip(*out, strict=True)]

        def end():
            if held:
                squeeze()
                yield counted()
                some = np.flatnonzero(plain)
                one = np.array([len(some)])
                yield [pa.array([PLAIN], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), lists(some, one), lists(plain[some], one), pa.nulls(1, pa.list_(pa.int32()))]

        f.end = end
        return f

    rounds = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(ROUNDS)).cast("int")
    packed = map_texts(df.select("text", rounds.alias("part")), make, "part int, ids binary, sizes binary, key array<long>, n array<long>, lead array<int>", text=0)
    out = f"{shared_dir(df.sparkSession)}/parts-{uuid.uuid4().hex}"
    packed.write.partitionBy("part").parquet(out)
    return df.sparkSession.read.schema(packed.schema).parquet(out)


def id_type(end: int) -> str:
    """The type of ids up to ``end`` where they are written: half as wide if they fit."""
    return "<u2" if end < 1 << 16 else "<i4"


def totals(packed: DataFrame, make, size: int, kind: str = "<i4") -> np.ndarray:
    """Sums over all rows of packed (ids of the type ``kind``, sizes) of an array of ``size`` numbers: make() is called once a task and gives f(ids, sizes) -> array.

    Each task adds up its own; Spark adds up the tasks'. The driver gets ``size`` numbers at most. A task reads its rows in a stream but
    hands on up to ``size`` sums, so there are a few tasks a core, not one for each small part of the table."""
    whole = packed.select("ids", "sizes").coalesce(TASKS * packed.sparkSession.sparkContext.defaultParallelism)

    def run(batches):
        reuse_memory()
        f, total = make(), np.zeros(size)
        for ids, sizes in _joined(batches, kind):
            total += f(ids, sizes)
        some = np.flatnonzero(total)
        for lo in range(0, len(some), 100_000):
            k = some[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], ["i", "w"])

    got = whole.mapInArrow(run, "i int, w double").groupBy("i").agg(F.sum("w").alias("w")).toArrow()
    out = np.zeros(size)
    out[got["i"].to_numpy()] = got["w"].to_numpy()
    return out


def _joined(batches, kind: str):
    """Ids and sizes of rows (ids, sizes) as arrays, some rows together."""
    held, n = [], 0
    for batch in batches:
        for row in zip(batch.column(0), batch.column(1), strict=True):
            held.append(tuple(np.frombuffer(x.as_buffer(), t).astype(np.int64) for x, t in zip(row, (kind, "<i4"), strict=True)))
            n += len(held[-1][0])
            if n > TOGETHER:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


class Vocabulary:
    """Classes of subwords: the most frequent ones that begin a word have one each, the others share classes of like neighbourhood, those
    inside words apart; and the embedding of each subword as an input: one for each of the most frequent, and one for each class.

    ``chance`` is the smoothed unigram, ``share`` the natural log of a subword's part of its class."""

    def __init__(self, counts: np.ndarray, near: np.ndarray, leads: np.ndarray):
        """counts of the subwords; near: how often each of the NEAR most frequent ones stands shortly before each."""
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        head = order[leads[order]][:OWN]
        rest = leads.copy()
        rest[head] = False
        self.kind = np.where(leads, OWN + groups(near, counts, rest, CLASSES - OWN - INNER), CLASSES - INNER + groups(near, counts, ~leads, INNER))
        self.kind[head] = np.arange(len(head))
        self.input = np.where(rank < INPUTS - CLASSES, rank, INPUTS - CLASSES + self.kind)
        self.rank = rank
        self.chance = (counts + 0.1) / (counts + 0.1).sum()
        weight = counts + 0.1
        total = np.bincount(self.kind, weights=weight, minlength=CLASSES) + 1e-3
        self.share = np.log(weight / total[self.kind])
        self.prior = np.log(total / total.sum()).astype(np.float32)


class Members:
    """The share of each subword of its class after each input: how often it stands there, and BELIEF times its share after all inputs."""

    def __init__(self, voc: Vocabulary, pairs: np.ndarray):
        """pairs [INPUTS, MEMBERS]: how often each of the most frequent subwords stands right after each input."""
        order = np.argsort(voc.rank)[:MEMBERS]
        kind = voc.kind[order]
        sums = np.stack([np.bincount(kind, weights=row[: len(kind)], minlength=CLASSES) for row in pairs]) + BELIEF
        self.table = np.zeros(pairs.shape, np.float32)
        self.table[:, : len(kind)] = np.log((pairs[:, : len(kind)] + BELIEF * np.exp(voc.share[order])) / sums[:, kind])
        self.rest = np.log(BELIEF / sums).astype(np.float32)  # to be added to the share of a rare subword

    def logs(self, voc: Vocabulary, shown: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Natural log of the share of each subword of seq after the inputs shown."""
        rank = voc.rank[seq]
        out = self.table[shown, np.minimum(rank, MEMBERS - 1)].astype(np.float64)
        rare = np.flatnonzero(rank >= MEMBERS)
        out[rare] = voc.share[seq[rare]] + self.rest[shown[rare], voc.kind[seq[rare]]]
        return out


def after(use: np.ndarray, sizes: np.ndarray, far: range) -> Iterator[tuple[np.ndarray, int]]:
    """For each distance d, those of the places ``use`` of tokens with a token of their document d places after them."""
    rest = (np.repeat(np.cumsum(sizes, dtype=np.int32), sizes) if len(use) else use)[use] - use
    for d in far:
        yield use[rest > d], d


def groups(near: np.ndarray, counts: np.ndarray, use: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """A group of 0..k-1 for each subword of ``use``: k-means by cosine of the log ratios of its neighbourhood, weighing by count."""
    out = np.zeros(len(counts), np.int64)
    of = np.flatnonzero(use)
    share = near.sum(0) / max(1.0, near.sum())
    strength = near[of].sum(1, keepdims=True)
    x = np.log((near[of] + 8 * share + 1e-9) / ((strength + 8) * share + 1e-9))
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    weight = np.sqrt(counts[of] + 1.0)
    frequent = of[np.argsort(-counts[of], kind="stable")]
    centres = x[np.searchsorted(of, frequent[:k])]
    if len(centres) < k:
        centres = np.concatenate([centres, np.zeros((k - len(centres), x.shape[1]))])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        centres = np.stack([np.bincount(own, weights=weight * x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-9
    out[of] = (x @ centres.T).argmax(1)
    return out


#: Sums over all classes, and over those that begin a word.
SUMS = np.stack([np.ones(CLASSES), np.arange(CLASSES) < CLASSES - INNER], axis=1).astype(np.float32)

#: Where each weight of an input stands among those of all inputs.
PLACES = np.arange(INPUTS * WIDTH).reshape(INPUTS, WIDTH)


class Attention:
    """One causal self-attention layer over windows and class logits, in numpy with its own gradients."""

    SHAPES = {"emb": (INPUTS, WIDTH), "val": (INPUTS, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "far": (2 * STEP,), "out": (2 * WIDTH + 1, CLASSES)}
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, weights: dict[str, np.ndarray]):
        self.p = p = weights
        i, j = np.arange(STEP)[:, None], np.arange(2 * STEP)[None]
        self.gap = np.clip(STEP + i - j, 0, 2 * STEP - 1)  # how far key j is behind query i
        self.hidden = j > STEP + i
        self.bias = np.where(self.hidden, np.float32(-1e9), p["far"][self.gap])
        self.table = np.concatenate([p["emb"], p["val"], np.ones((INPUTS, 1), np.float32)], axis=1)
        self.m = (p["q"] @ p["k"].T) * np.float32(WIDTH**-0.5)
        self.asks = p["emb"] @ self.m
        self.turned = np.ascontiguousarray(p["emb"].T)
        # whether what is raised to a power can pass 60 at all: what is attended to is a mean of rows of val
        self.steep = (self.asks @ p["emb"].T).max() + p["far"].max() > 60
        self.high = ((p["emb"] @ p["out"][:WIDTH]).max(0) + (p["val"] @ p["out"][WIDTH:-1]).max(0) + p["out"][-1]).max() > 60

    @classmethod
    def start(cls, voc: Vocabulary, next_: np.ndarray, later: np.ndarray) -> Attention:
        """The network before training: low-rank factors of how much likelier each class is right after an input (next_), and shortly
        after it (later), both counts [INPUTS, CLASSES]; attention is even."""
        rng = np.random.default_rng(7)
        sides, outs = [], []
        for counts, sharp in ((next_, 1.0), (later, 3.0)):
            base = np.exp(voc.prior.astype(np.float64))
            n = counts.sum(1, keepdims=True)
            lift = np.log((counts + 20 * base) / ((n + 20) * base))
            weigh_in, weigh_out = np.sqrt(n / max(1.0, n.sum()) + 1e-9), np.sqrt(base)
            u, s, v = np.linalg.svd(weigh_in * lift * weigh_out, full_matrices=False)
            root = np.sqrt(s[:WIDTH])
            sides.append(u[:, :WIDTH] * root / weigh_in)
            outs.append(sharp * (root[:, None] * v[:WIDTH]) / weigh_out)
        small = lambda: rng.normal(size=(WIDTH, WIDTH)) * 0.1
        p = {"emb": sides[0], "val": sides[1], "q": small(), "k": small(), "far": np.zeros(2 * STEP), "out": np.concatenate([*outs, voc.prior[None]])}
        return cls({k: x.astype(np.float32) for k, x in p.items()})

    @classmethod
    def unpack(cls, flat: np.ndarray) -> Attention:
        out, at = {}, 0
        for k, s in cls.SHAPES.items():
            n = int(np.prod(s))
            out[k], at = flat[at : at + n].reshape(s).astype(np.float32), at + n
        return cls(out)

    def pack(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES])

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        """x: input ids of a step and of the steps to work on, one after the other; first: which of these have nothing before them.

        Logits are of all places of the steps: padding is little, and picking the other places costs more."""
        n = len(first)
        t = self.table.take(x, axis=0)
        # window i is step i and the one before it: a view, nothing is copied
        win = np.lib.stride_tricks.as_strided(t, (n, 2 * STEP, t.shape[1]), (STEP * t.strides[0], *t.strides))
        e, v = win[..., :WIDTH], win[..., WIDTH:]
        q = self.asks.take(x[STEP:], axis=0).reshape(n, STEP, WIDTH)
        s = q @ e.transpose(0, 2, 1)
        s += self.bias
        s[first, :, :STEP] = -1e9
        if self.steep:
            np.minimum(s, np.float32(60), out=s)
        a = np.exp(s, out=s)
        # what is narrow lies with the places side by side: numpy is slow over short rows
        c = np.empty((WIDTH + 1, n, STEP), np.float32)
        np.matmul(v.transpose(0, 2, 1), a.transpose(0, 2, 1), out=c.transpose(1, 0, 2))
        c = c.reshape(WIDTH + 1, -1)  # the last row of v is 1: it gives the sum of a
        h = np.ones((2 * WIDTH + 1, n * STEP), np.float32)
        self.turned.take(x[STEP:], axis=1, out=h[:WIDTH], mode="clip")
        np.divide(c[:-1], c[-1], out=h[WIDTH:-1])
        z = h.T @ self.p["out"]
        if self.high:
            np.minimum(z, np.float32(60), out=z)
        return {"e": e, "v": v, "q": q, "a": a, "sum": c[-1], "h": h, "z": z}

    def log_probs(self, x: np.ndarray, first: np.ndarray, at: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log-probability of the class y at each place of ``at``."""
        return self.log_probs_and_ends(x, first, at, y)[0]

    def log_probs_and_ends(self, x: np.ndarray, first: np.ndarray, at: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log-probability, at each place of ``at``, of the class y, and of all classes that begin a word or end the text."""
        z = self.forward(x, first)["z"]
        hit = z.ravel()[at * CLASSES + y]
        sums = np.log((np.exp(z, out=z) @ SUMS)[at])
        return hit - sums[:, 0], sums[:, 1] - sums[:, 0]

    def gradients(self, x: np.ndarray, first: np.ndarray, at: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sum over the places of ``at`` of the gradient of the negative log-probability of the class y, packed."""
        p, t, n = self.p, self.forward(x, first), len(first)
        g = np.exp(t["z"], out=t["z"])
        sums = g @ np.ones(CLASSES, np.float32)
        # a place's row of g is the gradient times its sum: the narrow factors are divided, and those of padding are 0
        g.ravel()[at * CLASSES + y] -= sums[at]
        part = np.zeros(n * STEP, np.float32)
        part[at] = 1 / sums[at]
        d = {"out": (t["h"] * part) @ g}
        gh = p["out"][:-1] @ g.T
        gh *= part
        # with minus what all keys have in common beside the 1 of v
        go = np.empty((WIDTH + 1, n * STEP), np.float32)
        np.divide(gh[WIDTH:], t["sum"], out=go[:-1])
        np.negative((go[:-1] * t["h"][WIDTH:-1]).sum(0), out=go[-1])
        go = go.reshape(WIDTH + 1, n, STEP).transpose(1, 2, 0)
        gs = go @ t["v"].transpose(0, 2, 1)
        gs *= t["a"]
        d["far"] = np.bincount(self.gap.ravel(), weights=np.where(self.hidden, 0, gs.sum(0)).ravel(), minlength=2 * STEP)
        gq = np.empty((WIDTH, n, STEP), np.float32)
        np.matmul(t["e"].transpose(0, 2, 1), gs.transpose(0, 2, 1), out=gq.transpose(1, 0, 2))
        gq = gq.reshape(WIDTH, -1)
        gm = t["h"][:WIDTH] @ gq.T * np.float32(WIDTH**-0.5)
        d["q"], d["k"] = gm @ p["k"], gm.T @ p["q"]
        own = self.m @ gq
        own += gh[:WIDTH]
        # sums over the places of each input
        place = PLACES.take(x, axis=0).ravel()
        for name, rest, spread in (("emb", own, gs.transpose(0, 2, 1) @ t["q"]), ("val", None, t["a"].transpose(0, 2, 1) @ go[..., :-1])):
            spread = spread.reshape(n, -1)
            rows = np.zeros((n + 1, STEP * WIDTH), np.float32)
            rows[1:] = spread[:, STEP * WIDTH :]
            rows[:-1] += spread[:, : STEP * WIDTH]
            if rest is not None:
                rows.reshape(-1, WIDTH)[STEP:] += rest.T
            d[name] = np.bincount(place, weights=rows.ravel(), minlength=INPUTS * WIDTH)
        return np.concatenate([d[k].ravel() for k in self.SHAPES])


class Adam:
    """Steps of one size in each weight, less for weights whose gradients disagree; sums of gradients are divided by the tokens."""

    def __init__(self, model: Attention):
        self.model, self.n = model, 0
        self.m, self.v = np.zeros(Attention.SIZE), np.zeros(Attention.SIZE)

    def step(self, g: np.ndarray) -> None:
        self.n += 1
        self.m += 0.2 * (g - self.m)
        self.v += 0.1 * (g * g - self.v)
        rate = RATE / (1 + self.n / ROUNDS)
        move = (self.m / (1 - 0.8**self.n)) / (np.sqrt(self.v / (1 - 0.9**self.n)) + 1e-6)
        self.model = Attention.unpack(self.model.pack() - rate * move)


def windows(seq: np.ndarray, counts: np.ndarray, end: int, voc: Vocabulary) -> tuple[np.ndarray, ...]:
    """Steps of all documents: input ids, after one step of nothing; which steps are a document's first; and each token's place in them.

    A document's first input is the end id; its steps are padded at the end."""
    steps = -(-counts // STEP)
    start = np.cumsum(steps) - steps
    ends = np.cumsum(counts)
    spot = np.arange(len(seq)) + np.repeat(start * STEP - ends + counts, counts)
    n = int(steps.sum())
    shown = voc.input[seq]
    shown[1:] = shown[:-1].copy()
    shown[(ends - counts)[counts > 0]] = voc.input[end]
    x = np.zeros((n + 1) * STEP, np.int16)
    x[spot + STEP] = shown
    first = np.zeros(n, bool)
    first[start[steps > 0]] = True
    return x, first, spot


def batches_of(x: np.ndarray, first: np.ndarray, at: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Parts of BATCH steps: their inputs with the step before them, which are first, and the places of ``at`` in them with their y."""
    cuts = np.searchsorted(at, np.arange(0, len(first) + BATCH, BATCH) * STEP)
    for i, lo in enumerate(range(0, len(first), BATCH)):
        k = slice(cuts[i], cuts[i + 1])
        yield x[lo * STEP : (lo + BATCH + 1) * STEP], first[lo : lo + BATCH], at[k] - lo * STEP, y[k]


def reuse_memory() -> None:
    """Frees one large block: from then on the C library serves arrays of up to that size from memory it keeps, instead of mapping new
    pages for each."""
    np.ones(24 << 20, np.uint8)


def train(packed: DataFrame, end: int, leads: np.ndarray) -> tuple[Vocabulary, np.ndarray, Members]:
    """The classes, the network's weights and the shares of classes from packed subword ids: counts over all documents, then ROUNDS
    gradient steps, each on the sum over all windows of that round's documents."""
    spark = packed.sparkSession
    texts = packed.where(F.col("part") >= 0)
    kind = id_type(end)
    counts = np.zeros(end + 1)
    plain = packed.where(F.col("part") == PLAIN).select(F.explode(F.arrays_zip("key", "n")).alias("c")).groupBy("c.key").agg(F.sum("c.n").alias("n")).toArrow()
    counts[plain["key"].to_numpy()] = plain["n"].to_numpy()
    top = np.argsort(-counts, kind="stable")[:NEAR]
    slot = np.full(end + 1, -1, np.int8)
    slot[top] = np.arange(NEAR)

    def make_near():
        def f(seq, sizes):
            own = slot[seq]
            pairs = [seq[a + d] * NEAR + own[a] for a, d in after(np.flatnonzero(own >= 0), sizes, range(1, 4))]
            return np.bincount(np.concatenate(pairs), minlength=(end + 1) * NEAR)

        return f

    voc = Vocabulary(counts, totals(texts, make_near, (end + 1) * NEAR, kind).reshape(-1, NEAR), leads)
    shared = spark.sparkContext.broadcast(voc)

    def make_pairs():
        voc = shared.value

        def f(seq, sizes):
            shown, kind = voc.input[seq], voc.kind[seq]
            out = []
            inside = runs(sizes)
            for far in (range(1, 2), range(3, 12, 4)):
                pairs = ((shown[:-d] * CLASSES + kind[d:])[inside[d:] >= d] for d in far)
                out.append(sum(np.bincount(p, minlength=INPUTS * CLASSES) for p in pairs))
            # the first subword of a document stands after the end of another
            last = np.roll(shown, 1)
            last[np.cumsum(sizes) - sizes] = voc.input[end]
            rank = voc.rank[seq]
            some = np.flatnonzero(rank < MEMBERS)
            out.append(np.bincount(last[some] * MEMBERS + rank[some], minlength=INPUTS * MEMBERS))
            return np.concatenate(out)

        return f

    sums = totals(texts, make_pairs, INPUTS * (2 * CLASSES + MEMBERS), kind)
    pairs, members = np.split(sums, [2 * INPUTS * CLASSES])
    adam = Adam(Attention.start(voc, *pairs.reshape(2, INPUTS, CLASSES)))
    for r in range(ROUNDS):
        now = spark.sparkContext.broadcast((voc, adam.model.pack()))

        def make_gradient(now=now):
            voc, flat = now.value
            model = Attention.unpack(flat)

            def f(seq, sizes):
                x, first, spot = windows(seq, sizes, end, voc)
                y = voc.kind[seq]
                g = np.zeros(Attention.SIZE + 1)
                for part in batches_of(x, first, spot, y):
                    g[:-1] += model.gradients(*part)
                g[-1] = len(y)
                return g

            return f

        g = totals(packed.where(F.col("part") == r), make_gradient, Attention.SIZE + 1, kind)
        if g[-1]:
            adam.step(g[:-1] / g[-1])
    return voc, adam.model.pack(), Members(voc, members.reshape(INPUTS, MEMBERS))


def word_odds(model: Attention, voc: Vocabulary, members: Members, masses: np.ndarray, seq: np.ndarray, x: np.ndarray, first: np.ndarray, place: np.ndarray, subwords: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """For each word and end of the subwords seq: by what its unigram probability is to be multiplied, and the natural log of what is to
    be added, which is that it is spelt as it is."""
    y = voc.kind[seq]
    parts = [model.log_probs_and_ends(*part) for part in batches_of(x, first, place, y)]
    if not parts:
        return np.zeros(0), np.zeros(0)
    of_class, ends = (np.concatenate(a).astype(np.float64) for a in zip(*parts, strict=True))
    of_all = of_class + members.logs(voc, x[place + STEP], seq)
    lead = np.flatnonzero(subwords.leads[seq])
    # all subwords of a word, and that another begins after them; that one began here is settled by the one before
    spelt = np.add.reduceat(of_all, lead) - ends[lead]
    spelt[:-1] += np.where(seq[lead[:-1]] == subwords.end, 0, ends[lead[1:]])
    whole = (1 - MIX) + MIX * (1 - SPELT) * np.exp(of_class[lead] - ends[lead] - masses[y[lead]])
    return whole, spelt + np.log(MIX * SPELT)


class Frequent:
    """The places of words among the sorted keys of the frequent ones: most are found in a table of slots, the others by a search."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.keys, self.slots = keys, np.zeros(SLOTS, np.int32)
        order = np.argsort(logs, kind="stable")
        self.slots[keys[order] & (SLOTS - 1)] = order  # of two words in a slot the more frequent one has it

    def __call__(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word, and whether it is there at all."""
        if not len(self.keys):
            return np.zeros(len(own), np.int64), np.zeros(len(own), bool)
        spot = self.slots[own & (SLOTS - 1)].astype(np.int64)
        hit = self.keys[spot] == own
        other = np.flatnonzero(~hit)
        spot[other] = np.minimum(np.searchsorted(self.keys, own[other]), len(self.keys) - 1)
        hit[other] = self.keys[spot[other]] == own[other]
        return spot, hit


def lm_score(df: DataFrame, path: str, held_out_fold: int = 0, folds: int = 10, add: float = 0.1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords: one row per input row.

    Documents whose crc32 of the id as text is ``held_out_fold`` modulo ``folds`` take no part in counts and training; a row with
    a null id does. base_score is the log10 probability of its words and its end under the smoothed unigram. score is the model's: the
    network gives the class of each subword (``path``: a rank file) a probability, given the subwords before it in its window. Of a
    word's probability 1 - MIX is its unigram probability; of the rest, SPELT is the product over its subwords of class and share in
    the class, up to the word's end, and 1 - SPELT that of the first one's class times the word's unigram share of the class. A word
    that is not known has the smoothed unigram's probability of one. A null text counts as empty: one token, the end. Rows of
    one id and text have one score. With no training text every word is unknown and base_score uses the smoothing alone.
    """
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    fold = fold_of("doc_id", folds)
    packed = gather(rows.where(fold != held_out_fold), path)
    partial = packed.where(F.col("part") == COUNTS).select(F.explode(F.arrays_zip("key", "n", "lead")).alias("c")).select("c.key", "c.n", "c.lead")
    words = written(partial.groupBy("key").agg(F.sum("n").alias("n"), F.min("lead").alias("lead")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # the smallest count that at most FREQUENT words reach, from a histogram of some hundred rows
    scale = F.floor(F.log2("n") * 16)
    bins = sorted(((r.b, r.c) for r in words.groupBy(scale.alias("b")).agg(F.count("*").alias("c")).collect()), reverse=True)
    reach, low = 0, None
    for b, c in bins:
        reach += c
        if reach > FREQUENT:
            break
        low = b
    frequent = words.where(scale >= F.lit(low if low is not None else 1 << 20))
    top = frequent.orderBy("key").toArrow()  # at most FREQUENT rows
    _, end, leads = _encoding(path)
    voc, weights, members = train(packed, end, leads)
    logs = np.log10((top["n"].to_numpy() + add) / (total.n + add * (total.v + 1)))
    # the unigram's probability of each class of words: at most one row for each subword reaches the driver
    by_lead = words.groupBy("lead").agg((F.sum("n") + add * F.count("*")).alias("m")).toArrow()
    mass = np.zeros(CLASSES)
    np.add.at(mass, voc.kind[by_lead["lead"].to_numpy()], by_lead["m"].to_numpy() / (total.n + add * (total.v + 1)))
    shared = spark.sparkContext.broadcast((voc, weights, members, top["key"].to_numpy(), logs, np.log(np.maximum(mass, 1e-300) / max(mass.sum(), 1e-300))))

    def make():
        reuse_memory()
        voc, flat, members, keys, logs, masses = shared.value
        subwords, model, find, odds = Subwords(path), Attention.unpack(flat), Frequent(keys, logs), 10**logs

        def f(batch, data, at):
            n = len(at) - 1
            words = Words(data, at)
            own = word_keys(words)
            seq, size, _ = sequences(subwords, data, at, words, own)
            x, first, place = windows(seq, size, subwords.end, voc)
            whole, spelt = word_odds(model, voc, members, masses, seq, x, first, place, subwords)
            own, docs = np.insert(own, words.first[1:], END_KEY), np.insert(words.docs, words.first[1:], np.arange(n))
            spot, hit = find(own)
            base = np.bincount(docs[hit], weights=logs[spot[hit]], minlength=n)
            score = np.bincount(docs[hit], weights=np.log10(odds[spot[hit]] * whole[hit] + np.exp(spelt[hit])), minlength=n)
            per = np.bincount(docs[~hit], minlength=n)
            longs = lambda a: pa.array(a.astype(np.int64))
            return [batch.column(0), longs(words.counts + 1), longs(np.bincount(docs[hit], minlength=n)), pa.array(base), pa.array(score), longs(size), lists(own[~hit], per), *(lists(a[~hit].astype(np.float32), per) for a in (whole, spelt))]

        return f

    schema = "doc_id long, n_tokens long, n_known long, base double, mixed double, n_subwords long, rare array<long>, whole array<float>, spelt array<float>"
    # a row's number in the written table tells rows with one id apart
    scored = written(map_texts(rows, make, schema).withColumn("row", F.monotonically_increasing_id()))
    each = scored.select("row", F.explode(F.arrays_zip("rare", "whole", "spelt")).alias("r")).select("row", F.col("r.rare").alias("key"), "r.whole", "r.spelt")
    known = words.where(scale < F.lit(low)) if low is not None else words
    chance = (F.coalesce("n", F.lit(0)) + F.lit(add)) / F.lit(total.n + add * (total.v + 1))
    joined = each.join(known, "key", "left").select("row", F.log10(chance).alias("base"), F.log10(chance * F.col("whole") + F.exp("spelt")).alias("mixed"), F.col("n").isNotNull().cast("int").alias("known"))
    looked = joined.groupBy("row").agg(F.sum("base").alias("more"), F.sum("mixed").alias("more_mixed"), F.sum("known").alias("more_known"))
    return scored.drop("rare", "whole", "spelt").join(looked, "row", "left").select(
        "doc_id", (fold == held_out_fold).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("mixed") + F.coalesce("more_mixed", F.lit(0.0))).alias("score"), "n_subwords",
    )
