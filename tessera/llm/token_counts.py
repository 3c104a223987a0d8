"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import map_texts

#: The pre-token pattern of byte-level BPE, with Unicode white space spelt out.
_WS = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
CACHE = 200_000
_NONE = np.int32(2**31 - 1)


class ByteBpe:
    """The merges of a tokenizer file, as sorted keys to probe."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        # byte-level files write each byte as one printable character: itself if printable, else the next free one from 256 on
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(own)]
        shown = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.first = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        a, b, c = (np.array(x, np.int64) for x in zip(*((vocab[x], vocab[y], vocab[x + y]) for x, y in pairs), strict=True))
        keys = a << 32 | b
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), c[order]
        special = sorted((x["content"] for x in spec.get("added_tokens") or []), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of each pair, or a value above all ranks; and the symbol it makes."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.made[at]

    def merge(self, texts: list[bytes]) -> list[np.ndarray]:
        """Symbols of each non-empty byte string when no merge is left. All strings take a step together: each applies the merge
        of lowest rank among its pairs, at all its places from the left; strings without a merge leave."""
        out: list = [None] * len(texts)
        lens = np.array([len(t) for t in texts], np.int64)
        who = np.arange(len(texts))
        sym = self.first[np.frombuffer(b"".join(texts), np.uint8)]
        rank = made = None
        while len(who):
            starts = np.cumsum(lens) - lens
            if rank is None:
                rank, made = self.rank(sym, np.append(sym[1:], 0))
            rank[starts + lens - 1] = _NONE
            low = np.minimum.reduceat(rank, starts)
            if (low == _NONE).any():
                for i in np.flatnonzero(low == _NONE):
                    out[who[i]] = sym[starts[i] : starts[i] + lens[i]]
                on = low != _NONE
                keep = np.repeat(on, lens)
                sym, rank, made, lens, who, low = sym[keep], rank[keep], made[keep], lens[on], who[on], low[on]
                if not len(who):
                    break
                starts = np.cumsum(lens) - lens
            hit = rank == np.repeat(low, lens)
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():  # x x x: of each run every second place
                new = np.append(True, np.diff(at) > 1)
                begin = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
                at = at[(at - begin) % 2 == 0]
            sym[at] = made[at]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            lens = lens - np.add.reduceat(gone, starts, dtype=np.int64)
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            stay = ~gone
            sym, rank, made, touched = sym[stay], rank[stay], made[stay], touched[stay]
            touched[:-1] |= touched[1:].copy()
            redo = np.flatnonzero(touched)
            after = np.append(sym, 0)
            rank[redo], made[redo] = self.rank(sym[redo], after[redo + 1])
        return out

    def parts(self, text: str) -> tuple[list[str], int]:
        """Text between special strings, and the number of these."""
        if self.special is None or not (n := len(self.special.findall(text))):
            return [text], 0
        return self.special.split(text), n


class Counter:
    """Counts tokens of texts; pre-tokens met before are looked up."""

    def __init__(self, path: str):
        self.bpe, self.find, self.known = ByteBpe(path), regex.compile(PRETOKEN).findall, {}

    def __call__(self, texts: list[str]) -> list[int]:
        rows = []
        for text in texts:
            parts, n = self.bpe.parts(text)
            rows.append((n, [t for p in parts for t in self.find(p)] if len(parts) > 1 else self.find(parts[0])))
        new = list(set().union(*(r[1] for r in rows)).difference(self.known))
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(set().union(*(r[1] for r in rows)))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.known.update(zip(part, map(len, self.bpe.merge([t.encode() for t in part])), strict=True))
        get = self.known.__getitem__
        return [n + sum(map(get, tokens)) for n, tokens in rows]


def token_counts(df: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens (of the vocabulary file at ``path``), over_limit (n_tokens > limit).

    One row per input row, in one pass without a shuffle. A null text counts as empty: no bytes, no tokens. Null and repeated
    ids are passed on; other columns are not read.
    """

    def make():
        count = Counter(path)

        def f(batch, data, at):
            n = np.array(count([x or "" for x in batch.column(1).to_pylist()]), np.int64)
            return [batch.column(0), pa.array(np.diff(at)), pa.array(n)]

        return f

    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_texts(source, make, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
