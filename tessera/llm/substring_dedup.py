"""Removal of repeated word sequences with suffix automata of reference shards.

Windows of a text are told apart by an anchor, the smallest hash of the shorter runs of words in them, which equal windows share wherever they
stand. A piece is a run of windows with one anchor. The pieces of one anchor make a shard: it is read in order of the documents that hold a
piece first; each piece is streamed through the automaton of those before it, whose matching statistics (at each word, the longest text ending
there that the shard knows) tell what smaller documents hold, and is then added to it. Every maximal match of at least ``window`` words is
removed. As the shards together grow with the corpus they are not broadcast to all tasks: anchors name the shard that a piece is streamed
through. A shard that would be too large is split by anchors of longer runs, at last by whole windows, where each shard is one piece.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import U64, Words, gram_hash, lists, map_texts, mix, runs, signed, written
from tessera.llm.bitmap import maybe
from tessera.llm.keyed import shared_keys

#: Different pieces that a shard may hold before it is split.
SHARD = 1000


def anchors(own: np.ndarray, docs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of words that lies in one document, the smallest hash of ``gram`` words in it, and the window's first word."""
    ok = np.flatnonzero(docs[: max(0, len(docs) - window + 1)] == docs[window - 1 :])
    if not len(ok):
        return np.zeros(0, U64), ok
    g = gram_hash(own, gram)
    span = window - gram + 1
    low, width = g, 1  # minima of runs of a power of two, then of two overlapping ones
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[ok], low[ok + span - width]), ok


class Automaton:
    """Suffix automaton of sequences, one after the other with a break between them."""

    def __init__(self, sequences: list[list[int]] = ()):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for seq in sequences:
            self.add(seq)

    def add(self, seq: list[int]) -> None:
        last = 0
        for w in seq:
            last = self._extend(last, w)

    def _extend(self, last: int, w: int) -> int:
        step, link, length = self.next, self.link, self.length
        known = step[last].get(w)
        if known is not None:  # a later sequence takes a way that is there
            if length[known] == length[last] + 1:
                return known
            return self._clone(last, w, known)
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        step, link, length = self.next, self.link, self.length
        copy = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and step[p].get(w) == q:
            step[p][w] = copy
            p = link[p]
        return copy

    def statistics(self, seq: list[int]) -> Iterator[int]:
        """Length of the longest match that ends at each place of seq."""
        step, link, length = self.next, self.link, self.length
        state = n = 0
        for w in seq:
            there = step[state].get(w)
            while there is None and state:
                state = link[state]
                n = length[state]
                there = step[state].get(w)
            if there is None:
                n = 0
            else:
                state, n = there, n + 1
            yield n


def repeats(automaton: Automaton, seq: list[int], window: int) -> list[tuple[int, int]]:
    """Spans of seq that matches of at least ``window`` words cover."""
    out: list[list[int]] = []
    for i, n in enumerate(automaton.statistics(seq), 1):
        if n >= window:
            if out and i - n <= out[-1][1]:
                out[-1] = [min(out[-1][0], i - n), i]
            else:
                out.append([i - n, i])
    return [(a, b) for a, b in out]


def repeated_spans(df: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """(doc_id, tag, spans): for each text with words to remove, disjoint spans (start, end) of word numbers, ascending; tag is a hash
    of the text.

    A word is removed if a window of ``window`` words of its text that covers it also stands in a text with a smaller id.
    Rows with a null id neither lose words nor make others lose some. Rows that share an id are texts of their own, none of which
    makes another lose words; equal rows get equal spans."""
    rows = _tagged(df, doc_id, text).where("doc_id is not null")
    grams = sorted({max(1, window // 3), max(1, 2 * window // 3), window})

    def anchors_of():
        def f(batch, data, at):
            words = Words(data, at)
            low, first = anchors(words.hashes(), words.docs, window, grams[0])
            doc = words.docs[first]
            # an anchor serves neighbouring windows: once for each run of them is enough
            new = np.append(True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]))[: len(low)]
            return [pa.array(signed(low[new])), batch.column(0).take(pa.array(doc[new]))]

        return f

    # anchors that two or more documents hold, and with them the stretches that may be repeated
    held = shared_keys(map_texts(rows.select("doc_id", "text"), anchors_of, "key long, doc_id long").distinct(), with_first=True)
    mine = written(held.groupBy("doc_id").agg(F.collect_set("key").alias("keys")))
    texts = maybe(rows, mine, "doc_id").join(mine, "doc_id")

    def shared_pieces():
        def f(batch, data, at):
            words = Words(data, at)
            own = words.hashes()
            low, first = anchors(own, words.docs, window, grams[0])
            doc = words.docs[first]
            keys = batch.column(2)
            flat = keys.flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(keys)), np.diff(np.asarray(keys.offsets)))
            # pairs of document and anchor as one number each; equal numbers of unequal pairs only keep a piece too many
            pair = lambda k, d: mix(k ^ mix(d.astype(U64) + U64(11)))
            hit = np.isin(pair(low, doc), pair(flat.astype(np.int64).view(U64), of))
            key, start, sizes, at_word = _pieces(low[hit], first[hit], words.docs, window)
            doc = pa.array(words.docs[start])
            return [pa.array(signed(key)), batch.column(0).take(doc), batch.column(3).take(doc), pa.array((start - words.first[words.docs[start]]).astype(np.int32)), lists(signed(own[at_word]), sizes)]

        return f

    kind = "key long, doc_id long, tag long, start int, words array<long>"
    pieces = map_texts(texts.select("doc_id", "text", "keys", "tag"), shared_pieces, kind)
    spans = None
    for level, gram in enumerate(grams):
        pieces = written(pieces.withColumn("piece", F.xxhash64("words")))
        distinct = written(pieces.groupBy("key", "piece").agg(F.min("doc_id").alias("first"), F.any_value("words").alias("words"), F.max("doc_id").alias("last")))
        large = distinct.groupBy("key").count().where(F.col("count") > shard).select("key") if gram < window else None
        fits = distinct if large is None else distinct.join(large, "key", "left_anti")
        streamed = fits.select("key", "piece", "first", "words", (F.col("last") > F.col("first")).alias("more")).repartition("key").sortWithinPartitions("key", "first").mapInArrow(_streamed(window), "key long, piece long, first long, own array<struct<a:int,b:int>>, others array<struct<a:int,b:int>>")
        place = pieces.select("key", "piece", "doc_id", "tag", "start").join(streamed, ["key", "piece"])
        now = place.select("doc_id", "tag", "start", F.explode(F.when(F.col("doc_id") > F.col("first"), F.col("others")).otherwise(F.col("own"))).alias("s"))
        spans = now if spans is None else spans.unionByName(now)
        if large is None:
            break
        pieces = pieces.join(large, "key", "left_semi").select("key", "doc_id", "tag", "start", "words").mapInArrow(_split(window, grams[level + 1]), kind)
    ends = spans.select("doc_id", "tag", F.struct((F.col("start") + F.col("s.a")).alias("start"), (F.col("start") + F.col("s.b")).alias("end")).alias("s")).groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set("s")).alias("s"))
    merged = F.aggregate("s", F.expr("cast(array() as array<struct<start:int,end:int>>)"), _join_spans)
    return ends.select("doc_id", "tag", merged.alias("spans"))


def _join_spans(done, s):
    last = F.element_at(done, -1)
    joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
    return F.when((F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(-1)) >= s["start"]), joined).otherwise(F.concat(done, F.array(s)))


def _pieces(low: np.ndarray, first: np.ndarray, docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of one document and anchor: anchor, first word and number of words of each, and the places of their words."""
    new = np.append(True, (low[1:] != low[:-1]) | (first[1:] != first[:-1] + 1) | (docs[first[1:]] != docs[first[:-1]]))[: len(low)]
    head = np.flatnonzero(new)
    sizes = np.diff(np.append(head, len(low))) + window - 1 if len(head) else np.zeros(0, np.int64)
    start = first[head]
    return low[head], start, sizes, np.repeat(start, sizes) + runs(sizes)


def _split(window: int, gram: int):
    """Pieces (key, doc_id, tag, start, words) cut into pieces of anchors of longer runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                own = part.column(4).flatten().to_numpy().view(U64)
                n = np.diff(np.asarray(part.column(4).offsets))
                which = np.repeat(np.arange(len(n)), n)
                low, first = anchors(own, which, window, gram)
                if len(low):
                    key, start, sizes, at_word = _pieces(low, first, which, window)
                    of = pa.array(which[start])
                    place = runs(n)[start] + np.asarray(part.column(3))[which[start]]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(key)), part.column(1).take(of), part.column(2).take(of), pa.array(place.astype(np.int32)), lists(signed(own[at_word]), sizes)], batch.schema.names)

    return run


def _streamed(window: int):
    """For pieces (key, piece, first, words, more) in order of key and first: the spans that pieces of smaller documents cover (own), and, if
    there are more documents that hold the piece, what its first one covers of theirs (others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = automaton = None
        held: list[list[int]] = []  # of the document at hand: none of its pieces counts against another of its own
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                own, others = [], []
                for key, first, words, more in zip(*(part.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                    if now is None or key != now[0]:
                        automaton, held = Automaton(), []
                    elif first != now[1]:
                        for seq in held:
                            automaton.add(seq)
                        held = []
                    now = key, first
                    own.append([{"a": a, "b": b} for a, b in repeats(automaton, words, window)])
                    held.append(words)
                    others.append([{"a": a, "b": b} for a, b in repeats(Automaton([words]), words, window)] if more else [])
                kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(own, kind), pa.array(others, kind)], ["key", "piece", "first", "own", "others"])

    return run


def _tagged(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))


def _digests(data: np.ndarray, words: Words, keep: np.ndarray) -> list[str]:
    """SHA-256 of each document's kept words, joined by single spaces."""
    # a kept word and one byte after it, which becomes the space
    if not len(words.starts):
        return [hashlib.sha256(b"").hexdigest()] * (len(words.at) - 1)
    size = np.where(keep, words.ends - words.starts + 1, 0)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(at[-1], 0x20, np.uint8)
    spot = np.repeat(words.starts - at[:-1], size) + np.arange(at[-1])
    mark = np.ones(at[-1], bool)
    mark[at[1:][size > 0] - 1] = False
    out[mark] = data[spot[mark]]
    raw, cut = out.tobytes(), at[words.first]
    return [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def removal(df: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tag, text (the kept words, joined by single spaces), n_words, n_removed, once for each text of ``spans``."""
    hit = maybe(_tagged(df, doc_id, text), spans, "doc_id").join(spans, ["doc_id", "tag"]).select("doc_id", "text", "spans", "tag")

    def make():
        def f(batch, data, at):
            words = Words(data, at)
            raw, texts, gone = data.tobytes(), [], []
            starts, ends = words.starts.tolist(), words.ends.tolist()
            for i, spans in enumerate(batch.column(2).to_pylist()):
                keep = np.ones(words.counts[i], bool)
                for s in spans:
                    keep[s["start"] : s["end"]] = False
                lo = int(words.first[i])
                texts.append(b" ".join(raw[starts[lo + j] : ends[lo + j]] for j in np.flatnonzero(keep).tolist()).decode())
                gone.append(int((~keep).sum()))
            return [batch.column(0), batch.column(3), pa.array(texts, pa.string()), pa.array(words.counts.astype(np.int64)), pa.array(gone, pa.int64())]

        return f

    return map_texts(hit, make, "doc_id long, tag long, text string, n_words long, n_removed long").dropDuplicates(["doc_id", "tag"])


def dedup(df: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (lower-case hex, of the kept words joined by single spaces): one row per input row.

    A null text, or one without words, keeps the empty string. See repeated_spans for the words that go."""

    def make():
        def f(batch, data, at):
            words = Words(data, at)
            return [batch.column(0), batch.column(2), pa.array(words.counts.astype(np.int64)), pa.array(_digests(data, words, np.ones(len(words.starts), bool)))]

        return f

    plain = map_texts(_tagged(df, doc_id, text), make, "doc_id long, tag long, n_words long, kept_sha256 string")
    spans = written(repeated_spans(df, window, doc_id, text))
    cut = removal(df, spans, doc_id, text).select("doc_id", "tag", "n_removed", F.sha2("text", 256).alias("cut"))
    return plain.join(cut, ["doc_id", "tag"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut", "kept_sha256").alias("kept_sha256"))


def strip(df: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows and columns of df, whatever their names, with repeated stretches removed from the text; texts without one stay as they are.

    Null and empty texts and rows with a null id stay as they are; of rows that share an id each text is cut by itself."""
    spans = written(repeated_spans(df, window, doc_id, text))
    own, tag, new = (f"{k}_{uuid.uuid4().hex}" for k in ("doc", "tag", "text"))
    cut = removal(df, spans, doc_id, text).select(F.col("doc_id").alias(own), F.col("tag").alias(tag), F.col("text").alias(new))
    kept = df.join(cut, (F.col(doc_id).cast("long") == F.col(own)) & (F.xxhash64(F.col(text).cast("string")) == F.col(tag)), "left")
    return kept.withColumn(text, F.coalesce(new, F.col(text))).select(*(f"`{c}`" for c in df.columns))
