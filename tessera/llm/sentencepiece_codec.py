"""SentencePiece encoding and decoding: a batched Viterbi over words of equal length.

The vocabulary is a SentencePiece BPE model. A sequence of pieces is what BPE gives for its text exactly if each piece by itself
and each two neighbours by themselves are what BPE gives for theirs; and if it is, so is the sequence without its last piece. The
best path to a place in a word is therefore the best path to an earlier place plus one piece that may follow that path's last
one: a lattice that Viterbi solves from left to right, for all words of one length at a time.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import U64, Memo, lists, map_texts, mix, powers, runs, span_hash, sums
from tessera.llm.batches import pieces as pieces_of

SPACE = "▁"
#: Slots of the table of known units and of the one of known pairs, and ids remembered.
UNITS, PAIRS, IDS = 1 << 19, 1 << 20, 1 << 21
#: Bytes of texts, or ids, that are looked at together.
PART = 1 << 19
#: Bits of a key that a table of present keys is asked for before the sorted keys are searched.
SEEN = 20
_LENGTH = U64(0xD6E8FEB86659FD93)


class Pieces:
    """The pieces of a model file: sorted 64-bit keys of their code points, and what each id decodes to."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        names = [model.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.names, self.unknown = names, model.unk_id()
        self.bytes = {int(names[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.score = {names[i]: model.get_score(i) for i in plain}
        self.longest = max(map(len, self.score))
        self.decoded = [b"" if model.is_control(i) else bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else " ⁇ ".encode() if model.is_unknown(i) else names[i].replace(SPACE, " ").encode() for i in ids]
        good = [i for i in plain if self.merged(names[i]) == [names[i]]]  # BPE makes no other piece
        keys = np.zeros(len(good), U64)
        lengths = np.array([len(names[i]) for i in good])
        for n in np.unique(lengths):
            of = np.flatnonzero(lengths == n)
            keys[of] = self.keys(codes("".join(names[good[i]] for i in of)).reshape(len(of), n))[-1][:, 0]
        order = np.argsort(keys)
        self.sorted, self.ids = keys[order], np.array(good, np.int64)[order]
        assert len(np.unique(keys)) == len(keys), "two pieces have one key"
        self.present = np.zeros(1 << SEEN, bool)
        self.present[(keys >> U64(64 - SEEN)).astype(np.int64)] = True
        self.line_ends = any("\n" in x for x in self.score)  # else a line end is a unit by itself
        self.parts = np.frombuffer(b"".join(self.decoded), np.uint8)
        self.part_sizes = np.array([len(x) for x in self.decoded], np.int64)
        self.part_starts = np.cumsum(self.part_sizes) - self.part_sizes
        self.pair, self.apart = np.full(PAIRS, -2, np.int64), np.zeros(PAIRS, bool)
        self.known = Memo(UNITS, IDS)

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the two neighbours whose join scores highest, the first such two, become one piece, until none can."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def keys(self, words: np.ndarray) -> list[np.ndarray]:
        """For each end 1..n of a matrix of code points, the keys of the pieces that may end there: one column for each start."""
        n = words.shape[1]
        up, down = powers(n + 1)
        prefix = np.zeros((len(words), n + 1), U64)
        np.cumsum(mix(words.astype(U64)) * up[:n], axis=1, out=prefix[:, 1:])
        out = []
        for end in range(1, n + 1):
            starts = np.arange(max(0, end - self.longest), end)
            out.append(mix((prefix[:, end, None] - prefix[:, starts]) * down[starts] + (end - starts).astype(U64) * _LENGTH))
        return out

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each two pieces apart; a character without a piece (-1) merges with nothing."""
        key = left << 32 | (right & 0xFFFFFFFF)
        slot = (mix(key.view(U64)) & U64(PAIRS - 1)).astype(np.int64)
        out = self.apart[slot]
        miss = np.flatnonzero(self.pair[slot] != key)
        if len(miss):
            new, where = np.unique(key[miss], return_inverse=True)
            names = self.names
            found = np.array([a < 0 or b >= 0xFFFFFFFF or self.merged(names[a] + names[b]) == [names[a], names[b]] for a, b in zip((new >> 32).tolist(), (new & 0xFFFFFFFF).tolist(), strict=True)])
            out[miss] = found[where]
            slot = (mix(new.view(U64)) & U64(PAIRS - 1)).astype(np.int64)
            _, last = np.unique(slot, return_index=True)
            self.pair[slot[last]], self.apart[slot[last]] = new[last], found[last]
        return out

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a matrix of code points, a word a row: the piece that ends the best path to each place, and where it begins."""
        n_words, n = words.shape
        last, back = np.full((n_words, n + 1), -1, np.int64), np.zeros((n_words, n + 1), np.int32)
        for end, keys in enumerate(self.keys(words), 1):
            first = end - keys.shape[1]
            piece = np.full(keys.shape, -2, np.int64)
            maybe = self.present[(keys >> U64(64 - SEEN)).astype(np.int64)]
            some = keys[maybe]
            at = np.minimum(np.searchsorted(self.sorted, some), len(self.sorted) - 1)
            piece[maybe] = np.where(self.sorted[at] == some, self.ids[at], -2)
            piece[:, -1][piece[:, -1] == -2] = -1  # a character without a piece
            row, col = np.nonzero(piece > -2)
            found, start = piece[row, col], col + first
            ok = start == 0
            inner = np.flatnonzero(~ok)
            if len(inner):
                ok[inner] = self.follows(last[row[inner], start[inner]], found[inner])
            # the score of a path is 0 if all its pieces may follow each other, else minus infinity; exactly one start has 0
            score = np.full(piece.shape, -np.inf)
            score[row[ok], col[ok]] = 0.0
            best = score.argmax(axis=1)
            last[:, end], back[:, end] = piece[np.arange(n_words), best], best + first
        return last, back

    def solve(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units points[start : start + size], one after the other, and the number of each one's."""
        count, found, owner = np.zeros(len(starts), np.int64), [], []
        order = np.argsort(sizes, kind="stable")
        for lo, hi in _runs(sizes[order]):
            n = int(sizes[order[lo]])
            step = max(1, 400_000 // (n * min(n, self.longest)))
            for k in range(lo, hi, step):
                of = order[k : min(hi, k + step)]
                words = points[starts[of][:, None] + np.arange(n)]
                last, back = self.viterbi(words)
                spots, live = np.full(len(of), n), np.arange(len(of))
                while len(live):  # all words step back together
                    here = spots[live]
                    begin = back[live, here]
                    found.append(last[live, here])
                    lost = np.flatnonzero(found[-1] < 0)
                    if len(lost):  # the code point of a character without a piece, as a number below 0
                        found[-1][lost] = -2 - words[live[lost], begin[lost]].astype(np.int64)
                    owner.append(of[live])
                    spots[live] = begin
                    live = live[begin > 0]
        if not found:
            return np.zeros(0, np.int32), count
        # pieces came last first: the order of rounds is turned round
        ids, owner = np.concatenate(found[::-1]), np.concatenate(owner[::-1])
        order = np.argsort(owner, kind="stable")
        ids, owner = ids[order], owner[order]
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            spelt = [self.spelt(-2 - x) for x in ids[lost].tolist()]
            size = np.ones(len(ids), np.int64)
            size[lost] = [len(x) for x in spelt]
            ids, owner, new = np.repeat(ids, size), np.repeat(owner, size), np.repeat(ids < 0, size)
            ids[new] = np.concatenate(spelt)
        return ids.astype(np.int32), np.bincount(owner, minlength=len(starts))

    def spelt(self, code: int) -> list[int]:
        """The byte pieces of a character; the unknown id if the model has none."""
        return [self.bytes[b] for b in chr(code).encode()] if self.bytes else [self.unknown]

    def units(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts, each that is not empty with a space before it and spaces as SPACE; where units start, with the end of all; each one's text.

        A unit is a run of spaces with the other characters after it, or a line end; no piece reaches over its ends."""
        full = np.flatnonzero(np.diff(at))
        points = codes(np.insert(data, at[full], 0x20).tobytes().decode("utf-8", "replace"))
        points = np.where(points == 0x20, ord(SPACE), points)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at[full]] + np.arange(len(full))
        space, line = points == ord(SPACE), (points == 0x0A) & (not self.line_ends)
        begin = line.copy()
        begin[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        begin[lead] = True
        starts = np.flatnonzero(begin)
        return points, np.append(starts, len(points)), full[np.searchsorted(lead, starts, "right") - 1] if len(full) else starts

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each one's. Units met before are looked up."""
        points, edges, doc = self.units(data, at)
        if not len(doc):
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
        h = span_hash(mix(points.astype(U64)), edges[:-1], edges[1:])
        ids, n = self.known.look(h, lambda one: self.solve(points, edges[one], edges[one + 1] - edges[one]))
        return ids, sums(n, doc, len(at) - 1).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of consecutive runs of ids; the space that encoding puts first goes."""
        size = self.part_sizes[ids]
        raw = self.parts[np.repeat(self.part_starts[ids], size) + runs(size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        full = np.flatnonzero(np.diff(ends))
        lead = ends[full][raw[ends[full]] == 0x20]
        raw, ends = np.delete(raw, lead), ends - np.searchsorted(lead, ends)
        out = raw.tobytes()
        cut = ends[ends < len(raw)]
        try:
            out.decode()
            whole = not ((raw[cut] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if whole:
            return pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())
        return pa.array([out[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (of the model file at ``path``, without begin and end), text_crc32 of the text with each U+2581 read as a space.

    ids are the ones the SentencePiece library gives for a BPE model with identity normalisation. One row per input row, in one pass
    without a shuffle. A null or empty text has no ids. Null and repeated ids are passed on; other columns are not read."""

    def make():
        model = pieces(path)

        def f(batch, data, at):
            ids, counts = model.encode(data, at)
            raw, dots = data.tobytes(), SPACE.encode()
            crc = np.array([zlib.crc32(raw[a:b].replace(dots, b" ")) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)
            return [batch.column(0), lists(ids, counts), pa.array(crc)]

        return f

    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_texts(source, make, "doc_id long, ids array<int>, text_crc32 long", PART)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The columns of ``encoded`` and decoded, the text of its column ``ids``; null and empty lists give an empty text.

    Bytes that are not UTF-8 become replacement characters, as they do in the library."""

    def run(batches):
        model = pieces(path)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            column = batch.column(at)
            if column.null_count:
                column = pc.fill_null(column, pa.scalar([], column.type))
            ends = np.asarray(column.offsets).astype(np.int64)
            for lo, hi in pieces_of(ends - ends[0], PART):
                flat = column.values[ends[lo] : ends[hi]].to_numpy(zero_copy_only=False)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, model.decode(flat, np.diff(ends[lo : hi + 1]))], [*part.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded string"
    return encoded.mapInArrow(run, schema)
