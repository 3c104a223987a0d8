"""Packs and budgets that are filled row by row, along groups of any size.

What a row does depends on all rows before it, yet no group is one task's. Rows are dealt by ranges of (group, order); a group's rows in one
part are a block. Each block is summed up on its own, for every state in which it may be entered; only the few groups that lie in several
parts have these summaries (one row a block) folded in order; then each block is filled from the state in which it is entered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.running import running
from tessera.plans.stored import stored

FRESH = 0, 0, 0  # packs opened, tokens in the open pack, rows in it


def _blocks(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by, _part, _rows): a group's rows in one part, in order. An array is no larger than a part; it holds order and value only."""
    keys = [F.col(f"`{c}`") for c in [*by, *order]]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    row = F.struct("_at", *(F.col(f"`{c}`") for c in dict.fromkeys([*order, value]) if c not in by))
    return stored(dealt.groupBy(*keys[: len(by)], F.shiftright("_at", 33).alias("_part")).agg(F.sort_array(F.collect_list(row)).alias("_rows")))


def _same(by: list[str]) -> Column:
    out = F.lit(True)
    for i, c in enumerate(by):
        out = out & F.col(f"`{c}`").eqNullSafe(F.col(f"_g{i}"))
    return out


def _named(df: DataFrame, by: list[str], *more: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(by)), *more)


def _entered(blocks: DataFrame, by: list[str], summary: Column, start: Callable[[tuple], list[int]], step: Callable) -> DataFrame:
    """blocks with _entry, the state in which each is entered; null where a group lies in one part. There are fewer than two blocks a part
    of groups in several, so what is folded and joined is bounded by the number of parts."""
    several = _named(blocks.groupBy(*(F.col(f"`{c}`") for c in by)).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), by)
    few = blocks.join(several, _same(by), "left_semi").select(*(F.col(f"`{c}`") for c in by), "_part", summary.alias("_sum"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in few.drop("_sum").schema) + ", _entry array<bigint>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = state = None
        for p in parts:
            entry = []
            for g, s in zip(zip(*(p[c].astype(object).where(p[c].notna(), None) for c in by), strict=True), p["_sum"], strict=True):
                if g != last:
                    last, state = g, start(g)
                entry.append(state)
                state = step(state, s)
            yield p[[*by, "_part"]].assign(_entry=entry)

    keys = [F.col(f"`{c}`") for c in by]
    entries = _named(few.repartition(*keys).sortWithinPartitions(*keys, "_part").mapInPandas(run, schema), by, F.col("_part").alias("_p"), "_entry")
    return blocks.join(entries, _same(by) & (F.col("_part") == F.col("_p")), "left").select(*keys, "_part", "_rows", "_entry")


def _filled(blocks: DataFrame, by: list[str], fill: Column, name: str) -> DataFrame:
    """The rows of the blocks, each with what ``fill``, an array beside _rows, gives it."""
    rows = blocks.select(*(F.col(f"`{c}`") for c in by), F.explode(F.arrays_zip("_rows", fill.alias("_out"))).alias("_r"))
    return rows.select(*(F.col(f"`{c}`") for c in by), "_r._rows.*", F.col("_r._out").alias(name)).drop("_at")


def _following(sums: np.ndarray, at: np.ndarray, room: int, most: int) -> np.ndarray:
    """The row that opens the pack after one opened at each of ``at``; the number of rows if none does."""
    return np.minimum(np.maximum(np.searchsorted(sums, sums[at] + room, side="right") - 1, at + 1), np.minimum(at + most, len(sums) - 1))


def pack(df: DataFrame, by: list[str], order: list[str], tokens: Column, limit: int, base: int = 500, most: int = 1 << 30) -> DataFrame:
    """(by, order, tokens, pack): consecutive packs of each group's rows, from 0; a row that would pass the limit of tokens or of rows opens
    the next pack. ``base`` tokens are spent on each pack; null and negative counts are 0 tokens, and a row over the limit has a pack of its
    own. Without ``by`` all rows are one group. Name a unique column last in ``order``: ties keep no fixed order. An empty table gives none.

    A block may be entered with an open pack, which ends at one of its first rows: no later than one opened at the block's first row. So
    its summary says, for each row up to there, how a chain of packs opened at it leaves the block."""
    if most < 1:
        raise ValueError("a pack holds at least one row")
    room, within = limit - base, by or ["_all"]
    rows = df.select(*by, *([] if by else [F.lit(0).alias("_all")]), *order, F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0)).cast("long").alias("tokens"))
    blocks = _blocks(rows, within, order, "tokens")

    @F.pandas_udf("upto array<bigint>, opened array<bigint>, used array<bigint>, n array<bigint>, total bigint, size bigint")
    def summary(tokens: pd.Series) -> pd.DataFrame:
        out = []
        for t in tokens:
            sums = np.concatenate([[0], np.cumsum(t, dtype=np.int64)])
            at = np.arange(min(int(_following(sums, np.array([0]), room, most)[0]) + 1, len(t)))
            upto, opened = sums[at + 1], np.ones(len(at), np.int64)
            while (go := (after := _following(sums, at, room, most)) < len(t)).any():
                at, opened = np.where(go, after, at), opened + go
            out.append((upto, opened, sums[-1] - sums[at], len(t) - at, sums[-1], len(t)))
        return pd.DataFrame(out, columns=["upto", "opened", "used", "n", "total", "size"])

    def first(upto: np.ndarray, used: int, n: int) -> int:  # the row that opens a pack, where one with n rows and used tokens is open
        return min(int(np.searchsorted(upto, room - used, side="right")), max(most - n, 0)) if n else 0

    def step(state: list[int], s: dict) -> list[int]:
        opened, used, n = state
        at = first(np.asarray(s["upto"]), used, n)
        if at >= len(s["upto"]):  # all of the block goes to the open pack
            return [opened, used + s["total"], n + s["size"]]
        return [opened + int(s["opened"][at]), int(s["used"][at]), int(s["n"][at])]

    @F.pandas_udf("array<int>")
    def fill(tokens: pd.Series, entry: pd.Series) -> pd.Series:
        out = []
        for t, e in zip(tokens, entry, strict=True):
            opened, used, n = FRESH if e is None else e
            sums, starts = np.concatenate([[0], np.cumsum(t, dtype=np.int64)]), np.zeros(len(t), np.int64)
            at = first(sums[1:], int(used), int(n))
            while at < len(t):
                starts[at] = 1
                at = int(_following(sums, np.array([at]), room, most)[0])
            out.append((int(opened) - 1 + np.cumsum(starts)).astype(np.int32))
        return pd.Series(out)

    entered = _entered(blocks, within, summary("_rows.tokens"), lambda g: list(FRESH), step)
    return _filled(entered, within, fill("_rows.tokens", "_entry"), "pack").select(*by, *order, "tokens", "pack")


def budget_skip(df: DataFrame, by: str, newest: list[str], key: str, size: str, budget: int, gap: int = 100) -> DataFrame:
    """(by, key) of the rows that fit, in order; one that doesn't is skipped if at most ``gap`` remains, else it ends the list. Null and
    negative sizes count 0. Name a unique column last in ``newest``.

    Rows fit as long as their running sum does. From the first that doesn't, what remains is at most ``gap`` or the list has ended, so only
    rows of at most that size matter, and a block's summary is what it leaves of each number from 0 to the gap."""
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).cast("long")
    rows = running(df.select(*dict.fromkeys([by, *newest, key]), n.alias("_size")), [by], [F.col(c).asc() for c in newest], {"_used": F.col("_size")})
    over = rows.where(F.col("_used") > budget)
    room = _named(over.groupBy(by).agg((F.lit(budget) - F.min(F.col("_used") - F.col("_size"))).alias("_room")).where(F.col("_room") <= gap), [by], "_room")
    small = over.where(F.col("_size") <= gap).join(room, _same([by])).drop("_g0", "_used")
    order = list(dict.fromkeys([*newest, key]))
    blocks = _blocks(small, [by, "_room"], [c for c in order if c != by], "_size")

    @F.pandas_udf("array<bigint>")
    def summary(sizes: pd.Series) -> pd.Series:
        out = []
        for t in sizes:
            left = np.arange(gap + 1)
            for v in t[np.asarray(t) > 0]:
                left = np.where(left >= v, left - v, left)
            out.append(left)
        return pd.Series(out)

    @F.pandas_udf("array<boolean>")
    def fill(sizes: pd.Series, room: pd.Series, entry: pd.Series) -> pd.Series:
        out = []
        for t, r, e in zip(sizes, room, entry, strict=True):
            left, fits = int(r if e is None else e[0]), []
            for v in t:
                fits.append(bool(v <= left))
                left -= int(v) if v <= left else 0
            out.append(fits)
        return pd.Series(out)

    entered = _entered(blocks, [by, "_room"], summary("_rows._size"), lambda g: [int(g[-1])], lambda state, s: [int(s[state[0]])])
    more = _filled(entered, [by, "_room"], fill("_rows._size", "_room", "_entry"), "_fits").where("_fits")
    return rows.where(F.col("_used") <= budget).select(by, key).union(more.select(by, key))
