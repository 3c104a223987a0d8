"""Packs and budgets over many parts against the rules applied row by row."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.packing import budget_skip, pack
from tessera.operators.search import resolve_loose


@pytest.fixture
def many_parts(spark):
    """Small ranges are not put together, so that a group lies in several parts."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def packed(rows, limit, base, most):
    """(group, i) -> pack of rows (group, i, tokens)."""
    out, state = {}, {}
    for g, i, t in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        number, used, n = state.get(g, (0, base, 0))
        t = max(t or 0, 0)
        if n and (used + t > limit or n >= most):
            number, used, n = number + 1, base, 0
        state[g], out[g, i] = (number, used + t, n + 1), number
    return out


def skipped(rows, budget, gap):
    """(group, i) of the rows of (group, i, size) that are kept."""
    kept, state = set(), {}
    for g, i, n in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        used, over = state.get(g, (0, False))
        n = max(n or 0, 0)
        fits = not over and used + n <= budget
        kept |= {(g, i)} if fits else set()
        state[g] = used + n * fits, over or (not fits and budget - used > gap)
    return kept


def drawn(seed, groups, n, top):
    rng = random.Random(seed)
    return [(rng.choice(groups), i, rng.choice([None, 0, -3, *(rng.randrange(top) for _ in range(9))])) for i in range(n)]


@pytest.mark.parametrize(("limit", "base", "most"), [(400, 50, 1 << 30), (400, 0, 3), (90, 100, 5), (1 << 40, 0, 1 << 30), (20_000, 7, 150), (1000, 0, 1)])
def test_pack(many_parts, limit, base, most):
    rows = drawn(limit, ["hot"] * 8 + ["a", None, "b"], 1500, 150)
    df = many_parts.createDataFrame(rows, "g string, i int, n int").repartition(5)
    out = pack(df, ["g"], ["i"], F.col("n"), limit, base, most)
    assert out.columns == ["g", "i", "tokens", "pack"]
    got = [((r.g, r.i), r.pack) for r in out.collect()]
    assert len(got) == len(rows) and dict(got) == packed(rows, limit, base, most)


def test_pack_of_all_rows_and_of_none(many_parts):
    rows = drawn(3, [7, None], 600, 80)
    df = many_parts.createDataFrame(rows, "g int, i int, n int")
    want = packed([(0, i, n) for _, i, n in rows], 300, 10, 6)
    assert {r.i: r.pack for r in pack(df, [], ["i"], F.col("n"), 300, 10, 6).collect()} == {i: p for (_, i), p in want.items()}
    assert {(r.g, r.i): r.pack for r in pack(df, ["g"], ["i"], F.col("n"), 300, 10, 6).collect()} == packed(rows, 300, 10, 6)
    assert pack(df.limit(0), ["g"], ["i"], F.col("n"), 300).count() == 0
    with pytest.raises(ValueError, match="at least one"):
        pack(df, ["g"], ["i"], F.col("n"), 300, most=0)


def test_no_task_streams_a_group(many_parts):
    df = many_parts.range(4000).select(F.lit("one").alias("g"), "id", F.lit(10).alias("n"))
    out = pack(df, ["g"], ["id"], F.col("n"), 100, base=0)
    assert {r.id: r.pack for r in out.collect()} == {i: i // 10 for i in range(4000)}
    assert len({r.p for r in out.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 1


@pytest.mark.parametrize(("budget", "gap", "top"), [(3000, 100, 150), (3000, 10, 150), (500, 200, 400), (0, 0, 9), (10**9, 100, 50), (2000, 0, 40)])
def test_budget_skip(many_parts, budget, gap, top):
    rows = drawn(budget + gap, ["hot"] * 8 + ["a", None], 900, top)
    df = many_parts.createDataFrame(rows, "g string, i int, n int").repartition(4)
    got = [(r.g, r.i) for r in budget_skip(df, "g", ["i"], "i", "n", budget, gap).collect()]
    assert len(got) == len(set(got)) and set(got) == skipped(rows, budget, gap)
    assert budget_skip(df.limit(0), "g", ["i"], "i", "n", budget, gap).count() == 0


def test_loose_references_meet_names_once(spark):
    """A name that very many files have is one row before it meets a reference; the result is that of a plain scan."""
    paths = [f"{d}/index.ts" for d in ("a", "b/c", "b", "x/b/c")] + ["src/Main.py", "lib/main.js", "src/util/strings.py", "docs/read me.md", "/top/only.go", "top"]
    asked = ["index.ts", "./c/index.ts", "b/c/index.ts", "zz/index.ts", "MAIN.PY", "string.py", "util/strings.ts", "top", "/top/only.go", "nothing-like-it.rs", "indexx.ts", "index.ts"]
    refs, files = spark.createDataFrame([(r,) for r in asked], "ref string"), spark.createDataFrame([(p,) for p in paths], "path string")

    def near(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, e = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(e[j] + 1, d[-1] + 1, e[j - 1] + (x != y)))
        return 1 - d[-1] / max(len(a), len(b), 1)

    name = lambda p: p.split("/")[-1].lower()
    cut = lambda n: (n[: n.rindex(".")], n[n.index(".") :]) if "." in n else (n, "")
    want = {}
    for r in set(asked):
        clean, found = r.removeprefix("./"), []
        same = [p for p in paths if name(p) == name(clean)]
        for p in paths:
            if p in same:
                found.append((1.0 if p == clean or p.endswith("/" + clean) else 0.95 if len(same) == 1 else 0.7, p))
            elif not same:
                (s, e), (t, f) = cut(name(clean)), cut(name(p))
                found += [(v, p) for v in (near(name(clean), name(p)) if e == f else 0, 0.9 * near(s, t)) if v >= 0.7]
        if found:
            score, path = min(found, key=lambda x: (-round(x[0], 9), x[1]))
            want[r] = path, round(score, 6)
    got = [(r.ref, (r.path, round(r.score, 6))) for r in resolve_loose(refs, files).collect()]
    assert dict(got) == want and len(got) == len(want)
