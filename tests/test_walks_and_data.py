"""Walks of many levels, innermost ranges, nested data files and the scorer hook against plain versions."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import search as S
from tessera.operators import traverse as X
from tessera.sources import data_files


def test_reach_on_circles(spark):
    rng = random.Random(1)
    edges = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.choice("ab")) for _ in range(60)}
    df = spark.createDataFrame(sorted(edges), "src string, dst string, type string")
    starts = ["n1", "n2", "n2", "far"]
    for depth in (None, 3):
        want = {}
        for s in set(starts):
            seen, front, level = {s}, {s}, 0
            while front and (depth is None or level < depth):
                level += 1
                new = {d for a, d, _ in edges if a in front} - seen
                want |= {(s, d): (level, sorted({t for a, e, t in edges if e == d and a in front})) for d in new}
                seen, front = seen | new, new
        got = {(r.start, r.id): (r.depth, r.types) for r in X.reach(spark.createDataFrame([(s,) for s in starts], "id string"), df, depth).collect()}
        assert got == want


def test_jobs_grow_with_depth_alone(spark):
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}", "x") for i in range(12)], "src string, dst string, type string")
    start = spark.createDataFrame([("c0",)], "id string")
    tracker = spark.sparkContext.statusTracker()

    def jobs(depth):
        spark.sparkContext.setJobGroup(f"reach{depth}", "")
        n = X.reach(start, chain, depth).count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n, len(tracker.getJobIdsForGroup(f"reach{depth}"))

    (n4, j4), (n8, j8) = jobs(4), jobs(8)
    assert (n4, n8) == (4, 8) and j8 <= 2.5 * j4
    assert [r.depth for r in X.expand(start, chain, "x", 5).orderBy("depth").collect()] == [1, 2, 3, 4, 5]


def nested(rng, lo, hi, depth, out, name):
    out.append((name, lo, hi))
    at = lo
    while depth and at < hi:
        a = rng.randint(at, hi)
        b = rng.randint(a, min(hi, a + (hi - lo) // 2))
        nested(rng, a, b, depth - 1, out, f"{name}.{len(out)}")
        at = b + 1


@pytest.mark.parametrize("block", [7, 10_000])
def test_innermost_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK", block)
    rng, ranges, points = random.Random(block), [], []
    for f in ("a", "b", None):
        found = []
        nested(rng, 1, 120, 4, found, "r")
        found += [(f"x{i}", a := rng.randint(1, 100), a + rng.randint(0, 40)) for i in range(6)] + [("back", 9, 3)]  # crossing ones, and an empty one
        ranges += [(f, *r) for r in found]
        points += [(f, rng.randint(-3, 140), k) for k in range(80)]
    points += [("a", None, 900), ("none", 5, 901)]
    want = {}
    for f, line, k in points:
        inside = [(e - s, s, i) for g, i, s, e in ranges if g == f and f is not None and line is not None and s <= line <= e]
        if inside:
            want[f, k] = min(inside)[2]
    p = spark.createDataFrame(points, "file string, line int, k int").where("file is not null")
    r = spark.createDataFrame(ranges, "file string, id string, start_line int, end_line int").where("file is not null")
    out = X.innermost(p, r, ["k"])
    assert {(x.file, x.k): x.id for x in out.collect()} == want and out.columns == ["file", "line", "k", "id", "start_line", "end_line"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


FILES = {
    "a.json": ('{"a": {"b": [1, {"c": "x"}]}, "n": null}', {"a.b.[0]": "1", "a.b.[1].c": "x", "n": None}),
    "b.toml": ('top = 1\n[s]\nk = "v"\n[s.t]\nl = [true, "y"]\n', {"top": "1", "s.k": "v", "s.t.l.[0]": "true", "s.t.l.[1]": "y"}),
    "c.xml": ('<?xml version="1.0"?><a id="7"><b><c>2</c></b><d>x</d><d>y</d><e>t<f/></e></a>', {"a.@id": "7", "a.b.c": "2", "a.d.[0]": "x", "a.d.[1]": "y", "a.e.f": "", "a.e.#text": "t"}),
    "d.yaml": ("# c\nname: x  # note\non: true\nlist:\n  - one\n  - k: 1\n    l: two\nmap:\n  deep:\n    n: 5\n  empty:\nplain:\n- 'q: r'\n", {"name": "x", "on": "true", "list.[0]": "one", "list.[1].k": "1", "list.[1].l": "two", "map.deep.n": "5", "map.empty": None, "plain.[0]": "q: r"}),
    "e.env": ('export A="1"\r\nB=two words\n# C=3\nD=\n', {"A": "1", "B": "two words", "D": ""}),
    "f.yml": ("a: &x 1\nb: *x\n", {}), "g.toml": ("= broken", {}), "h.xml": ("<a><b></a>", {}), "i.txt": ("a: 1", {}), "j.json": (None, {}), "k.yaml": ("- a\nb: 1\n", {}), "l.xml": ('<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>', {}), "m.yaml": ("", {}),
}


def test_data_files(spark):
    df = spark.createDataFrame([(p, t) for p, (t, _) in FILES.items()] + [(None, "a: 1")], "path string, content string")
    got: dict = {}
    for r in data_files.data_entries(df).collect():
        got.setdefault(r.path, {})[r.key] = r.value
    assert got == {p: v for p, (_, v) in FILES.items() if v}
    sections = {(r.section, r.type, r.depth, r.parent) for r in data_files.data_sections(df.where("path = 'b.toml'"), 2).collect()}
    assert {("s", "OBJECT", 1, ""), ("s.t", "OBJECT", 2, "s"), ("s.k", "STRING", 2, "s"), ("top", "BIGINT", 1, "")} == sections


def test_scorer(spark):
    hits = spark.createDataFrame([(i, 0.5) for i in range(25)] + [(99, 0.4)], "id long, score double")
    rows = spark.range(25).select("id", F.concat(F.lit("t"), "id").alias("text"))

    def judge(p: pd.DataFrame) -> pd.Series:
        assert list(p.columns) == ["id", "score", "text"] and len(p) <= 10
        return (p["text"].str[1:].astype(int) / 100).where(p["id"] % 5 != 0)

    got = {r.id: round(r.score, 6) for r in S.evaluated(hits, rows, ["text"], judge, batch=10).collect()}
    assert got == {i: round(0.5 if i % 5 == 0 else 0.15 + 0.7 * i / 100, 6) for i in range(25)} | {99: 0.4}
