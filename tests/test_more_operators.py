"""Operators against plain versions, on cases that the driver's tables don't hold."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import conversations as V
from tessera.operators import incremental as I
from tessera.operators import ranking as R
from tessera.operators import resolution as E
from tessera.operators import search as S
from tessera.operators import traverse as X
from tessera.operators.similar import similar
from tessera.plans import frame
from tessera.streaming import feed


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_is_complete(spark):
    rng = random.Random(3)
    base = ["customer#000", "international paper", "anna", "bo", "x", "aaaaaaaa", "Jean-Luc Picard", "abcabcabc"]
    names = set(base)
    for _ in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice(["", "q", "a", "#"])
        names.add("".join(w))
    names = sorted(n for n in names if n)
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    for least in (0.8, 0.7):
        got = {(r.a, r.b) for r in similar(df, df, least).collect()}
        want = {(a, b) for a in names for b in names if 1 - levenshtein(a.lower(), b.lower()) / max(len(a), len(b)) >= least}
        assert got == want


def test_match_by_type(spark):
    m = spark.createDataFrame([("m1", "person", "Ana Smith"), ("m2", "place", "Ana Smith"), ("m3", "person", "zzz")], "mention string, type string, name string")
    c = spark.createDataFrame([("c1", "person", "Anna Smith"), ("c2", "person", "The Anna Smith")], "canonical string, type string, name string")
    assert {r.mention: r.canonical for r in E.match(m, c).collect()} == {"m1": "c1", "m2": None, "m3": None}


def test_longest_common():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert I.longest_common(a, b) == t[-1][-1]


def test_change_records_moved_lines(spark):
    old = spark.createDataFrame([(1, "a\nb\nc"), (2, "x"), (4, "same")], "k int, t string")
    new = spark.createDataFrame([(1, "c\na\nb"), (3, "n\nm"), (4, "same")], "k int, t string")
    got = {r.k: (r.change_type, r.lines_added, r.lines_removed) for r in I.change_records(old, new, "k", "t", F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {1: ("updated", 1, 1), 2: ("deleted", 0, 1), 3: ("created", 2, 0)}


def test_packs(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.randrange(1, 900)) for g in ("a", None, "b") for i in range(rng.randrange(1, 60))]
    want, pack, used, n, last = {}, 0, 500, 0, object()
    for g, i, t in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if g != last:
            pack, used, n, last = 0, 500, 0, g
        elif used + t > 2000 or n >= 4:
            pack, used, n = pack + 1, 500, 0
        used, n = used + t, n + 1
        want[g, i] = pack
    df = spark.createDataFrame(rows, "g string, i int, t int").repartition(4)
    assert {(r.g, r.i): r.pack for r in R.pack(df, ["g"], ["i"], F.col("t"), 2000, most=4).collect()} == want
    empty = R.pack(df.limit(0), ["g"], ["i"], F.col("t"), 2000)
    assert empty.columns == ["g", "i", "tokens", "pack"] and empty.count() == 0


def test_imports(spark):
    js = "import D, { a as b, type C } from './x';\nimport * as n from 'pkg'\nimport 'side'\nexport * from '../y'\n\nconst z = require(\"./z.json\")"
    py = "from .a import (\n    b,  # first\n    c as d,\n)\nimport os.path\n    from x.y import z\nfromage = 2"
    df = spark.createDataFrame([(js, py)], "js string, py string")
    got = [(r.line, r.module, r.symbols, r.local) for r in df.select(F.inline(T.script_imports(F.col("js")))).collect()]
    assert got == [(1, "./x", ["default", "a", "C"], True), (2, "pkg", ["*"], False), (3, "side", [], False), (4, "../y", ["*"], True), (6, "./z.json", [], True)]
    got = [(r.line, r.module, r.symbols, r.local) for r in df.select(F.inline(T.python_imports(F.col("py")))).collect()]
    assert got == [(1, ".a", ["b", "c"], True), (5, "os.path", [], False), (6, "x.y", ["z"], False)]


def test_loose_paths_skip_code(spark):
    df = spark.createDataFrame([("see src/a.ts or b.md here\nimport './c.ts'\nlet x = 'd.js';\nand e.py",)], "t string")
    got = {r.path: (r.confidence, r.context) for r in df.select(F.inline(T.loose_paths(F.col("t")))).collect()}
    assert set(got) == {"src/a.ts", "b.md", "e.py"} and got["src/a.ts"][0] == 0.9 and got["b.md"][0] == 0.6
    assert got["src/a.ts"][1].startswith("see src/a.ts or b.md")


def test_reference_and_library_edges(spark):
    scopes = spark.createDataFrame([("s1", "a.ts", "Foo"), ("s2", "a.ts", "Bar")], "id string, file string, name string")
    refs = spark.createDataFrame([("x", "a.ts", ["Foo", "Nope"]), ("x", "b.ts", ["Foo"]), ("x", "i.png", []), ("x", "s.css", None)], "src string, path string, symbols array<string>")
    assert {tuple(r) for r in X.reference_edges(refs, scopes).collect()} == {("x", "s1", "CONSUMES"), ("x", "b.ts", "CONSUMES"), ("x", "i.png", "REFERENCES_ASSET"), ("x", "s.css", "REFERENCES_STYLE")}
    imports = spark.createDataFrame([("s1", "react", ["A"], False), ("s2", "react", ["B", "A"], False), ("s2", "./a", ["C"], True)], "scope string, module string, symbols array<string>, local boolean")
    libs, edges = X.library_edges(imports)
    assert [(r.id, r.symbols) for r in libs.collect()] == [("lib:react", ["A", "B"])] and edges.count() == 2


def test_pending_imports(spark):
    scopes = spark.createDataFrame([("a1", "a.ts", "main"), ("a2", "a.ts", "other"), ("b1", "b.ts", "Foo")], "id string, file string, name string")
    pending = spark.createDataFrame([("a.ts", "b.ts", ["Foo"], "a1"), ("a.ts", "b.ts", ["Foo"], None), ("a.ts", "c.ts", ["X"], None)], "src_file string, dst_file string, symbols array<string>, scope string")
    edges, left = X.complete_imports(pending, scopes)
    assert {tuple(r) for r in edges.collect()} == {("a1", "b1", "CONSUMES"), ("a2", "b1", "CONSUMES")} and [r.dst_file for r in left.collect()] == ["c.ts"]


def test_turns_with_tools(spark):
    m = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "first"), (1, 3, "assistant", " "), (1, 4, "user", "q2"), (1, 5, "assistant", ""), (1, 6, "user", "q3")], "conv_id int, turn int, role string, text string")
    c = spark.createDataFrame([(1, 2, 1, "b", True), (1, 2, 0, "a", True), (1, 3, 0, "c", False), (1, 5, 0, "d", True)], "conv_id int, turn int, call int, tool string, success boolean")
    got = {r.turn_id: (r.question, r.answer, [(t.tool, t.success) for t in r.tools]) for r in V.turns_with_tools(m, c).collect()}
    assert got == {1: ("q", "first", [("a", True), ("b", True), ("c", False)]), 2: ("q2", "", [("d", True)])}
    assert [len(r.tools) for r in V.messages_with_tools(m, c).orderBy("turn").collect()] == [0, 0, 2, 1, 0, 1, 0]


def test_history_levels(spark):
    rows = spark.createDataFrame([(i, i % 4, i / 20) for i in range(20)], "id int, level int, s double")
    got = [(r.id, r.level, r.confidence) for r in V.history_search(rows, F.col("s"), (0, 1, 2), 2, 0.5).collect()]
    assert got == [(18, 2, 0.5), (17, 1, 0.7)]


def test_merge_mention(spark):
    canon = spark.createDataFrame([(1, "Acme", ["ACME"], [1])], "canonical int, name string, aliases array<string>, docs array<int>")
    got = E.merge_mention(spark.createDataFrame([(1, "Acme Corporation", ["acme corp"], 2), (9, "lost", [], 3)], "canonical int, name string, aliases array<string>, doc int"), canon, "organisation").collect()
    assert [(r.name, r.aliases, r.docs) for r in got] == [("Acme Corporation", ["ACME", "Acme", "acme corp"], [1, 2])]


def test_mentions_and_fuzzy_files(spark):
    files = spark.createDataFrame([("src/index.ts",), ("src/utils.js",), ("lib/config.yaml",)], "path string")
    mentions = spark.createDataFrame([("m", "utilz.js", 0.6), ("m", "config.yml", 0.9), ("m", "nothing.at", 0.6), ("m", "src/index.ts", None)], "mention string, ref string, confidence double")
    done, left = S.resolve_mentions(mentions, files)
    got = {r.path: round(r.confidence, 4) for r in done.collect()}
    assert got == {"src/utils.js": round(0.6 * 0.875, 4), "lib/config.yaml": round(0.9 * 0.9, 4), "src/index.ts": 0.5} and [r.ref for r in left.collect()] == ["nothing.at"]


def test_feed_due_and_snapshots(spark, tmp_path):
    rows = [("a", "in_progress", "2024-01-01 00:00:00"), ("b", "error", "2024-01-01 00:10:00"), ("c", "error", "2024-01-01 00:01:00"), ("c", "error", "2024-01-01 00:02:00"), ("c", "error", "2024-01-01 00:03:00"), ("d", "in_progress", "2024-01-01 00:09:00"), ("e", "done", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "key string, state string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.key for r in feed.due(df, F.lit("2024-01-01 00:10:00").cast("timestamp")).collect()} == {"a", "b"}
    start = spark.createDataFrame([("k1", "h", "p", [1.0]), ("k2", "h", "p", [2.0])], "key string, hash string, provider string, embedding array<double>")
    batch = spark.createDataFrame([("k1", "deleted", None, None, None), ("k2", "updated", "h", "p", None), ("k3", "created", "n", "p", None)], "key string, change_type string, hash string, provider string, embedding array<double>")
    source = f"{tmp_path}/in"
    batch.write.parquet(source)
    apply = feed.apply_to_snapshots(f"{tmp_path}/out", I.apply_batch, start)
    feed.apply_batches(spark.readStream.schema(batch.schema).parquet(source), apply, f"{tmp_path}/check").awaitTermination()
    want = {("k2", 2.0), ("k3", None)}
    read = lambda: {(r.key, r.embedding and r.embedding[0]) for r in spark.read.parquet(f"{tmp_path}/out/batch=0").collect()}
    assert read() == want
    apply(batch, 0)  # the same batch once more
    assert read() == want


def test_summarise(spark):
    df = spark.createDataFrame([(1, "x" * 30), (2, "short"), (3, None)], "id int, t string")
    assert {r.id: r.summary for r in frame.summarise(df, "id", "t", lambda t: t.str[:3], 10).collect()} == {1: "xxx", 2: None, 3: None}


def test_text_search_is_fulltext(spark):
    docs = spark.createDataFrame([(1, "the red fox"), (2, "Fox; fox den"), (3, "foxes"), (4, ""), (5, None)], "id int, text string")
    one = {r.id: round(r.score, 9) for r in S.text_search(docs, "red FOX", 9).collect()}
    two = {r.id: round(r.score, 9) for r in S.fulltext_search(S.postings(docs), S.lengths(docs.where("text is not null")), "red FOX", 9).collect()}
    assert set(one) == {1, 2} == set(two)


def test_search_modes(spark):
    v = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id int, score double")
    t = spark.createDataFrame([(2, 3.0), (3, 2.0)], "id int, score double")
    rows = spark.createDataFrame([(1, "a/x.ts"), (2, "a/y.ts"), (3, "b/z.ts")], "id int, path string")
    assert [(r.id, r.total) for r in S.search(v, t, rows, 9).collect()] == [(1, 3), (2, 3), (3, 3)]
    assert [(r.id, r.total) for r in S.search(v, t, rows, 1, 1, glob="a/*").collect()] == [(2, 2)]
    assert [r.id for r in S.search(None, t, rows, 9, least=2.5).collect()] == [2] and [r.id for r in S.search(v, None, rows, 9).collect()] == [1, 2]
