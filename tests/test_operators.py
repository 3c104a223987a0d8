from __future__ import annotations

import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import conversations as V
from tessera.operators import incremental as I
from tessera.operators import ranking as R
from tessera.operators import search as S
from tessera.operators import traverse as X
from tessera.operators.predicates import glob_regex
from tessera.sources import files
from tessera.streaming import feed


@pytest.mark.parametrize(
    ("glob", "path", "text", "want"),
    [
        ("*.ts", True, "a.ts", True), ("*.ts", True, "d/a.ts", False), ("**/*.ts", True, "d/e/a.ts", True), ("**/*.ts", True, "a.ts", True),
        ("src/**", True, "src/a/b", True), ("a?c", False, "abc", True), ("[!a]x", False, "bx", True), ("[!a]x", False, "ax", False),
        ("[[:digit:]]*", False, "7up", True), ("*", True, "..", False), ("a.b", False, "axb", False), ("*x*", False, "a/x/b", True),
    ],
)
def test_glob(spark, glob, path, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.col("t").rlike(glob_regex(glob, path=path))).first()[0] is want


def test_turns(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("system", "s"), ("assistant", "early"), ("user", "q1"), ("assistant", " "), ("assistant", "a1"), ("tool", "x"), ("assistant", "a2"), ("user", "q2"), ("user", "q3"), ("assistant", "a3")])]
    got = V.turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).orderBy("turn_id").collect()
    assert [(r.question, r.answer, r.n_messages) for r in got] == [("q1", "a2", 5), ("q3", "a3", 2)]
    assert V.turns(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).count() == 0


def test_stream_equals_batch(spark):
    rows = [(f"k{i % 5}", "updated" if i % 3 else "created", datetime(2024, 1, 1) + timedelta(seconds=i)) for i in range(60)]
    src, out, mark = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(3))
    df = spark.createDataFrame(rows, "key string, change_type string, ts timestamp")
    df.repartition(3).write.mode("append").parquet(src)
    seen = {}

    def apply(batch, batch_id):
        for r in feed.running_statistics(batch).collect():
            seen[r.change_type] = seen.get(r.change_type, 0) + r.n

    feed.apply_batches(spark.readStream.schema(df.schema).parquet(src), apply, mark).awaitTermination()
    assert seen == {r.change_type: r.n for r in feed.running_statistics(df).collect()}
    assert out


def test_upsert_twice_equals_once(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, name string, v double")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, name string")
    once = I.upsert(old, new, ["id"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1.0), (2, "c", 2.0), (3, "d", None)] == sorted(map(tuple, I.upsert(once, new, ["id"]).collect()))


def test_budget_skip(spark):
    rows = [(1, i, n) for i, n in enumerate([50, 90, 30, 200, 5])]
    df = spark.createDataFrame(rows, "c int, k long, size int")
    assert sorted(r.k for r in R.budget_skip(df, "c", ["k"], "k", "size", 150).collect()) == [0, 1, 4]
    assert sorted(r.k for r in R.budget_skip(df, "c", ["k"], "k", "size", 300).collect()) == [0, 1, 2]


def test_pack(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([5, 4, 3, 9, 1])], "g string, i int, n int")
    got = R.pack(df, ["g"], ["i"], F.col("n"), 10, base=0).orderBy("i").collect()
    assert [r.pack for r in got] == [0, 0, 1, 2, 2]


def test_chunks_cover_text(spark):
    body = "Para one. It is short.\n\nPara two is here.\n\n" + "Word word. " * 300
    df = spark.createDataFrame([(body,)], "t string")
    fixed = df.select(F.inline(T.fixed_chunks(F.col("t"), 500, 100))).collect()
    assert all(body[c.start_char : c.end_char] == c.text for c in fixed) and fixed[-1].end_char == len(body)
    for strategy in ("paragraph", "sentence"):
        made = df.select(F.inline(T.chunks(F.col("t"), 500, 50, 100, strategy))).collect()
        assert len(made) > 3 and max(len(c.text) for c in made) < 900


def test_web(spark):
    pages = [("https://a.org/", '<a href="/x">x</a><a href="https://a.org/">self</a>'), ("https://a.org/x", '<a href="/y#f">y</a><a href="/">home</a>'), ("https://a.org/y", '<a href="https://b.org/z">out</a><a href="x">back</a>')]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id int, url string, html string")
    links = sorted(map(tuple, files.page_links(df).collect()))
    assert links == [("https://a.org", "https://a.org/x"), ("https://a.org/x", "https://a.org"), ("https://a.org/x", "https://a.org/y"), ("https://a.org/y", "https://a.org/x")]
    assert [tuple(r) for r in files.crawl(files.page_links(df), "https://a.org", 2, 10).collect()] == [("https://a.org", 0), ("https://a.org/x", 1), ("https://a.org/y", 2)]


def test_references(spark):
    files_ = spark.createDataFrame([("src/a.ts",), ("src/lib/index.ts",), ("src/b.ts",), ("docs/b.ts",), ("src/hello.py",)], "path string")
    imports = spark.createDataFrame([("src/a.ts", "./lib"), ("src/a.ts", "./b.js"), ("src/a.ts", "./none")], "file string, module string")
    assert {r.module: r.target for r in X.resolve_imports(imports, files_).collect()} == {"./lib": "src/lib/index.ts", "./b.js": "src/b.ts"}
    refs = spark.createDataFrame([("lib/index.ts",), ("hello.py",), ("b.ts",), ("helo.py",)], "ref string")
    got = {r.ref: (r.path, round(r.score, 3)) for r in S.resolve_loose(refs, files_).collect()}
    assert got["lib/index.ts"] == ("src/lib/index.ts", 1.0) and got["hello.py"][0] == "src/hello.py" and got["helo.py"] == ("src/hello.py", 0.875)
    src = spark.createDataFrame([("from .a import b, c as d\nimport os\nx = 1",)], "t string")
    assert [(r.line, r.module, r.symbols, r.local) for r in src.select(F.inline(T.python_imports(F.col("t")))).collect()] == [(1, ".a", ["b", "c"], True), (2, "os", [], False)]
    js = spark.createDataFrame([("import x from './m'\nexport { y } from \"pkg\"\nconst z = require('../z')",)], "t string")
    assert {(r.module, r.local) for r in js.select(F.inline(T.script_imports(F.col("t")))).collect()} == {("./m", True), ("pkg", False), ("../z", True)}


def test_scopes(spark):
    s = spark.createDataFrame([("p", "1", "Base", "class Base"), ("p", "2", "Kid", "class Kid extends Base"), ("p", "3", "Py", "class Py(Base, object):")], "project_id string, id string, name string, signature string")
    assert sorted(map(tuple, X.inheritance(s).collect())) == [("2", "1"), ("3", "1")]
    rel = spark.createDataFrame([("a", "b", "CALLS"), ("a", "b", "CALLS"), ("b", "a", "CALLED_BY"), ("d", "f", "DECORATES")], "src string, dst string, kind string")
    assert sorted(map(tuple, X.scope_edges(rel).collect())) == [("a", "b", "CALLS"), ("f", "d", "DECORATED_BY")]
