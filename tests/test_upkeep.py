"""Upkeep of dirty rows, summaries and tags, and parts of pages, at their edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import aggregate as A
from tessera.operators import incremental as I
from tessera.operators import resolution as E
from tessera.operators import traverse as X


def test_dirty_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, True), (3, False), (4, True)], "id int, dirty boolean")
    statuses = spark.createDataFrame([(1, "created"), (3, "unchanged"), (9, "modified")], "id int, status string")
    marked = I.mark_changed(rows, statuses)
    assert {r.id: r.dirty for r in marked.collect()} == {1: True, 2: True, 3: False, 4: True}
    assert sorted(r.id for r in I.dirty_rows(I.clear_dirty(marked, spark.createDataFrame([(2,), (2,), (7,)], "id int"))).collect()) == [1, 4]
    assert I.mark_changed(rows.drop("dirty"), statuses).where("dirty").count() == 1 and I.dirty_rows(rows.limit(0)).count() == 0


def test_chunk_tasks(spark):
    rows = spark.createDataFrame([(1, "ab\ncd\nef", "x"), (2, "ab", "y"), (3, None, "z"), (4, "", "w")], "id int, body string, tag string")
    got = [(r.id, r.tag, r.chunk, r.text, r.start_line, r.end_line) for r in I.chunk_tasks(rows, "body", 4, 1).orderBy("id", "chunk").collect()]
    assert got == [(1, "x", 0, "ab\nc", 1, 2), (1, "x", 1, "cd\ne", 2, 3), (1, "x", 2, "ef", 3, 3), (2, "y", 0, "ab", 1, 1), (4, "w", 0, "", 1, 1)]


def test_summaries_of_fields(spark):
    rows = spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "id int, code string")
    made = spark.createDataFrame([(1, "p", ["a", "b"]), (1, "q", ["c"]), (3, "r", None), (8, "s", [])], "id int, purpose string, tags array<string>")
    at = F.lit("2024-01-01").cast("timestamp")
    stored = I.store_summaries(rows, made, "code", at)
    assert {(r.id, r.purpose, r.tags, r.current) for r in I.load_summaries(stored, "code").collect()} >= {(1, "q", "c", True)}
    again = I.store_summaries(stored.withColumn("code", F.upper("code")), made.where("id = 2"), "code", at)
    assert [(r.id, r.purpose, r.current) for r in I.load_summaries(again, "code").where("id = 1").collect()] == [(1, "q", False)]
    left = I.delete_summaries(again, spark.createDataFrame([(1,), (1,)], "id int"), "code")
    assert left.count() == 3 and I.load_summaries(left, "code").where("id = 1").count() == 0


def test_progress_and_backlog_of_nothing(spark):
    files = spark.createDataFrame([("linked",), ("embedded",), (None,)], "state string")
    nodes = spark.createDataFrame([(True,), (None,)], "dirty boolean")
    assert A.vector_backlog(files, nodes).first() == (1, 1, True) and A.vector_backlog(files.limit(0), nodes.limit(0)).first() == (0, 0, False)
    assert A.vector_progress(files).first() == (2, 1, 1, 0, 0, 50.0) and A.vector_progress(files.limit(0)).first() == (0, 0, 0, 0, 0, 100.0)


def test_stored_tags(spark):
    tags = spark.createDataFrame([("a-b", "Old", "c", ["p"], 3), ("z", "Z", None, None, 1)], "tag string, name string, category string, projects array<string>, usage long")
    uses = spark.createDataFrame([(1, "A b", "k", "q"), (1, "a B", None, "p"), (2, "new", None, None), (3, None, "k", "q"), (2, "NEW", "m", "r")], "node int, name string, category string, project string")
    merged, links = E.upsert_tags(tags, uses)
    assert {tuple(r) if r.projects is None else (r.tag, r.name, r.category, tuple(r.projects), r.usage) for r in merged.collect()} == {("a-b", "Old", "c", ("p", "q"), 5), ("z", "Z", None, (), 1), ("new", "NEW", "m", ("r",), 2)}
    assert {tuple(r) for r in links.collect()} == {(1, "a-b"), (2, "new")}
    assert E.upsert_tags(tags.limit(0), uses.limit(0))[0].count() == 0


def test_parts_of_pages(spark):
    html = """<head><meta name=a content="x"><meta content="1" name="n"><META NAME='n' CONTENT='2'><meta name="empty" content=""><meta property="og:t" content="y">
<script type="module" src="./m.ts"></script><script>var a = 1</script><SCRIPT SRC='https://x.y/z.js'></SCRIPT><link rel=icon href="/i.ico"><link href="s.SCSS"></head>
<article href="no"><a id=1 href="p.md#top">1</a><a href="#top">2</a><a href="x.py">3</a><a href="/dir/">4</a><a href="JavaScript:go()">5</a><img data-k="1" src="a/b.png"><h2 class="q">T <b>w</b></h2><h3> </h3><hr><h1>
x</h1>"""
    df = spark.createDataFrame([(html,), ("",), (None,)], "html string")
    r = df.select(T.html_references(F.col("html")).alias("refs"), T.meta_tags(F.col("html")).alias("meta"), T.outline(F.col("html")).alias("outline")).collect()
    assert [tuple(x) for x in r[0].refs] == [("./m.ts", "code"), ("/i.ico", "asset"), ("s.SCSS", "stylesheet"), ("a/b.png", "asset"), ("p.md", "document"), ("x.py", "code"), ("/dir/", "document")]
    assert r[0].meta == {"n": "2", "og:t": "y"} and [tuple(x) for x in r[0].outline] == [(2, "T w"), (1, "\nx")]
    assert (r[1].refs, r[1].meta, r[1].outline) == ([], {}, []) and (r[2].refs, r[2].meta, r[2].outline) == (None, None, None)


def test_far_neighbours(spark):
    edges = spark.createDataFrame([("a", "b", "E"), ("b", "c", "E"), ("c", "a", "F"), ("a", "b", "G"), ("c", "d", "E"), ("x", "a", "E")], "src string, dst string, type string")
    nodes = spark.createDataFrame([(i,) for i in "abcd"], "id string")
    got = {(r.type, r.depth): r.ids for r in X.explore_far("a", edges, nodes, 3, 9).collect()}
    assert got == {("E", 1): "b", ("G", 1): "b", ("F_BY", 1): "c", ("E", 2): "d"}
    assert X.explore_far("a", edges, nodes, 3, 1).count() == 2 and X.explore_far("none", edges, nodes, 2).count() == 0
