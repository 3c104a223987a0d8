"""Data files are read and parsed once, whatever the depth of their sections."""

from __future__ import annotations

from tessera.sources import data_files, files


def test_data_files_are_read_once(spark):
    rows = [("a.json", '{"a": {"b": [1, {"c": null}], "d": {}}, "e": "x"}'), ("b.yaml", "k: 1\nm:\n  n: y"), ("c.json", "no"), ("d.json", None)]
    out = data_files.data_entries(spark.createDataFrame(rows, "path string, content string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    want = {("a.json", "a.b.[0]", "1"), ("a.json", "a.b.[1].c", None), ("a.json", "e", "x"), ("b.yaml", "k", "1"), ("b.yaml", "m.n", "y")}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want


def test_sections_end_at_their_depth(spark):
    df = spark.createDataFrame([(1, '{"": {"x": [[7]]}}'), (2, "[]"), (3, "5")], "id long, body string")
    got = lambda depth: sorted((r.path, r.key, r.depth, r.parent, r.type, r.value) for r in files.json_sections(df, "body", ["id"], depth).collect())
    all_ = [("", "", 1, "", "OBJECT", '{"x":[[7]]}'), ("x", "x", 2, "", "ARRAY", "[[7]]"), ("x.[0]", "[0]", 3, "x", "ARRAY", "[7]"), ("x.[0].[0]", "[0]", 4, "x.[0]", "BIGINT", "7")]
    assert got(9) == all_ and got(2) == all_[:2]
