"""Stored indexes and bucketed tables: same results as without them, fewer files read, upkeep equal to a new build."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import incremental as I
from tessera.operators import search as S
from tessera.plans.stored import new_folder
from tessera.sources import buckets as B
from tessera.sources import line_index, text_index, vector_index


def files(df):
    return {r.f for r in df.select(F.input_file_name().alias("f")).distinct().collect()} - {""}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- bucketed tables ----


def test_merge_rewrites_touched_buckets_only(spark):
    root = new_folder(spark)
    old = spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(400)] + [(None, "none", 0.0)], "id long, name string, v double")
    first = B.create(old, root, ["id"], 16)
    assert len(first.place) == 16 and first.read().count() == 401
    batch = spark.createDataFrame([(5, "five", None), (900, "new", 1.0)], "id long, name string, v double")
    second = B.merge(spark, root, batch, lambda o, n: I.upsert(o, n, ["id"]), batch=3)
    touched = {r.b for r in batch.select(B.bucket_of(["id"], 16).alias("b")).collect()}
    assert {b for b in second.place if second.place[b] != first.place[b]} == touched
    both = files(first.read()) & files(second.read())
    assert len(both) == 16 - len(touched) and all(f"bucket={b}/" not in f for b in touched for f in both)
    want = sorted(map(str, I.upsert(old, batch, ["id"]).collect()))
    assert sorted(map(str, second.read().drop("bucket").select("id", "name", "v").collect())) == want
    again = B.merge(spark, root, batch, lambda o, n: I.upsert(o, n, ["id"]), batch=3)
    assert again.version == second.version
    twice = B.merge(spark, root, batch, lambda o, n: I.upsert(o, n, ["id"]), batch=4)
    assert sorted(map(str, twice.read().drop("bucket").select("id", "name", "v").collect())) == want
    one = twice.where_key(5)
    assert [r.name for r in one.collect()] == ["five"] and "PartitionFilters: [" in plan(one) and len(files(one)) == 1
    assert sorted(map(str, B.Bucketed(spark, root, 0).read().drop("bucket").collect())) == sorted(map(str, old.collect()))  # the old version stays readable
    B.expire(spark, root, 1)
    assert sorted(map(str, B.Bucketed(spark, root).read().drop("bucket").select("id", "name", "v").collect())) == want
    assert B.merge(spark, root, batch.limit(0), lambda o, n: o).version == twice.version


def test_two_writers(spark):
    root = new_folder(spark)
    B.create(spark.createDataFrame([(1, "a")], "id long, t string"), root, ["id"], 4)

    def slow(old, new):  # meanwhile another writer commits
        B.merge(spark, root, new, lambda o, n: n)
        return new

    with pytest.raises(RuntimeError, match="another writer"):
        B.merge(spark, root, spark.createDataFrame([(1, "b")], "id long, t string"), slow)
    assert [r.t for r in B.Bucketed(spark, root).read().collect()] == ["b"]


def test_delete_empties_a_bucket(spark):
    root = new_folder(spark)
    B.create(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, t string"), root, ["id"], 64)
    gone = spark.createDataFrame([(2,)], "id long")
    out = B.merge(spark, root, gone, lambda o, n: o.join(n, "id", "left_anti"))
    assert sorted(r.id for r in out.read().collect()) == [1, 3] and out.read([]).count() == 0


# ---- words ----


def texts(rng, n, words=("red", "fox", "foxes", "den", "Fox", "ox", "über", "x1", "deep", "river")):
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(n)]


def hits(df):
    return [(r.id, round(r.score, 9)) for r in df.collect()]


def test_text_index_equals_search_without(spark):
    rng, root = random.Random(1), new_folder(spark)
    docs = spark.createDataFrame([*texts(rng, 120), (500, None), (501, "")], "id long, text string")
    text_index.build(docs, root, buckets=8)
    for ask in ("fox", "Red, fox!", "nothing", "über river", ""):
        assert hits(text_index.search(spark, root, ask, 30)) == hits(S.fulltext_search(S.postings(docs), S.lengths(docs), ask, 30))
    for ask in ("fox", "dep rivr"):
        assert hits(text_index.search(spark, root, ask, 30, edits=1)) == hits(S.fulltext_search(S.postings(docs), S.lengths(docs), ask, 30, edits=1))
    postings = B.Bucketed(spark, f"{root}/postings")
    assert len(files(postings.where_key("fox"))) == 1 < len(files(postings.read()))


def test_updated_index_equals_rebuilt(spark):
    rng, one, two = random.Random(2), new_folder(spark), new_folder(spark)
    old = dict(texts(rng, 100))
    text_index.build(spark.createDataFrame(list(old.items()), "id long, text string"), one, buckets=8)
    changed = dict([*texts(rng, 20)[5:], (200, "a new red word"), (7, None)])
    changed = {(i if i in (7, 200) else i * 3): t for i, t in changed.items()}
    removed = [90, 91, 999]
    args = (spark.createDataFrame(list(changed.items()), "id long, text string"), spark.createDataFrame([(i,) for i in removed], "id long"))
    for _ in range(2):  # the second call of the same batch changes nothing
        text_index.update(spark, one, *args, batch=1)
    now = {i: t for i, t in {**old, **changed}.items() if i not in removed}
    text_index.build(spark.createDataFrame(list(now.items()), "id long, text string"), two, buckets=8)
    for name in ("postings", "terms"):
        rows = [sorted(map(str, B.Bucketed(spark, f"{r}/{name}").read().drop("bucket").select(*cols).collect())) for r in (one, two) for cols in [["term", "id", "tf", "length"] if name == "postings" else ["size", "term", "df"]]]
        assert rows[0] == rows[1]
    assert hits(text_index.search(spark, one, "red new", 50)) == hits(text_index.search(spark, two, "red new", 50))


def test_unfinished_update_is_completed(spark):
    """A failure after the postings were merged: the same batch again merges what is missing."""
    rng, one, two = random.Random(3), new_folder(spark), new_folder(spark)
    old = dict(texts(rng, 40))
    text_index.build(spark.createDataFrame(list(old.items()), "id long, text string"), one, buckets=4)
    changed = spark.createDataFrame([(3, "red red den"), (4, "")], "id long, text string")
    merge, calls = B.merge, []

    def failing(*a, **k):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        return merge(*a, **k)

    text_index.B.merge = failing
    try:
        with pytest.raises(OSError):
            text_index.update(spark, one, changed, batch=7)
    finally:
        text_index.B.merge = merge
    text_index.update(spark, one, changed, batch=7)
    text_index.build(spark.createDataFrame(list((old | {3: "red red den", 4: ""}).items()), "id long, text string"), two, buckets=4)
    for ask in ("red", "fox den"):
        assert hits(text_index.search(spark, one, ask, 50)) == hits(text_index.search(spark, two, ask, 50))


# ---- vectors ----


def test_cells(spark):
    rng, root = random.Random(4), new_folder(spark)
    near = lambda c: [x + rng.gauss(0, 0.2) for x in c]
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(10)]
    rows = [(i, near(rng.choice(centres)), i % 3) for i in range(600)] + [(1000, [0.0] * 12, 0), (1001, None, 0)] + [(2000 + i, centres[0], 1) for i in range(100)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>, label int").repartition(4)
    vector_index.build_cells(v, root, 10)
    for q in (centres[0], centres[3], [0.0] * 12):
        for where in (None, F.col("label") != 1):
            want = hits(S.vector_search(v, q, 15, where=where))
            assert [i for i, _ in hits(vector_index.cell_search(spark, root, q, 15, None, where=where))] == [i for i, _ in want]
    few = vector_index.cell_search(spark, root, centres[3], 5, 2)
    assert re.search(r"PartitionFilters: \[.*cell#\d+ (IN \(\d+,\d+\)|INSET \d+, \d+)", plan(few))
    asked = v.where("id % 50 = 0 and embedding is not null").select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
    every = vector_index.search_many(spark, root, asked, 5, None).collect()
    for q in asked.collect():
        assert [(r.id, round(r.score, 6)) for r in sorted((r for r in every if r["query"] == q["query"]), key=lambda r: (-r.score, r.id))] == [(i, round(s, 6)) for i, s in hits(vector_index.cell_search(spark, root, q.vector, 5, None))]
    probes = vector_index.probes_for(spark, root, asked, 10, 0.9)
    assert probes < 10 and vector_index.recall(spark, root, asked, 10, probes) >= 0.9
    vector_index.add_vectors(spark, root, spark.createDataFrame([(5000, centres[5], 0)], "id long, embedding array<float>, label int"))
    assert hits(vector_index.cell_search(spark, root, centres[5], 1, 1))[0][0] == 5000


# ---- lines ----

PATTERNS = [
    "river", "red fox", "(?i)RIVER", "r[aeiou]ver", "fo+x", "(fox|ox) den", "deep( red)? river", "^red", "den$", "[a-z]+", "a{3}b", r"x\d", r"\bden\b", "ri(?=ver)ver", "(?:deep ){2}", "über", "Ü", "(", "no such words", "dee[p]",
]


@pytest.fixture(scope="module")
def lines(spark):
    rng, root = random.Random(5), new_folder(spark)
    rows = [(i, "\n".join(" ".join(rng.choice(["red", "fox", "den", "Fox", "über", "x1", "deep", "river", "aaab"]) for _ in range(rng.randrange(5))) for _ in range(3)), f"d/{i % 2}.txt") for i in range(150)]
    rows += [(900, None, "d/n"), (901, "", "d/e"), (902, "River ends here", "d/r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    line_index.build(docs, root, buckets=8)
    return docs, root


@pytest.mark.parametrize("pattern", [p for p in PATTERNS if p != "("])
def test_indexed_grep(spark, lines, pattern):
    docs, root = lines
    for ignore in (False, True):
        assert sorted(map(tuple, line_index.indexed_grep(spark, root, pattern, ignore_case=ignore).collect())) == sorted(map(tuple, S.grep(docs, pattern, ignore).collect()))


def test_fewer_rows_are_read(spark, lines):
    docs, root = lines
    assert line_index.needed("(") is None and line_index.needed("[a-z]+") is None and line_index.needed(r"\p{L}iver") is None and line_index.needed("(?i)river") is None
    assert line_index.needed("fox|ox") is None and line_index.needed("deep( red)? river") == [" ri", "dee", "eep", "ive", "riv", "ver"]
    some = line_index.candidate_texts(spark, root, "River ends")
    assert [r.doc_id for r in some.collect()] == [902] and sum("/texts/" in f for f in some.inputFiles()) == 1 < len(files(B.Bucketed(spark, f"{root}/texts").read()))
    assert line_index.candidate_texts(spark, root, "[a-z]+").count() == docs.count()


def test_updated_lines(spark):
    root, docs = new_folder(spark), [(1, "the red fox"), (2, "a deep river"), (3, "nothing")]
    line_index.build(spark.createDataFrame(docs, "doc_id long, text string"), root, buckets=4)
    change = spark.createDataFrame([(2, "a red den"), (4, "the river")], "doc_id long, text string")
    line_index.update(spark, root, change, batch=1)
    line_index.update(spark, root, change, batch=1)
    ids = lambda p: sorted(r.doc_id for r in line_index.candidate_texts(spark, root, p).collect())
    assert ids("river") == [4] and ids("red") == [1, 2] and ids("deep") == []


def test_indexed_fuzzy_grep(spark, lines):
    docs, root = lines
    words = new_folder(spark)
    text_index.build(docs, words, "doc_id", buckets=8)
    for keys, t in ((["rivers", "dens"], 0.7), (["foxy"], 0.75)):
        assert sorted(map(tuple, line_index.indexed_fuzzy_grep(spark, root, words, keys, t).collect())) == sorted(map(tuple, S.fuzzy_grep(docs, keys, t).collect()))
