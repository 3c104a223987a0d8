"""Queries over stored indexes and bucketed tables. An index is built once for a folder of tables and serves all queries of a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import incremental as I
from tessera.operators import resolution as E
from tessera.operators import search as S
from tessera.operators import traverse as X
from tessera.operators.ranking import page
from tessera.operators.running import ranked
from tessera.plans import graph
from tessera.plans.graph import table
from tessera.plans.stored import new_folder, stored
from tessera.queries import _CH, _HYBRID, _T8, _bm25, _changes, r6, vec_of, vectors
from tessera.registry import ORACLE_SQL, query
from tessera.sources import buckets as B
from tessera.sources import data_files, files, line_index, text_index, vector_index

_built: dict[tuple[str, str, str], str] = {}


def built(spark: SparkSession, d: str, name: str, make: Callable[[str], None]) -> str:
    """The folder of an index of the tables in d, built at first use."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _built:
        root = new_folder(spark, name)
        make(root)
        _built[key] = root
    return _built[key]


def text_root(spark: SparkSession, d: str) -> str:
    return built(spark, d, "words", lambda root: text_index.build(table(spark, d, "documents"), root, "doc_id", buckets=32))


def cell_root(spark: SparkSession, d: str) -> str:
    return built(spark, d, "cells", lambda root: vector_index.build_cells(vectors(spark, d), root, 16))


def line_root(spark: SparkSession, d: str) -> str:
    return built(spark, d, "lines", lambda root: line_index.build(table(spark, d, "documents"), root, buckets=32))


# --- vectors by cell ------------------------------------------------------------------------------------------------


@query("s1_cell_search", ORACLE_SQL["s1_vector_search"])
def s1_cells(spark, d):
    return vector_index.cell_search(spark, cell_root(spark, d), vec_of(spark, d), 10, None, where=F.col("label") != 3).withColumn("score", r6(F.col("score")))


@query("s16_cell_filtered", ORACLE_SQL["s16_filtered_vectors"])
def s16_cells(spark, d):
    return vector_index.cell_search(spark, cell_root(spark, d), vec_of(spark, d), 10, None, where=F.col("label").isin(1, 2)).withColumn("score", r6(F.col("score")))


@query("s2_cell_fields", ORACLE_SQL["s2_multi_field"])
def s2_cells(spark, d):
    v = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("id"), F.when(F.col("vec_id") % 2 == 0, "name").otherwise("content").alias("field"), "embedding")
    root = built(spark, d, "field_cells", lambda to: vector_index.build_cells(v, to, 16))
    return vector_index.cell_search_fields(spark, root, vec_of(spark, d), ["name", "content"], 20, None).withColumn("score", r6(F.col("score")))


@query("s1_cell_recall", "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def s1_recall(spark, d):
    """Whether the number of cells chosen for a recall at 10 of 0.9 reaches it, on every fiftieth vector against all."""
    root = cell_root(spark, d)
    asked = stored(table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")))
    probes = vector_index.probes_for(spark, root, asked, 10, 0.9)
    return asked.agg(F.count("*").alias("queries")).withColumn("enough", F.lit(vector_index.recall(spark, root, asked, 10, probes) >= 0.9))


# --- words ----------------------------------------------------------------------------------------------------------


@query("s6_indexed", ORACLE_SQL["s6_fulltext"])
def s6_indexed(spark, d):
    return text_index.search(spark, text_root(spark, d), "Thing, with", 20).withColumn("score", r6(F.col("score")))


@query("s6_indexed_fuzzy", ORACLE_SQL["s6_fulltext_fuzzy"])
def s6_fuzzy(spark, d):
    return text_index.search(spark, text_root(spark, d), "thing", 20, edits=1).withColumn("score", r6(F.col("score")))


@query("s6_index_updated", f"SELECT id, round(score, 6) AS score FROM ({_bm25(['thing', 'with'], 20)})")
def s6_updated(spark, d):
    """An index of older documents, brought up to date: some texts were other ones, some documents are new, some are no longer there."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    part = F.col("doc_id") % 10
    old = docs.where(part != 3).withColumn("text", F.when(part == 4, F.concat(F.lit("thing thing "), F.substring("text", 1, 400))).otherwise(F.col("text")))
    gone = docs.where(part == 5).select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text")

    def make(root):
        text_index.build(old.unionByName(gone), root, "doc_id", buckets=32)
        text_index.update(spark, root, docs.where(part.isin(3, 4)), gone.select("doc_id"), "doc_id", batch=1)

    return text_index.search(spark, built(spark, d, "updated_words", make), "thing with", 20).withColumn("score", r6(F.col("score")))


@query("s8_indexed_hybrid", _HYBRID + " SELECT id, round(score, 6) AS score FROM x ORDER BY x.score DESC, id LIMIT 20")
def s8_indexed(spark, d):
    near = vector_index.cell_search(spark, cell_root(spark, d), vec_of(spark, d), 60, None, least=0.1)
    return S.hybrid(near, text_index.search(spark, text_root(spark, d), "thing with", 60), 20).withColumn("score", r6(F.col("score")))


# --- lines ----------------------------------------------------------------------------------------------------------


@query("s17_indexed_grep", ORACLE_SQL["s17_grep"].replace("th[aeiou]re", "with[a-z]*the"))
def s17_indexed(spark, d):
    hits = line_index.indexed_grep(spark, line_root(spark, d), "with[a-z]*the")
    return hits.select("doc_id", F.col("line").cast("long").alias("line"), "match", F.col("n_lines").cast("long").alias("n_lines"))


@query("s18_indexed_fuzzy", ORACLE_SQL["s18_fuzzy_grep"])
def s18_indexed(spark, d):
    hits = line_index.indexed_fuzzy_grep(spark, line_root(spark, d), text_root(spark, d), ["thing", "pour"], 0.8)
    return hits.groupBy("doc_id", "keyword").agg(F.count("*").alias("n"))


# --- merges into stored snapshots -----------------------------------------------------------------------------------


@query(
    "a8_bucket_merge",
    "SELECT o_orderkey AS id, CASE WHEN o_custkey = 7 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_custkey = 7 THEN 0.0 ELSE o_totalprice END AS price FROM orders WHERE o_custkey <> 4 UNION ALL SELECT o_orderkey + 100000000, 'N', o_totalprice FROM orders WHERE o_custkey = 10",
)
def a8_buckets(spark, d):
    """Orders in buckets by key, then a batch for three customers: changed, deleted and new rows; only buckets that hold one are rewritten."""
    orders = table(spark, d, "orders")
    rows = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.lit(False).alias("gone"))
    mine = orders.where("o_custkey in (4, 7, 10)").select(
        F.when(F.col("o_custkey") == 10, F.col("o_orderkey") + 100_000_000).otherwise(F.col("o_orderkey")).alias("id"), F.when(F.col("o_custkey") == 10, "N").otherwise("X").alias("status"),
        F.when(F.col("o_custkey") == 10, F.col("o_totalprice")).otherwise(0.0).alias("price"), (F.col("o_custkey") == 4).alias("gone"),
    )

    def make(root):
        B.create(rows, root, ["id"], 64)
        B.merge(spark, root, stored(mine), lambda old, new: I.upsert(old, new, ["id"]).where("not gone"), batch=1)

    return B.Bucketed(spark, built(spark, d, "orders_merged", make)).read().select("id", "status", "price")


@query("a9_bucket_edges", "SELECT DISTINCT 'orders:' || l_orderkey AS src, 'part:' || l_partkey AS dst FROM lineitem WHERE l_partkey % 3 <> 0 OR l_orderkey % 5 = 0")
def a9_buckets(spark, d):
    """Edges in buckets by source; a batch of edges of some sources is laid over them, each triple once."""
    edges = graph.edges(spark, d, ["CONTAINS"])
    part, order = F.substring_index("dst", ":", -1).cast("long"), F.substring_index("src", ":", -1).cast("long")

    def make(root):
        B.create(edges.where(part % 3 != 0), root, ["src"], 64)
        new = edges.where((part % 3 == 0) & (order % 5 == 0))
        B.merge(spark, root, stored(new.unionByName(new)), lambda old, more: old.unionByName(more).distinct(), batch=1)

    return B.Bucketed(spark, built(spark, d, "edges_merged", make)).read().select("src", "dst")


# --- ranks over all rows, and the forms of change history for users --------------------------------------------------


@query("w3_global_ranks", "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
def w3_global(spark, d):
    return ranked(table(spark, d, "documents").select("doc_id", "n_chars"), [], [F.desc("n_chars"), F.col("doc_id").asc()]).select("doc_id", "rank")


def _log(spark, d):
    return _changes(table(spark, d, "events")).withColumnsRenamed({"event_id": "id", "user_id": "entity"})


@query("c6_user_recent", f"SELECT event_id AS id FROM {_CH} WHERE entity_type IN ('u1', 'u2') ORDER BY ts DESC, event_id LIMIT 50")
def c6_recent(spark, d):
    return I.user_recent(_log(spark, d), ["u1", "u2"], 500).select("id")


@query("c6_user_range", f"SELECT event_id AS id FROM {_CH} WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09' AND change_type = 'deleted' ORDER BY ts DESC, event_id LIMIT 30")
def c6_range(spark, d):
    at = lambda s: F.lit(s).cast("timestamp")
    return I.user_range(_log(spark, d), at("2024-01-05"), at("2024-01-09"), "deleted", 30).select("id")


@query(
    "c6_user_statistics",
    f"""SELECT 'change_type' AS kind, change_type AS name, count(*) AS n, CAST(sum(lines_added) AS BIGINT) AS added, CAST(sum(lines_removed) AS BIGINT) AS removed FROM {_CH} GROUP BY 2 UNION ALL SELECT 'entity_type', entity_type, count(*), CAST(sum(lines_added) AS BIGINT), CAST(sum(lines_removed) AS BIGINT) FROM {_CH} GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'entity', CAST(user_id AS VARCHAR), count(*), CAST(sum(lines_added) AS BIGINT), CAST(sum(lines_removed) AS BIGINT) FROM {_CH} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""",
)
def c6_statistics(spark, d):
    return I.user_statistics(_log(spark, d)).drop("latest")


@query("c4_most_modified", f"SELECT CAST(user_id AS VARCHAR) AS name, count(*) AS n FROM {_CH} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def c4_most(spark, d):
    counts = _log(spark, d).groupBy(F.col("entity").cast("string").alias("name")).agg(F.count("*").alias("n"))
    return page(counts, [F.desc("n"), F.col("name")], 20)


# --- walks of many levels, nested data, a scorer ---------------------------------------------------------------------

_WALK = """WITH RECURSIVE e AS (SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, 'IN_NATION' AS type FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'IN_REGION' FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'SUPPLIER_IN' FROM supplier),
w AS (SELECT * FROM e UNION ALL SELECT dst, src, type FROM e), r(id, depth) AS (SELECT 'customer:1', 0 UNION SELECT w.dst, depth + 1 FROM r JOIN w ON w.src = r.id WHERE depth < 5), m AS (SELECT id, min(depth) AS depth FROM r GROUP BY 1)"""


@query("t3_reach", _WALK + " SELECT m.id, m.depth, string_agg(DISTINCT w.type, ',' ORDER BY w.type) AS types FROM m JOIN w ON w.dst = m.id JOIN m p ON p.id = w.src AND p.depth = m.depth - 1 GROUP BY 1, 2")
def t3_reach(spark, d):
    """Five levels from one customer over edges walked both ways, which lead in circles."""
    edges = graph.edges(spark, d, ["IN_NATION", "IN_REGION", "SUPPLIER_IN"])
    found = X.reach(spark.createDataFrame([("customer:1",)], "id string"), edges, 5, direction="both")
    return found.select("id", "depth", F.array_join("types", ",").alias("types"))


@query(
    "t8_edges",
    _T8[: _T8.index("a AS (")].replace("k AS (SELECT id, nxt FROM", "k AS (SELECT id, nxt, type, way FROM")
    + "f AS (SELECT id FROM s UNION SELECT nxt FROM k JOIN s USING (id)) SELECT DISTINCT CASE way WHEN 'o' THEN id ELSE nxt END AS src, CASE way WHEN 'o' THEN nxt ELSE id END AS dst, type FROM k JOIN f USING (id)",
)
def t8_edges(spark, d):
    hits = table(spark, d, "customer").select(graph.node_id("customer", "c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    return X.neighbourhood(hits, graph.edges(spark, d, ["PLACED_BY", "IN_NATION", "CONTAINS"]), depth=2)[1]


@query(
    "a3_nested_sections",
    """SELECT n_nationkey, path, depth, kind, value FROM nation, LATERAL (VALUES ('name', 1, 'STRING', n_name), ('in', 1, 'OBJECT', NULL), ('in.region', 2, 'OBJECT', NULL), ('in.region.key', 3, 'BIGINT', CAST(n_regionkey AS VARCHAR)), ('tags', 1, 'ARRAY', NULL), ('tags.[0]', 2, 'STRING', 'a'), ('tags.[1]', 2, 'STRING', n_name)) t(path, depth, kind, value)""",
)
def a3_nested(spark, d):
    body = F.to_json(F.struct(F.col("n_name").alias("name"), F.struct(F.struct(F.col("n_regionkey").alias("key")).alias("region")).alias("in"), F.array(F.lit("a"), "n_name").alias("tags")))
    found = files.json_sections(table(spark, d, "nation").select("n_nationkey", body.alias("body")), "body", ["n_nationkey"])
    return found.select("n_nationkey", "path", "depth", F.col("type").alias("kind"), F.when(~F.col("type").isin("OBJECT", "ARRAY"), F.col("value")).alias("value"))


@query(
    "a2_nested_entries",
    """WITH s AS (SELECT s_suppkey AS k, s_name AS n, CAST(s_nationkey AS VARCHAR) AS c FROM supplier) SELECT k, CASE k % 3 WHEN 1 THEN 'r.who.name' ELSE 'who.name' END AS key, n AS value FROM s
UNION ALL SELECT k, CASE k % 3 WHEN 1 THEN 'r.place.[0]' ELSE 'place.[0]' END, c FROM s UNION ALL SELECT k, CASE k % 3 WHEN 1 THEN 'r.place.[1]' ELSE 'place.[1]' END, 'x' FROM s""",
)
def a2_nested(spark, d):
    """The same nested content as TOML, XML and YAML."""
    k, n, c = F.col("s_suppkey"), F.col("s_name"), F.col("s_nationkey").cast("string")
    toml = F.concat(F.lit('place = ["'), c, F.lit('", "x"]\n[who]\nname = "'), n, F.lit('"\n'))
    xml = F.concat(F.lit("<r><who><name>"), n, F.lit("</name></who><place>"), c, F.lit("</place><place>x</place></r>"))
    yaml = F.concat(F.lit("# a note\nwho:\n  name: "), n, F.lit('\nplace:\n- "'), c, F.lit('"\n- x\n'))
    text, end = F.when(k % 3 == 0, toml).when(k % 3 == 1, xml).otherwise(yaml), F.when(k % 3 == 0, ".toml").when(k % 3 == 1, ".xml").otherwise(".yml")
    found = data_files.data_entries(table(spark, d, "supplier").select(F.concat(k.cast("string"), end).alias("path"), text.alias("content")))
    return found.select(F.substring_index("path", ".", 1).cast("long").alias("k"), "key", "value")


@query("x4_scorer", "SELECT doc_id AS id, CAST(CASE WHEN lang = 'en' THEN round(0.3 * 0.5 + 0.7 * least(n_chars / 1000.0, 1), 6) ELSE 0.5 END AS DOUBLE) AS score FROM documents")
def x4(spark, d):
    """A scorer that judges English texts by their length and no others."""
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    judge = lambda p: (p["n_chars"] / 1000).clip(upper=1).where(p["lang"] == "en")
    return S.evaluated(docs.select("id", F.lit(0.5).alias("score")), docs, ["lang", "n_chars"], judge).withColumn("score", r6(F.col("score")))


# --- hosts and names ------------------------------------------------------------------------------------------------

_HOST = "lower(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1))"


@query("f7_same_host", f"SELECT a.page_id, b.page_id AS other, {_HOST.format('a.url')} = {_HOST.format('b.url')} AS same FROM pages a JOIN pages b ON b.page_id = a.page_id - a.page_id % 7")
def f7_same(spark, d):
    a = table(spark, d, "pages").select("page_id", "url", (F.col("page_id") - F.col("page_id") % 7).alias("other"))
    b = table(spark, d, "pages").select(F.col("page_id").alias("other"), F.col("url").alias("there"))
    return a.join(b, "other").select("page_id", "other", T.same_host(F.col("url"), F.col("there")).alias("same"))


@query("e6_best_tag", "SELECT p_brand, p_type AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (p_type <> lower(p_type)), length(p_type), p_type) AS r FROM (SELECT p_brand, CASE p_partkey % 2 WHEN 0 THEN lower(p_type) ELSE p_type END AS p_type FROM part)) WHERE r = 1")
def e6_tag(spark, d):
    t = table(spark, d, "part").select("p_brand", F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("name"))
    return t.groupBy("p_brand").agg(F.min_by("name", E.name_rank(F.col("name"), "tag")).alias("name"))


@query(
    "e6_best_person",
    r"""SELECT n, name FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY -len(regexp_split_to_array(trim(name), '\s+')), CASE WHEN regexp_matches(name, '^[A-Z]') THEN 0 ELSE 1 END, CASE WHEN name = upper(name) THEN 1 ELSE 0 END, -length(name), name) AS r
FROM (SELECT c_nationkey AS n, CASE c_custkey % 3 WHEN 0 THEN lower(c_name) WHEN 1 THEN c_name || ' ' || lower(c_mktsegment) ELSE upper(c_name) || ' X' END AS name FROM customer)) WHERE r = 1""",
)
def e6_person(spark, d):
    k, name = F.col("c_custkey") % 3, F.col("c_name")
    told = F.when(k == 0, F.lower(name)).when(k == 1, F.concat_ws(" ", name, F.lower("c_mktsegment"))).otherwise(F.concat(F.upper(name), F.lit(" X")))
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("n"), told.alias("name")).groupBy("n").agg(F.min_by("name", E.name_rank(F.col("name"), "person")).alias("name"))
