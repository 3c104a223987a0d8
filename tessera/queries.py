"""Queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vectors import cosine
from tessera.operators import aggregate as A
from tessera.operators import conversations as V
from tessera.operators import incremental as I
from tessera.operators import predicates as P
from tessera.operators import ranking as R
from tessera.operators import resolution as E
from tessera.operators import search as S
from tessera.operators import traverse as X
from tessera.plans import frame, graph
from tessera.plans.graph import table
from tessera.registry import ORACLE_SQL, QUERIES, query, simple
from tessera.sources import files
from tessera.streaming import feed

def vec_of(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    """One stored vector, as a query vector."""
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")


def r6(c) -> F.Column:
    return F.round(c, 6)


_SIM = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_VQ = "embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"
_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"

# --- predicates and projections -------------------------------------------------------------------------------------

simple("p1_compare", "orders", lambda t: t.where(P.all_of([("o_totalprice", ">=", 100000.0), ("o_orderstatus", "!=", "F")])).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F'")
simple("p2_string_match", "part", lambda t: t.where(P.compare("p_name", "CONTAINS", "a") & P.compare("p_type", "ENDS WITH", "L") & P.compare("p_brand", "STARTS WITH", "Brand")).select("p_partkey"), "SELECT p_partkey FROM part WHERE contains(p_name, 'a') AND p_type LIKE '%L' AND p_brand LIKE 'Brand%'")
simple("p3_in_lists", "customer", lambda t: t.where(P.compare("c_nationkey", "IN", [1, 2, 3]) & P.compare("c_mktsegment", "NOT IN", ["BUILDING"])).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3) AND c_mktsegment NOT IN ('BUILDING')")
simple("p4_operator_map", "lineitem", lambda t: t.where(P.where_map({"l_quantity": {"gte": 10, "lt": 20}, "l_returnflag": "R", "l_linestatus": None, "l_linenumber": {"in": [1, 2]}})).select("l_orderkey", "l_linenumber", "l_quantity"), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_returnflag = 'R' AND l_linenumber IN (1, 2)")
simple("p5_regex", "customer", lambda t: t.where(P.where_pattern("c_name", "0[13]")).withColumn("whole", P.where_pattern("c_name", "Customer#.*[02468]", whole=True)).select("c_custkey", "whole"), "SELECT c_custkey, regexp_full_match(c_name, 'Customer#.*[02468]') AS whole FROM customer WHERE regexp_matches(c_name, '0[13]')")
simple("p6_glob_path", "pages", lambda t: t.withColumn("path", T.url_path(F.col("url"))).where(F.col("path").rlike(P.glob_regex("/**/*[0-9]*", path=True))).select("page_id", "path"), r"SELECT page_id, path FROM (SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS path FROM pages) WHERE regexp_matches(path, '^/([^/]+/)*[^/]*[0-9][^/]*$')")
simple("p7_glob_search", "part", lambda t: P.glob_search(t.select("p_type").distinct(), "p_type", "*t?nd*"), "SELECT DISTINCT p_type FROM part WHERE p_type ILIKE '%t_nd%' ORDER BY p_type LIMIT 50")
simple("p8_result_glob", "pages", lambda t: t.where(F.col("url").rlike(P.glob_regex("https://*.*"))).select("page_id"), "SELECT page_id FROM pages WHERE url LIKE 'https://%.%'")
simple("p9_dispatch", "part", lambda t: t.where(P.compare("p_type", "GLOB", "*S*") & P.compare("p_name", "REGEX", ".*e.*") & P.compare("p_size", "<=", 30)).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_type LIKE '%S%' AND p_name LIKE '%e%' AND p_size <= 30")


@query("p10_named_filter", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
def p10(spark, d):
    filters = P.Filters()
    filters.register("price_between", lambda low, high: F.col("o_totalprice").between(low, high))
    return table(spark, d, "orders").where(filters.use("price_between", low=1000, high=50000)).select("o_orderkey")


simple("p11_user_predicate", "orders", lambda t: frame.Hits(t.select("o_orderkey", "o_totalprice"), "o_orderkey").keep(lambda p: p["o_totalprice"] > 200000).df.select("id"), "SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 200000")
simple("p12_search_filters", "documents", lambda t: t.where(P.all_of([("lang", "in", ["en", "fr"]), ("source", "neq", "src1"), ("n_chars", "gt", 500), ("source", "startsWith", "src")])).select("doc_id"), "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source <> 'src1' AND n_chars > 500 AND source LIKE 'src%'")


@query("p13_project_scope", "SELECT doc_id FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE source LIKE '%3')")
def p13(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("source", "project_id")
    projects = docs.select("project_id").distinct().withColumn("excluded", F.col("project_id").endswith("3"))
    return P.in_projects(docs, projects).select("doc_id")


simple("p14_type_and_path", "pages", lambda t: P.of_types(t.withColumn("type", F.lit("WebPage")), ["webpage"], "https://", path="url").select("page_id"), "SELECT page_id FROM pages WHERE url LIKE 'https://%'")
simple("p15_by_ids", "embeddings", lambda t: P.by_ids(t, [1, 5, 9, 10**9], "vec_id", ["vec_id", "label"]), "SELECT vec_id, label FROM embeddings WHERE vec_id IN (1, 5, 9, 1000000000)")


@query("p16_with_children", "SELECT o_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def p16(spark, d):
    kids = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = P.with_children(table(spark, d, "orders").select("o_orderkey"), kids, "o_orderkey", ["l_linenumber"])
    return out.select("o_orderkey", F.array_join(F.transform("children", lambda c: c["l_linenumber"].cast("string")), ",").alias("lines"))


simple("p17_computed", "lineitem", lambda t: P.computed(t, {"net": "l_extendedprice * (1 - l_discount)"}).where("net > 50000").select("l_orderkey", "l_linenumber", r6(F.col("net")).alias("net")), "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000")
simple("p18_snippets", "documents", lambda t: P.listing(t, "text", drop=["n_chars"]), "SELECT doc_id, substr(text, 1, 200) AS text, lang, source FROM documents")
simple("p19_count", "orders", lambda t: frame.Hits(t, "o_orderkey").where({"o_orderstatus": "O"}).count(), "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
simple("p20_required", "documents", lambda t: P.missing_fields(t.withColumn("title", F.when(F.col("lang") == "en", F.col("source"))), ["title", "text"]).select("doc_id", F.array_join("errors", ",").alias("errors")), "SELECT doc_id, concat_ws(',', CASE WHEN lang <> 'en' OR lang IS NULL THEN 'title' END, CASE WHEN text IS NULL OR text = '' THEN 'text' END) AS errors FROM documents")

# --- graph ----------------------------------------------------------------------------------------------------------

_ID = "'{0}:' || CAST({1} AS VARCHAR)"


@query("t1_hop", "SELECT DISTINCT 'customer:' || CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 1)")
def t1(spark, d):
    n, e = graph.nodes(spark, d, ["part", "orders", "customer"]), graph.edges(spark, d, ["CONTAINS", "PLACED_BY"], unique=False)
    orders = X.hop(n.where("id = 'part:1'"), e, n, "CONTAINS", "in", "orders")
    return X.hop(orders, e, n, "PLACED_BY", "out", "customer").select("id")


@query("t2_related_to", "SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name = (SELECT min(n_name) FROM nation)")
def t2(spark, d):
    n, e = graph.nodes(spark, d, ["nation", "customer"]), graph.edges(spark, d, ["IN_NATION"])
    name = n.where("label = 'nation'").agg(F.min("name")).first()[0]
    return X.related_to(n, e, "IN_NATION", name).select("id")


_EXPAND = """SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS start, 'nation:' || CAST(c_nationkey AS VARCHAR) AS id, 1 AS depth FROM customer
UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), 'region:' || CAST(n_regionkey AS VARCHAR), 2 FROM customer JOIN nation ON n_nationkey = c_nationkey"""


@query("t3_expand", _EXPAND)
def t3(spark, d):
    return X.expand(graph.nodes(spark, d, ["customer"]), graph.edges(spark, d, ["IN_NATION", "IN_REGION"]), None, 2)


@query("t4_expand_filtered", f"SELECT * FROM ({_EXPAND}) WHERE id IN (SELECT 'region:' || CAST(r_regionkey AS VARCHAR) FROM region WHERE r_name LIKE 'A%')")
def t4(spark, d):
    target = graph.nodes(spark, d, ["region"]).where(P.compare("name", "STARTS WITH", "A"))
    return X.expand(graph.nodes(spark, d, ["customer"]), graph.edges(spark, d, ["IN_NATION", "IN_REGION"]), None, 2, target=target)


@query("t5_semi_join", "SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_acctbal > 0 AND c_nationkey = 3")
def t5(spark, d):
    hits = table(spark, d, "customer").where("c_acctbal > 0").select(graph.node_id("customer", "c_custkey").alias("id"))
    n = graph.nodes(spark, d, ["customer", "nation"])
    name = n.where("id = 'nation:3'").first()["name"]
    return frame.Hits(hits).has(graph.edges(spark, d, ["IN_NATION"]), n, "IN_NATION", name).df.select("id")


@query("t6_enrich", "SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS id, n_name AS nations FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def t6(spark, d):
    n = graph.nodes(spark, d, ["customer", "nation"])
    out = X.enrich(n.where("label = 'customer'").select("id"), graph.edges(spark, d, ["IN_NATION"]), n, {"nations": "IN_NATION"})
    return out.select("id", F.array_join("nations", ",").alias("nations"))


@query("t7_hierarchy", "SELECT 'consumers' AS relation, 'orders:' || CAST(o_orderkey AS VARCHAR) AS id, 1 AS depth FROM orders WHERE o_custkey = 1 UNION ALL SELECT 'ancestors', 'nation:' || CAST(c_nationkey AS VARCHAR), 1 FROM customer WHERE c_custkey = 1")
def t7(spark, d):
    n, e = graph.nodes(spark, d, ["customer"]), graph.edges(spark, d, ["PLACED_BY", "IN_NATION"])
    return X.hierarchy(n.where("id = 'customer:1'"), e, "PLACED_BY", "IN_NATION", 1, 10_000)


_T8 = """WITH e AS (SELECT 'orders:' || CAST(o_orderkey AS VARCHAR) AS src, 'customer:' || CAST(o_custkey AS VARCHAR) AS dst, 'PLACED_BY' AS type FROM orders UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), 'nation:' || CAST(c_nationkey AS VARCHAR), 'IN_NATION' FROM customer
UNION ALL SELECT DISTINCT 'orders:' || CAST(l_orderkey AS VARCHAR), 'part:' || CAST(l_partkey AS VARCHAR), 'CONTAINS' FROM lineitem), w AS (SELECT src AS id, dst AS nxt, type, 'o' AS way FROM e UNION ALL SELECT dst, src, type, 'i' FROM e),
k AS (SELECT id, nxt FROM (SELECT *, row_number() OVER (PARTITION BY id, way ORDER BY type, nxt) AS r FROM w) WHERE r <= 15), s AS (SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS id FROM customer ORDER BY c_acctbal DESC, id LIMIT 10),
a AS (SELECT DISTINCT nxt AS id FROM k JOIN s USING (id) WHERE nxt NOT IN (SELECT id FROM s)), b AS (SELECT DISTINCT nxt AS id FROM k JOIN a USING (id) WHERE nxt NOT IN (SELECT id FROM s) AND nxt NOT IN (SELECT id FROM a))
SELECT id, 0 AS depth FROM s UNION ALL SELECT id, 1 FROM a UNION ALL SELECT id, 2 FROM b"""


@query("t8_neighbourhood", _T8)
def t8(spark, d):
    hits = table(spark, d, "customer").select(graph.node_id("customer", "c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    nodes, _ = X.neighbourhood(hits, graph.edges(spark, d, ["PLACED_BY", "IN_NATION", "CONTAINS"]), depth=2)
    return nodes


@query("t9_explore", "SELECT 'IN_NATION' AS type, CAST(1 AS BIGINT) AS n, 'nation:' || CAST(c_nationkey AS VARCHAR) AS ids FROM customer WHERE c_custkey = 1 UNION ALL SELECT 'PLACED_BY_BY', count(*), string_agg('orders:' || CAST(o_orderkey AS VARCHAR), ',' ORDER BY 'orders:' || CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_custkey = 1 HAVING count(*) > 0")
def t9(spark, d):
    return X.explore("customer:1", graph.edges(spark, d, ["PLACED_BY", "IN_NATION"]), graph.nodes(spark, d))


def _scopes(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.size(F.split("text", "\n")).alias("n"))
    ranges = F.explode(F.array(F.struct(F.lit("whole").alias("id"), F.lit(1).alias("start_line"), F.col("n").alias("end_line")), F.struct(F.lit("head").alias("id"), F.lit(1).alias("start_line"), F.ceil(F.col("n") / 2).cast("int").alias("end_line")))).alias("r")
    return docs.select("file", "n", ranges).select("file", "n", "r.*")


@query("t10_innermost", "SELECT CAST(doc_id AS VARCHAR) AS file, line, CASE WHEN n > 1 AND line <= ceil(n / 2) THEN 'head' WHEN n = 1 THEN 'head' ELSE 'whole' END AS id FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), (SELECT unnest([1, 3, 5]) AS line) WHERE line <= n")
def t10(spark, d):
    scopes = _scopes(spark, d)
    points = scopes.select("file").distinct().select("file", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("line"))
    return X.innermost(points, scopes, ["line"]).select("file", "line", "id")


@query("t11_attribute", "SELECT doc_id AS ref, CASE WHEN 3 <= ceil(n / 2) THEN 'head' WHEN 3 <= n THEN 'whole' ELSE 'head' END AS source FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)")
def t11(spark, d):
    refs = table(spark, d, "documents").select(F.col("doc_id").alias("ref"), F.col("doc_id").cast("string").alias("file"), F.lit(3).alias("line"))
    return X.attribute(refs, _scopes(spark, d)).select("ref", "source")


@query("t12_pending", "SELECT 'resolved' AS kind, count(*) AS n FROM orders WHERE o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'pending', count(*) FROM orders WHERE NOT (o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer))")
def t12(spark, d):
    pending = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("target"))
    nodes = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    done, left = X.resolve_pending(pending, nodes)
    return done.agg(F.count("*").alias("n")).select(F.lit("resolved").alias("kind"), "n").unionByName(left.agg(F.count("*").alias("n")).select(F.lit("pending").alias("kind"), "n"))


@query("t16_parent_link", "SELECT l_orderkey AS child, o_custkey AS parent FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1")
def t16(spark, d):
    return table(spark, d, "lineitem").where("l_linenumber = 1").join(table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").select(F.col("l_orderkey").alias("child"), F.col("o_custkey").alias("parent"))


@query("t19_rollup", "WITH c AS (SELECT o_custkey AS id, max(o_totalprice) AS s FROM orders GROUP BY 1) SELECT coalesce(c_custkey, c.id) AS id, round(greatest(coalesce(c_acctbal, 0), coalesce(s, 0)), 6) AS score FROM customer FULL JOIN c ON c.id = c_custkey")
def t19(spark, d):
    parents = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    chunks = table(spark, d, "orders").select(F.col("o_custkey").alias("parent_id"), F.col("o_orderkey").alias("index"), F.col("o_totalprice").alias("score"))
    return X.rollup_chunks(parents, chunks).select("id", r6(F.col("score")).alias("score"))


@query("t20_entity_content", "SELECT doc_id FROM documents WHERE source = 'src3'")
def t20(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("source", "entity")
    entities = docs.select("entity").distinct().select("entity", F.upper("entity").alias("name"), F.array(F.concat(F.lit("x"), "entity")).alias("aliases"))
    return X.mentions_of(docs, entities, "Src3").select("doc_id")


# --- aggregates -----------------------------------------------------------------------------------------------------

simple("g1_aggregate", "lineitem", lambda t: A.aggregate(t.where("l_quantity < 25"), "AVG", "l_extendedprice").select(r6(F.col("value")).alias("value")), "SELECT round(avg(l_extendedprice), 6) AS value FROM lineitem WHERE l_quantity < 25")
simple("g2_group_by", "lineitem", lambda t: A.aggregate(t, "COUNT", None, "l_returnflag"), "SELECT l_returnflag, count(*) AS value FROM lineitem GROUP BY 1 ORDER BY 2 DESC LIMIT 100")


def _changes(t: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("updated")
    return t.withColumns({"change_type": kind, "entity_type": F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")), "lines_added": F.when(kind == "deleted", 0).otherwise(F.col("event_id") % 7), "lines_removed": F.when(kind == "created", 0).otherwise(F.col("event_id") % 3)})


_CH = "(SELECT *, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'updated' END AS change_type, 'u' || CAST(user_id % 5 AS VARCHAR) AS entity_type, CASE event_type WHEN 'error' THEN 0 ELSE event_id % 7 END AS lines_added, CASE event_type WHEN 'signup' THEN 0 ELSE event_id % 3 END AS lines_removed FROM events)"
simple("g3_change_statistics", "events", lambda t: A.change_statistics(_changes(t)), f"SELECT 'change_type' AS dimension, change_type AS name, count(*) AS n, CAST(sum(lines_added) AS BIGINT) AS added, CAST(sum(lines_removed) AS BIGINT) AS removed FROM {_CH} GROUP BY 2 UNION ALL SELECT 'entity_type', entity_type, count(*), CAST(sum(lines_added) AS BIGINT), CAST(sum(lines_removed) AS BIGINT) FROM {_CH} GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*), CAST(sum(lines_added) AS BIGINT), CAST(sum(lines_removed) AS BIGINT) FROM {_CH}")
simple("g4_most_modified", "events", lambda t: A.most_modified(t, "user_id", "ts", "event_type", 20, "event_id"), "SELECT user_id, count(*) AS n, (max(row(ts, event_id, event_type)))[3] AS latest FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
ORACLE_SQL["g4_most_modified"] = "SELECT user_id, n, event_type AS latest FROM (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 ORDER BY n DESC, user_id LIMIT 20"
simple("g5_state_counts", "orders", lambda t: A.state_counts(t, ["O", "F", "P", "X"], "o_orderstatus"), "SELECT s.state, count(o_orderkey) AS n FROM (SELECT unnest(['O', 'F', 'P', 'X']) AS state) s LEFT JOIN orders ON o_orderstatus = s.state GROUP BY 1")
simple("g6_state_statistics", "events", lambda t: A.state_statistics(t, F.col("event_type") == "error", F.col("props"), F.col("event_id") % 4, F.col("event_type") == "view", F.col("ts")).withColumn("avg_retries", r6(F.col("avg_retries"))), "SELECT count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT props) FILTER (event_type = 'error') AS error_types, round(avg(event_id % 4) FILTER (event_id % 4 > 0), 6) AS avg_retries, min(ts) FILTER (event_type = 'view') AS oldest_pending FROM events")
simple("g7_progress", "orders", lambda t: A.progress(t, F.col("o_orderstatus") == "F"), "SELECT count(*) FILTER (o_orderstatus = 'F') AS processed, count(*) AS total, CAST(round(100 * (count(*) FILTER (o_orderstatus = 'F')) / count(*)) AS DOUBLE) AS percent FROM orders")


@query("g8_graph_counts", "SELECT 'nation' AS name, count(*) AS n, 'node' AS kind FROM nation UNION ALL SELECT 'region', count(*), 'node' FROM region UNION ALL SELECT 'IN_REGION', count(*), 'edge' FROM nation")
def g8(spark, d):
    return A.graph_counts(graph.nodes(spark, d, ["region", "nation"]), graph.edges(spark, d, ["IN_REGION"]))


simple("g9_per_project", "documents", lambda t: A.histogram(t, "source"), "SELECT source, count(*) AS n FROM documents GROUP BY 1")
simple("g10_sources", "documents", lambda t: A.histogram(t, "source", "lang", limit=100), "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2 ORDER BY n DESC, source, lang LIMIT 100")


@query("g11_usage", "SELECT source, count(l.doc_id) AS n FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l USING (doc_id) GROUP BY 1")
def g11(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return A.usage(docs, docs.join(table(spark, d, "labels").where("toxic = 1"), "doc_id"), "source")


simple("g12_type_histogram", "events", lambda t: A.histogram(t, "event_type"), "SELECT event_type, count(*) AS n FROM events GROUP BY 1")


@query("g13_coverage", "SELECT count(*) AS total, count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS missing FROM documents LEFT JOIN labels l USING (doc_id)")
def g13(spark, d):
    return A.coverage(table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left"), F.col("quality").isNotNull())


simple("g14_duplicates", "documents", lambda t: A.duplicates(t.withColumn("h", T.content_hash(F.col("text"))), "h", "doc_id"), "SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1 HAVING count(*) > 1")


@query("g15_orphans", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def g15(spark, d):
    return A.orphans(table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem").where("l_quantity > 49").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey")


simple("g16_section_chunks", "documents", lambda t: A.section_chunks(t, t, "source"), "SELECT source, CAST(sum(CASE WHEN length(text) <= 2000 THEN 1 ELSE ceil((length(text) - 200) / 1800) END) AS BIGINT) AS n FROM documents GROUP BY 1")
simple("g17_best_per_parent", "conversations", lambda t: A.best_per_parent(t.withColumn("score", F.length("text")), "conv_id", "score", 25), "SELECT conv_id, max(length(text)) AS score FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
simple("g18_role_chars", "conversations", lambda t: V.chars_by(t, "conv_id", "role"), "SELECT conv_id, role, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1, 2")


def _snapshots(spark, d):
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus")
    new = old.where("id % 10 <> 0").withColumn("o_totalprice", F.when(F.col("id") % 10 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    new = new.unionByName(old.where("id % 10 = 2").withColumn("id", F.col("id") + 1_000_000_000))
    h = lambda t: t.withColumn("hash", T.content_hash(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.col("o_orderstatus")))
    return h(old), h(new)


@query("g19_ingest_counts", "SELECT count(*) FILTER (o_orderkey % 10 = 2) AS created, count(*) FILTER (o_orderkey % 10 = 1) AS modified, count(*) FILTER (o_orderkey % 10 NOT IN (0, 1)) AS unchanged, count(*) FILTER (o_orderkey % 10 = 0) AS deleted FROM orders")
def g19(spark, d):
    return I.diff_counts(I.diff(*_snapshots(spark, d), "id"))


simple("g20_kind_profile", "pages", lambda t: A.kind_profile(t.select(T.url_host(F.col("url")).alias("root"), F.concat(F.lit("p"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".md").otherwise(".ts")).alias("path"))).select("root", "total", "code", "document", "dominant"), r"WITH p AS (SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS root, page_id % 3 = 0 AS doc FROM pages), c AS (SELECT root, count(*) AS total, count(*) FILTER (NOT doc) AS code, count(*) FILTER (doc) AS document FROM p GROUP BY 1) SELECT *, CASE WHEN greatest(code, document) / total < 0.7 AND greatest(code, document) / total < 0.5 THEN 'mixed' WHEN code >= document THEN 'code' ELSE 'document' END AS dominant FROM c")
simple("g21_result_histogram", "documents", lambda t: A.histogram(t, "lang"), "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
simple("g22_backlog", "orders", lambda t: A.progress(t, F.col("o_orderstatus") != "O").withColumn("needed", F.col("processed") < F.col("total")), "SELECT count(*) FILTER (o_orderstatus <> 'O') AS processed, count(*) AS total, CAST(round(100 * (count(*) FILTER (o_orderstatus <> 'O')) / count(*)) AS DOUBLE) AS percent, count(*) FILTER (o_orderstatus <> 'O') < count(*) AS needed FROM orders")


@query("g23_summary_coverage", "SELECT count(*) AS total, count(*) FILTER (quality = 1) AS covered, count(*) - count(*) FILTER (quality = 1) AS missing FROM documents LEFT JOIN labels USING (doc_id)")
def g23(spark, d):
    return A.coverage(table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left"), F.coalesce(F.col("quality") == 1, F.lit(False)))


# --- ranking and budgets --------------------------------------------------------------------------------------------

simple("w1_page", "orders", lambda t: R.page(t.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 20, 10), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
simple("w2_top_k", "customer", lambda t: R.top_k(t.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")), 15, least=100.0), "SELECT c_custkey AS id, c_acctbal AS score FROM customer WHERE c_acctbal >= 100 ORDER BY 2 DESC, 1 LIMIT 15")
simple("w3_ranks", "documents", lambda t: R.ranks(t.select("source", F.col("doc_id").alias("id"), F.col("n_chars").alias("score")), within=["source"]).select("id", "rank"), "SELECT doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
simple("w4_latest", "conversations", lambda t: R.latest(t.select("conv_id", "role", "turn", "text"), ["conv_id", "role"], ["turn"]), "SELECT conv_id, role, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
simple("w5_budget_suffix", "conversations", lambda t: R.budget_suffix(t, ["conv_id"], [F.desc("turn")], F.length("text"), 800).select("conv_id", "turn", "used"), "SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 800")
simple("w6_budget_cut", "documents", lambda t: R.budget_cut(t.select("source", "doc_id", "text"), ["source"], [F.col("doc_id")], "text", 5000), "SELECT source, doc_id, CASE WHEN used <= 5000 THEN text ELSE substr(text, 1, CAST(5000 - used + length(text) AS BIGINT)) || '...' END AS text FROM (SELECT source, doc_id, text, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE 5000 - used + length(text) > 0 AND (used <= 5000 OR 5000 - used + length(text) > 100)")
@query(
    "w7_budget_skip",
    """WITH RECURSIVE d AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations), p AS (SELECT conv_id, turn, r, n <= 700 AS fits, CASE WHEN n <= 700 THEN n ELSE 0 END AS used, n > 700 AS over FROM d WHERE r = 1
UNION ALL SELECT d.conv_id, d.turn, d.r, NOT over AND used + d.n <= 700, CASE WHEN NOT over AND used + d.n <= 700 THEN used + d.n ELSE used END, over OR (used + d.n > 700 AND 700 - used > 100) FROM p JOIN d ON d.conv_id = p.conv_id AND d.r = p.r + 1) SELECT conv_id, turn FROM p WHERE fits""",
)
def w7(spark, d):
    m = table(spark, d, "conversations").withColumns({"newest": -F.col("turn"), "size": F.length("text")})
    return R.budget_skip(m, "conv_id", ["newest"], "turn", "size", 700)


_PACK = """WITH RECURSIVE d AS (SELECT {g}, doc_id, row_number() OVER (PARTITION BY {g} ORDER BY doc_id) AS r, CAST(ceil(length(text) / 4) + {t} AS BIGINT) AS t FROM documents),
p AS (SELECT {g}, doc_id, r, t, 0 AS pack, 500 + t AS used, 1 AS n FROM d WHERE r = 1 UNION ALL SELECT d.{g}, d.doc_id, d.r, d.t, pack + CASE WHEN {full} THEN 1 ELSE 0 END, CASE WHEN {full} THEN 500 ELSE used END + d.t, CASE WHEN {full} THEN 1 ELSE n + 1 END FROM p JOIN d ON d.{g} = p.{g} AND d.r = p.r + 1)
SELECT {g}, doc_id, t AS tokens, pack FROM p"""


@query("w8_pack_tokens", _PACK.format(g="lang", t=1400, full="used + d.t > 20000"))
def w8(spark, d):
    return R.pack(table(spark, d, "documents"), ["lang"], ["doc_id"], F.ceil(F.length("text") / 4) + 1400, 20_000)


@query("w9_pack_batches", _PACK.format(g="source", t=200, full="used + d.t > 20000 OR n >= 10"))
def w9(spark, d):
    return R.pack(table(spark, d, "documents"), ["source"], ["doc_id"], F.ceil(F.length("text") / 4) + 200, 20_000, most=10)


simple("w10_batches", "documents", lambda t: R.batches(t.select("source", "doc_id"), ["source"], ["doc_id"], 10).select("doc_id", "batch"), "SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS batch FROM documents")


@query("w11_context", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT doc_id, line, context FROM (SELECT doc_id, line, text, concat_ws(chr(10), lag(text) OVER w, text, lead(text) OVER w) AS context FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line)) WHERE contains(text, 'tion')")
def w11(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("line"), "text")
    return R.lines_around(lines, F.col("text").contains("tion"), 1, 1).select("doc_id", F.col("line").cast("long").alias("line"), "context")


# --- sets -----------------------------------------------------------------------------------------------------------


@query("u1_union_all", "SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def u1(spark, d):
    return table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))


@query("u2_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def u2(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("u3_merge_max", "SELECT id, max(score) AS score FROM (SELECT vec_id AS id, CAST(label AS DOUBLE) AS score FROM embeddings UNION ALL SELECT vec_id, CAST(vec_id % 7 AS DOUBLE) FROM embeddings) GROUP BY 1")
def u3(spark, d):
    v = vectors(spark, d)
    return S.merge_max([v.select("id", F.col("label").cast("double").alias("score")), v.select("id", (F.col("id") % 7).cast("double").alias("score"))])


simple("u4_list_union", "documents", lambda t: t.select("doc_id", F.array_join(F.array_union(F.array("lang", "source"), F.array(F.lit("en"), F.col("lang"))), ",").alias("items")), "SELECT doc_id, CASE WHEN lang = 'en' THEN concat_ws(',', lang, source) ELSE concat_ws(',', lang, source, 'en') END AS items FROM documents")


@query("u5_difference", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 = 0")
def u5(spark, d):
    old, new = _snapshots(spark, d)
    return old.select("id").join(new.select("id"), "id", "left_anti")


simple("u6_first", "documents", lambda t: t.groupBy(T.content_hash(F.col("text"))).agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")

# --- functions ------------------------------------------------------------------------------------------------------

simple("f1_hash", "documents", lambda t: t.select("doc_id", T.content_hash(F.col("text")).alias("h"), T.content_hash(F.col("lang"), F.col("source")).alias("m"), T.short_hash(F.col("text")).alias("s")), "SELECT doc_id, sha256(text) AS h, sha256(lang || chr(0) || source) AS m, substr(sha256(text), 1, 16) AS s FROM documents")
_UUID = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"
simple("f2_uuid", "documents", lambda t: t.select("doc_id", T.text_uuid(F.col("text")).alias("u")), f"SELECT doc_id, {_UUID.format('sha256(text)')} AS u FROM documents")
simple("f3_derived_key", "conversations", lambda t: t.select("conv_id", "turn", T.derived_key("message", F.col("conv_id"), F.col("turn")).alias("u")), f"SELECT conv_id, turn, {_UUID.format(chr(104))} AS u FROM (SELECT conv_id, turn, sha256('message:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)) AS h FROM conversations)")
simple("f4_edit_similarity", "customer", lambda t: t.select("c_custkey", r6(T.edit_similarity(F.col("c_name"), F.col("c_mktsegment"))).alias("s")), "SELECT c_custkey, round(1 - levenshtein(lower(c_name), lower(c_mktsegment)) / greatest(length(c_name), length(c_mktsegment)), 6) AS s FROM customer")


@query("f5_cosine", f"SELECT e.vec_id AS id, round({_SIM}, 6) AS s FROM {_VQ}")
def f5(spark, d):
    q = vec_of(spark, d)
    return vectors(spark, d).select("id", r6(cosine(F.col("embedding"), S.vector(q))).alias("s"))


simple("f6_normalise_url", "pages", lambda t: t.select("page_id", T.normalise_url(F.col("url")).alias("u")), "SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') AS u FROM pages")
simple("f7_host", "pages", lambda t: t.groupBy(T.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n")), "SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
_CUT = r"list_filter(list_transform(regexp_split_to_array(regexp_replace({t}, '([.!?])\s+(\p{Lu})', '\1' || chr(1) || '\2', 'g'), '\x01|\n+'), lambda p: trim(p)), lambda p: p <> '')"
# pieces of one text are folded into one string, parted by chr(2)
_SENTENCES = "string_split(list_reduce(" + _CUT + ", lambda a, x: CASE WHEN length(string_split(a, chr(2))[-1]) + length(x) < 100 THEN a || ' ' || x ELSE a || chr(2) || x END), chr(2))"
_PACKED = "string_split(list_reduce({u}, lambda a, x: CASE WHEN length(string_split(a, chr(2))[-1]) + length(x) + {j} <= 2000 THEN a || {s} || x ELSE a || chr(2) || right(string_split(a, chr(2))[-1], 200) || {s} || x END), chr(2))"
_MERGED = "SELECT doc_id, unnest(range(len(c))) AS index, unnest(c) AS text FROM (SELECT doc_id, CASE WHEN len(c) > 1 AND length(c[-1]) < 100 THEN list_concat(c[:-3], [c[-2] || {s} || c[-1]]) ELSE c END AS c FROM (SELECT doc_id, {p} AS c FROM {t}))"


@query("f8_sentences", f"SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS sentence FROM (SELECT doc_id, {_SENTENCES.replace('{t}', 'text')} AS x FROM documents WHERE len({_CUT.replace('{t}', 'text')}) > 0)")
def f8(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))


simple("f9_chunks_fixed", "documents", lambda t: t.select("doc_id", F.explode(T.fixed_chunks(F.col("text"))).alias("c")).select("doc_id", "c.index", "c.start_char", "c.end_char", "c.start_line", F.length("c.text").alias("n")), "SELECT doc_id, CAST(i AS INTEGER) AS index, CAST(1800 * i AS INTEGER) AS start_char, CAST(least(1800 * i + 2000, length(text)) AS INTEGER) AS end_char, CAST(1800 * 0 + 1 + length(substr(text, 1, 1800 * i)) - length(replace(substr(text, 1, 1800 * i), chr(10), '')) AS INTEGER) AS start_line, CAST(least(2000, length(text) - 1800 * i) AS INTEGER) AS n FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 2000 THEN 1 ELSE CAST(ceil((length(text) - 200) / 1800) AS BIGINT) END)) AS i FROM documents)")
_WITH_TEXT = f"(SELECT doc_id, text FROM documents WHERE len({_CUT.replace('{t}', 'text')}) > 0)"


@query("f9_chunks_sentence", _MERGED.format(s="' '", p=_PACKED.format(u="u", j=1, s="' '"), t=f"(SELECT doc_id, {_SENTENCES.replace('{t}', 'text')} AS u FROM {_WITH_TEXT})"))
def f9_sentence(spark, d):
    return table(spark, d, "documents").select("doc_id", F.inline(T.chunks(F.col("text"), strategy="sentence")))


_UNITS = f"(SELECT doc_id, flatten(list_transform(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda q: trim(q) <> ''), lambda v: CASE WHEN length(v) > 3000 THEN {_SENTENCES.replace('{t}', 'v')} ELSE [v] END)) AS u FROM {_WITH_TEXT})"


@query("f9_chunks_paragraph", _MERGED.format(s="(chr(10) || chr(10))", p=_PACKED.format(u="u", j=2, s="(chr(10) || chr(10))"), t=_UNITS))
def f9_paragraph(spark, d):
    return table(spark, d, "documents").select("doc_id", F.inline(T.chunks(F.col("text"), strategy="paragraph")))


simple("f10_chunk_estimate", "documents", lambda t: t.select("doc_id", T.needs_chunking(F.col("text")).alias("needed"), T.chunk_count(F.col("text")).alias("n")), "SELECT doc_id, length(text) > 2000 AS needed, CAST(CASE WHEN length(text) <= 2000 THEN 1 ELSE ceil((length(text) - 200) / 1800) END AS INTEGER) AS n FROM documents")
simple("f14_hrefs", "pages", lambda t: t.select("page_id", F.explode(F.array_distinct(T.hrefs(F.col("html")))).alias("href")), "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
simple("f16_web_urls", "pages", lambda t: t.select("page_id", F.explode(T.web_urls(F.concat(F.lit("see "), "url", F.lit("). and more"), ))).alias("u")), r"SELECT page_id, regexp_replace(url || ').', '[.,;:!?)\]}''\x22]+$', '') AS u FROM pages")
simple("f18_file_kind", "pages", lambda t: t.select("page_id", T.file_kind(F.concat(F.lit("a/b."), F.when(F.col("page_id") % 4 == 0, "py").when(F.col("page_id") % 4 == 1, "css").when(F.col("page_id") % 4 == 2, "md").otherwise("zzz"))).alias("kind")), "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'style' WHEN 2 THEN 'document' ELSE 'other' END AS kind FROM pages")


@query("f19_embedding_text", "SELECT o_orderkey, '[ORDER] ' || any_value(o_orderstatus) || chr(10) || '[ITEM] ' || string_agg(p, ' ' ORDER BY r) AS t FROM orders JOIN (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS r FROM lineitem WHERE l_linenumber <= 2) ON l_orderkey = o_orderkey WHERE r <= 2 GROUP BY 1")
def f19(spark, d):
    near = table(spark, d, "lineitem").where("l_linenumber <= 2").groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("p")))), 1, 2).alias("x"))
    return table(spark, d, "orders").join(near, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", T.labelled_lines({"ORDER": F.col("o_orderstatus"), "ITEM": F.array_join(F.transform("x", lambda r: r["p"]), " ")}).alias("t"))


simple("f20_entity_text", "nation", lambda t: t.select("n_nationkey", F.concat_ws("\n", F.concat(F.lit("Name: "), "n_name"), F.when(F.col("n_regionkey") > 1, F.concat(F.lit("Region: "), F.col("n_regionkey").cast("string"))), F.lit("Type: nation")).alias("t")), "SELECT n_nationkey, concat_ws(chr(10), 'Name: ' || n_name, CASE WHEN n_regionkey > 1 THEN 'Region: ' || CAST(n_regionkey AS VARCHAR) END, 'Type: nation') AS t FROM nation")
simple("f21_turn_text", "conversations", V.turn_texts, "SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || substr(text, 1, 200), chr(10) ORDER BY turn) AS t FROM conversations WHERE role <> 'system' GROUP BY 1")
simple("f22_field_format", "documents", lambda t: t.select("doc_id", T.truncate(F.col("text"), 300).alias("t")), "SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS t FROM documents")
simple("f24_tags", "part", lambda t: t.select("p_partkey", T.normalise_tag(F.col("p_type")).alias("tag")), "SELECT p_partkey, regexp_replace(lower(p_type), ' +', '-', 'g') AS tag FROM part")


@query("f25_cost", "SELECT role, CAST(round(sum(ceil(length(text) / 4) * CASE role WHEN 'assistant' THEN 15.0 ELSE 3.0 END / 1000000), 6) AS DOUBLE) AS cost FROM conversations GROUP BY 1")
def f25(spark, d):
    prices = spark.createDataFrame([("assistant", 15.0), ("user", 3.0), ("system", 3.0)], "role string, price double")
    return table(spark, d, "conversations").join(F.broadcast(prices), "role").groupBy("role").agg(r6(F.sum(T.cost(T.token_estimate(F.col("text")), F.col("price")))).alias("cost"))


simple("f26_headings", "pages", lambda t: t.select("page_id", F.array_join(T.headings(F.col("html")), "|").alias("h")), "SELECT page_id, array_to_string(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1), '|') AS h FROM pages")
simple("f27_preprocess", "documents", lambda t: t.select("doc_id", T.preprocess(F.col("text"), ["whitespace", "unknown", "camel_case"]).alias("t")), r"SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([a-z])([A-Z])', '\1 \2', 'g') AS t FROM documents")

# --- search ---------------------------------------------------------------------------------------------------------


@query("s1_vector_search", f"SELECT e.vec_id AS id, round({_SIM}, 6) AS score FROM {_VQ} WHERE e.label <> 3 ORDER BY {_SIM} DESC, e.vec_id LIMIT 10")
def s1(spark, d):
    return S.vector_search(vectors(spark, d), vec_of(spark, d), 10, where=F.col("label") != 3).withColumn("score", r6(F.col("score")))


@query("s2_multi_field", f"SELECT e.vec_id // 2 AS id, round(max({_SIM}), 6) AS score FROM {_VQ} GROUP BY 1 ORDER BY max({_SIM}) DESC, 1 LIMIT 20")
def s2(spark, d):
    v = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("id"), F.when(F.col("vec_id") % 2 == 0, "name").otherwise("content").alias("field"), "embedding")
    return S.multi_search(v, vec_of(spark, d), ["name", "content"], 20).withColumn("score", r6(F.col("score")))


@query("s3_brute_force", f"SELECT e.vec_id AS id, round({_SIM}, 6) AS score FROM {_VQ} WHERE {_SIM} >= 0.1 ORDER BY {_SIM} DESC, e.vec_id LIMIT 50")
def s3(spark, d):
    return S.vector_search(vectors(spark, d), vec_of(spark, d), 50, least=0.1).withColumn("score", r6(F.col("score")))


_TWO = "embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q, (SELECT embedding FROM embeddings WHERE vec_id = 1) p"
_SIM2 = _SIM.replace("q.", "p.")


@query("s4_refine", f"SELECT id, round(0.3 * a + 0.7 * b, 6) AS score FROM (SELECT e.vec_id AS id, {_SIM} AS a, {_SIM2} AS b FROM {_TWO} ORDER BY a DESC, id LIMIT 30) ORDER BY 0.3 * a + 0.7 * b DESC, id LIMIT 10")
def s4(spark, d):
    v = vectors(spark, d)
    return frame.Hits(v).semantic(v, vec_of(spark, d), 30).refine(v, vec_of(spark, d, 1), 10).df.withColumn("score", r6(F.col("score")))


@query("s5_merge_filtered", f"SELECT v.vec_id AS id, round(coalesce(h.s, 0.3), 6) AS score FROM embeddings v LEFT JOIN (SELECT e.vec_id, {_SIM} AS s FROM {_VQ} ORDER BY s DESC, e.vec_id LIMIT 10) h ON h.vec_id = v.vec_id")
def s5(spark, d):
    v = vectors(spark, d)
    return S.merge_filtered(v.select("id", F.lit(1.0).alias("score")), S.vector_search(v, vec_of(spark, d), 10)).withColumn("score", r6(F.col("score")))


def _bm25(words: list[str], limit: int) -> str:
    inside = ", ".join(f"'{w}'" for w in words)
    return f"""SELECT id, score FROM (WITH w AS (SELECT doc_id AS id, {_WORDS} AS ws FROM documents), t AS (SELECT id, len(ws) AS l, unnest(ws) AS term FROM w),
p AS (SELECT term, id, count(*) AS tf, any_value(l) AS l FROM t WHERE term IN ({inside}) GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), s AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w)
SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS score FROM p JOIN f USING (term), s GROUP BY 1) ORDER BY score DESC, id LIMIT {limit}"""


def _text_hits(spark, d, words: str, k: int, edits: int = 0) -> DataFrame:
    docs = table(spark, d, "documents")
    if not edits:
        return S.text_search(docs, words, k, key="doc_id")
    return S.fulltext_search(S.postings(docs, "doc_id"), S.lengths(docs, "doc_id"), words, k, edits)


@query("s6_fulltext", f"SELECT id, round(score, 6) AS score FROM ({_bm25(['thing', 'with'], 20)})")
def s6(spark, d):
    return _text_hits(spark, d, "Thing, with", 20).withColumn("score", r6(F.col("score")))


@query("s6_fulltext_fuzzy", f"SELECT id, round(score, 6) AS score FROM ({_bm25(['thing'], 20).replace("term IN ('thing')", "levenshtein(term, 'thing') <= 1")})")
def s6b(spark, d):
    return _text_hits(spark, d, "thing", 20, edits=1).withColumn("score", r6(F.col("score")))


simple("s7_search_docs", "part", lambda t: t.select(graph.node_id("part", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("content"), F.lit(None).cast("string").alias("description")), "SELECT 'part:' || CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type || ' ' || p_brand AS content, CAST(NULL AS VARCHAR) AS description FROM part")

_HYBRID = f"""WITH v AS (SELECT e.vec_id AS id, {_SIM} AS s FROM {_VQ} WHERE {_SIM} >= 0.1 ORDER BY s DESC, e.vec_id LIMIT 60), t AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({_bm25(["thing", "with"], 60)})),
b AS (SELECT v.id, s * CASE WHEN rank IS NULL THEN 1 ELSE 1 + 0.3 / sqrt(rank) END AS score FROM v LEFT JOIN t USING (id)), o AS (SELECT id, row_number() OVER (ORDER BY rank) AS i FROM t WHERE id NOT IN (SELECT id FROM v)),
x AS (SELECT * FROM b UNION ALL SELECT id, 0.4 - 0.05 * (i - 1) FROM o WHERE i <= 5)"""


def _hybrid(spark, d, least=None) -> DataFrame:
    return S.hybrid(S.vector_search(vectors(spark, d), vec_of(spark, d), 60, least=0.1), _text_hits(spark, d, "thing with", 60), 20, least=least)


@query("s8_hybrid", _HYBRID + " SELECT id, round(score, 6) AS score FROM x ORDER BY x.score DESC, id LIMIT 20")
def s8(spark, d):
    return _hybrid(spark, d).withColumn("score", r6(F.col("score")))


@query("s9_search", _HYBRID + " SELECT id, round(score, 6) AS score, lang, source FROM (SELECT * FROM x WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 20) JOIN documents ON doc_id = id WHERE lang IN ('en', 'fr', 'de', 'es')")
def s9(spark, d):
    """The search front door: hybrid ranking, score cut, filters and the hits' own fields."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return _hybrid(spark, d, least=0.3).join(docs.where(P.compare("lang", "in", ["en", "fr", "de", "es"])), "id").withColumn("score", r6(F.col("score")))


simple("s10_keyword_boost", "part", lambda t: S.keyword_boost(t.select(F.col("p_partkey").alias("id"), F.lit(0.5).alias("score"), "p_brand"), ["p_brand"], ["brand"]).select("id", r6(F.col("score")).alias("score")), "SELECT p_partkey AS id, CAST(round(0.5 + CASE WHEN contains(lower(p_brand), 'brand') THEN 0.15 ELSE 0 END, 6) AS DOUBLE) AS score FROM part")


@query("s11_entity_boost", "SELECT doc_id AS id, CAST(round(0.5 + CASE WHEN quality = 1 THEN 0.9 * 0.05 ELSE 0 END, 6) AS DOUBLE) AS score FROM documents LEFT JOIN labels USING (doc_id)")
def s11(spark, d):
    hits = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(0.5).alias("score"))
    links = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("entity"))
    return S.entity_boost(hits, links, spark.createDataFrame([(1, 0.9), (0, 0.5)], "entity int, match double")).withColumn("score", r6(F.col("score")))


simple("s12_type_boost", "documents", lambda t: S.type_boost(t.select(F.col("doc_id").alias("id"), F.lit(0.8).alias("score"), F.col("lang").alias("type")), {"en": 1.5, "fr": 0.9, "de": 0.5}, 0.6).select("id", r6(F.col("score")).alias("score")), "SELECT doc_id AS id, CAST(CASE lang WHEN 'en' THEN 1.0 WHEN 'fr' THEN 0.72 ELSE 0.8 END AS DOUBLE) AS score FROM documents WHERE lang <> 'de'")
simple("s13_snippet", "documents", lambda t: t.select("doc_id", T_snip(t).alias("s")), "SELECT doc_id, CASE WHEN lang = 'en' THEN substr(text, 1, 800) ELSE substr(text, 1, 500) END AS s FROM documents")


def T_snip(t: DataFrame) -> F.Column:
    return S.snippet(F.when(F.col("lang") == "en", F.col("text")), F.col("text"))


@query("s14_merge_scores", "SELECT doc_id AS id, CAST(0.3 * 0.5 + 0.7 * quality AS DOUBLE) AS weighted, CAST(0.5 * quality AS DOUBLE) AS product, CAST(CASE WHEN quality > 0.9 THEN 1.0 ELSE (0.5 + quality) / 2 END AS DOUBLE) AS override FROM documents JOIN labels USING (doc_id)")
def s14(spark, d):
    hits = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(0.5).alias("score"))
    ev = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("evaluation"))
    w, p, o = (S.merge_scores(hits, ev, s) for s in ("weighted", "multiplicative", "override"))
    return w.withColumnRenamed("score", "weighted").join(p.withColumnRenamed("score", "product"), "id").join(o.withColumnRenamed("score", "override"), "id")


@query("s15_entity_search", _HYBRID.replace("i <= 5", "i <= 3") + " SELECT id, round(score, 6) AS score FROM (SELECT * FROM x WHERE score >= 0.2 ORDER BY score DESC, id LIMIT 20)")
def s15(spark, d):
    return S.hybrid(S.vector_search(vectors(spark, d), vec_of(spark, d), 60, least=0.1), _text_hits(spark, d, "thing with", 60), 20, extra=3, least=0.2).withColumn("score", r6(F.col("score")))


@query("s16_filtered_vectors", f"SELECT e.vec_id AS id, round({_SIM}, 6) AS score FROM {_VQ} WHERE e.label IN (1, 2) ORDER BY {_SIM} DESC, e.vec_id LIMIT 10")
def s16(spark, d):
    return S.vector_search(vectors(spark, d), vec_of(spark, d), 10, where=P.all_of([("label", "in", [1, 2])])).withColumn("score", r6(F.col("score")))


simple("s17_grep", "documents", lambda t: S.grep(t, "th[aeiou]re").select("doc_id", F.col("line").cast("long").alias("line"), "match", F.col("n_lines").cast("long").alias("n_lines")), "SELECT doc_id, line, regexp_extract(l, 'th[aeiou]re') AS match, n_lines FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) WHERE regexp_matches(l, 'th[aeiou]re')")
simple("s18_fuzzy_grep", "documents", lambda t: S.fuzzy_grep(t, ["thing", "pour"], 0.8).groupBy("doc_id", "keyword").agg(F.count("*").alias("n")), r"WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(l), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 3))) AS word FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)), m AS (SELECT doc_id, CASE WHEN 1 - levenshtein(word, 'thing') / greatest(length(word), 5) >= 0.8 THEN 'thing' WHEN 1 - levenshtein(word, 'pour') / greatest(length(word), 4) >= 0.8 THEN 'pour' END AS keyword FROM w) SELECT doc_id, keyword, count(*) AS n FROM m WHERE keyword IS NOT NULL GROUP BY 1, 2")


# --- sources --------------------------------------------------------------------------------------------------------

simple("a1_discover", "pages", lambda t: files.discover(t.select("page_id", F.concat(F.lit("src"), T.url_path(F.col("url"))).alias("path")), ["src/**"], ["**/*9*"]).select("page_id"), r"SELECT page_id FROM (SELECT page_id, 'src' || regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS p FROM pages) WHERE regexp_matches(p, '^src/') AND NOT regexp_matches(p, '^(?:[^/]+/)*[^/]*9[^/]*$')")
simple("a3_sections", "events", lambda t: files.json_sections(t.select("event_id", "props"), "props", ["event_id"], 1).select("event_id", "path", "value"), "SELECT event_id, k AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
simple("a4_reference_kind", "pages", lambda t: t.select("page_id", T.reference_kind(F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, "./lib/").otherwise("./a.json")).alias("kind")), "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'directory' ELSE 'config' END AS kind FROM pages")
simple("a5_pages", "pages", lambda t: files.pages(t).select("page_id", "url", "host", "n_headings", "n_links"), "SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') AS url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host, CAST(len(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1)) AS INTEGER) AS n_headings, CAST(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS INTEGER) AS n_links FROM pages")
_NORM = "regexp_replace(regexp_replace({u}, '#.*$', ''), '/$', '')"
_LINKS = f"(SELECT DISTINCT src, {_NORM.format(u="CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN starts_with(h, '/') THEN site || h ELSE base || h END")} AS dst FROM (SELECT {_NORM.format(u='url')} AS src, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+') AS site, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') AS base, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h FROM pages))"


@query("a5_page_links", f"SELECT src, dst FROM {_LINKS}")
def a5_links(spark, d):
    return files.page_links(table(spark, d, "pages"), inside=False)


@query(
    "a6_crawl",
    f"""WITH l AS {_LINKS}, s AS (SELECT min({_NORM.format(u="url")}) AS url FROM pages), one AS (SELECT DISTINCT dst AS url FROM l JOIN s ON src = url WHERE dst <> s.url), two AS (SELECT DISTINCT dst AS url FROM l JOIN one ON src = url WHERE dst NOT IN (SELECT url FROM one) AND dst NOT IN (SELECT url FROM s))
SELECT * FROM (SELECT url, 0 AS depth FROM s UNION ALL SELECT url, 1 FROM one UNION ALL SELECT url, 2 FROM two) ORDER BY depth, url LIMIT 100""",
)
def a6(spark, d):
    pages = table(spark, d, "pages")
    return files.crawl(files.page_links(pages, inside=False), pages.agg(F.min(T.normalise_url(F.col("url")))).first()[0], 2, 100)


@query(
    "a7_directories",
    """SELECT DISTINCT array_to_string(p[1:i + 1], '/') AS child, array_to_string(p[1:i], '/') AS parent, CASE WHEN i = len(p) - 1 THEN 'IN_DIRECTORY' ELSE 'PARENT_OF' END AS type
FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT list_filter(string_split(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/'), lambda x: x <> '') AS p FROM pages))""",
)
def a7(spark, d):
    return files.directory_edges(table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://|[?#].*$", "").alias("path")))


@query("a8_upsert", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders UNION ALL SELECT o_orderkey + 1000000000, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 10 = 2")
def a8(spark, d):
    old, new = _snapshots(spark, d)
    return I.upsert(old.drop("hash"), new.drop("hash", "o_orderstatus").where("id < 1000000000").unionByName(new.drop("hash").where("id >= 1000000000"), allowMissingColumns=True), ["id"])


@query("a9_upsert_edges", "SELECT count(*) AS n, count(*) FILTER (o_custkey % 3 = 0) AS old FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 4 = 0 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0))")
def a9(spark, d):
    e = graph.edges(spark, d, ["PLACED_BY"])
    some = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(graph.node_id("customer", "c_custkey").alias("id")).unionByName(graph.nodes(spark, d, ["orders"]).select("id"))
    old = e.where(F.regexp_extract("src", r"(\d+)$", 1).cast("long") % 4 == 0)
    merged = I.upsert_edges(old, e.unionByName(e), some)
    return merged.agg(F.count("*").alias("n"), F.count_if(F.regexp_extract("dst", r"(\d+)$", 1).cast("long") % 3 == 0).alias("old"))


@query("a10_delete", "SELECT count(*) AS n FROM orders WHERE o_custkey % 5 <> 0")
def a10(spark, d):
    _, e = I.delete_nodes(graph.nodes(spark, d, ["customer"]), graph.edges(spark, d, ["PLACED_BY"]), table(spark, d, "customer").where("c_custkey % 5 = 0").select(graph.node_id("customer", "c_custkey").alias("id")))
    return e.agg(F.count("*").alias("n"))


@query("a11_delete_source", "SELECT doc_id FROM documents WHERE source NOT IN ('src0', 'src1')")
def a11(spark, d):
    gone = table(spark, d, "documents").select("source").distinct().where("source in ('src0', 'src1')")
    return table(spark, d, "documents").join(gone, "source", "left_anti").select("doc_id")


simple("a12_garbage", "orders", lambda t: t.where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
simple("a13_transcript", "conversations", V.transcript, "SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
simple("a14_compact", "embeddings", lambda t: t.select(*(c for c in t.columns if c != "embedding")), "SELECT vec_id, label FROM embeddings")


@query("a15_reassign", "SELECT page_id, CASE WHEN url LIKE 'https://%' THEN 's' ELSE 'held' END AS project_id FROM pages")
def a15(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.lit("held").alias("project_id"))
    return files.reassign(rows, spark.createDataFrame([("https:", "s")], "path string, project_id string")).select("page_id", "project_id")


simple("a16_patch", "documents", lambda t: I.patch(t, F.col("source") == "src2", {"lang": F.lit("archived")}).select("doc_id", "lang"), "SELECT doc_id, CASE WHEN source = 'src2' THEN 'archived' ELSE lang END AS lang FROM documents")
simple("a17_dirty", "documents", lambda t: I.mark_dirty(t, F.col("source") == "src4").select("doc_id", "dirty"), "SELECT doc_id, source = 'src4' AS dirty FROM documents")

# --- incremental maintenance, state, history ------------------------------------------------------------------------

_STATUS = "SELECT o_orderkey AS id, CASE o_orderkey % 10 WHEN 0 THEN 'deleted' WHEN 1 THEN 'modified' ELSE 'unchanged' END AS status FROM orders UNION ALL SELECT o_orderkey + 1000000000, 'created' FROM orders WHERE o_orderkey % 10 = 2"


@query("i1_change_detection", _STATUS)
def i1(spark, d):
    return I.diff(*_snapshots(spark, d), "id")


@query("i2_changed_or_forced", f"SELECT id FROM ({_STATUS}) WHERE status IN ('created', 'modified') OR (id % 10 = 3 AND status <> 'deleted')")
def i2(spark, d):
    return I.diff(*_snapshots(spark, d), "id", dirty=F.col("id") % 10 == 3).where("status in ('created', 'modified')").select("id")


@query("i3_node_diff", f"SELECT status, count(*) AS n FROM ({_STATUS}) GROUP BY 1")
def i3(spark, d):
    return I.diff(*_snapshots(spark, d), "id").groupBy("status").agg(F.count("*").alias("n"))


@query("i4_apply_diff", "SELECT id, o_totalprice FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey + 1000000000, o_totalprice FROM orders WHERE o_orderkey % 10 = 2)")
def i4(spark, d):
    old, new = _snapshots(spark, d)
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_orderkey").alias("dst"), F.lit("SELF").alias("type"))
    return I.apply_diff(old, e, new, e, I.diff(old, new, "id"))[0].select("id", "o_totalprice")


@query("i5_carry_vectors", "SELECT vec_id AS id, vec_id % 2 = 0 AS kept FROM embeddings")
def i5(spark, d):
    v = vectors(spark, d)
    new = v.select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("provider"), F.lit(None).cast("array<float>").alias("embedding"))
    return I.carry_vectors(new, v.select("id", F.lit("a").alias("provider"), "embedding")).select("id", F.col("embedding").isNotNull().alias("kept"))


@query("i6_reuse_ids", f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'old' || CAST(p_partkey AS VARCHAR) ELSE {_UUID.format('h')} END AS id FROM (SELECT p_partkey, sha256(CAST(p_partkey AS VARCHAR) || ':' || p_name) AS h FROM part)")
def i6(spark, d):
    new = table(spark, d, "part").select("p_partkey", "p_name")
    old = new.where("p_partkey % 2 = 0").withColumn("id", F.concat(F.lit("old"), F.col("p_partkey").cast("string")))
    return I.reuse_ids(new, old, ["p_partkey", "p_name"]).select("p_partkey", "id")


@query("i7_needs_embedding", "SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' ELSE 'model' END AS reason FROM documents WHERE length(text) >= 5 AND doc_id % 4 <> 3")
def i7(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    stored = docs.where("id % 4 <> 0").select("id", F.when(F.col("id") % 4 == 1, "x").otherwise(T.content_hash(F.col("text"))).alias("hash"), F.lit("p").alias("provider"), F.when(F.col("id") % 4 == 2, "old").otherwise("m").alias("model"))
    return I.needs_embedding(docs, stored, F.col("text"), "p", "m").select("id", "reason")


@query("i8_stale_chunks", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 10 <> 1")
def i8(spark, d):
    changed = table(spark, d, "orders").where("o_orderkey % 10 = 1").select(F.col("o_orderkey").alias("l_orderkey"))
    return I.stale_chunks(table(spark, d, "lineitem"), changed, "l_orderkey").select("l_orderkey", "l_linenumber")


simple("i9_dirty_count", "embeddings", lambda t: A.coverage(t, F.col("label") == 0), "SELECT count(*) AS total, count(*) FILTER (label = 0) AS covered, count(*) FILTER (label <> 0) AS missing FROM embeddings")
simple("i10_schema_dirty", "customer", lambda t: t.select("c_custkey", (F.when(F.col("c_custkey") % 2 == 0, I.schema_fingerprint("customer", ["c_name", "c_custkey"])).otherwise("old") != I.schema_fingerprint("customer", ["c_custkey", "c_name"])).alias("dirty")), "SELECT c_custkey, c_custkey % 2 <> 0 AS dirty FROM customer")


def _states(t: DataFrame) -> DataFrame:
    return t.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "ready").otherwise("error").alias("state"), (F.col("o_orderkey") % 5).cast("int").alias("retries"), F.col("o_orderdate").alias("changed_at"), F.lit(None).cast("string").alias("error"))


_ST = "(SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'ready' ELSE 'error' END AS state, CAST(o_orderkey % 5 AS INTEGER) AS retries FROM orders)"


@query("i11_transition", f"SELECT id, CASE WHEN id % 2 = 0 AND state = 'pending' THEN 'error' ELSE state END AS state, CASE WHEN id % 2 = 0 AND state = 'pending' THEN retries + 1 ELSE retries END AS retries FROM {_ST}")
def i11(spark, d):
    s = _states(table(spark, d, "orders"))
    updates = s.where("id % 2 = 0").select("id", F.lit("error").alias("to"), F.lit("2024-01-01").cast("timestamp").alias("at"), F.lit("boom").alias("message"))
    return I.transition(s, updates, spark.createDataFrame([("pending", "error"), ("error", "pending")], "from string, to string"))[0].select("id", "state", "retries")


@query("i12_reset_changed", f"SELECT id, CASE WHEN id % 10 = 1 THEN 'pending' ELSE state END AS state FROM {_ST} WHERE id % 10 <> 0")
def i12(spark, d):
    old, new = _snapshots(spark, d)
    changed = I.diff(old, new, "id").where("status in ('modified', 'unchanged')")
    return _states(table(spark, d, "orders")).join(changed, "id").select("id", F.when(F.col("status") == "modified", "pending").otherwise(F.col("state")).alias("state"))


simple("i13_retry", "orders", lambda t: I.retry_errors(_states(t)).select("id", "state"), f"SELECT id, CASE WHEN state = 'error' AND retries < 3 THEN 'pending' ELSE state END AS state FROM {_ST}")
simple("i14_stuck", "events", lambda t: I.reset_stuck(t.select("event_id", F.when(F.col("event_type") == "view", "in_progress").otherwise("ready").alias("state"), F.col("ts").alias("changed_at")), F.lit("2024-01-15").cast("timestamp")).select("event_id", "state"), "SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-14 23:55:00' THEN 'pending' WHEN event_type = 'view' THEN 'in_progress' ELSE 'ready' END AS state FROM events")
simple("i15_list_states", "orders", lambda t: R.page(_states(t).where("state = 'error'").select("id", "changed_at"), [F.col("changed_at"), F.col("id")], 20, 5), "SELECT o_orderkey AS id, o_orderdate AS changed_at FROM orders WHERE o_orderstatus NOT IN ('O', 'F') ORDER BY 2, 1 LIMIT 20 OFFSET 5")
simple("i16_initialise", "orders", lambda t: I.initialise_states(t, "o_orderpriority", "^[12]").select("o_orderkey", "state"), "SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, '^[12]') THEN 'skip' ELSE 'discovered' END AS state FROM orders")
simple("i18_drop_vectors", "embeddings", lambda t: I.drop_vectors(t, F.col("label") == 1).groupBy("label").agg(F.count("embedding").alias("left")), "SELECT label, count(*) FILTER (label <> 1) AS left FROM embeddings GROUP BY 1")


@query("i19_needs_summary", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE length(text) > 1000 AND (quality IS NULL OR quality = 0)")
def i19(spark, d):
    h = T.content_hash(F.col("text"))
    docs = table(spark, d, "documents")
    stored = docs.join(table(spark, d, "labels"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, h).when(F.col("quality") == 0, "stale").alias("hash"))
    return I.needs_summary(docs, stored, "text", 1000, "doc_id").select("doc_id")


@query(
    "c1_change_records",
    """SELECT substr(sha256(concat_ws(':', CAST(doc_id AS VARCHAR), '2024-01-01 00:00:00', nh)), 1, 16) AS id, doc_id, CASE WHEN nh IS NULL THEN 'deleted' ELSE 'updated' END AS change_type, sha256(text) AS old_hash, nh AS new_hash,
CASE WHEN nh IS NULL THEN 0 ELSE 1 END AS lines_added, CASE WHEN nh IS NULL THEN len(string_split(text, chr(10))) ELSE 0 END AS lines_removed
FROM (SELECT doc_id, text, CASE WHEN doc_id % 10 = 1 THEN sha256(text || chr(10) || 'added') END AS nh FROM documents WHERE doc_id % 10 < 2)""",
)
def c1(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    new = docs.where("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("\nadded"))).otherwise(F.col("text")))
    return I.change_records(docs, new, "doc_id", "text", F.lit("2024-01-01").cast("timestamp"))


simple("c2_history", "events", lambda t: I.history(t, F.col("user_id") == 1, [F.desc("ts"), F.col("event_id")], 30).select("event_id"), "SELECT event_id FROM events WHERE user_id = 1 ORDER BY ts DESC, event_id LIMIT 30")
simple("c3_recent", "events", lambda t: I.history(t, F.col("event_type").isin("error", "signup"), [F.desc("ts"), F.col("event_id")], 500).select("event_id", "event_type"), "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts DESC, event_id LIMIT 500")
simple("c4_statistics", "events", lambda t: A.histogram(_changes(t), "change_type"), f"SELECT change_type, count(*) AS n FROM {_CH} GROUP BY 1")
simple("c5_range", "events", lambda t: t.where(F.col("ts").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-06").cast("timestamp"))).select("event_id"), "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
simple("c6_user_history", "events", lambda t: I.history(t, F.col("value") > 50, [F.desc("ts"), F.col("event_id")], 50).select("event_id"), "SELECT event_id FROM events WHERE value > 50 ORDER BY ts DESC, event_id LIMIT 50")

# --- entities and tags ----------------------------------------------------------------------------------------------


@query("e1_unresolved", "SELECT c_custkey AS mention FROM customer WHERE c_acctbal / 10000 >= 0.6 AND c_custkey % 3 <> 0")
def e1(spark, d):
    m = table(spark, d, "customer").select(F.col("c_custkey").alias("mention"), F.col("c_mktsegment").alias("type"), F.col("c_name").alias("name"), (F.col("c_acctbal") / 10000).alias("confidence"))
    return E.unresolved(m, m.where("mention % 3 = 0")).select("mention")


@query("e2_match", "SELECT count(*) AS n, count(canonical) AS matched FROM (SELECT a.p_type, max(b.p_type) AS canonical FROM (SELECT DISTINCT p_type FROM part) a LEFT JOIN (SELECT DISTINCT p_type FROM part) b ON 1 - levenshtein(lower(a.p_type), lower(b.p_type)) / greatest(length(a.p_type), length(b.p_type)) >= 0.8 GROUP BY 1)")
def e2(spark, d):
    t = table(spark, d, "part").select("p_type").distinct()
    m = t.select(F.col("p_type").alias("mention"), F.lit("t").alias("type"), F.col("p_type").alias("name"))
    return E.match(m, m.withColumnRenamed("mention", "canonical")).agg(F.count("*").alias("n"), F.count("canonical").alias("matched"))


simple("e3_canonicalise", "customer", lambda t: E.canonicalise(t.select(F.col("c_mktsegment").alias("name"), F.lit("segment").alias("type"), F.col("c_nationkey").alias("doc"))).select("norm", "name", F.size("docs").alias("n")), "SELECT lower(c_mktsegment) AS norm, min(c_mktsegment) AS name, CAST(count(DISTINCT c_nationkey) AS INTEGER) AS n FROM customer GROUP BY 1")


@query("e5_merge_duplicates", "SELECT min(doc_id) AS canonical, count(*) AS merged FROM documents GROUP BY lower(trim(lang)), source")
def e5(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("canonical"), F.col("lang").alias("name"), F.col("source").alias("type"))
    return E.merge_duplicates(c, c.select(F.col("canonical").alias("mention"), "canonical"))[0].select("canonical", "merged")


simple("e6_best_name", "customer", lambda t: t.groupBy("c_nationkey").agg(F.min_by("c_name", E.name_rank(F.col("c_name"), "organisation")).alias("name")), "SELECT c_nationkey, c_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY -length(c_name), c_name) AS r FROM customer) WHERE r = 1")
simple("e7_merge_tags", "part", lambda t: E.merge_tags(t.groupBy(F.col("p_type").alias("tag")).agg(F.count("*").alias("usage"), F.collect_set("p_brand").alias("projects"))).select("name", "usage", F.size("projects").alias("n")), "SELECT regexp_replace(lower(p_type), ' +', '-', 'g') AS name, count(*) AS usage, CAST(count(DISTINCT p_brand) AS INTEGER) AS n FROM part GROUP BY 1")


@query("e8_tag_upsert", "SELECT source AS tag, count(*) AS usage FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def e8(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id").transform(lambda t: E.tag_usage(t.select(F.col("source").alias("tag"))))


simple("e10_preview", "documents", lambda t: R.page(t.where("source = 'src5'").select("doc_id", F.substring("text", 1, 150).alias("preview")), [F.col("doc_id")], 20), "SELECT doc_id, substr(text, 1, 150) AS preview FROM documents WHERE source = 'src5' ORDER BY 1 LIMIT 20")
simple("e12_dedup_mentions", "documents", lambda t: E.dedup_mentions(t.select(F.col("source").alias("doc"), F.col("lang").alias("type"), F.lit("X").alias("name"), ((F.col("doc_id") % 10) / 10).alias("confidence"), F.array(F.col("lang")).alias("aliases"))).select("doc", "type", "confidence"), "SELECT source AS doc, lang AS type, max((doc_id % 10) / 10) AS confidence FROM documents WHERE doc_id % 10 >= 6 GROUP BY 1, 2")

# --- conversations --------------------------------------------------------------------------------------------------

simple("v1_list", "conversations", lambda t: R.page(V.counters(t), [F.desc("n_messages"), F.col("conv_id")], 20), "SELECT conv_id, count(*) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
simple("v2_messages", "conversations", lambda t: t.where("conv_id = 1").orderBy("turn").select("turn", "role", "text"), "SELECT turn, role, text FROM conversations WHERE conv_id = 1 ORDER BY turn")
simple("v3_counters", "conversations", V.counters, "SELECT conv_id, count(*) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY 1")
simple("v4_turns", "conversations", V.turns, "WITH m AS (SELECT *, CAST(sum(CASE role WHEN 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_id FROM conversations WHERE role <> 'system') SELECT conv_id, turn_id, max(CASE role WHEN 'user' THEN text END) AS question, arg_max(text, turn) FILTER (role = 'assistant' AND trim(text) <> '') AS answer, count(*) AS n_messages FROM m WHERE turn_id > 0 GROUP BY 1, 2 HAVING count(*) FILTER (role = 'assistant' AND trim(text) <> '') > 0")
simple("v5_effective_size", "conversations", lambda t: t.select("conv_id", "turn", V.effective_size(F.col("text"), F.array(F.struct(F.lit("grep").alias("name"), F.col("role").alias("arguments"), F.lit(None).cast("string").alias("result")))).alias("n")), "SELECT conv_id, turn, CAST(length(text) + 4 + length(role) AS INTEGER) AS n FROM conversations")
simple("v6_summary_window", "conversations", lambda t: V.summary_window(t, F.lit(0), 500), "WITH m AS (SELECT conv_id, turn, length(text) AS l, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM conversations WHERE turn > 0) SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, CAST(max(run) AS BIGINT) AS chars FROM m WHERE run - l < 500 GROUP BY 1 HAVING max(run) >= 500")
simple("v8_recent_queries", "conversations", lambda t: R.budget_suffix(t.where("role = 'user'"), ["conv_id"], [F.desc("turn")], F.length("text"), 300).select("conv_id", "turn"), "SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations WHERE role = 'user') WHERE used <= 300")
simple("v10_recall", "conversations", lambda t: V.recall(t.select("conv_id", "turn", (F.col("turn") % 3).cast("int").alias("level"), F.lit(0.9).alias("score"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(turn as int))").alias("at")), F.lit("2024-02-01").cast("timestamp"), {0: 1.0, 1: 1.1, 2: 1.2}, 7.0, 0.5).select("conv_id", "turn", r6(F.col("score")).alias("score")), "SELECT conv_id, turn, round(0.9 * (1.0 + 0.1 * (turn % 3)) * (0.5 + 0.5 * exp(-(31 - turn) / 7.0)), 6) AS score FROM conversations")
simple("v12_budget_report", "conversations", lambda t: V.budget_report(t, "role", 100_000).withColumn("percent", r6(F.col("percent"))), "SELECT role, CAST(sum(length(text)) AS BIGINT) AS chars, round(100 * sum(length(text)) / 100000, 6) AS percent FROM conversations GROUP BY 1")
simple("v15_recent", "conversations", lambda t: V.recent(t, 600, 2).select("conv_id", "turn"), "SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER w AS used, sum(CASE role WHEN 'user' THEN 1 ELSE 0 END) OVER w AS users FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) WHERE used <= 600 AND users <= 2")
simple("v17_sessions", "conversations", lambda t: R.page(t.where("conv_id = 2").select("turn", "role"), [F.desc("turn")], 5), "SELECT turn, role FROM conversations WHERE conv_id = 2 ORDER BY turn DESC LIMIT 5")

# --- the change feed ------------------------------------------------------------------------------------------------


def _feed(t: DataFrame) -> DataFrame:
    return _changes(t).select(F.col("user_id").cast("string").alias("key"), "change_type", "ts")


simple("r1_coalesce", "events", lambda t: feed.coalesce_changes(_feed(t), seconds=86400), f"SELECT date_trunc('day', ts) AS window_start, CAST(user_id AS VARCHAR) AS key, CASE WHEN count(*) FILTER (change_type = 'deleted') > 0 THEN 'deleted' WHEN count(*) FILTER (change_type = 'updated') > 0 THEN 'updated' ELSE 'created' END AS change_type, coalesce(max(ts) FILTER (change_type = 'deleted'), max(ts) FILTER (change_type = 'updated'), min(ts) FILTER (change_type = 'created')) AS ts FROM {_CH} GROUP BY 1, 2")
ORACLE_SQL["r1_coalesce"] = ORACLE_SQL["r1_coalesce"].replace("date_trunc('day', ts)", "CAST(date_trunc('day', ts) AS TIMESTAMP)")
simple("r2_by_project", "events", lambda t: feed.by_project(t.withColumn("project_id", F.when(F.col("user_id") % 4 > 0, (F.col("user_id") % 4).cast("string")))), "SELECT coalesce(CASE WHEN user_id % 4 > 0 THEN CAST(user_id % 4 AS VARCHAR) END, '_orphan') AS project, count(*) AS n FROM events GROUP BY 1")
simple("r4_retention", "events", lambda t: feed.retained(feed.touched(_feed(t)), F.lit("2024-01-30").cast("timestamp"), 3).select("key"), "SELECT CAST(user_id AS VARCHAR) AS key FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-27'")
simple("r5_touched", "events", lambda t: feed.touched(_feed(t)), "SELECT CAST(user_id AS VARCHAR) AS key, min(ts) AS first_seen, max(ts) AS last_access, count(*) AS n FROM events GROUP BY 1")
simple("r7_running", "events", lambda t: feed.running_statistics(_feed(t)), f"SELECT change_type, count(*) AS n FROM {_CH} GROUP BY 1")


@query("x6_raw_sql", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def x6(spark, d):
    frame.register({t: table(spark, d, t) for t in ("customer", "nation")})
    return spark.sql("SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")


from tessera import code_queries, index_queries, memory_queries, upkeep_queries  # noqa: E402, F401 - they register their queries
