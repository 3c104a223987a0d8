"""Queries over upkeep: dirty rows, summaries of fields, backlogs, stored tags; parts of pages; a node's far neighbours; rows of merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import aggregate as A
from tessera.operators import incremental as I
from tessera.operators import resolution as E
from tessera.operators import search as S
from tessera.operators import traverse as X
from tessera.plans import graph
from tessera.plans.graph import table
from tessera.queries import _HYBRID, _LINKS, _NORM, _SIM, _VQ, _text_hits, r6, vec_of, vectors
from tessera.registry import query, simple
from tessera.sources import files
from tessera.sources.references import file_references

# --- dirty rows and texts to embed ----------------------------------------------------------------------------------

_ORDER_STATUS = "CASE WHEN o_orderkey % 5 = 0 THEN 'created' WHEN o_orderkey % 5 = 1 THEN 'modified' ELSE 'unchanged' END"


@query("i4_marked_dirty", f"SELECT o_orderkey AS id, ({_ORDER_STATUS} <> 'unchanged' OR o_orderstatus = 'P') AND o_custkey % 3 <> 0 AS dirty FROM orders")
def i4(spark, d):
    """Nodes marked by a diff, then those of some customers embedded again."""
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", True).alias("dirty"))
    old = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 1, "old").otherwise("same").alias("hash"))
    statuses = I.diff(old, rows.select("id", F.lit("same").alias("hash")), "id")
    done = o.where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("id"))
    return I.clear_dirty(I.mark_changed(rows, statuses), done).select("id", "dirty")


@query("i9_dirty_list", "SELECT vec_id FROM embeddings WHERE label = 0 AND vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def i9(spark, d):
    rows = I.mark_dirty(table(spark, d, "embeddings").select("vec_id", "label"), F.col("label") == 0)
    done = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return I.dirty_rows(I.clear_dirty(rows, done, "vec_id")).select("vec_id")


@query(
    "i7_chunk_tasks",
    """SELECT doc_id, lang, CAST(i AS INTEGER) AS chunk, 1 + len(string_split(substr(text, 1, 1800 * i), chr(10))) - 1 AS start_line, len(string_split(substr(text, 1, CASE WHEN length(text) <= 2000 THEN length(text) ELSE 1800 * i + 2000 END), chr(10))) AS end_line, sha256(substr(text, 1 + 1800 * i, 2000)) AS hash
FROM documents, LATERAL (SELECT unnest(range(CASE WHEN length(text) <= 2000 THEN 1 ELSE CAST(ceil((length(text) - 200) / 1800) AS BIGINT) END)) AS i)""",
)
def i7(spark, d):
    tasks = I.chunk_tasks(table(spark, d, "documents").select("doc_id", "lang", "text"), "text")
    return tasks.select("doc_id", "lang", "chunk", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.sha2("text", 256).alias("hash"))


# --- summaries of fields --------------------------------------------------------------------------------------------


def _summarised(spark, d):
    """Documents with summaries of texts over a thousand characters, some of whose texts were changed afterwards."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    made = rows.where(F.length("text") > 1000).select("id", F.substring("text", 1, 30).alias("purpose"), F.array("lang", F.lit("x")).alias("tags"))
    stored = I.store_summaries(rows, made, "text", F.lit("2024-01-01").cast("timestamp"))
    return stored.withColumn("text", F.when(F.col("id") % 4 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))


@query("i19_stored_summaries", "SELECT doc_id AS id, substr(text, 1, 30) AS purpose, lang || ', x' AS tags, doc_id % 4 <> 1 AS current FROM documents WHERE length(text) > 1000")
def i19_load(spark, d):
    return I.load_summaries(_summarised(spark, d), "text").select("id", "purpose", "tags", "current")


@query("i19_deleted_summaries", "SELECT doc_id AS id, CASE WHEN length(text) > 1000 AND toxic IS DISTINCT FROM 1 THEN substr(text, 1, 30) END AS purpose, length(text) > 1000 AND toxic IS DISTINCT FROM 1 AS stored FROM documents LEFT JOIN labels USING (doc_id)")
def i19_delete(spark, d):
    gone = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return I.delete_summaries(_summarised(spark, d), gone, "text").select("id", F.col("text_summary_purpose").alias("purpose"), F.col("text_summary_hash").isNotNull().alias("stored"))


# --- backlog and progress of vectors --------------------------------------------------------------------------------

_STATE = "CASE o_orderstatus WHEN 'F' THEN 'embedded' WHEN 'O' THEN 'linked' ELSE 'error' END"


@query("g22_vector_backlog", f"SELECT count(*) FILTER (s = 'linked') AS linked, (SELECT count(*) FROM embeddings WHERE label = 1) AS dirty, true AS needed FROM (SELECT {_STATE} AS s FROM orders)")
def g22(spark, d):
    nodes = table(spark, d, "embeddings").select((F.col("label") == 1).alias("dirty"))
    return A.vector_backlog(table(spark, d, "orders").select(F.expr(_STATE).alias("state")), nodes)


simple(
    "g22_vector_progress", "orders", lambda t: A.vector_progress(t.select(F.expr(_STATE).alias("state"))),
    f"SELECT count(*) AS total, count(*) FILTER (s = 'embedded') AS embedded, count(*) FILTER (s = 'linked') AS linked, CAST(0 AS BIGINT) AS embedding, count(*) FILTER (s = 'error') AS error, round(100 * count(*) FILTER (s = 'embedded') / count(*)) AS percent FROM (SELECT {_STATE} AS s FROM orders)",
)


# --- stored tags ----------------------------------------------------------------------------------------------------

_USES = "(SELECT p_partkey AS node, p_type AS name, replace(lower(p_type), ' ', '-') AS tag, CASE WHEN p_size % 2 = 0 THEN p_brand END AS category, p_brand AS project FROM part WHERE p_size > 5)"
_OLD_TAGS = "(SELECT DISTINCT replace(lower(p_type), ' ', '-') AS tag FROM part WHERE p_size < 15)"


def _tags(spark, d):
    p = table(spark, d, "part")
    name = F.col("p_type")
    old = p.where("p_size < 15").select(T.normalise_tag(name).alias("tag")).distinct()
    stored = old.select("tag", F.lit("Known").alias("name"), F.lit("kept").alias("category"), F.array(F.lit("first")).alias("projects"), F.lit(7).cast("long").alias("usage"))
    uses = p.where("p_size > 5").select(F.col("p_partkey").alias("node"), name.alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("category"), F.col("p_brand").alias("project"))
    return E.upsert_tags(stored, uses)


@query(
    "e8_stored_tags",
    f"""WITH n AS (SELECT tag, min(name) AS name, min(category) AS category, string_agg(DISTINCT project, ',' ORDER BY project) AS projects, count(*) AS usage FROM {_USES} GROUP BY 1)
SELECT coalesce(o.tag, n.tag) AS tag, CASE WHEN o.tag IS NULL THEN n.name ELSE 'Known' END AS name, CASE WHEN o.tag IS NULL THEN coalesce(category, 'other') ELSE 'kept' END AS category, concat_ws(',', CASE WHEN o.tag IS NOT NULL THEN 'first' END, projects) AS projects, CASE WHEN o.tag IS NULL THEN 0 ELSE 7 END + coalesce(usage, 0) AS usage FROM {_OLD_TAGS} o FULL JOIN n ON n.tag = o.tag""",
)
def e8(spark, d):
    return _tags(spark, d)[0].withColumn("projects", F.array_join("projects", ","))


@query("e8_tag_links", f"SELECT DISTINCT node, tag FROM {_USES}")
def e8_links(spark, d):
    return _tags(spark, d)[1]


# --- parts of pages -------------------------------------------------------------------------------------------------

_HEAD = """'<META property="og:site" content="a"><meta name="keys" content="k' || page_id || '"><meta name="keys" content="last ' || page_id || '"><link rel="stylesheet" href="/s' || page_id || '.css"><link href="https://far.example/x.css"><script defer src=''js/a' || page_id || '.js''></script><img alt="" src="img/' || page_id || '.png"><img src="data:x"><a class="b" href="doc' || page_id || '.md#part">d</a><a href="mailto:x@y.z">m</a>' || html"""


def _pages(spark, d):
    p, k = table(spark, d, "pages"), F.col("page_id").cast("string")
    parts = ['<META property="og:site" content="a"><meta name="keys" content="k', k, '"><meta name="keys" content="last ', k, '"><link rel="stylesheet" href="/s', k, '.css"><link href="https://far.example/x.css"><script defer src=\'js/a', k, '.js\'></script><img alt="" src="img/', k, '.png"><img src="data:x"><a class="b" href="doc', k, '.md#part">d</a><a href="mailto:x@y.z">m</a>']
    return p.withColumn("html", F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts), "html"))


@query(
    "f14_html_references",
    rf"""WITH p AS (SELECT page_id, {_HEAD} AS html FROM pages), a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href\s*=\s*[\x22\x27]([^\x22\x27]+)[\x22\x27]', 1)) AS u FROM p)
SELECT page_id, regexp_replace(u, '#.*$', '') AS source, 'document' AS kind, count(*) AS n FROM a WHERE NOT regexp_matches(u, '(?i)^(https?://|data:|mailto:|tel:|javascript:|#)') GROUP BY 1, 2 UNION ALL
SELECT page_id, source, kind, 1 FROM pages, LATERAL (VALUES ('/s' || page_id || '.css', 'stylesheet'), ('js/a' || page_id || '.js', 'code'), ('img/' || page_id || '.png', 'asset')) t(source, kind)""",
)
def f14(spark, d):
    found = _pages(spark, d).select("page_id", F.inline(T.html_references(F.col("html"))))
    return found.groupBy("page_id", "source", "kind").agg(F.count("*").alias("n"))


@query("f26_meta_tags", "SELECT page_id, name, CASE name WHEN 'keys' THEN 'last ' || page_id ELSE 'a' END AS content FROM pages, (VALUES ('og:site'), ('keys')) t(name)")
def f26_meta(spark, d):
    return _pages(spark, d).select("page_id", F.explode(T.meta_tags(F.col("html"))).alias("name", "content"))


@query(
    "f26_outline",
    r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6](?:\s[^>]*)?>.*?</h[1-6]>')) AS h FROM pages) SELECT page_id, CAST(substr(h, 3, 1) AS INTEGER) AS level, trim(regexp_replace(h, '<[^>]*>', '', 'g')) AS text, count(*) AS n FROM h WHERE trim(regexp_replace(h, '<[^>]*>', '', 'g')) <> '' GROUP BY 1, 2, 3""",
)
def f26(spark, d):
    found = table(spark, d, "pages").select("page_id", F.inline(T.outline(F.col("html"))))
    return found.groupBy("page_id", "level", "text").agg(F.count("*").alias("n"))


simple(
    "f22_array_format", "documents", lambda t: t.select("doc_id", T.format_field(F.split("text", " "), 8, 5).alias("t")),
    "SELECT doc_id, array_to_string(list_transform(string_split(text, ' ')[1:5], lambda w: CASE WHEN length(w) > 8 THEN substr(w, 1, 5) || '...' ELSE w END), ', ') AS t FROM documents",
)


# --- far neighbours of a node ---------------------------------------------------------------------------------------


@query(
    "t9_explore_far",
    """WITH e AS (SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, 'IN_NATION' AS type FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'IN_REGION' FROM nation), b AS (SELECT * FROM e UNION ALL SELECT dst, src, type || '_BY' FROM e),
o AS (SELECT dst AS id, 1 AS depth, type FROM b WHERE src = 'region:1'), t AS (SELECT DISTINCT b.dst AS id, 2 AS depth, b.type FROM o JOIN b ON b.src = o.id WHERE b.dst <> 'region:1' AND b.dst NOT IN (SELECT id FROM o)),
k AS (SELECT id, depth FROM (SELECT DISTINCT id, depth FROM o UNION SELECT DISTINCT id, depth FROM t) ORDER BY depth, id LIMIT 25)
SELECT type, CAST(depth AS INTEGER) AS depth, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT * FROM o UNION SELECT * FROM t) JOIN k USING (id, depth) GROUP BY 1, 2""",
)
def t9(spark, d):
    return X.explore_far("region:1", graph.edges(spark, d, ["IN_NATION", "IN_REGION"]), graph.nodes(spark, d), 2, 25)


# --- rows of merges and of both kinds of hits -----------------------------------------------------------------------


@query(
    "e2_match_rows",
    """WITH p AS (SELECT p_partkey, p_name, substr(p_name, 1, length(p_name) - 2) AS cut, CASE p_partkey % 2 WHEN 0 THEN 'a' ELSE 'b' END AS type FROM part),
n AS (SELECT a.cut, a.type, b.p_name AS name, 1 - levenshtein(lower(a.cut), lower(b.p_name)) / greatest(length(a.cut), length(b.p_name)) AS sim FROM (SELECT DISTINCT cut, type FROM p) a JOIN (SELECT DISTINCT p_name, type FROM p) b ON a.type = b.type AND abs(length(a.cut) - length(b.p_name)) <= 0.2 * greatest(length(a.cut), length(b.p_name)) WHERE 1 - levenshtein(lower(a.cut), lower(b.p_name)) / greatest(length(a.cut), length(b.p_name)) >= 0.8)
SELECT p.p_partkey AS mention, (SELECT min(c.p_partkey) FROM p c JOIN n ON n.name = c.p_name AND n.type = c.type WHERE n.cut = p.cut AND n.type = p.type AND n.sim = (SELECT max(sim) FROM n m WHERE m.cut = p.cut AND m.type = p.type)) AS canonical FROM p""",
)
def e2(spark, d):
    """Names of parts that lost two letters, matched with the whole names."""
    p = table(spark, d, "part").withColumn("type", F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b"))
    cut = F.substring(F.col("p_name"), F.lit(1), F.length("p_name") - 2)
    mentions, canonicals = p.select(F.col("p_partkey").alias("mention"), "type", cut.alias("name")), p.select(F.col("p_partkey").alias("canonical"), "type", F.col("p_name").alias("name"))
    return E.match(mentions, canonicals).select("mention", "canonical")


@query("e5_moved_links", "SELECT doc_id AS mention, min(doc_id) OVER (PARTITION BY lower(trim(lang)), source) AS canonical FROM documents")
def e5(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("canonical"), F.col("lang").alias("name"), F.col("source").alias("type"))
    return E.merge_duplicates(c, c.select(F.col("canonical").alias("mention"), "canonical"))[1]


@query("a9_edge_rows", "SELECT DISTINCT 'orders:' || o_orderkey AS src, 'customer:' || o_custkey AS dst, 'PLACED_BY' AS type FROM orders WHERE o_orderkey % 4 = 0 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def a9(spark, d):
    e = graph.edges(spark, d, ["PLACED_BY"])
    ends = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(graph.node_id("customer", "c_custkey").alias("id")).unionByName(graph.nodes(spark, d, ["orders"]).select("id"))
    return I.upsert_edges(e.where(F.regexp_extract("src", r"(\d+)$", 1).cast("long") % 4 == 0), e.unionByName(e), ends)


@query("t12_pending_rows", "SELECT o_orderkey AS src, o_custkey AS target, o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) AS resolved FROM orders")
def t12(spark, d):
    pending = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("target"))
    done, left = X.resolve_pending(pending, table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id")))
    return done.withColumn("resolved", F.lit(True)).unionByName(left.withColumn("resolved", F.lit(False)))


@query(
    "s1_with_neighbour_names",
    f"SELECT h.id, round(score, 6) AS score, (SELECT string_agg(DISTINCT s_name, ',' ORDER BY s_name) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = h.id) AS suppliers FROM (SELECT e.vec_id AS id, {_SIM} AS score FROM {_VQ} WHERE e.vec_id IN (SELECT p_partkey FROM part) ORDER BY {_SIM} DESC, e.vec_id LIMIT 15) h",
)
def s1(spark, d):
    """The nearest parts, each with the names of those that supply it."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    hits = S.vector_search(vectors(spark, d).join(parts, "id", "left_semi"), vec_of(spark, d), 15).withColumn("number", F.col("id")).withColumn("id", graph.node_id("part", "number"))
    found = X.enrich(hits, graph.edges(spark, d, ["SUPPLIED_BY"]), graph.nodes(spark, d, ["supplier"]), {"suppliers": "SUPPLIED_BY"})
    return found.select(F.col("number").alias("id"), r6(F.col("score")).alias("score"), F.array_join("suppliers", ",").alias("suppliers"))


@query("s9_hybrid_page", _HYBRID + " SELECT id, round(score, 6) AS score, lang, total FROM (SELECT x.id, x.score, lang, count(*) OVER () AS total FROM x JOIN documents ON doc_id = x.id WHERE lang IN ('en', 'fr') AND x.score >= 0.12 ORDER BY x.score DESC, x.id LIMIT 10 OFFSET 2)")
def s9(spark, d):
    """The front door with hits of both kinds: filter and minimum score hold before the second page is cut."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    near = S.vector_search(vectors(spark, d), vec_of(spark, d), 60, least=0.1)
    out = S.search(near, _text_hits(spark, d, "thing with", 60), docs, 10, 2, where=F.col("lang").isin("en", "fr"), least=0.12)
    return out.select("id", r6(F.col("score")).alias("score"), "lang", "total")


# --- sites, and what files of all kinds refer to ---------------------------------------------------------------------

_SITE = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1))"
simple("a5_sites", "pages", files.sites, f"SELECT {_SITE} AS site, count(DISTINCT {_NORM.format(u='url')}) AS n_pages, min({_NORM.format(u='url')}) AS first_url FROM pages WHERE {_SITE} <> '' GROUP BY 1")
simple(
    "a5_page_graph", "pages", files.page_graph,
    f"SELECT DISTINCT {_SITE} AS src, {_NORM.format(u='url')} AS dst, 'HAS_PAGE' AS type FROM pages WHERE {_SITE} <> '' UNION ALL SELECT src, dst, 'LINKS_TO' FROM {_LINKS} WHERE src <> dst AND dst IN (SELECT {_NORM.format(u='url')} FROM pages)",
)


@query(
    "f11_file_references",
    """WITH p AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS c, p_size AS z, string_split(p_name, ' ') AS w, CAST(p_size AS VARCHAR) AS s FROM part), r AS (
SELECT k, '.ts' AS e, z % 4 + 2 AS line, './m' || s AS source, w[1] || ',' || w[2] AS symbols, 'code' AS type, true AS local FROM p WHERE k % 6 = 0 UNION ALL SELECT k, '.ts', z % 4 + 5, '../d' || c, 'x' || s, 'code', true FROM p WHERE k % 6 = 0 UNION ALL SELECT k, '.ts', z % 4 + 5, 'pkg', '*', 'code', false FROM p WHERE k % 6 = 0
UNION ALL SELECT k, '.py', z % 4 + 2, '.m' || s, w[1] || ',' || w[2], 'code', true FROM p WHERE k % 6 = 1 UNION ALL SELECT k, '.py', z % 4 + 5, 'os.p' || c, '*', 'code', false FROM p WHERE k % 6 = 1
UNION ALL SELECT k, '.md', z % 4 + 2, 'docs/p' || c || '.md', '', 'document', true FROM p WHERE k % 6 = 2 UNION ALL SELECT k, '.md', z % 4 + 3, 'img/' || s || '.png', '', 'asset', true FROM p WHERE k % 6 = 2 UNION ALL SELECT k, '.md', z % 4 + 3, 'https://www.h' || s || '.example/', '', 'url', false FROM p WHERE k % 6 = 2
UNION ALL SELECT k, '.css', z % 4 + 2, 'base' || s || '.css', '', 'stylesheet', true FROM p WHERE k % 6 = 3 UNION ALL SELECT k, '.css', z % 4 + 3, 'f/' || c || '.woff2', '', 'asset', true FROM p WHERE k % 6 = 3
UNION ALL SELECT k, '.html', z % 4 + 2, 'p' || c || '.html', '', 'document', true FROM p WHERE k % 6 = 4 UNION ALL SELECT k, '.html', z % 4 + 3, 's' || s || '.js', '', 'code', true FROM p WHERE k % 6 = 4
UNION ALL SELECT k, '.vue', z % 4 + 4, './m' || s, 'default', 'code', true FROM p WHERE k % 6 = 5 UNION ALL SELECT k, '.vue', z % 4 + 7, 'v' || c || '.css', '', 'stylesheet', true FROM p WHERE k % 6 = 5)
SELECT 'src/f' || CAST(k AS VARCHAR) || e AS path, CAST(line AS INTEGER) AS line, source, symbols, type, local FROM r""",
)
def f11_files(spark, d):
    """Files of six kinds, of lines that name nothing and then of such that do, with names from the part's."""
    c, z, w = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.split("p_name", " ")
    kind, above = F.col("p_partkey") % 6, F.repeat(F.lit("no words\n"), (F.col("p_size") % 4 + 1).cast("int"))
    a, b = F.get(w, F.lit(0)), F.get(w, F.lit(1))
    body = (
        F.when(kind == 0, F.concat(F.lit("import {\n  "), a, F.lit(" as A, "), b, F.lit(" } from './m"), z, F.lit("'\n\nconst { x"), z, F.lit(" } = await import('../d"), c, F.lit("'); export * from \"pkg\"\n")))
        .when(kind == 1, F.concat(F.lit("from .m"), z, F.lit(" import ("), a, F.lit(",\n  "), b, F.lit(" as B)\n\nimport os.p"), c, F.lit("\n")))
        .when(kind == 2, F.concat(F.lit("[a](docs/p"), c, F.lit(".md#top) [b](#c)\n![d](img/"), z, F.lit(".png) on www.h"), z, F.lit(".example/, too")))
        .when(kind == 3, F.concat(F.lit("@import url('base"), z, F.lit(".css');\na { src: url(f/"), c, F.lit(".woff2), url(https://h.example/x.png) }")))
        .when(kind == 4, F.concat(F.lit("<a href='p"), c, F.lit(".html#q'>a</a>\n<script src=\"s"), z, F.lit(".js\"></script>")))
        .otherwise(F.concat(F.lit("<template><p/></template>\n<script>\nimport M from './m"), z, F.lit("'\n</script>\n<style>\n@import 'v"), c, F.lit(".css';\n</style>")))
    )
    ends = F.get(F.array(*(F.lit(e) for e in (".ts", ".py", ".md", ".css", ".html", ".vue"))), kind.cast("int"))
    out = file_references(table(spark, d, "part").select(F.concat(F.lit("src/f"), c, ends).alias("path"), F.concat(above, body).alias("content")))
    return out.withColumn("symbols", F.array_join("symbols", ","))


simple(
    "f20_entity_lines", "part",
    lambda t: t.select("p_partkey", E.entity_text(F.col("p_name"), F.when(F.col("p_size") > 25, F.split("p_type", " ")).otherwise(F.array().cast("array<string>")), F.lower("p_brand")).alias("t")),
    "SELECT p_partkey, concat_ws(chr(10), p_name, CASE WHEN p_size > 25 THEN 'Aliases: ' || replace(p_type, ' ', ', ') END, 'Type: ' || lower(p_brand)) AS t FROM part",
)
