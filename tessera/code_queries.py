"""Queries over sources, references, conversations with tool calls, and state, all derived from the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vectors import cosine, vector
from tessera.operators import conversations as V
from tessera.operators import incremental as I
from tessera.operators import ranking as R
from tessera.operators import resolution as E
from tessera.operators import search as S
from tessera.operators import traverse as X
from tessera.plans import frame, graph
from tessera.plans.graph import table
from tessera.registry import query, simple
from tessera.sources import data_files
from tessera.streaming import feed


def s(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def joined(c) -> F.Column:
    return F.array_join(c, ",")


# --- references in sources ------------------------------------------------------------------------------------------

def _script() -> F.Column:
    """A script source that imports in five ways."""
    return F.concat(
        F.lit("import Main, { A"), s("p_size"), F.lit(" as B, C } from './m"), s(F.col("p_partkey") % 50), F.lit("';\nimport * as ns from 'pkg"), s(F.col("p_size") % 5),
        F.lit("';\n\nexport { X } from '../lib/x';\nconst y = require('./data.json');\nawait import('lazy');\n"),
    )


@query(
    "f11_script_imports",
    """SELECT p_partkey, line, module, symbols, local FROM part, (VALUES (1, 'a'), (2, 'b'), (4, 'c'), (5, 'd'), (6, 'e')) v(line, k), LATERAL (SELECT
CASE k WHEN 'a' THEN './m' || CAST(p_partkey % 50 AS VARCHAR) WHEN 'b' THEN 'pkg' || CAST(p_size % 5 AS VARCHAR) WHEN 'c' THEN '../lib/x' WHEN 'd' THEN './data.json' ELSE 'lazy' END AS module,
CASE k WHEN 'a' THEN 'default,A' || CAST(p_size AS VARCHAR) || ',C' WHEN 'b' THEN '*' WHEN 'c' THEN 'X' ELSE '' END AS symbols, k IN ('a', 'c', 'd') AS local)""",
)
def f11(spark, d):
    out = table(spark, d, "part").select("p_partkey", F.explode(T.script_imports(_script())).alias("i"))
    return out.select("p_partkey", "i.line", "i.module", joined("i.symbols").alias("symbols"), "i.local")


@query(
    "f12_python_imports",
    """SELECT p_partkey, line, module, symbols, local FROM part, LATERAL (SELECT 1 AS line, '.m' || CAST(p_partkey % 7 AS VARCHAR) AS module, 'a,b' AS symbols, true AS local
UNION ALL SELECT 4, 'os.path', '', false UNION ALL SELECT 5, 'pkg', 'x' || CAST(p_size AS VARCHAR), false)""",
)
def f12(spark, d):
    text = F.concat(F.lit("from .m"), s(F.col("p_partkey") % 7), F.lit(" import (\n    a,\n    b as c)\nimport os.path\nfrom pkg import x"), s("p_size"), F.lit("\nfromage = 1\n"))
    out = table(spark, d, "part").select("p_partkey", F.explode(T.python_imports(text)).alias("i"))
    return out.select("p_partkey", "i.line", "i.module", joined("i.symbols").alias("symbols"), "i.local")


@query("f13_markdown_links", "SELECT p_partkey, unnest(['docs/p' || CAST(p_partkey AS VARCHAR) || '.md', 'img/' || CAST(p_size AS VARCHAR) || '.png']) AS target FROM part")
def f13(spark, d):
    text = F.concat(F.lit("See [part](docs/p"), s("p_partkey"), F.lit(".md#top) and ![it](img/"), s("p_size"), F.lit(".png) or [out](https://a.b/c) [here](#x)"))
    return table(spark, d, "part").select("p_partkey", F.explode(T.markdown_links(text)).alias("target"))


simple(
    "f14_style_links", "part",
    lambda t: t.select("p_partkey", F.explode(T.style_links(F.concat(F.lit("@import 'base"), s(F.col("p_size") % 3), F.lit(".css';\nbody { background: url(\"img/"), s("p_partkey"), F.lit(".png\"); }")))).alias("target")),
    "SELECT p_partkey, unnest(['base' || CAST(p_size % 3 AS VARCHAR) || '.css', 'img/' || CAST(p_partkey AS VARCHAR) || '.png']) AS target FROM part",
)


@query("f15_component_sections", "SELECT p_partkey, './m' || CAST(p_size AS VARCHAR) AS script, 'x' || CAST(p_size AS VARCHAR) || '.css' AS style FROM part")
def f15(spark, d):
    page = F.concat(F.lit("<template><p/></template>\n<script setup>\nimport A from './m"), s("p_size"), F.lit("';\n</script>\n<style scoped>@import 'x"), s("p_size"), F.lit(".css';</style>"))
    return table(spark, d, "part").select(
        "p_partkey", F.get(T.script_imports(T.component_section(page, "script")), F.lit(0))["module"].alias("script"), F.get(T.style_links(T.component_section(page, "style")), F.lit(0)).alias("style")
    )


@query(
    "f17_loose_paths",
    """SELECT p_partkey, path, confidence, context FROM part, LATERAL (SELECT 'src/p' || CAST(p_partkey AS VARCHAR) || '.ts' AS path, CAST(0.9 AS DOUBLE) AS confidence,
'the file src/p' || CAST(p_partkey AS VARCHAR) || '.ts and readme.md of it' AS context
UNION ALL SELECT 'readme.md', 0.6, right('the file src/p' || CAST(p_partkey AS VARCHAR) || '.ts and ', 20) || 'readme.md of it')""",
)
def f17(spark, d):
    text = F.concat(F.lit("the file src/p"), s("p_partkey"), F.lit(".ts and readme.md of it\nimport './skip.ts'\nconst a = 'b.js';"))
    out = table(spark, d, "part").select("p_partkey", F.explode(T.loose_paths(text)).alias("p"))
    return out.select("p_partkey", "p.path", "p.confidence", F.regexp_replace("p.context", r"(?s) it\n.*$", F.lit("")).alias("c"), "p.context").select(
        "p_partkey", "path", "confidence", F.when(F.col("path") == "readme.md", F.regexp_replace("context", r"\n.*", "")).otherwise(F.col("context")).alias("context")
    )


def _file() -> F.Column:
    """Path of one of 50 files."""
    k = F.col("p_partkey") % 50
    return F.concat(F.lit("src/m"), s(k), F.when(k < 20, ".ts").when(k < 40, "/index.jsx").otherwise(".css"))


@query(
    "t13_resolve_imports",
    """SELECT DISTINCT 'src/a/f' || CAST(p_partkey AS VARCHAR) || '.ts' AS file, '../m' || CAST(k AS VARCHAR) || e AS module, 'src/m' || CAST(k AS VARCHAR) || CASE WHEN k < 20 THEN '.ts' WHEN k < 40 THEN '/index.jsx' ELSE '.css' END AS target
FROM (SELECT p_partkey, p_partkey % 60 AS k, CASE WHEN p_partkey % 60 < 20 AND p_partkey % 2 = 0 THEN '.js' WHEN p_partkey % 60 >= 40 THEN '.css' ELSE '' END AS e FROM part) WHERE k < 50""",
)
def t13(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 60
    ending = F.when((k < 20) & (F.col("p_partkey") % 2 == 0), ".js").when(k >= 40, ".css").otherwise("")
    imports = p.select(F.concat(F.lit("src/a/f"), s("p_partkey"), F.lit(".ts")).alias("file"), F.concat(F.lit("../m"), s(k), ending).alias("module"))
    return X.resolve_imports(imports, p.select(_file().alias("path")).distinct())


def _scopes(spark, d) -> DataFrame:
    """Scopes of code files: two a part, the second the child of the first."""
    p = table(spark, d, "part").where("p_partkey % 50 < 40").select("p_partkey", _file().alias("file"))
    a = p.select(F.concat(F.lit("c"), s("p_partkey")).alias("id"), "file", F.concat(F.lit("C"), s("p_partkey")).alias("name"), F.lit(None).cast("string").alias("parent_name"))
    return a.unionByName(p.select(F.concat(F.lit("m"), s("p_partkey")).alias("id"), "file", F.concat(F.lit("run"), s("p_partkey")).alias("name"), F.concat(F.lit("C"), s("p_partkey")).alias("parent_name")))


_TARGET = "'src/m' || CAST(p_partkey % 50 AS VARCHAR) || CASE WHEN p_partkey % 50 < 20 THEN '.ts' WHEN p_partkey % 50 < 40 THEN '/index.jsx' ELSE '.css' END"


@query(
    "t14_reference_edges",
    f"""SELECT 'f' || CAST(p_size AS VARCHAR) AS src, CASE WHEN p_partkey % 50 < 40 THEN 'c' || CAST(p_partkey AS VARCHAR) ELSE {_TARGET} END AS dst, CASE WHEN p_partkey % 50 < 40 THEN 'CONSUMES' ELSE 'REFERENCES_STYLE' END AS type FROM part
UNION SELECT 'g', 'doc' || CAST(p_size AS VARCHAR) || '.md', 'REFERENCES_DOC' FROM part""",
)
def t14(spark, d):
    p = table(spark, d, "part")
    refs = p.select(F.concat(F.lit("f"), s("p_size")).alias("src"), _file().alias("path"), F.array(F.concat(F.lit("C"), s("p_partkey")), F.lit("Other")).alias("symbols"))
    docs = p.select(F.lit("g").alias("src"), F.concat(F.lit("doc"), s("p_size"), F.lit(".md")).alias("path"), F.array().cast("array<string>").alias("symbols"))
    return X.reference_edges(refs.unionByName(docs), _scopes(spark, d))


@query(
    "t15_scope_edges",
    """SELECT DISTINCT CASE WHEN p_size % 3 = 1 THEN 'b' || CAST(p_size AS VARCHAR) ELSE 'a' || CAST(p_size AS VARCHAR) END AS src, CASE WHEN p_size % 3 = 1 THEN 'a' || CAST(p_size AS VARCHAR) ELSE 'b' || CAST(p_size AS VARCHAR) END AS dst,
CASE WHEN p_size % 3 = 1 THEN 'DECORATED_BY' ELSE 'CONSUMES' END AS type FROM part WHERE p_size % 3 < 2""",
)
def t15(spark, d):
    kind = F.when(F.col("p_size") % 3 == 0, "CONSUMES").when(F.col("p_size") % 3 == 1, "DECORATES").otherwise("CONSUMED_BY")
    return X.scope_edges(table(spark, d, "part").select(F.concat(F.lit("a"), s("p_size")).alias("src"), F.concat(F.lit("b"), s("p_size")).alias("dst"), kind.alias("kind")))


@query("t16_parents", "SELECT 'm' || CAST(p_partkey AS VARCHAR) AS child, 'c' || CAST(p_partkey AS VARCHAR) AS parent FROM part WHERE p_partkey % 50 < 40")
def t16(spark, d):
    return X.parent_scopes(_scopes(spark, d))


@query(
    "t17_inheritance",
    """SELECT 's' || CAST(p_partkey AS VARCHAR) AS child, 's' || CAST(p_partkey - 1 AS VARCHAR) AS parent FROM part WHERE p_partkey > 1 AND p_partkey % 3 < 2
AND (p_partkey - 1) IN (SELECT p_partkey FROM part) AND p_partkey % 4 >= 2""",
)
def t17(spark, d):
    up = s(F.col("p_partkey") - 1)
    name = F.concat(F.lit("N"), s("p_partkey"))
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("class "), name, F.lit(" extends N"), up, F.lit(" {"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("class "), name, F.lit("(Base, N"), up, F.lit("):"))).otherwise("def f():")
    scopes = table(spark, d, "part").select(F.when(F.col("p_partkey") % 4 == 0, -1 - F.col("p_partkey")).otherwise(F.floor(F.col("p_partkey") / 4)).alias("project_id"), F.concat(F.lit("s"), s("p_partkey")).alias("id"), name.alias("name"), text.alias("signature"))
    return X.inheritance(scopes)


@query("t18_library_edges", "SELECT 'p' || CAST(p_partkey AS VARCHAR) AS src, 'lib:pkg' || CAST(p_size % 5 AS VARCHAR) AS dst, 'USES_LIBRARY' AS type, '*' AS symbols FROM part UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), 'lib:lazy', 'USES_LIBRARY', '' FROM part")
def t18(spark, d):
    found = table(spark, d, "part").select(F.concat(F.lit("p"), s("p_partkey")).alias("scope"), F.explode(T.script_imports(_script())).alias("i")).select("scope", "i.*")
    return X.library_edges(found)[1].select("src", "dst", "type", joined("symbols").alias("symbols"))


@query(
    "i20_complete_imports",
    """SELECT 'm' || CAST(o.o_orderkey AS VARCHAR) AS src, 'c' || CAST(p.p_partkey AS VARCHAR) AS dst, 'CONSUMES' AS type FROM orders o JOIN part p ON p.p_partkey = o.o_orderkey % 97 + 1 WHERE p.p_partkey % 50 < 40""",
)
def i20(spark, d):
    key = F.col("o_orderkey") % 97 + 1
    o = table(spark, d, "orders").select("o_orderkey", key.alias("p_partkey"))
    pending = o.select(F.concat(F.lit("o"), s("o_orderkey")).alias("src_file"), _file().alias("dst_file"), F.array(F.concat(F.lit("C"), s("p_partkey"))).alias("symbols"), F.concat(F.lit("m"), s("o_orderkey")).alias("scope"))
    own = o.select(F.concat(F.lit("m"), s("o_orderkey")).alias("id"), F.concat(F.lit("o"), s("o_orderkey")).alias("file"), F.lit("main").alias("name"))
    return X.complete_imports(pending, own.unionByName(_scopes(spark, d).select("id", "file", "name")))[0]


_REF = "CASE p_partkey % 3 WHEN 0 THEN 'lib/p' || CAST(p_partkey AS VARCHAR) || '.py' WHEN 1 THEN 'p' || CAST(p_partkey AS VARCHAR) || '.py' ELSE 'zz/none-at-all-' || CAST(p_partkey AS VARCHAR) || '.rs' END"


def _mentions(spark, d) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    known = p.select(F.concat(F.lit("src/lib/p"), s("p_partkey"), F.lit(".py")).alias("path"))
    k = F.col("p_partkey") % 3
    ref = F.when(k == 0, F.concat(F.lit("lib/p"), s("p_partkey"), F.lit(".py"))).when(k == 1, F.concat(F.lit("p"), s("p_partkey"), F.lit(".py"))).otherwise(F.concat(F.lit("zz/none-at-all-"), s("p_partkey"), F.lit(".rs")))
    return p.select(F.col("p_partkey").alias("mention"), ref.alias("ref"), F.when(k == 0, 0.9).otherwise(0.6).alias("confidence")), known


@query("s19_loose_references", f"SELECT {_REF} AS ref, 'src/lib/p' || CAST(p_partkey AS VARCHAR) || '.py' AS path, CAST(1.0 AS DOUBLE) AS score FROM part WHERE p_partkey % 3 < 2")
def s19(spark, d):
    mentions, known = _mentions(spark, d)
    return S.resolve_loose(mentions.select("ref"), known)


@query("s20_resolve_mentions", "SELECT p_partkey AS mention, 'src/lib/p' || CAST(p_partkey AS VARCHAR) || '.py' AS path, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0.9 ELSE 0.6 END AS DOUBLE) AS confidence FROM part WHERE p_partkey % 3 < 2")
def s20(spark, d):
    return S.resolve_mentions(*_mentions(spark, d))[0]


@query("s20_pending_mentions", f"SELECT p_partkey AS mention, {_REF} AS ref, CAST(0.6 AS DOUBLE) AS confidence FROM part WHERE p_partkey % 3 = 2")
def s20b(spark, d):
    return S.resolve_mentions(*_mentions(spark, d))[1].select("mention", "ref", "confidence")


@query(
    "a2_data_entries",
    """SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'r.kind' ELSE 'kind' END AS key, event_type AS value FROM events UNION ALL SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'r.user' ELSE 'user' END, CAST(user_id AS VARCHAR) FROM events""",
)
def a2(spark, d):
    k, kind, user = F.col("event_id") % 4, F.col("event_type"), s("user_id")
    text = (
        F.when(k == 0, F.concat(F.lit('{"kind": "'), kind, F.lit('", "user": '), user, F.lit("}")))
        .when(k == 1, F.concat(F.lit("<r><kind>"), kind, F.lit("</kind><user>"), user, F.lit("</user></r>")))
        .when(k == 2, F.concat(F.lit("# note\nkind="), kind, F.lit('\nuser="'), user, F.lit('"\n')))
        .otherwise(F.concat(F.lit("kind: "), kind, F.lit("\nuser: "), user))
    )
    ending = F.when(k == 0, ".json").when(k == 1, ".xml").when(k == 2, ".env").otherwise(".yaml")
    got = data_files.data_entries(table(spark, d, "events").select(F.concat(s("event_id"), ending).alias("path"), text.alias("content")))
    return got.select(F.substring_index("path", ".", 1).cast("long").alias("event_id"), "key", "value")


# --- entities -------------------------------------------------------------------------------------------------------


@query(
    "e4_merge_mention",
    """SELECT p_size AS canonical, max(p_brand) FILTER (length(p_brand) = l) AS name FROM (SELECT p_size, p_brand, max(length(p_brand)) OVER (PARTITION BY p_size) AS l FROM part) GROUP BY 1""".replace("max(p_brand) FILTER", "min(p_brand) FILTER"),
)
def e4(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").alias("canonical"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("doc"))
    start = p.groupBy("canonical").agg(F.min("name").alias("name"), F.min("doc").alias("doc")).select("canonical", "name", F.array().cast("array<string>").alias("aliases"), F.array("doc").alias("docs"))
    return E.merge_mention(p.withColumn("aliases", F.array().cast("array<string>")), start).select("canonical", "name")


@query("e9_tag_groups", "SELECT 'size' || CAST(g AS VARCHAR) AS tag, CAST(n AS BIGINT) AS usage FROM (SELECT p_size // 10 AS g, sum(1) AS n FROM part GROUP BY 1)")
def e9(spark, d):
    tags = table(spark, d, "part").groupBy(F.concat(F.lit("t"), s("p_size")).alias("tag"), F.floor(F.col("p_size") / 10).alias("g")).agg(F.count("*").alias("usage"))
    merged = E.merge_groups(tags.select("tag", "usage"), tags.select("tag", F.concat(F.lit("size"), s("g")).alias("group")))
    names = tags.select("tag", F.concat(F.lit("size"), s("g")).alias("name"))
    return merged.join(names, "tag").select(F.col("name").alias("tag"), "usage")


@query("e11_entity_vectors", "SELECT n_nationkey AS id, n_name || chr(10) || 'Type: nation' AS text, sha256(n_name || chr(10) || 'Type: nation') AS hash FROM nation WHERE n_nationkey % 2 = 1")
def e11(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit("nation").alias("type"))
    stored = n.where("id % 2 = 0").select("id", F.sha2(E.entity_text(F.col("name"), F.col("aliases"), F.col("type")), 256).alias("hash"))
    return E.entity_vectors(n, stored).select("id", "text", "hash")


# --- conversations with tool calls ----------------------------------------------------------------------------------


def _calls(t: DataFrame) -> DataFrame:
    """Two calls for some assistant messages, one of which may fail."""
    own = t.where("role = 'assistant' and (conv_id + turn) % 2 = 0")
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("call")
    turn, conv = s("turn"), s("conv_id")
    return own.select("conv_id", "turn", k).select(
        "conv_id", "turn", "call", F.when(F.col("call") == 0, "read_file").otherwise("search").alias("tool"),
        F.when(F.col("call") == 0, F.concat(F.lit('{"path":"src/f'), turn, F.lit('.ts"}'))).otherwise('{"query":"x"}').alias("arguments"),
        F.when(F.col("call") == 1, F.concat(F.lit('{"results":[{"uuid":"n'), conv, F.lit('","file":"lib/g'), turn, F.lit('.py"}]}'))).otherwise("{}").alias("result"),
        ((F.col("call") == 0) | (F.col("turn") % 4 != 1)).alias("success"),
    )


_CALLS = "(SELECT conv_id, turn, call, CASE call WHEN 0 THEN 'read_file' ELSE 'search' END AS tool, (call = 0 OR turn % 4 <> 1) AS success FROM conversations, (VALUES (0), (1)) v(call) WHERE role = 'assistant' AND (conv_id + turn) % 2 = 0)"


@query("v2_messages_with_tools", f"SELECT conv_id, turn, role, coalesce((SELECT string_agg(tool || ':' || CAST(success AS VARCHAR), ',' ORDER BY call) FROM {_CALLS} c WHERE c.conv_id = m.conv_id AND c.turn = m.turn), '') AS tools FROM conversations m")
def v2(spark, d):
    t = table(spark, d, "conversations")
    return V.messages_with_tools(t, _calls(t)).select("conv_id", "turn", "role", joined(F.transform("tools", lambda c: F.concat_ws(":", c["tool"], c["success"].cast("string")))).alias("tools"))


@query(
    "v4_turns_with_tools",
    f"""WITH t AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN ' ' ELSE text END AS text FROM conversations), m AS (SELECT *, CAST(sum(CASE role WHEN 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_id FROM t WHERE role <> 'system'),
g AS (SELECT conv_id, turn_id, max(CASE role WHEN 'user' THEN text END) AS question, coalesce(arg_max(text, turn) FILTER (role = 'assistant' AND trim(text) <> ''), '') AS answer FROM m WHERE turn_id > 0 GROUP BY 1, 2),
c AS (SELECT conv_id, turn_id, string_agg(tool || ':' || CAST(success AS VARCHAR), ',' ORDER BY turn, call) AS tools FROM {_CALLS} JOIN m USING (conv_id, turn) WHERE turn_id > 0 GROUP BY 1, 2)
SELECT conv_id, turn_id, question, answer, coalesce(tools, '') AS tools FROM g LEFT JOIN c USING (conv_id, turn_id) WHERE answer <> '' OR tools IS NOT NULL""",
)
def v4(spark, d):
    t = table(spark, d, "conversations")
    blank = t.withColumn("text", F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 0), " ").otherwise(F.col("text")))
    return V.turns_with_tools(blank, _calls(t)).withColumn("tools", joined(F.transform("tools", lambda c: F.concat_ws(":", c["tool"], c["success"].cast("string")))))


@query(
    "v14_tool_mentions",
    f"""SELECT DISTINCT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS message, kind, value FROM {_CALLS}, LATERAL (SELECT 'file' AS kind, 'src/f' || CAST(turn AS VARCHAR) || '.ts' AS value WHERE call = 0
UNION ALL SELECT 'node', 'n' || CAST(conv_id AS VARCHAR) WHERE call = 1 UNION ALL SELECT 'file', 'lib/g' || CAST(turn AS VARCHAR) || '.py' WHERE call = 1) WHERE success""",
)
def v14(spark, d):
    return V.tool_mentions(_calls(table(spark, d, "conversations")).withColumn("message", F.concat_ws("/", "conv_id", "turn")))


def _summaries(t: DataFrame) -> DataFrame:
    """Level-1 summaries of three turns each, and a level-2 one of the first two of each long conversation."""
    k = F.floor(F.col("turn") / 3)
    one = t.groupBy("conv_id", k.alias("k")).agg(F.sum(F.length("text")).alias("chars"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    one = one.select("conv_id", F.concat_ws("-", F.lit("s"), "conv_id", "k").alias("id"), F.lit(1).alias("level"), F.array().cast("array<string>").alias("parents"), F.col("k").alias("end"), "chars", "first_turn", "last_turn")
    long = one.groupBy("conv_id").agg(F.max("end").alias("m")).where("m >= 4 and conv_id % 2 = 0")
    two = long.select("conv_id", F.concat_ws("-", F.lit("u"), "conv_id").alias("id"), F.lit(2).alias("level"), F.array(*(F.concat_ws("-", F.lit("s"), "conv_id", F.lit(i)) for i in range(2))).alias("parents"), F.lit(1).cast("long").alias("end"), F.lit(9).cast("long").alias("chars"), F.lit(None).cast("long").alias("first_turn"), F.lit(None).cast("long").alias("last_turn"))
    return one.unionByName(two)


_ONE = "(SELECT conv_id, turn // 3 AS k, sum(length(text)) AS chars, min(turn) AS a, max(turn) AS b FROM conversations GROUP BY 1, 2)"
_LEFT = f"(SELECT * FROM {_ONE} o WHERE NOT (k < 2 AND conv_id % 2 = 0 AND (SELECT max(turn // 3) FROM conversations c WHERE c.conv_id = o.conv_id) >= 4))"


@query(
    "v7_level_two_window",
    f"""WITH r AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM {_LEFT})
SELECT conv_id, count(*) AS n, string_agg('s-' || CAST(conv_id AS VARCHAR) || '-' || CAST(k AS VARCHAR), ',' ORDER BY 's-' || CAST(conv_id AS VARCHAR) || '-' || CAST(k AS VARCHAR)) AS ids FROM r WHERE run - chars < 400 GROUP BY 1 HAVING count(*) >= 2 AND max(run) >= 400""",
)
def v7(spark, d):
    return V.level_two_window(_summaries(table(spark, d, "conversations")), 400).select("conv_id", "n", joined("ids").alias("ids"))


_PAIR = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_LEVELS = f"(SELECT m.conv_id * 1000 + m.turn AS id, CAST(m.turn % 3 AS INTEGER) AS level, {_PAIR} AS score FROM conversations m JOIN embeddings e ON e.vec_id = (m.conv_id * 13 + m.turn) % 50, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def _message_vectors(spark, d) -> DataFrame:
    """Messages with stored vectors."""
    t = table(spark, d, "conversations").withColumn("vec_id", (F.col("conv_id") * 13 + F.col("turn")) % 50)
    return t.join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")


def _history(spark, d) -> DataFrame:
    q = table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]
    rows = _message_vectors(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("turn") % 3).cast("int").alias("level"), "embedding")
    return V.history_search(rows, cosine(F.col("embedding"), vector(q)), k=15, least=0.05)


_HISTORY = f"SELECT id, level, score, CAST(CASE level WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, id) AS r FROM {_LEVELS} WHERE score >= 0.05) WHERE r <= 15 ORDER BY score DESC, id LIMIT 15"


@query("v9_history_search", f"SELECT id, level, round(score, 6) AS score, confidence FROM ({_HISTORY})")
def v9(spark, d):
    return _history(spark, d).withColumn("score", F.round("score", 6))


@query(
    "v11_enriched_context",
    f"""SELECT 'queries' AS part, conv_id AS key, turn AS at FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations WHERE role = 'user') WHERE used <= 200
UNION ALL SELECT 'recent', conv_id, turn FROM (SELECT *, sum(length(text)) OVER w AS used, sum(CASE role WHEN 'user' THEN 1 ELSE 0 END) OVER w AS users FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) WHERE used <= 400 AND users <= 2
UNION ALL SELECT 'history', id, level FROM ({_HISTORY})
UNION ALL SELECT 'summaries', conv_id, k FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS r FROM {_LEFT}) WHERE r <= 2""",
)
def v11(spark, d):
    t = table(spark, d, "conversations")
    parts = V.enriched_context(t, _history(spark, d), _summaries(t), 200, 400, 2, 2)
    shaped = {"queries": ("conv_id", "turn"), "recent": ("conv_id", "turn"), "history": ("id", "level"), "summaries": ("conv_id", "end")}
    out = None
    for name, (key, at) in shaped.items():
        now = parts[name].select(F.lit(name).alias("part"), F.col(key).alias("key"), F.col(at).cast("long").alias("at"))
        out = now if out is None else out.unionByName(now)
    return out


@query(
    "v13_combine",
    """WITH x AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS file, CAST(len(string_split(split_part(text, 'thing', 1), chr(10))) AS INTEGER) AS start_line, text AS content, doc_id AS seq, 0 AS src, CAST(0.8 AS DOUBLE) AS score, CAST(0.3 AS DOUBLE) AS confidence FROM documents WHERE contains(text, 'thing')
UNION ALL SELECT 'd' || CAST(doc_id AS VARCHAR), 1, text, doc_id, 1, least(CAST(n_chars AS DOUBLE) / 1000, 1), 0.5 FROM documents WHERE lang <> 'en'), r AS (SELECT *, sum(length(content)) OVER (ORDER BY src, seq ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT file, start_line, score, confidence FROM (SELECT *, row_number() OVER (PARTITION BY file, start_line ORDER BY src, seq) AS n FROM r WHERE run <= 2000000) WHERE n = 1""",
)
def v13(spark, d):
    """Texts with a word, at the line of it, and texts of other languages, scored by length, under a budget of two million characters."""
    hits = table(spark, d, "documents").select(F.concat(F.lit("d"), s("doc_id")).alias("file"), F.col("text").alias("content"), F.col("doc_id").alias("seq"), "n_chars", "lang")
    line = F.size(F.split(F.substring_index("content", "thing", 1), "\n"))
    found = hits.where(F.contains("content", F.lit("thing"))).withColumn("start_line", line).drop("n_chars", "lang")
    near = hits.where("lang <> 'en'").withColumns({"start_line": F.lit(1), "score": F.least(F.col("n_chars") / 1000, F.lit(1.0))}).drop("n_chars", "lang")
    return V.combine(found, near, 2_000_000).select("file", "start_line", "score", "confidence")


@query(
    "v16_summary_links",
    f"""SELECT 's-' || CAST(conv_id AS VARCHAR) || '-' || CAST(k AS VARCHAR) AS src, 'file' || CAST(a AS VARCHAR) AS dst, 'MENTIONS_FILE' AS type FROM {_ONE} WHERE a IN (SELECT turn FROM conversations)
UNION SELECT 's-' || CAST(conv_id AS VARCHAR) || '-' || CAST(k AS VARCHAR), 'n' || CAST(k AS VARCHAR), 'MENTIONS_NODE' FROM {_ONE} WHERE k < 2
UNION SELECT 's-' || CAST(o.conv_id AS VARCHAR) || '-' || CAST(k AS VARCHAR), 'm' || CAST(c.conv_id AS VARCHAR) || '-' || CAST(c.turn AS VARCHAR), 'SUMMARIZES' FROM {_ONE} o JOIN conversations c ON c.conv_id = o.conv_id AND c.turn BETWEEN a AND b""",
)
def v16(spark, d):
    t = table(spark, d, "conversations")
    one = _summaries(t).where("level = 1").withColumns({"files": F.array(F.concat(F.lit("./f"), s("first_turn"), F.lit(".ts"))), "nodes": F.array(F.concat(F.lit("n"), s("end")))})
    known = t.select("turn").distinct().select(F.concat(F.lit("src/f"), s("turn"), F.lit(".ts")).alias("path"), F.concat(F.lit("file"), s("turn")).alias("id"))
    nodes = t.where("turn < 2").select(F.concat(F.lit("n"), s("turn")).alias("id")).distinct()
    return V.summary_links(one, known, nodes, t.select("conv_id", "turn", F.concat_ws("-", F.concat(F.lit("m"), s("conv_id")), "turn").alias("id")))


@query("s21_within_conversation", f"""SELECT a.conv_id, a.turn, round({_PAIR}, 6) AS score FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = 0 JOIN embeddings e ON e.vec_id = (a.conv_id * 13 + a.turn) % 50
JOIN embeddings q ON q.vec_id = (b.conv_id * 13 + b.turn) % 50 WHERE a.turn > 0 AND {_PAIR} > 0.1""")
def s21(spark, d):
    m = _message_vectors(spark, d).select("conv_id", "turn", "embedding")
    first = m.where("turn = 0").select("conv_id", F.col("embedding").alias("q"))
    return m.where("turn > 0").join(first, "conv_id").select("conv_id", "turn", cosine(F.col("embedding"), F.col("q")).alias("score")).where("score > 0.1").withColumn("score", F.round("score", 6))


# --- state and the feed ---------------------------------------------------------------------------------------------


@query(
    "i17_document_states",
    """SELECT state, count(*) AS documents, CAST(sum(r) AS BIGINT) AS retries, CAST(sum(n) AS BIGINT) AS pending_vectors FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'error' ELSE 'parsing' END
ELSE CASE o_orderstatus WHEN 'F' THEN 'embedding' WHEN 'O' THEN 'parsing' ELSE 'pending' END END AS state, CASE WHEN o_orderkey % 5 = 0 AND o_orderstatus = 'O' THEN 1 ELSE 0 END AS r,
(SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1) AS n FROM orders) GROUP BY 1""",
)
def i17(spark, d):
    o = table(spark, d, "orders")
    status = F.col("o_orderstatus")
    at = F.lit("2024-01-01").cast("timestamp")
    state = o.select(F.col("o_orderkey").alias("id"), F.when(status == "F", "embedding").when(status == "O", "parsing").otherwise("pending").alias("state"), F.lit(0).alias("retries"), at.alias("changed_at"), F.lit(None).cast("string").alias("error"))
    to = F.when(status == "F", "ready").when(status == "O", "error").otherwise("parsing")
    updates = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id"), to.alias("to"), at.alias("at"), F.lit("x").alias("message"))
    allowed = spark.createDataFrame(I.document_transitions(), "`from` string, `to` string")
    after, _ = I.transition(state, updates, allowed)
    nodes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.when(F.col("l_linenumber") > 1, F.array(F.lit(1.0))).alias("embedding"))
    return I.document_progress(after, nodes)


@query(
    "r3_apply_batch",
    """SELECT vec_id AS key, CASE WHEN vec_id % 7 = 2 THEN 'new' ELSE 'h' END AS hash, (vec_id % 7 <> 2) AS has_vector FROM embeddings WHERE vec_id % 7 <> 1 UNION ALL SELECT vec_id + 1000000, 'n', false FROM embeddings WHERE vec_id % 7 = 4""",
)
def r3(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.lit("h").alias("hash"), F.lit("p").alias("provider"), "embedding")
    none = F.lit(None).cast("array<float>")
    k = F.col("key") % 7
    batch = e.where(k.isin(1, 2, 3)).select("key", F.when(k == 1, "deleted").otherwise("updated").alias("change_type"), F.when(k == 2, "new").otherwise("h").alias("hash"), "provider", none.alias("embedding"))
    batch = batch.unionByName(e.where(k == 4).select((F.col("key") + 1_000_000).alias("key"), F.lit("created").alias("change_type"), F.lit("n").alias("hash"), "provider", none.alias("embedding")))
    return I.apply_batch(e, batch).select("key", "hash", F.col("embedding").isNotNull().alias("has_vector"))


_STATE = "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'in_progress' WHEN 'click' THEN 'pending' ELSE 'done' END"


@query(
    "r6_due",
    f"""SELECT key, state, retries FROM (SELECT user_id AS key, arg_max({_STATE}, ts) AS state, max(ts) AS seen, count(*) FILTER (event_type = 'error') AS retries FROM events GROUP BY 1) WHERE (state = 'in_progress' AND seen < TIMESTAMP '2024-01-30' - INTERVAL 5 MINUTE) OR (state = 'error' AND retries < 3)""",
)
def r6(spark, d):
    kind = F.col("event_type")
    state = F.when(kind == "error", "error").when(kind == "view", "in_progress").when(kind == "click", "pending").otherwise("done")
    return feed.due(table(spark, d, "events").select(F.col("user_id").alias("key"), state.alias("state"), "ts"), F.lit("2024-01-30").cast("timestamp"))


# --- user hooks -----------------------------------------------------------------------------------------------------


@query("x2_embed", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS v0, CAST(length(text) - length(replace(text, 'a', '')) AS DOUBLE) AS v1 FROM documents")
def x2(spark, d):
    def provider(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), float(t.count("a"))])

    out = frame.embed(table(spark, d, "documents").select("doc_id", "text"), "text", provider)
    return out.select("doc_id", F.col("embedding")[0].cast("double").alias("v0"), F.col("embedding")[1].cast("double").alias("v1"))


@query("x3_generate", "SELECT doc_id, lang, substr(text, 1, 12) || '!' AS title FROM documents")
def x3(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")

    def titles(parts):
        for p in parts:
            yield p.assign(title=p["text"].str[:12] + "!", lang="zz")[["doc_id", "title", "lang"]]

    return frame.generate(docs.select("doc_id", "text"), titles, "doc_id long, title string, lang string", docs.drop("text"), "doc_id").select("doc_id", "lang", "title")


@query("x5_summarise", "SELECT doc_id, CASE WHEN length(text) > 1500 THEN substr(text, 1, 80) || '...' END AS summary FROM documents")
def x5(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return frame.summarise(docs, "doc_id", "text", lambda t: t.str[:80] + "...", 1500).select("doc_id", "summary")


@query(
    "x7_examples",
    "SELECT 'nation' AS label, unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS field, unnest(['int', 'string', 'int']) AS type, unnest([min(CAST(n_nationkey AS VARCHAR)), min(n_name), min(CAST(n_regionkey AS VARCHAR))]) AS example FROM nation",
)
def x7(spark, d):
    return frame.examples({"nation": table(spark, d, "nation")})


# --- one call for several operators ---------------------------------------------------------------------------------


@query(
    "s9_text_page",
    """WITH h AS (SELECT doc_id AS id, length(text) - length(replace(lower(text), 'e', '')) AS n, lang, source FROM documents)
SELECT id, lang, total FROM (SELECT id, lang, row_number() OVER (ORDER BY n DESC, id) AS r, count(*) OVER () AS total FROM h WHERE lang = 'en' AND n >= 50 AND regexp_matches('s/' || source || '/x', '^s/[^/]*1[^/]*/x$')) WHERE r > 3 AND r <= 10""",
)
def s9_page(spark, d):
    docs = table(spark, d, "documents")
    hits = docs.select(F.col("doc_id").alias("id"), (F.length("text") - F.length(F.replace(F.lower("text"), F.lit("e"), F.lit("")))).cast("double").alias("score"))
    rows = docs.select(F.col("doc_id").alias("id"), "lang", F.concat(F.lit("s/"), "source", F.lit("/x")).alias("path"))
    return S.search(None, hits, rows, 7, 3, F.col("lang") == "en", "s/*1*/x", least=50).select("id", "lang", "total")


@query(
    "s17_grep_context",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE lang = 'en'), c AS (SELECT *, concat_ws(chr(10), lag(l) OVER w, l, lead(l) OVER w) AS context FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line))
SELECT doc_id, line, context FROM c WHERE regexp_matches(l, '(?i)THE') ORDER BY doc_id, line LIMIT 40""",
)
def s17_context(spark, d):
    docs = table(spark, d, "documents").withColumn("path", F.concat(F.lit("d/"), "lang", F.lit(".txt")))
    return S.grep(docs, "THE", True, glob="d/en*", context=1, most=40).select("doc_id", F.col("line").cast("long").alias("line"), "context")


@query(
    "a8_upsert_nodes",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE 'pending' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN 2023 ELSE 2024 END AS created, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 2023 ELSE 2024 END AS updated FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 1""",
)
def a8(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    then = F.lit("2023-01-01").cast("timestamp")
    old = o.where("id % 3 = 0").withColumns({"created_at": then, "updated_at": then, "state": F.lit("old")})
    return I.upsert_nodes(old, o.where("id % 2 = 1"), ["id"], F.lit("2024-01-01").cast("timestamp")).select("id", "state", F.year("created_at").alias("created"), F.year("updated_at").alias("updated"))


@query(
    "a10_edit_graph",
    """SELECT 'node' AS kind, count(*) AS n, CAST(sum(CASE WHEN c_custkey % 5 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT 'edge', count(*), CAST(sum(CASE WHEN o_orderkey % 2 = 1 AND o_custkey % 5 <> 2 THEN 0 ELSE 0 END) AS BIGINT) FROM orders WHERE o_custkey % 5 <> 0 AND o_custkey % 5 <> 2 AND o_custkey IN (SELECT c_custkey FROM customer)""",
)
def a10(spark, d):
    key = lambda t: t.select("c_custkey", graph.node_id("customer", "c_custkey").alias("id"), F.col("c_name").alias("name"))
    c = key(table(spark, d, "customer"))
    orders = graph.nodes(spark, d, ["orders"]).select("id", "name")
    e = graph.edges(spark, d, ["PLACED_BY"])
    last = F.regexp_extract("dst", r"(\d+)$", 1).cast("long") % 5
    start = c.where("c_custkey % 5 <> 4").drop("c_custkey").unionByName(orders)
    n, left = I.edit_graph(
        start, e.where(last != 4), c.where("c_custkey % 5 in (3, 4)").drop("c_custkey"), c.where("c_custkey % 5 = 1").select("id", F.lit("new").alias("name")),
        c.where("c_custkey % 5 = 0").select("id"), e.where(last == 4), e.where(last == 2),
    )
    mine = n.where(F.col("id").startswith("customer:"))
    return mine.agg(F.lit("node").alias("kind"), F.count("*").alias("n"), F.count_if(F.col("name") == "new").alias("changed")).unionByName(left.agg(F.lit("edge").alias("kind"), F.count("*").alias("n"), F.lit(0).cast("long").alias("changed")))


@query("a11_without_files", "SELECT count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size % 4 <> 0")
def a11(spark, d):
    nodes = table(spark, d, "part").select(graph.node_id("part", "p_partkey").alias("id"), (F.col("p_size") % 4).alias("file"))
    edges = table(spark, d, "lineitem").select(graph.node_id("orders", "l_orderkey").alias("src"), graph.node_id("part", "l_partkey").alias("dst"), F.lit("CONTAINS").alias("type"))
    _, left = I.without_files(nodes, edges, nodes.where("file = 0").select("file").distinct())
    return left.agg(F.count("*").alias("n"))


@query("a12_collect_garbage", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey % 3 <> 0) AND o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_orderdate) >= TIMESTAMP '1998-01-01')")
def a12(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "project_id")
    used = o.groupBy("project_id").agg(F.max("o_orderdate").alias("last_used"))
    projects = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.when(F.col("c_nationkey") % 3 != 0, F.col("c_name")).alias("owner")).join(used, "project_id")
    return I.collect_garbage(o, projects, F.lit("1998-01-01").cast("timestamp")).select("o_orderkey")


@query(
    "v1_list_filtered",
    """SELECT conv_id, n_messages FROM (SELECT conv_id, count(*) AS n_messages FROM conversations WHERE conv_id % 2 = 0 AND conv_id % 5 IN (1, 2) GROUP BY 1) ORDER BY conv_id DESC LIMIT 15""",
)
def v1(spark, d):
    m = table(spark, d, "conversations")
    c = m.groupBy("conv_id").agg(F.max("conv_id").alias("created_at")).select("conv_id", F.when(F.col("conv_id") % 2 == 0, "active").otherwise("archived").alias("status"), F.array(F.concat(F.lit("t"), s(F.col("conv_id") % 5))).alias("tags"), "created_at")
    return R.page(V.listed(c, m, "active", ["t1", "t2"]).select("conv_id", "n_messages"), [F.desc("conv_id")], 15)


@query(
    "v17_session_list",
    """SELECT user_id AS session, event_type AS domain, count(*) AS n, max(ts) AS last FROM events WHERE event_type = 'click' GROUP BY 1, 2""",
)
def v17(spark, d):
    visits = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("domain"), F.col("ts").alias("at"))
    return V.sessions(visits, "click").select("session", "domain", "n", "last")
