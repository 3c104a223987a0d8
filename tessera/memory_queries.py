"""Queries over conversation memory: what fits a prompt, and what becomes of turns and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.code_queries import _ONE, _calls, _summaries
from tessera.operators import conversations as V
from tessera.plans.graph import table
from tessera.registry import query, simple

_CALLS = """(SELECT conv_id, turn, call, CASE call WHEN 0 THEN 'read_file' ELSE 'search' END AS tool, (call = 0 OR turn % 4 <> 1) AS success, CASE call WHEN 0 THEN '{"path":"src/f' || turn || '.ts"}' ELSE '{"query":"x"}' END AS arguments,
CASE call WHEN 0 THEN '{}' ELSE '{"results":[{"uuid":"n' || conv_id || '","file":"lib/g' || turn || '.py"}]}' END AS result FROM conversations, (VALUES (0), (1)) v(call) WHERE role = 'assistant' AND (conv_id + turn) % 2 = 0)"""
_TURNS = f"""(WITH m AS (SELECT *, CAST(sum(CASE role WHEN 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_id FROM conversations WHERE role <> 'system'),
g AS (SELECT conv_id, turn_id, max(CASE role WHEN 'user' THEN text END) AS question, coalesce(arg_max(text, turn) FILTER (role = 'assistant' AND trim(text) <> ''), '') AS answer FROM m WHERE turn_id > 0 GROUP BY 1, 2),
c AS (SELECT conv_id, turn_id, CAST(sum(length(arguments) + length(result)) AS BIGINT) AS n, string_agg('- ' || tool || '(' || arguments || '): ' || CASE WHEN success THEN result ELSE 'Error: ' || result END, chr(10) ORDER BY turn, call) AS lines FROM {_CALLS} JOIN m USING (conv_id, turn) WHERE turn_id > 0 GROUP BY 1, 2)
SELECT conv_id, turn_id, question, answer, lines, length(question) + length(answer) + coalesce(n, 0) AS chars FROM g LEFT JOIN c USING (conv_id, turn_id) WHERE answer <> '' OR n IS NOT NULL)"""
_RECENT = f"(SELECT conv_id, turn_id, chars FROM (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn_id DESC ROWS UNBOUNDED PRECEDING) AS used FROM {_TURNS}) WHERE used <= 4000)"
_FIT = "NOT f.over AND f.used + o.chars <= 2500"
_SUMMED = f"""(WITH RECURSIVE o AS (SELECT conv_id, k, CAST(chars AS BIGINT) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS r FROM {_ONE}),
f AS (SELECT conv_id, k, r, chars, chars <= 2500 AS fits, CASE WHEN chars <= 2500 THEN chars ELSE 0 END AS used, chars > 2500 AS over FROM o WHERE r = 1
UNION ALL SELECT o.conv_id, o.k, o.r, o.chars, {_FIT}, f.used + CASE WHEN {_FIT} THEN o.chars ELSE 0 END, f.over OR (f.used + o.chars > 2500 AND 2500 - f.used > 100) FROM f JOIN o ON o.conv_id = f.conv_id AND o.r = f.r + 1) SELECT conv_id, k, chars FROM f WHERE fits)"""


@query("v8_recent_turns", f"SELECT * FROM {_RECENT}")
def v8_turns(spark, d):
    t = table(spark, d, "conversations")
    return V.recent_turns(V.turns_with_tools(t, _calls(t)), 4000).select("conv_id", "turn_id", "chars")


@query("v8_recent_summaries", f"SELECT conv_id, 's-' || conv_id || '-' || k AS id, chars FROM {_SUMMED}")
def v8_summaries(spark, d):
    return V.recent_summaries(_summaries(table(spark, d, "conversations")), 2500).select("conv_id", "id", "chars")


@query(
    "v12_context_report",
    f"""WITH p AS (SELECT conv_id, 'queries' AS part, length(text) AS chars FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations WHERE role = 'user') WHERE used <= 600
UNION ALL SELECT conv_id, 'turns', chars FROM {_RECENT} UNION ALL SELECT conv_id, 'summaries', chars FROM {_SUMMED} UNION ALL SELECT conv_id, 'history', length(text) FROM conversations WHERE contains(text, 'the'))
SELECT conv_id, part, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars, round(100 * sum(chars) / 10000) AS percent FROM p GROUP BY 1, 2 UNION ALL SELECT conv_id, 'total', count(*), CAST(sum(chars) AS BIGINT), round(100 * sum(chars) / 10000) FROM p GROUP BY 1""",
)
def v12(spark, d):
    t = table(spark, d, "conversations")
    hits = t.where(F.contains("text", F.lit("the"))).select("conv_id", F.col("turn").alias("at"), F.length("text").alias("chars"))
    return V.context_report(V.context_parts(t, _calls(t), _summaries(t), 600, 4000, 2500, hits), 10_000)


@query("v17_session_messages", f"SELECT turn, role, coalesce((SELECT string_agg(tool || ' ' || arguments, ',' ORDER BY call) FROM {_CALLS} c WHERE c.conv_id = 2 AND c.turn = m.turn), '') AS tools FROM (SELECT * FROM conversations WHERE conv_id = 2 ORDER BY turn DESC LIMIT 4) m")
def v17(spark, d):
    t = table(spark, d, "conversations")
    lines = F.array_join(F.transform("tools", lambda c: F.concat_ws(" ", c["tool"], c["arguments"])), ",")
    return V.session_messages(t, _calls(t), 2, 4).select("turn", "role", lines.alias("tools"))


@query("f21_turn_text_with_tools", f"SELECT conv_id, turn_id, concat_ws(chr(10), CASE WHEN question <> '' THEN 'User: ' || question END, CASE WHEN lines IS NOT NULL THEN 'Tools used:' || chr(10) || lines END, CASE WHEN answer <> '' THEN 'Assistant: ' || answer END) AS t FROM {_TURNS}")
def f21(spark, d):
    t = table(spark, d, "conversations")
    return V.turns_with_tools(t, _calls(t)).select("conv_id", "turn_id", V.turn_text(F.col("question"), F.col("tools"), F.col("answer")).alias("t"))


simple("a13_transcript_json", "conversations", V.transcript_json, """SELECT conv_id, CAST(to_json({'conv_id': conv_id, 'messages': list({'turn': turn, 'role': role, 'text': text} ORDER BY turn)}) AS VARCHAR) AS json FROM conversations GROUP BY conv_id""")
