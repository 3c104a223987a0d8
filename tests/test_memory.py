"""Parts of a conversation's context, at their edges."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.operators import conversations as V

CALLS = "conv_id long, turn long, call int, tool string, arguments string, result string, success boolean"


def test_turn_text(spark):
    rows = [("q", [("grep", "x" * 200, "r" * 199, True), (None, None, "no such file", False), ("ls", "", "", None)], "a"), (None, [], ""), ("", None, "only")]
    df = spark.createDataFrame(rows, "q string, tools array<struct<tool:string,arguments:string,result:string,success:boolean>>, a string")
    got = [r.t for r in df.select(V.turn_text(F.col("q"), F.col("tools"), F.col("a"), F.lit("since")).alias("t")).collect()]
    assert got[0].split("\n") == ["User: q", "Tools used:", f"- grep({'x' * 200}...): {'r' * 199}", "- unknown: Error: no such file", "- ls: ", "Assistant: a", "Reasoning: since"]
    assert got[1:] == ["Reasoning: since", "Assistant: only\nReasoning: since"]


def test_recent_turns_and_summaries(spark):
    turns = spark.createDataFrame([(1, i, "q" * 10, "a" * (40 if i == 2 else 10), [("t", "x" * 5, None)] if i == 4 else []) for i in range(1, 6)], "conv_id long, turn_id long, question string, answer string, tools array<struct<tool:string,arguments:string,result:string>>")
    # newest first: 20, 25, 20, then 50 that don't fit, which ends the list
    assert sorted((r.turn_id, r.chars) for r in V.recent_turns(turns, 100).collect()) == [(3, 20), (4, 25), (5, 20)]
    s = spark.createDataFrame([(1, "a", 1, 1, 60), (1, "b", 1, 2, 90), (1, "c", 1, 3, 850), (1, "x", 2, 9, 1), (2, "d", 1, 1, 2000), (2, "e", 1, 0, 1)], "conv_id long, id string, level int, end long, chars long")
    # 850 leaves 150: 90 fits, 60 fits exactly; where 1000 remain, 2000 end the list
    assert sorted(r.id for r in V.recent_summaries(s, 1000).collect()) == ["a", "b", "c"]
    # 850 leaves 50: both others are passed over and none ends it
    assert sorted(r.id for r in V.recent_summaries(s, 900).collect()) == ["c"]


def test_report_and_empty_tables(spark):
    messages = spark.createDataFrame([(1, 0, "user", "abc"), (1, 1, "assistant", None), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    calls = spark.createDataFrame([(1, 1, 0, "ls", "{}", "ok", True)], CALLS)
    none = spark.createDataFrame([], "conv_id long, id string, level int, parents array<string>, end long, chars long")
    parts = V.context_parts(messages, calls, none, 100, 100, 100)
    got = {(r.conv_id, r.part): (r.n, r.chars, r.percent) for r in V.context_report(parts, 10).collect()}
    assert got == {(1, "queries"): (1, 3, 30.0), (1, "turns"): (1, 7, 70.0), (1, "total"): (2, 10, 100.0), (2, "queries"): (1, 0, 0.0), (2, "total"): (1, 0, 0.0)}
    assert V.context_report(V.context_parts(messages.limit(0), calls.limit(0), none, 1, 1, 1), 10).count() == 0
    # of one session, the oldest of the newest first
    assert [(r.turn, len(r.tools)) for r in V.session_messages(messages, calls, 1, 1).collect()] == [(1, 1)]
    assert [json.loads(r.json)["messages"] for r in V.transcript_json(messages).orderBy("conv_id").collect()] == [[{"turn": 0, "role": "user", "text": "abc"}, {"turn": 1, "role": "assistant"}], [{"turn": 0, "role": "user"}]]
