"""Conversation memory: turns, budgets, summary windows, retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.packing import budget_skip
from tessera.operators.running import running


def turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn_id, question, answer, n_messages) of messages (conv_id, turn, role, text).

    A turn is a user message with all that follows until the next; the last non-blank assistant text is the answer; turns
    without one are dropped, system messages skipped."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    m = messages.where("role <> 'system'").withColumn("turn_id", F.sum((F.col("role") == "user").cast("int")).over(w)).where("turn_id > 0")
    said = (F.col("role") == "assistant") & (F.trim("text") != "")
    out = m.groupBy("conv_id", "turn_id").agg(F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("question"), F.max_by("text", F.when(said, F.col("turn"))).alias("answer"), F.count_if(said).alias("n_said"), F.count("*").alias("n_messages"))
    return out.where("n_said > 0").drop("n_said")


def counters(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.sum(F.length("text")).alias("n_chars"))


def transcript(messages: DataFrame) -> DataFrame:
    """(conv_id, text): role and text of each message in order."""
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n\n").alias("text"))


def effective_size(text: Column, tools: Column) -> Column:
    """Characters of a message with the names, arguments and results of its tool calls."""
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    return n(text) + F.aggregate(F.coalesce(tools, F.expr("cast(array() as array<struct<name:string,arguments:string,result:string>>)")), F.lit(0), lambda s, t: s + n(t["name"]) + n(t["arguments"]) + n(t["result"]))


def summary_window(messages: DataFrame, done: Column, threshold: int) -> DataFrame:
    """(conv_id, first_turn, last_turn, chars): messages past the summarised turn until the threshold is reached; none if it isn't."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    m = messages.where(F.col("turn") > done).withColumn("run", F.sum(F.length("text")).over(w))
    before = F.col("run") - F.length("text")
    return m.where(before < threshold).groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.max("run").alias("chars")).where(F.col("chars") >= threshold)


def level_two_window(summaries: DataFrame, threshold: int) -> DataFrame:
    """Level-1 summaries (conv_id, id, level, parents, end, chars) no level-2 one names, two at least, until the threshold."""
    used = summaries.where("level = 2").select(F.explode("parents").alias("id"))
    w = Window.partitionBy("conv_id").orderBy("end").rowsBetween(Window.unboundedPreceding, 0)
    left = summaries.where("level = 1").join(used, "id", "left_anti").withColumn("run", F.sum("chars").over(w))
    return left.where(F.col("run") - F.col("chars") < threshold).groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"), F.max("end").alias("end"), F.max("run").alias("chars")).where((F.col("n") >= 2) & (F.col("chars") >= threshold))


def recall(hits: DataFrame, now: Column, boosts: dict[int, float], decay_days: float, least: float) -> DataFrame:
    """Summary hits (level, score, at) above ``least``, boosted by level and fading with age: x (0.5 + 0.5 e^(-age / decay))."""
    boost = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in boosts.items() for x in kv)), F.col("level")), F.lit(1.0))
    age = (F.unix_timestamp(now) - F.unix_timestamp("at")) / 86400.0
    return hits.where(F.col("score") > least).withColumn("score", F.col("score") * boost * (0.5 + 0.5 * F.exp(-age / decay_days)))


def recent(messages: DataFrame, chars: int, most_turns: int) -> DataFrame:
    """The newest messages within both limits, of characters and of user turns; the first overflow ends the list."""
    m = running(messages, ["conv_id"], [F.desc("turn")], {"used": F.length("text").cast("long"), "users": (F.col("role") == "user").cast("long")})
    return m.where((F.col("used") <= chars) & (F.col("users") <= most_turns)).drop("used", "users")


def combine(regex_hits: DataFrame, semantic_hits: DataFrame, budget: int) -> DataFrame:
    """Both hit lists (file, start_line, content, score, seq) under one budget in order of arrival, one a (file, start line), best first."""
    both = regex_hits.withColumns({"source": F.lit(0), "score": F.lit(0.8), "confidence": F.lit(0.3)}).unionByName(semantic_hits.withColumns({"source": F.lit(1), "confidence": F.lit(0.5)}))
    fits = running(both, [], [F.col("source"), F.col("seq")], {"run": F.length("content").cast("long")}).where(F.col("run") <= budget).drop("run")
    rest = [c for c in fits.columns if c not in ("file", "start_line")]
    first = fits.groupBy("file", "start_line").agg(F.min_by(F.struct(*rest), F.struct("source", "seq")).alias("r"))
    return first.select("file", "start_line", "r.*").select(*fits.columns).orderBy(F.desc("score"), "file", "start_line")


def tool_mentions(calls: DataFrame) -> DataFrame:
    """(message, kind, value): paths and node ids in the JSON arguments and results of successful calls, each once."""
    ok = calls.where("success")
    path = F.coalesce(F.get_json_object("arguments", "$.path"), F.get_json_object("arguments", "$.file_path"))
    paths = ok.select("message", F.lit("file").alias("kind"), path.alias("value"))
    found = F.from_json(F.get_json_object("result", "$.results"), "array<struct<uuid:string,file:string>>")
    rows = ok.select("message", F.explode(found).alias("r"))
    return paths.unionByName(rows.select("message", F.lit("node").alias("kind"), F.col("r.uuid").alias("value"))).unionByName(rows.select("message", F.lit("file").alias("kind"), F.col("r.file").alias("value"))).where("value is not null").distinct()


def messages_with_tools(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, ...) with tools, their calls (conv_id, turn, call, tool, arguments, result, success) in order; an empty
    list without any."""
    rest = [c for c in calls.columns if c not in ("conv_id", "turn")]
    listed = calls.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("call", *(c for c in rest if c != "call")))).alias("tools"))
    return messages.join(listed, ["conv_id", "turn"], "left").withColumn("tools", F.coalesce("tools", F.array().cast(listed.schema["tools"].dataType)))


def turns_with_tools(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """(conv_id, turn_id, question, answer, tools): turns as in ``turns``, with the calls of all their assistant messages in order; a turn
    with calls and no text stays, its answer empty."""
    more = [c for c in calls.columns if c not in ("conv_id", "turn", "call", "tool", "success")]
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    m = messages.where("role <> 'system'").withColumn("turn_id", F.sum((F.col("role") == "user").cast("int")).over(w)).where("turn_id > 0")
    said = (F.col("role") == "assistant") & (F.trim("text") != "")
    full = messages_with_tools(m, calls).withColumn("tools", F.when(F.col("role") == "assistant", F.transform("tools", lambda c: F.struct(F.col("turn").alias("turn"), c["call"].alias("call"), c["tool"].alias("tool"), c["success"].alias("success"), *(c[m].alias(m) for m in more)))))
    g = full.groupBy("conv_id", "turn_id").agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("question"),
        F.coalesce(F.max_by("text", F.when(said, F.col("turn"))), F.lit("")).alias("last"),
        F.count_if(said).alias("n_said"),
        F.sort_array(F.flatten(F.collect_list("tools"))).alias("tools"),
    )
    return g.where((F.col("n_said") > 0) | (F.size("tools") > 0)).select("conv_id", "turn_id", "question", F.when(F.col("n_said") > 0, F.col("last")).otherwise("").alias("answer"), "tools")


#: How far a hit in messages, in summaries of them, and in summaries of summaries is trusted.
LEVEL_CONFIDENCE = {0: 1.0, 1: 0.7, 2: 0.5}


def history_search(rows: DataFrame, score: Column, levels: tuple[int, ...] = (0, 1, 2), k: int = 10, least: float = 0.3) -> DataFrame:
    """(id, level, score, confidence): of rows (id, level, ...) the k best of each level from ``least`` up, and of these the k best."""
    scored = rows.where(F.col("level").isin(*levels)).select("id", "level", score.alias("score")).where(F.col("score") >= least)
    first = scored.withColumn("r", F.row_number().over(Window.partitionBy("level").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k)
    sure = F.create_map(*(F.lit(x) for kv in LEVEL_CONFIDENCE.items() for x in kv))
    return first.select("id", "level", "score", F.element_at(sure, F.col("level")).alias("confidence")).orderBy(F.desc("score"), "id").limit(k)


def enriched_context(messages: DataFrame, history: DataFrame, summaries: DataFrame, query_chars: int, recent_chars: int, most_turns: int, most_summaries: int) -> dict[str, DataFrame]:
    """The parts of a prompt's context for each conversation: last user queries, recent messages, history hits, and level-1 summaries
    that no level-2 one names, the newest first."""
    used = summaries.where("level = 2").select(F.explode("parents").alias("id"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("end"), "id")
    newest = summaries.where("level = 1").join(used, "id", "left_anti").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most_summaries).drop("r")
    run = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    queries = messages.where("role = 'user'").withColumn("used", run).where(F.col("used") <= query_chars).drop("used")
    return {"queries": queries, "recent": recent(messages, recent_chars, most_turns), "history": history, "summaries": newest}


def recent_turns(turns: DataFrame, budget: int) -> DataFrame:
    """The newest turns (conv_id, turn_id, question, answer, tools) of each conversation, with chars, their characters with those of
    arguments and results, as long as all fit; the first that doesn't ends the list. A null text counts 0."""
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    chars = n(F.col("question")) + n(F.col("answer")) + F.aggregate("tools", F.lit(0), lambda x, t: x + n(t["arguments"]) + n(t["result"]))
    sized = turns.withColumn("chars", chars.cast("long"))
    return running(sized, ["conv_id"], [F.desc("turn_id")], {"used": F.col("chars")}).where(F.col("used") <= budget).drop("used")


def recent_summaries(summaries: DataFrame, budget: int, gap: int = 100) -> DataFrame:
    """The newest level-1 summaries (conv_id, id, level, end, chars) within the budget. One that doesn't fit is passed over while at most
    ``gap`` characters remain, and else ends the list."""
    first = summaries.where("level = 1").withColumn("_newest", -F.col("end"))
    kept = budget_skip(first, "conv_id", ["_newest", "id"], "id", "chars", budget, gap)
    return first.drop("_newest").join(kept, ["conv_id", "id"], "left_semi")


def context_parts(messages: DataFrame, calls: DataFrame, summaries: DataFrame, query_chars: int, turn_chars: int, summary_chars: int, history: DataFrame | None = None) -> DataFrame:
    """(conv_id, part, at, chars): what a prompt's context holds of each conversation: the last user queries, recent turns with their calls,
    and recent level-1 summaries, each within its budget, and hits of a search (conv_id, at, chars) if given."""
    length = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    asked = running(messages.where("role = 'user'"), ["conv_id"], [F.desc("turn")], {"used": length}).where(F.col("used") <= query_chars)
    parts = {
        "queries": asked.select("conv_id", F.col("turn").alias("at"), length.alias("chars")),
        "turns": recent_turns(turns_with_tools(messages, calls), turn_chars).select("conv_id", F.col("turn_id").alias("at"), "chars"),
        "summaries": recent_summaries(summaries, summary_chars).select("conv_id", F.col("end").alias("at"), "chars"),
    }
    if history is not None:
        parts["history"] = history.select("conv_id", "at", "chars")
    named = [p.select("conv_id", F.lit(name).alias("part"), F.col("at").cast("long").alias("at"), F.col("chars").cast("long").alias("chars")) for name, p in parts.items()]
    return reduce(DataFrame.unionByName, named)


def context_report(parts: DataFrame, limit: int) -> DataFrame:
    """(conv_id, part, n, chars, percent): what each part of a context takes of the limit, and a row ``total`` for each conversation."""
    sums = parts.groupingSets([["conv_id", "part"], ["conv_id"]], "conv_id", "part").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    return sums.select("conv_id", F.coalesce("part", F.lit("total")).alias("part"), "n", "chars", F.round(100 * F.col("chars") / limit).alias("percent"))


def turn_text(question: Column, tools: Column, answer: Column, reasoning: Column | None = None, cut: int = 200) -> Column:
    """What a turn's vector is made of: the question, a line for each call with the first ``cut`` characters of its arguments and of its
    result or error, the answer and the reasoning. What is null or empty is left out; a call without a verdict succeeded."""
    dots = lambda c: F.concat(c, F.when(F.length(c) >= cut, "...").otherwise(""))
    said = lambda label, c: F.when(c != "", F.concat(F.lit(f"{label}: "), c))

    def line(t):
        given, got = F.substring(F.coalesce(t["arguments"], F.lit("")), 1, cut), F.substring(F.coalesce(t["result"], F.lit("")), 1, cut)
        got = F.when(F.coalesce(t["success"], F.lit(True)), got).otherwise(F.concat(F.lit("Error: "), got))
        return F.concat(F.lit("- "), F.coalesce(t["tool"], F.lit("unknown")), F.when(given != "", F.concat(F.lit("("), dots(given), F.lit(")"))).otherwise(""), F.lit(": "), dots(got))

    used = F.when(F.size(tools) > 0, F.concat_ws("\n", F.lit("Tools used:"), F.transform(tools, line)))
    return F.concat_ws("\n", said("User", question), used, said("Assistant", answer), *([] if reasoning is None else [said("Reasoning", reasoning)]))


def session_messages(messages: DataFrame, calls: DataFrame, session: int, limit: int) -> DataFrame:
    """The newest messages of a session (conv_id), at most ``limit``, with their calls; the oldest of them first."""
    newest = messages.where(F.col("conv_id") == session).orderBy(F.desc("turn")).limit(limit)
    return messages_with_tools(newest, calls.where(F.col("conv_id") == session)).orderBy("turn")


def transcript_json(messages: DataFrame) -> DataFrame:
    """(conv_id, json): one JSON object a conversation, its messages (turn, role, text) in order; null fields are left out."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return messages.groupBy("conv_id").agg(rows.alias("messages")).select("conv_id", F.to_json(F.struct("conv_id", "messages")).alias("json"))


def summary_links(summaries: DataFrame, files: DataFrame, nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """(src, dst, type) of summaries (id, conv_id, first_turn, last_turn, files, nodes): to the file of that path or, with the smallest
    path, of a path that ends in it; to existing nodes; to the messages (id, conv_id, turn) in range."""
    tails = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.call_function("substring_index", F.col("path"), F.lit("/"), -i))
    known = files.select("path", F.col("id").alias("dst"), F.explode(tails).alias("tail"))
    wanted = summaries.select("id", F.explode("files").alias("f")).withColumn("tail", F.regexp_replace("f", r"^(\./|/)", ""))
    hit = wanted.join(known, "tail").groupBy("id", "f").agg(F.min_by("dst", F.struct(F.length("path"), "path")).alias("dst"))
    to_nodes = summaries.select("id", F.explode("nodes").alias("dst")).join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    inside = messages.select("conv_id", "turn", F.col("id").alias("dst")).join(summaries.select("id", "conv_id", "first_turn", "last_turn"), "conv_id")
    to_messages = inside.where(F.col("turn").between(F.col("first_turn"), F.col("last_turn")))
    parts = ((hit, "MENTIONS_FILE"), (to_nodes, "MENTIONS_NODE"), (to_messages, "SUMMARIZES"))
    out = [p.select(F.col("id").alias("src"), "dst", F.lit(t).alias("type")).distinct() for p, t in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def listed(conversations: DataFrame, messages: DataFrame, status: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Conversations (conv_id, status, tags, created_at) of a status with any of the tags, with counters, the newest first."""
    some = conversations if status is None else conversations.where(F.col("status") == status)
    some = some if tags is None else some.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return some.join(counters(messages), "conv_id", "left").orderBy(F.desc("created_at"), "conv_id")


def sessions(visits: DataFrame, domain: str | None = None) -> DataFrame:
    """(session, domain, n, first, last) of visits (session, domain, at), of one domain or all, the newest first."""
    some = visits if domain is None else visits.where(F.col("domain") == domain)
    return some.groupBy("session", "domain").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last")).orderBy(F.desc("last"), "session", "domain")


def turn_texts(messages: DataFrame, cut: int = 200) -> DataFrame:
    """(conv_id, t): what a conversation's vector is made of: role and first ``cut`` characters of each message but the system's, in order."""
    line = F.struct("turn", F.concat(F.initcap("role"), F.lit(": "), F.substring("text", 1, cut)).alias("s"))
    own = messages.where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return own.select("conv_id", F.array_join(F.transform("lines", lambda r: r["s"]), "\n").alias("t"))


def chars_by(messages: DataFrame, *by: str) -> DataFrame:
    return messages.groupBy(*by).agg(F.sum(F.length("text")).alias("chars"))


def budget_report(messages: DataFrame, by: str, budget: int) -> DataFrame:
    """(by, chars, percent): characters and their share of the budget."""
    return chars_by(messages, by).withColumn("percent", 100 * F.col("chars") / budget)
