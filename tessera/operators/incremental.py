"""Keeping a graph current: diffs by content hash, upserts, state, change history."""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tessera.functions.text import content_hash, fixed_chunks, text_uuid


def diff(old: DataFrame, new: DataFrame, key: str, hash_col: str = "hash", dirty: Column | None = None) -> DataFrame:
    """(key, status): created, modified, unchanged or deleted, from the hashes on both sides."""
    o = old.select(key, F.col(hash_col).alias("_o"), F.lit(True).alias("_in_old"))
    n = new.select(key, F.col(hash_col).alias("_n"), F.lit(True).alias("_in_new"), (dirty if dirty is not None else F.lit(False)).alias("_d"))
    status = F.when(F.col("_in_old").isNull(), "created").when(F.col("_in_new").isNull(), "deleted").when(~F.col("_o").eqNullSafe(F.col("_n")) | F.col("_d"), "modified").otherwise("unchanged")
    return o.join(n, key, "full").select(key, status.alias("status"))


def diff_counts(statuses: DataFrame) -> DataFrame:
    return statuses.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("created", "modified", "unchanged", "deleted")))


def last_of_each(rows: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """One row a key: the greatest by the order columns, then by all others; of equal rows one."""
    rest = [c for c in rows.columns if c not in key]
    if not rest:
        return rows.distinct()
    by = [*(order or []), *(f.name for f in rows.schema if f.name not in key and not f.dataType.simpleString().startswith("map"))]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(by)))).alias("_r"))
    return best.select(*key, "_r.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Old rows with the new values laid over them; columns and values that new lacks keep the old ones.

    Of several new rows of one key the last by ``order`` counts, else the greatest by its other columns in turn."""
    new = last_of_each(new, key, order)
    rest = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in key]
    o, n = old.select(*key, *(F.col(c).alias(f"_o_{c}") for c in old.columns if c not in key)), new.select(*key, *(F.col(c).alias(f"_n_{c}") for c in new.columns if c not in key))
    pick = lambda c: F.coalesce(*(F.col(p + c) for p, cols in (("_n_", new.columns), ("_o_", old.columns)) if c in cols)).alias(c)
    return o.join(n, key, "full").select(*key, *(pick(c) for c in rest))


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, type), new ones only if both ends exist, each triple once."""
    ids = nodes.select("id")
    ok = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return old.select("src", "dst", "type").unionByName(ok.select("src", "dst", "type")).distinct()


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those ids and whatever touches them."""
    ids = gone.select("id")
    return nodes.join(ids, "id", "left_anti"), edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")


def apply_diff(nodes: DataFrame, edges: DataFrame, new: DataFrame, new_edges: DataFrame, statuses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deleted nodes go with their edges, modified ones lose their outgoing edges, then rows and edges are merged in."""
    n, e = delete_nodes(nodes, edges, statuses.where("status = 'deleted'"))
    e = e.join(statuses.where("status = 'modified'").select(F.col("id").alias("src")), "src", "left_anti")
    merged = upsert(n, new, ["id"])
    return merged, upsert_edges(e, new_edges, merged)


def carry_vectors(new: DataFrame, captured: DataFrame, key: str = "id") -> DataFrame:
    """New rows (key, provider, embedding) with the captured vector where they have none and the provider is the same."""
    c = captured.select(key, F.col("provider").alias("_p"), F.col("embedding").alias("_e"))
    return new.join(c, key, "left").withColumn("embedding", F.coalesce("embedding", F.when(F.col("provider").eqNullSafe(F.col("_p")), F.col("_e")))).drop("_p", "_e")


def needs_embedding(df: DataFrame, stored: DataFrame, text: Column, provider: str, model: str, least: int = 5) -> DataFrame:
    """Rows to embed, with the reason: no vector yet, text changed, provider or model changed. Short texts are left out."""
    h = content_hash(text)
    s = stored.select("id", F.col("hash").alias("_h"), F.col("provider").alias("_p"), F.col("model").alias("_m"))
    reason = F.when(F.col("_h").isNull(), "new").when(F.col("_h") != h, "changed").when(F.col("_p") != provider, "provider").when(F.col("_m") != model, "model")
    return df.join(s, "id", "left").where(F.length(text) >= least).withColumn("reason", reason).where("reason is not null").drop("_h", "_p", "_m")


def reuse_ids(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """The old id of the same symbol, or a new deterministic one."""
    return new.join(old.select(*keys, F.col("id").alias("_id")), keys, "left").withColumn("id", F.coalesce("_id", text_uuid(F.concat_ws(":", *keys)))).drop("_id")


def schema_fingerprint(label: str, fields: list[str]) -> Column:
    return F.substring(F.sha2(F.lit(f"{label}:{','.join(sorted(fields))}"), 256), 1, 12)


def transition(state: DataFrame, updates: DataFrame, allowed: DataFrame, enforce: bool = True) -> tuple[DataFrame, DataFrame]:
    """State rows (id, state, retries, changed_at, error) after updates (id, to, at, message), and the rejected updates.

    allowed: (from, to). retries grows on error and is 0 on pending. Several updates of one id are applied one after the other by their time
    (then by state and message), each to the state that the one before left; an update to null is none."""
    legal = [(r["from"], r["to"]) for r in allowed.distinct().collect()]  # a few pairs of states
    ok = lambda a, b: reduce(lambda x, y: x | y, ((a == f) & (b == t) for f, t in legal), F.lit(False)) if enforce else F.lit(True)
    per_id = updates.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "to", "message"))).alias("_u"))
    s, at, err = (dict((f.name, f.dataType.simpleString()) for f in state.schema)[c] for c in ("state", "changed_at", "error"))
    start = F.struct(
        F.col("state").alias("state"), F.col("retries").cast("long").alias("retries"), F.col("changed_at").alias("changed_at"), F.lit(None).cast(err).alias("error"),
        F.expr(f"cast(array() as array<struct<state:{s},to:{s}>>)").alias("rejected"),
    )

    def step(x, u):
        go = ok(x["state"], u["to"]) & u["to"].isNotNull()
        retries = F.when(go & (u["to"] == "error"), x["retries"] + 1).when(go & (u["to"] == "pending"), F.lit(0).cast("long")).otherwise(x["retries"])
        refused = F.when(go | u["to"].isNull(), x["rejected"]).otherwise(F.concat(x["rejected"], F.array(F.struct(x["state"].alias("state"), u["to"].cast(s).alias("to")))))
        return F.struct(
            F.when(go, u["to"].cast(s)).otherwise(x["state"]).alias("state"), retries.alias("retries"), F.when(go, u["at"].cast(at)).otherwise(x["changed_at"]).alias("changed_at"),
            F.when(go & (u["to"] == "error"), u["message"].cast(err)).when(~go, x["error"]).alias("error"), refused.alias("rejected"),
        )

    none = F.expr("cast(array() as array<struct<at:timestamp,to:string,message:string>>)")
    j = state.join(per_id, "id", "left").withColumn("_s", F.aggregate(F.coalesce("_u", none), start, step))
    kind = dict((f.name, f.dataType.simpleString()) for f in state.schema)["retries"]
    after = j.select("id", "_s.state", F.col("_s.retries").cast(kind).alias("retries"), "_s.changed_at", "_s.error")
    return after, j.select("id", F.inline("_s.rejected"))


def retry_errors(state: DataFrame, most: int = 3) -> DataFrame:
    return state.withColumn("state", F.when((F.col("state") == "error") & (F.col("retries") < most), "pending").otherwise(F.col("state")))


def reset_stuck(state: DataFrame, now: Column, minutes: int = 5, busy: str = "in_progress") -> DataFrame:
    return state.withColumn("state", F.when((F.col("state") == busy) & (F.col("changed_at") < now - F.expr(f"interval {minutes} minutes")), "pending").otherwise(F.col("state")))


def change_records(old: DataFrame, new: DataFrame, key: str, text: str, at: Column) -> DataFrame:
    """One record a changed row: type, hashes and the lines that a shortest edit adds and removes. Python sees the lines between the equal
    ends of rows that both sides have; where one text only gains lines at an end, that is none."""
    o, n = old.select(key, F.col(text).alias("_o")), new.select(key, F.col(text).alias("_n"))
    j = o.join(n, key, "full").where(~F.col("_o").eqNullSafe(F.col("_n")))
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1)
    # a text that another one begins or ends with, at a line end, is kept whole
    inside = lambda a, b: F.startswith(F.col(a), F.concat(b, F.lit("\n"))) | F.endswith(F.col(a), F.concat(F.lit("\n"), b))
    one_sided = F.col("_o").isNull() | F.col("_n").isNull()
    plain = F.when(one_sided, 0).when(inside("_n", "_o"), count("_o")).when(inside("_o", "_n"), count("_n"))
    j = j.withColumn("_plain", plain)
    keep = F.coalesce("_plain", kept_lines(F.when(F.col("_plain").isNull(), F.col("_o")), F.when(F.col("_plain").isNull(), F.col("_n"))))
    kind = F.when(F.col("_o").isNull(), "created").when(F.col("_n").isNull(), "deleted").otherwise("updated")
    h = content_hash(F.col("_n"))
    return j.select(F.substring(F.sha2(F.concat_ws(":", F.col(key).cast("string"), at.cast("string"), h), 256), 1, 16).alias("id"), key, kind.alias("change_type"), content_hash(F.col("_o")).alias("old_hash"), h.alias("new_hash"), (count("_n") - keep).alias("lines_added"), (count("_o") - keep).alias("lines_removed"))


@F.pandas_udf(IntegerType())
def kept_lines(old: pd.Series, new: pd.Series) -> pd.Series:
    """Lines that a shortest edit keeps of a text."""
    return pd.Series([0 if a is None or b is None else longest_common(a.split("\n"), b.split("\n")) for a, b in zip(old, new, strict=True)])


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence. Equal ends and lines of one side only go first; then, for each length, the earliest
    end in b of a common subsequence of that length is kept, and moved by the places of each line of a."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    places: dict[str, list[int]] = {}
    for j in range(len(b) - hi - 1, lo - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    for line in a[lo : len(a) - hi]:
        for j in places.get(line, ()):
            i = bisect_left(ends, j)
            ends[i : i + 1] = [j]
    return lo + hi + len(ends)


def history(changes: DataFrame, where: Column, order: list[Column], limit: int, cap: int | None = None) -> DataFrame:
    """The first ``limit`` changes in order; forms for users cap what they may ask for."""
    return changes.where(where).orderBy(*order).limit(limit if cap is None else min(limit, cap))


#: What a user may ask for at once.
USER_CAP = 50


def user_history(changes: DataFrame, entity: Column, limit: int = 20) -> DataFrame:
    """History of one entity (changes with entity, ts, id), newest first, at most ``USER_CAP`` rows."""
    return history(changes, entity, [F.desc("ts"), F.col("id")], limit, USER_CAP)


def user_recent(changes: DataFrame, types: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Recent changes, of some entity types only if named, newest first, at most ``USER_CAP`` rows."""
    return history(changes, F.lit(True) if types is None else F.col("entity_type").isin(*types), [F.desc("ts"), F.col("id")], limit, USER_CAP)


def user_statistics(changes: DataFrame, limit: int = 10) -> DataFrame:
    """(kind, name, n, added, removed, latest): counts and lines by change type and entity type, and the most modified entities, at most
    ``USER_CAP`` of them, with their latest change."""
    sums = [F.count("*").alias("n"), F.sum("lines_added").alias("added"), F.sum("lines_removed").alias("removed"), F.max("ts").alias("latest")]
    parts = [changes.groupBy(F.col(c).alias("name")).agg(*sums).select(F.lit(c).alias("kind"), "*") for c in ("change_type", "entity_type")]
    most = changes.groupBy(F.col("entity").cast("string").alias("name")).agg(*sums).orderBy(F.desc("n"), "name").limit(min(limit, USER_CAP))
    return parts[0].unionByName(parts[1]).unionByName(most.select(F.lit("entity").alias("kind"), "*"))


def user_range(changes: DataFrame, start: Column, end: Column, change_type: str | None = None, limit: int = 20) -> DataFrame:
    """Changes from start to end, both included, of one type if named, newest first, at most ``USER_CAP`` rows."""
    inside = F.col("ts").between(start, end)
    return history(changes, inside if change_type is None else inside & (F.col("change_type") == change_type), [F.desc("ts"), F.col("id")], limit, USER_CAP)


#: The way of a document through its states; from any it may fail, and from a failure or the end start again.
DOCUMENT_STATES = ("pending", "parsing", "parsed", "linking", "linked", "embedding", "ready")


def document_transitions() -> list[tuple[str, str]]:
    """(from, to): the next state, error from any but the end, pending from error and ready."""
    ahead = list(zip(DOCUMENT_STATES, DOCUMENT_STATES[1:], strict=False))
    return [*ahead, *((s, "error") for s in DOCUMENT_STATES[:-1]), ("error", "pending"), ("ready", "pending")]


def document_progress(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(state, documents, retries, pending_vectors): documents (id, state, retries) by state, with their nodes (doc, embedding) that have no vector."""
    waiting = nodes.where("embedding is null").groupBy(F.col("doc").alias("id")).agg(F.count("*").alias("n"))
    return documents.join(waiting, "id", "left").groupBy("state").agg(F.count("*").alias("documents"), F.sum("retries").alias("retries"), F.sum(F.coalesce("n", F.lit(0))).alias("pending_vectors"))


def apply_batch(rows: DataFrame, batch: DataFrame, key: str = "key") -> DataFrame:
    """Rows (key, hash, provider, embedding) after a batch (key, change_type, hash, provider, embedding): deletes first, then upserts, which
    keep the old vector if they bring none and hash and provider are the same."""
    gone = batch.where("change_type = 'deleted'").select(key)
    left = rows.join(gone, key, "left_anti")
    new = batch.where("change_type <> 'deleted'").select(key, "hash", "provider", "embedding")
    old = rows.select(key, F.col("hash").alias("_h"), F.col("provider").alias("_p"), F.col("embedding").alias("_e"))
    same = F.col("hash").eqNullSafe(F.col("_h")) & F.col("provider").eqNullSafe(F.col("_p"))
    carried = new.join(old, key, "left").select(key, "hash", "provider", F.coalesce("embedding", F.when(same, F.col("_e"))).alias("embedding"))
    return left.join(carried.select(key), key, "left_anti").select(key, "hash", "provider", "embedding").unionByName(carried)


def upsert_nodes(old: DataFrame, new: DataFrame, key: list[str], at: Column, state: str = "pending") -> DataFrame:
    """``upsert`` of nodes (key, ..., created_at, updated_at, state): rows of new get the time, and those that were not there a first state."""
    known = old.select(*key, F.lit(True).alias("_known"))
    stamped = new.join(known, key, "left").withColumns({
        "created_at": F.when(F.col("_known").isNull(), at), "updated_at": at, "state": F.when(F.col("_known").isNull(), F.lit(state)),
    })
    return upsert(old, stamped.drop("_known"), key)


def edit_graph(nodes: DataFrame, edges: DataFrame, create: DataFrame, update: DataFrame, delete: DataFrame, link: DataFrame, unlink: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, ...) and edges (src, dst, type) after one batch, in this order: deletes (id) with their edges, creates of ids that are
    not there, updates of ids that are, unlinked triples, and links whose ends exist."""
    n, e = delete_nodes(nodes, edges, delete)
    fresh = create.join(n.select("id"), "id", "left_anti")
    n = upsert(n, update.join(n.select("id"), "id", "left_semi"), ["id"]).unionByName(fresh, allowMissingColumns=True)
    e = e.select("src", "dst", "type").join(unlink.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")
    return n, upsert_edges(e, link, n)


def without_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, file: str = "file") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without what belongs to the files (file)."""
    return delete_nodes(nodes, edges, nodes.join(files.select(file), file, "left_semi").select("id"))


def collect_garbage(rows: DataFrame, projects: DataFrame, since: Column) -> DataFrame:
    """Rows (project_id, ...) whose project (project_id, owner, last_used) has an owner and was used since."""
    return rows.join(projects.where(F.col("owner").isNotNull() & (F.col("last_used") >= since)).select("project_id"), "project_id", "left_semi")


def patch(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Rows with new values in the named columns where the condition holds; the number of these is ``rows.where(where).count()``."""
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def mark_dirty(rows: DataFrame, where: Column) -> DataFrame:
    """Rows with dirty, true where the condition holds; a null condition does not."""
    return rows.withColumn("dirty", F.coalesce(where, F.lit(False)))


def stale_chunks(chunks: DataFrame, changed: DataFrame, parent: str) -> DataFrame:
    """Chunks without those of parents that are chunked again (parent)."""
    return chunks.join(changed.select(parent), parent, "left_anti")


def initialise_states(rows: DataFrame, path: str, skip: str, state: str = "state") -> DataFrame:
    """Rows without a state get one: skip where the path matches, else discovered."""
    first = F.when(F.col(path).rlike(skip), "skip").otherwise("discovered")
    return rows.withColumn(state, F.coalesce(state, first) if state in rows.columns else first)


def drop_vectors(rows: DataFrame, where: Column, columns: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """Rows with null vectors (and hashes, if named) where the condition holds."""
    return rows.withColumns({c: F.when(~F.coalesce(where, F.lit(False)), F.col(c)) for c in columns})


def needs_summary(rows: DataFrame, stored: DataFrame, text: str, least: int, key: str = "id") -> DataFrame:
    """Rows (key, text) longer than ``least`` characters whose text has another hash than that of the stored summary (key, hash)."""
    j = rows.join(stored.select(key, F.col("hash").alias("_h")), key, "left")
    return j.where((F.length(text) > least) & ~content_hash(F.col(text)).eqNullSafe(F.col("_h"))).drop("_h")


def mark_changed(rows: DataFrame, statuses: DataFrame, key: str = "id") -> DataFrame:
    """Rows with dirty true where a diff (key, status) calls them created or modified; others keep theirs, null as false."""
    changed = statuses.where("status in ('created', 'modified')").select(key).distinct().withColumn("_changed", F.lit(True))
    before = F.coalesce("dirty", F.lit(False)) if "dirty" in rows.columns else F.lit(False)
    return rows.join(changed, key, "left").withColumn("dirty", F.coalesce("_changed", before)).drop("_changed")


def dirty_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce("dirty", F.lit(False)))


def clear_dirty(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows with dirty false for the keys in done (key), whether they were dirty or not."""
    ids = done.select(key).distinct().withColumn("_done", F.lit(True))
    return rows.join(ids, key, "left").withColumn("dirty", F.col("_done").isNull() & F.coalesce("dirty", F.lit(False))).drop("_done")


def chunk_tasks(rows: DataFrame, text: str, size: int = 2000, overlap: int = 200) -> DataFrame:
    """Rows as pieces to embed: the row's other columns with chunk, text, start_line and end_line; a text up to ``size`` is one piece. Rows
    without a text give none."""
    rest = [c for c in rows.columns if c != text]
    pieces = rows.where(F.col(text).isNotNull()).select(*rest, F.explode(fixed_chunks(F.col(text), size, overlap)).alias("_c"))
    return pieces.select(*rest, F.col("_c.index").alias("chunk"), F.col("_c.text").alias("text"), "_c.start_line", "_c.end_line")


def store_summaries(rows: DataFrame, summaries: DataFrame, field: str, at: Column, key: str = "id") -> DataFrame:
    """Rows with the summaries (key, outputs...) of a field laid over them: ``{field}_summary_{output}``, arrays joined by commas, the hash of
    the field as it is now, and the time. Rows without a summary keep what they had; of two summaries of a key one is taken, as
    ``last_of_each`` says; summaries without a row are left out."""
    outputs = [f for f in summaries.schema if f.name != key]
    flat = {f.name: F.array_join(F.col(f.name), ", ") if f.dataType.typeName() == "array" else F.col(f.name) for f in outputs}
    new = last_of_each(summaries, [key]).select(key, F.lit(True).alias("_new"), *(c.alias(f"_n_{n}") for n, c in flat.items()))
    values = {f"{field}_summary_{n}": F.col(f"_n_{n}") for n in flat} | {f"{field}_summary_hash": content_hash(F.col(field)), f"{field}_summarized_at": at}
    j = rows.join(new, key, "left")
    return j.withColumns({c: F.when(F.col("_new"), v).otherwise(F.col(c) if c in rows.columns else F.lit(None)) for c, v in values.items()}).drop("_new", *(f"_n_{n}" for n in flat))


def load_summaries(rows: DataFrame, field: str, key: str = "id") -> DataFrame:
    """(key, outputs..., hash, at, current): the stored summaries of a field; current if the field's text is the one summarised."""
    p = f"{field}_summary_"
    outputs = [F.col(c).alias(c.removeprefix(p)) for c in rows.columns if c.startswith(p)]
    return rows.where(F.col(p + "hash").isNotNull()).select(key, *outputs, F.col(f"{field}_summarized_at").alias("at"), content_hash(F.col(field)).eqNullSafe(F.col(p + "hash")).alias("current"))


def delete_summaries(rows: DataFrame, gone: DataFrame, field: str, key: str = "id") -> DataFrame:
    """Rows with null in all summary columns of a field for the keys in gone (key)."""
    ids = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    mine = [c for c in rows.columns if c.startswith(f"{field}_summary_") or c == f"{field}_summarized_at"]
    return rows.join(ids, key, "left").withColumns({c: F.when(F.col("_gone").isNull(), F.col(c)) for c in mine}).drop("_gone")
