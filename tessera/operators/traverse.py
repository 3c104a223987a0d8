"""Graph traversal over node and edge tables."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import file_kind
from tessera.plans.stored import stored


def directed(edges: DataFrame, direction: str = "out", kind: str | None = None) -> DataFrame:
    """(src, dst, type) in walking direction: out, in or both."""
    e = edges.where(F.col("type") == kind) if kind else edges
    e = e.select("src", "dst", "type")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return {"out": e, "in": back, "both": e.unionByName(back)}[direction]


def hop(starts: DataFrame, edges: DataFrame, nodes: DataFrame, kind: str, direction: str = "out", label: str | None = None, returns: str = "target") -> DataFrame:
    """Distinct nodes one edge away (or, with returns='start', the start nodes that have one)."""
    target = nodes.where(F.col("label") == label) if label else nodes
    walk = starts.select(F.col("id").alias("src")).distinct().join(directed(edges, direction, kind), "src").join(target.select(F.col("id").alias("dst")), "dst")
    end = walk.select(F.col("dst" if returns == "target" else "src").alias("id")).distinct()
    return nodes.join(end, "id", "left_semi")


def related_to(nodes: DataFrame, edges: DataFrame, kind: str, name: str, direction: str = "out") -> DataFrame:
    """Nodes with an edge to (or from) the node of that name."""
    target = nodes.where(F.col("name") == name).select(F.col("id").alias("dst"))
    return nodes.join(directed(edges, direction, kind).join(target, "dst", "left_semi").select(F.col("src").alias("id")), "id", "left_semi")


def expand(starts: DataFrame, edges: DataFrame, kind: str | None, depth: int, direction: str = "out", target: DataFrame | None = None, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(start, id, depth): nodes reached in 1..depth steps, each with its smallest number of steps; target restricts the reached ones.

    Beyond two levels each one is stored (or kept by ``cut``), and an empty level ends the walk."""
    cut = cut or (stored if depth > 2 else None)
    walk = directed(edges, direction, kind).select("src", "dst")
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("at"))
    seen = None
    for level in range(1, depth + 1):
        front = front.join(walk, F.col("at") == F.col("src")).select("start", F.col("dst").alias("at")).distinct()
        if seen is not None:  # what was reached before is not walked from again
            front = front.join(seen.select("start", F.col("id").alias("at")), ["start", "at"], "left_anti")
        front = cut(front) if cut else front
        if cut and seen is not None and front.isEmpty():
            break
        now = front.select("start", F.col("at").alias("id"), F.lit(level).alias("depth"))
        seen = now if seen is None else seen.unionByName(now)
    out = seen.groupBy("start", "id").agg(F.min("depth").alias("depth")).where("start <> id")
    return out.join(target.select("id"), "id", "left_semi") if target is not None else out


def reach(starts: DataFrame, edges: DataFrame, depth: int | None = None, kind: str | None = None, direction: str = "out", target: DataFrame | None = None) -> DataFrame:
    """(start, id, depth, types): nodes reached from each start, with their smallest number of steps and the sorted types of the edges that
    reach them in so many; without a depth as far as edges lead.

    One stored frontier a level, walked from once: a cycle ends where it meets what was reached, so jobs grow with the depth alone."""
    walk = directed(edges, direction, kind)
    front = stored(starts.select(F.col("id").alias("start"), "id").distinct())
    seen, level = front.withColumns({"depth": F.lit(0), "types": F.expr("cast(array() as array<string>)")}), 0
    while depth is None or level < depth:
        level += 1
        step = front.join(walk.withColumnRenamed("src", "id"), "id").groupBy("start", F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("type")).alias("types"))
        new = stored(step.join(seen.select("start", "id"), ["start", "id"], "left_anti"))
        if new.isEmpty():
            break
        front = new.select("start", "id")
        seen = seen.unionByName(new.select("start", "id", F.lit(level).alias("depth"), "types"))
    out = seen.where("depth > 0")
    return out.join(target.select("id"), "id", "left_semi").select("start", "id", "depth", "types") if target is not None else out


def enrich(df: DataFrame, edges: DataFrame, nodes: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """For each {column: edge type}, the sorted distinct names of neighbours; one aggregate an edge type, so rows don't multiply."""
    for column, kind in kinds.items():
        names = directed(edges, "out", kind).join(nodes.select(F.col("id").alias("dst"), "name"), "dst").groupBy("src").agg(F.sort_array(F.collect_set("name")).alias(column))
        df = df.join(names.withColumnRenamed("src", "id"), "id", "left")
    return df


def hierarchy(start: DataFrame, edges: DataFrame, uses: str, inherits: str, depth: int, limit: int) -> DataFrame:
    """(relation, id, depth) of dependencies, consumers, ancestors and descendants, nearest first."""
    parts = [expand(start, edges, kind, depth, way).select(F.lit(name).alias("relation"), "id", "depth") for name, kind, way in (("dependencies", uses, "out"), ("consumers", uses, "in"), ("ancestors", inherits, "out"), ("descendants", inherits, "in"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("relation", "id").agg(F.min("depth").alias("depth")).orderBy("depth", "relation", "id").limit(limit)


def neighbourhood(hits: DataFrame, edges: DataFrame, depth: int = 1, seeds: int = 10, per_node: int = 15, cut: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around the best ``seeds`` hits (id, score): per node and direction the first ``per_node`` edges by type and id.

    Beyond two levels each one is stored (or kept by ``cut``)."""
    cut = cut or (stored if depth > 2 else None)
    front = hits.orderBy(F.desc("score"), "id").limit(seeds).select("id")
    nodes, kept = front.withColumn("depth", F.lit(0)), None
    for level in range(1, depth + 1):
        found = None
        for way in ("out", "in"):
            e = front.join(directed(edges, way).withColumnRenamed("src", "id"), "id")
            rank = F.row_number().over(Window.partitionBy("id").orderBy("type", "dst"))
            e = e.withColumn("r", rank).where(F.col("r") <= per_node)
            e = e.select(*(("id", "dst") if way == "out" else (F.col("dst").alias("id"), F.col("id").alias("dst"))), "type", F.col("dst").alias("next"))
            found = e if found is None else found.unionByName(e)
        found = cut(found) if cut else found
        kept = found.drop("next") if kept is None else kept.unionByName(found.drop("next"))
        front = found.select(F.col("next").alias("id")).distinct().join(nodes, "id", "left_anti")
        nodes = nodes.unionByName(front.withColumn("depth", F.lit(level)))
    return nodes, kept.select(F.col("id").alias("src"), "dst", "type").distinct()


def explore(node: str, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(type, ids): neighbours of a node by edge type, incoming types with the suffix _BY."""
    out = edges.where(F.col("src") == node).select("type", F.col("dst").alias("id"))
    back = edges.where(F.col("dst") == node).select(F.concat("type", F.lit("_BY")).alias("type"), F.col("src").alias("id"))
    return out.unionByName(back).join(nodes.select("id"), "id", "left_semi").groupBy("type").agg(F.count_distinct("id").alias("n"), F.array_join(F.sort_array(F.collect_set("id")), ",").alias("ids"))


def explore_far(node: str, edges: DataFrame, nodes: DataFrame, depth: int = 1, most: int = 20) -> DataFrame:
    """(type, depth, n, ids): as ``explore``, up to so many steps and over the ``most`` nearest existing nodes, ties by id; each node is listed
    at its smallest number of steps under every edge type that reaches it in so many."""
    both = edges.select("src", "dst", "type").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat("type", F.lit("_BY")).alias("type")))
    start = edges.sparkSession.createDataFrame([(node,)], "id string")
    near = reach(start, both, depth, target=nodes).orderBy("depth", "id").limit(most)
    return near.select("depth", "id", F.explode("types").alias("type")).groupBy("type", "depth").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("id")), ",").alias("ids"))


#: Lines of a file that one task sweeps at a time.
BLOCK = 10_000


def innermost(points: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """For points (file, line, ...) the smallest of the ranges (file, id, start_line, end_line) that contain the line, of equal ones the first
    by start and id. Points that share ``keys`` within a file are one; nulls are in no range.

    One sweep in order of lines over starts of ranges and points, with the open ranges in a heap: rows grow with ranges plus points, not with
    their product. A file goes to tasks by blocks of lines; a range is handed to each block that it reaches into."""
    spans = ranges.where("start_line <= end_line").withColumn("_block", F.explode(F.sequence(F.expr(f"start_line div {BLOCK}"), F.expr(f"end_line div {BLOCK}"))))
    spans = spans.withColumns({"_at": F.greatest(F.col("start_line").cast("long"), F.col("_block") * BLOCK), "_point": F.lit(False)})
    asked = points.where("line is not null").dropDuplicates(["file", *keys])
    asked = asked.withColumns({"_block": F.expr(f"line div {BLOCK}"), "_at": F.col("line").cast("long"), "_point": F.lit(True)})
    mine, theirs = points.columns, [c for c in ranges.columns if c != "file"]
    both = asked.unionByName(spans, allowMissingColumns=True).select(*mine, *theirs, "_block", "_at", "_point")
    schema = both.select(*mine, *theirs).schema

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, count = None, [], itertools.count()
        for b in batches:
            rows, found, ids = b.to_pydict(), [], []
            for i in range(b.num_rows):
                here = rows["file"][i], rows["_block"][i]
                if here != place:
                    place, held = here, []
                if not rows["_point"][i]:
                    start, end, name = rows["start_line"][i], rows["end_line"][i], rows["id"][i]
                    heappush(held, (end - start, start, (name is not None, name), end, next(count), tuple(rows[c][i] for c in theirs)))
                    continue
                while held and held[0][3] < rows["line"][i]:
                    heappop(held)
                if held:
                    found.append(i)
                    ids.append(held[0][5])
            if found:
                data = {c: [rows[c][i] for i in found] for c in mine} | {c: [x[k] for x in ids] for k, c in enumerate(theirs)}
                yield pa.RecordBatch.from_pydict(data, pa.schema([b.schema.field(c) for c in (*mine, *theirs)]))

    return both.repartition("file", "_block").sortWithinPartitions("file", "_block", "_at", "_point").mapInArrow(sweep, schema)


def attribute(refs: DataFrame, scopes: DataFrame, key: str = "ref") -> DataFrame:
    """Source of a reference (ref, file, line): the innermost scope, else the file's first scope, else the file."""
    inner = innermost(refs, scopes, [key]).select(key, F.col("id").alias("inner"))
    first = scopes.groupBy("file").agg(F.min_by("id", F.struct("start_line", "id")).alias("first"))
    return refs.join(inner, key, "left").join(first, "file", "left").select(*refs.columns, F.coalesce("inner", "first", "file").alias("source"))


def resolve_pending(pending: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending edges (src, target) whose target node exists, as edges; and the rest."""
    known = nodes.select(F.col("id").alias("target"))
    return pending.join(known, "target", "left_semi"), pending.join(known, "target", "left_anti")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """For imports (file, module), the first existing candidate path: as written, .js read as .ts, with an extension, or an index file."""
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    joined = F.concat_ws("/", F.when(folder != "", folder), F.regexp_replace("module", r"^\./", ""))
    base = F.regexp_replace(joined, r"(?:^|(?<=/))[^/]+/\.\./", "")
    endings = ["", ".ts", ".tsx", ".js", ".jsx", ".py", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/__init__.py"]
    options = F.array(*(F.struct(F.lit(i + 1).alias("rank"), F.concat("base", F.lit(x)).alias("path")) for i, x in enumerate(endings)), F.struct(F.lit(0).alias("rank"), F.regexp_replace("base", r"\.js$", ".ts").alias("path")))
    # imports that mean one place are tried once; all sides may grow with the input, so none is gathered on the driver
    meant = imports.select("file", "module").distinct().withColumn("base", base)
    tried = meant.select("base").distinct().select("base", F.explode(options).alias("o")).select("base", "o.*")
    found = tried.join(files.select("path").hint("merge"), "path").groupBy("base").agg(F.min_by("path", "rank").alias("target"))
    return meant.join(found.hint("merge"), "base").select("file", "module", "target")


def scope_edges(relations: DataFrame) -> DataFrame:
    """Edges of relation rows (src, dst, kind): inverse kinds dropped, DECORATES turned round, duplicates removed."""
    kept = relations.where(~F.col("kind").rlike("_BY$"))
    turn = F.col("kind") == "DECORATES"
    return kept.select(F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"), F.when(turn, F.lit("DECORATED_BY")).otherwise(F.col("kind")).alias("type")).distinct()


def inheritance(scopes: DataFrame) -> DataFrame:
    """(child, parent) where a signature extends a scope of the same project: ``extends Name`` or a Python class header."""
    names = F.concat(F.regexp_extract_all("signature", F.lit(r"\bextends\s+(\w+)"), F.lit(1)), F.flatten(F.transform(F.regexp_extract_all("signature", F.lit(r"^class\s+\w+\s*\(([^)]*)\)"), F.lit(1)), lambda s: F.split(s, r"\s*,\s*"))))
    wanted = scopes.select("project_id", F.col("id").alias("child"), F.explode(F.array_distinct(names)).alias("name"))
    return wanted.join(scopes.select("project_id", "name", F.col("id").alias("parent")), ["project_id", "name"]).where("child <> parent").select("child", "parent").distinct()


def rollup_chunks(parents: DataFrame, chunks: DataFrame, cut: Column | None = None) -> DataFrame:
    """Parents (id, score) with the best of their chunks (parent_id, index, score): score is the larger one."""
    best = (chunks.where(cut) if cut is not None else chunks).groupBy("parent_id").agg(F.max(F.struct("score", (-F.col("index")).alias("neg"))).alias("b"))
    j = parents.join(best.withColumnRenamed("parent_id", "id"), "id", "full")
    return j.select("id", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("b.score", F.lit(0.0))).alias("score"), (-F.col("b.neg")).alias("index"))


def mentions_of(nodes: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    """Nodes (id, entity) whose entity (entity, name, aliases) has that name or alias, case ignored."""
    hit = entities.where((F.lower("name") == name.lower()) | F.array_contains(F.transform("aliases", F.lower), name.lower()))
    return nodes.join(hit.select("entity"), "entity", "left_semi")


#: Edge types by kind of target; any other kind is code.
TARGET_TYPES = {"asset": "REFERENCES_ASSET", "document": "REFERENCES_DOC", "style": "REFERENCES_STYLE", "data": "REFERENCES_DATA"}


def reference_type(path: Column) -> Column:
    """Edge type of a reference to a file, by its extension."""
    pairs = [F.lit(x) for kv in TARGET_TYPES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), file_kind(path)), F.lit("CONSUMES"))


def reference_edges(references: DataFrame, scopes: DataFrame) -> DataFrame:
    """(src, dst, type) of resolved references (src, path, symbols): to the scopes (id, file, name) of the target file that a symbol
    names, or to the file where none does."""
    refs = references.select("src", "path", F.explode_outer("symbols").alias("name"), reference_type(F.col("path")).alias("type"))
    named = refs.join(scopes.select(F.col("file").alias("path"), "name", F.col("id").alias("dst")), ["path", "name"])
    whole = references.select("src", "path").distinct().join(named.select("src", "path"), ["src", "path"], "left_anti")
    return named.select("src", "dst", "type").unionByName(whole.select("src", F.col("path").alias("dst"), reference_type(F.col("path")).alias("type"))).distinct()


def library_edges(imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of imports (scope, module, symbols, local) that are not local: libraries (id, name, symbols), and edges (src, dst, type, symbols)."""
    outer = imports.where(~F.col("local")).withColumn("dst", F.concat(F.lit("lib:"), "module"))
    pick = F.sort_array(F.array_distinct(F.flatten(F.collect_list("symbols"))))
    return outer.groupBy(F.col("dst").alias("id"), F.col("module").alias("name")).agg(pick.alias("symbols")), outer.groupBy(F.col("scope").alias("src"), "dst").agg(pick.alias("symbols")).withColumn("type", F.lit("USES_LIBRARY"))


def complete_imports(pending: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending imports (src_file, dst_file, symbols, scope) whose target file has scopes (id, file, name) by now: edges from each scope of
    the source file (or the one named) to each scope that a symbol names; and the imports whose target file is still unknown."""
    target = scopes.select(F.col("file").alias("dst_file"), "name", F.col("id").alias("dst"))
    wanted = pending.select("src_file", "dst_file", "scope", F.explode("symbols").alias("name")).join(target, ["dst_file", "name"])
    source = scopes.select(F.col("file").alias("src_file"), F.col("id").alias("src"))
    edges = wanted.join(source, "src_file").where(F.col("scope").isNull() | (F.col("scope") == F.col("src")))
    return edges.select("src", "dst", F.lit("CONSUMES").alias("type")).distinct(), pending.join(target.select("dst_file"), "dst_file", "left_anti")


def parent_scopes(scopes: DataFrame) -> DataFrame:
    """(child, parent): scopes (id, file, name, parent_name) with the scope of their file that has the parent's name."""
    parents = scopes.select("file", F.col("name").alias("parent_name"), F.col("id").alias("parent"))
    return scopes.where("parent_name is not null").select(F.col("id").alias("child"), "file", "parent_name").join(parents, ["file", "parent_name"]).where("child <> parent").select("child", "parent")
