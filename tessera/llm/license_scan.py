"""License scans: ordered signature rules with a keyword prefilter; overlapping detections are resolved by containment and priority.

DataFrame functions only: the text never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.batches import written
from tessera.llm.license_rules import AS_JSON, GATE, LEADS

_BREAK = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Breaks but for the space: most words are parted by one space alone, which needs no replacement.
_SIGN = r"\x00-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_RULE = "array<struct<label:string,priority:int,keyword:string,pattern:string,base:boolean,rule:int>>"
_OPEN, _CLOSE = "\x01", "\x02"  # not in normalised text, whose words hold no ASCII control characters
#: The only capitals outside ASCII whose lower case has an ASCII letter.
_KELVIN, _DOTTED_I, _OTHER = "\u212a", "\u0130", "\u00e9"


def _either(words: Iterable[str]) -> str:
    """A pattern of the words as they are ordered, grouped by first letter, so that few alternatives are tried at a place."""
    groups: dict[str, list[str]] = {}
    for word in words:
        groups.setdefault(word[0], []).append(word[1:])
    return "(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items()) + ")"


def gate(norm: Column) -> Column:
    """Whether a rule can match normalised text: one of a few words begins there."""
    return norm.rlike(" " + _either(GATE))


def normalised(text: Column) -> Column:
    """Words in lower case, each with a space before it, and a space at the end; a text without words is one space.

    Letters outside ASCII are lower-cased too, which no rule sees; the two whose lower case would be an ASCII letter are replaced."""
    parted = F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), f"[{_SIGN}][{_BREAK}]*", " ")
    single = F.regexp_replace(parted, " {2,}", " ")
    return F.lower(F.replace(F.replace(single, F.lit(_KELVIN), F.lit(_OTHER)), F.lit(_DOTTED_I), F.lit(_OTHER)))


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def marked(norm: Column) -> Column:
    """The rules that match normalised text: label, priority, base, rule, and the text's parts before and after each match, as numbers
    of words. Null if the gate lets none through."""
    rules = F.from_json(F.lit(AS_JSON), _RULE)

    def match(r: Column) -> Column:
        cut = F.split(F.regexp_replace(norm, r["pattern"], F.lit(_OPEN + "$0" + _CLOSE)), _OPEN)
        parts = F.transform(cut, lambda p: F.struct(_spaces(p).alias("gap"), (_spaces(F.substring_index(p, _CLOSE, 1)) + 1).alias("n")))
        return F.struct(r["label"].alias("label"), r["priority"].alias("priority"), r["base"].alias("base"), r["rule"].alias("rule"), parts.alias("parts"))

    leads = F.array_distinct(F.regexp_extract_all(norm, F.lit(f" ({_either(LEADS)})"), F.lit(1)))
    led = F.flatten(F.transform(leads, lambda w: F.filter(rules, lambda r: F.startswith(w, F.substring_index(r["keyword"], " ", 1)))))
    tried = F.transform(F.filter(F.array_distinct(led), lambda r: F.contains(norm, r["keyword"])), match)
    return F.when(gate(norm), F.filter(tried, lambda m: F.size(m["parts"]) > 1))


def detections(texts: DataFrame) -> DataFrame:
    """(key, label, priority, base, start, end) for texts (key, text): words start..end-1 of the text match a rule of that label.

    Every place of a base phrase is there. The others are those that ``resolved`` leaves."""
    norm = texts.select("key", F.explode_outer(F.array(normalised(F.col("text")))).alias("norm"))
    return resolved(norm.select("key", marked(F.col("norm")).alias("hits")))


def resolved(matched: DataFrame) -> DataFrame:
    """Detections of texts (key, hits), texts of one key being equal.

    Of detections of no base phrase, one whose interval lies in another's is suppressed (of equal intervals the one of highest
    priority stays, then of the earlier rule). Of those left that overlap one another, the ones of highest priority are taken first
    (then the earlier ones), and each later one only if it overlaps none that was taken. The work for a text is sorting its own
    detections, and comparing those of one chain of overlaps."""
    places = matched.select("key", F.explode("hits").alias("r")).select("key", "r.label", "r.priority", "r.base", "r.rule", F.posexplode("r.parts").alias("i", "p"))
    order = Window.partitionBy("key", "rule").orderBy("i")
    spans = (
        places.dropDuplicates(["key", "rule", "i"])
        .withColumn("start", F.sum("p.gap").over(order.rowsBetween(Window.unboundedPreceding, -1)) - 1)
        .where("i > 0")
        .select("key", "label", "priority", "base", "rule", "start", (F.col("start") + F.col("p.n")).alias("end"))
    )
    outer = Window.partitionBy("key", "base").orderBy("start", F.desc("end"), F.desc("priority"), "rule")
    kept = spans.withColumn("reach", F.max("end").over(outer.rowsBetween(Window.unboundedPreceding, -1))).where("base or reach is null or reach < end")
    # what is left has ascending starts and ends: where one begins at or after the last one's end, a new chain of overlaps begins
    side = Window.partitionBy("key").orderBy("start", "end", "rule")
    other = kept.where("not base").withColumn("new", F.coalesce(F.col("start") >= F.lag("end").over(side), F.lit(True)).cast("int"))
    chains = other.withColumn("chain", F.sum("new").over(side)).groupBy("key", "chain").agg(F.sort_array(F.collect_list(F.struct((-F.col("priority")).alias("low"), "start", "rule", "end", "label", "priority"))).alias("all"))
    first = F.slice("all", 1, 1)
    taken = F.aggregate(F.slice(F.col("all"), 2, F.size("all")), first, lambda got, d: F.when(F.exists(got, lambda g: (g["start"] < d["end"]) & (d["start"] < g["end"])), got).otherwise(F.concat(got, F.array(d))))
    free = chains.select("key", F.explode(F.when(F.size("all") > 1, taken).otherwise(F.col("all"))).alias("d")).select("key", "d.label", "d.priority", F.lit(False).alias("base"), "d.start", "d.end")
    return kept.where("base").select("key", "label", "priority", "base", "start", "end").unionByName(free)


def license_scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per input row.

    n_base counts the places of base phrases; first_word and last_word are the smallest and largest word number at which one
    starts (null without any); labels lists the surviving labels and the base ones; score is the highest priority of a surviving
    detection over 100 (a base place alone gives 0.5), 0 without any. Each text is read once, and its rules
    matched there; what is shuffled are places of matches, those of equal texts once. A null text counts as empty: no words, empty label lists, score 0. Null and repeated ids are passed on.
    """
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # the outer explode of one element is not moved or repeated by the optimizer: each text is normalised once
    norm = source.select("doc_id", F.explode_outer(F.array(normalised(F.col("text")))).alias("norm"))
    hits = norm.select("doc_id", (_spaces(F.col("norm")) - 1).cast("long").alias("n_words"), marked(F.col("norm")).alias("hits"), F.md5("norm").alias("key"))
    rows = written(hits.withColumn("key", F.when(F.size("hits") > 0, F.col("key"))))
    found = (
        resolved(rows.where("key is not null").select("key", "hits"))
        .groupBy("key")
        .agg(
            F.count_if("base").alias("n_base"),
            F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
            F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max(F.when(F.col("base"), 0.5).otherwise(F.col("priority") / 100.0)).alias("score"),
        )
    )
    # texts without a match have keys that match nothing and are dealt evenly
    base = rows.select("doc_id", "n_words", F.coalesce("key", F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string"))).alias("key"))
    return base.join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
