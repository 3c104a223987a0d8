"""Filters as Columns: comparisons, operator maps, globs, regular expressions, named filters, scopes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One meaning for each operator at every stage of a query.
OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "CONTAINS": lambda c, v: c.contains(v),
    "STARTS WITH": lambda c, v: c.startswith(v),
    "ENDS WITH": lambda c, v: c.endswith(v),
    "IN": lambda c, v: c.isin(*v) if v else F.lit(False),
    "NOT IN": lambda c, v: ~c.isin(*v) if v else F.lit(True),
    "REGEX": lambda c, v: c.rlike(f"^(?:{v})$"),
    "GLOB": lambda c, v: c.rlike(glob_regex(v)),
}
_NAMES = {"equals": "=", "eq": "=", "neq": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "contains": "CONTAINS", "startsWith": "STARTS WITH", "endsWith": "ENDS WITH", "in": "IN", "notIn": "NOT IN"}


def compare(field: str, op: str, value: Any) -> Column:
    return OPERATORS[_NAMES.get(op, op)](F.col(field), value)


def all_of(conditions: Iterable[tuple[str, str, Any]]) -> Column:
    """AND of (field, operator, value)."""
    return reduce(and_, (compare(*c) for c in conditions), F.lit(True))


def where_map(spec: dict[str, Any]) -> Column:
    """AND over {field: value or {operator: value}}; a bare value means equality, null values are skipped."""
    out = []
    for field, value in spec.items():
        ops = value if isinstance(value, dict) else {"equals": value}
        out += [(field, op, v) for op, v in ops.items() if v is not None]
    return all_of(out)


def where_pattern(field: str, pattern: str, whole: bool = False) -> Column:
    return F.col(field).rlike(f"^(?:{pattern})$" if whole else pattern)


_POSIX = {"alpha": r"\p{Alpha}", "digit": r"\d", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}"}


def glob_regex(glob: str, path: bool = False, ignore_case: bool = False) -> str:
    """A glob as a regular expression for whole values. In path mode * and ? stop at /, and **/ stands for any directories."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if path and glob.startswith("**/", i):
            out += r"(?:(?!\.{1,2}/)[^/]+/)*"
            i += 3
            continue
        if path and glob.startswith("**", i):
            out += r"(?:(?!\.{1,2}(?:/|$))[^/]+(?:/|$))*"
            i += 2
            continue
        if c == "*":
            out += (r"(?!\.{1,2}(?:/|$))[^/]*" if not out or out.endswith("/") else "[^/]*") if path else "(?s:.*)"
        elif c == "?":
            out += "[^/]" if path else "(?s:.)"
        elif c == "[" and (end := _class_end(glob, i)) > 0:
            body = glob[i + 1 : end]
            no = body[:1] in ("!", "^")
            body = re.sub(r"\[:(\w+):\]", lambda m: _POSIX[m[1]], (body[1:] if no else body).replace("\\", "\\\\"))
            out += ("(?!/)" if path else "") + f"[{'^' if no else ''}{body}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"{'(?i)' if ignore_case else ''}^{out}$"


def _class_end(glob: str, at: int) -> int:
    i = at + 1 + (glob[at + 1 : at + 2] in ("!", "^"))
    i += glob[i : i + 1] == "]"
    while i < len(glob):
        if glob.startswith("[:", i) and (e := glob.find(":]", i)) > 0:
            i = e + 2
        elif glob[i] == "]":
            return i
        else:
            i += 1
    return -1


def glob_search(df: DataFrame, field: str, pattern: str, limit: int = 50) -> DataFrame:
    """Case-insensitive glob over a field, at most 50 rows in the order of the field."""
    return df.where(F.col(field).rlike(glob_regex(pattern, ignore_case=True))).orderBy(*df.columns).limit(min(limit, 50))


class Filters:
    """Named filters: register a function once, use it with parameters."""

    def __init__(self) -> None:
        self._named: dict[str, Callable[..., Column]] = {}

    def register(self, name: str, make: Callable[..., Column]) -> None:
        self._named[name] = make

    def use(self, name: str, **params: Any) -> Column:
        return self._named[name](**params)


def in_projects(df: DataFrame, projects: DataFrame, only: list[str] | None = None, key: str = "project_id") -> DataFrame:
    """Rows of the given projects; without a list, of those that projects (project_id, excluded) does not exclude."""
    if only:
        return df.where(F.col(key).isin(*only))
    return df.join(projects.where("excluded").select(F.col("project_id").alias(key)), key, "left_anti")


def of_types(df: DataFrame, types: list[str], base_path: str | None = None, kind: str = "type", path: str = "path") -> DataFrame:
    out = df.where(F.lower(kind).isin(*(t.lower() for t in types))) if types else df
    return out.where(F.col(path).startswith(base_path)) if base_path else out


def by_ids(df: DataFrame, ids: list, key: str, fields: list[str] | None = None) -> DataFrame:
    """Rows of a list of ids with chosen fields; none for an empty list."""
    out = df.where(F.col(key).isin(*ids) if ids else F.lit(False))
    return out.select(*fields) if fields else out


def with_children(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str = "children") -> DataFrame:
    """Parents with a sorted array of their children's fields."""
    grouped = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(grouped, key, "left")


def computed(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Named expressions over the columns; a stored column of that name wins. Unknown names in an expression raise an error."""
    for name, expr in fields.items():
        if name in df.columns:
            continue
        unknown = set(re.findall(r"[A-Za-z_]\w*(?!\w*\s*\()", re.sub(r"'[^']*'", "", expr))) - set(df.columns) - {"and", "or", "not", "null", "is", "case", "when", "then", "else", "end"}
        if unknown:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        df = df.withColumn(name, F.expr(expr))
    return df


def listing(df: DataFrame, text: str, drop: Iterable[str] = (), snippet: int = 200) -> DataFrame:
    """Without heavy columns, the text cut to a snippet."""
    return df.drop(*drop).withColumn(text, F.substring(text, 1, snippet))


def missing_fields(df: DataFrame, required: list[str]) -> DataFrame:
    """With an array of the required fields that are null or empty."""
    empty = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in required]
    return df.withColumn("errors", F.filter(F.array(*empty), lambda e: e.isNotNull()))
