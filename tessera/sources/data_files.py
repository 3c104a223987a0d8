"""Data files (JSON, YAML, XML, TOML, env) as nested sections and dotted entries."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.files import json_sections


def _env(text: str) -> dict[str, str]:
    found = re.findall(r"^[ \t]*(?:export[ \t]+)?([\w.-]+)[ \t]*=[ \t]*(.*?)[ \t\r]*$", text, re.M)
    return {k: v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v for k, v in found}


def _xml(e: ElementTree.Element) -> Any:
    """Attributes as @name, repeated children as lists, and text beside either as #text."""
    text, out = (e.text or "").strip(), {f"@{k}": v for k, v in e.attrib.items()}
    for child in e:
        name, value = re.sub(r"^\{.*\}", "", child.tag), _xml(child)
        if name not in out:
            out[name] = value
        elif isinstance(out[name], _Many):
            out[name].append(value)
        else:
            out[name] = _Many([out[name], value])
    return {**out, "#text": text} if out and text else out or text


class _Many(list):
    """The values of a repeated element, unlike one that is itself a list."""


def _scalar(text: str) -> Any:
    text = text if text[:1] in "\"'" else re.sub(r"\s+#.*$", "", text)
    if text[:1] in ("[", "{", "&", "*", "|", ">", "!", "%", "@", "`"):
        raise ValueError("not of the plain kind")
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text in ("", "~", "null"):
        return None
    return {"true": True, "false": False}.get(text, int(text) if re.fullmatch(r"-?\d{1,18}", text) else text)


def _yaml(text: str) -> Any:
    """Block mappings and lists of plain scalars; anchors, tags, flow and block scalars are refused."""
    lines = [(len(s) - len(s.lstrip(" ")), s.strip()) for s in text.splitlines() if s.strip() and not s.lstrip().startswith("#") and s.strip() != "---"]
    pair = re.compile(r"(\"[^\"]*\"|'[^']*'|[^\s\"'\[{&*!|>#-][^:#]*?|-[^\s:][^:#]*?)\s*:(?:\s+(.*))?$")
    at = 0

    def block(indent: int) -> Any:
        nonlocal at
        out: Any = [] if lines[at][1].startswith("- ") or lines[at][1] == "-" else {}
        while at < len(lines) and lines[at][0] == indent:
            rest = lines[at][1]
            if isinstance(out, list):
                if not (rest == "-" or rest.startswith("- ")):
                    raise ValueError("a list and a mapping in one block")
                item = rest[1:].strip()
                if pair.match(item):  # a mapping that begins on the dash's line
                    inner = indent + len(rest) - len(rest[1:].lstrip())
                    lines[at] = (inner, item)
                    out.append(block(inner))
                    continue
                at += 1
                out.append(_scalar(item) if item else block(lines[at][0]) if at < len(lines) and lines[at][0] > indent else None)
            else:
                m = pair.match(rest)
                if not m:
                    raise ValueError("not a mapping")
                at += 1
                value = m[2]
                deeper = at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("- ")))
                out[m[1].strip("\"'")] = _scalar(value) if value else block(lines[at][0]) if deeper else None
        if at < len(lines) and lines[at][0] > indent:
            raise ValueError("indented further than its block")
        return out

    out = block(lines[0][0]) if lines else {}
    if at < len(lines):
        raise ValueError("indented less than its block")
    return out


def as_json(path: str | None, text: str | None) -> str | None:
    """A data file's content as JSON text, by its ending; None for other endings and for what can't be read."""
    kind = (re.search(r"\.([A-Za-z]+)$", path or "") or ["", ""])[1].lower()
    if text is None or kind not in ("json", "xml", "toml", "env", "yaml", "yml"):
        return None
    try:
        if kind == "json":
            return text
        if kind == "xml":
            if "<!DOCTYPE" in text or "<!ENTITY" in text:
                return None  # entities could grow without bound
            root = ElementTree.fromstring(text)
            value = {re.sub(r"^\{.*\}", "", root.tag): _xml(root)}
        else:
            value = {"toml": tomllib.loads, "env": _env, "yaml": _yaml, "yml": _yaml}[kind](text)
        return json.dumps(value, default=str, ensure_ascii=False)
    except (ValueError, ElementTree.ParseError, RecursionError, IndexError):
        return None


def data_sections(files: DataFrame, depth: int = 10) -> DataFrame:
    """(path, section, key, depth, parent, type, value): every value of data files (path, content) down to a depth; containers are rows, too,
    with their JSON text. Sections of TOML, nested YAML and child elements of XML lie below their parents."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"file": p["path"], "body": [as_json(a, b) for a, b in zip(p["path"], p["content"], strict=True)]})

    parsed = files.select("path", "content").mapInPandas(read, "file string, body string").where("body is not null")
    return json_sections(parsed, "body", ["file"], depth).select(F.col("file").alias("path_of_file"), "path", "key", "depth", "parent", "type", "value").withColumnsRenamed({"path": "section", "path_of_file": "path"})


def data_entries(files: DataFrame, depth: int = 10) -> DataFrame:
    """(path, key, value): the single values of data files, with dotted keys from the file's top on, list places as [0], [1]."""
    found = data_sections(files, depth).where(~F.col("type").isin("OBJECT", "ARRAY"))
    return found.select("path", F.col("section").alias("key"), "value")
