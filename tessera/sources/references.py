"""What files refer to: one operator over files of many kinds, one pass over each text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Which extensions are read in which way; other code files name nothing, all other files are prose.
SCRIPTS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
PYTHON = ("py", "pyw")
MARKDOWN = ("md", "mdx", "markdown")
STYLES = ("css", "scss", "sass", "less")
PAGES = ("html", "htm", "xhtml")
COMPONENTS = ("vue", "svelte")
OTHER_CODE = ("go", "rs", "rb", "php", "java", "c", "cpp", "h", "hpp", "cs")

_NONE = "cast(array() as array<string>)"
_IMPORT = r"(?<![\w$.])import(?![\w$])\s*(?:type\s+(?!from\b))?(?:(?:[\w$]+\s*,?\s*)?(?:\*\s*as\s+[\w$]+|\{[^}]*\})?\s*(?<=[\s}])from\s*)?['\"][^'\"\n]+['\"]"
_EXPORT = r"(?<![\w$.])export\s*(?:type\s+)?(?:\*(?:\s*as\s+[\w$]+)?|\{[^}]*\})\s*from\s*['\"][^'\"\n]+['\"]"
_CALL = r"import\s*\(\s*['\"][^'\"\n]+['\"]\s*\)"
# what is taken from an awaited import is told before it or after it
_DYNAMIC = rf"(?:const|let|var)\s*(?:\{{[^}}]+\}}|[\w$]+)\s*=\s*await\s+{_CALL}|\(\s*await\s+{_CALL}\s*\)\.[\w$]+|(?<![\w$.]){_CALL}"


def kind_of(source: Column, other: str) -> Column:
    """code, stylesheet, document, data or asset by the extension of a path, else ``other``."""
    kind = T.file_kind(source)
    return F.when(kind == "style", "stylesheet").when(kind == "other", other).otherwise(kind)


def _row(line: Column, source: Column, kind: Column, local: Column, symbols: Column | None = None) -> Column:
    return F.struct(line.cast("int").alias("line"), source.alias("source"), (F.expr(_NONE) if symbols is None else symbols).alias("symbols"), kind.alias("type"), local.alias("local"))


def _by_line(text: Column, row) -> Column:
    """row(line, number) of every line, put together."""
    return F.flatten(F.transform(F.split(text, r"\r?\n"), lambda s, i: row(s, i + 1)))


def script(text: Column) -> Column:
    """Static and awaited imports and re-exports. symbols are names as the module has them, ``default``, or ``*`` for all of it; an import
    for its effect has none. A statement may go over several lines and counts where it begins."""
    said = F.array_distinct(F.regexp_extract_all(text, F.lit(f"{_IMPORT}|{_EXPORT}|{_DYNAMIC}"), F.lit(0)))

    def one(s: Column) -> Column:
        source = F.regexp_extract(s, r"['\"]([^'\"]+)['\"][\s)]*(?:\.[\w$]+)?$", 1)
        inside = F.regexp_replace(F.regexp_extract(s, r"\{([^}]*)\}", 1), r"(?s)/\*.*?\*/|//[^\n]*", "")
        names = F.filter(F.transform(F.split(inside, ","), lambda x: F.regexp_replace(x, r"(?s)^\s*(?:type\s+)?|(?:\s+as\s|\s*:).*|\s+$", "")), lambda x: x != "")
        default = F.regexp_extract(s, r"^import\s+(?:type\s+(?!from\b))?([A-Za-z_$][\w$]*)\s*(?:,|\bfrom\b)", 1)
        part = F.regexp_extract(s, r"\)\.([\w$]+)$", 1)
        none, called = F.expr(_NONE), s.rlike(r"\)(?:\.[\w$]+)?$")
        static = F.concat(F.when(default != "", F.array(F.lit("default"))).otherwise(none), F.when(s.rlike(r"^(?:import|export)\b[^'\"{]*\*"), F.array(F.lit("*"))).otherwise(none), names)
        symbols = F.when(~called, static).when(part != "", F.array(part)).when(F.size(names) > 0, names).otherwise(F.array(F.lit("*")))
        return _row(T.line_of(s, text), source, F.when(F.size(symbols) == 0, kind_of(source, "code")).otherwise("code"), source.rlike(r"^[./]"), symbols)

    return F.transform(said, one)


def python(text: Column) -> Column:
    """Imports of Python sources; ``import m`` has the symbol ``*``."""
    return F.transform(T.python_imports(text), lambda i: _row(i["line"], i["module"], F.lit("code"), i["local"], F.when(F.size(i["symbols"]) == 0, F.array(F.lit("*"))).otherwise(i["symbols"])))


def markdown(text: Column) -> Column:
    """Links without their anchors, and images, that are not on another host."""

    def row(s: Column, n: Column) -> Column:
        found = F.regexp_extract_all(s, F.lit(r"!?\[[^\]]*\]\(\s*[^)\s]+[^)]*\)"), F.lit(0))
        parts = F.transform(found, lambda m: F.struct(m.startswith("!").alias("image"), F.regexp_extract(m, r"\]\(\s*([^)\s]+)", 1).alias("u")))
        inner = F.transform(F.filter(parts, lambda p: ~p["u"].rlike(r"(?i)^(?:https?://|mailto:|data:)")), lambda p: F.struct(p["image"].alias("image"), F.when(p["image"], p["u"]).otherwise(F.regexp_replace(p["u"], "#.*$", "")).alias("u")))
        return F.transform(F.filter(inner, lambda p: p["u"] != ""), lambda p: _row(n, p["u"], F.when(p["image"], "asset").otherwise(kind_of(p["u"], "document")), F.lit(True)))

    return _by_line(text, row)


def style(text: Column) -> Column:
    """@import with or without url(), and url() of other lines, that are neither on another host nor inline data."""
    here = lambda found: F.filter(found, lambda u: ~u.rlike(r"(?i)^(?:https?:|data:)"))

    def row(s: Column, n: Column) -> Column:
        sheets = here(F.regexp_extract_all(s, F.lit(r"@import\s+(?:url\s*\(\s*)?['\"]([^'\"]+)['\"]"), F.lit(1)))
        others = F.when(s.contains("@import"), F.expr(_NONE)).otherwise(here(F.regexp_extract_all(s, F.lit(r"url\s*\(\s*['\"]?([^'\")]+)['\"]?\s*\)"), F.lit(1))))
        return F.concat(F.transform(sheets, lambda u: _row(n, u, F.lit("stylesheet"), F.lit(True))), F.transform(others, lambda u: _row(n, u, kind_of(u, "asset"), F.lit(True))))

    return _by_line(text, row)


def html(text: Column) -> Column:
    """Scripts, links, images and anchors of a page that are on its own host."""
    return _by_line(text, lambda s, n: F.transform(T.html_references(s), lambda r: _row(n, r["source"], r["kind"], F.lit(True))))


def component(text: Column) -> Column:
    """The script, style and template parts of a component, each read as what it is, on the lines that they have in the file."""

    def part(name: str, read) -> Column:
        body = F.regexp_extract(text, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
        head = F.regexp_extract(text, rf"(?is)^(.*?<{name}(?:\s[^>]*)?>).*?</{name}>", 1)
        above = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
        return F.transform(read(body), lambda r: r.withField("line", (r["line"] + above).cast("int")))

    return F.concat(part("script", script), part("style", style), part("template", html))


def prose(text: Column) -> Column:
    """Web addresses (``https://`` before a bare www) and paths that a text names."""
    urls = F.transform(T.web_urls(text), lambda u: _row(T.line_of(u, text), F.when(u.startswith("www."), F.concat(F.lit("https://"), u)).otherwise(u), F.lit("url"), F.lit(False)))
    return F.concat(urls, F.transform(T.loose_paths(text), lambda p: _row(T.line_of(p["path"], text), p["path"], kind_of(p["path"], "document"), F.lit(True))))


def file_references(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """(path, line, source, symbols, type, local) of files (path, text), each (type, source) of a file once: where it comes first, what a
    file's own form says before what its prose names. Files without a text or of an unread kind of code have no rows.

    The texts are read once and aren't shuffled: only their references are, to keep one of each."""
    ext, t = T.extension(F.col(path)), F.coalesce(F.col(text), F.lit(""))
    ways = ((SCRIPTS, script(t)), (PYTHON, python(t)), (MARKDOWN, F.concat(markdown(t), prose(t))), (STYLES, style(t)), (PAGES, F.concat(html(t), prose(t))), (COMPONENTS, component(t)), (OTHER_CODE, F.lit(None)))
    found = reduce(lambda c, w: c.when(ext.isin(*w[0]), w[1]), ways[1:], F.when(ext.isin(*ways[0][0]), ways[0][1])).otherwise(prose(t))
    rows = files.select(F.col(path).alias("path"), F.posexplode(found).alias("_at", "r")).select("path", "_at", "r.*")
    first = rows.groupBy("path", "type", "source").agg(F.min_by(F.struct("line", "symbols", "local"), "_at").alias("r"))
    return first.select("path", "r.line", "source", "r.symbols", "type", "r.local")
