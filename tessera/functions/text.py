"""Text, hash and URL functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(*cols: Column) -> Column:
    """SHA-256 hex; several fields are joined by NUL, nulls left out."""
    return F.sha2(cols[0] if len(cols) == 1 else F.concat_ws("\0", *cols), 256)


def short_hash(col: Column) -> Column:
    return F.substring(F.sha2(col, 256), 1, 16)


def text_uuid(col: Column) -> Column:
    """The first 32 hex digits of SHA-256, laid out 8-4-4-4-12."""
    h = F.sha2(col, 256)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def derived_key(kind: str, *parts: Column) -> Column:
    """Deterministic id of a message, summary, file, section, library or URL: UUID of kind:part:part."""
    return text_uuid(F.concat_ws(":", F.lit(kind), *(p.cast("string") for p in parts)))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length on lower-cased text; 1 if both are empty."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longest)


def normalise_url(url: Column) -> Column:
    """Without fragment and without one trailing slash."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/$", "")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def same_host(a: Column, b: Column) -> Column:
    """Whether two URLs name one host, whatever its case, port and path; false if either names none."""
    return F.coalesce((url_host(a) == url_host(b)) & (url_host(a) != ""), F.lit(False))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def normalise_tag(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), " +", "-")


def sentences(text: Column, merge_to: int = 100) -> Column:
    """Sentences, cut after . ! ? before white space and a capital, or at line ends; short ones are merged up to merge_to characters."""
    # not F.trim alone: transform would hand it the place of a part as the characters to cut off
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=\p{Lu})|\n+"), lambda s: F.trim(s)), lambda s: s != "")
    empty = F.expr("cast(array() as array<string>)")

    def step(done, s):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat_ws(" ", last, s)))
        return F.when((F.size(done) > 0) & (F.length(last) + F.length(s) < merge_to), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(parts, empty, step)


def needs_chunking(text: Column, size: int = 2000) -> Column:
    return F.length(text) > size


def chunk_count(text: Column, size: int = 2000, overlap: int = 200) -> Column:
    n = F.length(text)
    return F.when(n <= size, 1).otherwise(F.ceil((n - overlap) / F.lit(size - overlap))).cast("int")


def fixed_chunks(text: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Array of (index, text, start_char, end_char, start_line, end_line): cuts every size - overlap characters; offsets are true
    positions in code points, lines count from 1."""
    step = size - overlap
    n = chunk_count(text, size, overlap)

    breaks = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    # line breaks before each chunk: those of the steps before it, added up
    per_step = F.transform(F.sequence(F.lit(0), n - 1), lambda i: breaks(F.substring(text, i * step + 1, F.lit(step))))
    before = F.aggregate(per_step, F.array(F.lit(0)), lambda got, x: F.concat(got, F.array(F.element_at(got, -1) + x)))

    def one(i, known):
        start = i * step
        body = F.substring(text, start + 1, F.lit(size))
        line = F.get(known["before"], i) + 1
        shared = breaks(F.substring(text, start + step + 1, F.lit(overlap))) if overlap else F.lit(0)
        return F.struct(
            i.alias("index"), body.alias("text"), start.alias("start_char"), F.least(start + size, known["length"]).alias("end_char"), line.alias("start_line"),
            (F.get(known["before"], i + 1) + 1 + shared).alias("end_line"),
        )

    # what is known of the whole text is the one element of an array, so that it is computed once a text and not once a chunk
    known = F.array(F.struct(before.alias("before"), F.length(text).alias("length")))
    return F.get(F.transform(known, lambda k: F.transform(F.sequence(F.lit(0), n - 1), lambda i: one(i, k))), 0)


def chunks(text: Column, size: int = 2000, overlap: int = 200, least: int = 100, strategy: str = "fixed") -> Column:
    """Chunks of a text by strategy: ``fixed`` cuts by length; ``paragraph`` and ``sentence`` pack units up to size, the tail of one
    chunk opening the next, and a last chunk under ``least`` characters joins the one before."""
    if strategy == "fixed":
        return fixed_chunks(text, size, overlap)
    units = sentences(text) if strategy == "sentence" else F.filter(F.split(text, r"\n\s*\n"), lambda s: F.trim(s) != "")
    if strategy == "paragraph":
        units = F.flatten(F.transform(units, lambda u: F.when(F.length(u) > 1.5 * size, sentences(u)).otherwise(F.array(u))))
    joiner = " " if strategy == "sentence" else "\n\n"

    def step(done, u):
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
        fits = (F.size(done) > 0) & (F.length(last) + F.length(u) + len(joiner) <= size)
        head = F.slice(done, 1, F.size(done) - 1)
        tail = F.when(F.size(done) > 0, F.concat(F.substring(last, -overlap, overlap), F.lit(joiner), u)).otherwise(u) if overlap else u
        return F.when(fits, F.concat(head, F.array(F.concat(last, F.lit(joiner), u)))).otherwise(F.concat(done, F.array(tail)))

    packed = F.aggregate(units, F.expr("cast(array() as array<string>)"), step)
    small = (F.size(packed) > 1) & (F.length(F.try_element_at(packed, F.lit(-1))) < least)
    merged = F.concat(F.slice(packed, 1, F.size(packed) - 2), F.array(F.concat(F.try_element_at(packed, F.lit(-2)), F.lit(joiner), F.try_element_at(packed, F.lit(-1)))))
    return F.transform(F.when(small, merged).otherwise(packed), lambda t, i: F.struct(i.alias("index"), t.alias("text")))


_TRAIL = r"[.,;:!?)\]}'\"]+$"


def web_urls(text: Column) -> Column:
    """http(s) URLs and bare www hosts in a text, without trailing punctuation, first occurrence kept."""
    found = F.regexp_extract_all(text, F.lit(r"(?:https?://|www\.)[^\s<>\"']+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, _TRAIL, "")))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def headings(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"<h[1-6][^>]*>([^<]*)</h[1-6]>"), F.lit(1))


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title[^>]*>([^<]*)</title>", 1)


def plain_text(html: Column, limit: int = 50_000) -> Column:
    body = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</\1>", " ")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]+>", " "), r"\s+", " ")), 1, limit)


PREPROCESSORS = {
    "whitespace": lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")),
    "camel_case": lambda c: F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"),
    "comments": lambda c: F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/", ""), r"(?m)//.*$", ""),
}


def preprocess(text: Column, names: list[str]) -> Column:
    """Named steps in order; unknown names are skipped."""
    for name in names:
        text = PREPROCESSORS.get(name, lambda c: c)(text)
    return text


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


#: What kind of file an extension names.
KINDS = {
    "code": ("ts", "tsx", "js", "jsx", "py", "java", "go", "rs", "c", "cpp", "cs", "rb", "php", "vue", "svelte"),
    "style": ("css", "scss", "sass", "less"),
    "document": ("md", "mdx", "txt", "rst", "pdf", "docx", "html", "htm"),
    "data": ("json", "yaml", "yml", "toml", "xml", "csv", "env"),
    "asset": ("png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "mp4", "mp3", "ttf", "woff", "woff2"),
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_kind(path: Column) -> Column:
    pairs = [F.lit(x) for kind, names in KINDS.items() for n in names for x in (n, kind)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(path)), F.lit("other"))


def reference_kind(value: Column) -> Column:
    """What a string inside a data file refers to: url, directory, code, image, config, package, file, or null."""
    ext = extension(value)
    path = value.rlike(r"^(\.{1,2}/|/)") | value.rlike(r"^[\w@.-]+(/[\w@.-]+)+$")
    return (
        F.when(value.rlike("^(https?|ftp)://"), "url")
        .when(path & value.endswith("/"), "directory")
        .when(ext.isin(*KINDS["code"], *KINDS["style"]), "code")
        .when(ext.isin(*KINDS["asset"]), "image")
        .when(ext.isin(*KINDS["data"]), "config")
        .when(value.rlike(r"^@[\w-]+/[\w.-]+$"), "package")
        .when(path, "file")
    )


def python_imports(text: Column) -> Column:
    """(line, module, symbols, local) of each Python import, names in parentheses over several lines too; by line and module.

    Equal statements of one text count once."""
    rx = r"(?m)^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import[ \t]+(\([^()]*\)|[^\n(]+)|import[ \t]+([\w.]+))"

    def one(s):
        module = F.concat(F.regexp_extract(s, rx, 1), F.regexp_extract(s, rx, 3))
        names = F.filter(F.transform(F.split(F.regexp_extract(s, rx, 2), ","), lambda x: F.trim(F.regexp_replace(x, r"\s+as\s+.*|[()]|#.*|\s+", " "))), lambda x: x != "")
        return F.struct(line_of(s, text).alias("line"), module.alias("module"), names.alias("symbols"), module.startswith(".").alias("local"))

    return F.array_sort(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(rx), F.lit(0))), one))


def _before(part: Column, text: Column) -> Column:
    """What stands before the first place of a part in a text."""
    return F.call_function("substring_index", text, part, F.lit(1))


def line_of(part: Column, text: Column) -> Column:
    """Number of the line on which a part of a text first begins."""
    before = _before(part, text)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


_JS = (
    r"import\s+(?:type\s+)?(?:[\w*{}\s,$]+\s+from\s+)?['\"]([^'\"]+)['\"]",
    r"export\s+(?:type\s+)?[\w*{}\s,$]+\s+from\s+['\"]([^'\"]+)['\"]",
    r"(?:require|import)\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
)


def script_imports(text: Column) -> Column:
    """(line, module, symbols, local) of static, re-exported, required and dynamic imports of script sources, by line and module.

    symbols are names as the module has them; ``default`` and ``*`` stand for a default import and a whole module. Equal statements of one text count once."""
    found = F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(rx), F.lit(0)) for rx in _JS))))

    def one(s):
        module = F.regexp_extract(s, r"['\"]([^'\"]+)['\"]", 1)
        named = F.filter(F.transform(F.split(F.regexp_extract(s, r"\{([^}]*)\}", 1), ","), lambda x: F.trim(F.regexp_replace(x, r"\s+as\s+.*|\btype\s+", ""))), lambda x: x != "")
        head = F.regexp_extract(s, r"^import\s+(?:type\s+)?([A-Za-z_$][\w$]*)\s*(?:,|from)", 1)
        symbols = F.concat(F.when((head != "") & (head != "type"), F.array(F.lit("default"))).otherwise(F.array().cast("array<string>")), F.when(s.rlike(r"^(import|export)\s[^'\"]*\*"), F.array(F.lit("*"))).otherwise(F.array().cast("array<string>")), named)
        return F.struct(line_of(s, text).alias("line"), module.alias("module"), symbols.alias("symbols"), module.rlike(r"^[./]").alias("local"))

    return F.array_sort(F.transform(found, one))


def markdown_links(text: Column) -> Column:
    """Targets of Markdown links and images that are not external, without anchors."""
    found = F.regexp_extract_all(text, F.lit(r"\]\(([^)\s]+)[^)]*\)"), F.lit(1))
    inner = F.filter(found, lambda u: ~u.rlike(r"^(?:[a-z][a-z0-9+.-]*:|#)"))
    return F.transform(inner, lambda u: F.regexp_replace(u, "#.*$", ""))


def style_links(text: Column) -> Column:
    """Targets of @import and url() in style sheets."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"@import\s+['\"]([^'\"]+)['\"]"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"url\(\s*['\"]?([^'\")]+)['\"]?\s*\)"), F.lit(1))))


def loose_paths(text: Column) -> Column:
    """(path, confidence, context): file paths in prose, confidence 0.9 with a slash and 0.6 without, with 20 characters on each side of
    the first place. Lines that look like code (imports, declarations, ends in ; or brace) are left out."""
    code = r"(?m)^(?:\s*(?:import|export|from|const|let|var|require|def|class|function|return)\b.*|.*[;{}]\s*)$"
    text = F.regexp_replace(text, code, "")
    exts = "|".join(sorted({n for names in KINDS.values() for n in names}, key=len, reverse=True))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<![\w/.:@-])((?:[\w.@-]+/)*[\w@-][\w.@-]*\.(?:{exts}))(?![\w/-])"), F.lit(1)))
    return F.transform(found, lambda p: F.struct(p.alias("path"), F.when(p.contains("/"), 0.9).otherwise(0.6).alias("confidence"), F.concat(F.substring(_before(p, text), -20, 20), p, F.substring(F.substring(text, F.length(_before(p, text)) + F.length(p) + 1, F.lit(20)), 1, 20)).alias("context")))


def component_section(text: Column, name: str) -> Column:
    """The script, style or template part of a component file."""
    return F.regexp_extract(text, rf"(?s)<{re.escape(name)}[^>]*>(.*?)</{re.escape(name)}>", 1)


def labelled_lines(parts: dict[str, Column]) -> Column:
    """What a vector is made of: each part on a line of its own, its name in brackets before it; null parts are left out."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"[{name}] "), value) for name, value in parts.items()))


def cost(tokens: Column, price: Column) -> Column:
    """Price of some tokens, at a price for a million."""
    return tokens * price / 1_000_000


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def html_references(html: Column) -> Column:
    """Array of (source, kind) of local scripts, links, images and anchors of a page, in this order, each in page order: what is on another
    host, inline data, mail, phone and script targets are left out, and anchors lose their fragment."""
    outside = r"(?i)^(https?://|data:)"
    found = lambda tag, name: F.filter(F.regexp_extract_all(html, F.lit(rf"(?i)<{tag}\s[^>]*{name}\s*=\s*['\"]([^'\"]+)['\"]"), F.lit(1)), lambda u: ~u.rlike(outside))
    other = lambda u, kind: F.when(file_kind(u) == "style", "stylesheet").when(file_kind(u) == "other", kind).otherwise(file_kind(u))
    pages = F.filter(found("a", "href"), lambda u: ~u.rlike(r"(?i)^(mailto:|tel:|javascript:|#)"))
    parts = (
        (found("script", "src"), lambda u: F.lit("code")),
        (found("link", "href"), lambda u: other(u, "asset")),
        (found("img", "src"), lambda u: F.lit("asset")),
        (F.transform(pages, lambda u: F.regexp_replace(u, "#.*$", "")), lambda u: other(u, "document")),
    )
    named = lambda sources, kind: F.transform(sources, lambda u: F.struct(u.alias("source"), kind(u).alias("kind")))
    return F.concat(*(named(sources, kind) for sources, kind in parts))


def meta_tags(html: Column) -> Column:
    """Map of name or property to content of a page's meta tags with both; of several of one name the last counts."""
    value = lambda tag, names: F.regexp_extract(tag, rf"(?i)\s(?:{names})\s*=\s*['\"]([^'\"]*)['\"]", 1)
    tags = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<meta\s[^>]*>"), F.lit(0)), lambda t: F.struct(F.coalesce(F.nullif(value(t, "name"), F.lit("")), value(t, "property")).alias("name"), value(t, "content").alias("content")))
    told = F.filter(tags, lambda t: (t["name"] != "") & (t["content"] != ""))
    last = F.filter(told, lambda t, i: ~F.exists(F.slice(told, i + 2, F.size(told)), lambda later: later["name"] == t["name"]))
    return F.map_from_entries(last)


def outline(html: Column) -> Column:
    """Array of (level, text) of a page's headings that have a text, tags inside left out."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6](?:\s[^>]*)?>.*?</h[1-6]>"), F.lit(0))
    every = F.transform(found, lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), F.trim(F.regexp_replace(h, "<[^>]*>", "")).alias("text")))
    return F.filter(every, lambda h: h["text"] != "")


def format_field(value: Column, limit: int, most: int = 5) -> Column:
    """An array of strings as prompt text: its first ``most`` items, each cut at ``limit`` characters with dots in them, joined by commas."""
    short = lambda v: F.when(F.length(v) > limit, F.concat(F.substring(v, 1, limit - 3), F.lit("..."))).otherwise(v)
    return F.array_join(F.transform(F.slice(value, 1, most), short), ", ")
