"""The main text of web pages by composite text density.

Every page becomes a tree of elements. A node's density is its characters per tag, adjusted by how much of both belongs to links; a
node's density sum adds the densities of its children, runs of plain text among them. The subtree of the highest sum is the article; the
lowest density on its path to the body is the threshold by which further subtrees count as its parts. Elements whose meaning is stated
(nav, footer, form, a class such as ``cookie-banner``) are not of the article whatever their density.

Trees of a batch of pages are arrays in page order, where a subtree is a range: densities of all nodes come from running sums.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.batches import map_texts

# Elements of HTML by what they do to the text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSE_P = BLOCKS - frozenset("body caption head html legend option tbody td tfoot th thead tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
NEVER = frozenset("aside button dialog footer form head nav select svg object canvas audio video menu".split()) | RAW
#: An element that one of the second set closes, unless one of the third set was opened since.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}), "a": ({"a"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
FENCES = ("table", "td", "th", "caption", "button")
#: Words in class, id or role that name something beside the article.
ASIDE = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist contentinfo complementary consent cookie cookies disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget".split()
)
ABOUT = re.compile(r"(?:\d+ +)?(?:reader )?(?:comments?|replies|responses|kommentare|commentaires|comentarios|leave a (?:comment|reply))\b.{0,12}$", re.I | re.S)

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*+(?:\"[^\"]*\"|'[^']*')?|[\"'])*+)(?:>|\Z)", re.S)
_HINT = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


def _stated_aside(attributes: str) -> bool:
    """Whether class, id, role or style say that an element is not shown or not of the article."""
    for name, value in _HINT.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name in ("class", "id", "role") and any(w.lower() in ASIDE for w in _WORD.findall(value)):
            return True
    return False


class Page:
    """Elements and runs of text of one page in page order; ``items`` are (node, text), with text None where a block begins or ends."""

    def __init__(self, html: str):
        self.name, self.parent, self.end, self.aside = ["#page"], [-1], [0], [False]
        self.items: list[tuple[int, str | None]] = []
        self.stack, self.open = [0], {}
        at = 0
        while m := _TOKEN.search(html, at):
            self._text(html[at : m.start()])
            at = m.end()
            if name := m[2]:
                name = name.lower()
                if m[1]:
                    self._close(name)
                else:
                    self._begin(name, m[3])
                    if name in RAW:
                        stop = _ENDS[name].search(html, at)
                        at = stop.start() if stop else len(html)
        self._text(html[at:])
        self._pop(0)

    def _node(self, name: str, aside: bool) -> int:
        self.name.append(name)
        self.parent.append(self.stack[-1])
        self.aside.append(aside)
        self.end.append(len(self.name))
        return len(self.name) - 1

    def _text(self, raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            self.items.append((self._node("#text", False) if not text.isspace() else self.stack[-1], text))

    def _last(self, names) -> int:
        return max((places[-1] for n in names if (places := self.open.get(n))), default=-1)

    def _pop(self, depth: int) -> None:
        """Close all open elements from this place of the stack on."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.end[node] = len(self.name)
            if self.name[node] in BLOCKS:
                self.items.append((node, None))
            if node:
                self.open[self.name[node]].pop()

    def _begin(self, name: str, attributes: str) -> None:
        if name == "br":
            self.items.append((self.stack[-1], " "))
        if name in ("html", "body") and self.open.get(name):
            return
        if name in CLOSE_P and (p := self._last(("p",))) > self._last(FENCES):
            self._pop(p)
        if name in IMPLIED:
            closes, fence = IMPLIED[name]
            wall = self._last(fence)
            if (low := min((x for n in closes for x in self.open.get(n, ())[-1:] if x > wall), default=0)) > 0:
                self._pop(low)
        node = self._node(name, name in NEVER or "=" in attributes and _stated_aside(attributes) or " hidden" in attributes)
        if name in BLOCKS:
            self.items.append((node, None))
        if name not in VOID:
            self.open.setdefault(name, []).append(len(self.stack))
            self.stack.append(node)

    def _close(self, name: str) -> None:
        if name == "br":
            self.items.append((self.stack[-1], " "))
        place = self.open.get(name, ())
        # an inline end tag closes no block, and none closes the cell around it
        if place and name not in ("body", "html") and place[-1] > (self._last(FENCES) if name not in FENCES and name not in ("tr", "tbody", "thead", "tfoot") else -1):
            if name in BLOCKS or name in RAW or not any(self.name[x] in BLOCKS for x in self.stack[place[-1] + 1 :]):
                self._pop(place[-1])


def _left_out(p: Page) -> np.ndarray:
    """Which nodes are stated to stand beside the article. An element around an article, a main part or a top heading that is not itself
    left out is not beside it, and neither is a page's whole body; a header within an article is its heading."""
    n = len(p.name)
    out = np.zeros(n, bool)
    keep, in_article = np.zeros(n, bool), np.zeros(n, bool)
    for i in range(n - 1, 0, -1):
        stated = p.aside[i] and p.name[i] not in ("html", "body", "main")
        if not stated and p.name[i] in ("article", "main", "h1") or keep[i]:
            keep[p.parent[i]] |= p.name[i] != "h1" or p.name[p.parent[i]] not in ("header", "form", "nav", "aside", "footer")
    for i in range(1, n):
        up, name = p.parent[i], p.name[i]
        in_article[i] = in_article[up] or name == "article"
        header = name == "header" and not in_article[i]
        hard = name in NEVER and name != "form"
        out[i] = out[up] or hard or (header or p.aside[i] and name not in ("html", "body", "main") and not (in_article[i] and name in ("header", "h1"))) and not keep[i]
    for i in range(1, n):  # a section that says of itself to be the readers' comments
        if p.name[i] in ("section", "div") and not out[i] and not keep[i]:
            first = next((t for j, t in _items(p, i) if t and not t.isspace()), "")
            if len(first) < 60 and ABOUT.match(first.strip()):
                out[i : p.end[i]] = True
    return out


def _items(p: Page, i: int):
    """Up to eight items from node i's first text on."""
    lo = p.first[i]
    return [(j, t) for j, t in p.items[lo : lo + 8] if i <= j < p.end[i]]


def _firsts(p: Page) -> None:
    """first[i]: the place in items of the first item of node i's subtree."""
    p.first = [len(p.items)] * len(p.name)
    for k in range(len(p.items) - 1, -1, -1):
        p.first[p.items[k][0]] = k
    for i in range(len(p.name) - 1, 0, -1):
        p.first[p.parent[i]] = min(p.first[p.parent[i]], p.first[i])


def densities(parent: np.ndarray, end: np.ndarray, chars: np.ndarray, link: np.ndarray, tag: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composite density of every node, and the sum of its children's. Nodes stand in page order, with subtrees [i, end[i]); chars are a
    node's own, link and tag say whether it belongs to a link and counts as a tag, root is the node that stands for its page's whole."""
    here = np.arange(len(parent))

    def total(own):
        run = np.concatenate([[0.0], np.cumsum(own)])
        return run[end] - run[here]

    some = lambda x: np.where(x == 0, 1.0, x)
    c, lc = total(chars), total(chars * link)
    t, lt = total(tag) - tag, total(tag * link) - tag * link
    t, lt = some(t), some(lt)
    page = lc[root] / some(c[root])
    base = np.log(np.log(c / some(c - lc) * lc + page * c + np.e))
    density = c / t * np.log(np.maximum(c / some(lc) * t / lt, 1)) / np.maximum(base, 1e-9)
    # log(e) is 1 and its logarithm 0: without any link in the page the base would not exist, so plain characters per tag are used
    density = np.where(base < 1e-9, c / t, density)
    inner = parent >= 0
    return density, np.bincount(parent[inner], weights=density[inner], minlength=len(parent))


def _article(p: Page, density: np.ndarray, sums: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Which nodes of a page belong to its article."""
    n = len(p.name)
    keep = np.zeros(n, bool)
    if not (density > 0).any():
        return keep
    body = next((i for i in range(n) if p.name[i] == "body"), 0)
    score = np.where(out, -1.0, sums)
    best = int(np.argmax(score))
    path = [best]
    while path[-1] != body and p.parent[path[-1]] >= 0:
        path.append(p.parent[path[-1]])
    stated = next((i for i in path if p.name[i] in ("article", "main")), None)
    if stated is not None:
        outer = next((i for i in path[path.index(stated) :] if p.name[i] == "main"), stated)
        # a main part with one article is that article; one with several is all of it
        inner = [i for i in range(outer + 1, p.end[outer]) if p.name[i] == "article" and not out[i] and density[i] > 0]
        top = outer if p.name[outer] == "main" and (not inner or len(inner) > 1) else stated
        keep[top : p.end[top]] = True
        return keep & ~out
    threshold = min(density[i] for i in path)
    i = body
    while i < p.end[body] or body == 0 and i < n:
        if not out[i] and p.name[i] != "#text" and density[i] >= threshold and density[i] > 0:
            top = i + int(np.argmax(score[i : p.end[i]]))
            keep[top : p.end[top]] = True
        i += 1 if not keep[i] else p.end[i] - i
    heads = [i for i in range(best) if p.name[i] == "h1" and not out[i]]
    for i in heads[-1:]:
        keep[i : p.end[i]] = True
    return keep & ~out


def _joined(p: Page, keep: np.ndarray) -> str:
    blocks, now = [], []
    for node, text in [*p.items, (0, None)]:
        if text is None:
            if now and (block := " ".join("".join(now).split())):
                blocks.append(block)
            now = []
        elif keep[node]:
            now.append(text)
    return "\n\n".join(blocks)


def extract(pages: list[str]) -> list[str]:
    """The main text of each page; densities are computed for all pages at once."""
    trees = [Page(h) for h in pages]
    out, own, link = [], [], []
    for p in trees:
        _firsts(p)
        gone = _left_out(p)
        chars, linked = np.zeros(len(p.name)), np.zeros(len(p.name), bool)
        for node, text in p.items:
            if text and not gone[node] and p.name[node] == "#text":
                chars[node] = len(" ".join(text.split()))
        for i in range(1, len(p.name)):
            linked[i] = p.name[i] == "a" or linked[p.parent[i]]
        out.append(gone)
        own.append(chars)
        link.append(linked)
    if not trees:
        return []
    size = np.array([len(p.name) for p in trees])
    start = np.cumsum(size) - size
    parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + s) for p, s in zip(trees, start, strict=True)])
    end = np.concatenate([np.array(p.end) + s for p, s in zip(trees, start, strict=True)])
    gone = np.concatenate(out)
    tag = np.concatenate([np.array([x[0] != "#" for x in p.name]) for p in trees]) & ~gone
    density, sums = densities(parent, end, np.concatenate(own), np.concatenate(link), tag.astype(float), np.repeat(start, size))
    return [_joined(p, _article(p, density[a : a + n], sums[a : a + n], g)) for p, g, a, n in zip(trees, out, start, size, strict=True)]


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page, blocks separated by two line ends, white space within them one space.

    A null or empty page, and one without text beside menus and the like, gives an empty text. Unclosed tags are closed as browsers do,
    and a page cut off in the middle counts as far as it goes. Rows of one page_id are extracted each by itself, a null page_id stays,
    other columns are not read, and an empty table gives no rows. No page is cut, however long.
    """

    def make():
        def f(batch, data, at):
            raw = data.tobytes()
            texts = extract([raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)])
            return [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return f

    return map_texts(pages.select("page_id", "url", pages[f"`{html}`"].alias("_html")), make, "page_id long, url string, text string, n_chars long", text=2)
