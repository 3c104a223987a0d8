"""Main text, whitening and the prefix trie against plain versions, on odd tables too."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import oracle
import pytest

from tessera.llm import html_extraction, prefix_trie, queries, whitening

SF = "/root/testdata/sf0.001"


# ---- main text ----


def density_by_tree(p):
    """Composite density of a page by plain recursion over its elements."""
    kids = {i: [j for j in range(len(p.name)) if p.parent[j] == i] for i in range(len(p.name))}
    text = {i: " ".join(t.split()) for i, t in p.items if t and p.name[i] == "#text"}
    total = {}

    def walk(i, linked):
        linked = linked or p.name[i] == "a"
        own = len(text.get(i, ""))
        tag = p.name[i][0] != "#"
        c, lc, t, lt = own, own * linked, 0, 0
        for j in kids[i]:
            a, b, x, y = walk(j, linked)
            c, lc, t, lt = c + a, lc + b, t + x, lt + y
        total[i] = c, lc, t, lt
        return c, lc, t + tag, lt + (tag and linked)

    walk(0, False)
    page = total[0][1] / (total[0][0] or 1)
    out = []
    for i in range(len(p.name)):
        c, lc, t, lt = total[i]
        t, lt = t or 1, lt or 1
        base = math.log(math.log(c / ((c - lc) or 1) * lc + page * c + math.e))
        out.append(c / t * math.log(max(c / (lc or 1) * t / lt, 1)) / base if base > 1e-9 else c / t)
    return out


def soup(rng, say):
    """A page without any stated meaning, and the blocks of its article."""
    title, blocks = say(4), [say(rng.randrange(12, 60)) for _ in range(rng.randrange(3, 9))]
    menu = "".join(f"<div><a href='/{i}'>{say(2)}</a></div>" for i in range(12))
    inner = "".join(f"<p>{b[: len(b) // 2]}<b>{b[len(b) // 2 :]}</b></p>" for b in blocks)
    foot = "".join(f"<span><a href=x>{say(1)}</a></span>" for _ in range(9))
    return f"<html><body><div>{menu}</div><h1>{title}</h1><div><div class=k1>{inner}</div></div><div>{foot}</div></body></html>", [title, *blocks]


def test_densities():
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["sun", "low", "warm", "river", "stone"]) for _ in range(n))
    for html in [soup(rng, say)[0] for _ in range(20)] + ["", "plain", "<p>no links"]:
        p = html_extraction.Page(html)
        html_extraction._firsts(p)
        chars = np.zeros(len(p.name))
        for i, t in p.items:
            if t and p.name[i] == "#text":
                chars[i] = len(" ".join(t.split()))
        link = np.zeros(len(p.name), bool)
        for i in range(1, len(p.name)):
            link[i] = p.name[i] == "a" or link[p.parent[i]]
        tag = np.array([n[0] != "#" for n in p.name], float)
        got, sums = html_extraction.densities(np.array(p.parent), np.array(p.end), chars, link, tag, np.zeros(len(p.name), int))
        want = density_by_tree(p)
        assert np.allclose(got, want) and np.allclose(sums, [sum(want[j] for j in range(len(want)) if p.parent[j] == i) for i in range(len(want))])


def test_density_decides(monkeypatch):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["sun", "low", "warm", "river", "stone"]) for _ in range(n))
    pages = [soup(rng, say) for _ in range(60)]
    assert html_extraction.extract([h for h, _ in pages]) == ["\n\n".join(b) for _, b in pages]
    monkeypatch.setattr(html_extraction, "densities", lambda parent, *_: (np.ones(len(parent)), np.ones(len(parent))))
    assert html_extraction.extract([h for h, _ in pages]) != ["\n\n".join(b) for _, b in pages]


PAGES = {
    "": "", None: "", "<p": "", "&lt;p&gt; &amp;amp; &copy": "<p> &amp; ©", "a<br>b  \n c": "a b c", "<p>a<p>b<!-- x --> c": "a\n\nb c", "<!-- open": "",
    "<article><p>x</p></article><article class='comment'><p>so very long a comment of a reader of the page</p></article>": "x",
    "<main><article><h1>T</h1>one</article></main><aside>two</aside><footer>three</footer>": "T\n\none",
    "<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>text<form>mail<input></form></article>": "T\n\ntext",
    "<body><div class='cookie-notice'>We use cookies, and so on, at length.</div><div id=main><p>The text.</p><div class=ad>Buy!</div><p>More.</p></div></body>": "The text.\n\nMore.",
    "<body class='has-sidebar'><nav><a>menu</a></nav><script>if (a</p>b) {}</script><style>p{}</style><p hidden>gone</p><p>kept</p></body>": "kept",
    "<article><p>A &nbsp; b</p><ul><li>one<li>two</ul><table><tr><td>x<td>y</table><script>no": "A b\n\none\n\ntwo\n\nx\n\ny",
    "<article><div class='article-header'><h1>T</h1></div><p>t</p><section><h2>3 Comments</h2><p>I liked it</p></section></article>": "T\n\nt",
}


def test_op11(spark, tmp_path):
    rows = [(i, f"http://h/{i}", h, "x", "y") for i, h in enumerate(PAGES)] + [(None, None, "<p>null id", "x", "y"), (0, "again", "<p>twice", "x", "y")]
    long = "<article>" + "<p>word and more</p>" * 60_000 + "</article>"
    spark.createDataFrame([*rows, (99, "l", long, "x", "y")], "page_id long, url string, html string, text string, `a.b` string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter(tuple(r) for r in queries.op11_html_extraction(spark, str(tmp_path)).collect())
    want = [(i, f"http://h/{i}", t, len(t)) for i, t in enumerate(PAGES.values())] + [(None, None, "null id", 7), (0, "again", "twice", 5)]
    text = "\n\n".join(["word and more"] * 60_000)
    assert got == Counter([*want, (99, "l", text, len(text))])


# ---- whitening ----


def plain_whitening(rows, k=4):
    """Columns of op12 by numpy's own solver: n, {row number: (deviation, [absolute whitened values])}, explained."""
    use = [(i, v) for i, (_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = Counter(len(v) for _, v in use).most_common(1)[0][0]
    x = {i: np.floor(np.array(v, np.float32).astype(float) * 256).astype(int) for i, v in use if len(v) == d}
    u = np.unique(np.stack(list(x.values())), axis=0)
    e, q = np.linalg.eigh(np.cov(u.T, bias=True))
    e, q = e[::-1], q[:, ::-1]
    return len(u), {i: (int(((len(u) * y - u.sum(0)) ** 2).sum()), np.abs((y - u.mean(0)) @ q[:, :k] / np.sqrt(e[:k]))) for i, y in x.items()}, e[:k] / e.sum()


def test_op12(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(6) * [3, 2, 1, 0.5, 0.2, 0.1]).tolist()) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(200)] + [(None, rows[3][1]), (5, rows[9][1]), (5, rows[10][1])]
    rows += [(600, None), (601, [1.0, None, 0.0]), (602, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (603, [float("inf")] * 6), (604, []), (605, [1.0, 2.0])]
    spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, label int, x string, `a.b` string").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op12_whitening(spark, str(tmp_path)).collect()
    n, want, explained = plain_whitening(rows)
    assert len(out) == 4 * len(want) and all(r.n == n and r.identity_error <= 1e-10 and abs(r.explained / explained[r.component - 1] - 1) < 1e-12 for r in out)
    assert Counter((r.vec_id, r.component, r.deviation, round(abs(r.whitened), 9)) for r in out) == Counter((rows[i][0], c + 1, dev, round(w[c], 9)) for i, (dev, w) in want.items() for c in range(4))
    signs = {}
    for r in out:  # one sign for all rows: copies agree
        assert signs.setdefault((r.vec_id, r.component), r.whitened) == r.whitened or r.vec_id in (5, None)


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [3, 3, 3, 1, 1], [2, 1, 1, 1, 1], [7, 1e-3, 0, 0, 0], [1, 1 - 1e-9, 0.5, 0.1, 0], [0, 0, 0, 0, 0]])
def test_leading(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((5, 5)))
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    for s in (-1, 0.7, 1.5, 2.5, 3.5):
        assert whitening.count_below(v, s) == sum(e < s for e in values)
    pairs = whitening.leading(v, 4)
    axes = np.stack([x for _, x in pairs])
    assert np.allclose([e for e, _ in pairs], values[:4], atol=1e-12) and np.allclose(axes @ axes.T, np.eye(4), atol=1e-12)
    assert all(np.linalg.norm(v @ x - e * x) < 1e-12 for e, x in pairs)


def test_whiten_without_variance(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert Counter(tuple(r) for r in whitening.whiten(df).collect()) == Counter((v, c, 1, 0, None, None, None) for v in (1, 2) for c in (1, 2))
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {(r.component, r.whitened is None) for r in whitening.whiten(line).collect()} == {(1, False), (2, True)}
    huge = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [0.0, 1e12])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}


# ---- prefix trie ----

NODE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def trie_rows(rows):
    """Nodes by plain dictionaries; rows (conv_id, turn, role, text)."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    members, ends = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    out = []
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), len(leaves), saved, sha))
    return out


def odd_turns():
    rng = random.Random(3)
    rows = [(c * rng.choice([1, 1, 3]) - 5, rng.choice([t, t, t, None]), rng.choice(["user", "bot", None]), rng.choice(["a", "b", "é", None])) for c in range(60) for t in range(rng.randrange(14))]
    rows += [(5 * k, t, "user", f"hot{t % 2}") for k in range(100, 140) for t in range(12)]
    rows += [(c, t, "u", f"long{t}") for c in (100001, 100002) for t in range(60)] + [(100003, None, None, None)]
    return [*rows, (None, 1, "a", "b"), (7, 1, "x", "y"), (7, 1, "x", "y")]


@pytest.mark.parametrize("limit", [4, 60, 100_000])
def test_prefix_trie(spark, limit):
    rows = odd_turns()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, k string, `a.b` string").repartition(5)
    assert Counter(tuple(r[c] for c in NODE) for r in prefix_trie.prefix_trie(df, limit).collect()) == Counter(trie_rows(rows))


def test_op13(spark):
    assert oracle.compare(spark, oracle.connect(SF), queries.op13_prefix_trie, queries.ORACLE_SQL["op13_prefix_trie"], SF) == ""


def test_one_long_conversation(spark):
    """Ranks and sums of a conversation over many tasks."""
    rows = [(c, t, "u", f"t{t}") for c in (5, 10) for t in range(9000)]
    out = {r.depth: r for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7), 50).collect()}
    sizes = [len(f"t{t}") for t in range(9000)]
    assert len(out) == 9001 and out[0].saved_tokens == sum(sizes) and all(out[d].saved_tokens == sum(sizes[d - 1 :]) and out[d].n_convs == 2 for d in (1, 2, 4096, 4097, 9000))


def test_empty(spark, tmp_path):
    for name, schema in {"pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>, label int", "conversations": "conv_id long, turn long, role string, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for f in (queries.op11_html_extraction, queries.op12_whitening, queries.op13_prefix_trie):
        assert f(spark, str(tmp_path)).count() == 0
