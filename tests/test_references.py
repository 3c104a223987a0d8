"""References of varied sources, hand-written and generated, against what is known of them."""

from __future__ import annotations

import random

import pytest

from tessera.sources.references import file_references

FILES = {
    "a.ts": "// a note\r\nimport {\r\n  Ünï as U, // first, 'quoted not'\r\n  type B,\r\n} from './m';\nimport D, { E } from \"pkg\"\nimport * as ns from '../ns'\nimport type T from './t';\nimport'./side.css';import{F}from'./tight'\n",
    "b.js": "const { x, y: z } = await import('./dyn');\nconst all = await import(\"./all\");\nuse((await import('./one')).pick);\nimport('./later').then(f);\nexport { P as Q, default } from './re';\nexport * from '/abs';\nexport * as k from './named';\nconst important = 'no import';\nobj.import('./not-mine');\nimporter('x');\n",
    "c.py": "from .a import (b,\n    c as d)  # e\nimport os.path\nfrom pkg.sub import f  # g\n# from .no import x is a note\nvalue = 'import that'\n",
    "d.md": "# Hi\n[in](docs/p.md#top) and ![pic](img/a.png) [out](https://h.example/x) [here](#h)\n[mail](mailto:a@b.c) [two](x.css) see www.site.example/y. Also src/u.ts, ok.\n",
    "e.scss": "@import 'base';\n@import url(\"more.css\");\n@import 'https://h.example/z.css';\na { background: url(img/x.png) } b { src: url('f.woff2'), url(data:abc) }\n",
    "f.html": "<html>\n<link rel=x href='s.css'><script src=\"m.js\"></script>\n<img src='i.png'> <a href='p.html#q'>p</a> <a href='https://h.example/'>h</a>\n</html>",
    "g.vue": "<template>\n<img src='t.png'>\n</template>\n<script setup>\n\nimport A from './A.vue'\n</script>\n<style>\n@import 'v.css';\n</style>",
    "h.txt": "read https://h.example/a, then notes/b.md\nand https://h.example/a again",
    "i.go": 'import "fmt"',
    "j.md": None,
    "k": "",
}
KNOWN = {
    "a.ts": {("./m", "code", 2, "Ünï,B", True), ("pkg", "code", 6, "default,E", False), ("../ns", "code", 7, "*", True), ("./t", "code", 8, "default", True), ("./side.css", "stylesheet", 9, "", True), ("./tight", "code", 9, "F", True)},
    "b.js": {("./dyn", "code", 1, "x,y", True), ("./all", "code", 2, "*", True), ("./one", "code", 3, "pick", True), ("./later", "code", 4, "*", True), ("./re", "code", 5, "P,default", True), ("/abs", "code", 6, "*", True), ("./named", "code", 7, "*", True)},
    "c.py": {(".a", "code", 1, "b,c", True), ("os.path", "code", 3, "*", False), ("pkg.sub", "code", 4, "f", False)},
    "d.md": {("docs/p.md", "document", 2, "", True), ("img/a.png", "asset", 2, "", True), ("x.css", "stylesheet", 3, "", True), ("https://h.example/x", "url", 2, "", False), ("https://www.site.example/y", "url", 3, "", False), ("src/u.ts", "code", 3, "", True)},
    "e.scss": {("base", "stylesheet", 1, "", True), ("more.css", "stylesheet", 2, "", True), ("img/x.png", "asset", 4, "", True), ("f.woff2", "asset", 4, "", True)},
    "f.html": {("s.css", "stylesheet", 2, "", True), ("m.js", "code", 2, "", True), ("i.png", "asset", 3, "", True), ("p.html", "document", 3, "", True), ("https://h.example/", "url", 3, "", False)},
    "g.vue": {("t.png", "asset", 2, "", True), ("./A.vue", "code", 6, "default", True), ("v.css", "stylesheet", 9, "", True)},
    "h.txt": {("https://h.example/a", "url", 1, "", False), ("notes/b.md", "document", 1, "", True)},
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(list(FILES.items()), "path string, content string")
    return file_references(df).collect()


@pytest.mark.parametrize("path", sorted(FILES))
def test_kinds_of_files(found, path):
    got = [(r.source, r.type, r.line, ",".join(r.symbols), r.local) for r in found if r.path == path]
    assert len(got) == len(set(got)) and set(got) == KNOWN.get(path, set())


def test_random_scripts(spark):
    """Statements in random order and form, between lines that only look like imports."""
    rng = random.Random(11)
    noise = ["const s = `x`;", "// plain words", "function imports(a) { return { a } }", "if (a) {\n  b()\n}", "", "let exported = 1", "call(imported, './no.js')", "\tüber.import('./x')"]
    files, known = [], set()
    for n in range(60):
        lines: list[str] = []
        for k in range(rng.randint(0, 12)):
            lines += rng.choice(noise).split("\n")
            source, names = f"./m{n}_{k}", [f"N{k}", f"$é{k}"[: rng.randint(2, 4)]]
            forms = [
                (f"import {{ {names[0]}, type {names[1]} as Z }} from '{source}'", names), (f'import {{\n\t{names[0]},\n\t{names[1]},\n}} from "{source}";', names), (f"import D{k} from '{source}'", ["default"]),
                (f"import * as x from '{source}'", ["*"]), (f"import '{source}'", []), (f"export * from '{source}';", ["*"]), (f"export {{ {names[0]} as Y }} from '{source}'", names[:1]),
                (f"const {{ {names[0]} }} = await import('{source}')", names[:1]), (f"var v = (await import(\"{source}\")).{names[0]};", names[:1]), (f"load(import('{source}'))", ["*"]),
            ]
            text, symbols = rng.choice(forms)
            known.add((f"{n}.ts", source, len(lines) + 1, tuple(symbols)))
            lines += text.split("\n")
        files.append((f"{n}.ts", rng.choice(["\n", "\r\n"]).join(lines)))
    rows = file_references(spark.createDataFrame(files, "path string, content string").repartition(4)).collect()
    assert {(r.path, r.source, r.line, tuple(r.symbols)) for r in rows} == known and len(rows) == len(known)


def test_texts_are_not_shuffled(spark):
    df = file_references(spark.createDataFrame([("a.md", "x")], "path string, content string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(path" in plan
