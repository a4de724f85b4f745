"""Operators on small hand-made tables."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from corpusloom import config
from corpusloom.operators import budget, extract, graph, rank, render, report, resolve, semantic, vectors
from corpusloom.sources import cache

# -- extraction


PYTHON = '''"""Module text.

More."""
import os
from .a import b, c

LIMIT: int = 3
lower = 1


@decorated
class Thing(Base, metaclass=M):
    """A thing."""

    @property
    def size(self) -> int:
        """How large."""
        return helper(self)

    async def go(self, *a, k=1): ...


def free(x: Kind) -> str:
    return Thing(x)
'''


def test_python_facets():
    got = extract.facets(PYTHON, "python")
    assert got["imports"] == ["import os", "from .a import b, c"]
    assert got["docstrings"] == ["Module text.\n\nMore."]
    assert [(s["name"], s["kind"], s["signature"], s["docstring"]) for s in got["symbols"]] == [("Thing", "class", "class Thing(Base, metaclass=M)", "A thing."), ("free", "function", "def free(x: Kind) -> str", "")]
    assert [(c["name"], c["signature"]) for c in got["symbols"][0]["children"]] == [("size", "def size(self) -> int"), ("go", "async def go(self, *a, k=1)")]
    assert got["constants"] == ["LIMIT: int = 3"]
    assert {"helper", "Thing", "Base", "Kind", "decorated"} <= set(got["usages"])
    assert not got["partial_parse"] and not got["parse_failed"]


def test_constants():
    assert extract.facets("a = 1\nB = [" + "1, " * 100 + "]\n", "python")["constants"] == ["a = 1", "B = <complex expression>"]


def test_broken_python_keeps_what_patterns_find():
    got = extract.facets('"""Doc."""\nimport os\nfrom x import y\ndef (:\n', "python")
    assert got["parse_failed"] and got["partial_parse"]
    assert got["imports"] == ["import os", "from x import y"] and got["docstrings"] == ["Doc."]
    assert "os" in got["usages"] and "def" not in got["usages"]


@pytest.mark.parametrize(
    ("language", "source", "imports", "names"),
    [
        ("javascript", "import {a} from './a';\nconst q = require('./q');\nexport class K {\n  run(x) {\n  }\n}\nconst f = (a) => a\nfunction g() {}\n", 2, [("K", "class"), ("f", "function"), ("g", "function")]),
        ("typescript", "import x from \"./x\"\nexport default function main(a: string): void {\n}\n", 1, [("main", "function")]),
        ("java", "import a.B;\npublic class Main extends B {\n    public static void main(String[] args) {\n    }\n}\n", 1, [("Main", "class"), ("main", "function")]),
        ("go", 'package m\nimport "a/b"\nfunc F(x int) int {\n}\nfunc (t *T) M() {\n}\ntype T struct {\n}\n', 1, [("F", "function"), ("M", "method"), ("T", "class")]),
        ("rust", "use crate::a::b;\npub fn f() {\n}\npub struct S {\n}\nimpl S {\n}\n", 1, [("f", "function"), ("S", "class"), ("S", "class")]),
        ("ruby", "require 'x'\nrequire_relative 'y'\nclass A\n  def m\n  end\nend\ndef f(x)\nend\n", 2, [("A", "class"), ("f", "function")]),
        ("c", '#include "a.h"\n#include <b.h>\nint main(void) {\n}\nstruct P {\n};\n', 2, [("main", "function"), ("P", "class")]),
        ("cpp", '#include "a.hpp"\nclass Q {\n};\nint Q::run(int x) {\n}\n', 1, [("Q", "class"), ("Q::run", "function")]),
        ("scala", "object X", 0, []),
    ],
)
def test_other_languages(language, source, imports, names):
    got = extract.facets(source, language)
    assert len(got["imports"]) == imports, got["imports"]
    assert [(s["name"], s["kind"]) for s in got["symbols"]] == names
    assert got["partial_parse"] == (language != "scala") and not got["parse_failed"]


@pytest.mark.parametrize(
    ("language", "source", "imports", "names"),
    [
        ("typescript", "// function a() {}\n/*\nimport x from './x'\nclass B {\n}\n*/\nconst s = 'require(\"./no\")' + `\nfunction c() {}\n`\nconst r = /[\"'`]function/\nfunction d() {}\n", [], ["d"]),
        ("javascript", "const a = `x ${f('`')}`; // it's\nimport {b} from './b' // import c from './c'\nlet e = x / y / z; function q() {}\nfunction g() {}\n", ["import {b} from './b'"], ["q", "g"]),
        ("go", 'package m\nimport (\n\t"a/b"\n\t_ "c/d" // "e/f"\n)\nvar s = `\n\t"g/h"\nimport "i/j"\n`\nfunc R() rune { return \'"\' }\nfunc S() {}\n', ['"a/b"', '_ "c/d"'], ["R", "S"]),
        ("java", 'import a.B;\ninterface I {\n    int size();\n    <T> java.util.List<T> all(Class<T> c) throws E;\n}\nclass C {\n    String t = """\n    void no() {\n    """;\n    abstract void run(int a);\n    void go() {\n        foo(1);\n        return bar(2);\n        new Thing(3);\n    }\n}\n', ["import a.B;"], ["size", "all", "C", "run", "go"]),
        ("rust", "fn a<'x>(s: &'x str) -> char { '\"' }\nlet r = r#\"\nfn no() {}\n\"#;\nfn b() {}\n", [], ["a", "b"]),
        ("c", "#include <a.h> // #include <b.h>\nchar q = '\"';\nint f(void) {\n}\n", ["#include <a.h>"], ["f"]),
        ("ruby", "x = <<~TEXT\n  require 'no'\ndef no\nTEXT\ny = \"#{z} # not\"\ndef f(x) # def g\nend\n", [], ["f"]),
    ],
)
def test_comments_and_strings_are_no_code(language, source, imports, names):
    got = extract.facets(source, language)
    assert got["imports"] == imports and [s["name"] for s in got["symbols"]] == names
    code, kept = extract.code_of(source, language)
    assert len(code) == len(kept) == len(source) and code.count("\n") == kept.count("\n") == source.count("\n")


def test_heads_over_lines_and_members():
    got = extract.facets("class A<T> extends B<T> {\n  f = () => { x() }\n  async run<K>(\n    a: K,\n  ): Promise<K> {\n    if (a) { y() }\n  }\n}\nexport function g(\n  a\n) {\n}\n", "typescript")
    assert [(s["name"], s["kind"], s["signature"], s["start_line"], s["end_line"]) for s in got["symbols"]] == [("A", "class", "class A", 1, 8), ("g", "function", "function g(", 9, 12)]
    assert [(m["name"], m["kind"], m["start_line"], m["end_line"]) for m in got["symbols"][0]["children"]] == [("run", "method", 3, 7)]


@pytest.mark.parametrize("language", sorted(extract.syntax.SPECS))
def test_broken_sources_are_read_as_far_as_they_go(language):
    """Any order of brackets, words and strings gives some facets: nothing is raised and no node leaves the file."""
    import random

    rnd = random.Random(3)
    words = ["{", "}", "(", ")", "[", "]", ";", "\n", '"', "'", "`", "#", "class", "def", "end", "func", "fn", "function", "type", "if", "do", "x", "=", "=>", "<", ">", ":", "é", "struct", "int", "//", "/*", "interface", "new"]
    for _ in range(400):
        source = " ".join(rnd.choices(words, k=rnd.randint(0, 40)))
        got = extract.facets(source, language)
        assert not got["parse_failed"]
        assert all(1 <= s["start_line"] <= s["end_line"] <= source.count("\n") + 1 for s in got["symbols"])


def test_long_sources_take_linear_time():
    import time

    source = "".join(f"int f{i}(int a) {{ return g(a, {{1}}); }}\nstruct S{i} {{ int x; }};\n" for i in range(4000))
    at = time.time()
    assert len(extract.facets(source, "c")["symbols"]) == 8000
    assert time.time() - at < 10


def test_syntax_specs(spark):
    text = "; (no) @class\n(function_definition name: (identifier) @name) @function\n(a (b (c) @class)) @method (x) (y)\n @class (z) word @import\n(s \"(\") @from_import (open"
    assert extract.spec_patterns(text) == [("function_definition", "function"), ("a", "method"), ("y", "class"), ("s", "from_import")]
    specs = spark.createDataFrame([("p", text), ("q", None), ("p", "(s) @import (t) @other")], "language string, text string")
    assert {tuple(r) for r in extract.spec_types(specs).collect()} == {("p", "function", "function_definition"), ("p", "function", "a"), ("p", "class", "y"), ("p", "import", "s")}


def test_parse_keeps_rows(spark):
    rows = [("a.py", "python", PYTHON), ("b.py", "python", "def ("), ("c.txt", "unknown", ""), ("d.js", "javascript", "function z() {}\n")]
    parsed = extract.parse(spark.createDataFrame(rows, "path string, language string, text string"))
    got = {r.path: r for r in parsed.collect()}
    assert got["a.py"].line_count == PYTHON.count("\n") + 1 and got["c.txt"].line_count == 0
    assert {(r.language, r.total, r.failed) for r in extract.health(parsed).collect()} == {("python", 2, 1), ("unknown", 1, 0), ("javascript", 1, 0)}


# -- resolution


KNOWN = [
    "pkg/__init__.py", "pkg/utils.py", "pkg/sub/__init__.py", "pkg/sub/mod.py", "src/lib/core.py", "top.py", "web/util.ts", "web/ui/index.js", "h/y.hpp", "src/a/b.rs", "src/a/c/mod.rs", "com/x/Y.java", "src/main/java/com/x/Z.java",
    "lib/z.rb", "b/c.rb", "internal/p/p.go", "internal/p/q.go", "cmd.go",
]


@pytest.mark.parametrize(
    ("text", "language", "path", "found"),
    [
        ("import pkg.utils", "python", "x.py", ["pkg/utils.py"]),
        ("from pkg import utils", "python", "x.py", ["pkg/__init__.py"]),
        ("import lib.core", "python", "x.py", ["src/lib/core.py"]),
        ("from . import utils", "python", "pkg/a.py", ["pkg/utils.py"]),
        ("from .sub import mod", "python", "pkg/a.py", ["pkg/sub/__init__.py"]),
        ("from ..utils import f", "python", "pkg/sub/mod.py", ["pkg/utils.py"]),
        ("from ... import top", "python", "pkg/sub/mod.py", ["top.py"]),
        ("from .. import top", "python", "top2.py", []),
        ("import os", "python", "x.py", []),
        ("import {a} from './util'", "typescript", "web/app.ts", ["web/util.ts"]),
        ("const x = require('../web/ui')", "javascript", "web/app.js", ["web/ui/index.js"]),
        ("import x from 'react'", "javascript", "web/app.js", []),
        ("import x from '../../out'", "javascript", "web/app.js", []),
        ("use crate::a::b;", "rust", "src/main.rs", ["src/a/b.rs"]),
        ("use crate::a::c;", "rust", "src/main.rs", ["src/a/c/mod.rs"]),
        ("import com.x.Y;", "java", "M.java", ["com/x/Y.java"]),
        ("import com.x.Z;", "java", "M.java", ["src/main/java/com/x/Z.java"]),
        ("import com.x.*;", "java", "M.java", []),
        ('#include "../h/y.hpp"', "cpp", "s/m.cpp", ["h/y.hpp"]),
        ("#include <y.hpp>", "cpp", "h/m.cpp", []),
        ("require 'z'", "ruby", "a.rb", ["lib/z.rb"]),
        ("require_relative 'c'", "ruby", "b/a.rb", ["b/c.rb"]),
        ('"ex.com/m/internal/p"', "go", "main.go", ["internal/p/p.go", "internal/p/q.go"]),
        ('"internal/p"', "go", "main.go", ["internal/p/p.go", "internal/p/q.go"]),
        ('"fmt"', "go", "main.go", []),
        ('"ex.com/m"', "go", "main.go", ["cmd.go", "internal/p/p.go", "internal/p/q.go"]),
    ],
)
def test_resolution(spark, text, language, path, found):
    files = spark.createDataFrame([("r", p) for p in KNOWN], "root string, path string")
    modules = resolve.go_modules(spark.createDataFrame([("r", "go.mod", "module ex.com/m\n\ngo 1.2\n")], "root string, path string, text string"))
    imports = spark.createDataFrame([("r", path, language, 0, text)], "root string, path string, language string, pos int, import_text string")
    assert sorted(r.file for r in resolve.resolve(imports, files, modules).collect()) == found


def test_other_roots_come_after_the_own(spark):
    files = spark.createDataFrame([("a", "m.py"), ("b", "m.py"), ("b", "n.py"), ("c", "n.py")], "root string, path string")
    imports = spark.createDataFrame([("a", "x.py", "python", 0, "import m"), ("a", "x.py", "python", 1, "import n"), ("a", "x.py", "python", 2, "import o")], "root string, path string, language string, pos int, import_text string")
    got = {(r.pos, r.target_root, r.file) for r in resolve.resolve(imports, files, roots=["a", "b", "c"]).collect()}
    assert got == {(0, "a", "m.py"), (1, "b", "n.py")}


def test_other_roots_are_asked_in_the_order_given(spark):
    files = spark.createDataFrame([(r, "util.py") for r in "zb"] + [("b", "pkg/f.go"), ("z", "pkg/a.go"), ("z", "pkg/b.go")], "root string, path string")
    texts = [("python", "import util"), ("python", "from .util import x"), ("c", '#include "util.py"'), ("go", '"x/pkg"'), ("go", '"/pkg"')]
    imports = spark.createDataFrame([("m", "x", lang, i, t) for i, (lang, t) in enumerate(texts)], "root string, path string, language string, pos int, import_text string")
    ask = lambda *roots: {(r.pos, r.target_root, r.file) for r in resolve.resolve(imports, files, roots=roots).collect()}
    assert ask("m", "z", "b") == {(0, "z", "util.py"), (4, "z", "pkg/a.go"), (4, "z", "pkg/b.go")}
    assert ask("b", "m", "z") == {(0, "b", "util.py"), (4, "b", "pkg/f.go")}


def test_imports_are_not_multiplied_by_roots(spark):
    """2000 imports that mean a file of each of 2000 roots: no join makes more rows than there are of both."""
    roots = [f"r{i}" for i in range(2000)]
    files = spark.createDataFrame([(r, "util.py") for r in roots], "root string, path string")
    imports = spark.createDataFrame([("own", f"f{i}.py", "python", 0, "import util") for i in range(2000)], "root string, path string, language string, pos int, import_text string")
    found = resolve.resolve(imports, files, roots=["own", *reversed(roots)])
    assert {tuple(r) for r in found.select("target_root", "file").distinct().collect()} == {("r1999", "util.py")}
    rows, todo = [], [found._jdf.queryExecution().executedPlan()]
    found.collect()
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            rows.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName().startswith(("ShuffleQueryStage", "BroadcastQueryStage")):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert sum(rows) < 10_000


def test_cross_references(spark):
    symbols = spark.createDataFrame([("a.py", "T"), ("b.py", "T"), ("b.py", "U")], "path string, name string")
    used = spark.createDataFrame([("a.py", "T"), ("b.py", "T"), ("c.py", "U"), ("b.py", "U"), ("c.py", "nothing")], "path string, name string")
    assert {tuple(r) for r in resolve.cross_references(symbols, used).collect()} == {("T", "a.py", "b.py"), ("U", "b.py", "c.py")}


@pytest.mark.parametrize(
    ("text", "path", "modules"),
    [
        ("import pkg.a, pkg.sub.b as c, os", "pkg/m.py", ["a", "sub.b"]), ("from pkg import a, None_, Q", "pkg/m.py", ["a"]), ("from pkg.sub import (b,\n    x as y)", "pkg/m.py", ["sub", "sub.b"]), ("from . import a", "pkg/m.py", ["a"]),
        ("from .sub import b", "pkg/m.py", ["sub", "sub.b"]), ("from .. import a", "pkg/sub/b.py", ["a"]), ("from ... import a", "pkg/sub/b.py", ["a"]), ("from ..sub import b", "pkg/sub/b.py", ["sub", "sub.b"]), ("import pkg", "pkg/m.py", []), ("import other.a", "pkg/m.py", []),
        ("from pkg2 import z", "src/pkg2/y.py", ["z"]), ("from .z import q", "src/pkg2/y.py", ["z"]), ("import a", "top.py", []), ("from .missing import q", "pkg/m.py", []),
    ],
)
def test_internal_modules(spark, text, path, modules):
    known = ["pkg/__init__.py", "pkg/a.py", "pkg/m.py", "pkg/sub/__init__.py", "pkg/sub/b.py", "src/pkg2/z.py", "src/pkg2/y.py", "top.py", "a.py"]
    files = spark.createDataFrame([(r, p) for r in "rs" for p in known], "root string, path string")
    got = render.internal_modules(spark.createDataFrame([("r", path, text)], "root string, path string, import_text string"), files).collect()
    assert [m for r in got for m in r.modules] == modules


# -- graph


def edges_of(spark, pairs):
    return spark.createDataFrame([(*p, "import") for p in pairs], "src string, dst string, edge_type string")


def nodes_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "path string")


@pytest.fixture(params=["driver", "jobs"])
def walk(request, monkeypatch):
    """Small graphs are walked on the driver, others in jobs; both give the same."""
    if request.param == "jobs":
        monkeypatch.setattr(graph, "SMALL", 0)


def test_edges_are_distinct_and_imports_come_first(spark):
    imports = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a")], "src string, dst string")
    refs = spark.createDataFrame([("T", "b", "a"), ("T", "c", "a")], "symbol string, defined_in string, used_in string")
    assert {tuple(r) for r in graph.edges(imports, refs).collect()} == {("a", "b", "import"), ("a", "c", "symbol_ref")}


def test_distances(spark, walk):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("d", "b"), ("x", "y")])
    got = {r.path: r.dist for r in graph.distances(e, nodes_of(spark, ["a"])).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 2}
    assert graph.distance(e, "a", "c") == 2 and graph.distance(e, "c", "a") is None and graph.distance(e, "a", "a") == 0


@pytest.mark.parametrize("seed", range(4))
def test_cycles_against_reachability(spark, walk, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(13 + 3 * seed)]
    reach = {(a, b) for a, b in pairs if a != b}
    while True:
        more = {(a, d) for a, b in reach for c, d in reach if b == c} - reach
        if not more:
            break
        reach |= more
    assert {r.path for r in graph.cyclic(edges_of(spark, pairs)).collect()} == {a for a, b in reach if a == b}


def test_long_cycles(spark, walk):
    ring = [(f"n{i:02}", f"n{(i + 1) % 40:02}") for i in range(40)]
    tail = [("n05", "t0"), ("t0", "t1"), ("t1", "t2"), ("s", "n00")]
    assert {r.path for r in graph.cyclic(edges_of(spark, ring + tail)).collect()} == {a for a, _ in ring}


def test_entry_points(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c")])
    assert [r.path for r in graph.entry_points(nodes_of(spark, ["a", "b", "c"]), e).collect()] == ["a"]
    assert [r.path for r in graph.entry_points(nodes_of(spark, ["x/main.py", "b"]), e).collect()] == ["x/main.py"]


def test_call_paths(spark, walk):
    e = edges_of(spark, [("e", "a"), ("e", "b"), ("e", "c"), ("a", "d"), ("b", "f"), ("c", "g"), ("x", "c"), ("g", "e")])
    got = [r.nodes for r in graph.call_paths(e, nodes_of(spark, ["e"])).orderBy("rank").collect()]
    assert got == [["e", "a", "d"], ["e", "b", "f"], ["e", "c", "g"]]
    short = [r.nodes for r in graph.call_paths(e, nodes_of(spark, ["e", "x"]), max_depth=2, max_paths=2).orderBy("rank").collect()]
    assert short == [["e", "a"], ["e", "c"]]  # c has the most fan-in
    assert graph.call_paths(e, nodes_of(spark, [])).count() == 0


def brute_call_paths(pairs, entries, max_depth, max_paths):
    fan = {}
    for _, d in set(pairs):
        fan[d] = fan.get(d, 0) + 1
    out = []
    for e in sorted(set(entries)):
        level, ended = [([e], [])], []
        for size in range(1, max_depth + 1):
            grown = [(n + [d], t + [(-fan[d], d)]) for n, t in level for s, d in set(pairs) if s == n[-1] and d not in n]
            ended += sorted((t, n) for n, t in level if size == max_depth or not any(g[:-1] == n for g, _ in grown))
            level = grown
        out += [n for _, n in ended]
    return sorted(out[:max_paths], key=lambda n: (-len(n), n))


@pytest.mark.parametrize("seed", range(4))
def test_call_paths_against_brute_force(spark, walk, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(8 + 5 * seed)]
    pairs = [(a, b) for a, b in pairs if a != b] + [("n0", f"leaf{i}") for i in range(12 * (seed == 3))]
    entries = ["n0", "n1", "n2", "n3"][: 1 + seed]
    for depth, n in ((5, 3), (3, 2), (2, 4), (1, 2)):
        got = [list(r.nodes) for r in graph.call_paths(edges_of(spark, pairs), nodes_of(spark, entries), depth, n).orderBy("rank").collect()]
        assert got == brute_call_paths(pairs, entries, depth, n)


@pytest.mark.parametrize("seed", range(3))
def test_searches_in_blocks_are_whole(spark, monkeypatch, seed):
    """Blocks of two paths: what is not in the first is found in a later one."""
    monkeypatch.setattr(graph, "SMALL", 0)
    monkeypatch.setattr(graph, "BLOCK", 2)
    rng = random.Random(seed)
    pairs = sorted({(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}") for _ in range(14)} | {("n0", f"leaf{i}") for i in range(4 * (seed == 1))})
    pairs = [(a, b) for a, b in pairs if a != b]
    got = [list(r.nodes) for r in graph.call_paths(edges_of(spark, pairs), nodes_of(spark, ["n0", "n1"]), 4, 5).orderBy("rank").collect()]
    assert got == brute_call_paths(pairs, ["n0", "n1"], 4, 5)
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
    simple = [[n] for n in ahead]
    rings = []
    for _ in range(4):
        rings += [p for p in simple if len(p) > 1 and p[0] in ahead.get(p[-1], ()) and p[0] == min(p)]
        simple = [[*p, b] for p in simple for b in ahead.get(p[-1], ()) if b not in p]
    rings.sort(key=lambda p: (len(p), p))
    e = edges_of(spark, pairs)
    assert [list(r.nodes) for r in graph.cycles(e, graph.cyclic(e), longest=4, n=6).collect()] == rings[:6]


def test_a_hub_stores_few_paths(spark, monkeypatch):
    """300 successors that each have the same 300: 27 million ways of four steps, of which only blocks are held."""
    monkeypatch.setattr(graph, "SMALL", 0)
    kept = []

    def counted(df, name, *args):
        out = stored(df, name, *args)
        kept.append(out.count())
        return out

    stored = graph.stored
    monkeypatch.setattr(graph, "stored", counted)
    names = [f"m{i:03}" for i in range(300)]
    pairs = [("e", m) for m in names] + [(a, b) for a in names for b in names if a != b]
    got = [list(r.nodes) for r in graph.call_paths(edges_of(spark, pairs), nodes_of(spark, ["e"])).orderBy("rank").collect()]
    assert got == [["e", "m000", "m001", "m002", m] for m in ("m003", "m004", "m005")]
    assert sum(kept) < 1_000_000


def test_cycles_are_given_once_from_their_least_node(spark, walk):
    e = edges_of(spark, [("b", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("x", "y"), ("p", "q"), ("q", "r"), ("r", "s"), ("s", "t"), ("t", "u"), ("u", "p")])
    on = graph.cyclic(e)
    assert {r.path for r in on.collect()} == set("abcpqrstu")
    assert [list(r.nodes) for r in graph.cycles(e, on).collect()] == [["a", "b"], ["a", "b", "c"]]  # p to u is too long
    text = report.cycles(on, e)
    assert "1. `a` -> `b`\n2. `a` -> `b` -> `c`\n" in text and "Files on longer chains:\n\n- `p`\n- `q`" in text
    assert report.cycles(on.limit(0), e) == ""
    assert {tuple(r) for r in graph.importers(e.limit(2)).collect()} == {("a", "b"), ("b", "a")}
    assert tuple(graph.counts(nodes_of(spark, ["a", "b", "b"]), e).first()) == (2, 12)


# -- ranking and budget


SIGNALS = "path string, freq long, fan_in long, recency double, proximity double, symbols int, depth double, cyclic boolean"


def test_scores(spark):
    rows = [("main", 50, 1, 0.9, 1.0, 1, 0.2, False), ("utils", 30, 1, 0.5, 0.5, 1, 0.2, False), ("config", 5, 1, 0.1, 0.5, 1, 0.2, True), ("test", 10, 0, 0.3, 0.5, 1, 0.2, False)]
    got = {r.path: r.score for r in rank.score(spark.createDataFrame(rows, SIGNALS)).collect()}
    assert max(got, key=got.get) == "main" and all(0 <= s <= 1 for s in got.values())
    assert got["main"] == 1.0 and got["config"] == round(0.4 * 0 + 0.4 - 0.1, 6)
    again = {r.path: r.score for r in rank.score(spark.createDataFrame(rows[::-1], SIGNALS).repartition(3)).collect()}
    assert again == got
    assert rank.score(spark.createDataFrame([], SIGNALS)).count() == 0


def test_profiles_change_the_order(spark):
    rows = [("core", 1, 3, 500.0, 0.5, 15, 0.2, False), ("fresh", 90, 0, 1.0, 1.0, 1, 0.2, False)]
    best = lambda task: rank.score(spark.createDataFrame(rows, SIGNALS), task).orderBy(F.desc("score")).first().path
    assert best("refactor") == "core" and best("debug") in ("core", "fresh")
    young = [(p, f, i, 1 / (1 + d), x, s, y, c) for p, f, i, d, x, s, y, c in rows]
    assert rank.score(spark.createDataFrame(young, SIGNALS), "debug").orderBy(F.desc("score")).first().path == "fresh"


def brute_tiers(scores):
    s = sorted(scores, reverse=True)
    n = len(s)
    t1, t2 = s[max(1, int(n * 0.15)) - 1], s[min(max(2, int(n * 0.45)), n) - 1]
    return [1 if x >= t1 else 2 if x >= t2 else 3 for x in scores]


@pytest.mark.parametrize("scores", [[0.9, 0.5, 0.1], [0.5], [0.5, 0.5], [i / 100 for i in range(40)], [round((i * 7 % 10) / 10, 1) for i in range(33)]])
def test_tiers(spark, scores):
    df = spark.createDataFrame([(str(i), float(s)) for i, s in enumerate(scores)], "path string, score double").repartition(3)
    got = {r.path: r.tier for r in rank.tiers(df).collect()}
    assert [got[str(i)] for i in range(len(scores))] == brute_tiers(scores)


def brute_fill(rows, cap):
    out, left = {}, cap
    for p, s, t, n in sorted(rows, key=lambda r: (r[2], -r[1], r[0])):
        if t < 3 and left > 0:
            out[p] = min(n, left)
            left -= out[p]
        elif t == 3 and 0 < left >= n:
            out[p] = n
            left -= n
    return out


@pytest.mark.parametrize("seed", range(6))
def test_fill_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(f"p{i:02}", rng.randrange(5) / 4, rng.choice((1, 2, 3, 3)), rng.randrange(1, 60)) for i in range(40)]
    df = spark.createDataFrame(rows, "path string, score double, tier int, tokens int").repartition(4)
    cap = (0, 50, 400, 700, 900, 5000)[seed]
    assert {r.path: r.charged for r in budget.fill(df, cap).collect()} == brute_fill(rows, cap)


@pytest.mark.parametrize("step", [1, 3, 100])
@pytest.mark.parametrize("seed", range(6))
def test_fill_where_one_score_has_nearly_all(spark, monkeypatch, seed, step):
    monkeypatch.setattr(budget, "STEP", step)
    rng = random.Random(seed)
    rows = [(f"p{i:02}", 0.0 if rng.random() < 0.9 else 0.5, rng.choice((2, 3, 3, 3)) if seed % 2 else 3, rng.choice((1, 2, 5, 40, 90))) for i in range(60)]
    df = spark.createDataFrame(rows, "path string, score double, tier int, tokens int").repartition(4)
    cap = (30, 61, 200, 333, 1, 800)[seed]
    filled = budget.fill(df, cap)
    assert {r.path: r.charged for r in filled.collect()} == brute_fill(rows, cap)


# -- similarity


def test_relevance(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0]), ("d", [0.0, 0.0])]
    got = semantic.relevance(spark.createDataFrame(rows, "path string, embedding array<float>"), [2.0, 0.0])
    assert {r.path: r.relevance for r in got.collect()} == {"a": 1.0, "b": 0.5, "c": 0.0, "d": 0.5}
    assert [r.path for r in semantic.top(got, 3, "path").collect()] == ["a", "b", "d"]


def test_embeddings_are_kept_by_hash(spark):
    def encode(texts):
        return [[float(len(t)), 1.0, 2.0] for t in texts]

    texts = spark.createDataFrame([("a", "h1", "xx"), ("b", "h2", "yyy")], "file_path string, file_hash string, text string")
    kept = spark.createDataFrame([("a", "h1", [9.0, 9.0, 9.0]), ("b", "old", [8.0, 8.0, 8.0]), ("gone", "h", [7.0, 7.0, 7.0])], semantic.EMBEDDINGS)
    got = {r.file_path: list(r.embedding) for r in semantic.embed(texts, encode, kept, 3).collect()}
    assert got == {"a": [9.0, 9.0, 9.0], "b": [3.0, 1.0, 2.0]}
    other = {r.file_path: list(r.embedding) for r in semantic.embed(texts, encode, kept, 4).collect()}
    assert other["a"] == [2.0, 1.0, 2.0]
    new = semantic.embed(texts, encode, kept, 3)
    assert {r.file_path for r in semantic.refresh(kept, new, texts.select(F.col("file_path").alias("path"))).collect()} == {"a", "b"}


def test_eviction_of_nothing(spark):
    kept = spark.createDataFrame([("a",)], "k string")
    assert cache.evicted(kept, kept.limit(0), "k").count() == 1


# -- rendering and reports


def test_summaries_shrink_until_they_fit():
    symbols = [{"name": f"f{i}", "kind": "function", "signature": f"def f{i}()", "short": f"def f{i}()", "docstring": "Does it. " * 6, "bases": "", "children": []} for i in range(20)]
    full = render.summarize("a/b_c.py", [], [f"m{i}" for i in range(9)], symbols[:3], ["X = 1"], ["large file (400 lines)"], render.estimated)
    assert full.startswith("### `a/b_c.py`\n\n**Purpose:** Implements b c.\n**Depends on:** `m0`") and "+1 more" in full and "## Constants" in full and "**Notes:** large" in full
    for n in (3, 12, 20):
        got = render.summarize("a.py", ["Purpose here.\nmore"], [], symbols[:n], [], [], render.estimated)
        assert render.estimated(got) <= config.SUMMARY_TOKENS and "**Purpose:** Purpose here.\n" in got
    huge = render.summarize("a.py", ["x" * 2000], [], symbols, [], [], render.estimated)
    assert huge.count("- `def") == 4


def test_one_liners(spark):
    rows = [(["First line\nsecond"], ["class"], 0, 5), ([], ["function", "class", "function"], 2, 9), ([], [], 0, 1)]
    df = spark.createDataFrame(rows, "d array<string>, k array<string>, n int, lines int").withColumn("s", F.transform("k", lambda k: F.struct(k.alias("kind")))).withColumn("i", F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), F.col("n")))
    assert [r[0] for r in df.select(render.one_liner(F.col("d"), F.col("s"), F.col("i"), F.col("lines"))).collect()] == ["First line", "1 class, 2 functions, 2 imports, 9 lines", "1 lines"]


def included(spark):
    rows = [("main.py", 1, 0.9, "python", "### `main.py`\n\nrun\n", 10), ("b/x.py", 2, 0.5, "python", "### `b/x.py`\n\n> doc\n", 20), ("tests/t.py", 3, 0.1, "python", "- `tests/t.py` — one\n", 30)]
    return spark.createDataFrame(rows, "path string, tier int, score double, language string, content string, token_count long")


def test_sections(spark):
    symbols = spark.createDataFrame([("main.py", 0, "run", "function", []), ("b/x.py", 0, "K", "class", ["m"]), ("tests/t.py", 0, "t", "function", [])], "path string, pos int, name string, kind string, children array<string>")
    e = edges_of(spark, [("main.py", "b/x.py"), ("tests/t.py", "main.py")])
    found = graph.call_paths(e, nodes_of(spark, ["main.py"]))
    first, again = (report.sections(included(spark), e, nodes_of(spark, []), symbols, found) for _ in range(2))
    assert list(first) == list(config.SECTIONS) and first == again
    assert first["architecture"].split("\n")[2] == "A python-based project composed of the following subsystems:"
    assert "f0 --> f1" in first["dependency_graph"] and "tests" not in first["dependency_graph"]
    assert first["symbol_index"] == "## SYMBOL_INDEX\n\n**`main.py`**\n- `run()`\n\n**`b/x.py`**\n- class `K`\n  - `m()`\n\n"
    assert "main.run()\n  → x.K()" in first["important_call_paths"]
    assert "| `main.py` | 0.900 | full source | 10 |" in first["ranked_files"]
    assert first["core_modules"].endswith("*No core modules selected within budget.*\n\n")


def test_payload(spark):
    symbols = spark.createDataFrame([("main.py", "run"), ("b/x.py", "run"), ("gone.py", "lost")], "path string, name string")
    got = json.loads(report.payload(included(spark), symbols, 7, "/r", 100, "now", "1"))
    assert [f["tier"] for f in got["files"]] == ["CORE", "SUPPORTING", "PERIPHERAL"]
    assert got["files"][0] == {"path": "main.py", "tier": "CORE", "tokens": 10, "rank_score": 0.9, "summary": "run", "included": True}
    assert got["symbol_index"] == {"run": "b/x.py"}
    assert got["stats"] == {"total_files": 7, "included_files": 3, "total_tokens": 60, "core_count": 1, "supporting_count": 1, "peripheral_count": 1}


# -- vector index


def near_of(rows, query, k):
    rows = [(i, v) for i, v in rows if v is not None]
    size = lambda v: sum(x * x for x in v) ** 0.5
    far = {i: 1.0 if not size(v) else 1 - max(min(sum(a * b for a, b in zip(v, query, strict=True)) / (size(v) * size(query)), 1), -1) for i, v in rows}
    most = max(far.values()) or 1.0
    got = sorted(((-round(max(1 - d / most, 0), 6), i) for i, d in far.items()))[:k]
    return [(i, -r) for r, i in got if r < 0]


@pytest.mark.parametrize("seed", range(3))
def test_a_search_by_cells_is_exact_and_reads_some(spark, seed):
    rng = random.Random(seed)
    hearts = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(30)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in hearts[i % 30]]) for i in range(1500)]
    rows += [(2000, [0.0] * 12), (2001, None), (2002, rows[3][1]), (2003, rows[3][1]), (2004, [2 * x for x in rows[3][1]])]
    index = vectors.build(spark.createDataFrame(rows, "id long, embedding array<float>"))
    plain = [(i, None if v is None else [struct.unpack("f", struct.pack("f", x))[0] for x in v]) for i, v in rows]
    for query in (rows[3][1], hearts[7], [-x for x in hearts[1]]):
        got = index.search(query, 7, "id")
        assert [(r.id, r.relevance) for r in got.collect()] == [(i, pytest.approx(x, abs=2e-6)) for i, x in near_of(plain, query, 7)]
        assert len(index.probed) < len(index.cells) / 2
    assert "PartitionFilters: [isnotnull(cell" in got._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [cell" in got._jdf.queryExecution().executedPlan().toString()


def test_odd_vectors(spark):
    none = vectors.build(spark.createDataFrame([], "id long, embedding array<float>"))
    assert none.search([1.0, 2.0], 3, "id").count() == 0
    zero = vectors.build(spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "id long, embedding array<float>"))
    assert zero.search([1.0, 2.0], 3, "id").count() == 0
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)] + [(50, [0.0, 1.0])], "id long, embedding array<float>")
    same = vectors.build(rows)
    for query in ([1.0, 0.0], [1.0, 1.0], [0.0, 3.0]):
        want = [r.id for r in semantic.top(semantic.relevance(rows, query), 3, "id").collect()]
        assert [r.id for r in same.search(query, 3, "id").collect()] == want
    assert same.search([0.0, 0.0], 3, "id").count() == 0
    with pytest.raises(Exception, match="numbers"):
        vectors.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id long, embedding array<float>"))
