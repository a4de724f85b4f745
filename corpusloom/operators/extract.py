"""From a file's text to its imports, symbols, docstrings and used names.

Python files go through Python's own parser; other languages through tables of productions (``syntax``) over
their tokens, with comments and strings told apart first, and are marked as partly parsed. A file that can't be parsed keeps what patterns find and is marked as failed. Batches of
files are parsed where they lie, each on its own.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from . import syntax

_METHOD = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "kind", "signature", "docstring")] + [T.StructField(n, T.IntegerType()) for n in ("start_line", "end_line")])
SYMBOL = T.StructType([*_METHOD.fields, T.StructField("children", T.ArrayType(_METHOD))])
FACETS = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("imports", T.ArrayType(T.StringType())), T.StructField("symbols", T.ArrayType(SYMBOL)),
    T.StructField("docstrings", T.ArrayType(T.StringType())), T.StructField("usages", T.ArrayType(T.StringType())), T.StructField("constants", T.ArrayType(T.StringType())),
    T.StructField("partial_parse", T.BooleanType()), T.StructField("parse_failed", T.BooleanType()),
])


def _symbol(name: str, kind: str, signature: str, doc: str, start: int, end: int, children: list | None = None) -> dict:
    out = {"name": name, "kind": kind, "signature": signature, "docstring": doc, "start_line": start, "end_line": end}
    return out if kind == "method" and children is None else out | {"children": children or []}


# -- Python -----------------------------------------------------------------------------------------


def _python(source: str) -> dict[str, Any]:
    tree = ast.parse(source)

    def segment(node: ast.AST | None) -> str:
        return (ast.get_source_segment(source, node) or "") if node is not None else ""

    def doc(node) -> str:
        return (ast.get_docstring(node, clean=False) or "").strip()

    def function(node, kind: str) -> dict:
        head = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
        back = f" -> {segment(node.returns)}" if node.returns is not None else ""
        return _symbol(node.name, kind, f"{head} {node.name}({ast.unparse(node.args)}){back}", doc(node), node.lineno, node.end_lineno, None if kind == "method" else [])

    symbols, constants, named = [], [], []
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            symbols.append(function(node, "function"))
        elif isinstance(node, ast.ClassDef):
            methods = [function(x, "method") for x in node.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)]
            above = [segment(x) for x in node.bases] + [f"{k.arg}={segment(k.value)}" if k.arg else f"**{segment(k.value)}" for k in node.keywords]
            symbols.append(_symbol(node.name, "class", f"class {node.name}" + (f"({', '.join(above)})" if above else ""), doc(node), node.lineno, node.end_lineno, methods))
        elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            named.append((node.targets[0].id, "", node.value))
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name) and node.value is not None:
            named.append((node.target.id, f": {segment(node.annotation).strip()}", node.value))
    for name, annotation, value in named:
        if re.fullmatch(r"[A-Z][A-Z0-9_]*", name) or not symbols:
            shown = segment(value)
            constants.append(f"{name}{annotation} = {shown.strip() if shown.strip() and len(repr(shown)) <= 80 else '<complex expression>'}")

    imports = [(n.lineno, n.col_offset, segment(n)) for n in ast.walk(tree) if isinstance(n, ast.Import | ast.ImportFrom)]
    used: set[str] = set()
    for n in ast.walk(tree):
        near: list[ast.AST | None] = []
        if isinstance(n, ast.Call):
            near = [n.func, *n.args, *(k.value for k in n.keywords)]
        elif isinstance(n, ast.ClassDef):
            near = [*n.bases, *n.decorator_list]
        elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            near = [n.returns, *n.decorator_list]
        elif isinstance(n, ast.arg | ast.AnnAssign):
            near = [n.annotation]
        used.update(x.id for x in near if isinstance(x, ast.Name))
        if isinstance(n, ast.ClassDef):
            used.add(n.name)
    first = ast.get_docstring(tree, clean=False)
    return {"imports": [x for *_, x in sorted(imports)], "symbols": symbols, "docstrings": [first] if first else [], "usages": sorted(used), "constants": constants, "partial_parse": False, "parse_failed": False}


# -- other languages --------------------------------------------------------------------------------

def _signs(comments: str, strings: str) -> re.Pattern:
    return re.compile(f"(?P<comment>{comments})|(?P<string>{strings})", re.S)


_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE, _LETTER = r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)', r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)", r"'(?:\\[^\n]{1,9}?|[^'\\\n])'"
_TICKS = r"`(?:\\.|[^`\\])*(?:`|\Z)"
#: A regular expression literal stands where a value is expected.
_REGEX = r"(?<=[=(,:\[!&|?{;])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"
#: Comments and strings of each language.
SIGNS = {
    "javascript": _signs(f"{_LINE}|{_BLOCK}", f"{_DOUBLE}|{_SINGLE}|{_TICKS}|{_REGEX}"),
    "go": _signs(f"{_LINE}|{_BLOCK}", rf"{_DOUBLE}|{_LETTER}|`[^`]*(?:`|\Z)"),
    "rust": _signs(f"{_LINE}|{_BLOCK}", rf'r(?P<hashes>\#+)".*?(?:"(?P=hashes)|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|{_LETTER}'),
    "java": _signs(f"{_LINE}|{_BLOCK}", rf'"""(?:\\.|[^\\])*?(?:"""|\Z)|{_DOUBLE}|{_LETTER}'),
    "c": _signs(f"{_LINE}|{_BLOCK}", f"{_DOUBLE}|{_LETTER}"),
    "cpp": _signs(f"{_LINE}|{_BLOCK}", rf'R"(?P<mark>[^\s()\\]*)\(.*?(?:\)(?P=mark)"|\Z)|{_DOUBLE}|{_LETTER}'),
    "ruby": _signs(r"(?m:^=begin\b).*?(?m:^=end\b[^\n]*|\Z)|(?m:(?<![\w\"'#])\#(?!\{)[^\n]*)", rf"<<[~-]?(?P<quote>['\"]?)(?P<word>[A-Z_]+)(?P=quote).*?\n[ \t]*(?P=word)(?=\n|\Z)|{_DOUBLE}|{_SINGLE}"),
}
SIGNS["typescript"] = SIGNS["javascript"]


def code_of(source: str, language: str) -> tuple[str, str]:
    """The source with comments and strings blanked out, and with comments and strings of several lines
    alone; every letter stays in its place."""
    blank = lambda t: re.sub(r"[^\n]", " ", t)
    code, kept, at = [], [], 0
    for m in SIGNS[language].finditer(source):
        between, own = source[at : m.start()], m[0]
        code += [between, blank(own)]
        kept += [between, blank(own) if m["comment"] is not None or "\n" in own else own]
        at = m.end()
    return "".join([*code, source[at:]]), "".join([*kept, source[at:]])


IMPORT_STATEMENTS = {
    "javascript": r"^[ \t]*import\b[^;'\"]*(?:from\s*)?['\"][^'\"]+['\"];?|\brequire\(\s*['\"][^'\"]+['\"]\s*\)",
    "rust": r"^[ \t]*(?:pub\s+)?use\s+[^;]+;",
    "java": r"^[ \t]*import\s+[^;]+;",
    "c": r"^[ \t]*#\s*include\s*[<\"][^>\"]+[>\"]",
    "ruby": r"^[ \t]*require(?:_relative)?\s*\(?\s*['\"][^'\"]+['\"]\)?",
}
IMPORT_STATEMENTS |= {"typescript": IMPORT_STATEMENTS["javascript"], "cpp": IMPORT_STATEMENTS["c"]}
_USED = re.compile(r"\b([A-Za-z_]\w*)\s*\(|[:(,<]\s*([A-Z]\w*)|\bnew\s+([A-Za-z_]\w*)|\b(?:extends|implements)\s+([A-Za-z_]\w*)")


def _go_imports(code: str, kept: str) -> list[str]:
    """Single imports, and the lines of import blocks."""
    out = []
    for m in re.finditer(r"^[ \t]*import\b[ \t]*(?:\(([^)]*)\)|(?:[\w.]+[ \t]+)?\"[^\"\n]+\")", kept, re.M):
        if not code[m.start() : m.end()].strip():
            continue
        out += [(m.start(), m[0].strip())] if m[1] is None else [(m.start(1) + x.start(), x[0].strip()) for x in re.finditer(r"(?:[\w.]+[ \t]+)?\"[^\"\n]+\"", m[1])]
    return [x for _, x in sorted(out)]


def _by_tables(source: str, language: str) -> dict[str, Any]:
    code, kept = code_of(source, language)
    kinds = {node: SPEC_KINDS[c] for node, c in spec_patterns(syntax.SPECS[language])}
    strings = [m.span() for m in SIGNS[language].finditer(source) if m["comment"] is None]
    ends = [m.start() for m in re.finditer("\n", source)]
    line_of = lambda at: bisect.bisect_left(ends, at) + 1
    symbols = []
    for node in syntax.nodes(code, source, strings, language):
        kind, head = kinds[node.type], source[node.start : node.end].split("\n")[0].rstrip(" {;")
        if node.type == "lexical_declaration":
            head = f"const {node.name} = ..."
        elif kind == "class" and language in ("javascript", "typescript"):
            head = f"class {node.name}"
        methods = [_symbol(x.name, "method", source[x.start : x.end].split("\n")[0].rstrip(" {"), "", line_of(x.start), line_of(x.end)) for x in node.children]
        kind = "method" if node.type == "method_declaration" and language == "go" else kind
        symbols.append(_symbol(node.name or "<anonymous>", kind, head, "", line_of(node.start), line_of(node.end), methods))
    if language == "go":
        imports = _go_imports(code, kept)
    else:  # an import begins with code, not within a string
        found = ((m, m.start() + len(m[0]) - len(m[0].lstrip())) for m in re.finditer(IMPORT_STATEMENTS[language], kept, re.M))
        imports = [m[0].strip() for m, at in found if not code[at].isspace()]
    used = sorted({x for groups in _USED.findall(code) for x in groups if x})
    return {"imports": imports, "symbols": symbols, "docstrings": [], "usages": used, "constants": [], "partial_parse": True, "parse_failed": False}


def _plain() -> dict[str, Any]:
    return {"imports": [], "symbols": [], "docstrings": [], "usages": [], "constants": [], "partial_parse": False, "parse_failed": False}


def _failed(source: str, language: str) -> dict[str, Any]:
    pattern = tx.IMPORT_LINES.get(language)
    doc = re.match(tx.DOCSTRING, source) if language == "python" else None
    names = dict.fromkeys(re.findall(tx.IDENTIFIER, source))
    return _plain() | {"imports": [x.strip() for x in source.splitlines() if pattern and re.match(pattern, x)], "docstrings": [doc[1].strip()] if doc else [], "usages": [n for n in names if n not in tx.KEYWORDS], "partial_parse": True, "parse_failed": True}


#: A language's parser: text to facets. More can be added on the driver, also in place of those here:
#: executors get those that are there when ``parse`` is called.
PARSERS: dict[str, Callable[[str], dict[str, Any]]] = {"python": _python} | {lang: (lambda s, lang=lang: _by_tables(s, lang)) for lang in syntax.SPECS}


def facets(source: str, language: str, parsers: dict[str, Callable[[str], dict[str, Any]]] | None = None) -> dict[str, Any]:
    """Of one file. A language without a parser has none; what a parser leaves out is empty."""
    parser = (PARSERS if parsers is None else parsers).get(language)
    if parser is None:
        return _plain()
    try:
        return _plain() | parser(source)
    except (SyntaxError, ValueError, RecursionError):
        return _failed(source, language)


def parse(files: DataFrame) -> DataFrame:
    """``files`` (path, language, text, ...) with their facets, lines and bytes. Facets ride beside the
    row's other columns, so nothing is joined."""
    rest, parsers = [f for f in files.schema.fields if f.name != "path"], dict(PARSERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [{"path": p} | facets(s, lang, parsers) for p, lang, s in zip(b["path"], b["language"], b["text"], strict=True)]
            yield pd.concat([pd.DataFrame(own, columns=FACETS.names), b[[f.name for f in rest]].reset_index(drop=True)], axis=1)

    parsed = files.mapInPandas(run, T.StructType([*FACETS.fields, *rest]))
    return parsed.withColumns({"line_count": tx.line_count(F.col("text")), "file_size_bytes": tx.byte_size(F.col("text"))})


_SPEC = re.compile(r";[^\n]*|\"(?:\\.|[^\"\\])*\"|[()\[\]]|@[A-Za-z0-9_]+|[^\s()\[\]@\";]+")
#: What a capture of a query makes of the node it stands after.
SPEC_KINDS = {"import": "import", "from_import": "import", "function": "function", "method": "function", "class": "class"}


def spec_patterns(text: str) -> list[tuple[str, str]]:
    """(node type, capture) of each outermost pattern of a syntax query that has a capture right after
    it: ``(function_definition name: (identifier) @name) @function``."""
    out, depth, node, closed = [], 0, None, False
    for token in _SPEC.findall(text):
        if token[0] in ";\"":
            continue
        if token == "(":
            depth += 1
            if depth == 1:
                node, closed = None, False
        elif token == ")":
            depth = max(depth - 1, 0)
            closed = depth == 0
        elif token[0] == "@":
            if closed and node:
                out.append((node, token[1:]))
            closed = False
        elif depth == 1 and node is None:
            node = token
        elif depth == 0:
            closed = False
    return out


def spec_types(specs: DataFrame) -> DataFrame:
    """Rows (language, kind, node_type) of syntax queries (language, text): which node types are imports,
    functions and classes, each once; other captures say nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(lang, SPEC_KINDS[c], n) for lang, t in zip(b["language"], b["text"], strict=True) for n, c in spec_patterns(t or "") if c in SPEC_KINDS], columns=["language", "kind", "node_type"])

    return specs.select("language", "text").mapInPandas(run, "language string, kind string, node_type string").distinct()


def health(parsed: DataFrame) -> DataFrame:
    """Files by language: all, parsed, failed."""
    return parsed.groupBy("language").agg(F.count("*").alias("total"), F.count_if(~F.col("parse_failed")).alias("success"), F.count_if(F.col("parse_failed")).alias("failed"))


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "language", F.posexplode("imports").alias("pos", "import_text"))


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.posexplode("symbols").alias("pos", "s")).select("path", "pos", "s.name", "s.kind", "s.signature", "s.docstring", "s.start_line", "s.end_line")


def usages(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("usages").alias("name")).where(tx.is_usage_name(F.col("name")))
