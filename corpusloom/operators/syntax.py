"""Declarations of languages other than Python, by tables of productions.

A file's tokens are folded bottom-up: what stands between a pair of brackets (in Ruby between a word that
opens a block and its ``end``) becomes one item of the level around it. A level is then a row of items in
one line, words as they are, ``§`` for a string, ``()`` ``[]`` ``{}`` for what was folded and ``⏎`` where a line
ends that can end a statement. On such rows productions (node type, pattern) tell nodes, so that a head over
several lines, nested members and brackets within types make no difference. Which node types are symbols
and of what kind is a syntax query's to say (``SPECS``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

W = r"[A-Za-z_$][\w$]*"
_TOKEN = re.compile(rf"{W}|\d[\w.]*|=>|::|->|\n|[^\s\w]|[^\W\d_]+")
#: A line for the preprocessor of C, with those that continue it.
_DIRECTIVE = re.compile(r"^[ \t]*#(?:\\.|[^\\\n])*", re.M | re.S)
_CLOSERS = {"(": ")", "[": "]", "{": "}"}
#: Fixed: words that open a block in Ruby, those that do so only where a statement begins, and those that end one.
RUBY_OPEN, RUBY_FIRST = frozenset(("def", "class", "module", "begin", "do", "case", "for")), frozenset(("if", "unless", "while", "until"))
#: Languages in which a line's end can end a statement.
LINES = frozenset(("javascript", "typescript", "go", "ruby"))


@dataclass
class Item:
    """A token, or what was folded: its items in order. ``start`` and ``end`` are places in the source."""

    text: str
    start: int
    end: int
    inner: list[Item] = field(default_factory=list)


@dataclass
class Node:
    type: str
    name: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)


def tokens(code: str, strings: list[tuple[int, int]]) -> list[Item]:
    """Of a source whose comments and strings are blanked out, and the places of its strings."""
    found = [Item(m[0], m.start(), m.end()) for m in _TOKEN.finditer(code)]
    return sorted(found + [Item("§", x, y) for x, y in strings], key=lambda t: t.start)


def fold(row: list[Item], language: str) -> list[Item]:
    """The top level's items. Brackets that don't close end with the file, stray closing ones are dropped."""
    top: list[Item] = []
    stack: list[tuple[Item, str, list[Item]]] = []
    level = top
    lines = language in LINES
    loop = False
    for i, t in enumerate(row):
        if t.text == "\n":
            loop = False
            if lines and (not stack or stack[-1][1] in ("}", "end") or language == "go"):
                level.append(Item("⏎", t.start, t.end))
            continue
        word = language == "ruby" and t.text.isidentifier() and not (i and row[i - 1].text in (".", ":", "::")) and not (i + 1 < len(row) and row[i + 1].text == ":" and row[i + 1].start == t.end)
        first = not level or level[-1].text in ("⏎", ";", "=", "()", "then", "do")
        close = _CLOSERS.get(t.text)
        if word and t.text == "do" and loop:
            loop = False  # of the loop that this line began
        elif word and t.text == "def" and _endless(row, i):
            level.append(t)
            continue
        elif word and (t.text in RUBY_OPEN or t.text in RUBY_FIRST and first) and not (t.text == "class" and i + 1 < len(row) and row[i + 1].text == "<"):
            loop = t.text in ("while", "until", "for")
            level.append(t)
            group = Item("{}", t.end, t.end)
            stack.append((group, "end", level))
            level = group.inner
            continue
        if close:
            group = Item(t.text + close, t.start, t.end)
            level.append(group)
            stack.append((group, close, level))
            level = group.inner
        elif t.text in (")", "]", "}") or word and t.text == "end":
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == t.text), None)
            if k is not None:
                for group, kind, outer in reversed(stack[k:]):
                    group.end, level = t.end, outer
                    if kind == "end":
                        level.append(group)
                del stack[k:]
        else:
            level.append(t)
    for group, kind, outer in reversed(stack):
        group.end = row[-1].end
        if kind == "end":
            outer.append(group)
    return top


def _endless(row: list[Item], i: int) -> bool:
    """Whether Ruby's ``def`` at a place has its value after an equals sign, and no end."""
    j, depth = i + 1, 0
    while j < len(row) and row[j].text != "\n":
        depth += (row[j].text == "(") - (row[j].text == ")")
        if row[j].text == "=" and not depth:
            return row[j - 1].end < row[j].start and row[j].end < (row[j + 1].start if j + 1 < len(row) else 0)
        if j > i + 1 and not depth and row[j - 1].end < row[j].start and row[j].text not in ("(", ")"):
            return False
        j += 1
    return False


_START = r"(?<=[;⏎}] )"  # every row begins with a line's end
_GENERIC = r"(?:< [^(;{]*?> )?"
_JAVA_WORDS = "public protected private static final abstract synchronized native default strictfp sealed return new else throw assert yield case import package class interface enum record extends implements throws instanceof goto break continue do"
_JAVA_NOT = rf"(?!(?:{'|'.join(_JAVA_WORDS.split())})\b)"
_JAVA_MODS = rf"(?:@ (?!interface\b){W}(?: \. {W})*(?: \(\))? |(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp|sealed|non - sealed) )*"
_C_PART = rf"(?:{W}|::|\*|&|<|>|,|\[\]|~|\d+)"
#: Node types that stand at a file's top, by language, in the order in which they are tried: a production's
#: group ``node`` is the node, ``name`` its name.
TOP: dict[str, tuple[tuple[str, str], ...]] = {
    "javascript": (
        ("function_declaration", rf"{_START}(?:export )?(?:default )?(?P<node>(?:async )?function (?:\* )?(?P<name>(?:{W})?) ?{_GENERIC}\(\)(?: : [^;⏎]*?)? \{{\}})"),
        ("class_declaration", rf"{_START}(?:@ {W}(?: \(\))? (?:⏎ )?)*(?:export )?(?:default )?(?:abstract )?(?P<node>class (?P<name>(?!extends\b){W})(?: [^;{{]*?)? ?\{{\}})"),
        ("lexical_declaration", rf"{_START}(?P<node>(?:const|let) (?P<name>{W})(?: : [^;⏎=]*?(?:=> [^;⏎=]*?)?)? = (?:⏎ )?(?:async )?(?:function (?:\* )?(?:{W} )?\(\) \{{\}}|{_GENERIC}(?:\(\)|{W})(?: : [^;⏎=]*?)? => (?:⏎ )?(?:\{{\}}|[^;⏎]*)))"),
    ),
    "go": (
        ("function_declaration", rf"{_START}(?P<node>func (?P<name>{W})(?: \[\])? \(\)[^⏎;]*)"),
        ("method_declaration", rf"{_START}(?P<node>func \(\) (?P<name>{W}) \(\)[^⏎;]*)"),
        ("type_spec", rf"{_START}type (?P<node>(?P<name>{W})(?! =)[^⏎;]*)"),
    ),
    "rust": (
        ("function_item", rf"{_START}(?:# \[\] )*(?P<node>(?:pub(?: \(\))? )?(?:async |const |unsafe |extern (?:§ )?)*fn (?P<name>{W})[^;{{]*\{{\}})"),
        ("struct_item", rf"{_START}(?:# \[\] )*(?P<node>(?:pub(?: \(\))? )?struct (?P<name>{W})[^;{{]*(?:\{{\}}|;))"),
        ("enum_item", rf"{_START}(?:# \[\] )*(?P<node>(?:pub(?: \(\))? )?enum (?P<name>{W})[^;{{]*\{{\}})"),
        ("trait_item", rf"{_START}(?:# \[\] )*(?P<node>(?:pub(?: \(\))? )?(?:unsafe )?trait (?P<name>{W})[^;{{]*\{{\}})"),
        ("impl_item", rf"{_START}(?:# \[\] )*(?P<node>(?:unsafe )?impl {_GENERIC}(?:! )?(?P<name>{W})[^;{{]*\{{\}})"),
    ),
    "c": (
        ("struct_specifier", rf"{_START}(?:typedef )?(?P<node>struct (?P<name>{W}) \{{\}})"),
        ("function_definition", rf"{_START}(?P<node>(?!(?:typedef|return|else|enum)\b)(?:{_C_PART} )+?(?P<name>{W}) \(\)(?: {W}| \(\))* \{{\}})"),
    ),
    "cpp": (
        ("class_specifier", rf"{_START}(?:template < [^;{{(]*> )?(?:typedef )?(?P<node>(?:class|struct) (?:{W} |\(\) |\[\] )*?(?P<name>{W})(?: final)?(?: : [^;{{]*?)? \{{\}})"),
        ("function_definition", rf"{_START}(?P<node>(?!(?:typedef|return|else|enum|namespace|using)\b)(?:{_C_PART} )*?(?P<name>(?:{W} :: )*(?:operator (?:\(\)|\[\]|[^\s\w(]+(?: [^\s\w(]+)*|{W}(?: \*)?)|~? ?{W})) \(\)(?: (?:{_C_PART}|:|->|\(\)|§|\{{\}}(?= ,| \{{)))* \{{\}})"),
    ),
    "ruby": (
        ("class", rf"{_START}(?P<node>class \{{\}})"),
        ("method", rf"{_START}(?:{W} )?(?P<node>def (?:\{{\}}|(?:self \. )?{W}(?: [?!])?(?: \(\))? = [^⏎;]*))"),
    ),
}
TOP["typescript"] = TOP["javascript"]
#: Members of a class's body.
MEMBERS = {
    "javascript": (("method_definition", rf"{_START}(?:@ {W}(?: \(\))? (?:⏎ )?)*(?P<node>(?:(?:public|private|protected|static|async|get|set|readonly|override|\*) )*(?P<name>(?!(?:if|for|while|switch|catch|function|return)\b){W}) {_GENERIC}\(\)(?: : [^;⏎]*?)? \{{\}})"),),
}
MEMBERS["typescript"] = MEMBERS["javascript"]
#: Java's types, at any depth, and the methods of their bodies.
JAVA_TYPES = re.compile(rf"(?P<node>{_JAVA_MODS}(?P<what>class|interface|enum|record) (?P<name>{W})(?: [^;{{]*?)? ?\{{\}})|new (?:{W}|\.|<|>|,|\?| )*? ?\(\) \{{\}}")
JAVA_METHOD = re.compile(rf"{_START}(?P<node>{_JAVA_MODS}(?:< [^(;{{]*?> )?{_JAVA_NOT}{W}(?: (?:\.|<|>|,|\?|&|\[\]|@|{W}))*? (?P<name>{_JAVA_NOT}{W}) \(\)(?: \[\])*(?: throws [^;{{]*?)?(?: \{{\}}| ;| default [^;]*;))")
#: What is an import, a function and a class, in the form of syntax queries.
SPECS = {
    "javascript": "(function_declaration) @function (lexical_declaration) @function (class_declaration) @class",
    "go": "(function_declaration) @function (method_declaration) @function (type_spec) @class",
    "rust": "(function_item) @function (struct_item) @class (enum_item) @class (impl_item) @class (trait_item) @class",
    "java": "(method_declaration) @function (class_declaration) @class",
    "c": "(function_definition) @function (struct_specifier) @class",
    "cpp": "(function_definition) @function (class_specifier) @class",
    "ruby": "(method) @function (class) @class",
}
SPECS["typescript"] = SPECS["javascript"]


@dataclass
class Row:
    """A level in one line, and each item's place in it."""

    items: list[Item]
    line: str = ""
    at: dict[int, int] = field(default_factory=dict)
    upto: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        parts, place = ["⏎"], 2
        for i, t in enumerate(self.items):
            parts.append(t.text)
            self.at[place] = i
            self.upto[place + len(t.text)] = i
            place += len(t.text) + 1
        self.line = " ".join(parts)

    def span(self, m: re.Match, group: str = "node") -> tuple[int, int]:
        """First and last item of a match's group."""
        text = m[group]
        lo, hi = m.start(group) + len(text) - len(text.lstrip()), m.end(group) - len(text) + len(text.rstrip())
        while self.items[self.upto[hi]].text == "⏎":
            hi -= 2
        return self.at[lo], self.upto[hi]

    def nodes(self, productions: tuple[tuple[str, str], ...]) -> list[tuple[Node, list[Item]]]:
        """(node, its items), in order; what one production took is no other's."""
        out, taken = [], []
        for kind, pattern in productions:
            for m in re.finditer(pattern, self.line):
                lo, hi = self.span(m)
                if all(hi < x or lo > y for x, y in taken):
                    taken.append((lo, hi))
                    own = self.items[lo : hi + 1]
                    name = m["name"].replace(" ", "") if "name" in m.groupdict() else ""
                    out.append((Node(kind, name, own[0].start, own[-1].end), own))
        return sorted(out, key=lambda x: x[0].start)


def _java(items: list[Item], members: bool) -> list[Node]:
    row, out = Row(items), []
    bodies: dict[int, bool] = {}
    for m in JAVA_TYPES.finditer(row.line):
        body = row.upto[m.end()]
        bodies[body] = True
        if m["what"] == "class":
            lo, hi = row.span(m)
            out.append(Node("class_declaration", m["name"], items[lo].start, items[hi].end))
    if members:
        for node, _ in row.nodes((("method_declaration", JAVA_METHOD.pattern),)):
            out.append(node)
    for i, t in enumerate(items):
        if t.inner:
            out += _java(t.inner, bodies.get(i, False))
    return sorted(out, key=lambda n: (n.start, -n.end))


def _ruby_name(own: list[Item], source: str) -> str:
    m = re.match(r"(?:def|class)[ \t]+(?P<name>[\w.:]*(?:[?!](?!=)|=(?=\())?|[^\s\w(]+)", source[own[0].start :])
    return m["name"] if m else ""


def nodes(code: str, source: str, strings: list[tuple[int, int]], language: str) -> list[Node]:
    """The nodes of a file that its language's symbols are made of, classes with their members."""
    if language in ("c", "cpp"):
        kept = _DIRECTIVE.sub(lambda m: " " * len(m[0]), code)
        code, strings = kept, [x for x in strings if code[code.rfind("\n", 0, x[0]) + 1 : x[0]].lstrip()[:1] != "#"]
    top = fold(tokens(code, strings), language)
    if language == "java":
        return _java(top, False)
    out = []
    for node, own in Row(top).nodes(TOP[language]):
        if language == "ruby":
            node.name = _ruby_name(own, source)
        if node.type == "class_declaration" and language in MEMBERS:
            node.children = [n for n, _ in Row(own[-1].inner).nodes(MEMBERS[language])]
        out.append(node)
    if language == "go":  # specs of a group
        for i, t in enumerate(top[:-1]):
            if t.text == "type" and top[i + 1].text == "()":
                out += [n for n, _ in Row(top[i + 1].inner).nodes((("type_spec", rf"{_START}(?P<node>(?P<name>{W})(?! =) [^⏎;]+)"),))]
    return sorted(out, key=lambda n: n.start)
