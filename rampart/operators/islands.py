"""Node rows for languages with braces: a tolerant lexer, a tree of brackets, and islands that are told within it.

No grammar is followed: declarations, calls, assignments, literals and names are recognised wherever they
stand, and what is not recognised is stepped over. So any text gives a tree, broken or not.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from . import syntax

#: Languages that are read so; of all others a source is one node.
BRACES = frozenset("javascript typescript java c cpp csharp go php rust kotlin swift scala".split())
TOKEN = re.compile(
    r"""(?P<space>[^\S\n]+|\\\n)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|(?m:^[^\S\n]*\#(?!include|\[)[^\n]*))
    |(?P<string>"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)|`(?:[^`\\]|\\.)*(?:`|\Z))|(?P<number>\d[\w.]*)
    |(?P<name>[$@#]?[^\W\d][\w$]*)|(?P<open>[(\[{])|(?P<close>[)\]}])
    |(?P<sign>=>|===?|!==?|<=|>=|:=|->|\?\.|::|&&|\|\||[-+*/%&|^]=|\+\+|--|.)""",
    re.X | re.S,
)
CLOSES = {"(": ")", "[": "]", "{": "}"}
#: Signs that join names to one, and those that set a name.
JOINS, SETS = {".", "->", "::", "?."}, {"=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="}
IMPORTS = {"import", "using", "use", "package", "include", "require", "#include", "include_once", "require_once"}
BLOCKS = {"if": "if", "for": "for", "foreach": "for", "while": "while", "switch": "if", "with": "with", "try": "try", "catch": "try", "synchronized": "with", "lock": "with"}
CLASSES = {"class", "interface", "struct", "enum", "trait", "impl", "namespace", "record"}
#: Words before an expression or a declaration that are no names.
WORDS = frozenset("new return throw await yield typeof delete void echo print const let var val static final public private protected async export default else do in of case mut auto unsafe".split())
DECLARES = {"const", "let", "var", "val", "auto"}
VALUES = {"true": "boolean", "false": "boolean", "True": "boolean", "False": "boolean", "null": "none", "nil": "none", "undefined": "none", "NULL": "none"}


@dataclass
class Node:
    kind: str
    start: int
    end: int
    name: str | None = None
    args: list[str] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)


class Group(list):
    """Tokens and groups between two brackets: (kind, text, start, end) or Group."""

    def __init__(self, opens: str, start: int):
        super().__init__()
        self.opens, self.start, self.end = opens, start, start


def _is(x, *texts: str) -> bool:
    return not isinstance(x, Group) and x[1] in texts


def brackets(text: str) -> Group:
    """The text's tokens as a tree; an end without its beginning is passed over, what is not ended ends with the text."""
    stack = [Group("", 0)]
    for m in TOKEN.finditer(text):
        kind = m.lastgroup
        if kind in ("space", "comment"):
            continue
        if kind == "open":
            stack.append(Group(m[0], m.start()))
            stack[-2].append(stack[-1])
        elif kind == "close":
            depth = next((k for k in range(len(stack) - 1, 0, -1) if CLOSES[stack[k].opens] == m[0]), 0)
            if depth:
                for g in stack[depth:]:
                    g.end = m.end()
                del stack[depth:]
        else:
            stack[-1].append((kind, m[0], m.start(), m.end()))
    for g in stack:
        g.end = len(text)
    return stack[0]


def _start(x) -> int:
    return x.start if isinstance(x, Group) else x[2]


def _end(x) -> int:
    return x.end if isinstance(x, Group) else x[3]


class _Islands:
    def __init__(self, text: str):
        self.text = text

    def _split(self, group: list, at: tuple[str, ...]) -> Iterator[list]:
        part: list = []
        for x in group:
            if _is(x, *at):
                yield part
                part = []
            else:
                part.append(x)
        yield part

    def statements(self, group: list) -> list[Node]:
        """The statements of a block: they end with a semicolon, a block in braces, or a line after which no sign goes on."""
        out, part = [], []
        after, follows = None, [None] * len(group)  # the next token that is no line's end
        for k in range(len(group) - 1, -1, -1):
            follows[k] = after
            after = after if _is(group[k], "\n") else group[k]

        def done() -> None:
            out.extend(self.statement(part))
            part.clear()

        for k, x in enumerate(group):
            if _is(x, ";"):
                done()
            elif _is(x, "\n"):
                after, last = follows[k], part[-1] if part else None
                ends = isinstance(last, Group) or last is not None and last[0] in ("name", "string", "number") and last[1] not in WORDS or _is(last, "++", "--") if part else False
                goes = after is None or isinstance(after, Group) and after.opens == "{" or not isinstance(after, Group) and after[0] == "sign"
                if part and ends and not goes or part and after is None:
                    done()
            else:
                part.append(x)
                if isinstance(x, Group) and x.opens == "{" and not any(_is(y, *SETS, "return", "=>") for y in part):
                    done()
        done()
        return out

    def statement(self, part: list) -> list[Node]:
        while part and not isinstance(part[0], Group) and part[0][1] in {"else", "do", "export", "default", "public", "private", "protected", "static", "final", "async", "finally", "unsafe", "defer"}:
            part = part[1:]
        if not part:
            return []
        first, start, end = part[0], _start(part[0]), _end(part[-1])
        word = first[1] if not isinstance(first, Group) else ""
        body = part[-1] if isinstance(part[-1], Group) and part[-1].opens == "{" else None
        if isinstance(first, Group) and len(part) == 1 and first.opens == "{":
            return [Node("block", start, end, children=self.statements(first))]
        if word in IMPORTS:
            return [Node("import", start, end)]
        if word in BLOCKS and len(part) > 1:
            heads = [x for x in part[1:] if isinstance(x, Group) and x.opens == "("][:1]
            rest = part[part.index(heads[0]) + 1 :] if heads else [x for x in part[1:] if x is not body]
            inner = [n for h in heads for piece in self._split(h, (";",)) for n in self.statement([x for x in piece if not _is(x, "\n")])]
            inner += self.statements(body) if body else self.statement(rest)
            return [Node(BLOCKS[word], start, end, children=inner)]
        names = [x for x in part if not isinstance(x, Group) and x[0] == "name"]
        kind = next((k for k, x in enumerate(part) if _is(x, *CLASSES)), None)
        if body is not None and kind is not None and kind + 1 < len(part):
            name = part[kind + 1][1] if not isinstance(part[kind + 1], Group) else None
            return [Node("class_def", start, end, name, children=self.statements(body))]
        set_at = next((k for k, x in enumerate(part) if _is(x, *SETS)), None)
        if body is not None and set_at is None and not any(_is(x, "=>") for x in part):
            params = next((k for k, x in enumerate(part) if isinstance(x, Group) and x.opens == "("), None)
            if params and not isinstance(part[params - 1], Group) and part[params - 1][0] == "name" and not _is(part[0], "new", "return"):
                name = part[params - 1][1]
                return [Node("function_def", start, end, None if name in ("function", "func", "fn") else name, children=[*self.parameters(part[params]), *self.statements(body)])]
        if word == "return":
            return [Node("return", start, end, children=self.value(part[1:]))]
        if set_at and names:
            return self.assignment(part, set_at, start, end)
        return self.value(part)

    def parameters(self, group: Group) -> list[Node]:
        found = []
        for piece in self._split(group, (",",)):
            names = [x for x in piece if not isinstance(x, Group) and x[0] == "name"]
            if names:
                typed = any(_is(x, ":") for x in piece)
                x = names[0] if typed else names[-1]
                found.append(Node("parameter", x[2], x[3], x[1]))
        return found

    def assignment(self, part: list, at: int, start: int, end: int) -> list[Node]:
        """A target before the sign, its type left out, and one node for the value."""
        left = part[:at]
        declared = not isinstance(left[0], Group) and left[0][1] in DECLARES
        typed = next((k for k, x in enumerate(left) if _is(x, ":")), None)
        if declared:
            left = left[1:typed] if typed else left[1:]
        back = len(left)
        while back > 0:  # the chain of names, joins and groups that ends before the sign
            x = left[back - 1]
            chained = back < len(left) and (_is(left[back], *JOINS) or _is(x, *JOINS) or isinstance(left[back], Group))
            if back < len(left) and not chained:
                break
            back -= 1
        target = self.value(left[back:])
        if not target:
            return self.value(part[at + 1 :])
        value = self.value(part[at + 1 :])
        return [Node("assignment", start, end, self.text[target[0].start : target[0].end], children=[target[0], *value[:1]])]

    def value(self, part: list) -> list[Node]:
        """One node for an expression: what it is made of alone, or an operation over its parts; none if nothing is known in it."""
        part = [x for x in part if not _is(x, "\n")]
        found: list[Node] = []
        signs: list[str] = []
        k = 0
        while k < len(part):
            x = part[k]
            if not isinstance(x, Group) and x[0] == "name" and x[1] in ("function", "func", "fn") or k + 1 < len(part) and _is(part[k + 1], "=>"):
                node, k = self.function(part, k)
                found.append(node)
                continue
            if isinstance(x, Group) or x[0] in ("string", "number") or x[0] == "name" and (x[1] not in WORDS):
                node, k = self.primary(part, k)
                found += [node] if node else []
                continue
            if x[0] == "sign":
                signs.append(x[1])
            k += 1
        if len(found) < 2 and not (found and set(signs) & {"!", "-", "+", "~", "++", "--", "&", "*"}):
            return found
        kind = "unary_op" if len(found) == 1 else "comparison" if set(signs) & {"==", "===", "!=", "!==", "<", ">", "<=", ">="} else "binary_op"
        return [Node(kind, min(_start(part[0]), found[0].start), max(_end(part[-1]), found[-1].end), children=found)]

    def function(self, part: list, k: int) -> tuple[Node, int]:
        start, inner = _start(part[k]), []
        while k < len(part) and not _is(part[k], "=>") and not (isinstance(part[k], Group) and part[k].opens == "{"):
            if isinstance(part[k], Group) and part[k].opens == "(":
                inner += self.parameters(part[k])
            elif not isinstance(part[k], Group) and part[k][0] == "name" and part[k][1] not in ("function", "func", "fn", "async"):
                inner.append(Node("parameter", part[k][2], part[k][3], part[k][1]))
            k += 1
        k += k < len(part) and _is(part[k], "=>")
        if k < len(part) and isinstance(part[k], Group) and part[k].opens == "{":
            return Node("function_def", start, part[k].end, None, children=[*inner, *self.statements(part[k])]), k + 1
        rest = self.value(part[k:])
        return Node("function_def", start, _end(part[-1]), None, children=[*inner, *rest]), len(part)

    def primary(self, part: list, k: int) -> tuple[Node | None, int]:
        """A literal, name or group with the calls, indexes and attributes behind it."""
        x = part[k]
        if isinstance(x, Group):
            if x.opens == "(":
                inner = self.value(x)
                node = inner[0] if inner else None
            else:
                node = Node("list" if x.opens == "[" else "dict", x.start, x.end, children=[n for piece in self._split(x, (",",)) for n in (self.value(piece) if x.opens == "[" else self.entry(piece))])
        elif x[0] == "name":
            node = Node(VALUES.get(x[1], "identifier"), x[2], x[3], x[1])
        else:
            node = Node(x[0], x[2], x[3])
        k += 1
        while k < len(part) and node is not None:
            y = part[k]
            if isinstance(y, Group) and y.opens == "(" and node.kind in ("identifier", "attribute", "call", "subscript", "function_def"):
                args = [a for piece in self._split(y, (",",)) if (a := self.value(piece))]
                node = Node("call", node.start, y.end, self.text[node.start : node.end], [self.text[a[0].start : a[0].end] for a in args], [node, *(a[0] for a in args)])
            elif isinstance(y, Group) and y.opens == "[" and node.kind in ("identifier", "attribute", "call", "subscript"):
                node = Node("subscript", node.start, y.end, children=[node, *self.value(y)])
            elif _is(y, *JOINS) and k + 1 < len(part) and not isinstance(part[k + 1], Group) and part[k + 1][0] == "name":
                k += 1
                node = Node("attribute", node.start, part[k][3], self.text[node.start : part[k][3]], children=[node])
            else:
                break
            k += 1
        return node, k

    def entry(self, piece: list) -> list[Node]:
        """The value of an object's entry; where it has statements, a block's."""
        at = next((k for k, x in enumerate(piece) if _is(x, ":")), None)
        if at is not None:
            return self.value(piece[at + 1 :])
        return self.statements(piece)


def node_rows(path: str, text: str, language: str) -> list[tuple]:
    """The nodes of one source in order of ``pre``, as ``syntax.node_rows`` gives them; of an unknown language one node."""
    text = text or ""
    root = Node("module", 0, len(text))
    if language in BRACES:
        try:
            root.children = _Islands(text).statements(brackets(text))
        except RecursionError:  # hundreds of brackets within each other: the source stays one node
            root.children = []
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    rows: list[list] = []
    clock, stack = 0, [(root, -1, -1)]
    while stack:
        node, parent, at = stack.pop()
        clock += 1
        if at >= 0:
            rows[at][4] = clock
            continue
        line = bisect_right(lines, node.start)
        at = len(rows)
        shown = text[node.start : node.end]
        rows.append([path, at, parent, clock, 0, node.kind, node.name, node.args, shown, line if parent >= 0 else 0, node.start - lines[line - 1]])
        stack.append((node, parent, at))
        stack += [(child, at, -1) for child in reversed(node.children)]
    return list(map(tuple, rows))


def parse(files: DataFrame) -> DataFrame:
    """files (path, language, text) to node rows: Python by its own parser, languages with braces by islands, others as one node.

    Files are independent; a task holds the rows of a few. Null texts are empty. Store the result if more than
    one operator reads it: each reading parses again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in syntax.NODES.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for path, language, text in zip(batch["path"], batch["language"], batch["text"], strict=True):
                rows += syntax.node_rows(path, text) if language == "python" else node_rows(path, text, language)
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "language", "text").mapInPandas(run, syntax.NODES)
