"""Syntax trees as tables, and patterns over them. Python sources only: the standard parser is at hand."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .containment import containment, holding

NODES = "path string, node_id int, parent_id int, pre int, post int, kind string, name string, args array<string>, text string, line int, col int"
KINDS = {"Call": "call", "Assign": "assignment", "AnnAssign": "assignment", "AugAssign": "assignment", "FunctionDef": "function_def", "AsyncFunctionDef": "function_def", "ClassDef": "class_def", "Import": "import", "ImportFrom": "import", "Return": "return", "If": "if", "For": "for", "While": "while", "Name": "identifier", "Attribute": "attribute", "Constant": "literal", "BinOp": "binary_op", "JoinedStr": "fstring"}


class _Source:
    """A text's bytes with where its lines begin, so that a node's text is a slice."""

    def __init__(self, text: str):
        self.data = text.encode("utf-8", "replace")
        self.starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\n|\r", self.data))]

    def of(self, node: ast.AST) -> str:
        if getattr(node, "end_lineno", None) is None:
            return ""
        a, b = self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset
        return self.data[a:b].decode("utf-8", "replace")


def node_rows(path: str, text: str) -> list[tuple]:
    """The nodes of one source, in order of ``pre``; a broken source has none."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    source = _Source(text or "")
    rows: list[list] = []
    clock = 0
    stack: list[tuple[ast.AST, int, bool, int]] = [(tree, -1, False, -1)]
    while stack:  # own stack: sources may nest deeply
        node, parent, done, at = stack.pop()
        clock += 1
        if done:
            rows[at][4] = clock
            continue
        name = ast.unparse(node.func) if isinstance(node, ast.Call) else node.id if isinstance(node, ast.Name) else ast.unparse(node.targets[0]) if isinstance(node, ast.Assign) else getattr(node, "name", None)
        args = [ast.unparse(a) for a in node.args] + [f"{k.arg}={ast.unparse(k.value)}" for k in node.keywords if k.arg] if isinstance(node, ast.Call) else []
        at = len(rows)
        rows.append([path, at, parent, clock, 0, KINDS.get(type(node).__name__, type(node).__name__.lower()), name, args, source.of(node), getattr(node, "lineno", 0), getattr(node, "col_offset", 0)])
        stack.append((node, parent, True, at))
        stack += [(child, at, False, -1) for child in reversed(list(ast.iter_child_nodes(node)))]
    return list(map(tuple, rows))


def parse(files: DataFrame) -> DataFrame:
    """files (path, text) to nodes: a nested set (pre, post) tells descendants by a range. Broken files have none.

    Store the result if more than one operator reads it: each reading parses again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in NODES.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                rows += node_rows(path, text)
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "text").mapInPandas(run, NODES)


def match_calls(nodes: DataFrame, callee: str, args: Iterable[str] | None = None) -> DataFrame:
    """Calls of ``callee`` (or of its attributes; $X: any) with arguments as given, ... standing for any number.

    Arguments before ... are matched from the front, those after the last ... from the back, those between
    anywhere in order; no pattern of arguments matches all.
    """
    found = nodes.where("kind = 'call'")
    if not callee.startswith("$"):
        found = found.where(F.col("name").isNull() | (F.col("name") == callee) | F.startswith("name", F.lit(callee + ".")))
    if args is None:
        return found
    token = lambda a: "[^\x00]*" if a.startswith("$") else re.escape(a)
    whole = "".join("(?:[^\x00]*\x00)*" if a == "..." else token(a) + "\x00" for a in args)
    return found.where(F.array_join(F.transform("args", lambda a: F.concat(a, F.lit("\x00"))), "").rlike(f"^{whole}$"))


def without(matches: DataFrame, inner: DataFrame) -> DataFrame:
    """Matches with no ``inner`` match in their subtree."""
    return holding(matches, inner.select("path", "pre"), how="left_anti")


def assignments(nodes: DataFrame) -> DataFrame:
    """(path, target, source_var, line) of each assignment and identifier on its right-hand side."""
    made = nodes.where("kind = 'assignment' and name is not null").select("path", "pre", "post", "line", F.col("name").alias("target"))
    names = nodes.where("kind = 'identifier'").select("path", "pre", F.col("name").alias("source_var"))
    pairs = containment(made, names).select("path", "o.target", "i.source_var", "o.line")
    return pairs.where("source_var != target").distinct()
