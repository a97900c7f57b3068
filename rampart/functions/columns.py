"""Column functions of the security operators; built-in expressions only."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T


def cases(pairs: Iterable[tuple[Column, object]], otherwise) -> Column:
    """The value of the first condition that holds; a null condition doesn't."""
    out = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    otherwise = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return otherwise if out is None else out.otherwise(otherwise)


def lookup(key: Column, table: Mapping[str, object], otherwise) -> Column:
    """``table[key]``; ``otherwise`` for other keys and null."""
    return cases(((key == k, v) for k, v in table.items()), otherwise)


def any_of(text: Column, parts: Iterable[str]) -> Column:
    """Whether the text holds one of the parts; false for null."""
    return F.coalesce(reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts)), F.lit(False))


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns)), F.lit(False))


def js_round(x: Column) -> Column:
    """Half up, towards positive infinity."""
    return F.floor(x + 0.5).cast("int")


def file_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))


def language(path: Column, table: Mapping[str, str] = T.FILE_LANGUAGES, otherwise: str = "generic", *, dockerfile: bool = True) -> Column:
    """Language of a path by its last extension; Dockerfile and Dockerfile.* come first unless told otherwise."""
    extension = F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)
    found = lookup(extension, table, otherwise)
    base = file_name(path)
    return F.when((base == "dockerfile") | F.startswith(base, F.lit("dockerfile.")), F.lit("dockerfile")).otherwise(found) if dockerfile else found


def benchmark_language(path: Column) -> Column:
    """The benchmark's language of a path: Dockerfile_* is a Dockerfile too, and texts are of no language."""
    return F.when(F.startswith(file_name(path), F.lit("dockerfile_")), F.lit("dockerfile")).otherwise(language(path, T.BENCHMARK_LANGUAGES))


def severity_rank(severity: Column) -> Column:
    return lookup(severity, T.SEVERITY_RANK, 0)


def confidence_rank(confidence: Column) -> Column:
    return lookup(F.coalesce(confidence, F.lit("MEDIUM")), T.CONFIDENCE_RANK, 0)


def engine_rank(engine: Column) -> Column:
    return lookup(engine, T.ENGINE_RANK, 0)


def vulnerability_class(rule_id: Column) -> Column:
    """Class of the first part that the lower-cased id holds; else the lower-cased id itself."""
    low = F.lower(rule_id)
    return cases(((F.contains(low, F.lit(part)), name) for part, name in T.CLASSES), low)


def rule_category(rule_id: Column) -> Column:
    """First dotted segment of the id; ``other`` if there is none."""
    return F.coalesce(F.nullif(F.split_part(rule_id, F.lit("."), F.lit(1)), F.lit("")), F.lit("other"))


def glob_regex(glob: str) -> str:
    """A glob as a whole-string pattern: ** over folders, * and ? within one, braces and commas as choices."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.+/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}.get(c, re.escape(c)), i + 1
    return f"^{out}$"


def glob_matches(path: Column, globs: Iterable[str]) -> Column:
    """Whether one of the globs matches the path or its last part."""
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    tests = [path.rlike(p) | last.rlike(p) for p in map(glob_regex, globs)]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)) if tests else F.lit(False)


def first_replaced(text: Column, pattern: str, replacement: str) -> Column:
    """Replaces the first match only. Groups of ``pattern`` are numbered from 2 in ``replacement``."""
    return F.regexp_replace(text, rf"(?s)^(.*?){pattern}", "$1" + replacement)


def grade(issues: Column, errors: Column, files: Column) -> Column:
    """A to F by issues per file and errors; no file or no issue is A."""
    density = issues.cast("double") / files
    return cases(
        [
            (files == 0, "A"),
            ((issues == 0) & (errors == 0), "A"),
            ((errors == 0) & (density < 0.5), "B"),
            ((errors <= 2) & (density < 1.5), "C"),
            ((errors <= 5) & (density < 3), "D"),
        ],
        "F",
    )


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, or ``empty`` for b = 0."""
    return F.when(b == 0, F.lit(empty)).otherwise(a.cast("double") / b.cast("double"))


def balanced(line: Column) -> Column:
    """Whether quotes pair up and brackets nest without going below zero, in one line."""
    even = [(F.length(line) - F.length(F.replace(line, F.lit(q), F.lit("")))) % 2 == 0 for q in ("'", '"', "`")]
    return reduce(lambda a, b: a & b, even + [_nests(line, *pair) for pair in ("()", "[]", "{}")])


def _nests(line: Column, opens: str, closes: str) -> Column:
    """Whether the brackets of one kind never close before they open, and all close."""
    steps = F.split(F.regexp_replace(line, "[^" + re.escape(opens + closes) + "]", ""), "")
    step = lambda c: F.when(c == opens, 1).when(c == closes, -1).otherwise(0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    walk = lambda a, c: F.struct((a["depth"] + step(c)).alias("depth"), F.least(a["least"], a["depth"] + step(c)).alias("least"))
    return F.aggregate(steps, start, walk, lambda a: (a["depth"] == 0) & (a["least"] == 0))
