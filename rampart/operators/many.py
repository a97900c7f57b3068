"""Thousands of regexes over lines: an automaton of the strings that they require picks the few that a line may match."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from re import _constants as C
from re import _parser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .match import FOUND, _told, scan_all, spans

#: Letters that a required string has at least, and strings that a pattern may require one of at most.
SHORTEST, WIDEST = 3, 64
#: What Java's engine reads in another way than the parser here, or may.
ODD = ("\\0", "\\v", "\\Q", "\\p", "\\P", "(?x", "(?-", "[[", "&&")


def required(pattern: str) -> frozenset[str] | None:
    """Strings in lower case of which every match of the pattern holds one; None if there are none to rely on."""
    if any(x in pattern for x in ODD):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = _parser.parse(pattern)
        if tree.state.flags & C.SRE_FLAG_VERBOSE:
            return None
        return _of(tree)
    except (ValueError, RecursionError, OverflowError, _parser.error):
        return None


def _of(tree) -> frozenset[str] | None:
    """The best of what a sequence's parts require: the longest, of equal ones the fewest."""
    options: list[frozenset[str]] = []
    run = ""

    def told() -> None:
        nonlocal run
        if len(run) >= SHORTEST:
            options.append(frozenset([run]))
        run = ""

    for op, value in tree:
        if op is C.LITERAL:
            run += chr(value).lower()
            continue
        if op is C.AT:  # a place has no width
            continue
        told()
        inner = None
        if op is C.SUBPATTERN:
            inner = _of(value[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _of(value[2])
        elif op is C.ATOMIC_GROUP:
            inner = _of(value)
        elif op is C.BRANCH:
            parts = [_of(x) for x in value[1]]
            inner = frozenset().union(*parts) if all(parts) else None
        if inner and len(inner) <= WIDEST:
            options.append(inner)
    told()
    return max(options, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def automaton(strings: Iterable[tuple[str, int]]):
    """An Aho-Corasick automaton from strings to the numbers of the patterns that require them."""
    import ahocorasick

    of: dict[str, list[int]] = {}
    for text, k in strings:
        of.setdefault(text, []).append(k)
    made = ahocorasick.Automaton()
    for text, ks in of.items():
        made.add_word(text, tuple(ks))
    made.make_automaton()
    return made


def _picker(shared):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(shared.value)
        for batch in batches:
            rows, ks = [], []
            for r, text in enumerate(pc.utf8_lower(batch.column("text")).to_pylist()):
                some = {k for _, told in found.iter(text) for k in told} if text else ()
                rows += [r] * len(some)
                ks += some
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("path", "language", "line", "text")), pa.array(ks, pa.int32())], ["path", "language", "line", "text", "k"])

    return pick


def candidates(code: DataFrame, rows: list[Row]) -> tuple[DataFrame, list[Row]]:
    """(path, language, line, text, k): each line with the patterns of which it holds a required string; and the patterns that require none."""
    strings, rest = [], []
    for k, r in enumerate(rows):
        need = required(r.pattern)
        if need:
            strings += [(x, k) for x in sorted(need)]
        else:
            rest.append(r)
    told = code.select("path", "language", "line", "text")
    shared = code.sparkSession.sparkContext.broadcast(strings)  # configuration: some strings a rule
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in told.schema)
    return told.mapInArrow(_picker(shared), f"{kinds}, k int"), rest


def scan(code: DataFrame, rows: list[Row]) -> DataFrame:
    """What ``match.scan_all`` finds, for any number of patterns.

    A line goes once through the automaton; it is tried only with the patterns of which it holds a string,
    by a join with the table of rules, which is configuration. Patterns without a required string are
    literals of a projection over every line.
    """
    picked, rest = candidates(code, rows)
    table = [(k, r.rule_id, r.pattern_idx, r.severity, f"(?i){r.pattern}", [str(x) for x in r.languages or []]) for k, r in enumerate(rows)]
    told = code.sparkSession.createDataFrame(table, "k int, rule_id string, pattern_idx int, severity string, pattern string, languages array<string>")
    fits = F.array_contains("languages", F.lit("generic")) | F.expr("array_contains(languages, language)")
    hits = picked.join(F.broadcast(told), "k").where(fits).where(F.rlike("text", F.col("pattern")))
    found = F.struct("rule_id", "pattern_idx", "severity", spans(F.col("text"), F.col("pattern")).alias("all")).cast(FOUND)
    out = _told(hits.select("path", "language", "line", "text", found.alias("f")))
    return scan_all(code, rest).unionAll(out) if rest else out
