"""Rules over syntax trees: patterns compiled to predicates on node rows, rules as unions minus exclusions, taint rules."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .containment import containment, holding
from .graph import spread
from .syntax import assignments

METAVARIABLE = re.compile(r"\$[A-Z_][A-Z0-9_]*")
#: What a pattern is made of: metavariables, the ellipsis, dotted names, strings, signs.
TOKEN = re.compile(r"""\$[A-Z_][A-Z0-9_]*|\.\.\.|\w+(?:\.\w+)*|"[^"]*"|'[^']*'|[()\[\],=+\-*/<>!&|]""")
#: Tokens that don't anchor a pattern.
LOOSE = {"(", ")", ",", "...", "=", "+", "-", "*", "/", "[", "]"}


@dataclass(frozen=True)
class SyntaxRule:
    rule_id: str
    patterns: tuple[str, ...]
    pattern_not: tuple[str, ...] = ()
    severity: str = "warning"
    message: str = ""
    #: Patterns are regexes on the text of nodes.
    regex: bool = False


@dataclass(frozen=True)
class TaintRule:
    rule_id: str
    sources: tuple[str, ...]
    sinks: tuple[str, ...]
    sanitizers: tuple[str, ...] = ()
    severity: str = "error"
    message: str = ""
    languages: tuple[str, ...] = field(default=("python",))


def tokens(pattern: str) -> list[str]:
    """The pattern's tokens; characters that are none, as the dot between a metavariable and a name, fall away."""
    return TOKEN.findall(pattern)


def anchored(found: list[str]) -> bool:
    """Whether a token is more than a metavariable or a sign; other patterns match nothing."""
    return any(t not in LOOSE and not METAVARIABLE.fullmatch(t) for t in found)


def _same(token: str, text: Column) -> Column:
    """Text that is the token, or an attribute of it, both without quotes."""
    bare = token.strip("\"'")
    plain = F.trim(F.regexp_replace(text, "^[\"']+|[\"']+$", ""))
    return (plain == bare) | F.startswith(plain, F.lit(bare + "."))


def _arguments(found: list[str], args: Column) -> Column:
    """Arguments between the first parentheses: from the front up to the first ellipsis, from the back after the last, between them anywhere in order."""
    inner = found[found.index("(") + 1 : found.index(")")]
    if inner in ([], ["..."]):
        return F.lit(True)
    wanted = ""
    for t in inner:
        if t == ",":
            continue
        bare = re.escape(t.strip("\"'"))
        wanted += r"(?:[^\x00]*\x00)*" if t == "..." else r"[^\x00]*\x00" if METAVARIABLE.fullmatch(t) else rf"{bare}(?:\.[^\x00]*)?\x00"
    plain = F.transform(args, lambda a: F.concat(F.trim(F.regexp_replace(a, "^[\"']+|[\"']+$", "")), F.lit("\x00")))
    return F.array_join(plain, "").rlike(f"^{wanted}$")


def matches(pattern: str, regex: bool = False) -> Column:
    """Whether a node (kind, name, args, text) matches a pattern.

    Three tokens or more with parentheses are a call, else tokens with = after the first an assignment, whose
    value is not looked at; a single token is a node's whole text. Regexes are searched in each node's text.
    """
    if regex:
        return F.col("text").rlike(pattern)
    found = tokens(pattern)
    no = F.lit(False)
    if not anchored(found):
        return no
    if len(found) >= 3 and "(" in found and ")" in found:
        if found.index(")") < found.index("("):
            return no
        callee = F.lit(True) if METAVARIABLE.fullmatch(found[0]) else F.col("name").isNull() | _same(found[0], F.col("name"))
        return (F.col("kind") == "call") & callee & _arguments(found, F.col("args"))
    if "=" in found[1:]:
        target = F.lit(True) if METAVARIABLE.fullmatch(found[0]) else _same(found[0], F.col("name"))
        return (F.col("kind") == "assignment") & F.coalesce(target, no)
    if len(found) == 1:
        return F.trim(F.regexp_replace("text", "^[\"']+|[\"']+$", "")) == found[0].strip("\"'")
    return no


def any_of(patterns: Iterable[str], regex: bool = False) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(matches(p, regex), F.lit(False)) for p in patterns), F.lit(False))


def apply_rules(nodes: DataFrame, rules: Iterable[SyntaxRule]) -> DataFrame:
    """(path, rule_id, pattern_idx, severity, line, col, text, pre): nodes that match any pattern of a rule, but not those with an excluded one in their subtree.

    All patterns are predicates of one projection over the nodes; only matches meet the exclusions, by path
    and range. A node that several patterns of a rule match is found by each.
    """
    tests, unless = [], []
    for r in rules:
        for k, p in enumerate(r.patterns):
            hit = F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(k).alias("pattern_idx"), F.lit(r.severity).alias("severity"))
            tests.append(F.when(F.coalesce(matches(p, r.regex), F.lit(False)), hit))
        if r.pattern_not:
            unless.append(F.when(any_of(r.pattern_not, r.regex), F.lit(r.rule_id)))
    found = nodes.select("path", "pre", "post", "line", "col", "text", F.explode(F.array_compact(F.array(*tests))).alias("f")).select("path", "pre", "post", "line", "col", "text", "f.*")
    if unless:
        out = nodes.select("path", "pre", F.explode(F.array_compact(F.array(*unless))).alias("rule_id"))
        found = holding(found, out, ["path", "rule_id"], "left_anti")
    return found.select("path", "rule_id", "pattern_idx", "severity", "line", "col", "text", "pre")


def _first_fit(segment: list[str], least: Column) -> Column:
    """The first place from ``least`` on where a call's arguments are those of the segment."""
    plain = F.transform("args", lambda a: F.trim(F.regexp_replace(a, "^[\"']+|[\"']+$", "")))
    most = F.size("args") - len(segment)

    def fits(i: Column) -> Column:
        told = [(F.get(plain, i + n), t.strip("\"'")) for n, t in enumerate(segment) if not METAVARIABLE.fullmatch(t)]
        return reduce(lambda a, b: a & b, ((x == t) | F.startswith(x, F.lit(t + ".")) for x, t in told), F.lit(True))

    return F.get(F.filter(F.when(most >= least, F.sequence(least, most)), fits), F.lit(0))


def captures(pattern: str) -> Column | None:
    """What a pattern's metavariables stand for in a node that it matches, as (variable, text, part); None if it has none.

    ``part`` is an argument's number, CALLEE, TARGET or VALUE. Arguments before an ellipsis are counted from
    the front, those after the last from the back, those between are the first that fit. A variable that comes
    twice stands for what it met last.
    """
    found = tokens(pattern)
    told: dict[str, Column] = {}

    def put(token: str, text: Column, part: Column) -> None:
        if METAVARIABLE.fullmatch(token):
            told[token] = F.struct(F.lit(token).alias("variable"), text.alias("text"), part.cast("int").alias("part"))

    if not anchored(found):
        return None
    if len(found) >= 3 and "(" in found and ")" in found:
        if found.index(")") < found.index("("):
            return None
        put(found[0], F.col("name"), F.lit(CALLEE))
        inner = [t for t in found[found.index("(") + 1 : found.index(")")] if t != ","]
        segments: list[list[str]] = [[]]
        for t in inner:
            if t == "...":
                segments.append([])
            else:
                segments[-1].append(t)
        start = F.lit(0)
        for k, segment in enumerate(segments):
            if k and k == len(segments) - 1:
                start = F.size("args") - len(segment)
            elif k and segment:
                start = _first_fit(segment, start)
            for n, t in enumerate(segment):
                put(t, F.get("args", start + n), start + n)
            start = start + len(segment)
    elif "=" in found[1:]:
        put(found[0], F.col("name"), F.lit(TARGET))
        if len(found) > 2:
            put(found[2], F.lit(None).cast("string"), F.lit(VALUE))
    return F.array(*told.values()) if told else None


#: Parts of a node other than arguments.
CALLEE, TARGET, VALUE = -1, -2, -3


def matched(nodes: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """(path, pattern_idx, node_id, pre, post, line, captured): the nodes that match each pattern, with what its metavariables stand for."""
    none = F.array().cast("array<struct<variable:string,text:string,part:int>>")
    tests = []
    for k, p in enumerate(patterns):
        told = captures(p)
        tests.append(F.when(F.coalesce(matches(p), F.lit(False)), F.struct(F.lit(k).alias("pattern_idx"), (none if told is None else told).alias("captured"))))
    if not tests:
        tests = [F.lit(None).cast("struct<pattern_idx:int,captured:array<struct<variable:string,text:string,part:int>>>")]
    return nodes.select("path", "node_id", "pre", "post", "line", F.explode(F.array_compact(F.array(*tests))).alias("m")).select("path", "m.pattern_idx", "node_id", "pre", "post", "line", "m.captured")


def captured(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(path, pattern_idx, node_id, pre, line, variable, text, at): each metavariable of ``matched`` rows, and where the node begins that it stands for.

    An argument is the call's child of that number after the callee; a target the first child of its
    assignment, a value the last; a callee stands at the call itself.
    """
    each = found.select("path", "pattern_idx", "node_id", "pre", "line", F.explode("captured").alias("c")).select("path", "pattern_idx", "node_id", "pre", "line", "c.*")
    parents = each.select(F.col("path").alias("_path"), F.col("node_id").alias("_parent")).distinct()
    kin = nodes.join(parents, [F.col("path") == F.col("_path"), F.col("parent_id") == F.col("_parent")]).where("not (kind = 'keyword' and text like '**%')")
    order = W.partitionBy("path", "parent_id").orderBy("pre")
    kin = kin.select(F.col("path").alias("_path"), F.col("parent_id").alias("_parent"), F.col("pre").alias("_at"), F.col("text").alias("_text"), F.row_number().over(order).alias("_no"), F.lead("pre").over(order).isNull().alias("_last"))
    part = F.col("part")
    is_it = F.when(part >= 0, F.col("_no") == part + 2).when(part == TARGET, F.col("_no") == 1).when(part == VALUE, F.col("_last")).otherwise(False)
    told = each.join(kin, [F.col("path") == F.col("_path"), F.col("node_id") == F.col("_parent"), is_it], "left")
    return told.select("path", "pattern_idx", "node_id", "pre", "line", "variable", F.coalesce("text", "_text").alias("text"), F.coalesce("_at", "pre").alias("at"))


def taint_sources(nodes: DataFrame, rule: TaintRule) -> DataFrame:
    """(path, var, line): variables that a source match taints: that of the first assignment on its line, and what its metavariables stand for.

    Matches and captured nodes that are sanitizers themselves don't count, nor do assignments around one.
    """
    clean = nodes.where(any_of(rule.sanitizers)).select("path", "pre")
    found = matched(nodes, rule.sources).join(clean, ["path", "pre"], "left_anti")
    made = nodes.where("kind = 'assignment' and name is not null")
    first = made.groupBy("path", "line").agg(F.min_by(F.struct(F.col("name").alias("var"), "pre", "post"), "pre").alias("a")).select("path", "line", "a.*")
    received = holding(first.join(found.select("path", "line").distinct(), ["path", "line"], "left_semi"), clean, how="left_anti").select("path", "var", "line")
    taken = received.limit(0)
    if any(captures(p) is not None for p in rule.sources):
        told = captured(nodes, found).where("text <> ''")
        taken = told.join(clean.withColumnRenamed("pre", "at"), ["path", "at"], "left_anti").select("path", F.col("text").alias("var"), "line")
    return received.unionAll(taken).distinct()


def _sink_uses(nodes: DataFrame, rule: TaintRule, reached: DataFrame) -> DataFrame:
    """(path, pre, line, var, at): tainted variables of sink matches: those that metavariables stand for, where there are none all that are named within."""
    found = matched(nodes, rule.sinks)
    names = nodes.where("kind = 'identifier'").select("path", "pre", F.col("name").alias("var"))
    rows = found.select("path", "pattern_idx", "pre", "post", "line")
    within = containment(rows, names).select("path", "o.pattern_idx", "o.pre", "o.line", "i.var", F.col("i.pre").alias("at"))
    if any(captures(p) is not None for p in rule.sinks):
        hot = reached.select("path", "var")
        own = captured(nodes, found).select("path", "pattern_idx", "pre", "line", F.col("text").alias("var"), "at").join(hot, ["path", "var"], "left_semi").select("path", "pattern_idx", "pre", "line", "var", "at")
        within = within.join(own, ["path", "pattern_idx", "pre"], "left_anti").unionByName(own)
    return within.select("path", "pre", "line", "var", "at").distinct()


def apply_taint_rule(nodes: DataFrame, rule: TaintRule) -> DataFrame:
    """(path, rule_id, severity, line, var, source_line, hops, trail): tainted variables in a sink match, outside of its sanitizers."""
    clean = nodes.where(any_of(rule.sanitizers)).select("path", "pre", "post")
    flows = assignments(nodes)
    around = nodes.where("kind = 'assignment' and name is not null").select("path", F.col("name").alias("target"), "line", "pre", "post")
    washed = holding(around, clean).select("path", "target", "line")
    reached = spread(flows.join(washed, ["path", "target", "line"], "left_anti"), taint_sources(nodes, rule))
    hot = _sink_uses(nodes, rule, reached).join(reached, ["path", "var"])
    # The sanitizers around a place nest: if any lies in the sink, the innermost does.
    points = hot.select("path", F.col("at").alias("pre")).distinct()
    shields = containment(clean, points).groupBy("path", F.col("i.pre").alias("at")).agg(F.max("o.pre").alias("shield"))
    open_ = hot.join(shields, ["path", "at"], "left").where("shield is null or shield < pre")
    return open_.select("path", F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), "line", "var", "source_line", "hops", F.array_join("trail", " -> ").alias("trail")).distinct()


def taint_messages(found: DataFrame, rule: TaintRule) -> DataFrame:
    """Findings of a taint rule with a message: the rule's, the source's line and the last steps to the variable."""
    return found.withColumn("message", F.format_string("%s (%s, from line %d: %s)", F.lit(rule.message), "var", "source_line", "trail"))


def taint_paths(assigns: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, var, hops, trail): the last steps by which a variable is tainted, along the shortest way, the least by name of those.

    assigns: path, target, source_var; sources: path, var.
    """
    told = spread(assigns, sources.select("path", "var", F.lit(None).alias("line")))
    return told.select("path", "var", "hops", F.array_join("trail", " -> ").alias("trail"))


def fix_order(findings: DataFrame) -> DataFrame:
    """Findings in the order in which fixes are applied: from a file's last line to its first."""
    return findings.withColumn("fix_no", F.row_number().over(W.partitionBy("path").orderBy(F.desc("line"), "rule_id")))
