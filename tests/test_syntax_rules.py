"""Patterns over syntax, and packs of syntax and taint rules."""

import pytest
from pyspark.sql import functions as F

from rampart.operators import syntax, syntax_rules
from rampart.sources import rule_packs

SOURCE = """import os
a = f(1, x, g(2), key)
b.c.d('s', y)
eval(a)
t = "text"
é = call(ü)
z.execute(sql, (1, 2))
"""


@pytest.fixture(scope="module")
def nodes(spark):
    found = syntax.parse(spark.createDataFrame([("p", SOURCE), ("q", "def broken(:"), ("r", None)], "path string, text string")).cache()
    assert {r.path for r in found.select("path").distinct().collect()} <= {"p", "r"}
    return found.where("path = 'p'")


def test_tokens():
    assert syntax_rules.tokens("$X.execute($Q, ...)") == ["$X", "execute", "(", "$Q", ",", "...", ")"]
    assert syntax_rules.tokens("a.b.c('x y', \"z\")") == ["a.b.c", "(", "'x y'", ",", '"z"', ")"]
    assert not syntax_rules.anchored(syntax_rules.tokens("$F(...)")) and syntax_rules.anchored(["$F", "(", "x", ")"])


@pytest.mark.parametrize(
    ("pattern", "lines"),
    [
        ("f(...)", [2]), ("f()", [2]), ("f(1, ...)", [2]), ("f(..., key)", [2]), ("f(..., x, ...)", [2]), ("f(1, x)", []), ("f(..., 1)", []), ("f($A, $B, $C, $D)", [2]), ("f($A, $B, $C)", []),
        ("b.c(...)", [3]), ("b.c.d('s', $Y)", [3]), ("b.c.d(s, y)", [3]), ("c.d(...)", []), ("$F(..., y)", [3]), ("$F(...)", []), ("eval($X)", [4]), ("a = $V", [2]), ("$V = 1", [2, 5, 6]), ("t = 'other'", [5]),
        ("text", [5]), ("call(ü)", [6]), ("execute($S, ...)", []), ("nothing", []), (") f (", []),
    ],
)
def test_patterns(nodes, pattern, lines):
    found = syntax_rules.apply_rules(nodes, [syntax_rules.SyntaxRule("r", (pattern,))])
    assert sorted({r.line for r in found.collect()}) == lines


def test_node_texts(nodes):
    texts = {(r.kind, r.line): r.text for r in nodes.where("kind in ('call', 'assignment')").orderBy(F.desc("pre")).collect()}
    assert texts["call", 6] == "call(ü)" and texts["assignment", 6] == "é = call(ü)" and texts["call", 7] == "z.execute(sql, (1, 2))"


def test_exclusions_and_regexes(nodes):
    rules = [syntax_rules.SyntaxRule("any", ("f(...)", "eval(...)"), ("g(...)",)), syntax_rules.SyntaxRule("re", (r"^eval",), (), regex=True)]
    found = {(r.rule_id, r.pattern_idx, r.line) for r in syntax_rules.apply_rules(nodes, rules).collect()}
    assert found == {("any", 1, 4), ("re", 0, 4)}


PACK = """
rules:
  - {id: one, languages: [python], severity: ERROR, message: m, patterns: [{pattern: "eval(...)"}, {pattern-not: "eval('x')"}]}
  - {id: two, languages: [go], pattern: "f(...)"}
  - {id: three, languages: [python], pattern-either: [{pattern: "a($X)"}, {pattern: "b(\\n$X)"}, {pattern-regex: "x+"}]}
  - {id: four, languages: [python], mode: taint, pattern-sources: [{pattern: "input()"}], pattern-sinks: [{patterns: [{pattern: "eval(...)"}]}, {pattern: "exec($X)"}], pattern-sanitizers: [{pattern: "int(...)"}]}
  - {id: five, languages: [python], pattern: "plain text."}
  - {id: six, pattern-regex: "a(?i)b"}
  - {id: seven, languages: [python], patterns: ["print.*\\\\(", "$X = 1"]}
"""


def test_packs(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(PACK)
    (tmp_path / "b.yaml").write_text("rules: [")
    found, errors = rule_packs.read_rule_packs(spark, str(tmp_path), prompts=False)
    assert {(r.rule_id, r.pattern) for r in found.collect()} == {("three", "x+"), ("five", r"plain\ text\."), ("seven", r"print.*\(")}
    assert {(r.rule_id, r.reason) for r in errors.collect() if r.rule_id} >= {("one", "pattern over syntax"), ("six", "flags inside the pattern"), ("seven", "pattern over syntax")}
    rules, taint = rule_packs.read_syntax_rules(str(tmp_path), "python")
    of = {r.rule_id: r for r in rules}
    assert of["one"].patterns == ("eval(...)",) and of["one"].pattern_not == ("eval('x')",) and of["one"].severity == "error"
    assert of["three"].patterns == ("a($X)",) and "two" not in of and "four" not in of
    assert [(t.rule_id, t.sources, t.sinks, t.sanitizers) for t in taint] == [("four", ("input()",), ("eval(...)", "exec($X)"), ("int(...)",))]


def test_pack_rules_end_to_end(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(PACK)
    rules, taint = rule_packs.read_syntax_rules(str(tmp_path), "python")
    source = "x = input()\ny = int(input())\nz = x\neval(z)\neval(y)\neval('x')\n"
    told = syntax.parse(spark.createDataFrame([("p", source)], "path string, text string")).cache()
    assert {(r.rule_id, r.line) for r in syntax_rules.apply_rules(told, rules).collect() if r.rule_id == "one"} == {("one", 4), ("one", 5)}
    assert [(r.line, r["var"], r.source_line, r.hops) for r in syntax_rules.apply_taint_rule(told, taint[0]).collect()] == [(4, "z", 1, 1)]
