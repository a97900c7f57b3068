"""Plans without joins of all with all, and results that are whole or an error."""

import random

import pytest

from rampart.operators import containment, fixes, graph, match, prompts, syntax, tools
from rampart.plans import seeds
from rampart.plans.queries import QUERIES
from rampart.sources.rule_packs import SCHEMA, prompt_rules

NAMES = ["regex_rule_scan", "baseline_scan", "prompt_findings", "decoded_prompt_findings", "multi_turn_escalation", "composite_attacks", "prompt_recommendations", "prompt_verdict_medium", "editor_verdicts_high", "syntax_rule_findings", "taint_rule_findings", "typosquat_top5", "glob_suppress"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cartesian_product(spark, data, name):
    assert "CartesianProduct" not in plan(QUERIES[name](spark, data))


def test_rules_are_literals(spark):
    told = spark.createDataFrame([(1, "reverse   shell"), (2, "hello"), (3, None)], "prompt_id long, text string")
    found = prompts.pattern_hits(told, prompt_rules(spark))
    assert "Join" not in plan(found) and "Exchange" not in plan(found)
    assert [(r.prompt_id, r.rule_id) for r in found.collect()] == [(1, "inject.reverse-shell")]
    none = spark.createDataFrame([], SCHEMA)
    assert prompts.pattern_hits(told, none).count() == 0
    lines = spark.createDataFrame([("f", "python", 0, "eval(x)")], "path string, language string, line int, text string")
    assert match.regex_scan(lines, none).count() == 0 and match.regex_scan(lines, none).columns == match.regex_scan(lines, prompt_rules(spark)).columns


def test_too_many_rules_are_refused(spark):
    many = spark.range(30).selectExpr("cast(id as string) as rule_id", "0 as pattern_idx", "'x' as pattern")
    with pytest.raises(ValueError):
        match.rule_rows(many, 29)
    assert len(match.rule_rows(many, 30)) == 30


def test_taint_along_a_long_chain(spark):
    """A chain of 5,000 assignments is followed to its end, in one plan."""
    chain = spark.createDataFrame([("f", f"v{i + 1}", f"v{i}") for i in range(5000)] + [("g", "b", "a")], "path string, target string, source_var string")
    source = spark.createDataFrame([("f", "v0"), ("h", "z")], "path string, var string")
    found = graph.tainted(chain, source)
    assert {(r.path, r["var"], r.hops) for r in found.collect()} == {("f", f"v{i}", i) for i in range(5001)} | {("h", "z", 0)}


def test_containment_is_a_sweep(spark):
    """One file of 100,000 nodes: no join pairs its nodes, and pairs are as many as there are to tell."""
    source = "\n".join(f"x{i} = f(y{i})" for i in range(20_000))
    nodes = syntax.parse(spark.createDataFrame([("p", source)], "path string, text string")).cache()
    assert nodes.count() > 100_000
    flows = syntax.assignments(nodes)
    assert "Join" not in flows._jdf.queryExecution().executedPlan().toString()
    assert flows.count() == 40_000
    calls = nodes.where("kind = 'call'")
    assert syntax.without(calls, nodes.where("name = 'y7'")).count() == 19_999


def test_nested_ranges(spark):
    """All pairs of ranges and places of random trees by hand, with depth and over several batches."""
    r = random.Random(6)
    rows = []
    for tree in range(12):
        clock, stack = 0, []
        for _ in range(200):
            clock += 1
            if stack and r.random() < 0.45:
                rows.append((f"t{tree}", stack.pop(), clock, r.randrange(5)))
            else:
                stack.append(clock)
        while stack:
            clock += 1
            rows.append((f"t{tree}", stack.pop(), clock, r.randrange(5)))
    nodes = spark.createDataFrame([*rows, (None, 1, 2, 3), ("t0", None, None, 4)], "path string, pre int, post int, tag int")
    outer, inner = nodes.where("tag < 3"), nodes.where("tag > 1")
    hand = {(o[0], o[1], i[1]) for o in rows for i in rows if o[3] < 3 and i[3] > 1 and o[0] == i[0] and o[1] <= i[1] <= o[2]}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("7", before):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert {(x.path, x.o.pre, x.i.pre) for x in containment.containment(outer, inner).collect()} == hand
    held = {(p, o) for p, o, _ in hand}
    assert {(x.path, x.pre) for x in containment.holding(outer, inner).collect()} == held
    assert {(x.path, x.pre) for x in containment.holding(outer.where("path = 't1'"), inner, how="left_anti").collect()} == {(o[0], o[1]) for o in rows if o[0] == "t1" and o[3] < 3} - held
    assert containment.containment(outer.limit(0), inner).count() == 0


@pytest.mark.parametrize("made", [seeds.lines, seeds.prompts, seeds.actions, seeds.findings])
def test_small_tables_are_broadcast(spark, data, made):
    """The rows are not dealt by the number of a snippet, a probe or a rule: a few keys would be a few tasks, however large the table."""
    plan = made(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_fixes_in_one_pass(spark, data):
    """A line's findings are folded where the line is: no row is dealt, and what comes of it is what the findings as a table give."""
    told = fixes.apply_detected(seeds.lines(spark, data))
    made = QUERIES["fixes_applied"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in made and "SortMergeJoin" not in made
    some = seeds.lines(spark, data).where("line < 4")
    want = fixes.apply_fixes(some, match.detect(some)).select("path", "line", "fixed")
    assert sorted(map(tuple, told.where("line < 4").select("path", "line", "fixed").collect())) == sorted(map(tuple, want.collect()))


def test_a_diff_scan_looks_at_touched_lines_only(spark):
    lines = spark.createDataFrame([("/p/src/a.py", "python", k, "eval(user_input)") for k in (0, 0, 1, 2)], "path string, language string, line int, text string")
    touched = spark.createDataFrame([("/p/src/a.py", 1), ("/p/src/a.py", 3)], "file string, line int")
    found = tools.changed(lines, touched)
    assert sorted(r.line for r in found.collect()) == [0, 2]  # one a class and line, though line 0 is there twice
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join LeftSemi")  # the join lies below the detectors
    assert plan.count("Join ") == 1  # a line's text goes with its findings
