"""Trees of languages with braces: sources made from known trees, broken ones, and long ones."""

import random
import time

import pytest

from rampart.operators import islands


def made(r, depth=0):
    """(source, calls, assignments) of a random statement."""
    name = lambda: r.choice(["a", "b1", "obj.run", "x.y.z", "$v", "_t"])

    def value(d):
        kind = r.randrange(6 if d < 3 else 3)
        if kind == 0:
            n = name()
            return n, []
        if kind == 1:
            return str(r.randrange(99)), []
        if kind == 2:
            return r.choice(['"s(1)"', "'it\\'s = {'", "`t ${q()}`"]), []
        if kind == 3:
            x, c = value(d + 1)
            y, e = value(d + 1)
            return f"{x} + {y}", c + e
        if kind == 4:
            x, c = value(d + 1)
            return f"[{x}]", c
        n, args = name(), [value(d + 1) for _ in range(r.randrange(4))]
        told = [t for t, _ in args]
        return f"{n}({', '.join(told)})", [(n, told), *(c for _, cs in args for c in cs)]

    kind = r.randrange(6 if depth < 3 else 3)
    if kind < 2:
        n, (v, calls) = name(), value(0)
        return f"{r.choice(['', 'var ', 'const ']) if '.' not in n else ''}{n} = {v};", calls, [n]
    if kind == 2:
        n, (v, calls) = name(), value(0)
        return f"{n}({v}); // {n}(comment) = 1", [(n, [v]), *calls], []
    body = [made(r, depth + 1) for _ in range(r.randrange(3))]
    calls, sets = [c for _, cs, _ in body for c in cs], [x for *_, xs in body for x in xs]
    inner = "\n".join("  " * (depth + 1) + s for s, *_ in body)
    v, more = value(1)
    head = {3: f"if ({v})", 4: f"while ({v})", 5: f"function f{depth}(p, q)"}[kind]
    return f"{head} {{\n{inner}\n}}", (calls if kind == 5 else more + calls), sets


@pytest.mark.parametrize("seed", range(60))
def test_known_trees(seed):
    r = random.Random(seed)
    parts = [made(r) for _ in range(6)]
    source = "\n".join(s for s, *_ in parts)
    rows = islands.node_rows("p", source, "javascript")
    calls = sorted((x[6], x[7]) for x in rows if x[5] == "call")
    assert calls == sorted(c for _, cs, _ in parts for c in cs), source
    assert sorted(x[6] for x in rows if x[5] == "assignment") == sorted(n for *_, ns in parts for n in ns), source
    lines = source.split("\n")
    for path, at, parent, pre, post, kind, _, _, text, line, col in rows:
        assert path == "p" and pre < post and kind
        if parent >= 0:
            assert rows[parent][3] < pre and post < rows[parent][4] and text in rows[parent][8]
            assert lines[line - 1][col:].startswith(text.split("\n")[0])


@pytest.mark.parametrize("text", [None, "", "}", "((((", "a(b", "'", '"x', "/*", "//", "`", "= = =", "x = ", "if", "if (", "for (;;)", "function", "class", "return", "\\", "a.b.", "{a: {b: [1, {c}]}}", "=>", "😀 = f(é)", "\x00"])
def test_broken_sources(text):
    for language in sorted(islands.BRACES):
        rows = islands.node_rows("p", text, language)
        assert rows[0][5] == "module" and rows[0][2] == -1
    assert len(islands.node_rows("p", text, "cobol")) == 1


def test_deep_and_long_sources():
    assert islands.node_rows("p", "(" * 20_000, "c")[0][5] == "module"
    took = []
    for n in (10_000, 40_000):
        source = "\n".join(f"x{i} = f(y{i}, {i})" for i in range(n)) + "\n" * n
        began = time.time()
        rows = islands.node_rows("p", source, "javascript")
        took.append(time.time() - began)
        assert sum(x[5] == "call" for x in rows) == n
    assert took[1] < 12 * took[0]


def test_arguments_are_the_calls_children():
    rows = islands.node_rows("p", "f(a, b + c, g(1), (x) => { y() }, {k: h(2)}, [z], -n)", "javascript")
    call = next(x for x in rows if x[6] == "f" and x[5] == "call")
    kin = [x for x in rows if x[2] == call[1]]
    assert [x[8] for x in kin] == ["f", *call[7]] and [x[5] for x in kin] == ["identifier", "identifier", "binary_op", "call", "function_def", "dict", "list", "unary_op"]
