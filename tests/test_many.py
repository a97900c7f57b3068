"""Required strings, scans of many patterns against the plain scan, starts of matches, and the index of deletion neighbours."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rampart.operators import many, match, packages

KINDS = "rule_id string, pattern_idx int, pattern string, severity string, languages array<string>"


@pytest.mark.parametrize(
    ("pattern", "strings"),
    [
        ("password", {"password"}), ("(?i)PassWord\\s*=", {"password"}), ("a|bcd", None), ("abc|defg", {"abc", "defg"}), ("(abc)?def", {"def"}), ("(abc)+x", {"abc"}), ("(?:ab|cd)ef", None), ("x(?:abc|def)", {"abc", "def"}),
        ("[abc]def", {"def"}), ("ab*c", None), ("a.c", None), ("^import\\b", {"import"}), ("(?=secret)x", None), ("foo(?!bar)", {"foo"}), ("\\p{L}abcd", None), ("abc(", None), ("", None), ("eval\\(.*request", {"request"}), ("(?x) a b c", None), ("AKIA[0-9A-Z]{16}", {"akia"}),
    ],
)
def test_required(pattern, strings):
    got = many.required(pattern)
    assert (set(got) if got else None) == strings


def test_required_strings_are_in_every_match():
    r = random.Random(1)
    part = lambda: r.choice(["abc", "x", "[ab]+", "(?:foo|barr)", "(?:q|rst)?", "\\d{2,3}", "secret", "(?:no){2}", ".", "\\bkey\\b"])
    seen = 0
    for _ in range(400):
        p = "".join(part() for _ in range(r.randrange(1, 5)))
        need = many.required(p)
        for _ in range(30):
            text = "".join(r.choice(["abc", "x", "a", "foo", "barr", "rst", "12", "secret", "nono", " key ", "ABC", "Z"]) for _ in range(6))
            for m in re.finditer(p, text, re.I):
                seen += 1
                assert need is None or any(s in m[0].lower() for s in need)
    assert seen > 1000


def test_many_rules_find_the_same(spark):
    """2,000 rules: the automaton's scan, and the plain one in parts."""
    r = random.Random(2)
    words = ["".join(r.choices("abcdef", k=r.randrange(3, 7))) for _ in range(900)]
    rules = []
    for k in range(2000):
        w, v = r.choice(words), r.choice(words)
        p = r.choice([w, rf"\b{w}\b", rf"{w}\s*=\s*\d+", rf"(?:{w}|{v})\(", rf"{w}.*{v}", rf"[{w[:2]}]{v}", rf"({w})?{v}$"]) if k % 50 else r.choice([r"\d{4,}", "a.b", r"^\s*x"])
        rules.append((f"r{k}", k % 3, p, "warning", r.choice([["generic"], ["python"], ["go", "python"], None])))
    lines = [(f"f{i % 9}", r.choice(["python", "go", "c"]), i, " ".join(r.choice([r.choice(words), r.choice(words).upper() + " = 12", r.choice(words) + "(x)", "12345", "é"]) for _ in range(6))) for i in range(400)] + [("f", "python", 999, None), ("f", "python", 1000, "")]
    told = spark.createDataFrame(lines, "path string, language string, line int, text string")
    table = spark.createDataFrame(rules, KINDS)
    rows = match.rule_rows(table, None)
    assert 10 < sum(many.required(x.pattern) is None for x in rows) < 400
    got = sorted(map(tuple, many.scan(told, rows).collect()), key=str)
    plain = []
    for path, language, line, text in lines:
        for x in rows if text else ():
            if language in (x.languages or []) or "generic" in (x.languages or []):
                plain += [(path, language, line, text, x.rule_id, x.pattern_idx, x.severity, n, m[0], m.start()) for n, m in enumerate(re.finditer(x.pattern, text, re.I))]
    plain.sort(key=str)
    assert got == plain and len(got) > 2000
    assert sorted(map(tuple, match.regex_scan(told, table).collect()), key=str) == plain
    picked, _ = many.candidates(told, rows)
    assert picked.count() < 0.05 * 2000 * 400


def test_starts(spark):
    texts = ["", "a", "aaa", "banana", "--x--", "日本a日本a", "a\nb", "x" * 50, "\U0001F600a\U0001F600"]
    for p in ("a", "a*", "(?:)", "an|na", "$", "^", r"\b", "x{3}", "(a)(b)?", "[^a]", "(?<=a).", "\U0001F600"):
        df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", match.spans(F.col("t"), p).alias("s"), match.spans(F.col("t"), F.lit(p)).alias("u"))
        for row in df.collect():
            if "\U0001F600" in row.t and re.search(p, "") is not None:
                continue  # Java's engine finds an empty match between the halves of such a character
            want = [(m.start(), m[0]) for m in re.finditer(p, row.t)]
            if p in ("$", r"\b", "(?:)", "a*"):
                want = [x for x in want if p != "$" or x[0] == len(row.t) or row.t[x[0] :] == "\n"]
            assert [(x.start, x.matched) for x in row.s] == want == [(x.start, x.matched) for x in row.u], (p, row.t)


def test_deletion_neighbours(spark):
    r = random.Random(3)
    name = lambda: "".join(r.choices("abcE-", k=r.randrange(1, 9)))
    popular = [("npm", name()) for _ in range(80)] + [("pypi", name()) for _ in range(40)]
    asked = [("npm", name()) for _ in range(120)] + [("pypi", "x" * 214), ("pypi", ""), ("cargo", "abc")]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    near = {(e, n, p) for e, n in asked for f, p in popular if e == f and n.lower() != p.lower() and distance(n.lower(), p.lower()) <= 2}
    a, p = spark.createDataFrame(asked, "ecosystem string, name string"), spark.createDataFrame(popular, "ecosystem string, name string")
    told = {tuple(x) for x in packages.squat_candidates(a, p).collect()}
    assert near <= told and len(near) > 100
    scored = {(x.ecosystem, x.name, x.similar_to) for x in packages.typosquats(a, p, limit=10**6).collect()}
    assert scored == {x for x in near if (x[0], x[1]) not in set(popular)}


def test_candidates_of_a_large_registry(spark):
    """3,000 names against 3,000: candidates are a few a name, not millions."""
    r = random.Random(4)
    names = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(6, 14))) for _ in range(3000)]
    typo = [n[:k] + r.choice("xyz") + n[k + 1 :] for n in names if (k := r.randrange(len(n))) is not None]
    p = spark.createDataFrame([("npm", n) for n in names], "ecosystem string, name string")
    a = spark.createDataFrame([("npm", n) for n in typo], "ecosystem string, name string")
    assert 2500 < packages.squat_candidates(a, p).count() < 9000
