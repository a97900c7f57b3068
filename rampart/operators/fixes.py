"""Fix templates: the first key that the rule id holds gives the template for the line."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import balanced, cases, first_replaced
from . import match

#: How a language reads an environment variable; any other as JavaScript does.
ENVIRONMENT = {
    "python": 'os.environ.get("%s")', "go": 'os.Getenv("%s")', "java": 'System.getenv("%s")', "php": "getenv('%s')", "ruby": 'ENV["%s"]', "csharp": 'Environment.GetEnvironmentVariable("%s")',
    "rust": 'std::env::var("%s").unwrap_or_default()', "c": 'getenv("%s")', "cpp": 'getenv("%s")',
}


def environment(language: Column, name: str) -> Column:
    """How the language reads an environment variable."""
    return cases(((language == k, v % name) for k, v in ENVIRONMENT.items()), f"process.env.{name}")


class Template(NamedTuple):
    """A fix of the table: a pattern replaced, a literal read from the environment, a note before the line, a line after it, or a command's exec form."""

    kind: str
    key: str
    pattern: str
    replacement: str
    every: bool
    #: A line that it changes.
    example: str


@lru_cache(1)
def templates() -> tuple[Template, ...]:
    """All fixes in order of precedence."""
    from importlib.resources import files

    text = files("rampart.sources").joinpath("fixes.tsv").read_text(encoding="utf-8")
    rows = (x.split("\t") for x in text.splitlines() if x and not x.startswith("# "))
    return tuple(Template(kind, key, pattern, new, times == "all", example) for kind, key, pattern, new, times, example in rows)


UNSAFE = r"\beval\s*\(|\bos\.system\s*\("


def _later(replacement: str) -> str:
    """The replacement with its groups numbered from 2, as ``first_replaced`` has them."""
    return re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", replacement)


def by_template(t: Template, language: Column, line: Column) -> Column:
    """The line as the template changes it; as it is where the pattern doesn't match."""
    if t.kind == "env":
        start, rest = (F.regexp_extract(line, f"(?s)^(.*?)({t.pattern})(.*)$", k) for k in (1, 3))
        return F.when(line.rlike(t.pattern), F.concat(start, F.lit("= "), environment(language, t.replacement), rest)).otherwise(line)
    if t.kind == "note":
        return F.concat(F.lit(f"{t.pattern} SECURITY: {t.replacement} - "), line)
    if t.kind == "after":
        return F.concat(line, F.lit(f"\n{t.replacement}"))
    if t.kind == "shell":
        return shell_form(line)
    return F.regexp_replace(line, t.pattern, t.replacement) if t.every else first_replaced(line, t.pattern, _later(t.replacement))


def fixed_line(rule_id: Column, language: Column, line: Column) -> Column:
    """The line by the rule's template; null if no template's key is part of the id."""
    low = F.lower(rule_id)
    return cases(((F.contains(low, F.lit(t.key)), by_template(t, language, line)) for t in templates()), F.lit(None).cast("string"))


def key_of(rule_id: Column) -> Column:
    """The key of the fix that a rule's id holds, the first in order of precedence; null without one."""
    low = F.lower(rule_id)
    return cases(((F.contains(low, F.lit(t.key)), t.key) for t in templates()), F.lit(None).cast("string"))


def shell_form(line: Column) -> Column:
    """A Dockerfile's RUN in exec form: the command is what the replacement is made of, its quotes escaped."""
    form = r"(?s)^(.*?)RUN\s+([^\n]+)$"
    command = F.replace(F.regexp_extract(line, form, 2), F.lit('"'), F.lit('\\"'))
    return F.when(line.rlike(form), F.concat(F.regexp_extract(line, form, 1), F.lit('RUN ["/bin/sh", "-c", "'), command, F.lit('"]'))).otherwise(line)


def _acceptable(new: Column, line: Column) -> Column:
    """A changed line whose quotes and brackets pair up, without unsafe calls."""
    return F.coalesce((new != line) & balanced(F.regexp_replace(new, r"""\\["'`]""", "")) & ~new.rlike(UNSAFE), F.lit(False))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def suggest(findings: DataFrame) -> DataFrame:
    """findings (rule_id, language, text) with fixed and fixable: a changed, balanced line without unsafe calls."""
    made = _let(fixed_line(F.col("rule_id"), F.col("language"), F.col("text")), lambda x: F.struct(x.alias("fixed"), _acceptable(x, F.col("text")).alias("fixable")))
    return findings.withColumn("_fix", made).select("*", "_fix.fixed", "_fix.fixable").drop("_fix")


def apply_fixes(lines: DataFrame, findings: DataFrame) -> DataFrame:
    """lines (path, language, line, text) with ``fixed``: a line's findings applied one after the other, by seq.

    Each finding sees what the one before left, if that was good. The findings of a line, at most one a
    detector, are gathered and folded over its text.
    """
    rules = findings.groupBy("path", "line").agg(F.array_sort(F.collect_list(F.struct("seq", "rule_id")))["rule_id"].alias("_rules"))
    told = lines.join(rules, ["path", "line"], "left")
    return told.withColumn("fixed", F.when(F.col("_rules").isNull(), F.col("text")).otherwise(_folded(F.col("_rules")))).drop("_rules")


def apply_detected(lines: DataFrame) -> DataFrame:
    """``apply_fixes`` with the findings of ``match.detect``: a line's own detectors are folded over it, in one pass without join or shuffle."""
    fixed = _let(match.detected()["rule_id"], lambda rules: F.when(F.size(rules) == 0, F.col("text")).otherwise(_folded(rules)))
    return lines.withColumn("fixed", fixed)


def _folded(rules: Column) -> Column:
    """The line after the fixes of its rules, each of what the one before left, if that was good."""
    step = lambda acc, rule: _let(fixed_line(rule, F.col("language"), acc), lambda x: F.when(_acceptable(x, acc), x).otherwise(acc))
    return F.aggregate(rules, F.col("text"), step)
