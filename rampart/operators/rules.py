"""Tables of rules: the baseline, merging with packs, selection, names and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cases
from ..sources.rule_packs import SCHEMA

#: The three rules that hold without any pack; id, severity, languages, category, confidence, patterns.
BASELINE = (
    ("python.lang.security.audit.sql-injection", "error", ("python",), "CWE-89", "MEDIUM", (
        r"execute\s*\(\s*[\"'].*\$\{.*\}.*[\"']", r"query\s*\(\s*[\"'].*\+.*[\"']", r"SELECT\s+.*\s+FROM\s+.*\s+WHERE\s+.*=.*\+", r"cursor\.execute\s*\(\s*[^)]*%.*\)",
    )),
    ("javascript.browser.security.dom-based-xss", "error", ("javascript", "typescript"), "CWE-79", "MEDIUM", (
        r"innerHTML\s*=\s*", r"outerHTML\s*=\s*", r"document\.write\s*\(", r"\.html\s*\(\s*[^)]*\+",
    )),
    ("generic.secrets.security.hardcoded-secret", "warning", ("generic",), "CWE-798", "HIGH", (
        r"(api|secret|private)[_-]?key\s*[:=]\s*[\"'][^\"']{20,}[\"']", r"password\s*[:=]\s*[\"'][^\"']{6,}[\"']", r"[\"'](sk_live_[A-Za-z0-9]{24,})[\"']",
        r"[\"'](sk_test_[A-Za-z0-9]{24,})[\"']", r"[\"'](ghp_[A-Za-z0-9]{30,})[\"']",
    )),
)


def baseline_rules(spark: SparkSession) -> DataFrame:
    """The baseline, one row a pattern."""
    rows = [(rule, k, p, severity, category, confidence, None, None, list(languages), "") for rule, severity, languages, category, confidence, patterns in BASELINE for k, p in enumerate(patterns)]
    return spark.createDataFrame(rows, SCHEMA)


def merged(packs: DataFrame, baseline: DataFrame) -> DataFrame:
    """The packs' rules, and those of the baseline whose ids no pack has."""
    return packs.unionByName(baseline.join(packs.select("rule_id").distinct(), "rule_id", "left_anti"))


def rule_name(rule_id: Column) -> Column:
    """The last part of an id in words with capitals."""
    return F.initcap(F.replace(F.element_at(F.split(rule_id, r"\."), -1), F.lit("-"), F.lit(" ")))


def audit_category(rule_id: Column) -> Column:
    """The third part of an id, or the fourth after ``lang``; null for shorter ids."""
    parts = F.split(rule_id, r"\.")
    return cases([(F.size(parts) < 3, F.lit(None).cast("string")), ((F.get(parts, F.lit(2)) == "lang") & (F.size(parts) > 3), F.get(parts, F.lit(3)))], F.get(parts, F.lit(2)))


def for_language(rules: DataFrame, language: str) -> DataFrame:
    """Rules of a language, whatever its case, or of all."""
    return rules.where(F.exists("languages", lambda x: F.lower(x).isin(language.lower(), "generic")))


def by_category(rules: DataFrame, category: str) -> DataFrame:
    """Rules whose id holds the category."""
    return rules.where(F.contains(F.lower("rule_id"), F.lit(category.lower())))


def by_severity(rules: DataFrame, severity: str) -> DataFrame:
    return rules.where(F.lower("severity") == severity.lower())


def statistics(rules: DataFrame) -> DataFrame:
    """rules (rule_id, severity, languages; one row a rule) to (kind, value, rules): in total, by severity, language and category, in one pass."""
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    kinds = F.concat(
        F.array(pair("total", F.lit("all")), pair("severity", F.lower("severity"))),
        F.transform("languages", lambda x: pair("language", F.lower(x))),
        F.filter(F.array(pair("category", audit_category(F.col("rule_id")))), lambda x: x["value"].isNotNull()),
    )
    return rules.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.value").agg(F.count("*").alias("rules"))
