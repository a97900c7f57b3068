"""From findings to verdicts: classes, dedup, context, frameworks, configuration, counts, grades, policy."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.columns import any_of, cases, confidence_rank, engine_rank, glob_matches, grade, matches_any, severity_rank, vulnerability_class


def cross_engine_dedup(findings: DataFrame, *more: Column) -> DataFrame:
    """One finding for each path, line and class: that of the best engine (first by seq), with the greatest severity.

    findings: path, line, rule_id, severity, engine, seq. engines_matched lists the engines, best first,
    where more than one finding met. ``more`` are aggregates that the result has too. One shuffle; arg-max
    aggregates instead of a window.
    """
    ranked = findings.withColumn("vuln_class", vulnerability_class(F.col("rule_id"))).withColumn("_e", engine_rank(F.col("engine")))
    best = F.struct(F.col("_e"), -F.col("seq"))
    merged = ranked.groupBy("path", "line", "vuln_class").agg(
        F.max_by("rule_id", best).alias("rule_id"),
        F.max_by("engine", best).alias("engine"),
        F.max(F.struct(severity_rank(F.col("severity")), "severity"))["severity"].alias("severity"),
        F.count("*").alias("n"),
        F.reverse(F.array_sort(F.collect_set(F.struct("_e", "engine"))))["engine"].alias("_engines"),
        *more,
    )
    return merged.withColumn("engines_matched", F.when(F.col("n") > 1, F.array_join("_engines", ","))).drop("_engines")


def is_import_only(line: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(line), r"\s*//.*$", ""), r"\s*#(?!!).*$", ""))
    return (bare != "") & matches_any(bare, T.IMPORT_LINES)


def imported_module(line: Column) -> Column:
    """The module a line imports; null if none."""
    tries = (r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", r"from\s+['\"]([^'\"]+)['\"]", r"^\s*import\s+([a-zA-Z_][\w]*)", r"^\s*from\s+([a-zA-Z_][\w]*)")
    return F.coalesce(*(F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in tries))


def context_filter(findings: DataFrame, known_modules: DataFrame | None = None) -> DataFrame:
    """Drops suppressed findings and known imports; lowers hash findings on checksums and secrets in test files.

    findings: path, language, text (of the line), rule_id, severity; known_modules: language, module.
    """
    low = F.lower("rule_id")
    checksum = any_of(low, ("md5", "sha1")) & any_of(F.lower("text"), T.HASH_USES)
    tested = F.col("path").rlike(T.TEST_PATHS) & any_of(low, T.SECRET_IDS)
    after = F.when(checksum, F.lit("info")).otherwise(F.col("severity"))
    kept = (
        findings.where(~F.coalesce(F.col("text").rlike(T.NOSEC), F.lit(False)))
        .withColumn("context_note", cases([(tested & (after == "error"), "Hardcoded secret in test file"), (checksum, "Non-security hash usage (checksum/digest/etag)")], F.lit(None).cast("string")))
        .withColumn("severity", F.when(tested & (after == "error"), F.lit("warning")).otherwise(after))
    )
    if known_modules is None:
        return kept
    named = imported_module(F.col("text"))
    known = known_modules.select(F.col("language").alias("_l"), F.col("module").alias("_m")).distinct()
    asked = kept.withColumn("_name", F.when(is_import_only(F.col("text")), named)).withColumn("_base", F.split_part("_name", F.lit("/"), F.lit(1)))
    return asked.join(known, (F.col("language") == F.col("_l")) & ((F.col("_m") == F.col("_name")) | (F.col("_m") == F.col("_base"))), "left_anti").drop("_name", "_base")


def detect_frameworks(files: DataFrame) -> DataFrame:
    """files (path, language, text) with the array of frameworks they show, in table order."""
    tests = [F.when(F.col("language").isin(*langs) & F.col("text").rlike(pattern), F.lit(name)) for name, pattern, langs, *_ in T.FRAMEWORKS]
    return files.withColumn("frameworks", F.array_compact(F.array(*tests)))


def framework_rewrite(findings: DataFrame) -> DataFrame:
    """Sets the severity that the first of the file's frameworks gives a rule it mitigates.

    findings: rule_id, severity, frameworks.
    """
    low = F.lower("rule_id")
    hits = [(F.array_contains("frameworks", F.lit(name)) & any_of(low, parts), name, to) for name, _, _, parts, to in T.FRAMEWORKS]
    return findings.withColumn("framework_mitigated", cases(((c, n) for c, n, _ in hits), F.lit(None).cast("string"))).withColumn("severity", cases(((c, to) for c, _, to in hits), F.col("severity")))


def suppress(findings: DataFrame, rules: Iterable[Mapping], exclude: Iterable[str] = ()) -> DataFrame:
    """Without findings whose path is excluded, or whose rule (a glob) is suppressed, everywhere or on some paths."""
    gone = glob_matches(F.col("path"), list(exclude))
    for r in rules:
        rule = {"rule": r} if isinstance(r, str) else r
        hit = glob_matches(F.col("rule_id"), [rule["rule"]])
        gone = gone | (hit & glob_matches(F.col("path"), rule["paths"]) if rule.get("paths") else hit)
    return findings.where(~gone)


def thresholds(findings: DataFrame, severity: str = "info", confidence: str = "LOW") -> DataFrame:
    return findings.where((severity_rank(F.col("severity")) >= T.SEVERITY_RANK.get(severity, 0)) & (confidence_rank(F.col("confidence")) >= T.CONFIDENCE_RANK.get(confidence, 0)))


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings, errors, warnings and infos by key."""
    return findings.groupBy(*keys).agg(F.count("*").alias("issues"), *(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")))


def project_grades(counts: DataFrame) -> DataFrame:
    """counts: files, issues, errors; adds density and grade."""
    return counts.withColumn("density", F.when(F.col("files") == 0, F.lit(0.0)).otherwise(F.col("issues").cast("double") / F.col("files"))).withColumn("grade", grade(F.col("issues"), F.col("errors"), F.col("files")))


def server_grades(counts: DataFrame) -> DataFrame:
    """The same for servers: infos alone don't spoil an A."""
    clean = (F.col("files") == 0) | ((F.col("errors") == 0) & (F.col("warnings") == 0))
    return counts.withColumn("grade", F.when(clean, F.lit("A")).otherwise(grade(F.col("issues"), F.col("errors"), F.col("files"))))


GRADES = {"F": 0, "D": 1, "C": 2, "B": 3, "A": 4}


def policy(results: DataFrame, block_on: str = "error", max_critical: int | None = None, max_warning: int | None = None, required_grade: str | None = None) -> DataFrame:
    """results: errors, warnings, infos, grade; adds violations (array) and passed."""
    counted = {"error": F.col("errors"), "warning": F.col("warnings"), "info": F.col("infos")}
    order = {"info": ("info", "warning", "error"), "warning": ("warning", "error")}.get(block_on, ("error",))
    blocked = cases(((counted[k] > 0, F.format_string(f"Policy violation: found %d {k} issue(s) (block_on: {block_on})", counted[k])) for k in order), F.lit(None).cast("string"))
    told = [blocked]
    if max_critical is not None:
        told.append(F.when(counted["error"] > max_critical, F.format_string(f"Policy violation: %d critical issue(s) exceeds max_critical ({max_critical})", counted["error"])))
    if max_warning is not None:
        told.append(F.when(counted["warning"] > max_warning, F.format_string(f"Policy violation: %d warning(s) exceeds max_warning ({max_warning})", counted["warning"])))
    if required_grade:
        low = cases(((F.col("grade") == g, n) for g, n in GRADES.items()), 0) < GRADES.get(required_grade, 0)
        told.append(F.when(low, F.format_string(f"Policy violation: grade %s does not meet required_grade ({required_grade})", F.col("grade"))))
    return results.withColumn("violations", F.array_compact(F.array(*told))).withColumn("passed", F.size("violations") == 0)
