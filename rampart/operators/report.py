"""Results for readers: three verbosities, SARIF, top lists, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cases
from .match import first_of

#: Errors first, then warnings, then the rest.
ORDER = {"error": 0, "warning": 1}
LEVELS = {"error": "error", "warning": "warning", "info": "note"}


def minimal(findings: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    return findings.agg(F.count("*").alias("total"), n("error").alias("critical"), n("warning").alias("warning"), n("info").alias("info"))


def compact(findings: DataFrame) -> DataFrame:
    """The columns a reader needs, lines counted from 1."""
    return findings.select("path", (F.col("line") + 1).alias("line"), "rule_id", "severity")


def full(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct("*")).alias("finding"))


def worst(findings: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` findings by severity, then place; errors come first."""
    rank = cases(((F.col("severity") == s, n) for s, n in ORDER.items()), 2)
    return findings.withColumn("rank", rank).orderBy("rank", "path", "line", "rule_id").limit(limit)


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Each rule once, by its first finding, with its level and place in the run's list."""
    first = first_of(findings, ["rule_id"], "path", "line", "severity")
    return first.select("rule_id", cases(((F.col("severity") == s, v) for s, v in LEVELS.items()), "warning").alias("level"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One result a finding: rule, level, uri, line from 1, fingerprint of the trimmed line."""
    level = cases(((F.col("severity") == s, v) for s, v in LEVELS.items()), "warning")
    return findings.select("rule_id", level.alias("level"), F.col("path").alias("uri"), (F.col("line") + 1).alias("start_line"), F.sha2(F.trim("text"), 256).alias("fingerprint"))


def sarif_document(findings: DataFrame, tool: str = "rampart", version: str = "1.0.0") -> DataFrame:
    """One row with the SARIF 2.1.0 text. For a scan's results, which a reader must be able to open."""
    results = sarif_results(findings).select(
        F.struct(
            F.col("rule_id").alias("ruleId"),
            "level",
            F.struct(F.col("rule_id").alias("text")).alias("message"),
            F.array(F.struct(F.struct(F.struct("uri").alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
            F.create_map(F.lit("primaryLocationLineHash"), "fingerprint").alias("partialFingerprints"),
        ).alias("r")
    )
    rules = sarif_rules(findings).select(F.struct(F.col("rule_id").alias("id"), F.struct(F.col("level").alias("level")).alias("defaultConfiguration")).alias("r"))
    driver = rules.agg(F.array_sort(F.collect_list("r")).alias("rules")).select(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), "rules").alias("driver"))
    run = results.agg(F.array_sort(F.collect_list(F.to_json("r"))).alias("results"))
    body = F.concat(F.lit('{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":'), F.to_json("driver"), F.lit('},"results":['), F.array_join("results", ","), F.lit("]}]}"))
    return driver.crossJoin(run).select(body.alias("sarif"))  # one row each


def save_snapshot(findings: DataFrame, path: str, scan_date: str) -> None:
    """Appends a scan's findings to the history, by date."""
    findings.withColumn("scan_date", F.lit(scan_date)).write.mode("append").partitionBy("scan_date").json(path)
