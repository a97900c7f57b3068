"""Scan history, trends, reports, benchmark outcomes and metrics."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import cases, ratio
from ..sources.stored import stored

KEY = ["rule_id", "path", "line"]


#: Findings of both scans that one task compares, about.
TOGETHER = 500_000


def new_issues(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.join(previous.select(*KEY), KEY, "left_anti")


def fixed_issues(current: DataFrame, previous: DataFrame) -> DataFrame:
    return new_issues(previous, current)


def unchanged_issues(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.join(previous.select(*KEY), KEY, "left_semi")


def compared(current: DataFrame, previous: DataFrame) -> DataFrame:
    """The different keys of both scans: KEY, now and before (how many findings have it), state (new, fixed or unchanged).

    One shuffle of keys only, dealt to tasks of about TOGETHER findings each, however many there are. As in a
    join, a key with a null is no other's equal: its findings are new or fixed.
    """
    of = lambda f, now: f.select(*KEY, F.lit(now).alias("now"))
    unequal = reduce(or_, (F.isnull(c) for c in KEY))
    both = of(current, True).unionAll(of(previous, False)).withColumn("side", F.when(unequal, F.col("now")))
    parts = max(current.sparkSession.sparkContext.defaultParallelism, -(-both.count() // TOGETHER))
    per = both.repartition(parts, *KEY).groupBy(*KEY, "side").agg(F.count_if("now").alias("now"), F.count_if(~F.col("now")).alias("before"))
    state = cases([(F.col("before") == 0, "new"), (F.col("now") == 0, "fixed")], "unchanged")
    return stored(per.select(*KEY, "now", "before", state.alias("state")), "compared")


def changes(told: DataFrame) -> DataFrame:
    """One row: how many issues of the two scans that ``compared`` told of are new, fixed and unchanged."""
    n = lambda state, c: F.coalesce(F.sum(F.when(F.col("state") == state, F.col(c))), F.lit(0)).alias(state)
    return told.agg(n("new", "now"), n("fixed", "before"), n("unchanged", "now"))


def first_of_state(issues: DataFrame, told: DataFrame, state: str, limit: int) -> DataFrame:
    """The first ``limit`` of a scan's issues by place that are in this state; only so many keys are looked for among them."""
    place = ["path", "line", "rule_id"]
    keys = told.where(F.col("state") == state).orderBy(*place).limit(limit).select(*(F.col(c).alias(f"_{c}") for c in KEY))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY))
    return issues.join(F.broadcast(keys), same, "left_semi").orderBy(*place, *(c for c in issues.columns if c not in place)).limit(limit)


def trends(scans: DataFrame, *series: str) -> DataFrame:
    """scans (ts, issues, errors, ...) in order, with the changes since the scan before, by ``series``.

    Without a series the scans are one project's: one row a scan, some thousand at most, in one window. Tables of
    many projects need their key as the series, and each project is a window of its own.
    """
    order = W.partitionBy(*series).orderBy("ts")
    return scans.withColumn("issues_delta", F.col("issues") - F.lag("issues").over(order)).withColumn("errors_delta", F.col("errors") - F.lag("errors").over(order)).withColumn("scan_no", F.row_number().over(order))


def previous_scan(scans: DataFrame, *series: str) -> DataFrame:
    """The second latest scan of each series; without one, of one project's scans (``trends``)."""
    return scans.withColumn("_n", F.row_number().over(W.partitionBy(*series).orderBy(F.desc("ts")))).where("_n = 2").drop("_n")


def snapshot_deltas(snapshots: DataFrame, *series: str) -> DataFrame:
    """snapshots (ts, precision, recall, f1) with four places, and what each changed since the one before, by ``series``; without one, of one benchmark (``trends``)."""
    order = W.partitionBy(*series).orderBy("ts")
    for c in ("precision", "recall", "f1"):
        snapshots = snapshots.withColumn(c, F.round(c, 4))
    for c in ("precision", "recall", "f1"):
        snapshots = snapshots.withColumn(f"{c}_delta", F.round(F.col(c) - F.lag(c).over(order), 4))
    return snapshots


def top_files(findings: DataFrame, limit: int = 15) -> DataFrame:
    return findings.groupBy("path").agg(F.count("*").alias("issues")).orderBy(F.desc("issues"), "path").limit(limit)


def attach_annotations(lines: DataFrame) -> DataFrame:
    """lines (path, line, text) to annotations (path, line, type, rule_pattern) of the next code line.

    Annotations are comments ``VULN: rule``, ``SAFE: rule`` or ``FP-PRONE: rule``. They stack up; a blank line
    or a plain comment clears them, a code line takes them: so an annotation belongs to the first line after
    it that is no annotation, if that is code.
    """
    comment = F.regexp_extract("text", r"^\s*(?:#|//)\s*(.*)$", 1)
    is_comment = F.col("text").rlike(r"^\s*(#|//)")
    note = r"^(VULN|SAFE|FP-PRONE)\s*:\s*(\S+)"
    kinds = cases([(is_comment & comment.rlike(note), "note"), (is_comment | (F.trim("text") == ""), "break")], "code")
    told = lines.withColumn("_c", comment).withColumn("_k", kinds)
    after = W.partitionBy("path").orderBy("line").rowsBetween(1, W.unboundedFollowing)
    target = F.first(F.when(F.col("_k") != "note", F.struct("line", "_k")), ignorenulls=True).over(after)
    found = told.withColumn("_t", target).where("_k = 'note' and _t._k = 'code'")
    return found.select("path", F.col("_t.line").alias("line"), F.regexp_extract("_c", note, 1).alias("type"), F.regexp_extract("_c", note, 2).alias("rule_pattern"))


def outcomes(annotations: DataFrame, findings: DataFrame) -> DataFrame:
    """TP, FN, FP, TN of every annotation; findings without one are UNANNOTATED_FINDING.

    annotations: path, line, type, rule_pattern; findings: path, line, rule_id. An annotation takes the least
    rule id on its line that holds its pattern.
    """
    a, f = annotations, findings.select(F.col("path").alias("_p"), F.col("line").alias("_l"), "rule_id")
    hit = (F.col("path") == F.col("_p")) & (F.col("line") == F.col("_l")) & F.contains("rule_id", F.col("rule_pattern"))
    met = a.join(f, hit, "left").groupBy("path", "line", "type", "rule_pattern").agg(F.min("rule_id").alias("rule_id"))
    seen = F.col("rule_id").isNotNull()
    kind = cases([((F.col("type") == "VULN") & seen, "TP"), (F.col("type") == "VULN", "FN"), ((F.col("type") == "SAFE") & seen, "FP"), (F.col("type") == "SAFE", "TN"), (seen, "FP_PRONE_HIT")], "FP_PRONE_MISS")
    judged = met.select("path", "line", "rule_pattern", F.when(seen, F.col("rule_id")).otherwise("").alias("rule_id"), kind.alias("outcome"))
    rest = findings.select("path", "line", "rule_id").distinct().join(judged.select("path", "line", "rule_id"), ["path", "line", "rule_id"], "left_anti")
    return judged.unionByName(rest.select("path", "line", F.lit("").alias("rule_pattern"), "rule_id", F.lit("UNANNOTATED_FINDING").alias("outcome")))


def metrics(judged: DataFrame, *groupings: str) -> DataFrame:
    """Counts, precision, recall, F1, false-positive rate and coverage, overall and by each grouping.

    All groupings come from one pass over grouping sets. A ratio of nothing is 0, coverage of nothing 1.
    """
    keys = [F.col(g) for g in groupings]
    n = lambda k: F.count_if(F.col("outcome") == k)
    grouped = judged.groupingSets([[]] + [[k] for k in keys], *keys) if groupings else judged.groupBy()
    level = F.concat_ws("+", *(F.when(F.grouping(g) == 0, F.lit(g)) for g in groupings)) if groupings else F.lit("")
    counts = grouped.agg(level.alias("level"), n("TP").alias("tp"), n("FP").alias("fp"), n("FN").alias("fn"), n("TN").alias("tn"), n("UNANNOTATED_FINDING").alias("unannotated"))
    c = F.col
    scored = counts.withColumn("precision", ratio(c("tp"), c("tp") + c("fp"))).withColumn("recall", ratio(c("tp"), c("tp") + c("fn"))).withColumn("fpr", ratio(c("fp"), c("fp") + c("tn")))
    scored = scored.withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))
    return scored.withColumn("coverage", ratio(c("tp") + c("fp"), c("tp") + c("fp") + c("unannotated"), 1.0))
