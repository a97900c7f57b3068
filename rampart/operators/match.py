"""Detection: line detectors, look-aheads, regex rules, applicability, exact dedup."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import cases
from ..sources.detectors import LOOK_AHEADS, Detector, detectors

#: Languages that share another's detectors.
SHARED = {"cpp": "c", "typescript": "javascript"}


def detected(table: Iterable[Detector] | None = None, languages: Iterable[str] | None = None) -> Column:
    """Array of the detectors of its language that apply to a line (columns language, text), by seq: seq (the detector's place), rule_id, severity, confidence."""
    kinds = set(languages) if languages else None
    lang = cases(((F.col("language") == k, v) for k, v in SHARED.items()), F.col("language"))
    tests = []
    for seq, d in enumerate(table or detectors()):
        if kinds and d.language not in kinds:
            continue
        hit = (lang == d.language) & F.col("text").rlike(d.pattern)
        if d.also_contains:
            hit &= F.contains("text", F.lit(d.also_contains))
        if d.unless:
            hit &= ~F.col("text").rlike(d.unless)
        tests.append(F.when(hit, F.struct(F.lit(seq).alias("seq"), F.lit(d.rule_id).alias("rule_id"), F.lit(d.severity).alias("severity"), F.lit(d.confidence).alias("confidence"))))
    return F.array_compact(F.array(*tests))


def detect(lines: DataFrame, table: Iterable[Detector] | None = None, languages: Iterable[str] | None = None) -> DataFrame:
    """One finding for each line and detector of its language that applies.

    lines: path, language, line, text. Returns path, language, line, text, seq (the detector's place),
    rule_id, severity, confidence, engine. All detectors are literal predicates of one projection, gated by
    language: no join, no shuffle, one pass.
    """
    found = lines.select("path", "language", "line", "text", F.explode(detected(table, languages)).alias("f"))
    return found.select("path", "language", "line", "text", "f.*", F.lit("regex-fallback").alias("engine"))


def detect_look_ahead(lines: DataFrame) -> DataFrame:
    """Manifest detectors that look at the next lines; the finding sits on the header line."""
    lines = lines.where("language = 'kubernetes'")
    order = W.partitionBy("path").orderBy("line")
    parts = []
    for header, marker, ahead, rule in LOOK_AHEADS:
        seen = F.max(F.col("text").rlike(marker).cast("int")).over(order.rowsBetween(1, ahead))
        parts.append(F.when(F.col("text").rlike(header) & (F.coalesce(seen, F.lit(0)) == 1), F.lit(rule)))
    found = lines.select("path", "language", "line", "text", F.array(*parts).alias("rules"))
    return found.select("path", "language", "line", "text", F.explode(F.array_compact("rules")).alias("rule_id"), F.lit("warning").alias("severity"), F.lit("MEDIUM").alias("confidence"), F.lit("regex-fallback").alias("engine"))


def rule_rows(rules: DataFrame, most: int | None = 20_000) -> list[Row]:
    """The rows of a rule table, which is configuration; more than ``most`` are refused, not cut (None: as many as there are).

    Patterns that stand in the plan as literals are compiled once a task and need neither a join nor a shuffle.
    """
    rows = (rules if most is None else rules.limit(most + 1)).collect()
    if most is not None and len(rows) > most:
        raise ValueError(f"a rule table of more than {most} patterns")
    return sorted(rows, key=lambda r: (r.rule_id, r.pattern_idx))


def spans(text: Column, pattern: str | Column) -> Column:
    """Array of (start, matched) of every match of a regex, starts in code points from 0.

    A match begins where the pieces before it and the matches before it end. The pieces are those of a split
    by the same pattern, which leaves out the empty one before an empty match at the very beginning.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    all_ = F.regexp_extract_all(text, regex, F.lit(0))
    pieces = F.split(text, regex, -1)

    def placed(a: Column, p: Column) -> Column:
        gaps = F.when(F.size(p) == F.size(a), F.concat(F.array(F.lit("")), p)).otherwise(p)
        sizes = F.zip_with(gaps, a, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"), m.alias("matched")))
        step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), x["matched"].alias("matched")))).alias("out"))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,matched:string>>").alias("out"))
        return F.aggregate(F.filter(sizes, lambda x: x["matched"].isNotNull()), begin, step, lambda acc: acc["out"])

    both = F.transform(F.array(F.struct(all_.alias("a"), pieces.alias("p"))), lambda x: placed(x["a"], x["p"]))
    return F.get(both, F.lit(0))


FOUND = "struct<rule_id:string,pattern_idx:int,severity:string,all:array<struct<start:int,matched:string>>>"


def _code(lines: DataFrame) -> DataFrame:
    stripped = F.trim("text")
    return lines.where((stripped != "") & ~F.startswith(stripped, F.lit("#")) & ~F.startswith(stripped, F.lit("//")) & ~F.startswith(stripped, F.lit("*")))


def regex_scan(lines: DataFrame, rules: DataFrame, many: int = 400) -> DataFrame:
    """Lines against a table of rules (rule_id, pattern_idx, pattern, languages, severity): every match of every pattern.

    Blank and comment lines are skipped first; matching ignores case. Up to ``many`` patterns are literals of
    one projection (``rule_rows``): one pass, no join, no shuffle; more of them are looked for through their
    required strings first (``many.scan``). Returns one row a match, with its number and its start within
    the line.
    """
    rows = rule_rows(rules, most=None)
    if len(rows) > many:
        from . import many as many_

        return many_.scan(_code(lines), rows)
    return scan_all(_code(lines), rows)


def scan_all(code: DataFrame, rows: Iterable[Row]) -> DataFrame:
    """Every pattern as a literal predicate of one projection."""
    tests = []
    for r in rows:
        p, languages = f"(?i){r.pattern}", r.languages or []
        hit = F.col("text").rlike(p) if "generic" in languages else F.col("language").isin(*languages) & F.col("text").rlike(p)
        found = F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.pattern_idx).alias("pattern_idx"), F.lit(r.severity).cast("string").alias("severity"), spans(F.col("text"), p).alias("all"))
        tests.append(F.when(hit, found.cast(FOUND)))
    hits = code.select("path", "language", "line", "text", F.explode(F.array_compact(F.array(*tests))).alias("f")) if tests else code.select("*", F.lit(None).cast(FOUND).alias("f")).where("false")
    return _told(hits)


def _told(hits: DataFrame) -> DataFrame:
    each = hits.select("path", "language", "line", "text", "f.rule_id", "f.pattern_idx", "f.severity", F.posexplode("f.all").alias("match_no", "m"))
    return each.select("path", "language", "line", "text", "rule_id", "pattern_idx", "severity", "match_no", "m.matched", "m.start")


def applicable(rules: DataFrame, language: str, categories: Iterable[str], noisy: Iterable[str]) -> DataFrame:
    """Rules for a language (or generic) of the given categories, without the noisy ids."""
    fits = F.array_contains("languages", F.lit(language)) | F.array_contains("languages", F.lit("generic"))
    return rules.where(fits & F.col("category").isin(*categories) & ~F.col("rule_id").isin(*noisy))


def first_of(rows: DataFrame, keys: Iterable[str], *order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def exact_dedup(findings: DataFrame) -> DataFrame:
    """Distinct (path, rule_id, line, column), the first by seq."""
    return first_of(findings, ["path", "rule_id", "line", "column"], "seq")
