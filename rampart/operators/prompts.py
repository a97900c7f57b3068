"""Prompt scanning: findings, decoded content, escalation, composites, score, action."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.columns import cases, js_round, lookup
from ..sources.stored import stored
from .match import rule_rows

FIELDS = ("rule_id", "category", "severity", "confidence", "risk_score", "action")


def expand_code_blocks(text: Column) -> Column:
    """The text, then the inside of every fenced block, by line feeds."""
    inner = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```(?:\w+)?\n?(.*?)```"), F.lit(1)), lambda x: x)
    return F.array_join(F.concat(F.array(text), inner), "\n")


def pattern_hits(prompts: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """One finding for each prompt and rule, by the rule's first pattern that matches.

    prompts: prompt_id and ``text``; rules: rule_id, pattern_idx, pattern, and the FIELDS. The patterns are
    literals of one projection, a rule's in their order: one pass over the prompts, no join, no shuffle.
    """
    tests = []
    for _, rows in groupby(rule_rows(rules), key=lambda r: r.rule_id):
        tries = []
        for r in rows:
            values = [F.lit(r[c]).cast("int" if c == "risk_score" else "string").alias(c) for c in FIELDS]
            matched = F.left(F.regexp_extract(F.col("_t"), r.pattern, 0), F.lit(100)).alias("matched_text")
            tries.append(F.when(F.col("_t").rlike(r.pattern), F.struct(*values, matched)))
        tests.append(F.coalesce(*tries))
    told = prompts.select("prompt_id", F.col(text).alias("_t"))
    if not tests:
        return told.select("prompt_id", *(F.lit(None).cast("int" if c == "risk_score" else "string").alias(c) for c in (*FIELDS, "matched_text"))).where("false")
    return told.select("prompt_id", F.explode(F.array_compact(F.array(*tests))).alias("f")).select("prompt_id", "f.*")


def decoded_hits(prompts: DataFrame, rules: DataFrame, text: str = "text", least: int = 40) -> DataFrame:
    """Findings in base64 runs of at least ``least`` characters that decode to over 70 % printable text."""
    run = F.explode(F.regexp_extract_all(text, F.lit(rf"[A-Za-z0-9+/]{{{least},}}={{0,2}}"), F.lit(0)))
    runs = prompts.select("prompt_id", run.alias("run"))
    body = F.rtrim(F.col("run"), F.lit("="))
    whole = F.when(F.length(body) % 4 == 1, F.substr(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    padded = F.concat(whole, F.repeat(F.lit("="), (4 - F.length(whole) % 4) % 4))
    shown = F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    decoded = runs.withColumn("plain", shown).withColumn("printable", F.length(F.regexp_replace("plain", r"[^ -~\n\r\t]", "")) / F.greatest(F.length("plain"), F.lit(1)))
    found = pattern_hits(decoded.where("printable > 0.7"), rules, "plain")
    return found.withColumn("rule_id", F.concat("rule_id", F.lit(".base64-decoded")))


def prior_hits(turns: DataFrame, hits: DataFrame) -> DataFrame:
    """turns (prompt_id, conv_id, turn) with how many earlier turns of the conversation have a hit."""
    flagged = turns.join(hits.select("prompt_id").distinct().withColumn("_hit", F.lit(1)), "prompt_id", "left")
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return flagged.withColumn("prior", F.coalesce(F.sum(F.coalesce("_hit", F.lit(0))).over(before), F.lit(0)).cast("int")).drop("_hit")


def escalation(findings: DataFrame, prior: DataFrame) -> DataFrame:
    """A multi-turn finding for each prompt with findings after earlier turns with hits."""
    hot = findings.select("prompt_id").distinct().join(prior.where("prior > 0").select("prompt_id", "prior"), "prompt_id")
    again = F.col("prior") >= 2
    return hot.select(
        "prompt_id",
        F.lit("multi-turn.escalation").alias("rule_id"),
        F.lit("prompt-injection-multi-turn").alias("category"),
        F.when(again, "ERROR").otherwise("WARNING").alias("severity"),
        F.when(again, "HIGH").otherwise("MEDIUM").alias("confidence"),
        F.least(F.lit(90), 50 + 15 * F.col("prior")).cast("int").alias("risk_score"),
        F.when(again, "BLOCK").otherwise("WARN").alias("action"),
        F.concat(F.lit("escalation across "), (F.col("prior") + 1).cast("string"), F.lit(" conversation turns")).alias("matched_text"),
    )


def composites(findings: DataFrame) -> DataFrame:
    """A finding for each prompt whose findings combine several kinds of attack."""
    has = lambda *names: F.bool_or(F.col("category").isin(*names)).cast("int")
    kinds = (
        has("prompt-injection-jailbreak", "prompt-injection-context")
        + has("prompt-injection-encoded", "obfuscation")
        + has("social-engineering")
        + has("prompt-injection-output", "exfiltration")
        + has("prompt-injection-privilege")
    )
    seen = findings.groupBy("prompt_id").agg(F.count("*").alias("n"), F.count_distinct("category").alias("c"), kinds.alias("k")).where("n >= 2 and (k >= 3 or (k >= 2 and c >= 3))")
    multi = F.col("k") >= 3
    pick = lambda a, b: F.when(multi, a).otherwise(b)
    return seen.select(
        "prompt_id",
        pick("composite.multi-vector-attack", "composite.cross-category-escalation").alias("rule_id"),
        F.lit("prompt-injection-content").alias("category"),
        pick("ERROR", "WARNING").alias("severity"),
        pick("HIGH", "MEDIUM").alias("confidence"),
        pick(95, 75).cast("int").alias("risk_score"),
        pick("BLOCK", "WARN").alias("action"),
        F.concat(pick(F.col("k"), F.col("c")).cast("string"), pick(" attack vectors across ", " categories across "), F.col("n").cast("string"), F.lit(" findings")).alias("matched_text"),
    )


def verdicts(prompts: DataFrame, findings: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """Score, level and action of every prompt; prompts without findings are allowed with score 0."""
    risk = F.coalesce(F.nullif(F.col("risk_score"), F.lit(0)), F.lit(50)).cast("double")
    weight, factor = lookup(F.col("category"), T.CATEGORY_WEIGHTS, 0.5), lookup(F.coalesce("confidence", F.lit("MEDIUM")), T.CONFIDENCE_FACTORS, 0.7)
    acts = lambda a: F.bool_or(F.coalesce("action", F.lit("WARN")) == a)
    per = findings.groupBy("prompt_id").agg(
        F.count("*").alias("findings"),
        F.aggregate(F.array_sort(F.collect_list(risk / 100 * weight * factor * 100)), F.lit(0.0), lambda a, x: a + x).alias("_sum"),
        F.count_distinct(F.coalesce("category", F.lit("unknown"))).alias("categories"),
        F.bool_or(F.col("severity") == "ERROR").alias("_e"),
        F.bool_or(F.col("severity") == "WARNING").alias("_w"),
        acts("BLOCK").alias("_block"),
        acts("WARN").alias("_warn"),
        acts("LOG").alias("_log"),
    )
    told = prompts.select("prompt_id").join(per, "prompt_id", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))
    several = F.col("findings") > 1
    score = F.col("_sum") / F.col("findings")
    score = score * F.when(several & (F.col("categories") > 1), 1.15).otherwise(1.0) * F.when(several & F.col("_e") & F.col("_w"), 1.1).otherwise(1.0)
    score = F.least(F.lit(100.0), score * (1 + (F.col("findings") - 1) * 0.05))
    score = {"high": F.least(F.lit(100.0), score * 1.5), "low": score * 0.5}.get(sensitivity, score)
    block, warn, log = T.THRESHOLDS[sensitivity]
    flag = lambda c: F.coalesce(c, F.lit(False))
    s = F.col("risk_score")
    action = cases([(flag(F.col("_block")) | (s >= min(block, T.CRITICAL_SCORE)), "BLOCK"), (flag(F.col("_warn")) | (s >= warn), "WARN"), (flag(F.col("_log")) | (s >= log), "LOG")], "ALLOW")
    # A prompt's few terms are added in ascending order, so that reruns agree to the last bit.
    told = told.withColumn("risk_score", F.when(F.col("findings") == 0, F.lit(0)).otherwise(js_round(score)))
    return told.select("prompt_id", "findings", F.coalesce("categories", F.lit(0)).alias("categories"), "risk_score", cases(((s >= at, name) for at, name in T.LEVELS), "NONE").alias("risk_level"), action.alias("action"))


#: Fixed values of the editor's profile: weights of categories, levels, and the score from which an action is taken.
EDITOR_WEIGHTS = {
    "exfiltration": 1.0, "malicious-injection": 1.0, "system-manipulation": 1.0, "social-engineering": 0.8, "obfuscation": 0.7, "agent-manipulation": 0.9, "prompt-injection": 0.9,
    "prompt-injection-content": 0.9, "prompt-injection-jailbreak": 0.85, "prompt-injection-extraction": 0.9, "prompt-injection-delimiter": 0.8,
}
EDITOR_LEVELS = ((85, "CRITICAL"), (70, "HIGH"), (50, "MEDIUM"), (25, "LOW"))


def editor_verdicts(prompts: DataFrame, findings: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """The editor's score, level and action: a tenth more for each further finding, no bonus for kinds, no composites."""
    points = F.col("risk_score").cast("double") / 100 * lookup(F.col("category"), EDITOR_WEIGHTS, 0.5) * lookup(F.coalesce("confidence", F.lit("MEDIUM")), T.CONFIDENCE_FACTORS, 0.7) * 100
    acts = lambda a: F.bool_or(F.col("action") == a)
    per = findings.groupBy("prompt_id").agg(F.count("*").alias("findings"), F.aggregate(F.array_sort(F.collect_list(points)), F.lit(0.0), lambda a, x: a + x).alias("_sum"), acts("BLOCK").alias("_block"), acts("WARN").alias("_warn"), acts("LOG").alias("_log"))
    n = F.col("findings")
    score = F.col("_sum") / n
    score = F.when(n > 1, F.least(F.lit(100.0), score * (1 + (n - 1) * 0.1))).otherwise(score)
    score = {"high": F.least(F.lit(100.0), score * 1.2), "low": score * 0.8}.get(sensitivity, score)
    told = prompts.select("prompt_id").join(per, "prompt_id", "left").withColumn("risk_score", F.when(F.col("findings").isNull(), F.lit(0)).otherwise(js_round(score)).cast("int"))
    s, flag = F.col("risk_score"), lambda c: F.coalesce(F.col(c), F.lit(False))
    action = cases([(flag("_block") | (s >= 70), "BLOCK"), (flag("_warn") | (s >= 50), "WARN"), (flag("_log") | (s >= 25), "LOG")], "ALLOW")
    return told.select("prompt_id", F.coalesce("findings", F.lit(0)).alias("findings"), "risk_score", cases(((s >= at, name) for at, name in EDITOR_LEVELS), "NONE").alias("risk_level"), action.alias("action"))


def recommendations(findings: DataFrame) -> DataFrame:
    """prompt_id, recommendations: those of the findings' categories, in the order in which a category is first seen, without repeats.

    Rules are tried in order of their ids, so a category is first seen at its least rule_id. Categories without
    a recommendation of their own share one.
    """
    known = F.coalesce("category", F.lit("unknown"))
    kind = F.when(known.isin(*T.RECOMMENDATIONS), known).otherwise("")
    said = cases(((F.col("kind") == c, F.array(*map(F.lit, texts))) for c, texts in T.RECOMMENDATIONS.items()), F.array(F.lit(T.REVIEW)))
    first = findings.groupBy("prompt_id", kind.alias("kind")).agg(F.min("rule_id").alias("seen"))
    per = first.groupBy("prompt_id").agg(F.sort_array(F.collect_list(F.struct("seen", "kind", said.alias("said")))).alias("kinds"))  # as many as there are categories
    return per.select("prompt_id", F.flatten(F.col("kinds.said")).alias("recommendations"))


def audit(text: Column) -> Column:
    return F.struct(F.left(F.sha2(text, 256), F.lit(16)).alias("prompt_hash"), F.length(text).alias("prompt_length"))


def scan(prompts: DataFrame, rules: DataFrame, decoded_rules: DataFrame | None = None, sensitivity: str = "medium") -> tuple[DataFrame, DataFrame]:
    """(findings, verdicts) of conversations' turns: prompt_id, conv_id, turn, text.

    The prompts are matched once with their code blocks and once as they stand, for the turns before; what
    is found is stored, and escalation, composites and verdicts work on that.
    """
    direct = pattern_hits(prompts.withColumn("_full", expand_code_blocks(F.col("text"))), rules, "_full")
    found = stored(direct.unionByName(decoded_hits(prompts, rules if decoded_rules is None else decoded_rules)), "hits")
    prior = prior_hits(prompts.select("prompt_id", "conv_id", "turn"), pattern_hits(prompts, rules))
    found = stored(found.unionByName(escalation(found, prior)), "escalated")
    found = found.unionByName(composites(found))
    return found, verdicts(prompts, found, sensitivity)
