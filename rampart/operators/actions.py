"""Agent actions and server sources: rule findings and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.columns import cases


def _slug(label: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else "-" for c in label).lower()


def action_rules() -> list[tuple[str, str, str, str, str, bool]]:
    """(action_type, rule, severity, action, pattern, also on lower case), in the order of findings."""
    out = [("bash", rule, severity, action, pattern, True) for rule, severity, action, pattern in T.SHELL_RULES]
    for kind, action_of in (("file_write", "WARN"), ("file_delete", "BLOCK")):
        out += [(kind, f"{kind}.system.{_slug(n)}", "CRITICAL", "BLOCK", p, False) for n, _, p in T.SYSTEM_FILES]
        out += [(kind, f"{kind}.sensitive.{_slug(n)}", s if kind == "file_write" else "CRITICAL", action_of, p, False) for n, s, p in T.SENSITIVE_FILES]
        out += [(kind, f"{kind}.package.{_slug(n)}", s if kind == "file_write" else "HIGH", "WARN", p, False) for n, s, p in T.PACKAGE_FILES]
    out += [("file_read", f"file_read.credential.{_slug(n)}", s, "WARN", p, False) for n, s, p in T.CREDENTIAL_FILES]
    out += [("http_request", f"http.ssrf.{_slug(n)}", "CRITICAL", "BLOCK", p, False) for n, p in T.PRIVATE_ADDRESSES]
    out += [("http_request", f"http.exfiltration.{_slug(n)}", "HIGH", "WARN", p, False) for n, p in T.EXFILTRATION_HOSTS]
    return out


def _hits(kind: Column, value: Column) -> Column:
    tests = []
    for seq, (action_type, rule, severity, action, pattern, lower) in enumerate(action_rules()):
        hit = value.rlike(pattern) | F.lower(value).rlike(pattern) if lower else value.rlike(pattern)
        tests.append(F.when((kind == action_type) & hit, F.struct(F.lit(seq).alias("seq"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(action).alias("action"))))
    return F.array_compact(F.array(*tests))


def action_findings(actions: DataFrame) -> DataFrame:
    """actions (action_id, action_type, action_value) to one row a rule that applies; one pass, no shuffle."""
    found = actions.select("action_id", "action_type", F.explode(_hits(F.col("action_type"), F.col("action_value"))).alias("f"))
    return found.select("action_id", "action_type", "f.*")


def action_verdicts(actions: DataFrame) -> DataFrame:
    """Verdict (BLOCK over WARN over ALLOW), risk level and number of findings of every action; no shuffle."""
    found = actions.withColumn("_f", _hits(F.col("action_type"), F.col("action_value")))
    has = lambda field, v: F.exists("_f", lambda x: x[field] == v)
    n = F.size("_f")
    verdict = cases([(has("action", "BLOCK"), "BLOCK"), (has("action", "WARN"), "WARN")], "ALLOW")
    level = cases([(n == 0, "NONE"), (has("action", "BLOCK") | has("severity", "CRITICAL"), "CRITICAL"), (has("severity", "HIGH"), "HIGH"), (has("severity", "MEDIUM"), "MEDIUM")], "LOW")
    return found.select("action_id", "action_type", n.alias("findings"), verdict.alias("verdict"), level.alias("risk_level"))


#: Fixed values, server-source rules: id, severity, category, languages, pattern, the frame of lines around it (from, to;
#: None: only itself) that must not hold the last pattern.
SERVER_RULES = (
    ("mcp.shell-exec-no-validation", "ERROR", "overly-broad-permissions", ("javascript", "typescript"), r"\b(exec|execSync)\s*\(\s*(`[^`]*\$\{|['\"][^'\"]*['\"]\s*\+|[a-zA-Z_$][\w$]*(\s*\+|\s*,\s*\{[^}]*shell\s*:\s*true))", None, None),
    ("mcp.shell-exec-direct", "ERROR", "overly-broad-permissions", ("javascript", "typescript"), r"\bchild_process\b.*\b(exec|execSync)\b|\b(exec|execSync)\s*\(", None, None),
    ("mcp.spawn-shell-true", "ERROR", "overly-broad-permissions", ("javascript", "typescript"), r"\b(spawn|spawnSync)\s*\([^)]*\{[^}]*shell\s*:\s*true", None, None),
    ("mcp.subprocess-shell", "ERROR", "overly-broad-permissions", ("python",), r"subprocess\.(run|call|Popen|check_output|check_call)\s*\([^)]*shell\s*=\s*True", None, None),
    ("mcp.os-system", "ERROR", "overly-broad-permissions", ("python",), r"\bos\.system\s*\(", None, None),
    ("mcp.fs-write-no-path-validation", "WARNING", "overly-broad-permissions", ("javascript", "typescript"), r"\b(writeFileSync|writeFile|createWriteStream|appendFileSync|appendFile)\s*\(\s*[a-zA-Z_$]", None, None),
    ("mcp.http-request-user-url", "WARNING", "overly-broad-permissions", ("javascript", "typescript"), r"\b(fetch|axios\.(get|post|put|delete|request)|http\.request|https\.request|got|request)\s*\(\s*[a-zA-Z_$]", None, None),
    ("mcp.env-var-exposure", "WARNING", "overly-broad-permissions", ("javascript", "typescript"), r"process\.env\b", None, None),
    ("mcp.env-var-exposure-python", "WARNING", "overly-broad-permissions", ("python",), r"os\.environ\b|os\.getenv\s*\(", None, None),
    ("mcp.no-input-validation", "WARNING", "missing-input-validation", ("javascript", "typescript"), r"\.tool\s*\(\s*[\"'][^\"']+[\"']\s*,\s*[\"'][^\"']*[\"']\s*,\s*\{[^}]*\}\s*,\s*(async\s+)?\(\s*\{", (0, 14), r"(?i)\b(z\.|zod\.|joi\.|validate|sanitize|schema|\.parse\(|\.safeParse\(|isValid|assert|check)\b"),
    ("mcp.path-no-normalize", "WARNING", "missing-input-validation", ("javascript", "typescript"), r"\b(readFileSync|readFile|existsSync|statSync|stat|unlink|unlinkSync|rmdir|rmdirSync|mkdir|mkdirSync)\s*\(\s*[a-zA-Z_$]", (-5, 0), r"path\.(resolve|normalize|join)\s*\("),
    ("mcp.url-no-validation", "WARNING", "missing-input-validation", ("javascript", "typescript"), r"new\s+URL\s*\(\s*[a-zA-Z_$][\w$.]*\s*\)|url\.parse\s*\(\s*[a-zA-Z_$][\w$.]*\s*\)", (0, 4), r"(?i)\.(hostname|host|protocol|origin)\s*(===|!==|==|!=)|allowlist|whitelist|allowed"),
    ("mcp.exfiltration-network-socket", "WARNING", "data-exfiltration", ("javascript", "typescript"), r"\bnet\.(createConnection|connect|Socket)\s*\(|new\s+WebSocket\s*\(", None, None),
    ("mcp.exfiltration-log-secrets", "WARNING", "data-exfiltration", ("javascript", "typescript", "python"), r"(?i)\b(console\.(log|error|warn|info)|print|logging\.(info|warning|error|debug))\s*\([^)]*\b(key|token|password|secret|credential|api_key|apiKey|auth|bearer)\b", None, None),
    ("mcp.eval-usage", "ERROR", "insecure-patterns", ("javascript", "typescript", "python"), r"\beval\s*\(", None, None),
    ("mcp.function-constructor", "ERROR", "insecure-patterns", ("javascript", "typescript"), r"new\s+Function\s*\(", None, None),
    ("mcp.exec-string-concat", "ERROR", "insecure-patterns", ("javascript", "typescript"), r"\bexec\s*\(\s*['\"`][^'\"`]*['\"`]\s*\+", None, None),
    ("mcp.cors-wildcard", "WARNING", "insecure-patterns", ("javascript", "typescript"), r"cors\s*\(\s*\{[^}]*origin\s*:\s*['\"]\*['\"]", None, None),
    ("mcp.cors-permissive", "INFO", "insecure-patterns", ("javascript", "typescript"), r"\bcors\s*\(\s*\)", None, None),
    ("mcp.pickle-load", "ERROR", "insecure-patterns", ("python",), r"\bpickle\.(load|loads)\s*\(", None, None),
    ("mcp.yaml-unsafe-load", "ERROR", "insecure-patterns", ("python",), r"\byaml\.load\s*\(", None, None),
)

#: Rules whose pattern RE2 has not (look-ahead), in the same form.
AHEAD_RULES = (
    ("mcp.exfiltration-external-request", "ERROR", "data-exfiltration", ("javascript", "typescript"), r"\b(fetch|axios\.(post|put|patch)|http\.request|https\.request)\s*\(\s*['\"`](https?://(?!localhost|127\.0\.0\.1|0\.0\.0\.0|::1)[^'\"` ]+)['\"`]", None, None),
    ("mcp.exfiltration-external-request-python", "ERROR", "data-exfiltration", ("python",), r"\b(requests\.(post|put|patch)|urllib\.request\.urlopen|httpx\.(post|put|patch))\s*\(\s*['\"`](https?://(?!localhost|127\.0\.0\.1|0\.0\.0\.0|::1)[^'\"` ]+)['\"`]", None, None),
)
#: Rules for a line of a file of which no line holds the last pattern.
FILE_RULES = (
    ("mcp.no-auth-check", "INFO", "insecure-patterns", ("javascript", "typescript"), r"\b(createServer|listen)\s*\(", r"(?i)\b(auth|authenticate|authorize|jwt|bearer|token|apiKey|api_key|session|passport)\b"),
)


def _file_findings(lines: DataFrame, rules) -> list[DataFrame]:
    found = []
    for rule, severity, category, languages, pattern, unless in rules:
        held = lines.where(F.col("text").rlike(unless)).select("path").distinct()
        hit = lines.where(F.col("language").isin(*languages) & F.col("text").rlike(pattern)).join(held, "path", "left_anti")
        found.append(hit.select("path", (F.col("line") + 1).alias("line"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(category).alias("category")))
    return found


def server_findings(lines: DataFrame, rules=SERVER_RULES + AHEAD_RULES, file_rules=FILE_RULES) -> DataFrame:
    """lines (path, language, line 0-based, text) to (path, line 1-based, rule, severity, category), distinct.

    A rule with a frame looks at the lines around, by a window of bounded size over each file.
    """
    order = W.partitionBy("path").orderBy("line")
    tests = []
    for rule, severity, category, languages, pattern, frame, unless in rules:
        hit = F.col("language").isin(*languages) & F.col("text").rlike(pattern)
        if frame:
            hit &= F.max(F.col("text").rlike(unless).cast("int")).over(order.rowsBetween(*frame)) == 0
        tests.append(F.when(hit, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(category).alias("category"))))
    found = lines.select("path", (F.col("line") + 1).alias("line"), F.array(*tests).alias("f"))
    told = found.select("path", "line", F.explode(F.array_compact("f")).alias("f")).select("path", "line", "f.*")
    return reduce(DataFrame.unionByName, _file_findings(lines, file_rules), told).distinct()
