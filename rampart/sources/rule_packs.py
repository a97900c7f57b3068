"""Rule packs: YAML files of a folder, and a compact pack of our own wording."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stored import stored

#: Why a pattern is an error that no flag or syntax explains.
NOT_COMPILED = "not compiled by Java's engine"
SCHEMA = "rule_id string, pattern_idx int, pattern string, severity string, category string, confidence string, risk_score int, action string, languages array<string>, message string"

#: Prompt rules: id, category, severity, confidence, risk, action, patterns. Patterns keep to what Java and RE2 share.
PROMPT_RULES = (
    ("exfil.send-external", "exfiltration", "ERROR", "HIGH", 95, "BLOCK", (r"(?i)(send|post|upload)\s+.*(code|secrets?|keys?|tokens?|environment variables|passwords?)\s+.*to\s+", r"(?i)send it to (https?://|\w+\.(com|net|io))")),
    ("exfil.sensitive-file", "exfiltration", "ERROR", "HIGH", 90, "BLOCK", (r"(?i)(read|cat|print|show)\s+.*(/etc/passwd|/etc/shadow|\.env\b|id_rsa|\.aws/credentials)",)),
    ("inject.reverse-shell", "malicious-injection", "ERROR", "HIGH", 100, "BLOCK", (r"(?i)reverse\s+shell", r"(?i)backdoor")),
    ("system.destroy", "system-manipulation", "ERROR", "HIGH", 100, "BLOCK", (r"(?i)rm\s+-rf\s+/", r"(?i)(delete|wipe|erase)\s+(all|every)\s+(files?|data)")),
    ("social.authority", "social-engineering", "ERROR", "MEDIUM", 85, "WARN", (r"(?i)i\s*('m| am)\s+(the|an|your)\s+(admin|administrator|developer|owner)", r"(?i)this is authorized")),
    ("social.urgency", "social-engineering", "WARNING", "LOW", 65, "LOG", (r"(?i)(urgent|emergency|immediately or)", r"(?i)for debugging purposes")),
    ("obfuscated.base64", "obfuscation", "WARNING", "MEDIUM", 75, "WARN", (r"(?i)(decode|execute)\s+(this\s+)?base64", r"(?i)rot13")),
    ("agent.hide", "agent-manipulation", "WARNING", "MEDIUM", 70, "WARN", (r"(?i)(don't|do not)\s+(tell|show|ask)\s+(the\s+)?user", r"(?i)without\s+(asking|confirmation)")),
    ("injection.ignore", "prompt-injection-content", "ERROR", "HIGH", 90, "BLOCK", (r"(?i)ignore\s+(all\s+|the\s+|any\s+)?(previous\s+|prior\s+|above)?\s*(instructions|rules|and instead)", r"(?i)disregard\s+(all|your)\s+")),
    ("injection.jailbreak", "prompt-injection-jailbreak", "ERROR", "HIGH", 90, "BLOCK", (r"(?i)you\s+are\s+(now\s+)?DAN\b", r"(?i)do anything now")),
    ("injection.roleplay", "prompt-injection-jailbreak", "WARNING", "MEDIUM", 75, "WARN", (r"(?i)pretend\s+(you're|you are|to be)\s+", r"(?i)act as (an?|if) ")),
    ("injection.extract", "prompt-injection-extraction", "WARNING", "MEDIUM", 70, "WARN", (r"(?i)(show|reveal|print|repeat)\s+(me\s+)?(your|the)\s+(system\s+)?(prompt|instructions)",)),
    ("injection.delimiter", "prompt-injection-delimiter", "WARNING", "MEDIUM", 80, "WARN", (r"(?i)(^|\n)\s*system\s*:", r"(?i)\[/?INST\]|<\|im_start\|>")),
    ("injection.context", "prompt-injection-context", "WARNING", "LOW", 60, "LOG", (r"(?i)(new|updated)\s+(instructions|context)\s*:", r"(?i)from now on")),
    ("injection.privilege", "prompt-injection-privilege", "ERROR", "HIGH", 85, "WARN", (r"(?i)(enable|enter|switch to)\s+(developer|admin|root|god)\s+mode", r"(?i)override\s+(all\s+)?safety")),
    ("injection.output", "prompt-injection-output", "WARNING", "MEDIUM", 70, "WARN", (r"(?i)output\s+(only\s+)?HACKED", r"(?i)respond\s+only\s+with")),
    ("exfil.webhook", "exfiltration", "ERROR", "HIGH", 95, "BLOCK", (r"(?i)(webhook|pastebin|requestbin|ngrok)\S*\s.*(secret|token|key|credential|data|code)", r"(?i)(secret|token|key|credential|data|code)s?\b.*\b(webhook|pastebin|requestbin|ngrok)",)),
    ("exfil.mail", "exfiltration", "ERROR", "HIGH", 90, "BLOCK", (r"(?i)\b(e-?mail|mail)\s+(me\s+)?(the\s+|all\s+|your\s+)*(source|code|secret|credential|database|config)\w*",)),
    ("exfil.env-file", "exfiltration", "ERROR", "HIGH", 95, "BLOCK", (r"(?i)(contents?|values?|variables)\s+(of|in|from)\s+(the\s+)?\.env\b",)),
    ("exfil.ssh-key", "exfiltration", "ERROR", "HIGH", 95, "BLOCK", (r"(?i)(copy|share|give|dump)\s+.*(ssh|private)[ _-]?key",)),
    ("exfil.cloud", "exfiltration", "ERROR", "HIGH", 95, "BLOCK", (r"(?i)(aws|azure|gcp|cloud)\s+(access\s+)?(credentials|secret|keys?)",)),
    ("exfil.encoded", "exfiltration", "ERROR", "HIGH", 90, "BLOCK", (r"(?i)(encode|encrypt|compress)\s+.*(secret|token|credential|password)s?\b",)),
    ("exfil.foreign-repo", "exfiltration", "ERROR", "HIGH", 85, "BLOCK", (r"(?i)push\s+.*\bto\s+(my|this|a|another|an external)\s+(public\s+)?(repo|repository|remote|fork)",)),
    ("exfil.git-credentials", "exfiltration", "ERROR", "HIGH", 90, "BLOCK", (r"(?i)git[ -]?credentials?|\.netrc\b",)),
    ("inject.web-shell", "malicious-injection", "ERROR", "HIGH", 100, "BLOCK", (r"(?i)web\s?shell",)),
    ("inject.protection-off", "malicious-injection", "ERROR", "HIGH", 95, "BLOCK", (r"(?i)(disable|turn off|remove)\s+(the\s+|all\s+)?(security|csrf|authentication|validation|sandbox|antivirus)",)),
    ("inject.skip-login", "malicious-injection", "ERROR", "HIGH", 95, "BLOCK", (r"(?i)(bypass|skip|circumvent)\s+(the\s+)?(auth|login|permission|access control)\w*",)),
    ("inject.steal-code", "malicious-injection", "ERROR", "HIGH", 100, "BLOCK", (r"(?i)(code|script|program|function)\s+(that|to|which)\s+(steals?|logs? keystrokes|harvests?|captures? passwords)", r"(?i)keylogger",)),
    ("inject.ransom", "malicious-injection", "ERROR", "HIGH", 100, "BLOCK", (r"(?i)ransom(ware)?\b",)),
    ("inject.planted-flaw", "malicious-injection", "ERROR", "HIGH", 100, "BLOCK", (r"(?i)(intentional|deliberate|hidden|subtle)(ly)?\s+(add\s+|leave\s+|a\s+)*(vulnerab|flaw|weakness|bug)\w*",)),
    ("inject.disguise", "malicious-injection", "ERROR", "HIGH", 95, "BLOCK", (r"(?i)(obfuscate|disguise|hide)\s+(the\s+|this\s+)?(malware|payload|exploit|virus)",)),
    ("system.config", "system-manipulation", "ERROR", "HIGH", 95, "BLOCK", (r"(?i)(edit|modify|change|overwrite)\s+.*(/etc/(sudoers|passwd|fstab|ssh)|system32)",)),
    ("system.hosts", "system-manipulation", "ERROR", "HIGH", 90, "BLOCK", (r"(?i)(edit|modify|change|add)\s+.*(/etc/hosts|hosts file|dns (settings|records))",)),
    ("system.firewall", "system-manipulation", "ERROR", "HIGH", 95, "BLOCK", (r"(?i)(disable|stop|flush|turn off)\s+(the\s+)?(firewall|iptables|ufw|selinux|defender)",)),
    ("system.persist", "system-manipulation", "ERROR", "HIGH", 90, "BLOCK", (r"(?i)(add|install|create)\s+.*(cron\s?tab|cron job|startup (script|item)|systemd (unit|service)|launch\s?agent|\.bashrc)",)),
    ("system.registry", "system-manipulation", "ERROR", "HIGH", 90, "BLOCK", (r"(?i)(reg add|HKEY_|windows registry)",)),
    ("system.fetch-run", "system-manipulation", "ERROR", "HIGH", 95, "BLOCK", (r"(?i)(curl|wget|download)\s+.*(\|\s*(ba|z)?sh\b|and (run|execute) it)",)),
    ("social.impersonation", "social-engineering", "ERROR", "MEDIUM", 80, "WARN", (r"(?i)i('m| am)\s+(from|with)\s+(the\s+)?(security|support|it|openai|anthropic|compliance)\b",)),
    ("social.mode", "social-engineering", "WARNING", "MEDIUM", 80, "WARN", (r"(?i)(maintenance|test|training|unrestricted|debug)\s+mode\b",)),
    ("social.emergency", "social-engineering", "WARNING", "MEDIUM", 70, "WARN", (r"(?i)(lives? (are|is) at (risk|stake)|no time to (check|verify|explain)|right now or)",)),
    ("social.testing", "social-engineering", "WARNING", "LOW", 65, "LOG", (r"(?i)(just|only|purely)\s+(for\s+)?(testing|a test|a drill|research|educational)",)),
    ("obfuscated.hex", "obfuscation", "WARNING", "MEDIUM", 70, "WARN", (r"(?i)(decode|run|interpret)\s+(this\s+|the\s+)?hex", r"(\\x[0-9a-fA-F]{2}){6}",)),
    ("obfuscated.parts", "obfuscation", "WARNING", "LOW", 60, "LOG", (r"(?i)(combine|join|concatenate|put together)\s+(the\s+|these\s+)?(parts|pieces|fragments|letters|strings)",)),
    ("obfuscated.lookalikes", "obfuscation", "WARNING", "LOW", 65, "WARN", (r"[a-zA-Z][\x{0400}-\x{04FF}][a-zA-Z]",)),
    ("obfuscated.sample", "obfuscation", "ERROR", "HIGH", 85, "BLOCK", (r"(?i)(example|sample|demo)\s+of\s+(a\s+|an\s+)?(malware|virus|exploit|phishing|attack)",)),
    ("obfuscated.harmless", "obfuscation", "WARNING", "LOW", 60, "LOG", (r"(?i)(harmless|innocent|routine|standard)\s+(script|check|backup|cleanup)\s+that",)),
    ("obfuscated.languages", "obfuscation", "WARNING", "MEDIUM", 65, "WARN", (r"(?i)(ignora|ignorez|ignoriere|vergiss)\s+.*(instrucciones|instructions|anweisungen)",)),
    ("agent.force-tool", "agent-manipulation", "WARNING", "MEDIUM", 75, "WARN", (r"(?i)(you must|always)\s+(use|call|invoke)\s+(the\s+)?\w+\s+(tool|function|command)",)),
    ("agent.confirm-off", "agent-manipulation", "WARNING", "MEDIUM", 80, "WARN", (r"(?i)(disable|skip|auto-?(approve|accept|confirm))\s*(all\s+|the\s+)?(confirmation|approval|prompt|changes)s?",)),
    ("agent.quiet", "agent-manipulation", "WARNING", "MEDIUM", 75, "WARN", (r"(?i)(silently|quietly|in the background without)\b", r"(?i)(hide|suppress)\s+(the\s+|all\s+|any\s+)?(output|logs?|errors?)",)),
    ("agent.memory", "agent-manipulation", "WARNING", "MEDIUM", 70, "WARN", (r"(?i)(remember|store|save)\s+(this\s+)?(for(ever)?|in your memory|as a (permanent|new) rule)",)),
    ("injection.new-instructions", "prompt-injection-content", "ERROR", "HIGH", 85, "BLOCK", (r"(?i)(here (are|is)|these are)\s+(your|the)\s+(new|real|actual)\s+(instructions|rules|task)",)),
    ("injection.hypothetical", "prompt-injection-jailbreak", "WARNING", "MEDIUM", 60, "WARN", (r"(?i)hypothetical(ly)?\b.*\b(how|could|would)", r"(?i)imagine\s+(you|a world)\s+.*\bno (rules|limits|restrictions)",)),
    ("injection.extract-indirect", "prompt-injection-extraction", "WARNING", "MEDIUM", 65, "WARN", (r"(?i)(summari[sz]e|translate|rephrase|repeat)\s+(everything|all|the text)\s+(above|before|so far)",)),
    ("injection.tags", "prompt-injection-delimiter", "WARNING", "MEDIUM", 70, "WARN", (r"(?i)</?(system|instructions?|prompt|assistant)>",)),
    ("injection.encoded", "prompt-injection-encoded", "WARNING", "MEDIUM", 80, "WARN", (r"(?i)(follow|obey|execute)\s+(the\s+)?(encoded|decoded|hidden)\s+(instructions|message|text)",)),
    ("injection.privileged-request", "prompt-injection-privilege", "WARNING", "MEDIUM", 70, "WARN", (r"(?i)(grant|give)\s+(me|yourself|this session)\s+(full|root|admin|elevated)\s+(access|rights|privileges|permissions)",)),
    ("injection.turn-by-turn", "prompt-injection-multi-turn", "WARNING", "LOW", 55, "LOG", (r"(?i)(as (we|you) (agreed|discussed|said)|in (your|the) (last|previous) (reply|message|turn) you)",)),
    ("injection.code-block", "prompt-injection-content", "ERROR", "HIGH", 80, "BLOCK", (r"(?i)(run|follow|do)\s+(what|whatever)\s+(is|stands)\s+in\s+(the\s+)?(code\s?block|comment)",)),
    ("injection.html-comment", "prompt-injection-content", "ERROR", "HIGH", 90, "BLOCK", (r"(?i)<!--\s*.*(ignore|instruction|assistant|system)",)),
    ("injection.hidden-markdown", "prompt-injection-content", "ERROR", "HIGH", 85, "BLOCK", (r"(?i)\[//\]:\s*#\s*\(|\[[^\]]*\]\(javascript:",)),
    ("injection.file", "prompt-injection-content", "ERROR", "HIGH", 85, "WARN", (r"(?i)(the|this)\s+(file|document|readme|page)\s+(says|tells you|instructs you)\s+to",)),
    ("injection.image", "prompt-injection-content", "WARNING", "MEDIUM", 70, "WARN", (r"(?i)(exif|alt[ -]?text|image metadata)\b.*\b(instruct|command|follow)",)),
    ("injection.url", "prompt-injection-content", "ERROR", "HIGH", 85, "BLOCK", (r"(?i)https?://\S+[?&](prompt|instruction|cmd|q)=\S*(ignore|system|run)",)),
    ("injection.json", "prompt-injection-content", "ERROR", "HIGH", 90, "BLOCK", (r"""(?i)[\"']role[\"']\s*:\s*[\"'](system|developer)[\"']""",)),
    ("injection.developer", "prompt-injection-jailbreak", "ERROR", "HIGH", 90, "BLOCK", (r"(?i)developer\s+mode\s+(is\s+)?(on|enabled|output)",)),
    ("injection.token-smuggling", "prompt-injection-encoded", "ERROR", "HIGH", 85, "BLOCK", (r"""(?i)\ba\s*=\s*[\"'].{1,12}[\"'].*\bb\s*=\s*[\"'].{1,12}[\"'].*\ba\s*\+\s*b""",)),
    ("injection.authority", "social-engineering", "WARNING", "MEDIUM", 65, "WARN", (r"(?i)(my|the)\s+(boss|manager|ceo|supervisor)\s+(said|told|wants|approved)",)),
    ("injection.recursive", "prompt-injection-context", "WARNING", "MEDIUM", 75, "WARN", (r"(?i)(prompt|instruction)\s+(that|which)\s+(makes|tells|asks)\s+(you|another model|itself)",)),
    ("injection.fiction", "prompt-injection-jailbreak", "WARNING", "MEDIUM", 60, "WARN", (r"(?i)(in|for)\s+(a|my|this)\s+(story|novel|screenplay|game)\b.*\b(explain|describe|shows?)\s+how",)),
    ("injection.tool-abuse", "prompt-injection-privilege", "ERROR", "HIGH", 90, "BLOCK", (r"(?i)(use|call)\s+(your|the)\s+(shell|file|browser|terminal)\s+(tool\s+)?to\s+(delete|read|send|upload)",)),
    ("injection.hex", "prompt-injection-encoded", "WARNING", "MEDIUM", 70, "WARN", (r"\b([0-9a-fA-F]{2}\s){12}",)),
    ("injection.rot13", "prompt-injection-encoded", "WARNING", "MEDIUM", 65, "WARN", (r"(?i)vtaber\s+(nyy|cerivbhf)",)),
    ("assistant.forward-mail", "data_exfiltration", "ERROR", "MEDIUM", None, "BLOCK", (r"(?i)forward\s+(all\s+|every\s+|my\s+)*(e-?mails?|messages|inbox)\s+to",)),
    ("assistant.contacts", "data_exfiltration", "ERROR", "MEDIUM", None, "BLOCK", (r"(?i)(export|send|copy|upload)\s+(all\s+|my\s+|the\s+)*(contacts|address book)",)),
    ("assistant.calendar", "data_exfiltration", "WARNING", "MEDIUM", None, "WARN", (r"(?i)(export|share|send)\s+(all\s+|my\s+|the\s+)*(calendar|appointments|meetings)",)),
    ("assistant.upload", "data_exfiltration", "ERROR", "MEDIUM", None, "BLOCK", (r"(?i)upload\s+(all\s+|my\s+|the\s+|these\s+)*(documents|files|photos|folder)\s+to",)),
    ("assistant.browser-session", "data_exfiltration", "ERROR", "MEDIUM", None, "BLOCK", (r"(?i)(session|browser|login)\s+cookies?",)),
    ("assistant.browsing", "data_exfiltration", "WARNING", "MEDIUM", None, "WARN", (r"(?i)(browsing|browser|search)\s+history",)),
    ("assistant.mass-send", "messaging_abuse", "ERROR", "MEDIUM", None, "BLOCK", (r"(?i)(send|message|text|dm)\s+.*(everyone|all (my )?contacts|every (user|member|contact))",)),
    ("assistant.auto-reply", "messaging_abuse", "WARNING", "MEDIUM", None, "WARN", (r"(?i)(auto-?reply|automatically (reply|respond|answer))\s+to\s+(all|every|any)",)),
    ("assistant.impersonate", "messaging_abuse", "ERROR", "MEDIUM", None, "BLOCK", (r"(?i)(write|reply|message|post)\s+(to\s+\w+\s+)?(as if (you|i) (were|was)|pretending to be|in the name of)",)),
    ("assistant.phishing", "messaging_abuse", "ERROR", "MEDIUM", None, "BLOCK", (r"(?i)(phishing|fake (invoice|login|password reset))\s*(mail|email|page|message)?",)),
    ("assistant.api-keys", "credential_theft", "ERROR", "MEDIUM", None, "BLOCK", (r"(?i)(show|list|find|collect|extract)\s+(me\s+)?(all\s+|every\s+|the\s+|my\s+)*api[ _-]?keys?",)),
    ("assistant.passwords", "credential_theft", "ERROR", "MEDIUM", None, "BLOCK", (r"(?i)(show|list|find|collect|extract|dump)\s+(me\s+)?(all\s+|every\s+|the\s+|my\s+|saved\s+)*passwords?",)),
    ("assistant.keychain", "credential_theft", "ERROR", "MEDIUM", None, "BLOCK", (r"(?i)(keychain|password manager|credential (store|vault)|1password|bitwarden)",)),
    ("assistant.env-secrets", "credential_theft", "ERROR", "MEDIUM", None, "BLOCK", (r"(?i)(print|echo|dump|list)\s+(all\s+|the\s+)*(env(ironment)?)\s*(variables|vars|secrets)",)),
    ("assistant.ssh", "credential_theft", "ERROR", "MEDIUM", None, "BLOCK", (r"(?i)~?/\.ssh\b|authorized_keys",)),
    ("assistant.scheduled", "autonomous_harm", "WARNING", "MEDIUM", None, "WARN", (r"(?i)every\s+(day|hour|night|minute|week)\b.*\b(delete|send|post|transfer|buy)",)),
    ("assistant.no-confirm", "autonomous_harm", "WARNING", "MEDIUM", None, "WARN", (r"(?i)(never|don't|do not)\s+(ask|wait)\s+(for\s+)?(me|my|confirmation|permission|approval)",)),
    ("assistant.safety-off", "autonomous_harm", "ERROR", "MEDIUM", None, "BLOCK", (r"(?i)(disable|ignore|turn off)\s+(your\s+|the\s+|all\s+)*(safety|guardrails|safeguards|limits)",)),
    ("assistant.unlimited", "autonomous_harm", "ERROR", "MEDIUM", None, "BLOCK", (r"(?i)(unlimited|unrestricted|full)\s+(access|control)\s+(to|over)\s+(my|the|this|all)",)),
    ("assistant.payment", "service_attack", "ERROR", "MEDIUM", None, "BLOCK", (r"(?i)(transfer|wire|send|pay)\s+.*(money|funds|bitcoin|\$\s?\d+|gift cards?)",)),
    ("assistant.account", "service_attack", "WARNING", "MEDIUM", None, "WARN", (r"(?i)(change|reset|update)\s+(my\s+|the\s+|their\s+)*(account\s+)?(password|recovery email|phone number|2fa)",)),
    ("assistant.repository", "service_attack", "ERROR", "MEDIUM", None, "BLOCK", (r"(?i)(delete|force[ -]push|wipe)\s+(the\s+|my\s+|all\s+|every\s+)*(repo(sitor(y|ies))?|branch(es)?|main)\b",)),
    ("assistant.social", "service_attack", "WARNING", "MEDIUM", None, "WARN", (r"(?i)(delete|deactivate|unfollow)\s+(all\s+|my\s+|every\s+)*(posts?|tweets?|profile|friends|followers)",)),
)


def prompt_rules(spark: SparkSession) -> DataFrame:
    """The compact prompt pack, one row a pattern."""
    return spark.createDataFrame([(rule, i, p, severity, category, confidence, risk, action, ["generic"], "") for rule, category, severity, confidence, risk, action, patterns in PROMPT_RULES for i, p in enumerate(patterns)], SCHEMA)


def _rules_of(folder: str, pattern: str, errors: list[tuple[str, str, str, str]]) -> Iterator[tuple[str, dict]]:
    """(file, rule) of a folder's packs in path order; packs are configuration, so the driver reads them."""
    import yaml

    for path in sorted(Path(folder).rglob(pattern)):
        try:
            listed = (yaml.safe_load(path.read_text(encoding="utf-8")) or {}).get("rules") or []
        except (yaml.YAMLError, AttributeError, UnicodeDecodeError) as e:
            errors.append((str(path), "", "", str(e)[:200]))
            continue
        yield from ((str(path), rule) for rule in listed if isinstance(rule, dict) and rule.get("id"))


#: What tells that a string is a pattern over syntax, and that it is meant as a regex.
SYNTAX = ("...", "$", "pattern-not", "pattern-inside", "metavariable")
REGEX = re.compile(r"[\\^*+?{}\[\]|()]")


def _regexes(rule: dict, prompts: bool) -> Iterator[tuple[str, str]]:
    """(pattern, why it is none) of a rule's regexes, those in lists and alternatives too; plain text is escaped."""

    def of(node: dict) -> Iterator[tuple[str, str]]:
        p = node.get("pattern")
        if isinstance(p, str):
            yield (p, "pattern over syntax") if any(x in p for x in SYNTAX) else (p if REGEX.search(p) else re.escape(p), "")
        if isinstance(node.get("pattern-regex"), str):
            yield node["pattern-regex"], ""
        for item in node.get("pattern-either") or []:
            if isinstance(item, dict):
                yield from of(item)

    for item in rule.get("patterns") or []:
        if isinstance(item, str):
            yield (item, "pattern over syntax") if not prompts and any(x in item for x in SYNTAX) else (item, "")
        elif isinstance(item, dict):
            yield from of(item)
    yield from of(rule)


def rules_of_text(file: str, text: str, prompts: bool = True) -> Iterator[tuple]:
    """A pack's rows: file, SCHEMA's columns, reason; a row a pattern, those that can't be used with a reason, a broken pack as one row."""
    import yaml

    try:
        listed = (yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or {}).get("rules") or []
    except (yaml.YAMLError, AttributeError) as e:
        yield file, *[None] * len(SCHEMA.split(", ")), str(e)[:200]
        return
    for rule in listed:
        if not isinstance(rule, dict) or not rule.get("id"):
            continue
        meta = rule.get("metadata") or {}
        risk = meta.get("risk_score")
        for i, (p, why) in enumerate(_regexes(rule, prompts)):
            why = why or ("flags inside the pattern" if re.search(r".\(\?[a-z]+\)", p) else None)
            yield file, str(rule["id"]), i, p, str(rule.get("severity", "WARNING")), meta.get("category"), meta.get("confidence"), int(risk) if str(risk or "").isdigit() else None, meta.get("action"), [str(x) for x in rule.get("languages") or []], str(rule.get("message", "")), why


def unusable(spark: SparkSession, patterns) -> dict[str, str]:
    """Which patterns Java's engine, which runs them, doesn't compile, and why."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import IllegalArgumentException

    compile_, bad = spark._jvm.java.util.regex.Pattern.compile, {}
    for p in patterns:
        try:
            compile_(p)
        except (IllegalArgumentException, Py4JJavaError) as e:
            bad[p] = str(e).split("\n")[0]
    return bad


def read_rule_packs(spark: SparkSession, folder: str, pattern: str = "*.yaml", *, prompts: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rules, errors) of a folder's YAML packs; of the files with an id the last in path order wins.

    Files are read by the ``rulepack`` source, a partition each, once; no row comes to the driver. rules:
    SCHEMA, one row a pattern that Java's engine compiles, as the tasks try; a leading (?i) is kept, one
    further in drops its pattern, into errors (file, rule_id, pattern, reason; ``unusable`` tells what Java
    says of a pattern). Strings in ``patterns``, ``pattern``, ``pattern-regex`` and ``pattern-either`` are read;
    without ``prompts``, strings that are patterns over syntax go to errors (``read_syntax_rules`` reads them).
    """
    from . import formats

    formats.register(spark)
    read = spark.read.format("rulepack").option("pattern", pattern).option("prompts", str(prompts).lower()).load(folder)
    compiles = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("pattern")).isNotNull()
    why = F.coalesce(F.nullif("reason", F.lit("")), F.when(F.col("pattern").isNotNull() & ~compiles, F.lit(NOT_COMPILED)))
    rows = stored(read.withColumn("reason", why), "packs")
    last = F.max("file").over(W.partitionBy("rule_id"))
    rules = rows.where("rule_id <> '' and reason is null").withColumn("_last", last).where("file = _last").select(*(c.split()[0] for c in SCHEMA.split(", ")))
    errors = rows.where("reason is not null").select("file", *(F.coalesce(c, F.lit("")).alias(c) for c in ("rule_id", "pattern")), "reason")
    return rules, errors


def _syntax_patterns(node, key: str = "") -> Iterator[tuple[bool, str]]:
    """(excluded, pattern) of a rule's syntax patterns; lists of patterns count as alternatives, what lies around a match is not looked at."""
    if isinstance(node, str):
        if "\n" not in node.strip():
            yield key == "pattern-not", node.strip()
    elif isinstance(node, list):
        for item in node:
            yield from _syntax_patterns(item, key)
    elif isinstance(node, dict):
        for k in ("pattern", "patterns", "pattern-either", "pattern-not"):
            if k in node:
                yield from _syntax_patterns(node[k], k if k != "pattern" or key != "pattern-not" else key)


def read_syntax_rules(folder: str, language: str, pattern: str = "*.yaml") -> tuple[list, list]:
    """(syntax rules, taint rules) of a folder's packs for a language: ``syntax_rules.SyntaxRule`` and ``TaintRule``.

    Of a rule any pattern may match and no excluded one; patterns of more than one line are left out, as are
    rules without a pattern. Rules with ``mode: taint`` have sources, sinks and sanitizers.
    """
    from ..operators.syntax_rules import SyntaxRule, TaintRule

    syntax: dict[str, SyntaxRule] = {}
    taint: dict[str, TaintRule] = {}
    for _, rule in _rules_of(folder, pattern, []):
        languages = [str(x).lower() for x in rule.get("languages") or ["generic"]]
        if language not in languages and "generic" not in languages:
            continue
        severity, message = {"ERROR": "error", "INFO": "info"}.get(str(rule.get("severity", "")).upper(), "warning"), str(rule.get("message", ""))
        if rule.get("mode") == "taint":
            of = lambda k, rule=rule: tuple(p for no, p in _syntax_patterns(rule.get(k) or []) if not no)
            made = TaintRule(rule["id"], of("pattern-sources"), of("pattern-sinks"), of("pattern-sanitizers"), severity, message, tuple(languages))
            if made.sources and made.sinks:
                taint[rule["id"]] = made
            continue
        found = list(_syntax_patterns(rule))
        if any(not no for no, _ in found):
            syntax[rule["id"]] = SyntaxRule(rule["id"], tuple(p for no, p in found if not no), tuple(p for no, p in found if no), severity, message)
    return list(syntax.values()), list(taint.values())
