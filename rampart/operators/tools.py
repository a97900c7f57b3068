"""Whole scans, composed of the other operators: project, server, diff, package, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cases
from . import history, match, packages, report, triage


def scan_lines(lines: DataFrame) -> DataFrame:
    """Findings of lines as a scan reports them: detected, one for each class and line, with the line's text and the context filter."""
    found = match.detect(lines)
    return triage.context_filter(triage.cross_engine_dedup(found, F.any_value("text").alias("text")))


def by_file(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """path, issues, errors, warnings, infos of every path, those without findings too."""
    counts = triage.severity_counts(findings, "path")
    return paths.select("path").distinct().join(counts, "path", "left").fillna(0, ["issues", "errors", "warnings", "infos"])


def project(paths: DataFrame, findings: DataFrame, **rules) -> DataFrame:
    """One row: files, counts, density, grade, violations, passed and exit_code of a project."""
    per = by_file(paths, findings)
    total = per.agg(F.count("*").alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("issues", "errors", "warnings", "infos")))
    judged = triage.policy(triage.project_grades(total), **rules)
    return judged.withColumn("exit_code", ((F.col("issues") > 0) | ~F.col("passed")).cast("int"))


def server(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files, counts and grade of a server's sources; findings: path, severity in capitals."""
    low = findings.withColumn("severity", F.lower("severity"))
    total = low.groupBy().agg(F.count("*").alias("issues"), *(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")))
    files = paths.select("path").distinct().agg(F.count("*").alias("files"))
    return triage.server_grades(files.join(F.broadcast(total), F.lit(True))).withColumn("exit_code", (F.col("errors") > 0).cast("int"))  # one row each


def server_sorted(findings: DataFrame) -> DataFrame:
    """Server findings with their place in the report: errors, warnings, infos, then by place."""
    rank = cases(((F.col("severity") == s, k) for k, s in enumerate(("ERROR", "WARNING"))), 2)
    return findings.withColumn("rank", rank).orderBy("rank", "path", "line", "rule")


def changed(lines: DataFrame, touched: DataFrame) -> DataFrame:
    """Findings of a diff's lines; touched: file, line from 1.

    What is found on a line hangs on that line alone, so only the touched ones are looked at.
    """
    from ..sources.files import on_changed_lines

    return scan_lines(on_changed_lines(lines, touched))


def check_packages(names: DataFrame, registry: DataFrame, popular: DataFrame) -> DataFrame:
    """ecosystem, name, status, confidence, similar_names (nearest popular names, of missing packages), confusion_risk, reason."""
    told = packages.membership(names.select("ecosystem", "name").distinct(), registry)
    near = packages.typosquats(told.where("status = 'hallucinated'"), popular).groupBy("ecosystem", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "similar_to"))), lambda x: x["similar_to"]), ",").alias("similar_names"))
    risk = packages.confusion(told.select("name").distinct(), popular)
    return told.join(near, ["ecosystem", "name"], "left").join(risk, "name", "left").select("ecosystem", "name", "status", "confidence", F.coalesce("similar_names", F.lit("")).alias("similar_names"), "confusion_risk", "reason")


#: Rows that a page shows of each list.
SHOWN = 100


def scan_report(current: DataFrame, previous: DataFrame, paths: DataFrame, files: int = 15, issues: int = 100) -> dict[str, DataFrame]:
    """The parts of a report: summary, categories, top files, worst issues, how many are new, fixed and unchanged, and the first SHOWN of each."""
    told = history.compared(current, previous)
    return {
        "summary": project(paths, current),
        "categories": category_counts(current),
        "top_files": history.top_files(current, files),
        "worst": report.worst(current, issues),
        "changes": history.changes(told),
        **{state: history.first_of_state(previous if state == "fixed" else current, told, state, SHOWN) for state in ("new", "fixed", "unchanged")},
    }


def write_html(parts: dict[str, DataFrame], path: str) -> None:
    """Writes the parts of ``scan_report`` as one page: counts as cells, the lists of at most SHOWN rows as tables.

    What is shown is bounded, whatever the number of findings: of new, fixed and unchanged issues the page tells
    how many there are, and the first by place. The driver writes the page.
    """
    from html import escape

    from pyarrow import fs

    cell = lambda part, name, value: f'<tr><th>{escape(str(name))}</th><td data-part="{escape(part)}" data-name="{escape(str(name))}">{escape(str(value))}</td></tr>'
    changes = parts["changes"].first().asDict()
    out = ["<!doctype html><html><head><meta charset='utf-8'><title>Scan</title></head><body>"]
    for part, rows in parts.items():
        if part == "changes":  # a cell in each list's table
            continue
        out.append(f"<h2>{escape(part)}</h2><table>")
        if part == "summary":
            told = rows.first().asDict()
            out += [cell(part, k, ", ".join(v) if isinstance(v, list) else v) for k, v in told.items()]
        elif part == "categories":
            out += [cell(part, r.category, r.issues) for r in rows.limit(SHOWN).collect()]
        else:
            if part in changes:
                out.append(cell(part, "issues", changes[part]))
            some = rows.limit(SHOWN).collect()
            if some:
                names = some[0].asDict().keys()
                out += ["<tr>" + "".join(f"<th>{escape(n)}</th>" for n in names) + "</tr>", *("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in some)]
        out.append("</table>")
    files, at = fs.FileSystem.from_uri(path)
    with files.open_output_stream(at) as f:
        f.write("\n".join([*out, "</body></html>"]).encode())


def category_counts(findings: DataFrame) -> DataFrame:
    """Findings by the first part of their rule's id, most first."""
    from ..functions.columns import rule_category

    return findings.groupBy(rule_category(F.col("rule_id")).alias("category")).agg(F.count("*").alias("issues")).orderBy(F.desc("issues"), "category")
