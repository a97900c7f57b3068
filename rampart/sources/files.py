"""File sources: whole files, lines, ignore lists, diffs, registries, history, configuration."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.columns import glob_matches, glob_regex, language

# Folders that walks skip and extensions that they keep.
SKIPPED = ("node_modules", ".git", "dist", "build", "vendor", "__pycache__", ".next", "coverage", "venv", ".venv", "target")
KEPT = tuple(sorted({*T.FILE_LANGUAGES, "json"}))


def walk(paths: DataFrame, ignored: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """paths (path, relative) that a project scan looks at."""
    rel = F.col("relative")
    hidden = rel.rlike(r"(^|/)\.[^/]") | rel.rlike("(^|/)(" + "|".join(map(_literal, SKIPPED)) + ")/")
    kept = rel.rlike(r"(?i)\.(" + "|".join(KEPT) + ")$") | rel.rlike(r"(?i)(^|/)dockerfile(\.[^/]*)?$")
    out = paths.where(kept & ~hidden)
    for globs in (ignored, exclude):
        if globs:
            out = out.where(~glob_matches(rel, globs))
    return out.where(glob_matches(rel, include)) if include else out


def _literal(x: str) -> str:
    return x.replace(".", r"\.")


#: Extensions of a benchmark's corpus.
CORPUS = ("py", "js", "ts", "java", "go", "txt", "dockerfile", "c", "rb", "php", "tf", "yaml")


def corpus_files(paths: DataFrame) -> DataFrame:
    """paths (path, relative) of a benchmark's corpus: files of the folder itself, by extension or Dockerfile*, in order."""
    name = F.col("relative")
    kept = name.rlike(r"\.(" + "|".join(CORPUS) + ")$") | F.startswith(F.lower(name), F.lit("dockerfile"))
    return paths.where(kept & ~F.contains(name, F.lit("/"))).orderBy("relative")


def changed_files(tracked: DataFrame, untracked: DataFrame, existing: DataFrame) -> DataFrame:
    """Distinct paths of changed tracked and of untracked files that still exist (each has a column path)."""
    return tracked.select("path").union(untracked.select("path")).distinct().join(existing.select("path").distinct(), "path", "left_semi")


def server_sources(paths: DataFrame) -> DataFrame:
    """paths (path, relative) of a server's sources: JavaScript, TypeScript and Python outside the skipped folders."""
    return walk(paths).where(F.col("relative").rlike(r"\.(js|ts|py)$"))


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, relative, language, text of every file under ``root``; a file is a row, so split very large ones before."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "")
    base = root.rstrip("/").removeprefix("file://")
    return files.select(path.alias("path"), F.regexp_replace(path, f"^{_literal(base)}/", "").alias("relative"), F.col("value").alias("text")).withColumn("language", language(F.col("path")))


def lines_of(files: DataFrame) -> DataFrame:
    """One row a line: path, language, line (from 0), text."""
    return files.select("path", "language", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def ignore_globs(text: str) -> list[str]:
    """Globs of an ignore file: no comments, no negation; a folder stands for all in it."""
    kept = (x.strip() for x in text.splitlines())
    return [x + "**" if x.endswith("/") else x for x in kept if x and not x.startswith("#")]


def changed_lines(diff: DataFrame) -> DataFrame:
    """diff (lineno, text) in unified format to (file, line): lines of the new files that hunks cover.

    The current file is filled forward over the diff's lines; add a column ``diff_id`` for many diffs, each
    of which is then its own window.
    """
    keys = ["diff_id"] if "diff_id" in diff.columns else []
    name = F.nullif(F.regexp_extract("text", r"^\+\+\+ b/(.*)$", 1), F.lit(""))
    so_far = W.partitionBy(*keys).orderBy("lineno").rowsBetween(W.unboundedPreceding, 0)
    told = diff.withColumn("file", F.last(name, ignorenulls=True).over(so_far)).where(F.col("text").rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@"))
    start = F.regexp_extract("text", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).cast("int")
    count = F.coalesce(F.nullif(F.regexp_extract("text", r"^@@ -\d+(?:,\d+)? \+\d+,(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    told = told.select(*keys, "file", start.alias("s"), count.alias("c")).where("c > 0 and file is not null")
    return told.select(*keys, "file", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("c") - 1)).alias("line")).distinct()


def on_changed_lines(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings (path, line from 0) on changed lines (file, line from 1)."""
    keys = changed.select(F.col("file").alias("path"), (F.col("line") - 1).alias("line")).distinct()
    return findings.join(keys, ["path", "line"], "left_semi")


def read_registry(spark: SparkSession, folder: str) -> DataFrame:
    """ecosystem, name from files, or folders of parts, <ecosystem>.txt with a name a line."""
    eco = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.txt(?:/part-[^/]*)?$", 1)
    return spark.read.text(f"{folder}/*.txt").select(eco.alias("ecosystem"), F.trim("value").alias("name")).where("name <> ''")


def read_history(spark: SparkSession, folder: str, days: int, now: str, *, lines: bool = False) -> DataFrame:
    """Snapshots of the last ``days`` days before ``now``, oldest first; broken ones are skipped. A file holds one, or one a line."""
    kinds = "timestamp string, directory string, grade string, files_scanned int, issues_count int, by_severity map<string,int>, issues array<struct<ruleId:string,file:string,line:int>>"
    rows = spark.read.schema(kinds).option("mode", "DROPMALFORMED").option("multiLine", not lines).json(folder)
    rows = rows.withColumn("ts", F.to_timestamp("timestamp"))
    return rows.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))).orderBy("ts")


def load_config(start: str, most: int = 50) -> dict:
    """The nearest .scannerrc.yaml, .yml or .json at or above ``start``, over the defaults, key by key."""
    config: dict = {"version": 1, "suppress": [], "exclude": [], "severity_threshold": "info", "confidence_threshold": "LOW", "policy": {"block_on": "error", "max_critical": None, "max_warning": None, "required_grade": None}}
    for folder in [Path(start), *Path(start).parents][:most]:
        for name in (".scannerrc.yaml", ".scannerrc.yml", ".scannerrc.json"):
            if (at := folder / name).is_file():
                import yaml

                found = json.loads(at.read_text()) if name.endswith("json") else yaml.safe_load(at.read_text()) or {}
                return config | found | {"policy": config["policy"] | (found.get("policy") or {})}
    return config


__all__ = ["changed_files", "changed_lines", "glob_regex", "ignore_globs", "lines_of", "load_config", "on_changed_lines", "read_files", "read_history", "read_registry", "server_sources", "walk"]
