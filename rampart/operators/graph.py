"""Import graphs, cross-file warnings, and taint by assignments."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cases

JS_IMPORTS = (r"import\s+.*?from\s+['\"]([^'\"]+)['\"]", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)")
PY_IMPORTS = (r"(?m)^import\s+(\w+)", r"(?m)^from\s+(\w+)")
#: What may follow an import of a local file, in order of preference.
SUFFIXES = {"javascript": ("", ".js", ".ts", ".tsx", ".jsx", "/index.js", "/index.ts"), "python": (".py", "/__init__.py")}


def imports(files: DataFrame) -> DataFrame:
    """files (path, language, text) to (src, language, module): what each file imports."""
    js = F.flatten(F.array(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in JS_IMPORTS)))
    py = F.flatten(F.array(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in PY_IMPORTS)))
    found = cases([(F.col("language").isin("javascript", "typescript"), js), (F.col("language") == "python", py)], F.array().cast("array<string>"))
    kind = F.when(F.col("language") == "python", "python").otherwise("javascript")
    return files.select(F.col("path").alias("src"), kind.alias("language"), F.explode(F.array_distinct(found)).alias("module"))


def exports(files: DataFrame) -> DataFrame:
    """files (path, language, text) to (path, name): what each file exports, ``default`` for a whole module."""
    js = F.concat(F.regexp_extract_all("text", F.lit(r"export\s+(?:function|class|const|let|var)\s+(\w+)"), F.lit(1)), F.transform(F.regexp_extract_all("text", F.lit(r"module\.exports\s*="), F.lit(0)), lambda _: F.lit("default")))
    py = F.regexp_extract_all("text", F.lit(r"(?m)^(?:def|class)\s+(\w+)"), F.lit(1))
    found = cases([(F.col("language").isin("javascript", "typescript"), js), (F.col("language") == "python", py)], F.array().cast("array<string>"))
    return files.select("path", F.explode(found).alias("name"))


def resolve(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(src, module, dst): each import's first existing candidate file, other than the importer itself."""
    folder = F.regexp_replace("src", r"[^/]*$", "")
    plain = F.regexp_replace("module", r"^\./", "")
    local = (F.col("language") == "python") | F.startswith("module", F.lit("."))
    suffixes = cases(((F.col("language") == k, F.array(*map(F.lit, v))) for k, v in SUFFIXES.items()), F.array().cast("array<string>"))
    tries = edges.where(local).select("src", "module", F.concat(folder, plain).alias("_b"), F.posexplode(suffixes).alias("_pos", "_suffix"))
    tries = tries.select("src", "module", "_pos", F.concat("_b", "_suffix").alias("dst"))
    there = tries.join(files.select(F.col("path").alias("dst")).distinct(), "dst")
    return there.groupBy("src", "module").agg(F.min_by("dst", "_pos").alias("dst")).where("src <> dst")


def cross_file_warnings(edges: DataFrame, findings: DataFrame) -> DataFrame:
    """A warning for each file that imports one with errors: path, imported, errors, rules."""
    errors = findings.where("severity = 'error'").groupBy("path").agg(F.count("*").alias("errors"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))
    return edges.select("src", "dst").distinct().join(errors.withColumnRenamed("path", "dst"), "dst").select(F.col("src").alias("path"), F.col("dst").alias("imported"), "errors", "rules", F.lit("warning").alias("severity"))


#: Steps of a way that are told.
STEPS = 3


def _spread(edges: pa.Table, sources: pa.Table) -> pa.Table:
    """The variables of one file by breadth-first search: each with its fewest steps, the least line of a source so near, and the last steps."""
    follow: dict[str, list[str]] = {}
    for target, var in zip(edges.column("target").to_pylist(), edges.column("source_var").to_pylist(), strict=True):
        follow.setdefault(var, []).append(target)
    told: dict[str, tuple[int, int | None, list[str]]] = {}
    for var, line in zip(sources.column("var").to_pylist(), sources.column("line").to_pylist(), strict=True):
        lines = [x for x in (line, told.get(var, (0, None))[1]) if x is not None]
        told[var] = 0, min(lines, default=None), [var]
    new, hops = sorted(told), 0
    while new:
        hops, found = hops + 1, {}
        for var in new:  # in order of name, so that the least one leads to a variable
            line, trail = told[var][1:]
            for target in follow.get(var, ()):
                if target not in told:
                    near, steps = found.get(target, (line, trail))
                    found[target] = (line if near is None else near if line is None else min(line, near)), steps
        told |= {t: (hops, line, [*trail, t][-STEPS:]) for t, (line, trail) in found.items()}
        new = sorted(found)
    path = sources.column("path")[0].as_py() if sources.num_rows else None
    names = list(told)
    return pa.table(
        {"path": pa.array([path] * len(names), pa.string()), "var": pa.array(names, pa.string()), "hops": pa.array([told[v][0] for v in names], pa.int32()), "source_line": pa.array([told[v][1] for v in names], pa.int32()), "trail": pa.array([told[v][2] for v in names], pa.list_(pa.string()))}
    )


def spread(assigns: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, var, hops, source_line, trail): variables that a source reaches through assignments, with the fewest assignments.

    assigns: path, target, source_var; sources: path, var, line. Files are independent, so each is searched
    by one task that holds its different assignments, as its parser held its text: chains may have any
    length, there are no rounds of jobs, and the plan is one shuffle of both sides. ``source_line`` is the
    least line of those sources that are so near, ``trail`` the last steps along the way that is least by name.
    """
    edges = assigns.select("path", "target", "source_var").distinct().groupBy("path")
    begun = sources.select(F.col("path").cast("string").alias("path"), F.col("var").cast("string").alias("var"), F.col("line").cast("int").alias("line")).distinct().groupBy("path")
    return edges.cogroup(begun).applyInArrow(_spread, "path string, var string, hops int, source_line int, trail array<string>")


def tainted(assigns: DataFrame, sources: DataFrame, sanitized: DataFrame | None = None) -> DataFrame:
    """(path, var, hops): variables that a source reaches through assignments, with the fewest assignments.

    assigns: path, target, source_var; sources: path, var; sanitized: path, target, source_var, assignments to
    leave out.
    """
    edges = assigns if sanitized is None else assigns.join(sanitized, ["path", "target", "source_var"], "left_anti")
    return spread(edges, sources.select("path", "var", F.lit(None).alias("line"))).select("path", "var", "hops")


def tainted_sinks(sinks: DataFrame, reached: DataFrame) -> DataFrame:
    """sinks (path, line, var) whose variable is tainted."""
    return sinks.join(reached, ["path", "var"])
