"""Packages: imports in code, registry membership, typosquats, dependency confusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.columns import cases


def imported(code: Column, ecosystem: str) -> Column:
    """Array of the packages that code imports: first path segment without @, relative ones left out."""
    found = F.flatten(F.array(*(F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in T.IMPORTS.get(ecosystem, ()))))
    outside = F.filter(found, lambda x: (x != "") & ~F.startswith(x, F.lit(".")) & ~F.startswith(x, F.lit("/")))
    return F.array_distinct(F.transform(outside, lambda x: F.regexp_replace(F.split_part(x, F.lit("/"), F.lit(1)), "^@", "")))


def extract_packages(files: DataFrame) -> DataFrame:
    """files (path, ecosystem, text) to distinct (path, ecosystem, name)."""
    lists = cases(((F.col("ecosystem") == e, imported(F.col("text"), e)) for e in T.IMPORTS), F.array().cast("array<string>"))
    return files.select("path", "ecosystem", F.explode(lists).alias("name"))


def membership(packages: DataFrame, registry: DataFrame, approximate: tuple[str, ...] = ("npm", "pypi", "rubygems")) -> DataFrame:
    """packages (ecosystem, name, ...) with status legitimate, hallucinated or unknown, and confidence.

    registry: ecosystem, name. Unknown means that nothing of the ecosystem is loaded. Membership is exact; the
    confidence of large registries, elsewhere kept as Bloom filters, is medium.
    """
    loaded = registry.select(F.col("ecosystem").alias("_e")).distinct().withColumn("_loaded", F.lit(True))
    known = registry.select(F.col("ecosystem").alias("_re"), F.col("name").alias("_rn")).distinct().withColumn("_known", F.lit(True))
    asked = packages.join(loaded, F.col("ecosystem") == F.col("_e"), "left").join(known, (F.col("ecosystem") == F.col("_re")) & (F.col("name") == F.col("_rn")), "left")
    status = cases([(F.col("_loaded").isNull(), "unknown"), (F.col("_known").isNotNull(), "legitimate")], "hallucinated")
    return asked.withColumn("status", status).withColumn("confidence", F.when(F.col("ecosystem").isin(*approximate), "medium").otherwise("high")).drop("_e", "_loaded", "_re", "_rn", "_known")


def _deleted(words: Column) -> Column:
    """Every word of an array without one of its letters, and the words themselves."""
    without = F.transform(words, lambda w: F.transform(F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))))
    return F.array_distinct(F.concat(words, F.flatten(without)))


def neighbours(name: Column, most: int = 2) -> Column:
    """Hashes of the name with up to ``most`` letters left out: names within so many edits have one in common."""
    words = F.array(F.lower(name))
    for _ in range(most):
        words = _deleted(words)
    return F.transform(words, lambda w: F.xxhash64(w))


def squat_candidates(packages: DataFrame, popular: DataFrame, most: int = 2) -> DataFrame:
    """Different (ecosystem, name, similar_to) that share a deletion neighbour: an equi-join, whatever the number of popular names."""
    asked = packages.select("ecosystem", "name").distinct()
    near = popular.select(F.col("ecosystem").alias("_e"), F.col("name").alias("similar_to")).distinct()
    left = asked.select("ecosystem", "name", F.explode(neighbours(F.col("name"), most)).alias("key"))
    right = near.select("_e", "similar_to", F.explode(neighbours(F.col("similar_to"), most)).alias("_key"))
    met = left.join(right, (F.col("ecosystem") == F.col("_e")) & (F.col("key") == F.col("_key")))
    return met.where((F.abs(F.length("name") - F.length("similar_to")) <= most) & (F.lower("name") != F.lower("similar_to"))).select("ecosystem", "name", "similar_to").distinct()


def typosquats(packages: DataFrame, popular: DataFrame, most: int = 2, limit: int = 5) -> DataFrame:
    """Up to ``limit`` popular names (ecosystem, name) within ``most`` edits of each package, nearest first.

    Candidates come from an index of deletion neighbours, the exact distance decides. Names are those of a
    registry: a name of n letters has about n * n / 2 neighbours.
    """
    pairs = squat_candidates(packages, popular, most)
    scored = pairs.withColumn("distance", F.levenshtein(F.lower("name"), F.lower("similar_to"), most)).where("distance between 1 and " + str(most))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("ecosystem", "name").orderBy("distance", "similar_to")))
    exact = popular.select(F.col("ecosystem"), F.col("name"))
    return ranked.where(F.col("rank") <= limit).join(exact, ["ecosystem", "name"], "left_anti").select("ecosystem", "name", "similar_to", "distance", "rank")


def confusion(names: DataFrame, popular: DataFrame) -> DataFrame:
    """names (name) with confusion_risk and why: public-name, scope or prefix."""
    public = popular.select(F.col("name").alias("_p")).distinct()
    scoped = F.col("name").rlike(r"^@[a-z0-9-]+/")
    rest = F.regexp_replace("name", r"^@[a-z0-9-]+/", "")
    low = F.lower("name")
    prefix = cases(((F.startswith(low, F.lit(p)) & (F.length(low) > len(p)), p) for p in T.INTERNAL_PREFIXES), F.lit(None).cast("string"))
    asked = names.withColumn("_rest", F.when(scoped, rest)).join(public, F.col("_rest") == F.col("_p"), "left")
    why = cases([(scoped & F.col("_p").isNotNull(), "public-name"), (scoped, "scope"), (prefix.isNotNull(), F.concat(F.lit("prefix:"), prefix))], "none")
    return asked.withColumn("reason", why).withColumn("confusion_risk", F.col("reason") != "none").drop("_rest", "_p")


def registry_stats(registry: DataFrame) -> DataFrame:
    return registry.groupBy("ecosystem").agg(F.count_distinct("name").alias("packages"))


def package_report(found: DataFrame) -> DataFrame:
    """Counts by status and what to say first: hallucinated, then unknown."""
    n = lambda s: F.count_if(F.col("status") == s)
    per = found.groupBy("path").agg(F.count("*").alias("packages"), n("legitimate").alias("legitimate"), n("hallucinated").alias("hallucinated"), n("unknown").alias("unknown"))
    return per.withColumn("recommendation", cases([(F.col("hallucinated") > 0, "hallucinated"), (F.col("unknown") > 0, "unknown")], "ok"))
