"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text, thresholded (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words
from .ngram_lm import NgramRatio, fit

#: With at most so many different repeated windows, membership is tested by search, else by sorting positions.
FEW = 24
#: Unigrams and bigrams of words, in 2**15 buckets each.
MODEL = {"orders": (1, 2), "buckets": 2**15}


def covered_words(w: Column) -> Column:
    """Words of ``w`` inside a window of three words that occurs at least twice in ``w``.

    Windows are compared by a 64-bit hash, within one text. Texts without a repeated window, most of
    them, stop after a hash set; the rest sort the hashes, find the repeated ones, then merge the covered
    positions: sorted starts s cover min(3, next s - s) words each.
    """
    zero = F.lit(0).cast("long")

    def merged(starts: Column) -> Column:
        return F.aggregate(starts, F.struct(F.lit(-3).alias("last"), zero.alias("n")), lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(3), s - a["last"])).alias("n")), lambda a: a["n"])

    def by_search(h: Column, again: Column) -> Column:
        flagged = F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i))
        return merged(F.filter(flagged, lambda i: i.isNotNull()))

    def by_sort(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return let(placed, lambda s: merged(F.sort_array(F.transform(twice(s), lambda x: x["i"]))))

    def repeated(h: Column) -> Column:
        again = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: (k > 0) & (F.get(s, k - 1) == x))))
        return let(again, lambda a: F.when(F.size(a) <= FEW, by_search(h, a)).otherwise(by_sort(h)))

    windows = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, zero).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(repeated(h))))


def base_stats(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long); null text is empty."""
    full = F.coalesce(text, F.lit(""))
    symbols = F.length(full) - F.length(F.regexp_replace(full, r"[#*$%&|<>]", ""))
    lines = F.filter(F.split(full, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = F.when(F.instr(full, "\n") == 0, F.lit(0)).otherwise(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            dup_lines.cast("long").alias("n_dup_lines"),
            covered_words(w).alias("n_repeat_words"),
        ),
    )


def base_failed(s: str = "") -> Column:
    """Under 50 words, or over half of the words in repeated windows."""
    return (F.col(f"{s}n_words") < 50) | (F.col(f"{s}n_repeat_words") * 100 > F.col(f"{s}n_words") * 50)


def threshold(model: NgramRatio, deviations: float) -> float | None:
    """The lowest score that passes: the cut between labels; without bad ones so many deviations below the middle of held-out trusted documents."""
    if model.mean is None or model.cut is not None:
        return model.cut
    return model.mean - deviations * max(model.sd, 0.01)


def quality_rules(docs: DataFrame, labels: DataFrame, *, deviations: float = 6.0, **how) -> DataFrame:
    """``doc``, a struct of all columns of ``docs``, and ``quality``, a struct of the figures, llr and verdicts.

    docs: doc_id, text and any other columns; labels: doc_id, quality, toxic. quality: n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept. Every document is scored by the mean
    log-likelihood ratio of its hashed n-grams and kept unless it fails the base rules or scores below
    ``threshold``. Null and empty texts fail the base rules; repeated rows are judged alike; very
    long texts are read whole; further columns, whatever their names, pass through in ``doc``; with no trusted
    label there is no ratio and the base rules decide; an empty table gives an empty result. One scan, no shuffle of documents.
    """
    model = fit(docs, labels, **(MODEL | how))
    least = threshold(model, deviations)
    llr = model.score(F.col("text")) if least is not None else F.lit(None).cast("double")
    told = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), base_stats(F.col("text")).alias("base"), llr.alias("llr"))
    judged = told.select("doc", "base", "llr", base_failed("base.").alias("failed"))
    passes = F.lit(True) if least is None else F.coalesce(F.col("llr") >= least, F.lit(False))
    return judged.select("doc", F.struct("base.*", F.col("failed").alias("base_failed"), "llr", (~F.col("failed") & passes).alias("kept")).alias("quality"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's figures and verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc.doc_id", "quality.*")


def keep_by_rules(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns."""
    return quality_rules(docs, labels, **how).where("quality.kept").select("doc.*")
