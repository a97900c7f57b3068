"""Mixing sources to target weights: hash-threshold histograms (native)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import KEY_BITS, histogram_cut, stored, words


def hash_key() -> F.Column:
    """A document's place in the mix's order: the first 48 bits of the MD5 of its id and text.

    A larger budget takes every document that a smaller one takes. Only rows equal in id and text tie.
    """
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """Per source (source, source_size): its target, when all targets sum to ``share`` of all sizes.

    The share is dealt by weight, weights repeating over the sources by code point with null last; a
    target stops at ``most`` times its source's size and the excess is dealt again by weight. That is
    water-filling: with the sources by cap / weight, the k first to fill are capped, and the rest get
    (budget - caps) * weight / (weights left), for the smallest k that leaves none above its cap. The
    windows run over one row a source.
    """
    everywhere = W.partitionBy()
    n = len(weights)
    ranked = sizes.withColumn("_i", F.row_number().over(everywhere.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % n + 1).cast("int")).cast("double"))
    capped = weighed.withColumn("_cap", F.col("source_size").cast("double") * most)
    order = everywhere.orderBy((F.col("_cap") / F.col("_weight")).asc(), "_i")
    before, upto = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    filled = (
        capped.withColumn("_budget", F.sum("source_size").over(everywhere).cast("double") * share)
        .withColumn("_caps", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_left", F.sum("_weight").over(everywhere) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        # Open: were all before it capped, this source's part of the rest would be within its cap.
        .withColumn("_open", (F.col("_budget") - F.col("_caps")) * F.col("_weight") / F.col("_left") <= F.col("_cap"))
        .withColumn("_rest", F.max(F.col("_open").cast("int")).over(upto) == 1)
        .withColumn("_at", F.min(F.when(F.col("_open"), F.col("_caps"))).over(everywhere))
        .withColumn("_of", F.max(F.when(F.col("_open"), F.col("_left"))).over(everywhere))
    )
    dealt = (F.col("_budget") - F.col("_at")) * F.col("_weight") / F.col("_of")
    return filled.select("source", "source_size", F.when(F.col("_rest"), dealt).otherwise(F.col("_cap")).alias("target"))


def cuts(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """The documents' (doc_id, source, size, key), and per source its (source, source_size, target, whole, cut)."""
    sized = stored(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), hash_key().alias("key")), "sizes")
    per = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = per.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    at = histogram_cut(sized, "source", "key", "size", per.where("source_size > 0")).withColumnRenamed("source", "_s")
    found = per.join(at, F.col("source").eqNullSafe(F.col("_s")), "left")
    return sized, stored(found.select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut")), "cuts")


def with_copies(rows: DataFrame, per: DataFrame, most: int) -> DataFrame:
    """``rows`` (source, key, ...) with their source's figures and ``copies``, how often the mix takes them."""
    per = per.withColumnRenamed("source", "_s")
    copies = F.least(F.col("whole") + (F.col("key") < F.col("cut")).cast("long"), F.lit(most).cast("long"))
    return rows.join(per, F.col("source").eqNullSafe(F.col("_s"))).withColumn("copies", copies).drop("_s")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Each document's part in a mix of the sources by weight.

    docs: doc_id, text, source (further columns are ignored). Returns doc_id, source, key, size (words),
    source_size, target, whole, cut, copies, taken (size * copies). A source takes every document
    ``whole`` = floor(target / source_size) times and, once more, those whose hash key is below ``cut``,
    which ``histogram_cut`` finds. Null ids, texts (size 0) and sources (one source, last) are allowed;
    rows equal in id and text are taken alike; very long texts count whole and weigh in a cut like any others; a source without words has target 0 and takes nothing; an
    empty table gives an empty mix. A source with most of the rows has larger sums, not a larger task.
    """
    sized, per = cuts(docs, weights, share, most)
    return with_copies(sized, per, most).withColumn("taken", F.col("size") * F.col("copies"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    Only the cuts meet the documents, by source; texts are not shuffled.
    """
    _, per = cuts(docs, weights, share, most)
    rows = with_copies(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), "source", hash_key().alias("key")), per, most)
    return rows.where("copies > 0").select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_doc.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """The contract's mix of all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_OP1 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 12))::BIGINT AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s
), w AS (
  SELECT *, [3.0, 1.0, 2.0][i % 3 + 1]::DOUBLE AS weight, source_size::DOUBLE * 2 AS cap,
         (SELECT sum(source_size) FROM s)::DOUBLE * 1.5 AS budget
  FROM r
), o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w
), f AS (
  SELECT *, (budget - caps) * weight / rest <= cap AS is_open FROM o
), t AS (
  SELECT source, source_size,
         CASE WHEN (bool_or(is_open) OVER (ORDER BY cap / weight, i)) THEN
           (budget - (min(caps) FILTER (is_open) OVER ())) * weight / (max(rest) FILTER (is_open) OVER ())
         ELSE cap END AS target
  FROM f
), n AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), k AS (
  SELECT source, key, sum(size)::BIGINT AS tied,
         (sum(sum(size)) OVER (PARTITION BY source ORDER BY key))::BIGINT AS upto
  FROM d GROUP BY source, key
)
SELECT d.doc_id, d.size, n.source_size, n.target,
       (d.size * (n.whole + CASE WHEN k.upto <= n.target - n.whole * n.source_size
           OR (k.upto - k.tied <= n.target - n.whole * n.source_size
               AND (n.target - n.whole * n.source_size - (k.upto - k.tied)) * 2 >= k.tied) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.key = k.key
"""
