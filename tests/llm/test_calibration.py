"""The cut between trusted and rejected documents: labelled junk goes at every size, clean documents stay."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rampart.llm import ngram_lm, quality_classifier, quality_rules

SIZES = ["sf0.001", "sf0.01", "sf0.1"]


@pytest.fixture(scope="module", params=SIZES)
def tables(spark, request):
    at = f"/root/testdata/{request.param}"
    if not Path(at).exists():
        pytest.skip("no test tables")
    labels = spark.read.parquet(f"{at}/labels.parquet")
    of = labels.groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    kinds = of.select("doc_id", F.when(F.col("most") == 0, "bad").when((F.col("least") == 1) & (F.col("toxic") == 0), "good").alias("kind"))
    return spark.read.parquet(f"{at}/documents.parquet"), labels, kinds


def shares(judged, kinds):
    found = judged.join(kinds, "doc_id").where("kind is not null").groupBy("kind").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    return {r.kind: r.share for r in found}


def test_one_odd_document_moves_no_cut():
    good = [1 + i / 100 for i in range(50)]
    assert 0.5 < ngram_lm.best_cut(good, [0.1, 0.5]) <= 1
    assert 0.5 < ngram_lm.best_cut([-9.0, *good], [0.1, 0.5]) <= 1
    assert ngram_lm.best_cut(good, [1.9]) < 1.02  # a bad one like the good does not take them along
    assert ngram_lm.best_cut(good, []) is None and ngram_lm.best_cut([], [0.1]) is None


def test_rules_reject_labelled_junk(tables):
    docs, labels, kinds = tables
    judged = quality_rules.quality_rules(docs, labels).select("doc.doc_id", "quality.*").where("not base_failed")
    got = shares(judged, kinds)
    assert got["bad"] <= 0.02 and got["good"] >= 0.98


def test_classifier_rejects_labelled_junk(tables):
    docs, labels, kinds = tables
    got = shares(quality_classifier.quality_classifier(docs, labels), kinds)
    assert got["bad"] <= (0.06 if docs.count() > 200 else 0.4) and got["good"] >= 0.98


def test_stages_reject_labelled_junk(tables):
    """Stage 2 alone, on documents that the base rules pass, and after stage 1."""
    docs, labels, kinds = tables
    at = quality_rules.quality_rules(docs, labels)
    passed = at.where("not quality.base_failed").select("doc.*").cache()
    for before in (passed, at.where("quality.kept").select("doc.*").cache()):
        kept = quality_classifier.keep_by_classifier(before, labels).select("doc_id").distinct().withColumn("kept", F.lit(True))
        got = shares(before.select("doc_id").join(kept, "doc_id", "left").fillna(False, ["kept"]), kinds)
        assert got.get("bad", 0) <= (0.06 if docs.count() > 200 else 0.2) and got["good"] >= 0.97


@pytest.mark.parametrize("ties", [3, 40, 10_000])
def test_order_statistics_of_all_scores(spark, ties):
    """The cut and the median of ranged scores are those of plain lists."""
    import random
    from statistics import median

    r = random.Random(ties)
    good, bad = ([r.randrange(ties) / 7 + shift for _ in range(n)] for n, shift in ((701, 0.4), (333, -0.2)))
    rows = [(True, x) for x in good] + [(False, x) for x in bad]
    found = ngram_lm.Scores(spark.createDataFrame(rows, "good boolean, score double"))
    assert found.middle() == median(good) and found.cut() == ngram_lm.best_cut(good, bad)
    swapped = ngram_lm.Scores(spark.createDataFrame([(not k, x) for k, x in rows], "good boolean, score double"))
    assert swapped.cut() == ngram_lm.best_cut(bad, good)
    alone = ngram_lm.Scores(spark.createDataFrame(rows[:700], "good boolean, score double"))
    assert alone.cut() is None and alone.middle() == median(good[:700])


@pytest.mark.parametrize("near", [0, 2_000_000])
def test_every_trusted_document_counts(spark, monkeypatch, near):
    """More trusted documents than a sample once held: each one's own word weighs in favour of it, by either join."""
    n = 7000
    monkeypatch.setattr(ngram_lm, "NEAR", near)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("own"), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    model = ngram_lm.fit(docs, labels, buckets=2**20)
    out = ngram_lm.trusted(labels).where("not held_out").join(docs, "doc_id").select(model.score(F.col("text")).alias("s"))
    assert out.count() > 5120 and out.where("s < 0").count() == 0
