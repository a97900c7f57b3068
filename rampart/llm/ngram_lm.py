"""Hashed n-gram multinomials of trusted and raw text, and their log-likelihood ratio, in DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, stored, words

#: A weight is a log-likelihood ratio in parts of a nat: sums are exact, reruns agree, and the table of
#: weights, which stands in the plan as a literal, stays short.
UNIT = 32


@dataclass(frozen=True)
class NgramRatio:
    """log p_target - log p_raw by hash bucket, as whole UNITs, and what the held-out trusted documents score.

    mean and sd are the median and the spread of the middle, which one odd document does not move; cut is
    the score that parts them from documents labelled bad, None without such labels; sd is told where cut is not.
    """

    weights: tuple[int, ...]
    orders: tuple[int, ...]
    buckets: int
    shrink: int
    mean: float | None
    sd: float | None
    cut: float | None = None

    def score(self, text: Column) -> Column:
        """Mean log-ratio of the text's n-grams in nats; ``shrink`` neutral n-grams are added. No n-gram: null."""
        # One literal array: a foldable expression that the optimizer evaluates once.
        table = F.split(F.lit(",".join(map(str, self.weights))), ",").cast("array<int>")

        def scored(g: Column) -> Column:
            total = F.aggregate(g, F.lit(0).cast("long"), lambda acc, b: acc + F.get(table, b))
            return F.when(F.size(g) > 0, total.cast("double") / UNIT / (F.size(g) + self.shrink))

        return let(ngrams(words(text), self.orders, self.buckets), scored)


def ngrams(tokens: Column, orders: tuple[int, ...], buckets: int) -> Column:
    """Array of the hash buckets of the n-grams; every order has ``buckets`` of its own."""

    def of(w: Column) -> Column:
        kinds = []
        for k, n in enumerate(orders):
            if n == 1:
                hashed = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int") + k * buckets)
            else:
                firsts = F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))
                hashed = F.transform(firsts, lambda x, i: F.pmod(F.xxhash64(x, *(F.get(w, i + j) for j in range(1, n))), F.lit(buckets)).cast("int") + k * buckets)
            kinds.append(hashed)
        return F.concat(*kinds) if len(kinds) > 1 else kinds[0]

    return of(tokens) if orders == (1,) else let(tokens, of)


def trusted(labels: DataFrame) -> DataFrame:
    """All documents that are labelled good and not toxic: doc_id, held_out (a fifth). One with contradictory labels is not trusted."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0")
    return good.select("doc_id", (F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5)) == 0).alias("held_out"))


def trusted_sample(labels: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` of the trusted documents, by hash order; ``fit`` takes all."""
    return trusted(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def rejected(labels: DataFrame) -> DataFrame:
    """doc_id of all documents with labels that only call them bad."""
    bad = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 0")
    return bad.select("doc_id")


def rejected_sample(labels: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` of the rejected documents, by hash order; ``fit`` takes all."""
    return rejected(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def best_cut(good: list[float], bad: list[float], lost: float = 0.02) -> float | None:
    """The score that parts ``good`` from ``bad`` best by the sum of both shares, losing few good ones.

    Cuts that lose more than ``lost`` of the good ones (one at least may go) are not considered, so neither
    a mislabelled bad document nor an odd good one decides. Between two scores the cut lies in the middle.
    """
    if not good or not bad:
        return None
    good, bad = sorted(good), sorted(bad)
    steps = sorted({*good, *bad})
    cuts = [steps[0], *((a + b) / 2 for a, b in zip(steps, steps[1:], strict=False))]
    may = max(1, int(lost * len(good)))
    share = {c: (bisect_left(bad, c) / len(bad) - bisect_left(good, c) / len(good)) for c in cuts if bisect_left(good, c) <= may}
    return max(share, key=lambda c: (share[c], -c))


#: So many labelled ids are broadcast at most.
NEAR = 2_000_000
#: Ranges that the different scores are dealt to; their sums come to the driver, never scores.
RANGES = 64


class Scores:
    """Exact order statistics of labelled scores, by range: scores of one range lie in one task, sums of ranges on the driver."""

    def __init__(self, scores: DataFrame):
        """scores: good (boolean), score (double)."""
        n = lambda c: F.count_if(c).alias
        per = scores.groupBy("score").agg(n(F.col("good"))("good"), n(~F.col("good"))("bad"))
        dealt = per.repartitionByRange(RANGES, "score").withColumn("part", F.spark_partition_id())
        self.rows = stored(dealt, "scores")
        ranges = sorted(self.rows.groupBy("part").agg(F.sum("good"), F.sum("bad"), F.max("score")).collect())  # RANGES rows at most
        self.good, self.bad, before = 0, 0, []
        for part, good, bad, _ in ranges:
            before.append((part, self.good, self.bad))
            self.good, self.bad = self.good + good, self.bad + bad
        self.most = max((r[3] for r in ranges), default=None)
        upto = W.partitionBy("part").orderBy("score").rowsBetween(W.unboundedPreceding, 0)
        offset = F.broadcast(scores.sparkSession.createDataFrame(before, "part int, _g long, _b long"))
        #: score, and how many good and bad ones are not above it.
        self.summed = self.rows.join(offset, "part").select("score", "good", (F.sum("good").over(upto) + F.col("_g")).alias("g"), (F.sum("bad").over(upto) + F.col("_b")).alias("b"))

    def middle(self) -> float:
        """The median of the good ones."""
        found = [self.summed.where((F.col("g") > k) & (F.col("g") - F.col("good") <= k)).first().score for k in {(self.good - 1) // 2, self.good // 2}]
        return sum(found) / len(found)

    def cut(self, lost: float = 0.02) -> float | None:
        """``best_cut`` of all scores."""
        if not self.good or not self.bad:
            return None
        may = max(1, int(lost * self.good))
        share = F.col("b") / F.lit(float(self.bad)) - F.col("g") / F.lit(float(self.good))
        steps = self.summed.where((F.col("g") <= may) & (F.col("score") < self.most))
        best = steps.select("score", share.alias("share")).orderBy(F.desc("share"), "score").first()
        if best is None or best.share <= 0:  # the lowest score loses none and finds none
            return self.rows.agg(F.min("score")).first()[0]
        return (best.score + self.rows.where(F.col("score") > best.score).agg(F.min("score")).first()[0]) / 2


def fit(docs: DataFrame, labels: DataFrame, *, orders=(1,), buckets: int = 2**16, prior: float = 0.25, shrink: int = 0) -> NgramRatio:
    """Fits both multinomials: the raw one on every document, the target one on every trusted document that is not held out.

    The raw counts are half a count a bucket more; the target is smoothed by the raw distribution with
    ``prior`` times its own mass, so an n-gram that the target lacks costs log(prior / (1 + prior)),
    however rare it is. Counting shuffles at most ``len(orders) * buckets`` sums a task. The cut and the
    spread are those of all held-out trusted and all rejected documents. Up to NEAR labelled ids are broadcast
    (checked by a count), more are joined by a shuffle of the texts.
    """
    told = stored(trusted(labels).withColumn("good", F.lit(True)).unionByName(rejected(labels).select("doc_id", F.lit(True).alias("held_out"), F.lit(False).alias("good"))), "told")
    near = F.broadcast if told.count() <= NEAR else lambda t: t
    known = docs.select("doc_id", "text").join(near(told), "doc_id", "left")
    grams = known.select(F.coalesce(~F.col("held_out"), F.lit(False)).cast("int").alias("target"), F.explode(ngrams(words(F.col("text")), orders, buckets)).alias("bucket"))
    counts = stored(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target")), "grams")
    of_order = [counts.where((F.col("bucket") >= k * buckets) & (F.col("bucket") < (k + 1) * buckets)) for k in range(len(orders))]
    by_bucket = reduce(DataFrame.unionAll, [_weights(x, buckets, prior) for x in of_order])
    table = [0] * (len(orders) * buckets)
    for row in by_bucket.collect():  # at most len(orders) * buckets rows
        table[row.bucket] = row.weight
    model = NgramRatio(tuple(table), tuple(orders), buckets, shrink, None, None)
    judged = docs.select("doc_id", "text").join(near(told.where("held_out")), "doc_id")
    scores = judged.select("doc_id", "good", model.score(F.col("text")).alias("score"))
    scores = stored(scores.groupBy("doc_id", "good").agg(F.min("score").alias("score")).where("score is not null"), "scored")
    found = Scores(scores)
    if not found.good:
        return model
    middle, cut = found.middle(), found.cut()
    sd = None if cut is not None else 1.4826 * Scores(scores.where("good").select("good", F.abs(F.col("score") - middle).alias("score"))).middle()
    return replace(model, mean=middle, sd=sd, cut=cut)


def _weights(counts: DataFrame, buckets: int, prior: float) -> DataFrame:
    """bucket and weight of one order; a target without a single n-gram says nothing (weights 0)."""
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    raw, target = float(total.raw or 0), float(total.target or 0)
    if not target:
        return counts.select("bucket", F.lit(0).alias("weight"))
    p_raw = (F.col("raw") + 0.5) / (raw + 0.5 * buckets)
    p_target = (F.col("target") + p_raw * (prior * target)) / ((1 + prior) * target)
    return counts.select("bucket", F.round(F.log(p_target / p_raw) * UNIT).cast("int").alias("weight"))
