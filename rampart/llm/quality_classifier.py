"""Quality classifier: importance resampling by hashed n-gram models, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_automaton import AT_ONCE, forget
from .common import KEY_BITS, histogram_cut, stored
from .pieces import slices

#: Buckets of the word unigrams, and as many of the bigrams.
BUCKETS = 1 << 18
#: Log-ratios are counted in whole parts of a nat, so that sums are exact and reruns agree.
UNIT = 1024
#: Parts of the trusted sample: for the cut, documents of one are scored by a target model of the others.
FOLDS = 5
#: Shares of the raw distribution in the target model, as multiples of its own mass: of unigrams, of bigrams.
PRIORS = (0.05, 0.3)
#: The weight at the lower end of the trusted documents is 1; a bad one that is better than MOST_BAD of the bad is drawn with probability RARE.
RARE, MOST_BAD = 0.002, 0.9
#: The least temperature, where good and bad documents don't part.
COLDEST = 1 / 256
#: Sampling keys are counted in 2**-SCALE and clipped to 2**-(SCALE - KEY_BITS + 1).
SCALE = 24
#: An odd base of the words' polynomial hash, and multipliers that mix (fixed values of this table of weights).
BASE, MIX, PAIR = 0x100000001B3, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def gram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' word unigrams and bigrams, and the text of each; null texts have none.

    A word's hash is the sum of byte i times BASE**i, modulo 2**64; a bigram's is first * PAIR + second. The
    bucket is the upper bits of the hash, times MIX after a fold.
    """
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32)
    lo, hi = int(ends[0]), int(ends[-1])
    if lo == hi:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi]
    word = (raw != 32) & ((raw < 9) | (raw > 13))
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = ends[:-1][ends[:-1] < hi] - lo
    first[at] = word[at]
    starts, kept = np.flatnonzero(first), np.flatnonzero(word)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.searchsorted(kept, starts)
    place = np.arange(len(kept)) - np.repeat(begins, np.diff(np.append(begins, len(kept))))
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(place.max()), BASE, np.uint64)]))
    words = np.add.reduceat((raw[kept].astype(np.uint64) + np.uint64(1)) * powers[place], begins)
    of = np.searchsorted(ends - lo, starts, "right") - 1
    same = of[1:] == of[:-1]
    pairs = (words[:-1] * np.uint64(PAIR) + words[1:])[same]
    return np.concatenate([_bucket(words), _bucket(pairs) + BUCKETS]), np.concatenate([of, of[1:][same]])


def _bucket(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(MIX)
    return (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def weights_of(raw: np.ndarray, target: np.ndarray, priors: tuple[float, float] = PRIORS) -> np.ndarray:
    """log p_target - log p_raw by bucket in whole UNITs.

    The raw counts are half a count a bucket more; the target is smoothed by the raw distribution with its
    prior times its own mass.
    """
    out = np.zeros(len(raw), np.int32)
    for lo, prior in zip(range(0, len(raw), BUCKETS), priors, strict=True):
        r, t = raw[lo : lo + BUCKETS].astype(float), target[lo : lo + BUCKETS].astype(float)
        if t.sum():
            p = (r + 0.5) / (r.sum() + 0.5 * len(r))
            out[lo : lo + BUCKETS] = np.round(np.log((t + prior * p * t.sum()) / ((1 + prior) * t.sum()) / p) * UNIT)
    return out


def judged_labels(labels: DataFrame, most: int) -> DataFrame:
    """doc_id, kind of up to ``most`` trusted and as many bad documents, by hash order: a trusted one's fold, or FOLDS for bad.

    Trusted documents are only called good and never toxic; bad ones are only called bad. The sample fits the
    target model, the cut and the temperature alone.
    """
    per = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    good = per.where("lo = 1 and t = 0").orderBy(*order).limit(most).select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("kind"))
    return good.unionAll(per.where("hi = 0").orderBy(*order).limit(most).select("doc_id", F.lit(FOLDS).alias("kind")))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    raw, target = np.zeros(2 * BUCKETS, np.int64), np.zeros((FOLDS, 2 * BUCKETS), np.int64)
    for batch in batches:
        for part in slices(batch, size=AT_ONCE):
            buckets, of = gram_buckets(part.column("text"))
            raw += np.bincount(buckets, minlength=2 * BUCKETS)
            kinds = part.column("kind").to_numpy(zero_copy_only=False)[of]
            for fold in range(FOLDS) if (kinds < FOLDS).any() else ():
                target[fold] += np.bincount(buckets[kinds == fold], minlength=2 * BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), *(pa.array(t[some]) for t in target)], ["bucket", "raw", *TARGETS])


TARGETS = [f"target{k}" for k in range(FOLDS)]


@dataclass(frozen=True)
class Sampler:
    """The weights by bucket, the log-ratio and the temperature that say how surely a document is drawn."""

    weights: np.ndarray
    cut: float
    temperature: float = 1.0
    seed: int = 17

    def log_ratios(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text's log-ratio in nats a word, and whether it has words: the mean of its unigrams' plus that of its bigrams'.

        Sums grow with a text's length, so that of two texts of one kind the longer would outweigh any other.
        """
        buckets, of = gram_buckets(texts)
        total = np.zeros(len(texts))
        for one in (buckets < BUCKETS, buckets >= BUCKETS):
            n = np.bincount(of[one], minlength=len(texts))  # weights are whole numbers, so that sums are exact in doubles
            total += np.bincount(of[one], self.weights[buckets[one]], minlength=len(texts)) / np.maximum(n, 1)
        return total / UNIT, np.bincount(of, minlength=len(texts)) > 0

    def keys(self, log_ratio: np.ndarray, some: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Sampling keys: the higher log_ratio / temperature + Gumbel noise is, the lower; the last one without words.

        The k smallest keys are a sample of k documents without replacement by their importance weights.
        """
        noise = -np.log(-np.log(((bits & (2**52 - 1)).astype(float) + 0.5) / 2.0**52))
        half = 2 ** (KEY_BITS - 1)
        noisy = np.round(np.clip((log_ratio / self.temperature + noise) * 2.0**SCALE, -half, half)).astype(np.int64)
        return np.where(some, np.clip(half - noisy, 0, 2 * half - 2), 2 * half - 1)


def fit(docs: DataFrame, labels: DataFrame, *, priors: tuple[float, float] = PRIORS, sample: int = 40_960, lost: float = 0.01, temperature: float | None = None, seed: int = 17) -> Sampler:
    """Fits both models, the raw one on every document and the target one on the trusted sample, the cut and the temperature.

    A task counts all buckets in memory ((1 + FOLDS) * 2 * BUCKETS numbers) and shuffles those sums. Trusted
    documents are scored without their own fold. The sample is broadcast: it has at most 2 * ``sample`` rows.
    """
    chosen = F.broadcast(stored(judged_labels(labels, sample), "judged"))
    told = docs.select("doc_id", "text").join(chosen, "doc_id", "left").select("text", F.coalesce("kind", F.lit(FOLDS)).alias("kind"))
    counted = told.mapInArrow(_counter, ", ".join(["bucket int", *(f"{c} long" for c in ("raw", *TARGETS))]))
    sums = counted.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("raw", *TARGETS))).toArrow()  # at most 2 * BUCKETS rows
    counts = np.zeros((1 + FOLDS, 2 * BUCKETS), np.int64)
    for k, c in enumerate(("raw", *TARGETS)):
        counts[k, sums.column("bucket").to_numpy()] = sums.column(c).to_numpy()
    raw, target = counts[0], counts[1:].sum(axis=0)
    models = [Sampler(weights_of(raw, target - part, priors), -np.inf) for part in (*counts[1:], np.zeros_like(raw))]
    shared = docs.sparkSession.sparkContext.broadcast(models)  # FOLDS + 1 times 2 * BUCKETS weights
    judged = docs.select("doc_id", "text").join(chosen, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "kind").mapInArrow(_judge(shared), "doc_id long, kind int, log_ratio double")
    rows = judged.where("log_ratio is not null").groupBy("doc_id", "kind").agg(F.min("log_ratio").alias("s")).toArrow()  # at most 2 * sample rows
    is_bad, score = rows.column("kind").to_numpy() == FOLDS, rows.column("s").to_numpy()
    cut, fitted = calibrated(score[~is_bad], score[is_bad], lost)
    return Sampler(models[-1].weights, cut, fitted if temperature is None else temperature, seed)


def calibrated(good, bad, lost: float) -> tuple[float, float]:
    """The cut and the temperature: the log-ratio where a document's weight is 1, and how fast weights grow from there.

    A document is drawn with probability 1 - exp(-w), w being its weight, exp((log_ratio - cut) / temperature).
    The weight is 1 for the trusted document that ``lost`` of the trusted (or one) lie below; the chance is
    RARE for the bad one that MOST_BAD of the bad lie below. If the latter is not the lesser one, it is nearly
    a cut.
    """
    if not len(good):
        return -np.inf, 1.0
    good = np.sort(good)
    low = float(good[min(max(1, int(lost * len(good))), len(good) - 1)])
    worse = float(np.quantile(bad, MOST_BAD)) if len(bad) else low - float(np.median(good) - low)
    return low, max((low - worse) / -float(np.log(-np.log(1 - RARE))), COLDEST)


def _judge(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for kind in np.unique(kinds):
                part = batch.filter(pa.array(kinds == kind))
                ratio, some = shared.value[kind].log_ratios(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("kind"), pa.array(ratio, mask=~some)], ["doc_id", "kind", "log_ratio"])

    return score


def _scorer(sampler):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sampler.value
        for batch in batches:
            for part in slices(batch, size=AT_ONCE):
                ratio, some = known.log_ratios(part.column("text"))
                key = known.keys(ratio, some, part.column("bits").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ratio, mask=~some), pa.array(key)], ["doc_id", "log_ratio", "key"])

    return score


def _bits(seed: int):
    """64 bits from the document's id and text: reruns, and repeated rows, draw the same."""
    return F.xxhash64(F.lit(seed), "doc_id", "text").alias("bits")


def with_keys(docs: DataFrame, sampler: Sampler) -> DataFrame:
    """doc_id, log_ratio and key of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(sampler)  # 2 * BUCKETS numbers
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _bits(sampler.seed))
    return told.mapInArrow(_scorer(shared), "doc_id long, log_ratio double, key long")


def resample(docs: DataFrame, labels: DataFrame, *, share: float | None = None, **how) -> tuple[Sampler, DataFrame, int, int]:
    """The sampler, the scored documents (doc_id, log_ratio, key), k, and the cut of the k smallest keys.

    k is the budget: ``share`` of the documents with words, or, where that is None, as many as the weights
    call for in all, each document with its probability 1 - exp(-w) (``calibrated``). Which k they are is
    sampled: the k smallest keys are a sample without replacement by the weights, so documents far above the
    cut are taken, those far below are not, and those between now and then. The cut of the keys comes from
    bucket counts; no row is sorted. Ties at the cut are taken together.
    """
    sampler = fit(docs, labels, **how)
    scored = stored(with_keys(docs, sampler), "scored")
    some = scored.where("log_ratio is not null")
    if share is not None:
        k = round(share * some.count())
    elif sampler.cut == -np.inf:
        k = some.count()
    else:
        chance = 1 - F.exp(-F.exp((F.col("log_ratio") - F.lit(sampler.cut)) / F.lit(sampler.temperature)))
        k = round((some.agg(F.sum(F.round(chance * 2**20).cast("long"))).first()[0] or 0) / 2**20)  # whole parts, so that reruns agree
    need = docs.sparkSession.range(1).select(F.lit(1).alias("all"), F.lit(float(k)).alias("need"))
    cut = histogram_cut(scored.select("key", F.lit(1).alias("all"), F.lit(1).alias("one")), "all", "key", "one", need).first()["cut"]
    return sampler, scored, k, cut


def quality_classifier(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, log_ratio, key, kept of every document.

    docs: doc_id, text and any other columns, which are ignored; labels: doc_id, quality, toxic. A document's
    importance weight is exp(log_ratio / temperature), log_ratio being a mean over its whole text. Null and
    empty texts have no log_ratio and are never sampled; very long texts are summed whole, in slices of
    their own; repeated rows get the same key and verdict; null ids are documents like any other, without
    labels; with no trusted label all weights are equal and every document with words is taken; an empty
    table gives an empty result.
    """
    _, scored, _, cut = resample(docs, labels, **how)
    return scored.withColumn("kept", (F.col("key") < cut) & F.col("log_ratio").isNotNull())


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's log-ratio, sampling key and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _keeper(sampler, cut: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sampler.value
        for batch in batches:
            for part in slices(batch, size=AT_ONCE):
                ratio, some = known.log_ratios(part.column("text"))
                stay = some & (known.keys(ratio, some, part.column("bits").to_numpy()) < cut)
                yield part.select(["rest", "text"]).filter(pa.array(stay))

    return keep


def keep_by_classifier(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are sampled, with its columns, whatever their names; scores are computed again rather than joined."""
    sampler, _, _, cut = resample(docs, labels, **how)
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")
    told = docs.select(others, F.col("text").cast("string").alias("text"), _bits(sampler.seed))
    shared = docs.sparkSession.sparkContext.broadcast(sampler)
    kept = told.mapInArrow(_keeper(shared, cut), told.select("rest", "text").schema)
    return kept.select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns))
