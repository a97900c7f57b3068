"""Importance resampling against plain Python: n-gram buckets, weights, keys, the cut, and how often a document is drawn."""

import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rampart.llm import quality_classifier as qc

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FULL = 2**64


def slow_buckets(text):
    words = [sum((b + 1) * pow(qc.BASE, i, FULL) for i, b in enumerate(w)) % FULL for w in WORD.findall((text or "").encode())]
    bucket = lambda h: ((h ^ (h >> 31)) * qc.MIX % FULL) >> (64 - int(math.log2(qc.BUCKETS)))
    return [bucket(h) for h in words] + [bucket((a * qc.PAIR + b) % FULL) + qc.BUCKETS for a, b in zip(words, words[1:], strict=False)]


@pytest.mark.parametrize("texts", [[], [None], ["", None, " "], ["a b  c", None, "", "x", "\nfoo bar\tbaz ", "é ü  a b", " lead", "trail ", "\x1c a", "a" * 1000 + " b", "b"]])
def test_buckets(texts):
    for held in (pa.array(texts, pa.string()), pa.array(["zz", *texts, "y y"], pa.string()).slice(1, len(texts))):
        buckets, of = qc.gram_buckets(held)
        for k, t in enumerate(texts):
            assert sorted(buckets[of == k].tolist()) == sorted(slow_buckets(t))


@pytest.fixture(scope="module")
def told(spark):
    clean = [" ".join(f"word{(i * 7 + k * k) % 90}" for k in range(80)) for i in range(200)]
    rude = [t + " nasty nasty nasty" for t in clean[:30]]
    junk = [" ".join(f"word{(i + k) % 90}***" for k in range(80)) for i in range(40)]
    texts = [*clean, *rude, *junk, None, "", "  "]
    labels = [(i, 1, 0) for i in range(0, 200, 2)] + [(i, 1, 1) for i in range(200, 220)] + [(i, 0, 0) for i in range(230, 250)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_against_brute_force(spark, told):
    texts, docs, labels = told
    kinds = {r.doc_id: r.kind for r in qc.judged_labels(labels, 5120).collect()}
    sampler, scored, k, cut = qc.resample(docs, labels)
    raw, target, of = Counter(), [Counter() for _ in range(qc.FOLDS)], [slow_buckets(t) for t in texts]
    for i, g in enumerate(of):
        raw.update(g)
        if kinds.get(i, qc.FOLDS) < qc.FOLDS:
            target[kinds[i]].update(g)
    assert all(target)

    def model(without=None):
        """log-ratio of buckets by a target without a fold."""
        told = sum((c for k, c in enumerate(target) if k != without), Counter())
        totals = [(sum(n for b, n in raw.items() if b // qc.BUCKETS == k), sum(n for b, n in told.items() if b // qc.BUCKETS == k)) for k in (0, 1)]

        def weight(b):
            (r, t), prior = totals[b // qc.BUCKETS], qc.PRIORS[b // qc.BUCKETS]
            p = (raw[b] + 0.5) / (r + 0.5 * qc.BUCKETS)
            return round(math.log((told[b] + prior * p * t) / ((1 + prior) * t) / p) * qc.UNIT)

        return {b: weight(b) for b in raw}

    def log_ratio(i, weights):
        both = [[weights[b] for b in of[i] if b // qc.BUCKETS == k] for k in (0, 1)]
        if both[0]:
            return sum(sum(x) / max(1, len(x)) for x in both) / qc.UNIT

    whole, parts = model(), [model(k) for k in range(qc.FOLDS)]
    assert all(sampler.weights[b] == w for b, w in whole.items())
    ratio = {i: log_ratio(i, whole) for i in range(len(texts))}
    rows = {r.doc_id: r for r in scored.collect()}
    assert all((r.log_ratio is None) == (ratio[i] is None) and (r.log_ratio is None or abs(r.log_ratio - ratio[i]) < 1e-12) for i, r in rows.items())
    good = sorted(log_ratio(i, parts[k]) for i, k in kinds.items() if k < qc.FOLDS)
    bad = sorted(ratio[i] for i, k in kinds.items() if k == qc.FOLDS)
    chance = lambda s: 1 - math.exp(-math.exp((s - sampler.cut) / sampler.temperature))
    assert sampler.cut == good[max(1, int(0.01 * len(good)))] and abs(chance(float(np.quantile(bad, 0.9))) - 0.002) < 1e-9
    assert abs(k - sum(chance(r) for r in ratio.values() if r is not None)) < 0.51
    bits = {r.doc_id: r.bits for r in docs.select("doc_id", qc._bits(17)).collect()}
    for i, r in rows.items():
        if ratio[i] is not None:
            noise = -math.log(-math.log(((bits[i] & (2**52 - 1)) + 0.5) / 2**52))
            assert abs(r.key - (2**47 - (ratio[i] / sampler.temperature + noise) * 2**qc.SCALE)) <= 2
    taken = {i for i, r in rows.items() if r.key < cut and r.log_ratio is not None}
    assert taken == set(sorted(rows, key=lambda i: rows[i].key)[:k])
    assert not taken & set(range(230, 250)) and len(taken & set(range(200))) >= 198 and not taken & {250 + 20, 271, 272}


def test_share_is_a_budget(told):
    _, docs, labels = told
    for share in (0.0, 0.25, 1.0):
        _, scored, k, cut = qc.resample(docs, labels, share=share)
        assert k == round(share * 270) == scored.where((F.col("key") < cut) & F.col("log_ratio").isNotNull()).count()


def test_inclusion_frequencies_follow_the_weights():
    """Of k = 1 the first draw is by weight; of k = 2 the second is by weight among the rest."""
    weights = np.array([1.0, 2.0, 4.0, 8.0])
    sampler = qc.Sampler(np.zeros(1), 0.0)
    draws = np.random.RandomState(3).randint(0, 2**52, (40_000, 4))
    first, both = np.zeros(4), np.zeros(4)
    for bits in draws:
        order = np.argsort(sampler.keys(np.log(weights), np.ones(4, bool), bits))
        first[order[0]] += 1
        both[order[:2]] += 1
    p = weights / weights.sum()
    second = p + np.array([sum(p[j] * p[i] / (1 - p[j]) for j in range(4) if j != i) for i in range(4)])
    assert np.abs(first / len(draws) - p).max() < 0.01 and np.abs(both / len(draws) - second).max() < 0.01


def test_temperature_flattens_the_weights():
    bits = np.random.RandomState(4).randint(0, 2**52, 20_000)
    ratio = np.tile([0.0, 3.0], 10_000)
    share = lambda t: np.diff(np.sort(qc.Sampler(np.zeros(1), 0.0, t).keys(ratio, np.ones(20_000, bool), bits))).size and (np.argsort(qc.Sampler(np.zeros(1), 0.0, t).keys(ratio, np.ones(20_000, bool), bits))[:1000] % 2).mean()
    assert share(1.0) > 0.92 > share(10.0) > 0.5


def test_calibration_of_few_labels():
    assert qc.calibrated([], [1.0], 0.01) == (-np.inf, 1.0)
    cut, heat = qc.calibrated([1.0, 2.0], [-5.0, -4.0, 0.5], 0.01)
    assert cut == 2 and heat > 0.2
    for good, bad in (([0.0] * 5, [0.0] * 5), ([1.0], [3.0]), ([1.0], [])):
        cut, heat = qc.calibrated(good, bad, 0.01)
        assert heat == qc.COLDEST and cut == good[0]


def test_the_sample_is_no_threshold(spark):
    """On a whole table the sample differs from the k best scores, and over seeds documents are drawn as often as their weights say."""
    at = "/root/testdata/sf0.1"
    if not Path(at).exists():
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    sampler, scored, k, cut = qc.resample(docs, labels)
    rows = [(r.log_ratio, r.key < cut) for r in scored.where("log_ratio is not null").collect()]
    assert abs(sum(t for _, t in rows) - k) <= 2
    best = sorted((s for s, _ in rows), reverse=True)[k - 1]
    assert sum((s >= best) != taken for s, taken in rows) >= 5
    _, scored, half, cut = qc.resample(docs, labels, share=0.5)  # where a budget asks for a choice among good ones, the sample makes it
    drawn = [(r.log_ratio, r.key < cut) for r in scored.where("log_ratio is not null").collect()]
    best = sorted((s for s, _ in drawn), reverse=True)[half - 1]
    assert sum((s >= best) != taken for s, taken in drawn) >= 0.05 * len(drawn)
    ratio = np.array([s for s, _ in rows])
    drawn, r = np.zeros(len(rows)), np.random.RandomState(5)
    for _ in range(200):
        keys = sampler.keys(ratio, np.ones(len(rows), bool), r.randint(0, 2**52, len(rows)))
        drawn[np.argpartition(keys, k)[:k]] += 1
    chance = 1 - np.exp(-np.exp((ratio - sampler.cut) / sampler.temperature))
    for lo in np.arange(0, 1, 0.1):
        here = (chance >= lo) & (chance < lo + 0.1)
        if here.sum() >= 10:
            assert abs(drawn[here].mean() / 200 - chance[here].mean()) < 0.03
