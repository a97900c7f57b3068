"""The pipeline's near-dedup stage: copies of 0.8 and more by 5-word shingles go, and those within 4 bits of SimHash; others stay."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rampart.llm import simhash, similar


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def bits(a, b):
    return bin(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).count("1")


def test_near_copies_go(spark):
    r = random.Random(7)
    rows, copies, far = [], set(), 0
    for base in range(0, 1200, 2):
        w = [f"w{r.randrange(5000)}" for _ in range(200)]
        c = list(w)
        for at in r.sample(range(10, 190), r.randint(1, 8)):
            c[at] = f"x{at}"
        a, b = " ".join(w), " ".join(c).upper() if base % 4 else " ".join(c)
        rows += [(base, a), (base + 1, b)]
        if jaccard(a, b.lower()) >= 0.8 or bits(a, b) <= 4:
            copies.add(base + 1)
            far += bits(a, b) > 4
    assert far > 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows} - copies


def test_links_beside_the_least_of_a_bucket_are_found(spark):
    """All neighbours of a chain are similar, its ends are not: one class."""
    w = [f"w{i}" for i in range(300)]
    chain = [" ".join(f"y{i}" if i < 12 * k else x for i, x in enumerate(w)) for k in range(9)]
    docs = spark.createDataFrame([*enumerate(chain), (20, None), (21, " \n"), (22, "one two"), (23, "One  two"), (None, "alone here")], "doc_id long, text string")
    assert jaccard(chain[0], chain[8]) < 0.8 <= jaccard(chain[0], chain[1])
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {0, 20, 22, None}
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_stage_on_the_tables(spark, data):
    """All pairs of documents by plain Python: what stays is the least of each class."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    told = sorted((x.doc_id, x.text or "") for x in docs.collect())
    sets = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())(t.lower().split()) for i, t in told}
    prints = {i: simhash.fingerprint(t.encode()) for i, t in told}
    of = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and of[a] != of[b] and (sets[a] == sets[b] or (prints[a] ^ prints[b]).bit_count() <= 4 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                lo, hi = sorted((of[a], of[b]))
                of = {i: lo if c == hi else c for i, c in of.items()}
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(of.values())


def test_hot_band_and_fingerprint(spark):
    """Hundreds of copies of one text and of empty ones beside texts that share long passages: one row a class stays."""
    r = random.Random(9)
    passage = " ".join(f"p{r.randrange(3000)}" for _ in range(60))
    rows = [(i, passage + " " + " ".join(f"w{r.randrange(5000)}" for _ in range(200))) for i in range(60)]
    rows += [(100 + i, "the same words again and again in many rows of one table") for i in range(300)]
    rows += [(500 + i, None if i % 2 else "  ") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {*range(60), 100, 500}


@pytest.mark.parametrize("n", [400, 4000])
def test_a_shared_passage_makes_no_candidates(spark, n):
    """Texts of which two thirds are one passage meet no more often than their number."""
    r = random.Random(11)
    passage = " ".join(f"p{r.randrange(3000)}" for _ in range(120))
    own = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(30))
    docs = spark.createDataFrame([(i, f"{own()} {passage} {own()}") for i in range(n)], "doc_id long, text string")
    _, members = similar.candidates(docs)
    assert members.count() < n / 10
    if n == 400:
        assert corpus_pipeline.near_dedup(spark, docs, "").count() == n


def test_the_order_decides_no_link(spark):
    """With no shingle known as frequent, or all orders reversed, the same pairs of similar sets share a token."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(120):
        w = list(base)
        for at in r.sample(range(60), r.randrange(4)):
            w[at] = f"x{r.randrange(20)}"
        texts.append(" ".join(w[r.randrange(6) :]))
    sets = [similar.shingles(t.encode()) for t in texts]
    every = np.unique(np.concatenate(sets))
    orders = [similar.Order(np.zeros(0, np.uint64), np.zeros(0)), similar.Order(every, np.array([sum(x in s for s in sets) for x in every])), similar.Order(every, np.array(r.choices(range(1, 99), k=len(every))))]
    close = {(a, b) for a in range(120) for b in range(a) if similar.similar(sets[a], sets[b])}
    assert len(close) > 50
    for order in orders:
        first = [{t: k for k, t in enumerate(order.prefix(s)[0].tolist())} for s in sets]
        for a, b in close:
            least = -(-4 * (len(sets[a]) + len(sets[b])) // 9)
            assert any(first[a][t] <= len(sets[a]) - least and first[b][t] <= len(sets[b]) - least for t in first[a].keys() & first[b].keys())


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_tokens_that_meet(size):
    """Sorted rows in batches of any size: nodes of tokens that more than one has, with the least; all of salted ones."""
    r = random.Random(13)
    rows = sorted({(t := r.randrange(-40, 40), t % 3 if t > 30 else -1, r.randrange(25)) for _ in range(300)} | {(99, -1, 5)}, key=lambda x: (*x[:2], x[2] % 5, x[2]))
    rows = [x for x in rows for _ in range(r.randrange(1, 3))]
    table = pa.table({"token": pa.array([x[0] for x in rows], pa.int64()), "salt": pa.array([x[1] for x in rows], pa.int32()), "node": pa.array([x[2] for x in rows], pa.int64()), "size": pa.array([x[2] + 7 for x in rows], pa.int32()), "at": pa.array([x[2] % 5 for x in rows], pa.int32())})
    got = [tuple(x.values()) for b in similar._met(iter(table.to_batches(max_chunksize=size))) for x in b.to_pylist()]
    runs = {}
    for t, salt, n in rows:
        runs.setdefault((t, salt), set()).add(n)
    assert sorted(got) == sorted((t, n, n + 7, n % 5, (a := min(x, key=lambda v: (v % 5, v))), a + 7, a % 5) for (t, salt), x in runs.items() for n in x if len(x) > 1 or salt >= 0)


def test_dealt_tokens(spark, monkeypatch):
    """Tokens of many texts are dealt into parts; what is linked stays the same."""
    monkeypatch.setattr(similar, "SPLIT", 5)
    r = random.Random(14)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(x if r.random() > 0.01 else f"y{r.randrange(99)}" for x in base)) for i in range(120)]
    rows += [(200 + i, " ".join(f"z{r.randrange(9999)}" for _ in range(80))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets, prints = {i: similar.shingles(t.encode()) for i, t in rows}, {i: simhash.fingerprint(t.encode()) for i, t in rows}
    of = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and of[a] != of[b] and (similar.similar(sets[a], sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 4):
                lo, hi = sorted((of[a], of[b]))
                of = {i: lo if c == hi else c for i, c in of.items()}
    assert 40 < len(set(of.values())) < 120
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(of.values())


def test_outlines_lose_no_pair():
    """Sets of all sizes: similar ones may be similar by their outlines, and most others may not."""
    r = np.random.RandomState(15)
    passed = others = 0
    for _ in range(3000):
        n = int(r.choice([1, 2, 3, 5, 17, 60, 64, 65, 300, 1000]))
        a = np.unique(r.randint(0, 2**63, n).astype(np.uint64))
        kept = a[r.rand(len(a)) < r.choice([0.5, 0.8, 0.9, 0.95, 1.0])]
        b = np.unique(np.concatenate([kept, r.randint(0, 2**63, r.randint(0, 1 + n // 5)).astype(np.uint64)]))
        may = similar.may_be_similar(similar.outline(a), len(a), similar.outline(b), len(b))
        if similar.similar(a, b):
            assert may
        elif n >= 60:
            others += 1
            passed += may
    assert others > 300 and passed < 0.2 * others


def test_a_passage_that_is_most_of_many_texts(spark):
    """Texts of which 80 to 88 % are one passage: they meet in no token, or are similar."""
    r = random.Random(16)
    passage = [f"p{r.randrange(3000)}" for _ in range(160)]
    rows = [(i, " ".join([*(f"w{r.randrange(10**6)}" for _ in range(r.randrange(22, 38))), *passage])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, members = similar.candidates(docs)
    other = members.select("token", F.col("node").alias("b"), F.col("size").alias("b_size"), F.col("at").alias("b_at"))
    assert members.join(other, "token").where("node < b").where(similar._meet("size", "at", "b_size", "b_at")).count() < 300


def test_a_round_of_components_has_few_shuffles_and_stars_need_none(spark, monkeypatch):
    """On a table of many tasks each shuffle is hundreds of tasks, whose metrics the driver keeps."""
    from rampart.llm import components as c

    path = spark.createDataFrame([(k + 1, k) for k in range(40)], "u long, v long")
    plan = c.small_star(c.large_star(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 10  # as planned; five once equal ones are reused
    rounds = []
    monkeypatch.setattr(c, "large_star", lambda e, f=c.large_star: rounds.append(1) or f(e))
    stars = spark.createDataFrame([(2, 1), (3, 1), (1, 1), (1, 3), (8, 7)], "u long, v long")
    assert sorted(c.components(stars, "u", "v").collect()) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)] and not rounds
    assert sorted(c.components(path, "u", "v").collect()) == [(k, 0) for k in range(41)] and rounds
    assert c.components(path.where("false"), "u", "v").collect() == []
