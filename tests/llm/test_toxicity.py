"""Toxicity: the automaton against edit distances of all terms, contexts, held-out accuracy, odd rows."""

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampart.llm import toxicity
from rampart.llm.toxicity import Counts, Matcher, Terms, context, features, logistic, stems

LARGE = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def by_hand(terms, word):
    best = 0.0
    for k, t in enumerate(terms.texts):
        if not terms.whole[k] and word.startswith(t):
            best = max(best, terms.weights[k, 0])
        d = distance(t, word)
        if d <= terms.edits[k]:
            best = max(best, terms.weights[k, d])
    return best


def test_automaton_and_trie():
    r = random.Random(1)
    letters = "abcd"
    texts = sorted({"".join(r.choices(letters, k=r.randrange(3, 9))) for _ in range(60)})
    terms = Terms(texts, np.array([[9 + r.random(), 5 + r.random(), 1 + r.random()] for _ in texts]), [r.random() < 0.5 for _ in texts], [r.choice([0, 1, 2]) for _ in texts])
    m = Matcher(terms)
    words = ["".join(r.choices(letters + "xé", weights=[8] * 4 + [1, 1], k=r.randrange(3, 12))) for _ in range(3000)] + texts
    for w in words:
        found = m.match(w)
        assert (terms.weights[found] if found else 0.0) == by_hand(terms, w), w
    assert sum(m.match(w) is not None for w in words) > 300


def test_states_are_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 50)
    monkeypatch.setattr(toxicity, "WORDS", 10)
    terms = Terms(["abcabc", "bcdbcdbcd"], np.array([[3.0, 2, 1]] * 2), [False, False], [1, 2])
    m, r = Matcher(terms), random.Random(2)
    for _ in range(2000):
        w = "".join(r.choices("abcdx", k=r.randrange(3, 11)))
        found = m.match(w)
        assert (terms.weights[found] if found else 0.0) == by_hand(terms, w)
        assert len(m.sets) < 50 + 12 and len(m.words) <= 10


TERM = Terms(["stupid", "réeux"], np.array([[6.0, 4.5, 3.0], [3.0, 1.0, 0.5]]), [True, False], [1, 0])


def test_misspelled_words_and_contexts():
    m = Matcher(TERM)
    assert [m.match(w) for w in ("stupid", "STUPID!!".lower(), "(stuppid)", "st*pid", "stpid", "sstupidd", "stupidity", "réeuxment", "réeu", "")] == [(0, 0), (0, 0), (0, 1), (0, 1), (0, 1), None, None, (1, 0), None, None]
    score = lambda text: m.hits(text)[1][0, 0][0]
    plain, quoted, cited, aimed = score("this is a stupid thing to do"), score('this is a "stupid thing" to do'), score("the word is stupid and old now"), score("you are so stupid all of it")
    assert quoted < plain and cited < plain < aimed
    assert score("„stupid“") < plain and score("the term 'stupid' is one") < quoted
    assert m.hits("Stupid stupid stuppid")[1] == {(0, 0): [2.0, 1.0], (0, 1): [1.0, 1.0]}
    assert m.hits("")[0] == 0 and features(0, {}, TERM.weights) == [1.0, 0.0, 0.0, 0.0]
    assert context(["stupid"], 0) == 1.0


def test_terms_that_are_sure():
    toxic = ["what an idiot he is", "an idiot and his idiots", "no idiot can", "idiot", "the idiotic one is an idiot"] * 4
    clean = ["what an idea he has", "the one and no other can", "she is what she is"] * 40
    c = Counts(n_toxic=len(toxic), n_clean=len(clean))
    for told, texts in ((c.toxic, toxic), (c.clean, clean)):
        for t in texts:
            for s in stems(t):
                told[s] = told.get(s, 0) + 1
    terms = c.terms()
    assert "idiot" in terms.texts and not {"an", "the", "ide", "idi", "idio"} & set(terms.texts)
    k = terms.texts.index("idiot")
    assert terms.edits[k] == 1 and terms.weights[k, 0] > terms.weights[k, 1] > terms.weights[k, 2]
    seen = c.terms({("idiot", 1): (0, 30)})
    assert seen.weights[k, 1] < terms.weights[k, 1] and seen.weights[k, 0] == terms.weights[k, 0]


def test_logistic_never_falls_with_hits():
    r = np.random.RandomState(3)
    x = np.c_[np.ones(400), r.rand(400), r.rand(400), r.rand(400)]
    y = (x[:, 1] - x[:, 2] + 0.3 * r.randn(400) > 0).astype(int)
    b = logistic(x, y, np.ones(400))
    assert b[1] > 1 and b[2] == 0 and b[3] >= 0
    assert logistic(x, np.zeros(400, int), np.ones(400))[0] < -5


@pytest.mark.skipif(not Path(LARGE).exists(), reason="no test tables")
def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{LARGE}/documents.parquet"), spark.read.parquet(f"{LARGE}/labels.parquet")
    rows = toxicity.op13_toxicity(spark, LARGE).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    out = [r for r in rows if r.held_out]
    good = [r for r in out if r.toxic and r.quality]
    assert len(good) > 50 and sum(r.predicted for r in good) >= 0.97 * len(good)
    assert sum(r.predicted for r in out if not r.toxic) <= 0.005 * len(out)
    # Labels of held-out rows, and the other columns, are never looked at.
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.lit(0))
    other = docs.withColumn("source", F.lit("x")).withColumn("lang", F.lit(None).cast("string"))
    again = {r.doc_id: r.score for r in toxicity.toxicity(other, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)


def test_odd_rows(spark):
    base = [(i, f"some words number{i} here", 0) for i in range(80)] + [(100 + i, f"you are a moron number{i} here", 1) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in base] + [(None, "a moron"), (500, None), (501, ""), (502, " \n"), (503, "moron " * 50_000), (504, "word " * 50_000), (505, "x" * 100_000), (1, "some words number1 here"), (506, "what a morron")], "doc_id long, text string")
    docs = docs.withColumn("score", F.lit("x")).withColumn("toxic", F.lit(9)).withColumn("half", F.lit(7))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in base] + [(None, 1, 1), (5, None, None), (5, 1, 0), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    got = {}
    rows = toxicity.toxicity(docs, labels).collect()
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert len(rows) == docs.count() and len(got[1]) == 2 and got[1][0].score == got[1][1].score
    assert all(got[i][0].predicted == y for i, _, y in base)
    assert got[None][0].held_out and got[None][0].predicted == 1 and got[503][0].predicted == 1 and got[506][0].score > got[504][0].score
    assert got[500][0].score == got[501][0].score == got[502][0].score == got[505][0].score < 0.5
    nothing = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(nothing) == len(rows) and all(r.score < 0.01 for r in nothing)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    none_toxic = toxicity.toxicity(docs, labels.where("toxic = 0")).collect()
    assert all(r.predicted == 0 for r in none_toxic)
