"""Toxicity: Levenshtein automata over a trie of learnt terms, hits weighed by what stands around them."""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Words are compared without the signs around them.
SIGNS = string.punctuation + "“”„‟‘’‚‹›«»…–—¡¿"
QUOTES = "\"“”„‟«»‹›‘’‚'`"
#: Stems have FROM to UPTO letters; a whole word has END behind it.
FROM, UPTO, END = 3, 12, "$"
#: Of a term: documents that are toxic and hold it, standard deviations above chance, log-odds, all at least; terms at most.
LEAST, SURE, ODDS, MOST = 4, 5.0, 1.5, 4096
#: Letters of a term from which one edit, and two, are looked for.
EDITS = (5, 9)
#: What an edit takes from a term's weight where nothing else is known, and how many documents that belief counts as.
EDIT_COSTS, BELIEF = 1.5, 8.0
#: Words on either side of a hit that are looked at, and what those found make of it.
WINDOW, QUOTED, CITED, AIMED = 4, 0.3, 0.5, 1.25
#: Words that tell of words (fixed values), and words of address.
CITING = frozenset("said says called calls quote quoted quotes term word words phrase sagte sagt nannte wort zitat dit disait mot appelé dijo dice palabra llamó cita".split())
ADDRESS = frozenset("you your you're youre du dich dein ihr tu te toi ton vous votre tú usted eres".split())
#: States of the automaton, and words, that a worker keeps.
STATES, WORDS = 40_000, 200_000
#: Rows by label that terms and scores are fitted on, at most.
SAMPLE = 8192


@dataclass(frozen=True)
class Terms:
    """The learnt terms: their letters, weights by number of edits, whether only as a whole word, and edits allowed."""

    texts: list[str]
    weights: np.ndarray
    whole: list[bool]
    edits: list[int]


class Matcher:
    """The Levenshtein automaton of all terms at once, intersected with their trie, made as words ask for it.

    A state holds the trie's nodes that a word's beginning may have come to, each with the least number of
    edits; a letter leads to the node's child without an edit, to any child or to the node itself with one
    more; children are also reached with one more edit and no letter. States and moves are kept, so a word
    that begins like others walks a deterministic automaton.
    """

    def __init__(self, terms: Terms):
        self.terms = terms
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.room: list[int] = [0]
        for k, text in enumerate(terms.texts):
            at, path = 0, [0]
            for c in text:
                if c not in self.kids[at]:
                    self.kids[at][c] = len(self.kids)
                    self.kids.append({})
                    self.ends.append([])
                    self.room.append(0)
                at = self.kids[at][c]
                path.append(at)
            self.ends[at].append(k)
            for n in path:
                self.room[n] = max(self.room[n], terms.edits[k])
        self.words: dict[str, tuple[int, int] | None] = {}
        self._clear()

    def _clear(self) -> None:
        self.known: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.stem: list[int] = []
        self.accepts: list[list[tuple[int, int]]] = []
        self._state({})  # the dead state is 0
        self.start = self._state(self._skipped({0: 0}))

    def _skipped(self, nodes: dict[int, int]) -> dict[int, int]:
        wait = list(nodes.items())
        while wait:
            n, e = wait.pop()
            if e == nodes[n]:
                for kid in self.kids[n].values():
                    if e < self.room[kid] and e + 1 < nodes.get(kid, 9):
                        nodes[kid] = e + 1
                        wait.append((kid, e + 1))
        return nodes

    def _state(self, nodes: dict[int, int]) -> int:
        key = tuple(sorted(nodes.items()))
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            weights = self.terms.weights
            stems = [k for n, e in key if e == 0 for k in self.ends[n] if not self.terms.whole[k]]
            self.stem.append(max(stems, key=lambda k: weights[k, 0], default=-1))
            self.accepts.append([(k, e) for n, e in key for k in self.ends[n] if e <= self.terms.edits[k]])
        return self.known[key]

    def _move(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}

        def put(n: int, e: int) -> None:
            if e <= self.room[n] and e < nodes.get(n, 9):
                nodes[n] = e

        for n, e in self.sets[state]:
            for letter, kid in self.kids[n].items():
                put(kid, e + (letter != c))
            put(n, e + 1)
        to = self.moves[state][c] = self._state(self._skipped(nodes))
        return to

    def _search(self, word: str) -> tuple[int, int] | None:
        if len(self.sets) > STATES:
            self._clear()
        at, best, most, weights = self.start, None, 0.0, self.terms.weights
        for c in word:
            to = self.moves[at].get(c)
            at = self._move(at, c) if to is None else to
            if not at:
                break
            k = self.stem[at]
            if k >= 0 and weights[k, 0] > most:
                best, most = (k, 0), weights[k, 0]
        for k, e in self.accepts[at]:
            if weights[k, e] > most:
                best, most = (k, e), weights[k, e]
        return best

    def match(self, token: str) -> tuple[int, int] | None:
        """The term and number of edits that weigh most, of those that begin the word, or are it within their edits."""
        if token not in self.words:
            if len(self.words) >= WORDS:
                self.words.clear()
            word = token.strip(SIGNS)
            self.words[token] = self._search(word) if len(word) >= FROM else None
        return self.words[token]

    def hits(self, text: str) -> tuple[int, dict[tuple[int, int], list[float]]]:
        """The number of words, and for each (term, edits) found the sum and the maximum of its places' context scores."""
        tokens = text.lower().split()
        match = self.words.get
        some = {t: m for t in set(tokens) if (m := match(t, 0)) is not None and (m or (m := self.match(t)))}
        found: dict[tuple[int, int], list[float]] = {}
        if some:
            for k, t in enumerate(tokens):
                if t in some:
                    score, told = context(tokens, k), found.setdefault(some[t], [0.0, 0.0])
                    told[0] += score
                    told[1] = max(told[1], score)
        return len(tokens), found


def context(tokens: list[str], k: int) -> float:
    """What a hit at place k counts: less between quote marks or near words that tell of words, more in address."""
    before, here, after = tokens[max(0, k - WINDOW) : k], tokens[k], tokens[k + 1 : k + 1 + WINDOW]
    opens = any(t[0] in QUOTES for t in (*before, here))
    closes = any(t.rstrip(".,;:!?")[-1:] in QUOTES and t.rstrip(".,;:!?") for t in (here, *after))
    near = {t.strip(SIGNS) for t in (*before, *after)}
    score = (QUOTED if opens and closes else 1.0) * (CITED if near & CITING else 1.0)
    return score * AIMED if score == 1.0 and (near & ADDRESS or here.endswith("!")) else score


def stems(text: str) -> set[str]:
    """The beginnings of the text's words, and its words."""
    found = set()
    for word in {t.strip(SIGNS) for t in set(text.lower().split())}:
        if len(word) >= FROM:
            found.add(word[: UPTO + 1] + END)
            found.update(word[:k] for k in range(FROM, min(len(word), UPTO) + 1))
    return found


@dataclass
class Counts:
    """Of each stem: how many documents that are toxic hold it, and how many others; and of each there are in all."""

    toxic: dict[str, int] = field(default_factory=dict)
    clean: dict[str, int] = field(default_factory=dict)
    n_toxic: int = 0
    n_clean: int = 0

    def odds(self, stem: str) -> float:
        return math.log((self.toxic.get(stem, 0) + 0.5) / (self.n_toxic + 1) * (self.n_clean + 1) / (self.clean.get(stem, 0) + 0.5))

    def surprise(self, stem: str) -> float:
        a, b = self.toxic.get(stem, 0), self.clean.get(stem, 0)
        chance = (a + b) * self.n_toxic / max(1, self.n_toxic + self.n_clean)
        return (a - chance) / math.sqrt(chance) if chance else 0.0

    def terms(self, edited: dict[tuple[str, int], tuple[int, int]] | None = None, sure: float = SURE) -> Terms:
        """Stems that are surely more frequent in toxic documents; of those that say the same the longest.

        ``edited`` has, by term and number of edits, how many toxic and other documents hold it so: a weight
        falls as far as others do, and stays EDIT_COSTS an edit below the term's where there are none.
        """
        likely = {s for s, a in self.toxic.items() if a >= LEAST and self.surprise(s) >= sure and self.odds(s) >= ODDS}
        longer: Counter = Counter()
        for s in likely:
            if s[-1] != END and s[:-1] in likely:
                longer[s[:-1]] = max(longer[s[:-1]], self.toxic[s])
        kept = [s for s in likely if (self.odds(s) > self.odds(s[:-1]) + 0.3 or s[:-1] not in likely if s[-1] == END else longer[s] < 0.9 * self.toxic[s])]
        kept = sorted(kept, key=lambda s: (-self.surprise(s), s))[:MOST]
        texts, whole, edits, weights = [], [], [], []
        for s in kept:
            text = s.rstrip(END)
            is_word = 2 * self.toxic.get(text + END, 0) >= self.toxic[s]
            allowed = sum(len(text) >= n for n in EDITS) if is_word else 0
            row = [self.odds(s)]
            for e in (1, 2):
                prior = max(0.0, self.odds(s) - EDIT_COSTS * e)
                a, b = (edited or {}).get((text, e), (0, 0))
                rate = BELIEF / (self.n_clean + 1)  # what the belief's documents hold, by label
                row.append(max(0.0, math.log((a / (self.n_toxic + 1) + rate * math.exp(prior)) / (b / (self.n_clean + 1) + rate))))
            texts.append(text)
            whole.append(s[-1] == END)
            edits.append(allowed)
            weights.append(row)
        return Terms(texts, np.array(weights, float).reshape(-1, 3), whole, edits)


@dataclass(frozen=True)
class Model:
    """Terms, and a logistic function of what their hits in a text come to."""

    terms: Terms
    coefficients: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.coefficients, -30, 30)))


def features(n: int, found: dict[tuple[int, int], list[float]], weights: np.ndarray) -> list[float]:
    """1, the log of the summed weights, of the same a word, and the greatest weight."""
    total = sum(weights[k, e] * x[0] for (k, e), x in found.items())
    most = max((weights[k, e] * x[1] for (k, e), x in found.items()), default=0.0)
    return [1.0, math.log1p(total), math.log1p(100 * total / (n + 50)), most]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Coefficients by Newton's method; none is below 0 but the first, so that more hits never lower a score."""
    b = np.zeros(x.shape[1])
    b[0] = math.log((weight[y == 1].sum() + 0.5) / (weight[y == 0].sum() + 0.5))
    free = np.ones(len(b), bool)
    for _ in range(4):
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            slope = x.T @ (weight * (y - p)) - ridge * np.r_[0, b[1:]]
            bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(np.r_[1e-9, np.full(len(b) - 1, ridge)])
            step = np.zeros(len(b))
            step[free] = np.linalg.solve(bend[np.ix_(free, free)], slope[free])
            b = b + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        low = free & (np.r_[0, b[1:]] < 0)
        if not low.any():
            break
        b[low], free = 0, free & ~low
    return b


def _held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def learnt_from(labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, toxic, half of up to ``sample`` rows a label by hash order, never held-out ones; and how many rows each label has."""
    per = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~_held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), "doc_id"]
    told = [per.where(F.col("toxic") == t).orderBy(*order).limit(sample) for t in (0, 1)]
    count = {r.toxic: r["count"] for r in per.groupBy("toxic").count().collect()}
    return told[0].unionAll(told[1]).withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")), count


#: Stems that a task counts before it tells them.
FULL = 400_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), *(pa.array([x[k] for x in counts.values()], pa.int64()) for k in range(4))], ["stem", *CELLS])

    for batch in batches:
        for text, toxic, half in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
            for s in stems(text or ""):
                counts.setdefault(s, [0, 0, 0, 0])[2 * half + toxic] += 1
            counts.setdefault("", [0, 0, 0, 0])[2 * half + toxic] += 1  # documents in all
            if len(counts) >= FULL:
                yield told()
                counts.clear()
    yield told()


#: Counts by half and label.
CELLS = [f"n{half}{toxic}" for half in (0, 1) for toxic in (0, 1)]


def _hits(shared):
    """Each learnt document's hits by the other half's terms, and by those of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [Matcher(t) for t in shared.value]
        for batch in batches:
            rows = []
            for text, toxic, half in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
                for which in (1 - half, 2):
                    n, found = matchers[which].hits(text or "")
                    rows.append((which, toxic, n, [k for k, _ in found], [e for _, e in found], [x[0] for x in found.values()], [x[1] for x in found.values()]))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["which", "toxic", "n", "terms", "edits", "sums", "most"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns terms and the scoring function from labelled rows that aren't held out.

    Stems are counted by label over at most ``sample`` documents a label (a bounded sample, joined by
    broadcast); those that are sure come to the driver, MOST at most a half. The function is fitted by
    cross-fitting: each half's documents are scored with terms that the other half gave, so that terms found
    by chance don't look good; labels' shares in the table weigh the sample.
    """
    spark = docs.sparkSession
    chosen, count = learnt_from(labels, sample)
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(stored(chosen, "chosen")), "doc_id").select("text", "toxic", "half")
    told = stored(told, "learnt")
    sums = told.mapInArrow(_count, ", ".join(["stem string", *(f"{c} long" for c in CELLS)])).groupBy("stem").agg(*(F.sum(c).alias(c) for c in CELLS))
    sums = stored(sums.where(F.expr(f"n01 + n11 >= {LEAST} or stem = ''")), "stems")
    n = sums.where("stem = ''").first() or dict.fromkeys(CELLS, 0)
    n_toxic, n_clean = n["n01"] + n["n11"], n["n00"] + n["n10"]
    z = lambda a, b, p: (F.expr(a) - F.expr(f"{a} + {b}") * F.lit(p)) / F.sqrt(F.expr(f"{a} + {b}") * F.lit(p) + 1e-9)
    share = n_toxic / max(1, n_toxic + n_clean)
    likely = F.greatest(z("n01 + n11", "n00 + n10", share), z("n01", "n00", share), z("n11", "n10", share))
    rows = sums.where("stem <> ''").withColumn("_z", likely).where(F.col("_z") >= SURE / 2).orderBy(F.desc("_z"), "stem").limit(16 * MOST).toArrow().to_pylist()
    parts = []
    for halves in ((0,), (1,), (0, 1)):
        part = Counts(n_toxic=sum(n[f"n{h}1"] for h in halves), n_clean=sum(n[f"n{h}0"] for h in halves))
        for r in rows:
            part.toxic[r["stem"]], part.clean[r["stem"]] = sum(r[f"n{h}1"] for h in halves), sum(r[f"n{h}0"] for h in halves)
        parts.append(part)
    terms = [p.terms(sure=SURE * math.sqrt(k)) for p, k in zip(parts, (0.5, 0.5, 1), strict=True)]  # half as many rows are as sure at so much less
    found = told.mapInArrow(_hits(spark.sparkContext.broadcast(terms)), "which int, toxic int, n long, terms array<int>, edits array<int>, sums array<double>, most array<double>").toArrow().to_pylist()  # 4 * sample rows at most
    held: dict[tuple[str, int], list[int]] = {}
    for r in found:
        if r["which"] == 2:
            for k, e in zip(r["terms"], r["edits"], strict=True):
                if e:
                    held.setdefault((terms[2].texts[k], e), [0, 0])[1 - r["toxic"]] += 1
    final = parts[2].terms({k: (a, b) for k, (a, b) in held.items()})
    known = {(t, e): final.weights[k, e] for k, t in enumerate(final.texts) for e in (1, 2)}
    x, y = [], []
    for r in found:
        if r["which"] < 2:
            own = terms[r["which"]]
            weights = {(k, e): [s, m] for k, e, s, m in zip(r["terms"], r["edits"], r["sums"], r["most"], strict=True)}
            table = {(k, e): own.weights[k, 0] if e == 0 else known.get((own.texts[k], e), 0.0) for k, e in weights}
            x.append(features(r["n"], weights, _Table(table)))
            y.append(r["toxic"])
    if not x:
        return Model(final, np.array([-30.0, 0, 0, 0]))
    x, y = np.array(x), np.array(y)
    weight = np.where(y == 1, count.get(1, 0) / max(1, (y == 1).sum()), count.get(0, 0) / max(1, (y == 0).sum()))
    return Model(final, logistic(x, y, weight / weight.mean()))


class _Table(dict):
    """A table of weights, asked like an array."""

    def __getitem__(self, key):
        return self.get(key, 0.0)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        matcher, weights = Matcher(model.terms), model.terms.weights
        for batch in batches:
            told = [features(*matcher.hits(t.as_py() or ""), weights) for t in batch.column("text")]
            score = model.score(np.array(told, float).reshape(-1, 4))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    docs: doc_id, text and any other columns, which are ignored; labels: doc_id, toxic. Null and empty texts
    have no hits and score like any text without; null ids count as held out, and have no label; repeated rows
    score the same; very long texts are read whole; where no row is labelled, all scores are near 0; an empty
    table gives an empty result. Documents aren't shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))  # MOST terms at most
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(shared), "doc_id long, score double")
    return told.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity by what the labelled rows outside the held-out fifth teach."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
