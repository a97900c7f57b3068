"""The operators' queries against plain Python on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from rampart.llm import bpe_automaton, chat_format, html_extract, simhash
from rampart.llm.quality_classifier import quality_classifier
from rampart.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(sql):
    return dict(sql.sql("select doc_id, text from documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, data, sql, name):
    df = QUERIES[name](spark, data)
    found = sql.sql(ORACLES[name])
    columns = list(found.columns)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(map(tuple, found.fetchall()))


def test_sharding(spark, data, texts):
    got = QUERIES["op2_sharding"](spark, data).collect()
    assert {r.doc_id for r in got} == set(texts)
    size = {r.doc_id: (r["size"], r.text_crc32) for r in got}
    assert all(size[i] == (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts.items())
    shards, at = Counter(), {}
    for r in got:
        shards[r.shard] += r["size"]
        at.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(x) == 1 for x in at.values()) and len(shards) == 24
    for k in shards:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert max(shards.values()) - min(shards.values()) < 0.02 * sum(shards.values()) / 24 or max(shards.values()) <= max(s for s, _ in size.values()) * 1.01


def test_pages(spark, data, sql):
    from html import unescape

    got = {r.page_id: r for r in QUERIES["op3_html_extract"](spark, data).collect()}
    for page, html in sql.sql("select page_id, html from pages").fetchall():
        article = re.search(r"<article>(.*)</article>", html, re.S)[1]
        parts = (" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", article))
        assert got[page].text == "\n".join(p for p in parts if p)
        assert got[page].n_chars == len(got[page].text)


def test_generic_page():
    page = """<body><div id="cookie-banner">We use cookies. Accept all of them now, please do so.</div><header><h1>Site</h1></header><div class=sidebar><p>Popular posts of this month are here.</p></div>
    <div class="content"><h1>Story &amp; more</h1><p>First paragraph is long enough to be seen as content, with <b>bold</b>&nbsp;text and a <a href=x>link</a>.<p>Short.<aside>Related: read this other long story.</aside><ul><li>one item<li>two item</ul>
    <form><label>Name</label><button>Send</button></form><p>Last words.</div><div id=comments><p>Great article, I liked it very much, thanks to the author.</p></div><footer>Copyright</footer>"""
    assert html_extract.main_text(page).split("\n") == ["Story & more", "First paragraph is long enough to be seen as content, with bold text and a link.", "Short.", "one item", "two item", "Last words."]


def test_min_cut_is_minimal():
    import itertools
    import random

    r = random.Random(5)
    for _ in range(60):
        n = r.randint(1, 7)
        odds = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, r.uniform(0, 2)) for a in range(n) for b in range(a) if r.random() < 0.5]
        cost = lambda keep: sum(abs(x) for x, k in zip(odds, keep, strict=True) if (x > 0) != k) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: B023,E731
        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(html_extract.min_cut(odds, edges)) <= best + 0.05


def test_rules(spark, data, texts):
    for r in QUERIES["op7_quality_rules"](spark, data).collect():
        text = texts[r.doc_id] or ""
        w = WORD.findall(text)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        twice = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if twice[g] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.kept and r.base_failed)


def test_llr(spark, data, texts):
    """Counts, weights, ratios, the cut and the verdicts by plain Python."""
    import math

    from rampart.llm import ngram_lm, quality_rules

    buckets = 2**15

    def grams(text):
        w = [x.encode() for x in WORD.findall(text or "")]
        h = [xxhash.xxh64_intdigest(x, 42) for x in w]
        signed = lambda x: x - 2**64 if x >= 2**63 else x
        return [signed(x) % buckets for x in h] + [signed(xxhash.xxh64_intdigest(b, a)) % buckets + buckets for a, b in zip(h, w[1:], strict=False)]

    labels = spark.read.parquet(f"{data}/labels.parquet")
    held = {r.doc_id: r.held_out for r in ngram_lm.trusted_sample(labels, 5120).collect()}
    bad = {r.doc_id for r in ngram_lm.rejected_sample(labels, 5120).collect()}
    raw, target, of = Counter(), Counter(), {i: grams(t) for i, t in texts.items()}
    for i, g in of.items():
        raw.update(g)
        if held.get(i) is False:
            target.update(g)
    total = lambda c, k: sum(n for b, n in c.items() if b // buckets == k)
    totals = [(total(raw, k), total(target, k)) for k in (0, 1)]

    def weight(b):
        r, t = totals[b // buckets]
        p = (raw[b] + 0.5) / (r + 0.5 * buckets)
        x = math.log((target[b] + p * 0.25 * t) / (1.25 * t) / p) * ngram_lm.UNIT
        return math.floor(abs(x) + 0.5) * (1 if x > 0 else -1)

    weights = {b: weight(b) for b in raw}
    score = {i: sum(weights[b] for b in g) / ngram_lm.UNIT / len(g) if g else None for i, g in of.items()}
    cut = ngram_lm.best_cut([score[i] for i, out in held.items() if out and score.get(i) is not None], [score[i] for i in bad if score.get(i) is not None])
    for r in quality_rules.op7_quality_rules(spark, data).collect():
        assert (r.llr is None) == (score[r.doc_id] is None) and (r.llr is None or abs(r.llr - score[r.doc_id]) < 1e-9)
        assert r.kept == (not r.base_failed and score[r.doc_id] is not None and score[r.doc_id] >= cut - 1e-9)


@pytest.mark.parametrize("repeated", [1, 23, 24, 25, 60])
def test_covered_words_on_both_sides_of_few(spark, repeated):
    """Texts with few and with many different repeated windows."""
    from pyspark.sql import functions as F

    from rampart.llm.quality_rules import FEW, covered_words

    assert FEW == 24
    w = [f"w{i}" for i in range(repeated + 2)]
    text = w + [f"x{i}" for i in range(50)] + w + ["y", "y", "y", "y"]
    grams = list(zip(text, text[1:], text[2:], strict=False))
    twice = Counter(grams)
    want = len({k + j for k, g in enumerate(grams) if twice[g] > 1 for j in range(3)})
    assert spark.createDataFrame([(text,)], "w array<string>").select(covered_words(F.col("w")).alias("n")).first().n == want


def test_llr_separates_junk(spark):
    clean = [f"{i} " + " ".join(f"word{(i * 7 + k * k) % 90}" for k in range(80)) for i in range(300)]
    junk = [" ".join(f"word{(i + k) % 90}***" for k in range(80)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    from rampart.llm.quality_rules import quality_rules

    verdicts = {r.doc_id: r.kept for r in quality_rules(docs, labels).select("doc.doc_id", "quality.kept").collect()}
    assert all(verdicts[i] for i in range(300)) and not any(verdicts[i] for i in range(300, 360))
    taken = {r.doc_id: r.kept for r in quality_classifier(docs, labels).collect()}
    assert sum(taken[i] for i in range(300)) >= 298 and not any(taken[i] for i in range(300, 360))


def test_classifier_on_labels(spark, data, sql):
    got = {r.doc_id: r for r in QUERIES["op4_quality_classifier"](spark, data).collect()}
    good = [i for (i,) in sql.sql("select doc_id from labels group by 1 having min(quality) = 1 and max(toxic) = 0").fetchall() if got[i].log_ratio is not None]
    assert sum(got[i].kept for i in good) >= 0.97 * len(good)


def test_chats(spark, data, sql):
    told = {}
    for i, role, text in sql.sql("select conv_id, role, text from conversations order by conv_id, turn").fetchall():
        told.setdefault(i, []).append((role, text))
    told[-7] = [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]
    got = {r.conv_id: r for r in QUERIES["op5_chat_format"](spark, data).collect()}
    assert got.keys() == told.keys()
    for i, turns in told.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert (got[i].n_turns, got[i].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[i].loss_chars, got[i].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[i].formatted_chars == sum(len(chat_format.format_turn(r, t)[0]) for r, t in turns)


def test_hostile_turns_come_back():
    import random

    r = random.Random(0)
    bits = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<<TEXT>>", "<</ROLE>>", "\\", "<", "[", "\n", " ", "a", "]", ">", "/", "s>", "INST]"]
    for _ in range(3000):
        turns = [(r.choice(["user", "assistant", "system", "tool", "", "".join(r.choices(bits, k=2))]), "".join(r.choices(bits, k=r.randint(0, 6)))) for _ in range(3)]
        formatted = "".join(chat_format.format_turn(*t)[0] for t in turns)
        back = list(chat_format.parse(formatted))
        assert [(t.role, t.text) for t in back] == turns and not any(t.stray for t in back)


def test_bpe(spark, data, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_automaton.vocabulary("byte_bpe_50k.json"))
    for r in QUERIES["op8_bpe"](spark, data).collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_tokens(spark, data, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_automaton.vocabulary("word_bpe_49k.json"))
    start = 0
    for r in sorted(QUERIES["op9_token_files"](spark, data).collect(), key=lambda r: r.doc_id):
        ids = [*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def slow_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in (np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 4) + i + 1).tolist():
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, data, texts):
    got = sorted(QUERIES["op10_simhash_dedup"](spark, data).collect(), key=lambda r: r.doc_id)
    assert all(int(r.fingerprint, 16) == slow_fingerprint(texts[r.doc_id] or "") for r in got)
    fps = np.array([int(r.fingerprint, 16) for r in got], np.uint64)
    assert [r.component_id for r in got] == [got[i].doc_id for i in classes(fps)]


@pytest.mark.parametrize("how", [{}, {"tile": 64, "per_task": 100}])
def test_no_link_is_lost(spark, how):
    from rampart.llm.components import components

    rng = np.random.RandomState(3)
    fps = [rng.randint(0, 2**63, 400, dtype=np.int64).view(np.uint64)]
    for flips in (1, 3, 4, 5):
        f = fps[0].copy()
        for _ in range(flips):
            f ^= np.uint64(1) << rng.randint(0, 64, len(f)).astype(np.uint64)
        fps.append(f)
    fps = np.unique(np.concatenate([*fps, np.array([0, 1, 3, 7, 15, 31, 2**64 - 1], np.uint64)]))
    signed = fps.view(np.int64).tolist()
    got = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5), 4, **how), "a", "b").collect()
    roots = {r.node: r.root for r in got}
    want = {}
    for x, c in zip(signed, classes(fps), strict=True):
        want.setdefault(c, []).append(x)
    for members in want.values():
        assert {roots.get(x, x) for x in members} == {min(members)}


def test_pipeline(spark, data, texts):
    """Each stage by its operator's own decisions, in plain Python from there; the last against the library."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet")
    frames = [docs]
    for _, stage in p.STAGES:
        frames.append(stage(spark, frames[-1], data).cache())
    assert all(f.columns == docs.columns for f in frames[:-1])
    rules, classifier, dedup, mix = ([r.doc_id for r in f.collect()] for f in frames[1:5])
    kept = {r.doc_id for r in QUERIES["op7_quality_rules"](spark, data).collect() if r.kept}
    assert set(rules) == kept and set(classifier) <= kept
    judged = {r.doc_id for r in quality_classifier(frames[1], spark.read.parquet(f"{data}/labels.parquet")).collect() if r.kept}
    assert set(classifier) == judged
    order = sorted(classifier)
    prints = [simhash.fingerprint((texts[i] or "").encode()) for i in order]
    shingles = [(lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})((texts[i] or "").lower().split()) for i in order]
    of = list(range(len(order)))
    for a in range(len(order)):
        for b in range(a + 1, len(order)):
            if of[a] != of[b] and ((prints[a] ^ prints[b]).bit_count() <= 4 or len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])):
                lo, hi = sorted((of[a], of[b]))
                of = [lo if c == hi else c for c in of]
    assert sorted(dedup) == sorted({order[i] for i in of})
    words = lambda i: len(WORD.findall(texts[i] or ""))
    assert set(mix) <= set(dedup) and max(Counter(mix).values()) <= 2
    assert abs(sum(map(words, mix)) - 1.5 * sum(map(words, dedup))) < 0.05 * sum(map(words, dedup))
    t = Tokenizer.from_file(bpe_automaton.vocabulary("byte_bpe_50k.json"))
    last = p.run(spark, data).collect()
    assert Counter(r.doc_id for r in last) == Counter(mix)
    for r in last:
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
