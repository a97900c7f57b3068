"""Alignment of two vocabularies against the libraries and a comparison of all token pairs of a text."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rampart.llm import alignment
from rampart.llm.alignment import Aligner, byte_tokens, piece_tokens
from rampart.llm.bpe_automaton import byte_letters, vocabulary

NAMES = "byte_bpe_50k.json", "piece_bpe_32k.model"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary(NAMES[0]))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=vocabulary(NAMES[1]))


def ranges(libraries, text):
    """(id, start, end) of both vocabularies' tokens, or None."""
    a, b = libraries
    letters = byte_letters()
    one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = [(i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in zip(b.encode(text), b.encode(text, out_type=str))]
    if any(b"".join(s for _, s in x) != (" " + text).encode() for x in (one, two)):
        return None
    out = []
    for x in (one, two):
        at, told = 0, []
        for i, s in x:
            told.append((i, at, at + len(s)))
            at += len(s)
        out.append(told)
    return out


def by_hand(libraries, rows):
    told, docs = [], Counter()
    for doc_id, text in rows:
        both = ranges(libraries, text) if text else None
        links = []
        if both:
            k = 0
            for i, s, e in both[0]:
                while both[1][k][2] <= s:
                    k += 1
                n = k
                while n < len(both[1]) and both[1][n][1] < e:
                    links.append((i, both[1][n][0]))
                    n += 1
            docs.update(set(links))
        told.append((doc_id, both, links))
    best = {}
    for (a, _), n in docs.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for doc_id, both, links in told:
        if not both:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b = both
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, at = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in x if at <= s and e <= end) for x in (a, b)) if len(ends) < 400 else None)
            at = end
        if None in groups:  # the same in one pass, for long texts
            groups, k, n = [], 0, 0
            for end in ends:
                u, v = [], []
                while k < len(a) and a[k][2] <= end:
                    u.append(str(a[k][0]))
                    k += 1
                while n < len(b) and b[n][2] <= end:
                    v.append(str(b[n][0]))
                    n += 1
                groups.append(",".join(u) + "|" + ",".join(v))
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc_id, len(a), len(b), len(ends), len(links), sum(docs[x] == best[x[0]] for x in links), sum(docs[x] for x in links), sha))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in df.collect()), key=str)


def run(spark, docs):
    return alignment.alignment(docs, vocabulary(NAMES[0]), vocabulary(NAMES[1]))


def test_query(spark, data, libraries):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert got(alignment.op12_alignment(spark, data)) == by_hand(libraries, rows)


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b   c", "\n", "\n\n x\t y \r\n", "a▁b", "▁", "<s> </s> <unk> <0x0A>", "<|endoftext|> x", "x\x00y", "caf́e ﬁ 　x", "😀😀 👩‍👩‍👧 é", "don't we'll 'sup !!'s", "１２３ ³¼", "​﻿", "word " * 30_000, "ab" * 40_000, "it is the same", "it is the same"]


def test_odd_texts(spark, libraries):
    rows = [(None if k == 5 else k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(3)).withColumn("keys", F.lit("x"))
    assert got(run(spark, docs)) == by_hand(libraries, rows)
    assert got(run(spark, docs.repartition(7))) == by_hand(libraries, rows)
    assert run(spark, docs.limit(0)).count() == 0
    assert got(run(spark, docs.where("text is null"))) == [(0, 0, 0, 0, 0, 0, 0, "")]


def test_small_blocks(spark, libraries, monkeypatch):
    """Counts go over blocks: with a block for every few rows they are the same."""
    monkeypatch.setattr(alignment, "BLOCK_ROWS", 3)
    monkeypatch.setattr(alignment, "_KEPT", {})
    words = ["the", "of", "tion", "zwischen", "été", "x1"]
    r = random.Random(5)
    rows = [(k, " ".join(r.choices(words, k=r.randrange(12)))) for k in range(60)]
    aligner = Aligner(byte_tokens(open(vocabulary(NAMES[0]), encoding="utf-8").read()), piece_tokens(open(vocabulary(NAMES[1]), "rb").read()))
    blocks = []
    for lo in range(0, 60, 7):
        block = alignment._Block(lo)
        block.add(aligner, pa.array([i for i, _ in rows[lo : lo + 7]]), pa.array([t for _, t in rows[lo : lo + 7]]))
        blocks.append(block.told())
    told = pa.Table.from_batches(blocks)
    counts = Counter()
    for keys, docs in zip(told.column("keys").to_pylist(), told.column("docs").to_pylist()):
        counts.update(dict(zip(keys or [], docs or [])))
    expected = Counter()
    for _, t in rows:
        both = ranges(libraries, t) if t else None
        if both:
            expected.update({(x[0] << 32) | y[0] for x in both[0] for y in both[1] if x[1] < y[2] and y[1] < x[2]})
    assert counts == expected
    assert got(run(spark, spark.createDataFrame(rows, "doc_id long, text string"))) == by_hand(libraries, rows)


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        piece_tokens(_with_inner_space())


def _with_inner_space() -> bytes:
    """The model with a piece that goes over a space."""
    raw = open(vocabulary(NAMES[1]), "rb").read()
    old, new = "▁when".encode(), "wh▁en".encode()
    return raw.replace(b"\n" + bytes([len(old)]) + old, b"\n" + bytes([len(new)]) + new, 1)
