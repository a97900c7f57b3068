"""Pieces, the automaton and the word encoder against the tokenizers library, in batches with odd texts."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rampart.llm import pieces
from rampart.llm.bpe_automaton import Automaton, Encoder, vocabulary
from rampart.llm.token_files import WordEncoder

ODD = ["a<|endoftext|>b  c\n\n d", "  lead", "trail  ", "\t\ttabs\t x", " " * 50 + "x", "a" * 3000, "\x1c\x1d x\x85y", "it's we'll 'S", "é" * 999, "<|endoftext|>", "\r\n\r\nabc\r\n", "x　y  z", "", None, " ", "\n\n\n", "'s", " 's", "x's'll", "..'re", "a'", "²³ ½1", "ªº", "«É»", "“quoted” — dash…", "= ̸ é"]
CHARACTERS = [*"abcXYZ  \n\t.,'’ßéÉíñ123²½ªµ\xa0\x85　Σςσİı̈́<>|`~\x00\x7f\x1c\x1f中文字😀👍🏽ǅﬁ®¯×÷\xad\r-_", "<|endoftext|>", "<|startoftext|>", "<|", "'s", "'LL", "'ve", " ' s", "'re", "  ", "\n\n", "\t ", "don't"]


def odd_texts(n, labels=()):
    r = random.Random(7)
    made = ["".join(r.choices(CHARACTERS, k=r.randint(0, 30))) for _ in range(n)]
    made += ["".join(map(chr, r.choices([*range(0x3000), *range(0x1F000, 0x1FA00)], k=6))) for _ in range(n // 4)]
    if labels:
        made += [b"".join(r.choices(labels, k=r.randint(1, 5))).decode("utf-8", "ignore") for _ in range(n // 4)]
    return [*ODD, *made]


def parted(ids, ends):
    return [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


def test_byte_level():
    path = vocabulary("byte_bpe_50k.json")
    automaton, library = Automaton.load(path), Tokenizer.from_file(path)
    encoder, texts = Encoder(automaton), odd_texts(12_000, automaton.labels)
    ids, ends = encoder.pieces.texts(pa.array(texts))
    decoded = automaton.decode_all(ids, ends).to_pylist()
    for text, found, back in zip(texts, parted(ids, ends), decoded, strict=True):
        assert found == library.encode(text or "", add_special_tokens=False).ids, text
        assert back == (text or "")
    cut = np.array([len(ids) // 3, len(ids) // 2, len(ids)])  # ids that cut characters apart
    assert automaton.decode_all(ids, cut).to_pylist()[1] == library.decode(ids[cut[0] : cut[1]].tolist(), skip_special_tokens=False)


def test_words_together_and_alone_and_by_hand():
    automaton = Automaton.load(vocabulary("byte_bpe_50k.json"))
    r = random.Random(2)
    words = [b"".join(r.choices(automaton.labels[:3000], k=r.randint(1, 12))) for _ in range(3000)] + [b"", b"a" * 500, b"\xff\xfe"]
    for word, ids in zip(words, automaton.encode_words(words), strict=True):
        path = automaton.encode_word(word)
        assert np.frombuffer(ids, np.int32).tolist() == path and automaton.decode(path) == word
        # Every arc of the path is there, one after the other.
        assert all(automaton.has(u, t) for u, t in zip([-1, *path], path, strict=False))
    pairs = np.array([(r.randrange(50_000), r.randrange(50_000)) for _ in range(5000)])
    assert automaton.has_each(pairs[:, 0], pairs[:, 1]).tolist() == [automaton.has(int(u), int(t)) for u, t in pairs]


def test_every_word_of_a_small_automaton_has_one_path():
    """All tokenizations of all short words: just one is accepted, the one that merging in order gives."""
    labels = [b"a", b"b", b"ab", b"aa", b"aab", b"ba"]
    merges = [(0, 1, 2), (0, 0, 3), (0, 2, 4), (1, 0, 5)]
    automaton = Automaton(labels, merges, {})
    for n in range(1, 9):
        for word in map(bytes, itertools.product(b"ab", repeat=n)):
            path = [labels.index(bytes([c])) for c in word]
            while True:  # the merge of least rank, leftmost first
                ranked = [(k, i) for i in range(len(path) - 1) for k, (u, v, _) in enumerate(merges) if (u, v) == (path[i], path[i + 1])]
                if not ranked:
                    break
                k = min(ranked)[0]
                i = 0
                while i < len(path) - 1:
                    if (path[i], path[i + 1]) == merges[k][:2]:
                        path[i : i + 2] = [merges[k][2]]
                    i += 1
            assert automaton.encode_word(word) == path
            assert np.frombuffer(automaton.encode_words([word])[0], np.int32).tolist() == path


def test_a_token_that_two_merges_make():
    with pytest.raises(ValueError):
        Automaton([b"a", b"aa", b"aaa"], [(0, 0, 1), (0, 1, 2), (1, 0, 2)], {})


def test_word_ends():
    path = vocabulary("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        encoder = WordEncoder(f.read())
    library, texts = Tokenizer.from_file(path), odd_texts(12_000)
    for _ in range(2):  # the second time from what is kept
        ids, ends = encoder.pieces.texts(pa.array(texts))
        for text, found in zip(texts, parted(ids, ends), strict=True):
            assert found == library.encode(text or "", add_special_tokens=False).ids, text


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_BYTES", 20_000)
    kept = pieces.PieceIds(pieces.byte_level_pieces, lambda new: [np.array([len(p)], np.int32).tobytes() for p in new], [])
    for k in range(50):
        texts = pa.array([" ".join("w" + chr(97 + i // 676) + chr(97 + i // 26 % 26) + chr(97 + i % 26) for i in range(k * 50, k * 50 + 60)), "long " + "x" * 500])
        ids, ends = kept.texts(texts)
        assert ids.tolist() == [len(p) for t in texts.to_pylist() for p in (f" {w}" if j else w for j, w in enumerate(t.split(" ")))] and ends.tolist() == [60, 62]
    assert len(kept.young) + len(kept.old) <= 2 * 20_000 // pieces.ENTRY + 2 and not any(len(p) > pieces.LONGEST for p in kept.young)


def test_slices_cover_a_batch(monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 10)
    for texts in ([], [None], ["a" * 30], ["a", "b" * 9, None, "c" * 11, "", "d"]):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        got = list(pieces.slices(batch))
        assert [t for g in got for t in g.column("text").to_pylist()] == texts
