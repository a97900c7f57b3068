"""BPE encoding and decoding by a tokenization automaton built from the merges, gadget by gadget."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .pieces import PieceIds, byte_level_pieces, slices

#: White space of the byte-level pre-splitter: Unicode's White_Space property.
SPACE = "\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The published pre-splitting pattern of byte-level BPE (fixed value), with \s spelled out.
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pieces beyond ASCII that were cut by their bytes (``pieces.byte_level_pieces``); others may hold several.
PLAIN = regex.compile(r" ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}\x00-\x1f]+)")
#: Words up to so many bytes are encoded together, at most so many at once; a longer one goes alone.
SHORT, TOGETHER = 48, 1 << 14
#: Answers of the automaton that a worker keeps (a prime number).
KEPT_ARCS = 1_000_003
#: Bytes of text that are encoded at once, and bytes of pieces that a worker keeps (twice).
AT_ONCE, KEPT = 1 << 20, 32 << 20
#: Places of the table of moves, a power of two; at most a quarter of them is taken.
PLACES = 1 << 19


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Deterministic automaton over tokens that accepts just the tokenizations that BPE produces.

    It starts as one state with a loop for every byte token, which accepts everything. The merge of u and
    v adds a gadget: let u lead to state p. A copy of p without the arc v becomes where u leads (u is no
    longer followed by v), and every state with an arc u gets an arc uv to where v led from p.

    So all arcs with one token t lead to one state, which is named t here, and the copies that gadgets make
    of it differ only in the arcs they lack. They are stored as one row of a table: ``lacks[u, v]`` is the
    number of the gadget that took the arc v away. Where uv led is the row of v as it was at that gadget, so
    what uv's row does not tell is read off v's earlier part (``right``, ``made``), and a state has an arc
    made later just if it has that for the token's left part (``left``), as ``has`` reads.

    All states accept, and a text has exactly one accepted tokenization. So for every prefix of a word there
    is exactly one path, and one state that it leads to: encoding goes over the word's positions from left
    to right, extends each position's state by the arcs whose labels stand there, and never goes back.
    Decoding emits the labels of the arcs.
    """

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.labels, self.special = labels, special
        n = len(labels)
        self.left, self.right, self.made = [-1] * n, [-1] * n, [-1] * n
        self.lacks: dict[tuple[int, int], int] = {}
        merged = {t for *_, t in merges}
        if len(merged) < len(merges):
            raise ValueError("a token that two merges make")
        self.known = [t not in merged and t not in special.values() for t in range(n)]
        for k, (u, v, t) in enumerate(merges):
            if self.known[u] and self.known[v] and self.has(u, v):  # else no path takes u, v, and the merge never applies
                self.left[t], self.right[t], self.made[t], self.known[t] = u, v, k, True
                self.lacks[u, v] = k
        self._ready()

    def _ready(self) -> None:
        ids = {x: t for t, x in enumerate(self.labels) if self.known[t]}
        #: Every prefix of a label: its token, or -1.
        self.table = dict.fromkeys((x[:i] for x in ids for i in range(len(x))), -1) | ids
        #: The same as a table of moves by byte, from each prefix that goes on (they come first) to the longer one, in places by hash.
        goes_on = dict.fromkeys([b"", *(x[:-1] for x in self.table if x)])
        self.inner = len(goes_on)
        number = {x: k for k, x in enumerate([*goes_on, *(x for x in self.table if x not in goes_on)])}
        of = [x for x in number if x]
        self._set_moves(np.array([number[x[:-1]] * 256 + x[-1] for x in of], np.int64), np.array([number[x] for x in of], np.int32))
        self.token = np.array([self.table[x] for x in number], np.int32)
        self.sizes = np.array([len(x) for x in self.labels], np.int32)
        # The gadgets as arrays, the table of lacking arcs sorted by u, v.
        self.arrays = tuple(np.array(x, np.int64) for x in (self.left, self.right, self.made))
        gone = np.array([(u * len(self.labels) + v, k) for (u, v), k in self.lacks.items()] or [(-1, -1)], np.int64)
        gone = gone[np.argsort(gone[:, 0])]
        self.gone, self.when = np.ascontiguousarray(gone[:, 0]), np.ascontiguousarray(gone[:, 1])
        #: Answers of ``has`` for pairs asked before: the pair in its place by a hash, or another one.
        self.asked, self.answer = np.full(KEPT_ARCS, -1, np.int64), np.zeros(KEPT_ARCS, bool)
        self.stop = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.piece = regex.compile(PIECE)
        self.emit = pa.array(self.labels, pa.binary())

    def _set_moves(self, keys: np.ndarray, to: np.ndarray) -> None:
        places = PLACES
        while places < 4 * len(keys):
            places *= 2
        self.move_keys, self.move_to = np.full(places, -1, np.int64), np.full(places, -1, np.int32)
        at = self._place(keys)
        while len(keys):
            free = self.move_keys[at] < 0
            self.move_keys[at[free]] = keys[free]
            mine = self.move_keys[at] == keys
            self.move_to[at[mine]] = to[mine]
            keys, to, at = keys[~mine], to[~mine], (at[~mine] + 1) % places

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * -7046029254386353131 >> 24) % len(self.move_keys)

    def moved(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The prefix that the byte makes of each prefix, or -1."""
        keys = node.astype(np.int64) * 256 + byte
        at = self._place(keys)
        held = self.move_keys[at]
        found = np.where(held == keys, self.move_to[at], -1)
        more = np.flatnonzero((held != keys) & (held >= 0))
        at = at[more]
        while len(more):
            at = (at + 1) % len(self.move_keys)
            held = self.move_keys[at]
            hit = held == keys[more]
            found[more[hit]] = self.move_to[at[hit]]
            go = ~hit & (held >= 0)
            more, at = more[go], at[go]
        return found

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("labels", "special", "left", "right", "made", "lacks", "known")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._ready()

    @classmethod
    def load(cls, path: str) -> Automaton:
        """From the JSON file of a byte-level BPE tokenizer."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        labels = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, t in vocab.items():
            labels[t] = bytes(letters[c] for c in token)
        for token, t in special.items():
            labels[t] = token.encode()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        return cls(labels, [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs], special)

    def has(self, state: int, token: int) -> bool:
        """Whether the state that ``state`` leads to (-1: the first one) has the arc ``token``.

        Rows and left parts are gone through from the latest gadget to the first.
        """
        upto = since = len(self.labels)
        while state >= 0:
            k = self.lacks.get((state, token))
            if k is not None and k < upto and k <= since:
                return False
            a, b = self.made[state], self.made[token]
            if a < 0 and b < 0:
                break
            if a >= b:
                upto, state = a, self.right[state]
            if b >= a:
                since, token = b, self.left[token]
        return True

    def has_each(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``has`` of many pairs; answers are kept in a table of fixed size."""
        pair = state.astype(np.int64) * len(self.labels) + token
        place = (pair * -7046029254386353131 >> 20) % KEPT_ARCS
        found = self.answer[place]
        new = np.flatnonzero((self.asked[place] != pair) | (state < 0))
        if len(new):
            found[new] = self._has_each(state[new].astype(np.int64), token[new].astype(np.int64))
            new = new[state[new] >= 0]
            self.asked[place[new]], self.answer[place[new]] = pair[new], found[new]
        return found

    def _has_each(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        left, right, made = self.arrays
        found = np.ones(len(state), bool)
        at = np.flatnonzero(state >= 0)
        state, token = state[at], token[at]
        upto = np.full(len(at), len(self.labels))
        since = upto
        while len(at):
            pair = state * len(self.labels) + token
            k = np.minimum(np.searchsorted(self.gone, pair), len(self.gone) - 1)
            when = self.when[k]
            lacking = (self.gone[k] == pair) & (when < upto) & (when <= since)
            found[at[lacking]] = False
            a, b = made[state], made[token]
            more = np.flatnonzero(~lacking & ((a >= 0) | (b >= 0)))
            at, state, token, upto, since, a, b = at[more], state[more], token[more], upto[more], since[more], a[more], b[more]
            by_state, by_token = a >= b, b >= a
            upto, since = np.where(by_state, a, upto), np.where(by_token, b, since)
            state, token = np.where(by_state, right[state], state), np.where(by_token, left[token], token)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word: the arcs of its only accepted path.

        ``last[i]`` is the last arc of the only path for the word's first i bytes. The time grows with the
        word's length times the longest label.
        """
        table, n = self.table, len(word)
        last = [-1] * (n + 1)
        for at in range(n):
            state = last[at]
            for end in range(at + 1, n + 1):
                token = table.get(word[at:end])
                if token is None:
                    break
                if token >= 0 and last[end] < 0 and self.has(state, token):
                    last[end] = token
        path, at = [], n
        while at:
            path.append(last[at])
            at -= len(self.labels[last[at]])
        return path[::-1]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of many words, as the bytes of 32-bit integers: ``encode_word`` of all of them, position by position."""
        out: list[bytes] = [b""] * len(words)
        together = [k for k, w in enumerate(words) if 0 < len(w) <= SHORT]
        for lo in range(0, len(together), TOGETHER):
            part = together[lo : lo + TOGETHER]
            for k, ids in zip(part, self._encode_short([words[k] for k in part]), strict=True):
                out[k] = ids
        for k, w in enumerate(words):
            if len(w) > SHORT:
                out[k] = np.array(self.encode_word(w), np.int32).tobytes()
        return out

    def _encode_short(self, words: list[bytes]) -> list[bytes]:
        raw = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        # Longest first, so that those that still go on are the first ones. A word's paths are numbered from first on.
        order = np.argsort(-sizes, kind="stable")
        sizes, starts = sizes[order], (np.cumsum(sizes) - sizes)[order]
        firsts = starts + order  # one more place a word than it has bytes
        last = np.full(len(raw) + len(words), -1, np.int32)
        for at in range(int(sizes[0])):
            now = int(np.searchsorted(-sizes, -at))  # words longer than at
            begin, place, end = starts[:now] + at, firsts[:now] + at, starts[:now] + sizes[:now]
            state = last[place]
            node, far = np.zeros(now, np.int32), 0
            while len(node):
                node = self.moved(node, raw[begin + far])
                far += 1
                alive = np.flatnonzero(node >= 0)
                node, begin, place, end, state = node[alive], begin[alive], place[alive], end[alive], state[alive]
                token = self.token[node]
                asked = np.flatnonzero((token >= 0) & (last[place + far] < 0))
                asked = asked[self.has_each(state[asked], token[asked])]
                last[place[asked] + far] = token[asked]
                more = np.flatnonzero((node < self.inner) & (begin + far < end))
                node, begin, place, end, state = node[more], begin[more], place[more], end[more], state[more]
        # From the words' ends back: the arcs of the only path.
        at, kept, counts, paths = sizes.copy(), np.arange(len(words)), np.zeros(len(words), np.int64), []
        while len(kept):
            token = last[firsts[kept] + at[kept]]
            paths.append((kept, token))
            counts[kept] += 1
            at[kept] -= self.sizes[token]
            kept = kept[at[kept] > 0]
        upto = np.cumsum(counts)
        ids = np.empty(int(upto[-1]), np.int32)
        for k, (kept, token) in enumerate(paths):
            ids[upto[kept] - 1 - k] = token
        found, told = [b""] * len(words), ids.tobytes()
        for k, a, b in zip(order.tolist(), ((upto - counts) * 4).tolist(), (upto * 4).tolist(), strict=True):
            found[k] = told[a:b]
        return found

    def encode_text(self, text: str) -> list[int]:
        """Token ids of a text without special tokens, pre-split as a whole."""
        return [t for piece in self.piece.findall(text) for t in self.encode_word(piece.encode())]

    def encode(self, text: str) -> list[int]:
        """Token ids of a text, special tokens by their ids."""
        if not any(x in text for x in self.special):
            return self.encode_text(text)
        out, at = [], 0
        for m in self.stop.finditer(text):
            out += self.encode_text(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.encode_text(text[at:])

    def decode(self, ids) -> bytes:
        """The labels of the arcs, in order."""
        return b"".join(map(self.labels.__getitem__, ids))

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts whose ids stand one after the other and end at ``ends``, by the labels of their arcs."""
        told = self.emit.take(pa.array(ids))
        bounds = np.frombuffer(told.buffers()[1], np.int32)[: len(ids) + 1][np.concatenate([[0], ends])].copy()
        whole = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds), told.buffers()[2]])
        try:
            return whole.cast(pa.string())
        except pa.ArrowInvalid:  # ids that cut characters apart
            return pa.array([x.as_py().decode("utf-8", "replace") for x in whole], pa.string())


class Encoder:
    """Encodes texts; keeps the ids of pieces it has seen."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.pieces = PieceIds(byte_level_pieces, self._encode, list(automaton.special), KEPT)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        stop = self.automaton.stop
        plain = [k for k, p in enumerate(pieces) if (p.isascii() or PLAIN.fullmatch(p)) and not (stop and stop.search(p))]
        out: list[bytes | None] = [None] * len(pieces)
        for k, ids in zip(plain, self.automaton.encode_words([pieces[k].encode() for k in plain]), strict=True):
            out[k] = ids
        return [np.array(self.automaton.encode(p), np.int32).tobytes() if ids is None else ids for p, ids in zip(pieces, out, strict=True)]

    def encode(self, text: str) -> list[int]:
        return self.pieces.texts(pa.array([text], pa.string()))[0].tolist()


#: The encoder of this worker process, which tasks use one after the other, by its vocabulary.
_KEPT: dict[int, Encoder] = {}


def forget() -> None:
    """Drops the encoder that an earlier task has left in this worker."""
    _KEPT.clear()
    tidy()


def _round_trip(shared, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = Encoder(shared.value)
        encoder = _KEPT[key]
        for batch in batches:
            for part in slices(batch, size=AT_ONCE):
                ids, ends = encoder.pieces.texts(part.column("text"))
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                decoded = encoder.automaton.decode_all(ids, ends)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids)), decoded], ["doc_id", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text decoded from them, for every document.

    docs: doc_id, text; ``path`` is the tokenizer's JSON file, read by the driver only: the compiled
    automaton (a few MB, fixed by the vocabulary) is broadcast. Null and empty texts have no ids;
    repeated rows are encoded alike; very long texts are encoded whole, in slices of their own; null ids pass
    through; further columns, whatever their names, are ignored; an empty table gives an empty result. No shuffle.
    """
    automaton = Automaton.load(path)
    key = zlib.crc32(repr((automaton.labels, automaton.made, automaton.special)).encode())
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return told.mapInArrow(_round_trip(shared, key), "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and decoded text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encode_decode(docs, vocabulary("byte_bpe_50k.json")))
