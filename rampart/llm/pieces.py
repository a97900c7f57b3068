"""Texts cut into the pieces of a tokenizer's pre-splitter by array operations on bytes; each different piece is encoded once.

Letters, digits and marks of ASCII and Latin-1 and the general punctuation are classified by tables. What
holds any other character is not cut here but left whole, as an odd piece, to the encoder's own splitter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE = 4 << 20
#: Longer pieces are not kept; what is kept takes about two times so many bytes.
LONGEST, KEPT_BYTES, ENTRY = 200, 48 << 20, 190

SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
_ASCII = np.full(256, ODD, np.uint8)
_ASCII[:128] = OTHER
_ASCII[[9, 10, 11, 12, 13, 32]] = SPACE
_ASCII[48:58] = DIGIT
_ASCII[65:91] = _ASCII[97:123] = LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Classes of U+0080 to U+00BF by their second byte: signs, but for three letters, six numbers, and controls and a space.
_C2 = np.full(256, OTHER, np.uint8)
_C2[0x80:0xA1] = ODD
_C2[[0xAA, 0xB5, 0xBA]] = LETTER
_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = DIGIT
#: White space beyond ASCII, in UTF-8.
FAR_SPACES = [c.encode() for c in "\x85\xa0                　"]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``size`` bytes of text, one row at least."""
    texts = batch.column(column)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Cut:
    """The bytes of texts, their classes, and where texts and pieces begin."""

    raw: np.ndarray
    #: Where each text ends.
    ends: np.ndarray
    kind: np.ndarray
    #: Whether a text begins at a byte, and whether a piece does.
    row: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Cut | None:
        n = len(texts)
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32)
        lo, hi = int(ends[0]), int(ends[-1])
        if lo == hi:
            return None
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi]
        row = np.zeros(hi - lo + 1, bool)
        row[ends - lo] = True
        return cls(raw, ends[1:] - lo, _kinds(raw), row[:-1], np.zeros(hi - lo, bool))

    def at(self, tokens: list[bytes]) -> np.ndarray:
        """Where any of these byte strings begins."""
        found = [np.zeros(0, np.int64)]
        for t in tokens:
            here = np.flatnonzero(self.raw[: len(self.raw) - len(t) + 1] == t[0])
            for k in range(1, len(t)):
                here = here[self.raw[here + k] == t[k]]
            found.append(here)
        return np.concatenate(found)

    def odd_words(self, at: np.ndarray) -> None:
        """Makes words that hold these places odd as a whole, and those that hold odd characters."""
        at = np.concatenate([at, np.flatnonzero(self.kind == ODD)])
        if not len(at):
            return
        space = self.kind == SPACE
        begins = ~space & (self.row | np.concatenate([[True], space[:-1]]))
        number = np.cumsum(begins, dtype=np.int32)
        odd = np.zeros(int(number[-1]) + 1, bool)
        odd[number[at]] = True
        self.kind[odd[number] & ~space] = ODD

    def changes(self) -> None:
        """Pieces begin where texts do and where the class changes."""
        self.start[:] = self.row
        self.start[1:] |= self.kind[1:] != self.kind[:-1]

    def contractions(self) -> None:
        """'s 't 're 've 'm 'll 'd, where a piece begins with the apostrophe, are pieces."""
        raw, n = self.raw, len(self.raw)
        marks = np.flatnonzero(raw == 39)
        for i in marks[self.start[marks] & (self.kind[marks] == OTHER)].tolist():
            tail = raw[i + 1 : i + 3].tobytes()
            if not tail or self.row[i + 1]:
                continue
            if tail[0] in b"stmd":
                size = 2
            elif tail in (b"re", b"ve", b"ll") and not self.row[i + 2]:
                size = 3
            else:
                continue
            self.start[i + 1 : i + size] = False
            if i + size < n:
                self.start[i + size] = True


def _kinds(raw: np.ndarray) -> np.ndarray:
    kind = np.take(_ASCII, raw)
    two = np.flatnonzero(raw == 0xC3)
    if len(two):
        second = raw[two + 1]
        kind[two] = kind[two + 1] = np.where((second == 0x97) | (second == 0xB7), OTHER, LETTER)
    two = np.flatnonzero(raw == 0xC2)
    if len(two):
        kind[two] = kind[two + 1] = _C2[raw[two + 1]]
    three = np.flatnonzero(raw == 0xE2)
    if len(three):  # U+2010 to U+2027
        three = three[(raw[three + 1] == 0x80) & (raw[three + 2] >= 0x90) & (raw[three + 2] <= 0xA7)]
        kind[three] = kind[three + 1] = kind[three + 2] = OTHER
    return kind


def lowered(raw: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The bytes with the letters of classified characters in lower case."""
    low = np.take(_LOWER, raw)
    odd = np.flatnonzero(kind == ODD)
    low[odd] = raw[odd]
    two = np.flatnonzero(raw == 0xC3)
    if len(two):
        second = raw[two + 1]
        two = two[(second >= 0x80) & (second <= 0x9E) & (second != 0x97) & (kind[two] != ODD)]
        low[two + 1] += 32
    return low


#: The pieces of texts, and where each text's end in them.
Split = tuple[pa.Array, np.ndarray]


def word_pieces(texts: pa.Array, special: list[bytes]) -> Split:
    """Runs of letters, single digits and runs of other signs in lower case, without white space; odd words as they are."""
    cut = Cut.of(texts)
    if cut is None:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    cut.odd_words(cut.at(special))
    cut.changes()
    digits = np.flatnonzero(cut.kind == DIGIT)
    cut.start[digits[cut.raw[digits] & 0xC0 != 0x80]] = True
    low = lowered(cut.raw, cut.kind)
    cut.raw = low
    cut.contractions()
    keep = cut.kind != SPACE
    at = np.flatnonzero(cut.start & keep)
    upto = np.cumsum(keep, dtype=np.int32)
    offsets = np.append(upto[at] - 1, upto[-1]).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(low[keep])), np.searchsorted(at, cut.ends)


def byte_level_pieces(texts: pa.Array, special: list[bytes]) -> Split:
    """Runs of letters, digits or other signs with one space before them, and what white space is left.

    Of white space before a word the last character stands alone, or with the word if it is a space. Texts
    with a special token or white space beyond ASCII are one odd piece.
    """
    cut = Cut.of(texts)
    if cut is None:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    cut.odd_words(np.zeros(0, np.int64))
    cut.changes()
    space = cut.kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~cut.row[1:])
    cut.start[last] = True
    cut.start[last + 1] = cut.raw[last] != 32
    cut.contractions()
    whole = np.unique(np.searchsorted(cut.ends, cut.at([*special, *FAR_SPACES]), "right"))
    for k in whole.tolist():
        first = int(cut.ends[k - 1]) if k else 0
        cut.start[first + 1 : cut.ends[k]] = False
    at = np.flatnonzero(cut.start)
    offsets = np.append(at, len(cut.raw)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(cut.raw)), np.searchsorted(at, cut.ends)


class PieceIds:
    """Keeps the ids of pieces seen, as the bytes of 32-bit integers, in two generations.

    When the younger one is full, it becomes the older one and what that held is forgotten, so memory is
    bounded by bytes whatever the texts hold, and pieces that come often stay.
    """

    def __init__(self, split: Callable[[pa.Array, list[bytes]], Split], encode: Callable[[list[str]], list[bytes]], special: list[str], kept: int | None = None):
        self.split, self.encode, self.most = split, encode, kept or KEPT_BYTES
        self.special = [x.encode() for x in special]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.room = self.most

    def _keep(self, piece: str, ids: bytes) -> None:
        if len(piece) <= LONGEST:
            self.young[piece] = ids
            self.room -= ENTRY + len(piece) + len(ids)
            if self.room < 0:
                self.young, self.old, self.room = {}, self.young, self.most

    def of(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces."""
        found = list(map(self.young.get, pieces))
        new = []
        for k in [k for k, ids in enumerate(found) if ids is None]:
            ids = found[k] = self.old.get(pieces[k])
            if ids is None:
                new.append(k)
            else:
                self._keep(pieces[k], ids)
        for k, ids in zip(new, self.encode([pieces[k] for k in new]), strict=True):
            found[k] = ids
            self._keep(pieces[k], ids)
        return found

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's end; null is empty, empty has none."""
        pieces, ends = self.split(texts.fill_null("") if texts.null_count else texts, self.special)
        if not len(pieces):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        coded = pieces.dictionary_encode()
        known = pa.array(self.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary())
        found = known.take(coded.indices)
        upto = np.frombuffer(found.buffers()[1], np.int32)[: len(found) + 1] // 4
        ids = np.frombuffer(found.buffers()[2], np.int32)[: upto[-1]] if upto[-1] else np.zeros(0, np.int32)
        return ids, upto[ends].astype(np.int64)
