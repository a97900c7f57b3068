"""Cross-tokenizer alignment: an index over one tokenizer's byte ranges is stabbed by the other's; what no token spans parts groups."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_automaton import byte_letters, vocabulary
from .common import stored
from .pieces import Cut, PieceIds, Split, byte_level_pieces, slices

#: A block is documents whose links are counted together: about so many bytes of text, at most about so many rows.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 20_000
#: Bytes of text that are aligned at once, and bytes of pieces that a tokenizer keeps (twice).
AT_ONCE, KEPT = 1 << 20, 32 << 20
#: Stands for a piece whose tokens don't spell it.
UNSPELT = -1
#: The sign for a space in B's vocabulary (fixed value).
MARK = "▁"


class IntervalIndex:
    """The byte ranges of tokens that lie one behind the other; where they begin and end is searched by bisection."""

    def __init__(self, sizes: np.ndarray):
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.starts = self.ends - sizes

    def overlaps(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each range the first token that it overlaps, and the one after the last."""
        return np.searchsorted(self.ends, starts, "right"), np.searchsorted(self.starts, ends, "left")

    def ends_at(self, places: np.ndarray) -> np.ndarray:
        """Whether a token ends there, so that none spans the place."""
        return self.ends[np.minimum(np.searchsorted(self.ends, places), len(self.ends) - 1)] == places


def space_pieces(texts: pa.Array, special: list[bytes]) -> Split:
    """Texts cut before each run of spaces."""
    cut = Cut.of(texts)
    if cut is None:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    space = cut.raw == 32
    begins = cut.row.copy()
    begins[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(begins)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(cut.raw)).astype(np.int32)), pa.py_buffer(cut.raw)), np.searchsorted(at, cut.ends)


class Tokens:
    """A tokenizer's ids of texts, and the bytes that each id stands for."""

    def __init__(self, split: Callable, encode: Callable[[list[str]], list[list[int]]], spelling: list[bytes]):
        self.encode, self.spelling = encode, spelling
        self.sizes = np.array([*map(len, spelling)], np.int64)
        self.pieces = PieceIds(split, self._spelt, [], KEPT)

    def _spelt(self, pieces: list[str]) -> list[bytes]:
        out = []
        for piece, ids in zip(pieces, self.encode(pieces) if pieces else [], strict=True):
            same = b"".join([self.spelling[i] for i in ids]) == piece.encode()
            out.append(np.array(ids if same else [UNSPELT], np.int32).tobytes())
        return out


def byte_tokens(spec: str) -> Tokens:
    """A byte-level tokenizer of the tokenizers library, from its JSON; special tokens' strings are plain text."""
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_str(spec), byte_letters()
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    told = json.loads(spec)
    added = {x["content"] for x in told["added_tokens"]}
    spelling = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        spelling[i] = token.encode() if token in added else bytes([letters[c] for c in token])
    return Tokens(byte_level_pieces, lambda pieces: [x.ids for x in tokenizer.encode_batch(pieces, add_special_tokens=False)], spelling)


def piece_tokens(model: bytes) -> Tokens:
    """A sentencepiece model that puts a space before each text, and whose pieces hold spaces at their beginning only.

    So no piece spans the place before a space that follows another character, and texts cut there have the
    same ids. The library adds one space itself, so it gets pieces without their first.
    """
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=model)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(MARK in x.lstrip(MARK) for x in names) or sp.encode("a") != sp.encode("a a")[:1]:
        raise ValueError("not a model whose pieces keep spaces at their beginning")
    spelling = [bytes([int(x[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else x.replace(MARK, " ").encode() for i, x in enumerate(names)]
    alone = [sp.piece_to_id(MARK)]

    def encode(pieces: list[str]) -> list[list[int]]:
        return [ids or alone for ids in sp.encode([p[1:] for p in pieces], num_threads=1)]

    return Tokens(space_pieces, encode, spelling)


class Aligner:
    """Aligns the tokens of two tokenizers over the same bytes."""

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        names = []
        for count in (len(a.spelling), len(b.spelling)):
            for last in (False, True):
                names += [f"{i}{',' if not last else '|' if len(names) < 2 * len(a.spelling) else ';'}" for i in range(count)]
        self.names = pa.array(names)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Ids and each text's end in them, by A and by B, of texts with a space before them."""
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar(""))
        return *self.a.pieces.texts(spaced), *self.b.pieces.texts(spaced)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Which texts have tokens, and their ids: not null, not empty, and joined the tokens of both spell the text with a space before it."""
        some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False).copy()
        while True:
            told = self.ids(texts.filter(pa.array(some)))
            odd = np.unique(np.concatenate([np.searchsorted(ends, np.flatnonzero(ids == UNSPELT), "right") for ids, ends in (told[:2], told[2:])]))
            if not len(odd):
                return some, told
            some[np.flatnonzero(some)[odd]] = False

    def align(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> dict:
        """Of each text that ``read`` took: n_a, n_b, n_groups, n_links, groups (memoryviews); and its different linked pairs, how often each, and their ends by text.

        A pair is A's id times 2**32 plus B's.
        """
        n = len(a_ends)
        index_a, index_b = IntervalIndex(self.a.sizes[a]), IntervalIndex(self.b.sizes[b])
        first, after = index_b.overlaps(index_a.starts, index_a.ends)
        links = after - first
        upto = np.concatenate([[0], np.cumsum(links)])
        row_a = np.repeat(np.arange(n), np.diff(np.concatenate([[0], a_ends])))
        of = np.repeat(np.arange(len(a)), links)
        met = b[first[of] + np.arange(upto[-1]) - upto[of]]
        pairs, at = np.unique((a[of].astype(np.int64) << 32) | met, return_inverse=True)
        told, times = np.unique(row_a[of] * max(1, len(pairs)) + at, return_counts=True)
        rows = told // max(1, len(pairs))
        cut_a, cut_b = index_b.ends_at(index_a.ends), index_a.ends_at(index_b.ends)
        group_a, group_b = (np.cumsum(c) - c for c in (cut_a, cut_b))
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        shown = np.empty(len(a) + len(b), np.int64)
        shown[place_a] = a + cut_or_last(group_a) * len(self.a.spelling)
        shown[place_b] = b + 2 * len(self.a.spelling) + cut_or_last(group_b) * len(self.b.spelling)
        joined = self.names.take(pa.array(shown)).cast(pa.large_string())
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[: len(shown) + 1]
        ends, raw = offsets[a_ends + b_ends], memoryview(joined.buffers()[2] or b"")
        groups = [raw[lo : hi - 1] for lo, hi in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        cuts = np.concatenate([[0], np.cumsum(cut_a)])
        by_row = lambda x: np.diff(np.concatenate([[0], x]))
        return {"n_a": by_row(a_ends), "n_b": by_row(b_ends), "n_groups": by_row(cuts[a_ends]), "n_links": by_row(upto[a_ends]), "groups": groups, "pairs": pairs[told % max(1, len(pairs))], "times": times, "pair_ends": np.searchsorted(rows, np.arange(n), "right")}


def cut_or_last(group: np.ndarray) -> np.ndarray:
    """1 for the last token of each group, else 0."""
    return np.append(group[1:] != group[:-1], True).astype(np.int64) if len(group) else np.zeros(0, np.int64)


#: Rows of documents (what their pairs are: places in their block's ``keys``, each less the one before), and rows of blocks: ``keys``, and how many documents hold each.
ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, steps array<int>, times array<int>, keys array<long>, docs array<long>"
_ALIGNED = pa.schema(
    [*((c, pa.int64()) for c in ("block", "doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("steps", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))]
)
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _lists(values: np.ndarray, ends: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, kind))


class _Block:
    """Aligned documents, until there are enough to be told with their pairs."""

    def __init__(self, block: int):
        self.block, self.bytes, self.rows, self.parts = block, 0, 0, []

    def add(self, aligner: Aligner, doc_ids: pa.Array, texts: pa.Array) -> None:
        some, ids = aligner.read(texts)
        found, some = aligner.align(*ids), np.flatnonzero(some)
        n = len(texts)
        told = {c: np.zeros(n, np.int64) for c in (*COUNTS, "_held")}
        for c in COUNTS:
            told[c][some] = found[c]
        told["_held"][some] = np.diff(np.concatenate([[0], found["pair_ends"]]))
        sha = np.full(n, "", object)
        sha[some] = [hashlib.sha256(x).hexdigest() for x in found["groups"]]
        self.parts.append((doc_ids, told, sha, found["pairs"], found["times"].astype(np.int32)))
        self.bytes, self.rows = self.bytes + texts.nbytes, self.rows + n

    def told(self) -> pa.RecordBatch:
        ids, told, sha, pairs, times = zip(*self.parts, strict=True)
        pairs, times, held = np.concatenate(pairs), np.concatenate(times), np.concatenate([t["_held"] for t in told])
        keys, at, docs = np.unique(pairs, return_inverse=True, return_counts=True)
        ends = np.cumsum(held)
        steps = np.diff(np.concatenate([[0], at]))
        begins = (ends - held)[held > 0]
        steps[begins] = at[begins]  # each document's first place is told as it is
        n = self.rows
        nothing = lambda kind, m: pa.nulls(m, kind)
        rows = [
            pa.array(np.full(n, self.block)), pa.concat_arrays(ids), *(pa.array(np.concatenate([t[c] for t in told])) for c in COUNTS), pa.array(np.concatenate(sha), pa.string()),
            _lists(steps, ends, pa.int32()), _lists(times, ends, pa.int32()), nothing(pa.list_(pa.int64()), n), nothing(pa.list_(pa.int64()), n),
        ]
        own = [pa.array([self.block]), *(nothing(f.type, 1) for f in list(_ALIGNED)[1:9]), _lists(keys, np.array([len(keys)]), pa.int64()), _lists(docs, np.array([len(keys)]), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(pair) for pair in zip(rows, own, strict=True)], schema=_ALIGNED)


#: The aligner of this worker process, which tasks use one after the other, by its tokenizers.
_KEPT: dict[tuple, Aligner] = {}


def _align(shared, key: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are shared out by tasks
        if key not in _KEPT:
            _KEPT.clear()
            spec, model = shared.value
            _KEPT[key] = Aligner(byte_tokens(spec), piece_tokens(model))
        block = _Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part in slices(batch, size=AT_ONCE):
                block.add(_KEPT[key], part.column("doc_id"), part.column("text"))
                if block.bytes >= BLOCK_BYTES or block.rows >= BLOCK_ROWS:
                    yield block.told()
                    block = _Block(block.block + 1)
        if block.rows:
            yield block.told()

    return run


def _scored(docs: pa.Table, asked: pa.Table) -> pa.Table:
    """The documents of a block with the sums over their links; ``asked`` has each of the block's keys."""
    _KEPT.clear()  # this worker may have encoded before
    asked = asked.sort_by("key")
    count, best = asked.column("count").to_numpy(), asked.column("best").to_numpy().astype(np.int64)
    docs = docs.combine_chunks()
    steps, times = (docs.column(c).combine_chunks() if docs.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("steps", "times"))
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(steps).to_numpy(zero_copy_only=False).astype(np.int64))]).astype(np.int64)
    at, often = np.cumsum(steps.flatten().to_numpy(zero_copy_only=False).astype(np.int64)), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], at])[ends[:-1]]
    at = at - np.repeat(before, np.diff(ends))
    sums = [np.concatenate([[0], np.cumsum(often * x[at])]) if len(at) else np.zeros(1, np.int64) for x in (best, count)]
    sums = [np.diff(s[ends]) if len(at) else np.zeros(docs.num_rows, np.int64) for s in sums]
    return pa.table([docs.column("doc_id"), *(docs.column(c) for c in COUNTS), pa.array(sums[0]), pa.array(sums[1]), docs.column("groups_sha256")], names=RESULT)


RESULT = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"]


def aligned(docs: DataFrame, tokenizer: str, model: str) -> DataFrame:
    """Rows of documents and of blocks, as ``ALIGNED`` has it.

    ``tokenizer`` is a JSON file of the tokenizers library, ``model`` one of sentencepiece, read by the driver
    and sent to the tasks. A task encodes each different piece of text once a worker, lays the tokens of 1 MB
    of texts along one line of bytes and aligns them together. No shuffle.
    """
    with open(tokenizer, encoding="utf-8") as f, open(model, "rb") as g:
        told = f.read(), g.read()
    shared = docs.sparkSession.sparkContext.broadcast(told)
    key = tuple(hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest() for x in told)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_align(shared, key), ALIGNED)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """key, count, best: how many documents hold each linked pair, and whether that is the highest of the pair's A id."""
    each = blocks.select(F.explode(F.arrays_zip("keys", "docs")).alias("x")).select("x.keys", "x.docs")
    counts = stored(each.groupBy(F.col("keys").alias("key")).agg(F.sum("docs").alias("count")), "pairs")
    most = counts.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("count").alias("most"))
    return counts.join(most, F.shiftright("key", 32) == F.col("a")).select("key", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, tokenizer: str, model: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    docs: doc_id, text. Pairs are counted by block first (about 8 MB of text), so that a pair in every
    document comes once a block to the sum, and once a block back to its documents: neither documents nor
    links are joined with the counts. Null and empty texts, and those that their tokens don't spell, have
    zeros and an empty digest; null ids are documents like any other; repeated rows each count as a document;
    very long texts are aligned whole, in a slice of their own; further columns, whatever their names, are
    ignored; an empty table gives an empty result.
    """
    told = stored(aligned(docs, tokenizer, model), "aligned")
    blocks = told.where("keys is not null").select("block", "keys", "docs")
    counts = stored(pair_counts(blocks), "counts")
    asked = blocks.select(F.col("block").alias("of"), F.explode("keys").alias("key")).join(counts, "key")
    rows = told.where("keys is null").select("block", "doc_id", *COUNTS, "groups_sha256", "steps", "times")
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(asked.groupBy("of")).applyInArrow(_scored, kinds)


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    """Alignment figures of every document between the byte-level and the sentencepiece vocabulary."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return alignment(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
