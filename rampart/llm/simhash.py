"""SimHash near-dedup: tiled exact comparison by exclusive-or and bit counts, tile pairs skipped by population count."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Most fingerprints of a tile; rows of a block inside it; salts of a tile are numbered below SALTS.
TILE, BLOCK, SALTS = 65536, 256, 1 << 16
#: A cell is the pair of population counts of a fingerprint's halves: 33 * high + low.
CELLS = 33 * 33


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of the words' 4-word shingles, repeats included, letters A-Z in lower case; no word: 0."""
    tokens = text.lower().split()  # on bytes: A-Z only, and just space and the controls 9 to 13
    n = len(tokens)
    if not n:
        return 0
    joined = b" ".join(tokens)
    if n < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, tokens), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = (fingerprint(t or b"") for t in (x.as_py() for x in batch.column("text").cast(pa.binary())))
        fp = np.fromiter(found, np.uint64, batch.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fp)], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (of the exact text), fp (the fingerprint's bits as a long) of every document."""
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return told.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


class Layout:
    """Which tiles there are and who compares what, from the counts of the cells (at most CELLS numbers).

    A cell of more than TILE fingerprints is cut into sub-tiles by hash. A pair of tiles is compared if
    their cells' counts differ by no more than the radius in all: |high - high'| + |low - low'| is at most
    the number of differing bits. One of both is the pair's home; the other's rows visit it as guests. The
    guests of a home are dealt to ``salts`` tasks, each with a copy of the home's own rows.
    """

    def __init__(self, counts: dict[int, int], radius: int, tile: int = TILE, per_task: int | None = None):
        self.radius = radius
        self.subs = {c: -(-n // tile) for c, n in counts.items()}
        near = {c: [d for d in counts if self._apart(c, d) <= radius] for c in counts}
        guests = {c: sum(counts[d] for d in near[c]) // 2 for c in counts}
        if per_task is None:
            per_task = min(max(sum(guests[c] * self.subs[c] for c in counts) // 1024, 2048), 1 << 20)
        self.near = near
        self.salts = {c: min(max(1, -(-guests[c] // per_task)), SALTS) for c in counts}
        self.keys = sum(self.subs[c] * self.salts[c] for c in counts)

    @staticmethod
    def _apart(c: int, d: int) -> int:
        return abs(c // 33 - d // 33) + abs(c % 33 - d % 33)

    def homes(self, cell: int, sub: int):
        """(tile, salts, own) of every tile that rows of this one go to; a tile is (cell, sub) as one number."""
        yield self._tile(cell, sub), self.salts[cell], True
        for d in self.near[cell]:
            for other in range(self.subs[d]):
                a, b = self._tile(cell, sub), self._tile(d, other)
                if a != b and (max(a, b) if (cell + sub + d + other) % 2 else min(a, b)) == b:
                    yield b, self.salts[d], False

    @staticmethod
    def _tile(cell: int, sub: int) -> int:
        return cell + CELLS * sub


def _mixed(x: np.ndarray) -> np.ndarray:
    """Evenly spread bits of a fingerprint, to deal equal shares."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def _cells(fp: np.ndarray) -> np.ndarray:
    high = np.bitwise_count(fp >> np.uint64(32)).astype(np.int64)
    return high * 33 + np.bitwise_count(fp & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _dealer(layout: Layout):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes = lru_cache(None)(lambda cell, sub: list(layout.homes(cell, sub)))
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            cell, spread = _cells(fp), _mixed(fp)
            sub = (spread % np.array([layout.subs.get(int(c), 1) for c in range(CELLS)], np.uint64)[cell]).astype(np.int64)
            order = np.lexsort((sub, cell))
            fp, cell, sub, spread = fp[order], cell[order], sub[order], spread[order]
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(sub) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
                if lo == hi:
                    continue
                keys, owns, fps = [], [], []
                for tile, salts, own in homes(int(cell[lo]), int(sub[lo])):
                    x = fp[lo:hi]
                    if own:
                        key = np.repeat(np.arange(salts), len(x)) + tile * SALTS
                        x = np.tile(x, salts)
                    else:
                        key = tile * SALTS + (spread[lo:hi] // np.uint64(7919) % np.uint64(salts)).astype(np.int64)
                    keys.append(key)
                    owns.append(np.full(len(x), own))
                    fps.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(owns)), pa.array(np.concatenate(fps).view(np.int64))], ["key", "own", "fp"])

    return deal


class _Home:
    """The own rows of a tile in blocks, and the classes into which links join them."""

    def __init__(self, fp: np.ndarray, radius: int):
        self.radius = radius
        self.fp, self.low, self.high = self._blocks(fp)
        self.label = np.arange(len(self.fp))

    @staticmethod
    def _blocks(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted by the quarters' population counts; least and greatest count of each quarter by block."""
        quarters = np.bitwise_count(fp[:, None] >> np.array([48, 32, 16, 0], np.uint64) & np.uint64(0xFFFF)).astype(np.int16)
        order = np.lexsort((quarters[:, 1], quarters[:, 3], quarters[:, 2], quarters[:, 0]))
        at = np.arange(0, len(fp), BLOCK)
        quarters = quarters[order]
        return fp[order], np.minimum.reduceat(quarters, at, axis=0), np.maximum.reduceat(quarters, at, axis=0)

    def _pairs(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        gap = np.maximum(self.low[:, None] - high[None], low[None] - self.high[:, None])
        return np.argwhere(np.maximum(gap, 0).sum(axis=2) <= self.radius)

    def _merge(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the classes labelled a[i] and b[i]."""
        while len(a):
            a, b = self.label[a], self.label[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if len(a):
                lo, hi = min(a[0], b[0]), max(a[0], b[0])
                self.label[self.label == hi] = lo

    def within(self) -> None:
        for i, j in self._pairs(self.low, self.high):
            if i <= j:
                x, y = self.fp[i * BLOCK : (i + 1) * BLOCK], self.fp[j * BLOCK : (j + 1) * BLOCK]
                a, b = np.nonzero(np.bitwise_count(x[:, None] ^ y[None]) <= self.radius)
                self._link(a + i * BLOCK, b + j * BLOCK)

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(np.stack([self.label[a], self.label[b]], axis=1), axis=0) if len(a) else np.empty((0, 2), int)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        self._merge(pairs[:, 0], pairs[:, 1])

    def visit(self, guests: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Edges from guests to own rows, one a guest and block pair; own rows with a common guest are joined."""
        guests, low, high = self._blocks(guests)
        for i, j in self._pairs(low, high):
            x, y = self.fp[i * BLOCK : (i + 1) * BLOCK], guests[j * BLOCK : (j + 1) * BLOCK]
            b, a = np.nonzero(np.bitwise_count(y[:, None] ^ x[None]) <= self.radius)
            if len(a):
                a = a + i * BLOCK
                first = np.flatnonzero(np.diff(b, prepend=-1))
                self._link(a, np.repeat(a[first], np.diff([*first, len(b)])))
                yield y[b[first]], self.fp[a[first]]

    def own_edges(self) -> tuple[np.ndarray, np.ndarray]:
        moved = self.label != np.arange(len(self.label))
        return self.fp[moved], self.fp[self.label[moved]]


def _comparer(radius: int):
    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, home = None, [], None

        def closed() -> _Home:
            made = _Home(np.concatenate(own), radius)
            if now % SALTS == 0:  # the own rows meet each other in one of their tasks
                made.within()
            return made

        for batch in batches:
            key, mine = batch.column("key").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = (np.flatnonzero((np.diff(key) != 0) | (np.diff(mine) != 0)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if lo == hi:
                    continue
                if key[lo] != now:
                    if own:
                        yield edges(*(home or closed()).own_edges())
                    now, own, home = int(key[lo]), [], None
                if mine[lo]:
                    own.append(fp[lo:hi])
                elif own:  # a tile without own rows has nothing to compare with
                    home = home or closed()
                    for a, b in home.visit(fp[lo:hi]):
                        yield edges(a, b)
        if own:
            yield edges(*(home or closed()).own_edges())

    return compare


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, per_task: int | None = None) -> DataFrame:
    """Edges (a, b) that connect just the fingerprints which differ in at most ``radius`` bits.

    fps: one row a different fingerprint (fp). Every pair within the radius is found, by comparing all
    rows of all tile pairs that can hold one; a task then reports a spanning set of what it found, at most
    one edge a row and block, not all pairs of a dense group.
    """
    cell = F.bit_count(F.shiftrightunsigned("fp", 32)) * 33 + F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF))
    counts = {r["cell"]: r["n"] for r in fps.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}  # at most CELLS rows
    layout = Layout(counts, radius, tile, per_task)
    spark = fps.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(layout.keys // 8, 20000))
    dealt = fps.select("fp").mapInArrow(_dealer(layout), "key long, own boolean, fp long")
    # A fixed number of partitions: few bytes stand for much work, so they must not be coalesced by size.
    return dealt.repartition(parts, "key").sortWithinPartitions("key", F.desc("own")).mapInArrow(_comparer(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(documents, classes) of the near-duplicate classes by SimHash.

    documents: doc_id, text_hash, fp of every row of ``docs`` (doc_id, text). classes: fp, keeper, one row
    a different fingerprint; keeper is the struct (unnamed, doc_id, text_hash) of the row that stands for
    the class, least by doc_id with null last, then by text_hash. Null and empty texts have fingerprint 0
    and link like any other; repeated rows share a class; a null doc_id stands for a class only if all its
    ids are null; very long texts are hashed whole; further columns, whatever their names, are ignored; an
    empty table gives empty results.
    """
    told = stored(fingerprints(docs), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    different = stored(told.groupBy("fp").agg(F.min(key).alias("keeper")), "different")
    linked = stored(components(links(different, radius), "a", "b"), "linked")
    of = different.join(linked.withColumnRenamed("node", "fp"), "fp")
    keepers = of.groupBy("root").agg(F.min("keeper").alias("least"))
    moved = linked.join(keepers, "root").select(F.col("node").alias("fp"), "least")
    # Stored, so that a join with it reads two plain shuffles, of which a hot fingerprint's can be split.
    return told, stored(different.join(moved, "fp", "left").select("fp", F.coalesce("least", "keeper").alias("keeper")), "classes")


def op10_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    told, classes = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = told.join(classes, "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("keeper.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each near-duplicate class, with its columns; rows equal in id and text are one."""
    _, classes = near_duplicates(docs, radius)
    stay = classes.select("keeper").distinct().select(F.col("keeper.doc_id").alias("_id"), F.col("keeper.text_hash").alias("_hash"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col("doc_id").cast("long").alias("_doc_id"), F.xxhash64("text").alias("_text_hash"))
    kept = rows.join(stay, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates(["_doc_id", "_text_hash"]).select("_doc.*")
