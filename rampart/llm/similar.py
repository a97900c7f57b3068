"""Near-dedup for corpora: SimHash links, and set similarity of word shingles by a prefix join on the rarest ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe_automaton import forget
from .common import drop, rest, stored, stored_path, words
from .components import components
from .simhash import RADIUS, fingerprint, links

#: Two texts are near-duplicates if their sets of WORDS-word shingles have at least LEAST / OF in common.
WORDS, LEAST, OF = 5, 4, 5
SEED = 42
#: Shingles are ordered by how many of about SAMPLE texts hold them, MOST of them at most; the order decides what is compared, never what is found.
SAMPLE, MOST = 1 << 14, 1 << 20
#: Sets that one task compares with a leader's, about, and texts of one shingle that one task brings together.
TOGETHER, SPLIT = 4096, 100_000
#: Nodes (of 8 bytes) up to which a list of them is broadcast to the texts.
FEW = 200_000
#: Tokens before one that are looked at, to list a pair at its first common token only.
BEFORE = 4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the different 5-word shingles, sorted, letters A-Z in lower case; a shorter text is one shingle, no word none."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(tokens[i : i + WORDS]), SEED) for i in range(max(1, len(tokens) - WORDS + 1))], np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sets reach the bound; two empty ones do."""
    if min(len(a), len(b)) * OF < max(len(a), len(b)) * LEAST:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * OF >= (len(a) + len(b) - both) * LEAST


def outline(found: np.ndarray) -> bytes:
    """A bitmap of the set: the bits that its hashes name modulo a power of two, at least four a hash."""
    bits = max(64, 1 << int(4 * len(found) - 1).bit_length()) if len(found) else 64
    mask = np.zeros(bits, bool)
    mask[(found & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(mask, bitorder="little").tobytes()


def may_be_similar(a: bytes, a_size: int, b: bytes, b_size: int) -> bool:
    """Whether the outlines allow the sets to reach the bound: a bit that only one has is an element that only it has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):  # the longer one modulo half as much
        if len(x) < len(y):
            x, y, a_size, b_size = y, x, b_size, a_size
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    both = min(a_size - int(np.bitwise_count(x & ~y).sum()), b_size - int(np.bitwise_count(y & ~x).sum()))
    return both * OF >= (a_size + b_size - both) * LEAST


class Order:
    """An order of all shingles: those not known as frequent first, then by their count, then by hash.

    The shingles of a passage have one count, so they stand together, and a text of several passages begins
    with its rarest one.

    ``step`` is how many texts one of the sample stands for.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, step: int = 1):
        by = np.argsort(hashes)
        self.hashes, counts = hashes[by], np.maximum(counts[by], 1)
        self.level = counts.astype(np.int32)
        self.salts = np.minimum(counts * step // SPLIT + 1, 1 << 20).astype(np.int32)

    def prefix(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set's first elements, so many that any set similar to it has one of them among its own first ones; and into how many parts the texts of each are dealt."""
        n = len(found)
        level, salts = np.zeros(n, np.int32), np.ones(n, np.int32)
        if len(self.hashes) and n:
            at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            known = self.hashes[at] == found
            level[known], salts[known] = self.level[at[known]], self.salts[at[known]]
        first = np.argsort(level, kind="stable")[: n - -(-n * LEAST // OF) + 1]
        return found[first], salts[first]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column("text").cast(pa.binary()):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_py()).view(np.int64))], ["shingle"])


def frequent(docs: DataFrame) -> Order:
    """The order by a sample of the different texts, which the hash of a text takes or leaves; a bounded table comes to the driver."""
    step = max(1, docs.count() // SAMPLE)
    some = docs.select("text").where(F.pmod(F.xxhash64(F.lit("order"), "text"), F.lit(step)) == 0).where("text is not null").distinct()
    counts = some.mapInArrow(_each, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    table = counts.orderBy(F.desc("n"), "shingle").limit(MOST).toArrow()
    return Order(table.column("shingle").to_numpy().view(np.uint64), table.column("n").to_numpy(), step)


def node(text: Column) -> Column:
    """A text's words in lower case as one hash: texts that differ in white space or case only are one node."""
    return F.xxhash64(F.translate(F.concat_ws(" ", words(text)), UPPER, UPPER.lower()))


def _signed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        forget()
        for batch in batches:
            first, salts, outlines, sizes, prints = [], [], [], np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.uint64)
            nodes = batch.column("node").to_numpy()
            for k, x in enumerate(batch.column("text").cast(pa.binary())):
                text = x.as_py() or b""
                found = shingles(text)
                tokens, parts = order.prefix(found)
                first.append(tokens.view(np.int64))
                salts.append(np.where(parts > 1, nodes[k] % parts, -1).astype(np.int32))
                outlines.append(outline(found))
                sizes[k], prints[k] = len(found), fingerprint(text)
            ends = pa.array(np.cumsum([0, *map(len, first)]).astype(np.int32))
            lists = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*x, np.zeros(0, kind)]).astype(kind))) for x, kind in ((first, np.int64), (salts, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes), *lists, pa.array(outlines, pa.binary()), pa.array(prints.view(np.int64))], ["node", "size", "first", "salts", "outline", "fp"])

    return run


MEMBER = "token long, node long, size int, at int, a long, a_size int, a_at int"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token, salt, place and node: the different nodes of tokens that more than one has, each with the first one; all of salted tokens."""
    columns = ("token", "salt", "node", "size", "at")
    held: tuple | None = None  # the last row, its run's first, and whether it is known to be in company

    def told(rows: dict[str, np.ndarray], first: list[np.ndarray], some: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(rows[c][some]) for c in ("token", "node", "size", "at")), *(pa.array(x[some]) for x in first)], ["token", "node", "size", "at", "a", "a_size", "a_at"])

    for batch in batches:
        rows = {c: batch.column(c).to_numpy() for c in columns}
        if not batch.num_rows:
            continue
        lead = None
        if held:
            rows = {c: np.concatenate([[held[0][c]], rows[c]]).astype(rows[c].dtype) for c in columns}
            lead = held[1]
        token, salt, node = rows["token"], rows["salt"], rows["node"]
        same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
        new = np.append(True, ~same | (node[1:] != node[:-1]))
        rows = {c: x[new] for c, x in rows.items()}
        token, salt = rows["token"], rows["salt"]
        joins = np.append(False, (token[1:] == token[:-1]) & (salt[1:] == salt[:-1]))  # with the row before
        begins = np.flatnonzero(~joins)
        run = np.cumsum(~joins) - 1
        first = [rows[c][begins][run] for c in ("node", "size", "at")]
        company = joins | np.append(joins[1:], False) | (salt >= 0)
        if held:
            company[0] |= held[2]
            for x, was in zip(first, lead, strict=True):
                x[run == 0] = was
        last = len(token) - 1
        held = {c: rows[c][last] for c in columns}, [x[last] for x in first], bool(company[last])
        some = company.copy()
        some[last] = False
        yield told(rows, first, some)
    if held and held[2]:
        rows = {c: np.array([held[0][c]]) for c in columns}
        yield told(rows, [np.array([x]) for x in held[1]], np.array([True]))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a leader, whose set comes first, and those after it that are similar."""
    a = own = None
    for batch in batches:
        found: list[tuple[int, int]] = []
        lists = batch.column("shingles")
        for k, (leader, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
            told = lists[k].values.to_numpy(zero_copy_only=False)
            if b is None:
                a, own = leader, told
            elif a == leader and similar(own, told):
                found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _salted(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaders, pairs): a, salts and a, b, salt; a leader with many partners is dealt to several tasks."""
    leaders = stored(pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / TOGETHER).alias("salts")), "leaders")
    return leaders, pairs.join(leaders, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))


def _linked(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets are similar; sets are made of just the texts that they name."""
    leaders, dealt = _salted(pairs)
    asked = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
    few = asked.count() <= FEW
    texts = named.join(F.broadcast(asked) if few else asked, "node").groupBy("node").agg(F.first("text").alias("text"))
    sets = stored(texts.mapInArrow(_sets, "node long, shingles array<long>"), "sets")
    own = leaders.join(sets.select(F.col("node").alias("a"), "shingles"), "a")
    own = own.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "shingles")
    others = dealt.join(sets.select(F.col("node").alias("b"), "shingles"), "b").select("a", "salt", "b", "shingles")
    met = own.unionAll(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").isNotNull())
    return met.select("a", "b", "shingles").mapInArrow(_compared, "a long, b long")


SIGNED = "node long, size int, first array<long>, salts array<int>, outline binary, fp long"


def candidates(docs: DataFrame, order: Order | None = None) -> tuple[DataFrame, DataFrame]:
    """(known, members): node, size, outline, fp of every different node, and token, node, size, at (the token's place in the node's order) of the tokens that different nodes share, with a, the node that has the token at the earliest place (of a part, if a token's nodes are dealt into parts)."""
    spark = docs.sparkSession
    named = docs.select(node(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(frequent(docs) if order is None else order)  # MOST entries at most
    path = stored_path(spark, "signed")
    named.mapInArrow(_signed(shared), SIGNED).write.parquet(path)
    shared.destroy()
    signed = spark.read.schema(SIGNED).parquet(path)
    each = signed.select(F.posexplode(F.arrays_zip("first", "salts")).alias("at", "x"), "node", "size").select(F.col("x.first").alias("token"), F.col("x.salts").alias("salt"), "node", "size", "at")
    dealt = each.repartition("token", "salt").sortWithinPartitions("token", "salt", "at", "node")
    members = stored(dealt.mapInArrow(_met, MEMBER), "members")
    known = stored(signed.groupBy("node").agg(*(F.first(c).alias(c) for c in ("size", "outline", "fp"))), "known")
    drop(spark, path)  # the prefixes are the largest part
    return known, members


def _outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = zip(*(batch.column(c).to_pylist() for c in ("a_outline", "a_size", "b_outline", "b_size")), strict=True)
        yield batch.select(["a", "b"]).filter(pa.array([may_be_similar(*x) for x in told], pa.bool_()))


def plausible(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose outlines allow them to be similar; few others pass, and the sets of the rest never travel."""
    of = lambda c: known.select(F.col("node").alias(c), F.col("outline").alias(f"{c}_outline"), F.col("size").alias(f"{c}_size"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_outline", "a_size", "b_outline", "b_size").mapInArrow(_outlined, "a long, b long")


def _meet(a_size: str, a_at: str, b_size: str, b_at: str) -> Column:
    """Whether sets of these sizes that are similar can have their first common elements at these places.

    Similar sets have at least both sizes times LEAST / (LEAST + OF) in common, so the first common element
    comes before so many are left of each; sizes that are too far apart allow no place.
    """
    common = F.expr(f"({LEAST} * ({a_size} + {b_size}) + {LEAST + OF - 1}) div {LEAST + OF}")
    return (F.col(a_at) <= F.col(a_size) - common) & (F.col(b_at) <= F.col(b_size) - common)


def _open(members: DataFrame, edges: DataFrame) -> DataFrame:
    """token, node, size, at, part of the tokens whose nodes aren't yet all in one component."""
    roots = stored(components(edges, "a", "b"), "roots")
    placed = members.join(roots, "node", "left").select("token", "node", "size", "at", F.coalesce("root", "node").alias("part"))
    mixed = placed.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("token")
    return stored(placed.join(mixed, "token", "left_semi"), "open")


def similar_nodes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, root) of every node of ``docs`` (text) that a chain of links joins to another.

    Two texts are linked if their SimHash fingerprints differ in at most ``radius`` bits (``simhash.links``,
    tiled exact comparison), or if their shingle sets are similar. Two similar sets have a shingle in common
    among the first fifth of each, in any one order of all shingles. With those in many texts last, a passage
    that makes up less than four fifths of its texts is not among their first shingles, and its texts don't
    meet. Nodes that share a token, at places where similar sets can have their first common one, are paired in
    three steps: each node with one leader; then, where a token still holds more than one component, with that
    token's leader; and where it still does, all pairs of its nodes of different components. A token's leader
    has it at the earliest place, so it has the fewest rare shingles: of copies with changes of their own it is
    the one nearest to what they have in common. Where outlines (bitmaps of the sets) allow a pair, the sets
    decide. A group of near copies is joined by the first steps, so its pairs are never listed.
    """
    spark = docs.sparkSession
    rest(spark)
    known, members = candidates(docs)
    rest(spark)
    leader = members.where("a <> node").where(_meet("a_size", "a_at", "size", "at")).groupBy(F.col("node").alias("b")).agg(F.min(F.struct("a_at", "a"))["a"].alias("a"))
    named = docs.select(node(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    first = stored(_linked(stored(plausible(leader, known), "pairs"), named), "first")
    rest(spark)
    open_ = _open(members, first)
    rest(spark)
    stars = open_.groupBy("token").agg(F.min(F.struct("at", "node", "size", "part")).alias("x")).select("token", "x.*").toDF("token", "a_at", "a", "a_size", "a_part")
    tried = open_.join(stars, "token").where("part <> a_part").where(_meet("a_size", "a_at", "size", "at")).select("a", F.col("node").alias("b")).distinct()
    second = stored(_linked(stored(plausible(tried, known), "pairs"), named).unionAll(first), "second")
    rest(spark)
    open_ = _open(open_.drop("part"), second)
    rest(spark)
    # Where one of the tokens just before is common too, the pair meets there, at earlier places of both.
    here = W.partitionBy("node").orderBy("at")
    open_ = open_.withColumn("before", F.array_compact(F.array(*(F.lag("token", k).over(here) for k in range(1, 1 + BEFORE)))))
    other = open_.select("token", F.col("node").alias("b"), F.col("size").alias("b_size"), F.col("at").alias("b_at"), F.col("part").alias("b_part"), F.col("before").alias("b_before"))
    met = open_.join(other, "token").where("node < b and part <> b_part and not arrays_overlap(before, b_before)").where(_meet("size", "at", "b_size", "b_at"))
    met = met.select(F.col("node").alias("a"), "b").distinct()
    third = stored(_linked(stored(plausible(met, known), "pairs"), named), "third")
    rest(spark)
    # A fingerprint is told by its least node; nodes of one fingerprint are linked to that.
    prints = stored(known.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    alike = known.select("fp", "node").join(prints, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    close = stored(links(prints, radius), "close")
    rest(spark)
    ends = close.join(prints.select(F.col("fp").alias("a"), F.col("least").alias("na")), "a").join(prints.select(F.col("fp").alias("b"), F.col("least").alias("nb")), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    return stored(components(second.unionAll(third).unionAll(alike).unionAll(ends), "a", "b"), "linked")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, x in enumerate(batch.column("text").cast(pa.binary())):
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(k, 1), pa.array([shingles(x.as_py()).view(np.int64)], pa.list_(pa.int64()))], ["node", "shingles"])


def one_of_similar(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` (doc_id, text, any others) for each class of near-duplicates, with its columns whatever their names.

    The row that stays is the least by doc_id with null last, then by the text's hash. Texts without words
    are one class; rows equal in id and text are one; very long texts are compared whole; an empty table gives
    an empty result.
    """
    linked = similar_nodes(docs)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), node(F.col("text")).alias("node"))
    key = F.struct(F.col("_id").isNull().alias("unnamed"), "_id", "_hash")
    least = rows.select("node", "_id", "_hash").groupBy("node").agg(F.min(key).alias("keeper"))
    classes = least.join(linked, "node", "left").groupBy(F.coalesce("root", "node").alias("class")).agg(F.min("keeper").alias("keeper"))
    stay = stored(classes.select(F.col("keeper._id").alias("k_id"), F.col("keeper._hash").alias("k_hash")), "stay")
    kept = rows.join(stay, F.col("_id").eqNullSafe(F.col("k_id")) & (F.col("_hash") == F.col("k_hash")), "left_semi")
    return kept.dropDuplicates(["_id", "_hash"]).select("_doc.*")
