"""Sharding by Karmarkar-Karp differencing: byte-balanced shards of indivisible groups of equal texts."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: A group with over 1/LARGE of all bytes is an item of its own (so there are under LARGE of them); the
#: rest go into BUNDLES items by their text's hash, whole groups too.
LARGE, BUNDLES = 6144, 4096
#: Rows of a shard that one task numbers.
NUMBERED = 20_000


def differencing(sizes: Sequence[int], ways: int) -> list[int]:
    """The way of each item, by k-way Karmarkar-Karp differencing.

    Every item starts as a partial partition with one filled way. The two with the largest spread are
    combined again and again, the fullest ways of one with the emptiest of the other. Ties go by position.
    """
    # A partial partition: (-spread, order, sums above its least in ascending order, trees of items).
    heap = [(-s, i, (0,) * (ways - 1) + (s,), (None,) * (ways - 1) + (i,)) for i, s in enumerate(sizes)]
    if ways == 1 or not heap:
        return [0] * len(sizes)
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        (_, _, a, x), (_, _, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        ways_now = sorted(((p + q, k) for k, (p, q) in enumerate(zip(a, reversed(b), strict=True))), key=lambda w: w[0])
        sums = [w[0] for w in ways_now]
        trees = tuple((x[k], y[ways - 1 - k]) if x[k] is not None and y[ways - 1 - k] is not None else (x[k] if y[ways - 1 - k] is None else y[ways - 1 - k]) for _, k in ways_now)
        heapq.heappush(heap, (sums[0] - sums[-1], made, tuple(s - sums[0] for s in sums), trees))
        made += 1
    found = [0] * len(sizes)
    for way, tree in enumerate(heap[0][3]):
        open_ = [tree]
        while open_:
            t = open_.pop()
            if isinstance(t, tuple):
                open_ += t
            elif t is not None:
                found[t] = way
    return found


def assign_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document; the shards' bytes are as equal as whole groups allow.

    docs: doc_id, text and any other columns, which are ignored. Size: UTF-8 bytes + 8. Rows with equal
    texts (null equals null) form a group, told apart by 128 bits of hash, and stay in one shard whatever
    their number. A group above a fair share fills a shard of its own and the others share the rest
    evenly. Large groups are items of their own; all others, whole, share BUNDLES hash bundles, whose sums
    are exact; differencing deals these items. The driver sees at most LARGE + BUNDLES sums, whatever the
    input's size. Slots number a shard's rows from 0 without gaps, in a fixed but arbitrary order: rows are
    numbered within parts of a shard, then the parts are put end to end, so a shard with most of the rows
    has more parts, not a larger task. Null ids and very long texts are rows like any other; repeated rows
    each get a slot; an empty table gives an empty result.
    """
    full = F.coalesce("text", F.lit(""))
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(full) + 8).cast("long").alias("size"),
            F.crc32(full.cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("hash"),
            F.xxhash64(F.lit(1), "text").alias("more"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sized",
    )
    total = rows.agg(F.sum("size").alias("bytes")).first()
    groups = rows.groupBy("hash", "more").agg(F.sum("size").alias("bytes"))
    large = groups.where(F.col("bytes") > (total.bytes or 0) / LARGE).orderBy("hash", "more").collect()
    listed = [(g["hash"], g["more"], BUNDLES + k) for k, g in enumerate(large)]
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(listed, "hash long, more long, own int"))
    items = rows.join(known, ["hash", "more"], "left").select("doc_id", "size", "text_crc32", "row", F.coalesce("own", F.pmod("hash", F.lit(BUNDLES)).cast("int")).alias("item"))
    sums = {r["item"]: (r["bytes"], r["n"]) for r in items.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    order = sorted(sums)
    ways = differencing([sums[i][0] for i in order], shards)
    held = Counter()
    for i, way in zip(order, ways, strict=True):
        held[way] += sums[i][1]
    dealt = F.broadcast(spark.createDataFrame([(i, way, -(-held[way] // NUMBERED)) for i, way in zip(order, ways, strict=True)], "item int, shard int, parts int"))
    placed = items.join(dealt, "item").withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.col("parts")).cast("int")).drop("item", "parts")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = stored(counts.select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset")), "offsets")
    number = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "row"))
    return placed.withColumn("_n", number).join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("_n") - 1).alias("slot"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """The contract's shards of all documents, by the law of equal bytes."""
    found = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
