"""Exact top-k search by inner product: columnar branch-and-bound over blocks of dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALE, DIMENSIONS = 1024, 16
#: Queries and vectors that a task holds at most (but for uneven hashing); vectors at least, if there are as many.
QUERIES, VECTORS, FEWEST = 8192, 32768, 512
#: Per result asked for, candidates with the best sums so far whose whole scores set the bound.
SEEDS = 4
#: Sums of products below this are exact in doubles; scores are clipped to LONG.
EXACT, LONG = 2**53, 2**63 - 1


def quantised(lists: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of every component as a double, a vector a row, filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)[lists.offsets[0].as_py() :]
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None] < sizes[:, None]] = np.floor(flat[: int(sizes.sum())] * SCALE)
    return out


class Block:
    """Vectors in vertical layout: one contiguous row a dimension, largest masses first, with remaining norms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")  # so that earlier rows have smaller ids
        self.ids, vectors = ids[order], vectors[order]
        self.copies = np.ones(len(ids), np.int64) if copies is None else copies[order]
        mass = (vectors**2).sum(axis=0)
        self.dims = np.argsort(-mass, kind="stable")
        self.columns = np.ascontiguousarray(vectors[:, self.dims].T)
        self.at = list(range(0, len(self.dims), DIMENSIONS))
        rest = np.zeros((len(self.at) + 1, len(ids)))
        for b in reversed(range(len(self.at))):
            rest[b] = rest[b + 1] + (self.columns[self.at[b] : self.at[b] + DIMENSIONS] ** 2).sum(axis=0)
        self.rest = np.sqrt(rest)
        self.largest = np.abs(vectors).max(initial=0.0)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, scores and copies of the k best vectors but the query's own, ties to smaller ids."""
        alive = np.flatnonzero(self.ids != query_id)
        q = query[self.dims]
        if np.abs(q).max(initial=0.0) * self.largest * max(1, len(q)) >= EXACT:
            return self._in_whole_numbers(alive, q, k)
        left = np.sqrt(np.array([(q[a:] ** 2).sum() for a in [*self.at, len(q)]]))
        score, least = np.zeros(len(alive)), -np.inf
        whole = len(alive) == len(self.ids)
        for b, a in enumerate(self.at):
            columns = self.columns[a : a + DIMENSIONS]
            score += q[a : a + DIMENSIONS] @ (columns if whole else columns[:, alive])
            # By Cauchy and Schwarz the dimensions to come add at most this much, either way.
            slack = self.rest[b + 1][alive] * (left[b + 1] * (1 + 1e-9)) + 1e-3 * (b + 1 < len(self.at))
            # Before three quarters of the query's mass are in, bounds are too wide to be worth their price.
            if len(alive) > k and left[b + 1] <= 0.5 * left[0]:
                least = max(least, self._reached(alive, score, q, k) if b + 1 < len(self.at) else np.partition(score, len(alive) - k)[len(alive) - k])
                stay = score + slack >= least
                if stay.sum() < 0.8 * len(alive):
                    alive, score, whole = alive[stay], score[stay], False
        best = np.lexsort((alive, -score))[:k]
        return self.ids[alive[best]], score[best].astype(np.int64), self.copies[alive[best]]

    def _reached(self, alive: np.ndarray, score: np.ndarray, q: np.ndarray, k: int) -> float:
        """A score that k candidates reach: the k-th of the whole scores of those that are best so far."""
        n = min(len(alive), SEEDS * k)
        seeds = alive[np.argpartition(score, len(alive) - n)[len(alive) - n :]]
        whole = q @ self.columns[:, seeds]
        return np.partition(whole, n - k)[n - k]

    def _in_whole_numbers(self, alive: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = [int(x) for x in q]
        scores = [max(-LONG - 1, min(LONG, sum(x * int(y) for x, y in zip(whole, self.columns[:, i], strict=True)))) for i in alive]
        best = sorted(range(len(alive)), key=lambda j: (-scores[j], alive[j]))[:k]
        at = alive[np.array(best, np.int64)]
        return self.ids[at], np.array([scores[j] for j in best], np.int64), self.copies[at]


def _searcher(k: int):
    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        asked, held = queries.combine_chunks(), vectors.combine_chunks()
        found = {"query_id": [], "vec_id": [], "score": [], "copies": []}
        if asked.num_rows and held.num_rows:
            lists = [t.column("embedding").combine_chunks() for t in (asked, held)]
            lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
            width = max(int(np.diff(x.offsets.to_numpy()).max(initial=0)) for x in lists)
            block = Block(held.column("vec_id").to_numpy(), quantised(lists[1], width), held.column("copies").to_numpy())
            for query_id, query, times in zip(asked.column("vec_id").to_numpy(), quantised(lists[0], width), asked.column("copies").to_numpy(), strict=True):
                ids, scores, copies = block.search(query_id, query, k)
                found["query_id"].append(np.full(len(ids), query_id))
                found["vec_id"].append(ids)
                found["score"].append(scores)
                found["copies"].append(np.minimum(copies, k) * min(int(times), k))
        return pa.table({c: pa.array(np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64)) for c, x in found.items()})

    return search


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best other rows by integer inner product.

    vectors: vec_id, embedding; ``is_query`` is a condition on vec_id. Rows with a null id, a null vector
    or a null or non-finite component take no part. Shorter vectors count as filled up with zeros. Every
    row is a candidate and every query row asks, repeated ones too; all rows with the query's id are its
    own; the rows that ask with one id share one ranking. Scores beyond a long are clipped. Vectors are dealt by hash into
    blocks of bounded size, and each block meets the queries, itself in blocks; a block yields k rows a
    query. Vectors of any length take part whole; further columns, whatever their names, are ignored. No
    rows or no queries: an empty result.
    """
    spark = vectors.sparkSession
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fit)
    asked = rows.where(is_query).groupBy("vec_id", "embedding").agg(F.count("*").alias("copies"))
    sizes = rows.agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("q")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_block = min(VECTORS, max(FEWEST, sizes.n // (4 * parts)))
    blocks, groups = max(1, -(-sizes.n // per_block)), max(1, -(-(sizes.q or 0) // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.groupBy("vec_id", "embedding").agg(F.count("*").alias("copies")).withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int")).withColumn("group", every(groups))
    meet = asked.withColumn("group", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(groups)).cast("int")).withColumn("block", every(blocks))
    near = meet.groupBy("block", "group").cogroup(held.groupBy("block", "group")).applyInArrow(_searcher(k), "query_id long, vec_id long, score long, copies long")
    cut = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("place", F.row_number().over(cut)).where(F.col("place") <= k).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk_search(spark, sf_dir: str) -> DataFrame:
    """The contract's search: rows whose vec_id is divisible by 100, against all rows."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE_OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""
