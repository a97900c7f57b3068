"""Connected components of an edge table by alternating stars, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    # A join, not a window: the rows of a node with very many neighbours can be split over tasks.
    return edges.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours; edges point down (u > v)."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return _joined(up, least).select(F.col("v").alias("u"), F.col("m").alias("v"))  # a row an edge; the small star makes them distinct


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of those; edges point down (u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _joined(edges, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.withColumnRenamed("m", "v")).distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none, or none: one shuffle, where a further round takes five."""
    each = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("downs"), F.lit(0).alias("ups")), F.struct(F.col("v").alias("n"), F.lit(0).alias("downs"), F.lit(1).alias("ups")))).alias("e")).select("e.*")
    per = each.groupBy("n").agg(F.sum("downs").alias("downs"), F.max("ups").alias("ups"))
    return per.agg(F.count_if((F.col("downs") > 1) | ((F.col("downs") > 0) & (F.col("ups") > 0)))).first()[0] == 0


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge to another: root is the least node of its component.

    Edges may repeat, point either way or be loops. Each round is written to the shared folder; the
    rounds grow with the logarithm of the longest path, and end as soon as all edges form stars.
    """
    now = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if are_stars(now):
            break
        now = stored(small_star(large_star(now)), "stars")
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
