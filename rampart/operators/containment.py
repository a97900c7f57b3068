"""What lies within what: nested sets (pre, post) joined by one sweep over each file, without pairing all nodes of a file."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs that a task tells at once.
TOLD = 50_000


def _packed(df: DataFrame, but: Sequence[str] = ()) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in but))


def _sweep(n_keys: int):
    """Rows sorted by keys, place and kind: ranges are put on a stack while they are open, and what comes meanwhile is paired with each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack, held = None, [], None
        for batch in batches:
            outer, inner = batch.column("o"), batch.column("i")
            pool = pa.concat_arrays([held, outer]) if held is not None and len(held) else outer
            base, outs, ins = len(pool) - len(outer), [], []

            def told(outs=outs, ins=ins, pool=pool, inner=inner, batch=batch) -> pa.RecordBatch:
                rows = pa.array(ins, pa.int64())
                out = pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(n_keys)), pool.take(pa.array(outs, pa.int64())), inner.take(rows)], [*batch.schema.names[:n_keys], "o", "i"])
                outs.clear()
                ins.clear()
                return out

            places = zip(*(batch.column(c).to_pylist() for c in ("at", "until", "is_inner")), strict=True)
            keys = zip(*(batch.column(k).to_pylist() for k in range(n_keys)), strict=True)
            for r, (key, (at, until, is_inner)) in enumerate(zip(keys, places, strict=True)):
                if key != now:
                    now, stack = key, []
                while stack and stack[-1][0] < at:
                    stack.pop()
                if is_inner:
                    outs += [k for _, k in stack]
                    ins += [r] * len(stack)
                    if len(outs) > TOLD:
                        yield told()
                else:
                    stack.append((until, base + r))
            yield told()
            held = pool.take(pa.array([k for _, k in stack], pa.int64()))
            stack = [(until, k) for k, (until, _) in enumerate(stack)]

    return run


def containment(outer: DataFrame, inner: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """keys, o, i: each row of ``inner`` (keys, pre) with each row of ``outer`` (keys, pre, post) whose range holds it.

    ``o`` and ``i`` are the rows' other columns as structs. Ranges of one file nest or lie apart, as those of
    a tree do. Both sides are sorted by file and place, and a task keeps just the ranges that are open, so
    the work is the rows' number and that of the pairs told. Rows with null keys or places meet nothing.
    """
    keys = list(keys)
    o, i = _packed(outer, keys), _packed(inner, keys)
    o_type, i_type = outer.select(o).schema[0].dataType, inner.select(i).schema[0].dataType
    none = lambda kind: F.lit(None).cast(kind)
    ranges = outer.select(*keys, F.col("pre").cast("long").alias("at"), F.col("post").cast("long").alias("until"), F.lit(False).alias("is_inner"), o.alias("o"), none(i_type).alias("i"))
    points = inner.select(*keys, F.col("pre").cast("long").alias("at"), none("long").alias("until"), F.lit(True).alias("is_inner"), none(o_type).alias("o"), i.alias("i"))
    both = ranges.where("until is not null").unionAll(points).dropna(subset=[*keys, "at"])
    # Of ranges that begin together the longer one is the outer one.
    dealt = both.repartition(*keys).sortWithinPartitions(*keys, "at", "is_inner", F.desc("until"))
    schema = T.StructType([*(both.schema[k] for k in keys), T.StructField("o", o_type), T.StructField("i", i_type)])
    return dealt.mapInArrow(_sweep(len(keys)), schema)


def holding(outer: DataFrame, inner: DataFrame, keys: Sequence[str] = ("path",), how: str = "left_semi") -> DataFrame:
    """Rows of ``outer`` (keys, pre, post) with (left_semi) or without (left_anti) a row of ``inner`` (keys, pre) in their range.

    The rows of ``inner`` are counted along each file; a range holds one if the count at its end is not that
    before its beginning. No pairs are made, however deep the ranges nest.
    """
    keys = list(keys)
    event = lambda df, at, rank, n, of: df.select(*keys, F.col(at).cast("long").alias("at"), F.lit(rank).alias("rank"), F.lit(n).alias("n"), of.cast("long").alias("of"), (F.col("post") if rank != 1 else F.lit(None)).cast("long").alias("to"))
    events = event(outer, "pre", 0, 0, F.col("pre")).unionAll(event(inner, "pre", 1, 1, F.lit(None))).unionAll(event(outer, "post", 2, 0, F.col("pre")))
    upto = W.partitionBy(*keys).orderBy("at", "rank").rowsBetween(W.unboundedPreceding, 0)
    counted = events.withColumn("count", F.sum("n").over(upto)).where("of is not null")
    found = counted.groupBy(*keys, "of", "to").agg(F.min("count").alias("lo"), F.max("count").alias("hi")).where("lo < hi")
    same = [F.col(f"`{k}`") == F.col(f"_{k}") for k in keys]
    held = found.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("of").alias("_of"), F.col("to").alias("_to"))
    return outer.join(held, [*same, F.col("pre") == F.col("_of"), F.col("post") == F.col("_to")], how)
