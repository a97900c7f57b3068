"""What the operators of this package share: words, let-bindings, stored tables and histogram cuts."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stored import drop, scope, stored, stored_path  # noqa: F401 - used by the operators

#: White space of the contracts: space and the controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"


def tidy() -> None:
    """Gives back to the system what earlier tasks of this Python worker have freed: workers live long, and their peaks would add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own ways
        pass


def rest(spark: SparkSession) -> None:
    """Between the steps of a long job: the driver's Python and its JVM give back what the steps before have left.

    Hundreds of stages without a full collection let the JVM's heap grow to its limit, whatever lives in it;
    Spark's cleaner drops shuffle files and broadcasts of steps that are over only after one, too.
    """
    tidy()
    spark._jvm.System.gc()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the maximal runs without white space; null text has none.

    Single-character ``replace`` and ``split`` take the JVM's fast paths; a character class would go
    through the regex engine for every character.
    """
    flat = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


#: A cut works on keys of LEVELS digits of DIGIT bits.
DIGIT, LEVELS = 12, 4
KEY_BITS = DIGIT * LEVELS


def histogram_cut(rows: DataFrame, group: str, key: str, weight: str, need: DataFrame) -> DataFrame:
    """For each group the key up to which the rows, by ascending key, weigh about ``need``, without sorting rows.

    ``rows`` has ``key`` in [0, 2**48) and an integral ``weight``; ``need`` has one row a group, with a
    double column ``need``. Level by level the weights are summed by group and hash bucket, the bucket in
    which the running sum passes the need is found, and only that bucket is refined by the next digit. A
    level shuffles at most 4096 sums a group and task; the windows run over those sums.

    Returns ``group, cut``: the rows with key < cut make up the budget. The last key, with all rows tied
    on it, is taken if that comes at least as near to the need as leaving it. A group whose need is not
    below its weight gets a cut above every key.
    """
    state = need.select(group, F.col("need").cast("double"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = KEY_BITS - DIGIT * (level + 1)
        part = rows.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.col(weight).alias("_w"))
        if level:
            keyed = state.select(F.col(group).alias("_sg"), "prefix")
            part = part.join(keyed, F.col("_g").eqNullSafe(F.col("_sg"))).where(F.shiftright("_k", shift + DIGIT) == F.col("prefix"))
        sums = part.groupBy("_g", F.shiftright("_k", shift).bitwiseAND(2**DIGIT - 1).alias("_d")).agg(F.sum("_w").alias("_w")).where("_w > 0")
        upto = W.partitionBy("_g").orderBy("_d").rowsBetween(W.unboundedPreceding, 0)
        sums = sums.withColumn("_before", F.sum("_w").over(upto) - F.col("_w"))
        state = stored(
            state.join(sums, F.col(group).eqNullSafe(F.col("_g")))
            .where("_before <= need and need < _before + _w")
            .select(group, (F.col("need") - F.col("_before")).alias("need"), (F.col("prefix") * 2**DIGIT + F.col("_d")).alias("prefix"), F.col("_w").alias("tied")),
            f"cut{level}",
        )
    at = state.select(F.col(group).alias("_g"), (F.col("prefix") + (F.col("need") * 2 >= F.col("tied")).cast("long")).alias("_cut"))
    return need.join(at, F.col(group).eqNullSafe(F.col("_g")), "left").select(group, F.coalesce("_cut", F.lit(2**KEY_BITS)).alias("cut"))
