"""Streams of agent actions and conversation turns, by the same column functions as batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.actions import action_verdicts


def verdict_stream(actions: DataFrame) -> DataFrame:
    """Verdict of each action of a stream (action_id, action_type, action_value); stateless."""
    return action_verdicts(actions)


def verdict_counts(actions: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Actions by hour and verdict; ``ts`` is the event time, rows later than ``late`` are left out."""
    told = actions.withWatermark("ts", late)
    judged = action_verdicts(told.select(F.struct("action_id", "ts").alias("action_id"), "action_type", "action_value"))
    return judged.groupBy(F.window(F.col("action_id.ts"), every), "verdict").count()


#: Where transformWithState keeps its state.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _PriorHits(StatefulProcessor):
    """Counts a conversation's hits; a timer ends a conversation that has been quiet for ``keep_ms`` of event time, and its state."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle, self.hits = handle, handle.getValueState("hits", "hits long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "turn"])
        before, until = self.hits.get() if self.hits.exists() else (0, 0)
        hits = batch["hit"].astype(int)
        last = max(until, int(batch["ts"].max().timestamp() * 1000) + self.keep_ms)
        if last != until:
            if until:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(last)
        self.hits.update((before + int(hits.sum()), last))
        yield pd.DataFrame({"conv_id": key[0], "turn": batch["turn"].to_numpy(), "prior": (before + hits.cumsum() - hits).to_numpy(), "ended": False})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (hits, _) = self.hits.get()
        self.hits.clear()
        yield pd.DataFrame({"conv_id": [key[0]], "turn": pd.array([None], "Int64"), "prior": [hits], "ended": [True]})

    def close(self) -> None:
        pass


def prior_hits_stream(turns: DataFrame, keep: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """conv_id, turn, prior, ended: hits among the conversation's turns so far, and a last row when it has ended.

    turns: conv_id, turn, hit, ts, in order of arrival. A conversation ends when no turn of it has come for
    ``keep`` before the watermark (``late`` behind the latest ts): its state is deleted then, so the state
    holds the conversations of the last ``keep``, however long the stream runs; a turn that comes later begins
    anew. The session needs STORE as its state store.
    """
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    told = turns.select("conv_id", "turn", "hit", "ts").withWatermark("ts", late)
    return told.groupBy("conv_id").transformWithStateInPandas(_PriorHits(keep_ms), "conv_id long, turn long, prior long, ended boolean", "Append", "EventTime")


def to_history(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to the history; a batch that is run again overwrites itself."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).start()
