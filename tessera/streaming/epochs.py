"""Streams of signed changes: epochs arrive as micro-batches, state is a consolidated multiset.

Structured Streaming's own stateful operators take appends only, so retractions are folded into a state
table by ``foreachBatch``. Each batch writes its own version of the state; a batch that is run again
after a failure rewrites the same version, so replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.zset import DIFF, Collection


class ZSetState:
    """A consolidated multiset kept in versioned Parquet folders below ``path``, one per batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def version(self, batch: int) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], f"{self.schema}, {DIFF} bigint")
        return self.spark.read.parquet(f"{self.path}/v{batch}")

    def apply(self, changes: DataFrame, batch: int) -> DataFrame:
        """Version ``batch``: the one before plus the changes."""
        state = Collection(self.version(batch - 1)).concat(Collection(changes)).consolidate()
        state.df.write.mode("overwrite").parquet(f"{self.path}/v{batch}")
        return self.version(batch)


def run_changes(stream: DataFrame, state: ZSetState, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> int:
    """Feed all available change batches through the state; returns the last batch number (-1: none)."""
    last = [-1]

    def fold(batch: DataFrame, number: int) -> None:
        now = state.apply(batch, number)
        last[0] = number
        if on_batch:
            on_batch(now, number)

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return last[0]


def replay(changes: DataFrame, epoch: str, query: Callable[[DataFrame], DataFrame], epochs: list[int]) -> DataFrame:
    """Results of ``query`` over the multiset as of each epoch (batch form, for a stated list of epochs)."""
    out = None
    data = [c for c in changes.columns if c not in (epoch, DIFF)]
    for e in epochs:
        as_of = Collection(changes.where(F.col(epoch) <= e).select(*data, DIFF)).consolidate().df
        one = query(as_of).withColumn(epoch, F.lit(e).cast("bigint"))
        out = one if out is None else out.unionByName(one)
    return out


def windowed_counts(events: DataFrame, time: str, width: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Counts per tumbling window and key; works on streams (watermarked) and tables alike."""
    at = events.withColumn("__t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        at = at.withWatermark("__t", late)
    return at.groupBy(F.window("__t", width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
