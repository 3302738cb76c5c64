"""Streaming queries run to the end of their input, against the same question asked of the table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators.materialise import checkpoint_folder
from tessera.plans.common import table
from tessera.plans.multisets import CHANGES, changes
from tessera.streaming.epochs import ZSetState, replay, run_changes, windowed_counts

c = F.col


def stream_zset_replay(spark, sf):
    """The event changes as a stream of files, folded batch by batch into a consolidated state."""
    base = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    source = changes(spark, sf).map(user=c("user"), kind=c("kind")).df
    source.repartition(4).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    state = ZSetState(spark, f"{base}/state", "user bigint, kind string")
    return state.version(run_changes(stream, state, f"{base}/progress"))


def stream_event_counts(spark, sf):
    """Daily counts per kind: the stream's windows that the watermark has closed, in one table."""
    base = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    counted = windowed_counts(stream, "ts", "1 day", ["event_type"])
    counted.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.unix_seconds("start").alias("start_s"), "event_type", "n")


def epoch_replay(spark, sf):
    """Distinct active (user, kind) pairs as of some days."""
    x = changes(spark, sf).df
    return replay(x, "day", lambda z: z.groupBy("kind").agg(F.count("*").alias("pairs")), [1, 5, 15, 30])


QUERIES = {f.__name__: f for f in (stream_zset_replay, stream_event_counts, epoch_replay)}
ORACLE = {
    "stream_zset_replay": f'select "user", kind, sum(d)::bigint diff from {CHANGES} group by all having sum(d) <> 0',
    "stream_event_counts": "select epoch(date_trunc('day', ts))::bigint start_s, event_type, count(*) n from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 1 hour group by all",
    "epoch_replay": f"with e as (select unnest([1, 5, 15, 30])::bigint \"day\") select kind, count(*) pairs, \"day\" from (select e.\"day\", x.\"user\", x.kind, sum(d) n from e join {CHANGES} x on x.\"day\" <= e.\"day\" group by all having sum(d) <> 0) group by kind, \"day\"",
}
