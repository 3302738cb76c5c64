"""Readers and writers: edge lists, separated tables with RFC 3339 dates, literals, and nested columns as Parquet."""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalar import TYPES


def column(spark: SparkSession, tag: str, values: Sequence, name: str = "value", pos: str = "pos") -> DataFrame:
    """A literal column of an interpretation tag (see ``functions.scalar.TYPES``), with positions."""
    schema = T.StructType([T.StructField(pos, T.LongType(), False), T.StructField(name, T._parse_datatype_string(TYPES[tag]))])
    return spark.createDataFrame(list(enumerate(values)), schema)


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, time) of text files of ``src dst weight time`` lines.

    Header lines start with % or #; a line that is not four numbers is no edge.
    """
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*[%#]"))
    parts = F.split(F.trim("value"), r"\s+")
    numbers = [parts[k].try_cast("double").cast("bigint") for k in (0, 1, 3)]
    return lines.select(F.size(parts).alias("n"), *(n.alias(a) for n, a in zip(numbers, ("src", "dst", "time"), strict=True))).where("n = 4 and src is not null and dst is not null and time is not null").select("src", "dst", "time")


def adjacency(spark: SparkSession, prefix: str, parts: int | None = None) -> DataFrame:
    """(src, dst) of a binary adjacency pair: PREFIX.offsets (u64, one more than nodes) and PREFIX.targets (u32).

    The files lie where all workers can open them; each task maps its own range of nodes.
    """
    offsets = np.memmap(f"{prefix}.offsets", "<u8", "r") if os.path.getsize(f"{prefix}.offsets") else np.zeros(1, "<u8")
    nodes, schema = len(offsets) - 1, "src bigint, dst bigint"
    if nodes < 1:
        return spark.createDataFrame([], schema)

    def read(batches):
        starts = np.memmap(f"{prefix}.offsets", "<u8", "r")
        targets = np.memmap(f"{prefix}.targets", "<u4", "r") if int(starts[-1]) else np.zeros(0, "<u4")
        for batch in batches:
            ids = batch["id"].to_numpy()
            for b in range(0, len(ids), 4096):
                mine = ids[b : b + 4096]
                lo, hi = starts[mine].astype(np.int64), starts[mine + 1].astype(np.int64)
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(int((hi - lo).sum()))
                yield pd.DataFrame({"src": np.repeat(mine, hi - lo), "dst": targets[at].astype(np.int64)})

    return spark.range(0, nodes, numPartitions=parts or max(1, min(nodes, spark.sparkContext.defaultParallelism * 4))).mapInPandas(read, schema)


def millis(text: Column) -> Column:
    """RFC 3339 text as milliseconds of the epoch."""
    return F.unix_millis(F.to_timestamp(text))


def _barred(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", "|").option("comment", "#").option("inferSchema", False).csv(path)


def _by_place(df: DataFrame, **places: int) -> DataFrame:
    """Columns by place in the file; ``ts_ms`` is a date, the rest are numbers (empty: null)."""
    names = df.columns
    pick = lambda name, k: (millis(F.col(f"`{names[k]}`")) if name == "ts_ms" else F.col(f"`{names[k]}`").try_cast("bigint")).alias(name)
    return df.select(*(pick(n, k) for n, k in places.items()))


def path_queries(spark: SparkSession, path: str) -> DataFrame:
    return _by_place(_barred(spark, path), src=0, dst=1, start_ms=2, end_ms=3)


def knows(spark: SparkSession, path: str) -> DataFrame:
    return _by_place(_barred(spark, path), src=0, dst=1, ts_ms=2)


def comments(spark: SparkSession, path: str) -> DataFrame:
    """id, creator, link (the post or comment replied to), ts_ms."""
    raw = _by_place(_barred(spark, path), id=0, ts_ms=1, creator=6, post=8, comment=9)
    return raw.select("id", "creator", F.coalesce("post", "comment").alias("link"), "ts_ms")


def posts(spark: SparkSession, path: str) -> DataFrame:
    return _by_place(_barred(spark, path), id=0, ts_ms=2, creator=8, forum=9).select("id", "creator", "forum", "ts_ms")


def forums(spark: SparkSession, path: str) -> DataFrame:
    return _by_place(_barred(spark, path), id=0, ts_ms=2)


def save(df: DataFrame, path: str) -> None:
    """Nested columns keep their types: products, sums and lists are structs and arrays."""
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
