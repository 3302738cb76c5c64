"""What the operators share: tables, Arrow schemas, and the shared folder for written intermediates."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.operators.materialise import checkpoint_folder, materialise


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_type(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share; in tests a local one."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


#: Write to the shared folder and read again: cuts the lineage, and survives lost executors.
written = materialise


def fold_bucket(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


#: Bits of the filters that spare most rows a shuffle: sixteen a key, from 8 kB up to 32 MB. Beyond that
#: (some sixteen million keys) a filter still never loses a key, and spares fewer rows the shuffle.
FILTER_BITS = (1 << 16, 1 << 28)


def filter_bits(keys: int) -> int:
    return min(max(FILTER_BITS[0], 1 << (16 * keys).bit_length()), FILTER_BITS[1])


def _bit(values: np.ndarray, bits: int) -> np.ndarray:
    h = values.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def _bits_of(size: int):
    def run(batches):
        bits = np.zeros(size // 8, np.uint8)
        for b in batches:
            slot = _bit(b.column(0).to_numpy(zero_copy_only=False), size)
            np.bitwise_or.at(bits, slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    return run


def id_filter(ids: DataFrame, size: int | None = None) -> np.ndarray:
    """A bitmap that has the bit of every id of the (one, bigint, non-null) column."""
    size = size or filter_bits(ids.count())
    bits = np.zeros(size // 8, np.uint8)
    for row in ids.coalesce(16).mapInArrow(_bits_of(size), "bits binary").toLocalIterator():
        bits |= np.frombuffer(row[0], np.uint8)
    return bits


def maybe_in(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may be among the ids of the filter."""
    slot = _bit(values, 8 * len(bits))
    return ((bits[slot >> 3] >> (slot & 7)) & 1).astype(bool)


def in_filter(df: DataFrame, key: str, ids: DataFrame) -> Column:
    """Whether a row's key may be among ``ids`` (one, bigint, non-null column); false for rows without a key."""
    sent = df.sparkSession.sparkContext.broadcast(id_filter(ids).tobytes())

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        found = maybe_in(np.frombuffer(sent.value, np.uint8), keys.fillna(0).to_numpy(dtype=np.int64))
        return pd.Series(found & keys.notna().to_numpy())

    return maybe(F.col(key).cast("bigint"))


def without_filter(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is surely not among ``ids`` (one, bigint, non-null column), and the others."""
    flag = in_filter(df, key, ids)
    return df.where(~flag), df.where(flag)


#: A key with more rows than this, and than this share of all, is not shuffled to one task.
HOT_ROWS = 10_000
HOT_SHARE = 100_000


def join_groups(df: DataFrame, groups: DataFrame, key: str, rows: str, how: str = "inner") -> DataFrame:
    """``df`` with the columns of ``groups`` (written; a row per key, ``rows`` of it in ``df``).

    The hot keys are broadcast: they are fewer than HOT_SHARE, since each holds more than that share of the
    rows counted. The others are joined by shuffle, none of them with more rows than a task can hold.
    """
    total = groups.agg(F.sum(rows)).first()[0] or 0
    hot = groups.where(F.col(rows) > max(HOT_ROWS, total // HOT_SHARE))
    if hot.isEmpty():
        return df.join(groups, key, how)
    cold = df.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups, key, how)
    return df.join(F.broadcast(hot), key).unionByName(cold)


def without_ids(df: DataFrame, key: str, removed: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """``df`` without the rows whose key is in ``removed`` (one column); keys in ``once`` keep one row.

    Rows that a filter of bounded size shows to be in neither stay where they are; only the others are
    shuffled for the exact join. Rows without a key stay.
    """
    ids = removed.select(F.col(removed.columns[0]).cast("bigint").alias("id")).where("id is not null")
    both = ids if once is None else ids.union(once.select(F.col(once.columns[0]).cast("bigint").alias("id")).where("id is not null"))
    flag = in_filter(df, key, both)
    rest = df.where(flag).join(ids.withColumnRenamed("id", "__id").distinct(), F.col(key) == F.col("__id"), "left_anti")
    return df.where(~flag).union(rest if once is None else rest.dropDuplicates([key]))
