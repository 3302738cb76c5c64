"""Joins, grouping and set operations on keyed frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def equi_positions(a: DataFrame, b: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Position pairs of equal keys, with the cross product of equal runs."""
    return a.select(key, F.col(pos).alias("pos_a")).join(b.select(key, F.col(pos).alias("pos_b")), key)


def segmented_intersect(a: DataFrame, b: DataFrame, row: str, key: str, pos: str = "pos") -> DataFrame:
    """As ``equi_positions``, within each row's segment."""
    return a.select(row, key, F.col(pos).alias("pos_a")).join(b.select(row, key, F.col(pos).alias("pos_b")), [row, key])


def group_join(probes: DataFrame, build: DataFrame, key: str, value: Column, order: Sequence[Column], name: str = "matches") -> DataFrame:
    """Each probe with the ordered list of the build side's values of its key (empty if none)."""
    lists = group_lists(build, [key], value, order, name)
    return probes.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def group_lists(df: DataFrame, keys: Sequence[str], value: Column, order: Sequence[Column], name: str = "values") -> DataFrame:
    """Stable grouping: each key's values as a list in the order of ``order``."""
    entry = F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)), value.alias("v"))
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"]).alias(name))


def semi(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return a.join(b, key, "left_semi")


def anti(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return a.join(b, key, "left_anti")


def unique(df: DataFrame, *order: Column) -> DataFrame:
    return df.distinct().orderBy(*order)


def counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def segmented_running(df: DataFrame, value: Column, by: Sequence[str], order: Sequence[Column], how: str = "sum", name: str = "running") -> DataFrame:
    agg = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    return df.withColumn(name, agg(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def segmented_shift(df: DataFrame, value: Column, n: int, by: Sequence[str], order: Sequence[Column], fill=0, name: str = "shifted") -> DataFrame:
    return df.withColumn(name, F.lag(value, n, fill).over(W.partitionBy(*by).orderBy(*order)))


def per_row_product(a: DataFrame, b: DataFrame, row: str) -> DataFrame:
    """All pairs within each row: a join on the row, so rows spread over tasks (AQE splits large ones)."""
    return a.join(b, row)
