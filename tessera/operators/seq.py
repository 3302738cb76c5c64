"""Ordered columns as DataFrames: the order is data (key columns), never the physical row order.

Everything that runs along the whole order (positions, running aggregates, lags, lower-bound searches)
works in two levels: rows are range-partitioned by the order once, each range is windowed by itself,
and the ranges' totals (one row per range) are carried on to the later ones. No single task ever sees
all rows. The range of a row is materialised, so both levels agree on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.materialise import materialise, rows_per_partition

RANGE = "__range"


def _ranged(df: DataFrame, order: Sequence[Column], ranges: int | None) -> DataFrame:
    n = ranges or rows_per_partition(df.sparkSession)
    return materialise(df.repartitionByRange(n, *order).withColumn(RANGE, F.spark_partition_id()))


def _carried(ranged: DataFrame, totals: dict[str, Column], combine) -> DataFrame:
    """One row per range: the combination of all earlier ranges' totals (null for the first)."""
    per = ranged.groupBy(RANGE).agg(*(c.alias(k) for k, c in totals.items()))
    before = W.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    return per.select(RANGE, *(combine(k).over(before).alias(f"__{k}") for k in totals))


def with_position(df: DataFrame, *order: Column, name: str = "pos", ranges: int | None = None) -> DataFrame:
    """Number the rows 0, 1, … along ``order`` (give a full key: ties are numbered in any order)."""
    ranged = _ranged(df, order, ranges)
    carried = _carried(ranged, {"n": F.count("*")}, F.sum)
    rank = F.row_number().over(W.partitionBy(RANGE).orderBy(*order))
    return ranged.join(F.broadcast(carried), RANGE).withColumn(name, (F.coalesce("__n", F.lit(0)) + rank - 1).cast("bigint")).drop(RANGE, "__n")


def running(df: DataFrame, value: Column, *order: Column, how: str = "sum", name: str = "running", ranges: int | None = None) -> DataFrame:
    """Inclusive prefix ``sum``, ``min`` or ``max`` of ``value`` along ``order``."""
    agg = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    both = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}[how]
    ranged = _ranged(df.withColumn("__v", value), order, ranges)
    carried = _carried(ranged, {"t": agg("__v")}, agg)
    own = agg("__v").over(W.partitionBy(RANGE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = F.when(F.col("__t").isNull(), own).otherwise(both(own, F.col("__t")))
    return ranged.join(F.broadcast(carried), RANGE).withColumn(name, out).drop(RANGE, "__t", "__v")


def shift(df: DataFrame, value: str, n: int, pos: str = "pos", fill=0, name: str = "shifted") -> DataFrame:
    """The value ``n`` positions earlier, ``fill`` before the first: an equi-join on the position."""
    other = df.select((F.col(pos) + n).alias(pos), F.col(value).alias("__s"))
    return df.join(other, pos, "left").withColumn(name, F.when(F.col(pos) < n, F.lit(fill)).otherwise(F.col("__s"))).drop("__s")


def gather(positions: DataFrame, source: DataFrame, at: str = "at", pos: str = "pos") -> DataFrame:
    """The source row at each position; positions out of range are left out (see ``gather_try``)."""
    return positions.join(source.withColumnRenamed(pos, at), at)


def gather_try(positions: DataFrame, source: DataFrame, at: str = "at", pos: str = "pos") -> DataFrame:
    """As ``gather``, keeping positions out of range; ``found`` tells them apart."""
    held = source.withColumnRenamed(pos, at).withColumn("__hit", F.lit(True))
    return positions.join(held, at, "left").withColumn("found", F.coalesce("__hit", F.lit(False))).drop("__hit")


def take(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    return df.where(F.col(pos) < n)


def skip(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    return df.where(F.col(pos) >= n).withColumn(pos, F.col(pos) - n)


def reverse(df: DataFrame, pos: str = "pos") -> DataFrame:
    last = df.agg(F.max(pos).alias("__last"))
    return df.join(F.broadcast(last)).withColumn(pos, F.col("__last") - F.col(pos)).drop("__last")


def cat(*parts: DataFrame, pos: str = "pos") -> DataFrame:
    """Same-shaped columns one after the other: later parts' positions go on from the earlier ones'."""
    out, offset = None, F.lit(0)
    for p in parts:
        size = p.agg(F.coalesce(F.max(pos) + 1, F.lit(0)).alias("__n"))
        moved = p.withColumn(pos, F.col(pos) + offset) if out is None else p.join(F.broadcast(before)).withColumn(pos, F.col(pos) + F.col("__n")).select(*p.columns)
        before = size if out is None else before.union(size).agg(F.sum("__n").alias("__n"))
        out = moved if out is None else out.unionByName(moved)
    return out


def iota(spark, n: int, name: str = "pos") -> DataFrame:
    return spark.range(n).withColumnRenamed("id", name)


def spread(df: DataFrame, count: Column, name: str = "copy") -> DataFrame:
    """Each row as often as its count says, copies numbered from 0."""
    return df.withColumn(name, F.explode(F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))


def where_positions(df: DataFrame, mask: Column, pos: str = "pos") -> DataFrame:
    return df.where(mask).select(pos)


def view_range(df: DataFrame, low: int, high: int, pos: str = "pos") -> DataFrame:
    return df.where((F.col(pos) >= low) & (F.col(pos) < high))


def lower_bound(queries: DataFrame, target: DataFrame, key: str, name: str = "at", upper: bool = False, ranges: int | None = None) -> DataFrame:
    """Of each query row, how many target keys are smaller (``upper``: or equal): its place in the sorted target."""
    columns = queries.columns
    q = queries.select(F.struct(*columns).alias("__row"), F.col(key).alias("__k"), F.lit(int(upper)).alias("__side"), F.lit(0).alias("__one"))
    t = target.select(F.lit(None).cast(q.schema["__row"].dataType).alias("__row"), F.col(key).alias("__k"), F.lit(int(not upper)).alias("__side"), F.lit(1).alias("__one"))
    done = running(q.unionByName(t), F.col("__one"), F.col("__k"), F.col("__side"), name=name, ranges=ranges)
    return done.where(F.col("__row").isNotNull()).select("__row.*", F.col(name).cast("bigint").alias(name))


def equal_range(queries: DataFrame, target: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """Each query with lo and hi, the half-open run of its key in the sorted target."""
    low = lower_bound(queries, target, key, "lo", ranges=ranges)
    return lower_bound(low, target, key, "hi", upper=True, ranges=ranges)


def sessions(df: DataFrame, at: Column, gap, *, by: Sequence[str], order: Sequence[Column], name: str = "session") -> DataFrame:
    """Number each group's sessions: a new one begins where the step from the row before exceeds ``gap``.

    The row before the first counts as 0, as with a zero-filled shift.
    """
    w = W.partitionBy(*by).orderBy(*order)
    step = at - F.lag(at, 1, 0).over(w)
    return df.withColumn("__new", (step > gap).cast("bigint")).withColumn(name, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def top_per_group(df: DataFrame, n: int, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, rank.cast("bigint")).where(F.col(name) <= n)


def flatten(lists: DataFrame, row: str, column: str, pos: str = "pos", ranges: int | None = None) -> DataFrame:
    """The elements of a ragged column in order: (row, at, value, pos), pos over the whole flat column."""
    flat = lists.select(F.col(row), F.posexplode(column).alias("at", "value")).withColumn("at", F.col("at").cast("bigint"))
    return with_position(flat, F.col(row), F.col("at"), name=pos, ranges=ranges)


def list_ranges(lists: DataFrame, row: str, column: str, ranges: int | None = None) -> DataFrame:
    """Of each row, the half-open range [lo, hi) of its elements in the flat column."""
    sized = lists.select(row, F.size(column).cast("bigint").alias("__n"))
    return running(sized, F.col("__n"), F.col(row), name="hi", ranges=ranges).select(row, (F.col("hi") - F.col("__n")).alias("lo"), "hi")


def nest(flat: DataFrame, bounds: DataFrame, row: str = "row", value: str = "value", pos: str = "pos", ranges: int | None = None) -> DataFrame:
    """Lists from a flat column and rows with [lo, hi): the inverse of ``flatten`` and ``list_ranges``.

    Bounds that tile the column are looked up by search, so nothing is joined by range; rows of no
    elements are empty lists.
    """
    starts = bounds.where("lo < hi").select(F.col(row), F.col("lo").alias("k"))
    place = lower_bound(flat.withColumn("k", F.col(pos)), starts.select("k"), "k", "__owner", upper=True, ranges=ranges)
    numbered = with_position(starts, F.col("k"), name="__owner", ranges=ranges).select(row, (F.col("__owner") + 1).alias("__owner"))
    lists = place.join(numbered, "__owner").groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: x[value]).alias("list"))
    return bounds.select(row).join(lists, row, "left").withColumn("list", F.coalesce("list", F.array().cast(lists.schema["list"].dataType)))


def nest_stride(flat: DataFrame, stride: int, value: str = "value", pos: str = "pos") -> DataFrame:
    """Rectangular lists of ``stride`` elements; fails if the column's length does not divide."""
    lists = flat.groupBy(F.floor(F.col(pos) / stride).alias("row")).agg(F.array_sort(F.collect_list(F.struct(pos, value))).alias("l"))
    whole = F.assert_true(F.size("l") == stride, F.lit("length does not divide"))
    return lists.select("row", F.when(whole.isNull(), F.transform("l", lambda x: x[value])).alias("list"))


def enlist(df: DataFrame, value: str, pos: str = "pos") -> DataFrame:
    """The whole column as one row's list: for columns that fit a row."""
    return df.agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: x[value]).alias("list"))


def unlist(lists: DataFrame, column: str = "list") -> DataFrame:
    """The elements of a one-row ragged column; fails on more rows than one."""
    one = lists.groupBy().agg(F.count("*").alias("n"), F.first(column).alias("l"))
    fine = F.assert_true(F.col("n") == 1, F.lit("not one row"))
    return one.select(F.posexplode(F.when(fine.isNull(), F.col("l"))).alias("pos", "value")).withColumn("pos", F.col("pos").cast("bigint"))
