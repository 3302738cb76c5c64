"""Tagged sums in row form: struct(tag, l0, l1, …) with just the tag's lane filled."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Arm = Callable[[Column], Column]


def inject(tag: int, x: Column, lane_types: Sequence[str]) -> Column:
    """A constant variant; the other lanes are typed nulls."""
    lanes = [(x if k == tag else F.lit(None)).cast(t).alias(f"l{k}") for k, t in enumerate(lane_types)]
    return F.struct(F.lit(tag).cast("tinyint").alias("tag"), *lanes)


def branch(x: Column, tag: Column, n: int, strict: bool = True) -> Column:
    """Send a value to lane ``tag`` of n; a tag out of range fails, or gives null if not ``strict``."""
    lanes = [F.when(tag == k, x).alias(f"l{k}") for k in range(n)]
    out = F.struct(tag.cast("tinyint").alias("tag"), *lanes)
    fine = (tag >= 0) & (tag < n)
    return F.when(fine, out).otherwise(F.raise_error(F.lit("tag out of range")) if strict else F.lit(None))


def match(s: Column, arms: Sequence[Arm]) -> Column:
    """Apply the arm of each variant to its lane; results share a type."""
    out = F.when(s["tag"] == 0, arms[0](s["l0"]))
    for k, arm in enumerate(arms[1:], 1):
        out = out.when(s["tag"] == k, arm(s[f"l{k}"]))
    return out


def map_variant(s: Column, k: int, f: Arm, n: int) -> Column:
    """Change one lane; the others pass through."""
    return F.struct(s["tag"].alias("tag"), *((F.when(s["tag"] == k, f(s[f"l{k}"])) if i == k else s[f"l{i}"]).alias(f"l{i}") for i in range(n)))


def unwrap(s: Column, n: int) -> Column:
    """The payload of a sum whose lanes share a type."""
    return F.coalesce(*(s[f"l{k}"] for k in range(n)))


def capture(x: Column, s: Column, n: int) -> Column:
    """Pair a value with whichever lane is filled."""
    return F.struct(s["tag"].alias("tag"), *(F.when(s["tag"] == k, F.struct(x.alias("_0"), s[f"l{k}"].alias("_1"))).alias(f"l{k}") for k in range(n)))


def unweave(a: Column, n: int) -> Column:
    """A list of sums as its tags and one list per lane."""
    lane = lambda k: F.transform(F.filter(a, lambda x: x["tag"] == k), lambda x: x[f"l{k}"]).alias(f"l{k}")
    return F.struct(F.transform(a, lambda x: x["tag"]).alias("tags"), *map(lane, range(n)))


def weave(s: Column, n: int) -> Column:
    """Inverse of ``unweave``: the kth entry of a tag takes that lane's next value."""
    nth = lambda i, k: F.size(F.filter(F.slice(s["tags"], F.lit(1), i + 1), lambda t: t == k)) - 1
    return F.transform(s["tags"], lambda t, i: F.struct(t.alias("tag"), *(F.when(t == k, F.get(s[f"l{k}"], nth(i, k))).alias(f"l{k}") for k in range(n))))


def split(df: DataFrame, s: str, n: int, pos: str = "pos") -> list[DataFrame]:
    """The lanes as frames of their own, in source order (pos kept)."""
    return [df.where(F.col(s)["tag"] == k).select(pos, F.col(s)[f"l{k}"].alias("value")) for k in range(n)]


partition = split


def merge(tags: DataFrame, lanes: Sequence[DataFrame], pos: str = "pos", tag: str = "tag") -> DataFrame:
    """Put lane frames back in source order: the kth row of a tag takes that lane's kth value.

    Ranks are taken within a tag, so the work is spread over tags only; lanes that still carry their
    source positions should be joined on those instead.
    """
    rank = F.row_number().over(W.partitionBy(tag).orderBy(pos))
    held = tags.withColumn("__rank", rank)
    all_lanes = None
    for k, lane in enumerate(lanes):
        r = lane.select(F.lit(k).alias(tag), F.row_number().over(W.partitionBy(F.lit(k)).orderBy(pos)).alias("__rank"), "value")
        all_lanes = r if all_lanes is None else all_lanes.unionByName(r)
    return held.join(all_lanes, [tag, "__rank"]).drop("__rank")


def some(x: Column) -> Column:
    """An option is a nullable column."""
    return x


def default(x: Column, value: Column) -> Column:
    return F.coalesce(x, value)
