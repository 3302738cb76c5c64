"""Per-row list algebra as Column functions: everything stays inside one projection, nothing is exploded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def iota(n: Column) -> Column:
    """[0, n); empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))


def fold(a: Column, seed: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(a, seed, step)


def fold_add(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)


def fold_mul(a: Column) -> Column:
    return F.aggregate(a, F.lit(1).cast("bigint"), lambda x, y: x * y)


def fold_min(a: Column) -> Column:
    """The largest value where the list is empty."""
    return F.coalesce(F.array_min(a), F.lit((1 << 63) - 1))


def fold_max(a: Column) -> Column:
    return F.coalesce(F.array_max(a), F.lit(0).cast("bigint"))


def all_of(a: Column, test: Fn) -> Column:
    return F.forall(a, test)


def any_of(a: Column, test: Fn) -> Column:
    return F.exists(a, test)


def fold_scan(a: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out_type: str) -> Column:
    """Walk a list with a state; each step gives the next state and an output. Returns struct(state, out)."""
    start = F.struct(state.alias("state"), F.array().cast(f"array<{out_type}>").alias("out"))

    def go(acc: Column, x: Column) -> Column:
        nxt, out = step(acc["state"], x)
        return F.struct(nxt.alias("state"), F.concat(acc["out"], F.array(out.cast(out_type))).alias("out"))

    return F.aggregate(a, start, go)


def scan(a: Column, seed: Column, step: Callable[[Column, Column], Column], out_type: str = "bigint") -> Column:
    """Inclusive prefix results."""

    def both(s: Column, x: Column) -> tuple[Column, Column]:
        v = step(s, x)
        return v, v

    return fold_scan(a, seed.cast(out_type), both, out_type)["out"]


def scan_add(a: Column) -> Column:
    return scan(a, F.lit(0), lambda s, x: s + x)


def scan_mul(a: Column) -> Column:
    return scan(a, F.lit(1), lambda s, x: s * x)


def scan_max(a: Column, kind: str = "bigint") -> Column:
    """Prefix maxima."""
    return scan(a, F.lit(None), lambda s, x: F.greatest(s, x), kind)


def scan_min(a: Column, kind: str = "bigint") -> Column:
    return scan(a, F.lit(None), lambda s, x: F.least(s, x), kind)


def scan_all(a: Column) -> Column:
    """Whether all so far are true (or nonzero)."""
    return scan(a, F.lit(True), lambda s, x: s & x.cast("boolean"), "boolean")


def scan_any(a: Column) -> Column:
    return scan(a, F.lit(False), lambda s, x: s | x.cast("boolean"), "boolean")


def shift(a: Column, n: int, fill: Column) -> Column:
    """Drop the last n, put n fills in front."""
    return F.transform(a, lambda _, i: F.when(i < n, fill).otherwise(F.get(a, i - n)))


def filter_by(a: Column, mask: Column) -> Column:
    """Values whose mask entry is true."""
    pairs = F.arrays_zip(a.alias("v"), mask.alias("m"))
    return F.transform(F.filter(pairs, lambda p: p["m"]), lambda p: p["v"])


def positions(mask: Column) -> Column:
    """Positions of true entries."""
    return F.filter(F.transform(mask, lambda m, i: F.when(m, i.cast("bigint"))), lambda p: p.isNotNull())


def gather(idx: Column, hay: Column) -> Column:
    return F.transform(idx, lambda i: F.get(hay, i.cast("int")))


def zip_lists(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("_0"), y.alias("_1")))


def transpose(a: Column, fields: list[str]) -> Column:
    """List of products to product of lists."""
    lane = lambda f: F.transform(a, lambda x: x[f]).alias(f)
    return F.struct(*map(lane, fields))


def chunk(a: Column, k: int) -> Column:
    """Rows of k; the length must divide (see ``effect.chunk``)."""
    n = F.size(a)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / k).cast("int")), lambda i: F.slice(a, i * k + 1, k))).otherwise(F.array().cast("array<array<bigint>>"))


def append(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def enlist(x: Column) -> Column:
    return F.array(x)


def cap_list(x: Column, a: Column) -> Column:
    """Pair a value with each list element."""
    return F.transform(a, lambda y: F.struct(x.alias("_0"), y.alias("_1")))


def slices(ranges: Column, hay: Column) -> Column:
    """The sublists [lo, hi) of ``hay``."""
    return F.transform(ranges, lambda r: F.slice(hay, r["lo"].cast("int") + 1, (r["hi"] - r["lo"]).cast("int")))


def flatten_ranges(a: Column) -> Column:
    """Of a list of lists: struct(ranges, flat)."""
    ends = scan_add(F.transform(a, lambda x: F.size(x).cast("bigint")))
    ranges = F.transform(ends, lambda e, i: F.struct((e - F.size(F.get(a, i))).alias("lo"), e.alias("hi")))
    return F.struct(ranges.alias("ranges"), F.flatten(a).alias("flat"))


def find(needles: Column, hay: Column) -> Column:
    """[lo, hi) of each needle in a sorted list."""
    count = lambda f: F.size(F.filter(hay, f)).cast("bigint")
    return F.transform(needles, lambda v: F.struct(count(lambda h: h < v).alias("lo"), count(lambda h: h <= v).alias("hi")))


def group(a: Column) -> Column:
    """Stable per-row grouping of a list of struct(k, v): list of struct(k, list of v), keys ascending."""
    keys = F.array_sort(F.array_distinct(F.transform(a, lambda p: p["k"])))
    return F.transform(keys, lambda k: F.struct(k.alias("k"), F.transform(F.filter(a, lambda p: p["k"] == k), lambda p: p["v"]).alias("vs")))


def xprod(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(x.alias("_0"), y.alias("_1")))))


def take(a: Column, n) -> Column:
    return F.slice(a, 1, n)


def head(a: Column) -> Column:
    """First element; fails on an empty list (see ``effect.get``)."""
    return F.element_at(a, 1)


def intersect_sorted(a: Column, b: Column) -> Column:
    """Positions (in a, in b) of equal elements, with the cross product of equal runs."""
    at = F.flatten(F.transform(a, lambda x, i: F.transform(F.filter(F.transform(b, lambda y, j: F.struct(y.alias("y"), j.cast("bigint").alias("j"))), lambda t: t["y"] == x), lambda t: F.struct(i.cast("bigint").alias("i"), t["j"].alias("j")))))
    return at
