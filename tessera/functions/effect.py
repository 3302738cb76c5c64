"""Per-row failure as data: a fallible column is struct(err, ok), and failing rows never stop a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import arrays, sums


class Fallible:
    """A value and whether it failed. ``total`` is known when the plan is built: no fallible step led here."""

    def __init__(self, ok: Column, err: Column | None = None):
        self.total = err is None
        self.err = F.lit(False) if err is None else F.coalesce(err, F.lit(False))
        self.ok = ok if err is None else F.when(~self.err, ok)

    def then(self, f) -> Fallible:
        """Apply a step (Column -> Column or Fallible); an earlier failure stays one."""
        out = f(self.ok)
        if not isinstance(out, Fallible):
            return self if out is self.ok else (Fallible(out) if self.total else Fallible(out, self.err))
        return Fallible(out.ok, out.err if self.total else self.err | out.err) if not (self.total and out.total) else Fallible(out.ok)

    def attempt(self) -> Column:
        """Sum{value | failed}: failure becomes an ordinary value."""
        return F.struct(F.when(self.err, 1).otherwise(0).cast("tinyint").alias("tag"), self.ok.alias("l0"))

    def column(self) -> Column:
        return F.struct(self.err.alias("err"), self.ok.alias("ok"))


def get(a: Column, i: Column) -> Fallible:
    return Fallible(F.get(a, i.cast("int")), (i < 0) | (i >= F.size(a)))


def head(a: Column) -> Fallible:
    return get(a, F.lit(0))


def gather(idx: Column, hay: Column) -> Fallible:
    """All or nothing: one index out of range fails the row."""
    return Fallible(arrays.gather(idx, hay), F.exists(idx, lambda i: (i < 0) | (i >= F.size(hay))))


def gather_try(idx: Column, hay: Column) -> Column:
    """Per element Sum{out of range | found}."""
    inside = lambda i: (i >= 0) & (i < F.size(hay))
    return F.transform(idx, lambda i: F.struct(inside(i).cast("tinyint").alias("tag"), F.when(~inside(i), i).alias("l0"), F.when(inside(i), F.get(hay, i.cast("int"))).alias("l1")))


def branch(x: Column, tag: Column, n: int) -> Fallible:
    return Fallible(sums.branch(x, tag, n, strict=False), (tag < 0) | (tag >= n))


def zip_lists(a: Column, b: Column) -> Fallible:
    return Fallible(arrays.zip_lists(a, b), F.size(a) != F.size(b))


def filter_by(a: Column, mask: Column) -> Fallible:
    same = F.size(a) == F.size(mask)
    return Fallible(F.when(same, arrays.filter_by(a, mask)), ~same)


def slices(ranges: Column, hay: Column) -> Fallible:
    bad = F.exists(ranges, lambda r: (r["lo"] < 0) | (r["hi"] < r["lo"]) | (r["hi"] > F.size(hay)))
    return Fallible(F.when(~bad, arrays.slices(ranges, hay)), bad)


def chunk(a: Column, k: int) -> Fallible:
    return Fallible(arrays.chunk(a, k), F.size(a) % k != 0)


def sequence(**fields: Fallible) -> Fallible:
    """A product fails if any field does."""
    err = None
    for f in fields.values():
        if not f.total:
            err = f.err if err is None else err | f.err
    return Fallible(F.struct(*(f.ok.alias(k) for k, f in fields.items())), err)


def traverse(a: Column, f) -> Fallible:
    """A list of fallible results fails if any element does."""
    run = lambda x: f(x).column()
    return Fallible(F.transform(a, lambda x: run(x)["ok"]), F.exists(a, lambda x: run(x)["err"]))
