"""Multisets with signed multiplicities: frames with a ``diff`` column, consolidated by need."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIFF = "diff"


class Collection:
    """Rows with a signed count. Operators are linear unless they say otherwise."""

    def __init__(self, df: DataFrame):
        self.df = df if DIFF in df.columns else df.withColumn(DIFF, F.lit(1).cast("bigint"))
        self.data = [c for c in self.df.columns if c != DIFF]

    def map(self, **columns: Column) -> Collection:
        return Collection(self.df.select(*(c.alias(n) for n, c in columns.items()), DIFF))

    def filter(self, test: Column) -> Collection:
        return Collection(self.df.where(test))

    def flat_map(self, rows: Column) -> Collection:
        """``rows``: array of struct; its fields become the data."""
        return Collection(self.df.select(F.explode(rows).alias("r"), DIFF).select("r.*", DIFF))

    def concat(self, *others: Collection) -> Collection:
        out = self.df
        for o in others:
            out = out.unionByName(o.df)
        return Collection(out)

    def negate(self) -> Collection:
        return self.weigh(F.lit(-1))

    def weigh(self, factor: Column) -> Collection:
        """Multiply counts (``explode`` into weights)."""
        return Collection(self.df.withColumn(DIFF, (F.col(DIFF) * factor).cast("bigint")))

    def consolidate(self) -> Collection:
        return Collection(self.df.groupBy(*self.data).agg(F.sum(DIFF).alias(DIFF)).where(F.col(DIFF) != 0))

    def threshold(self, f: Callable[[Column], Column]) -> Collection:
        """New count from the consolidated one (not linear)."""
        return Collection(self.consolidate().df.withColumn(DIFF, f(F.col(DIFF)).cast("bigint")).where(F.col(DIFF) != 0))

    def distinct(self) -> Collection:
        return self.threshold(lambda n: (n > 0).cast("bigint"))

    def count(self, *keys: str, name: str = "n") -> Collection:
        """Each key with its multiplicity as data."""
        return Collection(self.df.groupBy(*keys).agg(F.sum(DIFF).alias(name)).where(F.col(name) != 0))

    def join(self, other: Collection, on: str | Sequence[str]) -> Collection:
        """Inner join; counts multiply."""
        right = other.df.withColumnRenamed(DIFF, "__d")
        joined = self.df.join(right, on)
        return Collection(joined.withColumn(DIFF, F.col(DIFF) * F.col("__d")).drop("__d"))

    def semijoin(self, keys: Collection, on: str | Sequence[str]) -> Collection:
        """Rows whose key is present, multiplied by its count."""
        names = [on] if isinstance(on, str) else list(on)
        return self.join(Collection(keys.df.select(*names, DIFF)), names)

    def antijoin(self, keys: Collection, on: str | Sequence[str]) -> Collection:
        """Rows whose key is not present (its consolidated count is not positive)."""
        names = [on] if isinstance(on, str) else list(on)
        held = Collection(keys.df.select(*names, DIFF)).distinct()
        return Collection(self.df.join(held.df.drop(DIFF), names, "left_anti"))

    def minus(self, other: Collection) -> Collection:
        return self.concat(other.negate()).consolidate()

    def reduce(self, keys: Sequence[str], **aggs: Column) -> Collection:
        """Aggregates over the consolidated, present rows of each key."""
        return Collection(self.consolidate().df.where(F.col(DIFF) > 0).groupBy(*keys).agg(*(c.alias(n) for n, c in aggs.items())))
