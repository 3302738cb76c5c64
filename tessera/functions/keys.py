"""Structural order keys: lists and strings are ordered by length first, sums by tag first.

``structural_key(column, type)`` is a value whose native Spark order and equality are the structural
ones, at any nesting; use the same key for sorting, grouping, deduplication and searching.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def string_key(s: Column) -> Column:
    """Strings as byte lists: shorter first, then by bytes."""
    return F.struct(F.octet_length(s).alias("n"), s.cast("binary").alias("b"))


def structural_key(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.struct(F.size(x).alias("n"), F.transform(x, lambda v: structural_key(v, kind.elementType)).alias("v"))
    if isinstance(kind, T.StructType):
        return F.struct(*(structural_key(x[f.name], f.dataType).alias(f.name) for f in kind.fields))
    if isinstance(kind, T.StringType):
        return string_key(x)
    return x


def sort_list(a: Column, element: T.DataType) -> Column:
    """A list sorted structurally."""
    keyed = F.transform(a, lambda v: F.struct(structural_key(v, element).alias("k"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def dedup_list(a: Column, element: T.DataType) -> Column:
    return sort_list(F.array_distinct(a), element)
