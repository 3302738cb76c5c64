"""Scalar arithmetic with explicit machine semantics: wrapping, truncating division, IEEE division, bit keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Interpretation tags and the Spark types that hold their values.
TYPES = {"i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "u8": "smallint", "u16": "int", "u32": "bigint", "u64": "bigint", "f32": "float", "f64": "double", "bool": "boolean"}
WIDTH = {"8": 8, "16": 16, "32": 32, "64": 64}
MIN64 = -(1 << 63)


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Integer arithmetic of expressions built inside wraps instead of failing.

    The mode is taken when an expression is built, so build the whole chain inside.
    """
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def truncating_div(a: Column, b: Column) -> Column:
    """Integer quotient towards zero."""
    return F.call_function("div", a, b)


def ieee_div(a: Column, b: Column) -> Column:
    """x/0 is an infinity of x's sign, 0/0 and NaN/0 are NaN."""
    a, b = a.cast("double"), b.cast("double")
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return F.when(b != 0, a / F.when(b != 0, b)).when(F.isnan(a) | (a == 0), nan).when(a > 0, inf).otherwise(-inf)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def square(x: Column) -> Column:
    return x * x


def shift_right(x: Column, k: int) -> Column:
    """x div 2^k of the unsigned value."""
    return F.shiftrightunsigned(x, k)


def low_bits(x: Column, k: int) -> Column:
    """x mod 2^k of the unsigned value."""
    return x.bitwiseAND(F.lit((1 << k) - 1)) if k < 64 else x


def as_width(x: Column, bits: int) -> Column:
    """Keep the low bits, read as unsigned."""
    return low_bits(x.cast("bigint"), bits)


def unsigned_key(x: Column) -> Column:
    """Orders 64-bit words as unsigned numbers."""
    return x.bitwiseXOR(F.lit(MIN64))


enswizzle = deswizzle = unsigned_key


def float_bits(x: Column) -> Column:
    """Total-order key of a double: orders all values, tells -0.0 from 0.0, equals on equal NaNs."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x.cast("double")).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(F.bitwise_not(bits).bitwiseXOR(F.lit(MIN64)))


def bits_float(key: Column) -> Column:
    """The double of a total-order key."""
    bits = F.when(key >= 0, key).otherwise(F.bitwise_not(key.bitwiseXOR(F.lit(MIN64))))
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


#: 2^63, to read a signed word as the unsigned one that orders alike.
HALF = "9223372036854775808"


def order_word(x: Column, tag: str) -> Column:
    """The unsigned number that orders like a value of the tag; 64-bit words are decimals, so they order and print as such."""
    half = F.lit(HALF).cast("decimal(20,0)")
    if tag[0] == "f":
        return (float_bits(x).cast("decimal(20,0)") + half).cast("decimal(20,0)")
    if tag == "i64":
        return (x.cast("decimal(20,0)") + half).cast("decimal(20,0)")
    if tag[0] == "i":
        return (x.cast("bigint") + (1 << int(tag[1:]) - 1)).cast(TYPES["u" + tag[1:]])
    return x


def from_order_word(x: Column, tag: str) -> Column:
    signed = lambda: (x.cast("decimal(20,0)") - F.lit(HALF).cast("decimal(20,0)")).cast("bigint")
    if tag[0] == "f":
        return bits_float(signed()).cast(TYPES[tag])
    if tag == "i64":
        return signed()
    if tag[0] == "i":
        return (x.cast("bigint") - (1 << int(tag[1:]) - 1)).cast(TYPES[tag])
    return x


def blend(mask: Column, then: Column, otherwise: Column) -> Column:
    """``then`` where the mask is true (or nonzero)."""
    return F.when(mask.cast("boolean"), then).otherwise(otherwise)
