"""Text pieces and total parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split(s: Column, delimiter: str) -> Column:
    """n delimiters give n + 1 pieces; empty pieces stay."""
    return F.split(s, re.escape(delimiter), -1)


def parse_u64(s: Column) -> Column:
    """Sum{error text | number}: digits only, no sign or blank, at most 2^64 - 1."""
    digits = F.regexp_replace(s, "^0+(?=[0-9])", "")
    number = F.when(s.rlike(r"\A[0-9]+\z") & (F.length(digits) <= 20), digits.try_cast("decimal(20,0)"))
    number = F.when(number <= F.lit("18446744073709551615").cast("decimal(20,0)"), number)
    ok = number.isNotNull()
    return F.struct(F.when(ok, 1).otherwise(0).cast("tinyint").alias("tag"), F.when(~ok, s).alias("l0"), number.alias("l1"))


def words(s: Column) -> Column:
    return F.filter(F.split(s, r"[ \t\n\r]+"), lambda w: w != "")


def sum_fields(s: Column, delimiter: str = ",") -> Column:
    """Sum of the fields that parse; the others count 0."""
    return F.aggregate(F.transform(split(s, delimiter), parse_u64), F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + F.coalesce(x["l1"], F.lit(0))).cast("decimal(38,0)"))
