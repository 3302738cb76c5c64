"""Tables and derived inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str) -> Column:
    """Money as whole cents: sums are exact in any order."""
    return F.round(F.col(column) * 100).cast("bigint")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with whole-number columns: ok, pk, sk, ln, qty, price, disc."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_linenumber").cast("bigint").alias("ln"), F.col("l_quantity").cast("bigint").alias("qty"),
        cents("l_extendedprice").alias("price"), cents("l_discount").alias("disc"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )


LINES = "(select l_orderkey ok, l_partkey pk, l_suppkey sk, l_linenumber::bigint ln, l_quantity::bigint qty, round(l_extendedprice*100)::bigint price, round(l_discount*100)::bigint disc, l_returnflag flag, l_linestatus status from lineitem)"

LINE_ORDER = ("ok", "ln", "pk", "sk", "qty", "price", "disc")


def order_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: ok, a (part keys) and b (quantities) as lists in line order."""
    entry = F.struct(*LINE_ORDER)
    held = lines(spark, sf_dir).groupBy("ok").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return held.select("ok", F.transform("e", lambda x: x["pk"]).alias("a"), F.transform("e", lambda x: x["qty"]).alias("b"))


ORDER_LISTS = f"(select ok, list(pk order by ok, ln, pk, sk, qty, price, disc) a, list(qty order by ok, ln, pk, sk, qty, price, disc) b from {LINES} group by ok)"


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges between parts that follow one another in an order."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return e.where("dst is not null and src <> dst").distinct()


GRAPH = "(select distinct src, dst from (select l_partkey src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) dst from lineitem) where dst is not null and src <> dst)"
