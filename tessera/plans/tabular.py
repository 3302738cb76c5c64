"""Filter, group and aggregate over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def q1_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    return (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.count("*").alias("n"), F.sum(cents("l_quantity")).alias("sum_qty"), F.sum(cents("l_extendedprice")).alias("sum_price"), F.sum(cents("l_discount")).alias("sum_disc"))
    )


QUERIES = {"q1_agg": q1_agg}
ORACLE = {
    "q1_agg": """select l_returnflag, l_linestatus, count(*) n, sum(round(l_quantity*100)::bigint)::bigint sum_qty,
 sum(round(l_extendedprice*100)::bigint)::bigint sum_price, sum(round(l_discount*100)::bigint)::bigint sum_disc
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2"""
}
