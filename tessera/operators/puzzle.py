"""Sudoku by constraint propagation: candidates of a cell lose the values that row, column and box have settled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.fixpoint import iterate


def board(spark: SparkSession, text: str) -> DataFrame:
    """(row, col, val) candidates of an 81-character board; 0 or . is an open cell."""
    cells = spark.createDataFrame([(i // 9, i % 9, int(c) if c.isdigit() else 0) for i, c in enumerate(text)], "row int, col int, clue int").coalesce(1)
    return cells.select("row", "col", F.explode(F.when(F.col("clue") > 0, F.array("clue")).otherwise(F.sequence(F.lit(1), F.lit(9)))).alias("val"))


def propagate(candidates: DataFrame) -> DataFrame:
    """The candidates left when nothing more follows from settled cells."""
    box = (F.floor(F.col("row") / 3) * 3 + F.floor(F.col("col") / 3)).cast("int")

    def step(state: DataFrame) -> DataFrame:
        settled = state.groupBy("row", "col").agg(F.count("*").alias("n"), F.first("val").alias("val")).where("n = 1").select("row", "col", "val")
        unit = lambda u, k: F.struct(F.lit(u).alias("u"), k.alias("k"))
        units = F.array(unit("row", F.col("row")), unit("col", F.col("col")), unit("box", box))
        taken = settled.select(F.col("row").alias("r0"), F.col("col").alias("c0"), F.explode(units).alias("unit"), "val")
        mine = candidates.select("row", "col", "val", F.explode(units).alias("unit"))
        gone = mine.join(taken, ["unit", "val"]).where("row <> r0 or col <> c0").select("row", "col", "val").distinct()
        return candidates.join(gone, ["row", "col", "val"], "left_anti")

    mark = lambda s: s.agg(F.count("*"), F.sum(F.xxhash64("row", "col", "val").cast("decimal(38,0)")))
    return iterate(candidates, step, lambda a, b: mark(b).exceptAll(mark(a)))


def histogram(candidates: DataFrame) -> DataFrame:
    """How many cells have each number of candidates."""
    return candidates.groupBy("row", "col").agg(F.count("*").alias("candidates")).groupBy("candidates").agg(F.count("*").alias("cells"))
