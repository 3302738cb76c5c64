"""Writing an intermediate result once, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = f"/tmp/checkpoints/{uuid.uuid4().hex}"


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = LOCAL_DEFAULT
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(base)
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base.rstrip("/")


def materialise(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet and read again: cuts the lineage and survives lost executors."""
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_per_partition(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
