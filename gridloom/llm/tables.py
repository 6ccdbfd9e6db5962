"""Session helpers of the operators: Arrow batch size, shared scratch tables, folds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.session import scratch, ship, small_batches, table

__all__ = ["crc_fold", "ready", "stored", "table"]


def ready(spark: SparkSession) -> None:
    """Send the package to the executors, and keep the Arrow batches of whole texts small."""
    ship(spark)
    small_batches(spark)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder named by spark.checkpoint.dir and read it back, so that a lost executor
    costs no recomputation and rows keep the numbers they were given."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_fold(key: Column, folds: int) -> Column:
    """crc32(key as text) modulo folds; null for a null key."""
    return F.crc32(key.cast("string")) % F.lit(folds)
