"""Reading the fixture tables, and rows that were delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of part files) of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, *key: str) -> DataFrame:
    """Redelivered rows are whole-row repeats under one id: keep one of each."""
    return df.dropDuplicates(list(key))
