"""Parquet tables kept side by side in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name``: a parquet file, or a folder of them, under ``folder``."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
