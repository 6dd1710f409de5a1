"""Parquet tables of a data folder, as DataFrames or temporary views.

Paths go to Spark's reader unchanged, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, *names: str) -> None:
    """Create or replace temporary views of the tables named."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
