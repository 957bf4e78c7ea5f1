"""Reading the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table that lies as `name.parquet` in the directory, a file or a folder."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
