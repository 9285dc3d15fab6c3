"""What an earlier export holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.schemas import EXPORT


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """An export table; the domain comes from the folders, so a filter on it
    reads those domains only, and a diff reads no content column."""
    return spark.read.schema(EXPORT).parquet(path)
