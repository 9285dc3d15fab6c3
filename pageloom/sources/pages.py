"""Captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.schemas import PAGES


def read_pages(spark: SparkSession, path: str, schema: str = PAGES) -> DataFrame:
    """Captures as stored. Plans that ask for no HTML read none: the column is
    pruned from the parquet scan."""
    return spark.read.schema(schema).parquet(path)
