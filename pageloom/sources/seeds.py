"""Seed lists, one URL per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.core import strip_ws


def clean_seed_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Strip lines and drop blank ones; duplicates and other columns stay."""
    return (
        lines.withColumn("seed", strip_ws(F.col(line))).filter(F.col("seed") != "").drop(line)
    )


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """``seeds(seed_id, seed)`` of text files.

    Ids are unique and grow along each file split; they need no global sort.
    """
    lines = clean_seed_lines(spark.read.text(path))
    return lines.select(F.monotonically_increasing_id().alias("seed_id"), "seed")
