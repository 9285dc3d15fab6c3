"""What several operators share: inputs, row marks, work tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from weakref import WeakSet

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.session import work_dir, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: WeakSet = WeakSet()  # contexts whose executors have this package


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, so they need no copy of their own."""
    context = spark.sparkContext
    if context in _SHIPPED:
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="pageloom-"), "pageloom_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                file = os.path.join(folder, name)
                out.write(file, os.path.relpath(file, os.path.dirname(here)))
    context.addPyFile(archive)
    _SHIPPED.add(context)


def over_batches(
    df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(step, schema)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; all other characters stay as they are."""
    return F.translate(text, _UPPER, _UPPER.lower())


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; NULL keys count as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in a new folder that all nodes share."""
    return written(df, f"{work_dir(df.sparkSession)}/{name}")
