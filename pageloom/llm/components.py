"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.session import work_dir, written


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def _stars(edges: DataFrame) -> DataFrame:
    """One round: every node's larger neighbours, then its smaller ones, are tied to the
    smallest node around. Minima are aggregates with a map-side step; a hub's rows in
    the joins are split when they are skewed."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    ).filter("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    tied = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(small.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge to another: the smallest node that it
    reaches. ``edges`` has long columns u and v; loops and NULLs are ignored.

    Alternates large and small stars until the edges no longer change; each round is a
    written table, so a lost executor costs one round at most.
    """
    folder = work_dir(edges.sparkSession)
    edges = edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    edges = written(edges.distinct(), f"{folder}/0")
    before, rounds = None, 0
    while (now := _checksum(edges)) != before:
        before, rounds = now, rounds + 1
        edges = written(_stars(edges), f"{folder}/{rounds}")
    tied = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return tied.unionByName(roots.distinct())
