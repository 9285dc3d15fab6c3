"""Robots texts and their rules as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.core import over
from pageloom.functions.robots import robots_groups
from pageloom.schemas import ROBOTS


def read_robots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROBOTS).parquet(path)


def robots_rules(robots: DataFrame) -> DataFrame:
    """``origin, group_no, agent, rule_no, allow, prefix`` of readable texts."""
    groups = (
        robots.filter(F.col("status").between(200, 299))
        .select("origin", F.posexplode(over(robots_groups, "body")).alias("group_no", "_group"))
        .select("origin", "group_no", "_group.rules", F.explode("_group.agents").alias("agent"))
    )
    return groups.select(
        "origin", "group_no", "agent", F.posexplode("rules").alias("rule_no", "_rule")
    ).select("origin", "group_no", "agent", "rule_no", "_rule.allow", "_rule.prefix")
