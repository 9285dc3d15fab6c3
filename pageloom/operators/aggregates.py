"""Counts, first and last per key.

All are aggregates with a partial step in the scan tasks; where Spark would use
a window over one whole key, the operator says why it is not needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import work_dir, written


def pages_per_seed(saved: DataFrame, key: str = "seed") -> DataFrame:
    """A1."""
    return saved.groupBy(key).agg(F.count("*").alias("pages"))


def pages_per_domain(saved: DataFrame) -> DataFrame:
    """A1 and A2 in one pass: one row per domain and the total under NULL."""
    return saved.rollup("domain").agg(F.count("*").alias("count"))


def files_by_format(export: DataFrame) -> DataFrame:
    """A4."""
    return export.groupBy("format").agg(F.count("*").alias("files"))


def distinct_urls(urls: DataFrame, keys: tuple[str, ...] = ("seed_id", "url")) -> DataFrame:
    """A5."""
    return urls.dropDuplicates(list(keys))


def distinct_content(texts: DataFrame, text: str, id_col: str) -> DataFrame:
    """One row per distinct text with its first id and number of copies."""
    return texts.groupBy(F.sha1(text).alias("sha1")).agg(
        F.min(id_col).alias("first_id"), F.count("*").alias("copies")
    )


def first_seen(queue: DataFrame) -> DataFrame:
    """Earliest place in the queue per seed and URL."""
    return queue.groupBy("seed_id", "url").agg(F.min("ord").alias("ord"))


def page_number(saved: DataFrame, key: str, order: str | list[str], name: str = "number") -> DataFrame:
    """Running number per key by ``order`` (one or more columns), from 1.

    Rows are range-partitioned by key and order and sorted, so a key's rows lie in
    neighbouring partitions and each knows its place within its own. A key's rows in each
    partition are counted; their sums over the partitions before are the offsets. No task
    holds more than a partition, whatever a key's share of the rows and however dense its
    order values are; a window only sees one count for each partition of a key. Rows with
    equal order are numbered one after the other, in any order, and split as well; NULL is
    a key like others. The sorted rows are a work table.
    """
    orders = [order] if isinstance(order, str) else list(order)
    ranged = saved.withColumn("_tie", F.monotonically_increasing_id())
    by = [key, *orders, "_tie"]
    ranged = ranged.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    ranged = ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    ranged = written(ranged, f"{work_dir(saved.sparkSession)}/ranged")
    counts = ranged.groupBy(key, "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(key).alias("_key"),
        F.col("_part").alias("_of"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_offset"),
    )
    same = (F.col("_part") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key"))
    numbered = ranged.join(offsets, same).withColumn(name, F.col("_at") + F.col("_offset"))
    return numbered.select(*saved.columns, name)


def last_write_wins(
    writes: DataFrame, keys: tuple[str, ...] = ("domain", "out_path"), order: str = "ord"
) -> DataFrame:
    """Per output path the row written last."""
    rest = [c for c in writes.columns if c not in (*keys, order)]
    return (
        writes.groupBy(*keys)
        .agg(F.max(F.struct(order, *rest)).alias("_last"))
        .select(*keys, "_last.*")
        .select(*writes.columns)
    )


def slug_collisions(writes: DataFrame, keys: tuple[str, ...] = ("domain", "out_path")) -> DataFrame:
    """Output paths that more than one page maps to."""
    return (
        writes.groupBy(*keys)
        .agg(F.count("*").alias("pages"), F.max("url").alias("last_url"))
        .filter(F.col("pages") > 1)
    )


def summary(saved: DataFrame, out: str) -> DataFrame:
    """K5: the grand total and where it went."""
    return saved.agg(F.count("*").alias("count")).withColumn("out", F.lit(out))
