"""Exact deduplication over an extendible-hash index kept as shared files.

The index has a directory (slot -> bucket) and entries. An entry is one distinct
text: its 63-bit key, its place in the chain of different texts under that key,
the id that stays and the number of copies. The slot of a key is its leading
``depth`` bits, so each bucket is one contiguous range of keys. While a bucket
holds more than ``capacity`` entries the directory doubles, and only overfull
buckets split.

Copies are found by comparing whole texts: rows are aggregated by key and bytes,
copies within a task first, so a text with a third of all rows crosses the network
once per task. Owner tasks then take key ranges of the directory and chain the
different texts of one key. Documents look their entry up by key alone; where a
chain has more than one text, the bytes decide. The directory decides nothing about
the result; it only lays the entries out.

Defined results: a NULL text counts as empty; a NULL id never wins against a number;
rows repeated with id and text all get the same values; an empty table gives no rows;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import ascii_lower
from pageloom.session import work_dir, written

KEY_BITS = 63


@dataclass(frozen=True)
class ExactIndex:
    directory: DataFrame  # slot, bucket, local_depth
    entries: DataFrame  # bucket, key, chain_no, chain_len, keep_id, group_size, text_sha256
    depth: int  # leading key bits that choose a slot


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _key(norm: Column, key_bits: int) -> Column:
    """Leading ``key_bits`` of a 63-bit hash; fewer bits only serve to test chains."""
    spare = KEY_BITS - key_bits
    return F.shiftleft(F.shiftright(F.shiftrightunsigned(F.xxhash64(norm), 1), spare), spare)


def _slot(key: Column, depth: Column | int) -> Column:
    bits = depth if isinstance(depth, Column) else F.lit(depth)
    return F.call_function("shiftright", key, (F.lit(KEY_BITS) - bits).cast("int"))


def _rows(docs: DataFrame, id_col: str, text_col: str, key_bits: int) -> DataFrame:
    norm = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    return norm.select("id", "norm", _key(F.col("norm"), key_bits).alias("key"))


def _global_depth(texts: DataFrame, capacity: int, key_bits: int) -> int:
    """Doubles the directory until no bucket is overfull, or all key bits are used.

    Fewer than n / capacity slots must leave one overfull, so counting starts there.
    """
    total = texts.count()
    depth = min(key_bits, max(0, math.ceil(math.log2(max(1, total) / capacity))))
    while depth < key_bits:
        sizes = texts.groupBy(_slot(F.col("key"), depth).alias("slot")).count()
        if (sizes.agg(F.max("count")).first()[0] or 0) <= capacity:
            break
        depth += 1
    return depth


def _directory(texts: DataFrame, depth: int, capacity: int) -> DataFrame:
    """For each slot the bucket it points to: that of the shortest prefix that fits."""
    spark = texts.sparkSession
    level = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    prefix = F.call_function("shiftright", F.col("slot"), F.lit(depth) - F.col("level"))
    slots = spark.range(1 << depth).withColumnRenamed("id", "slot").select("slot", level)
    slots = slots.withColumn("prefix", prefix)
    held = texts.groupBy(_slot(F.col("key"), depth).alias("slot")).count().select("slot", "count", level)
    held = held.withColumn("prefix", prefix).groupBy("level", "prefix").agg(F.sum("count").alias("held"))
    return (
        slots.join(held, ["level", "prefix"], "left")
        .filter((F.coalesce("held", F.lit(0)) <= capacity) | (F.col("level") == depth))
        .groupBy("slot")
        .agg(F.min("level").alias("local_depth"))
        .withColumn(
            "bucket",
            F.call_function(
                "shiftleft",
                F.call_function("shiftright", F.col("slot"), F.lit(depth) - F.col("local_depth")),
                F.lit(depth) - F.col("local_depth"),
            ),
        )
    )


def build_index(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 16_384,
    key_bits: int = KEY_BITS,
) -> ExactIndex:
    """Index of all texts of ``docs``, written below the shared folder."""
    folder = work_dir(docs.sparkSession)
    texts = (
        _rows(docs, id_col, text_col, key_bits)
        .groupBy("key", "norm")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("key", "keep_id", "group_size", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    )
    texts = written(texts, f"{folder}/texts")
    depth = _global_depth(texts, capacity, key_bits)
    directory = written(_directory(texts, depth, capacity), f"{folder}/directory")
    chain = Window.partitionBy("bucket", "key")
    entries = (
        texts.withColumn("slot", _slot(F.col("key"), depth))
        .join(directory.select("slot", "bucket"), "slot")
        .drop("slot")
        .repartitionByRange("bucket")  # owner tasks: each takes whole key ranges
        .withColumn("chain_no", F.row_number().over(chain.orderBy("text_sha256", "keep_id")))
        .withColumn("chain_len", F.count(F.lit(1)).over(chain))
    )
    return ExactIndex(directory, written(entries, f"{folder}/entries"), depth)


def look_up(
    docs: DataFrame,
    index: ExactIndex,
    id_col: str = "doc_id",
    text_col: str = "text",
    key_bits: int = KEY_BITS,
) -> DataFrame:
    """id, key, chain_no, keep_id, group_size and text_sha256 of each row's entry."""
    rows = _rows(docs, id_col, text_col, key_bits)
    found = ["id", "key", "chain_no", "keep_id", "group_size", "text_sha256"]
    entries = index.entries.drop("bucket")
    single = entries.filter("chain_len = 1")
    result = rows.drop("norm").join(single, "key").select(found)
    chained = entries.filter("chain_len > 1")
    if chained.isEmpty():
        return result
    # Different texts under one key: compare with the texts the entries stand for.
    stands = rows.select(F.col("id").alias("keep_id"), F.col("norm").alias("stands"), "key")
    stands = stands.join(chained, ["key", "keep_id"]).filter(
        F.sha2(F.col("stands").cast("binary"), 256) == F.col("text_sha256")
    )
    nulls = chained.filter("keep_id is null")
    if not nulls.isEmpty():  # groups without any id are found by their digest
        lost = rows.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
        lost = lost.join(nulls, ["key", "text_sha256"]).select(found)
        result = result.unionByName(lost)
    stands = stands.dropDuplicates(["key", "chain_no"])
    return result.unionByName(
        rows.join(stands, "key").filter(F.col("norm") == F.col("stands")).select(found)
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 16_384,
    key_bits: int = KEY_BITS,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Of equal texts (after lower-casing A-Z) the largest id stays.
    """
    index = build_index(docs, id_col, text_col, capacity, key_bits)
    return look_up(docs, index, id_col, text_col, key_bits).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
