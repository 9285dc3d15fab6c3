"""P8, J2 by a filter: keys that have certainly not been seen need no look-up.

A blocked Bloom filter as a table: a key sets ``MARKS`` bits of one 64-bit word, which its
hash names, and the words of many keys are merged by bitwise or, within tasks first. A key
whose bits are not all set has not been seen. The filter has ``words`` rows at most,
whatever the number of keys, so Spark's own limit decides by its written size whether it is
broadcast: keys are then tested where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.session import observed, removed, written

MARKS = 4


def _word(keys: list[str], words: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(*keys), 24), F.lit(words).cast("long")).alias("_word")


def _marks(keys: list[str]) -> Column:
    """The bits of a key: six bits of its hash name each."""
    hashed, marks = F.xxhash64(*keys), F.lit(0).cast("long")
    for i in range(MARKS):
        place = F.shiftright(hashed, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        marks = marks.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return marks


def key_filter(rows: DataFrame, keys: list[str], words: int) -> DataFrame:
    """``_word, _bits`` of the keys of ``rows``."""
    marked = rows.select(_word(keys, words), _marks(keys).alias("_bits"))
    return marked.groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))


def with_maybe(rows: DataFrame, known: DataFrame, keys: list[str], words: int) -> DataFrame:
    """Adds ``_maybe``: false where a key has certainly not been put into the filter."""
    marks = _marks(keys)
    hit = F.coalesce(F.col("_bits").bitwiseAND(marks) == marks, F.lit(False))
    return rows.withColumn("_word", _word(keys, words)).join(known, "_word", "left").select(
        *rows.columns, hit.alias("_maybe")
    )


class SeenFilter:
    """The filter of a crawl, kept on shared files and extended level by level.

    ``told`` has for each level how many keys were asked for and how many of them had to
    be looked up.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], words: int):
        self.spark, self.folder, self.keys, self.words = spark, folder, keys, words
        self.known: DataFrame | None = None
        self.told: list[dict] = []
        self.steps = 0

    def add(self, rows: DataFrame) -> None:
        own = key_filter(rows, self.keys, self.words)
        if self.known is not None:
            both = self.known.unionByName(own)
            own = both.groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
        self.steps += 1
        self.known = written(own, f"{self.folder}/filter/{self.steps}")
        removed(self.spark, f"{self.folder}/filter/{self.steps - 1}")

    def unseen(self, candidates: DataFrame, seen: DataFrame) -> DataFrame:
        """Candidates whose keys ``seen`` does not hold, exactly: those that pass the filter
        are joined, the others are new for certain."""
        if self.known is None:
            return candidates.join(seen.select(*self.keys), self.keys, "left_anti")
        marked = with_maybe(candidates, self.known, self.keys, self.words)
        path = f"{self.folder}/asked/{self.steps}"
        marked, told = observed(marked, path, asked=F.count(F.lit(1)), looked_up=F.count_if("_maybe"))
        self.told.append(told)
        new = marked.filter("not _maybe")
        if told["looked_up"]:
            new = new.unionByName(marked.filter("_maybe").join(seen.select(*self.keys), self.keys, "left_anti"))
        return new.drop("_maybe")
