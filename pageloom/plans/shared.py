"""C1 for many seeds on the same sites: one breadth-first walk for all of them.

Seeds of an origin are numbered, and a URL carries a bitmap of the seeds that have reached
it, 64 to a word. Links, robots rules, patterns and captures are looked up once for each URL
and word instead of once for each seed, and levels are merged by bitwise or, which Spark
does within tasks before anything is moved.

A bitmap does not tell the queue order of the pages of a seed. It is needed where two pages
of one level have the same text, as the first in the queue is saved, and where a seed has
reached more pages than its limit. Both are found with the bitmaps: copies by adding up the bits
of a text and level, limits by counting, seed by seed, only the words of an origin that
hold more pages than the limit. Seeds concerned leave the walk and are crawled by their own
queue (``crawl``), over the same link index. All others are done when the bitmaps are.

Work tables and levels are kept as in ``crawl``. The result has no queue order (``ord``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.config import HarvestConfig
from pageloom.functions.core import over
from pageloom.functions.urls import url_origin
from pageloom.operators.aggregates import page_number
from pageloom.operators.joins import fetch_join, robots_policies
from pageloom.plans.crawl import _Levels, _reader, _walk, base_of, first_frontier, link_index, select_urls
from pageloom.session import observed, removed, work_dir, written

RESULT = ("seed_id", "seed", "url", "depth", "page_id", "error")
WORD = 64  # seeds to a word of a bitmap


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _places(bits: Column) -> Column:
    """Numbers of the bits that are set."""
    every = F.sequence(F.lit(0), F.lit(WORD - 1))
    return F.filter(every, lambda i: bits.bitwiseAND(_bit(i)) != 0)


def numbered_seeds(seeds: DataFrame) -> DataFrame:
    """``seed_id, seed, base, origin, word, place``: the seeds of each origin by number."""
    based = seeds.select("seed_id", "seed", over(base_of, "seed").alias("base"))
    based = based.withColumn("origin", over(url_origin, "base"))
    number = F.col("number") - 1
    return page_number(based, "origin", "seed_id").select(
        *based.columns,
        F.floor(number / WORD).cast("int").alias("word"),
        (number % WORD).cast("int").alias("place"),
    )


def in_scope(reached: DataFrame, scopes: DataFrame, lengths: DataFrame) -> DataFrame:
    """P2 for bitmaps: of each URL the seeds whose base begins it.

    A URL is cut to the lengths that bases of its origin have and joined with the
    bases, as in ``scope_join``; ``scopes`` has one row for each base and word.
    """
    cut = (
        reached.join(lengths, "origin")
        .filter(F.col("length") <= F.length("url"))
        .withColumn("base", F.substring(F.col("url"), F.lit(1), F.col("length")))
    )
    own = F.col("bits").bitwiseAND(F.col("scope_bits"))
    met = cut.join(scopes, ["base", "word"]).select("origin", "url", "word", own.alias("bits")).filter("bits <> 0")
    return met.groupBy("origin", "url", "word").agg(F.bit_or("bits").alias("bits"))


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows less the bits that ``gone`` (one row for each key) holds."""
    gone = gone.select(*keys, F.col("bits").alias("_gone"))
    left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_gone", F.lit(0).cast("long"))))
    return rows.join(gone, keys, "left").withColumn("bits", left).drop("_gone").filter("bits <> 0")


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.bit_or("bits").alias("bits"))


def copied_seeds(level: DataFrame) -> DataFrame:
    """``origin, word, bits`` of the seeds that reach two pages of one text in a level.

    If no seed does, the bits of a text add up to those of its bitmap; only texts where
    they do not are looked at seed by seed.
    """
    keys = ["origin", "word", "sha1"]
    sums = level.groupBy(*keys).agg(F.sum(F.bit_count("bits")).alias("held"), F.bit_or("bits").alias("any"))
    twice = sums.filter(F.col("held") > F.bit_count("any")).select(*keys)
    each = level.join(twice, keys, "left_semi").select(*keys, F.explode(_places(F.col("bits"))).alias("place"))
    copies = each.groupBy(*keys, "place").count().filter("count > 1")
    return _merged(copies.select("origin", "word", _bit(F.col("place")).alias("bits")), "origin", "word")


def full_seeds(saved: DataFrame, max_pages: int) -> DataFrame:
    """``origin, word, bits`` of the seeds with more pages than the limit. Only words
    under which more pages are saved are counted seed by seed."""
    many = saved.groupBy("origin", "word").count().filter(F.col("count") > max_pages)
    each = saved.join(many.drop("count"), ["origin", "word"], "left_semi")
    each = each.select("origin", "word", F.explode(_places(F.col("bits"))).alias("place"))
    over_ = each.groupBy("origin", "word", "place").count().filter(F.col("count") > max_pages)
    return _merged(over_.select("origin", "word", _bit(F.col("place")).alias("bits")), "origin", "word")


def shared_crawl(
    seeds: DataFrame,
    pages: DataFrame,
    robots: DataFrame | None = None,
    cfg: HarvestConfig = HarvestConfig(),
) -> DataFrame:
    """The pages ``crawl`` saves, as ``seed_id, seed, url, depth, page_id, error``."""
    spark = pages.sparkSession
    folder = work_dir(spark)
    seeds = written(numbered_seeds(seeds), f"{folder}/seeds")
    index = link_index(pages, seeds, folder)
    policies = None
    if robots is not None:
        policies = written(robots_policies(robots, cfg.agent), f"{folder}/robots")
    marked = seeds.select("origin", "base", "word", _bit(F.col("place")).alias("bits"))
    scopes = _merged(marked, "base", "word").withColumnRenamed("bits", "scope_bits")
    scopes = written(scopes, f"{folder}/scopes")
    lengths = written(seeds.select("origin", F.length("base").alias("length")).distinct(), f"{folder}/lengths")

    saved: list[DataFrame] = []  # of each level: origin, url, word, bits, depth, page_id, sha1, error, targets
    left: list[DataFrame] = []  # origin, word, bits of seeds that left the walk
    frontier = marked.select("origin", F.col("base").alias("url"), "word", "bits")
    reach, depth = index.rows, 0
    told = {"first": F.min(F.array_min("targets")), "last": F.max(F.array_max("targets"))}
    while True:
        new = in_scope(_merged(frontier, "origin", "url", "word"), scopes, lengths)
        if saved:
            before = reduce(DataFrame.unionByName, [s.select("origin", "url", "word", "sha1", "bits") for s in saved])
            new = without(new, _merged(before, "origin", "url", "word"), ["origin", "url", "word"])
        fetched = fetch_join(index.dealt(select_urls(new, policies, cfg)), reach)
        if saved:
            fetched = without(fetched, _merged(before, "origin", "word", "sha1"), ["origin", "word", "sha1"])
        level, range_ = observed(fetched.withColumn("depth", F.lit(depth)), f"{folder}/levels/{depth}", **told)
        out = copied_seeds(level)
        if cfg.max_pages is not None:
            counted = reduce(DataFrame.unionByName, [s.select("origin", "word", "bits") for s in [*saved, level]])
            out = out.unionByName(full_seeds(counted, cfg.max_pages))
        for earlier in left:
            out = without(out, earlier, ["origin", "word"])
        out, number = observed(_merged(out, "origin", "word"), f"{folder}/left/{depth}", rows=F.count("*"))
        saved.append(level)
        if number["rows"]:
            left.append(out)
        if range_["first"] is None or (cfg.depth and depth >= cfg.depth):
            break
        reach = index.rows.filter(F.col("url").between(range_["first"], range_["last"]))
        walking = without(level, out, ["origin", "word"]) if number["rows"] else level
        frontier = walking.select("origin", "word", "bits", F.explode("targets").alias("url")).filter(
            over(url_origin, "url") == F.col("origin")
        )
        depth += 1

    found = reduce(DataFrame.unionByName, [s.drop("sha1", "targets") for s in saved])
    own_queue = None
    if left:
        gone = written(_merged(reduce(DataFrame.unionByName, left), "origin", "word"), f"{folder}/gone")
        found = without(found, gone, ["origin", "word"])
        own_queue = gone.select("origin", "word", F.explode(_places(F.col("bits"))).alias("place"))
    place = F.explode(_places(F.col("bits"))).alias("place")
    result = found.select("origin", "word", place, "url", "depth", "page_id", "error")
    result = result.join(seeds, ["origin", "word", "place"]).select(*RESULT)
    if own_queue is not None:
        alone = written(seeds.join(own_queue, ["origin", "word", "place"], "left_semi"), f"{folder}/alone")
        levels = _Levels(spark, folder)
        _walk(first_frontier(alone), lambda reach: _reader(index, reach), index.rows, policies, cfg, levels, folder)
        result = result.unionByName(levels.table().select(*RESULT))
    result = written(result, f"{folder}/saved")
    index.removed()
    for name in ("seeds", "hosts", "captures", "robots", "scopes", "lengths", "levels", "left", "gone", "alone", "found", "kept", "seen", "stretch"):
        removed(spark, f"{folder}/{name}")
    return result
