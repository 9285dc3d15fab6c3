"""Breadth-first crawl over captured pages, exact and level by level.

A queue visits all URLs of depth d before any of depth d+1, so one join step
per level for all seeds at once visits them in the same order. ``ord`` is the
place of a URL in its level: the place of its parent followed by the position
of the link. Arrays compare element by element, which is queue order. When they
have become long, the pages of a level are numbered anew in that order.

What a URL is refused for (robots, patterns, no capture, bad response) does
not change during a crawl, and the text of a URL neither. So the saved pages
and their hashes are all the memory a level needs: a URL that was taken from
the queue before is either saved, or refused again, or its text is known.

Only the newest capture of a URL is parsed, once for the whole crawl. What it links to lies
in a table bucketed by URL, so a level moves its own rows to that table and never the table;
and of it only the part between the first and the last URL of the level is scanned.

Each level is one job, a write to the work folder: lineage stays short and a lost
executor costs one level at most. What levels have saved is merged into one narrow
table at intervals, so a level reads a bounded number of tables. The driver sees
counts and two URLs a level. Work tables are removed when the result has been written.
Where levels stay thin, many of them are one job (``stretch``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pageloom.config import HarvestConfig
from pageloom.functions.core import over
from pageloom.functions.events import parse_links
from pageloom.functions.urls import (
    content_sha1,
    crawl_base,
    normalize_seed,
    normalize_url,
    url_origin,
)
from pageloom.operators.content import queue_hrefs
from pageloom.operators.filters import (
    depth_limit,
    first_n_per_key,
    include_exclude,
    lang_keep,
    response_gate,
)
from pageloom.operators.joins import (
    fetch_join,
    first_by_hash,
    latest_captures,
    page_key,
    robots_join,
    robots_policies,
    seen_anti,
)
from pageloom.operators.membership import SeenFilter
from pageloom.plans.stretch import ENDLESS, numbered_index, walk_stretch
from pageloom.session import Bucketed, bucketed, buckets_for, observed, removed, work_dir, written

SAVED = ("seed_id", "seed", "url", "depth", "ord", "page_id", "error")
MERGE_LEVELS = 8  # levels whose saved pages are read as tables of their own
LONG_ORD = 16  # elements from which on places are numbered anew
SLIM_LEVELS = 8  # thin levels in a row from which on many are walked in one job
SLIM_ROWS = 1024  # pages of a thin level at most
SLIM_SHARE = 16  # and it has less than this part of what was saved


def queue_targets(url: Column, links: Column) -> Column:
    """Normalised targets of a page in queue order, the first of equals."""
    targets = F.transform(queue_hrefs(links), lambda href: normalize_url(url, href))
    return F.array_distinct(F.filter(targets, lambda t: t.isNotNull()))


def base_of(seed: Column) -> Column:
    return crawl_base(normalize_seed(seed))


def origin_of_seed(seed: Column) -> Column:
    return url_origin(base_of(seed))


def newest_captures(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """``page_id, url`` of the newest capture of each URL of the origins in ``hosts``, where
    that passes the response gate; settled on narrow columns."""
    extra = [c for c in ("captured_at",) if c in pages.columns]
    named = pages.select(over(page_key, "url").alias("url"), "page_id", response_gate(pages).alias("ok"), *extra)
    own = named.withColumn("_origin", over(url_origin, "url")).join(hosts, "_origin", "left_semi")
    return latest_captures(own.drop("_origin"), "url", "ok").filter("ok").select("page_id", "url")


def page_links(pages: DataFrame, captures: DataFrame) -> DataFrame:
    """``url, page_id, sha1, targets, error`` of the given captures (``page_id, url``), which
    alone are parsed. Targets keep queue order, refresh tag first, first of equals.
    ``error`` tells why the links of a page could not be read."""
    raw = pages.select("page_id", "html").join(captures, "page_id").select(
        "url",
        "page_id",
        content_sha1(F.col("html")).alias("sha1"),
        parse_links(F.col("html")).alias("_links"),
    )
    targets = over(queue_targets, "url", "_links").alias("targets")
    return raw.select("url", "page_id", "sha1", targets, "_links.error")


def link_index(pages: DataFrame, seeds: DataFrame, folder: str) -> Bucketed:
    """Links of the newest captures of the hosts that seeds name, bucketed by URL.

    Hosts and captures are written before they are joined with, so Spark knows how small
    they are: HTML stays where it is scanned unless the captures wanted exceed its limit
    for broadcasts; then that of the wanted ones is exchanged once, by page.
    """
    hosts = seeds.select(over(origin_of_seed, "seed").alias("_origin")).distinct()
    hosts = written(hosts, f"{folder}/hosts")
    captures, told = observed(newest_captures(pages, hosts), f"{folder}/captures", rows=F.count(F.lit(1)))
    buckets = buckets_for(pages.sparkSession, told["rows"])
    return bucketed(page_links(pages, captures), f"{folder}/index", "url", buckets)


def select_urls(urls: DataFrame, policies: DataFrame | None, cfg: HarvestConfig) -> DataFrame:
    """P4, P3 and P9 on a frontier."""
    if policies is not None:
        urls = robots_join(urls, policies, cfg.robots_missing)
        urls = urls.filter("allowed").drop("allowed")
    return urls.filter(
        include_exclude(F.col("url"), cfg.include, cfg.exclude)
        & lang_keep(F.col("url"), cfg.lang)
    )


def crawl(
    seeds: DataFrame,
    pages: DataFrame,
    robots: DataFrame | None = None,
    cfg: HarvestConfig = HarvestConfig(),
) -> DataFrame:
    """Saved pages as ``seed_id, seed, url, depth, ord, page_id, error``."""
    spark = pages.sparkSession
    folder = work_dir(spark)
    seeds = written(seeds.select("seed_id", "seed"), f"{folder}/seeds")
    index = link_index(pages, seeds, folder)
    policies = None
    if robots is not None:
        policies = written(robots_policies(robots, cfg.agent), f"{folder}/robots")
    saved = _Levels(spark, folder)
    _walk(first_frontier(seeds), lambda reach: _reader(index, reach), index.rows, policies, cfg, saved, folder)
    result = written(saved.table().select(*SAVED), f"{folder}/saved")
    index.removed()
    for name in ("seeds", "hosts", "captures", "robots", "found", "kept", "seen", "filter", "asked", "stretch"):
        removed(spark, f"{folder}/{name}")
    return result


def first_frontier(seeds: DataFrame) -> DataFrame:
    rows = seeds.select("seed_id", "seed", over(base_of, "seed").alias("base"))
    return rows.select("*", F.col("base").alias("url"), F.array().cast("array<bigint>").alias("ord"))


def next_frontier(found: DataFrame) -> DataFrame:
    """The links of a level's pages, in queue order."""
    return found.select(
        "seed_id", "seed", "base", "ord", F.posexplode("targets").alias("pos", "url")
    ).select(
        "seed_id", "seed", "base", "url", F.concat("ord", F.array(F.col("pos").cast("bigint"))).alias("ord")
    )


Fetch = Callable[[DataFrame], DataFrame]  # URLs to their rows in the link index


def level_pages(
    frontier: DataFrame,
    seen: DataFrame | None,
    fetch: Fetch,
    policies: DataFrame | None,
    cfg: HarvestConfig,
    passed: SeenFilter | None = None,
) -> DataFrame:
    """What a level saves: new URLs, selected, captured, with a text that is new to the
    seed. Of their targets those in the seed's scope."""
    new = frontier.groupBy("seed_id", "url").agg(F.min(F.struct("ord", "seed", "base")).alias("_first"))
    if seen is not None:
        new = seen_anti(new, seen) if passed is None else passed.unseen(new, seen)
    new = new.select("seed_id", "url", "_first.*")
    fetched = fetch(select_urls(new, policies, cfg)).select(
        "seed_id", "sha1", "ord", "seed", "base", "url", "page_id", "error", "targets"
    )
    base = F.col("base")
    return first_by_hash(fetched, seen).withColumn("targets", F.filter("targets", lambda t: t.startswith(base)))


def _reader(index: Bucketed | DataFrame, reach: tuple[str, str] | None) -> Fetch:
    """Looks URLs up in the part of the index from the first to the last of them."""
    rows, dealt = (index.rows, index.dealt) if isinstance(index, Bucketed) else (index, lambda urls: urls)
    part = rows if reach is None else rows.filter(F.col("url").between(*reach))
    return lambda urls: fetch_join(dealt(urls), part)


def _walk(
    frontier: DataFrame | None,
    fetch_of: Callable[[tuple[str, str] | None], Fetch],
    index: DataFrame,
    policies: DataFrame | None,
    cfg: HarvestConfig,
    saved: _Levels,
    folder: str,
    entering: dict[int, DataFrame] | None = None,
    saved_total: int = 0,
) -> None:
    """Level by level until nothing is left. ``entering`` holds URLs that join at a depth of
    their own; ``fetch_of`` gives the look-up for a range of URLs, None for any, in ``index``.
    Thin levels go many at a time, where nothing else enters and it spares levels."""
    entering = dict(entering or {})
    passed = SeenFilter(saved.spark, folder, ["seed_id", "url"], cfg.seen_filter) if cfg.seen_filter else None
    if passed and saved:
        passed.add(saved.seen())
    if frontier is not None:
        entering[0] = frontier
    depth, length, frontier, reach = min(entering, default=0), 0, None, None
    slim, pause, numbered = 0, SLIM_LEVELS, None
    while entering or frontier is not None:
        joining = entering.pop(depth, None)
        if joining is not None:
            frontier, reach = joining if frontier is None else frontier.unionByName(joining), None
        seen = saved.seen() if saved else None
        stretch = None
        if slim >= SLIM_LEVELS and not entering and seen is not None:
            if numbered is None:
                numbered = numbered_index(select_urls(index, policies, cfg), f"{folder}/stretch")
            most = cfg.depth - depth + 1 if cfg.depth else ENDLESS
            stretch = walk_stretch(frontier, seen, *numbered, f"{folder}/stretch/{depth}", most, cfg.max_pages)
        path = f"{folder}/found/{depth}"
        if stretch is None:
            steps = 1
            found = level_pages(frontier, seen, fetch_of(reach), policies, cfg, passed).withColumn("depth", F.lit(depth))
            if length >= LONG_ORD:
                found = found.repartitionByRange("ord").sortWithinPartitions("ord")
                found = found.withColumn("ord", F.array(F.monotonically_increasing_id()))
                length = 1
        else:
            found, steps = stretch
            found = found.withColumn("depth", F.lit(depth) + F.col("step")).drop("step")
            length = 1
        depth += steps - 1
        last = F.col("depth") == depth
        told = {
            "rows": F.count(F.lit(1)),
            "deepest": F.count_if(last),
            "first": F.min(F.when(last, F.array_min("targets"))),
            "last": F.max(F.when(last, F.array_max("targets"))),
        }
        found, level = observed(found, path, **told)
        if stretch is None and cfg.max_pages is not None and saved_total + level["rows"] > cfg.max_pages:
            path = f"{folder}/kept/{depth}"
            found, level = observed(_within_limit(found, seen, cfg.max_pages), path, **told)
        saved.hold(found, path)
        if passed:
            passed.add(found)
        saved_total += level["rows"]
        if level["deepest"] > SLIM_ROWS or level["deepest"] * SLIM_SHARE >= saved_total:
            slim = 0
        elif slim >= SLIM_LEVELS and steps < 3:  # what it links to lies all over
            slim, pause = -pause, 2 * pause
        else:
            slim = min(slim + 1, SLIM_LEVELS)
            pause = pause if stretch is None else SLIM_LEVELS
        frontier = None
        # Without targets in scope the next level is only what enters there.
        if level["first"] is not None and not (cfg.depth and depth >= cfg.depth):
            reach = (level["first"], level["last"])
            open_ = _open_seeds(found.filter(last), saved.seen(), cfg.max_pages, saved_total)
            frontier = next_frontier(open_.filter(depth_limit(F.col("depth"), cfg.depth)))
        if frontier is None and entering:
            depth = min(entering) - 1
        depth += 1
        length += 1


class _Levels:
    """The written tables of all levels so far."""

    def __init__(self, spark: SparkSession, folder: str, before: DataFrame | None = None):
        self.spark, self.folder = spark, folder
        self.schema: StructType | None = None
        self.paths: list[str] = []  # of all levels
        self.merged = before  # seen pages from before the walk, and of its first levels
        self.since: list[str] = []  # levels after those

    def __bool__(self) -> bool:
        return bool(self.paths) or self.merged is not None

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def hold(self, level: DataFrame, path: str) -> None:
        self.schema = level.schema
        self.paths.append(path)
        self.since.append(path)
        if len(self.since) >= MERGE_LEVELS:
            self.merged = written(self.seen(), f"{self.folder}/seen/{len(self.paths)}")
            self.since = []

    def seen(self) -> DataFrame:
        """``seed_id, url, sha1`` of all saved pages."""
        parts = [self.merged] if self.merged is not None else []
        if self.since:
            parts.append(self._read(self.since).select("seed_id", "url", "sha1"))
        return reduce(DataFrame.unionByName, parts)

    def table(self) -> DataFrame:
        return self._read(self.paths)


def _within_limit(kept: DataFrame, saved: DataFrame | None, max_pages: int) -> DataFrame:
    """What still fits under each seed's limit, in queue order."""
    if saved is None:
        limited = kept.withColumn("_left", F.lit(max_pages))
    else:
        used = saved.groupBy("seed_id").agg(F.count("*").alias("_used"))
        limited = kept.join(used, "seed_id", "left").withColumn(
            "_left", max_pages - F.coalesce("_used", F.lit(0))
        )
    return first_n_per_key(
        limited, ["seed_id"], [F.col("ord")], F.col("_left"), "url", max_pages
    ).select(*kept.columns)


def _open_seeds(
    kept: DataFrame, saved: DataFrame, max_pages: int | None, saved_total: int
) -> DataFrame:
    """Pages of seeds that may still save more."""
    if max_pages is None or saved_total < max_pages:
        return kept
    full = (
        saved.groupBy("seed_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= max_pages)
    )
    return kept.join(full, "seed_id", "left_anti")
