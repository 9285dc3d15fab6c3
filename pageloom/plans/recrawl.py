"""C1 over arriving captures: a crawl that is kept up to date.

The state of a crawl is a log below one folder, a version for each wave of captures:

* ``captures``: the newest capture of each URL as of the wave that brought it (narrow);
* ``links``: what those pages hold and link to, bucketed by URL; only these are parsed;
* ``saved``: pages the wave has saved, as ``crawl`` does, with their targets;
* ``queue``: which URLs a seed has taken from its queue, and how deep, bucketed by URL;
* ``restarts``: the seeds the wave has walked again, and from which depth on.

A wave changes the URLs whose newest capture has another text, or is refused, or is the
first. A seed is concerned if one of them was in its queue, and from the least depth at which
that was so: everything above is the same as before, in the same order. So its saved pages
above are kept and its walk goes on from there; other seeds are not touched. Captures with the
text that was known only change the page id, which is put in when the crawl is read. Seeds, rules
and limits are those the log was begun with.

A row of ``saved`` or ``queue`` counts unless a later version has walked its seed again from
that depth or above. A version counts as a whole once it is ``done``; one that failed is
dropped and done again. After ``COMPACT`` waves the links that count are written as one table, so
a level looks into a bounded number. A walk of more than ``LONG`` levels makes one table of its
own of what lies around its seeds, so all further levels look into that alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pageloom.config import HarvestConfig
from pageloom.functions.core import over
from pageloom.functions.urls import url_origin
from pageloom.operators.filters import depth_limit, response_gate
from pageloom.operators.joins import fetch_join, latest_captures, page_key, robots_policies
from pageloom.plans.crawl import (
    SAVED,
    Fetch,
    _Levels,
    _open_seeds,
    _walk,
    base_of,
    first_frontier,
    next_frontier,
    origin_of_seed,
    page_links,
)
from pageloom.session import (
    BUCKET_ROWS,
    Bucketed,
    attached,
    bucketed,
    buckets_for,
    folder_numbers,
    observed,
    removed,
    work_dir,
    written,
)

COMPACT = 8  # versions of links that a look-up reads at most
LONG = 4  # levels of a walk that look into several tables before it makes one of them

_CAPTURES = "url string, page_id bigint, ok boolean, captured_at timestamp"
_LINKS = "url string, page_id bigint, sha1 string, targets array<string>, error string"
_SAVED = (
    "seed_id bigint, sha1 string, ord array<bigint>, seed string, base string, url string, "
    "page_id bigint, error string, targets array<string>, depth int"
)
_QUEUE = "seed_id bigint, url string, depth int"
_RESTARTS = "seed_id bigint, restart int"
_SAME = "url string, page_id bigint"
KINDS = (
    "captures", "links", "links_buckets", "whole", "whole_buckets", "compacted", "same",
    "saved", "queue", "restarts",
)


class Recrawl:
    """A crawl of ``seeds`` whose state lies in ``folder``, on a store all nodes share."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        seeds: DataFrame,
        robots: DataFrame | None = None,
        cfg: HarvestConfig = HarvestConfig(),
    ):
        self.spark, self.folder, self.cfg = spark, folder, cfg
        self.work = work_dir(spark)
        based = seeds.select("seed_id", "seed", over(base_of, "seed").alias("base"))
        self.seeds = written(based.withColumn("origin", over(origin_of_seed, "seed")), f"{self.work}/seeds")
        self.policies = None
        if robots is not None:
            self.policies = written(robots_policies(robots, cfg.agent), f"{self.work}/robots")
        self.tables: dict[tuple[str, int], Bucketed] = {}
        self.own: Bucketed | None = None  # the table that a long walk has made

    # The log

    def versions(self, kind: str) -> list[int]:
        return folder_numbers(self.spark, f"{self.folder}/{kind}")

    def _path(self, kind: str, version: int) -> str:
        return f"{self.folder}/{kind}/version={version}"

    def _read(self, kind: str, schema: str, since: int = 0) -> DataFrame:
        """All versions from ``since`` on, with their number."""
        paths = [self._path(kind, n) for n in self.versions(kind) if n >= since]
        typed = f"{schema}, version int"
        if not paths:
            return self.spark.createDataFrame([], typed)
        return self.spark.read.schema(typed).option("basePath", f"{self.folder}/{kind}").parquet(*paths)

    def _counting(self, rows: DataFrame) -> DataFrame:
        """The rows that no later version has replaced."""
        again = self._read("restarts", _RESTARTS)
        again = again.groupBy("seed_id").agg(F.collect_list(F.struct("version", "restart")).alias("_again"))
        replaced = F.exists("_again", lambda a: (a.version > F.col("version")) & (a.restart <= F.col("depth")))
        kept = rows.join(again, "seed_id", "left").filter(~F.coalesce(replaced, F.lit(False)))
        return kept.drop("_again", "version")

    def _links(self) -> list[Bucketed]:
        """Tables that hold the links of each URL once, all bucketed by URL."""
        whole = max(self.versions("compacted"), default=0)
        found = [("whole", whole)] if whole else []
        found += [("links", n) for n in self.versions("links") if n > whole]
        tables = []
        for i, (kind, n) in enumerate(found):
            table = self._table(kind, n)
            if i + 1 < len(found):
                later = table.dealt(self._read("captures", _CAPTURES, n + 1).select("url")).distinct()
                table = table._replace(rows=table.rows.join(later, "url", "left_anti"))
            tables.append(table)
        return tables

    def _table(self, kind: str, version: int) -> Bucketed:
        if (kind, version) not in self.tables:
            buckets = self.spark.read.parquet(self._path(f"{kind}_buckets", version)).first()[0]
            schema = StructType.fromDDL(_LINKS)
            self.tables[kind, version] = attached(self.spark, self._path(kind, version), schema, "url", buckets)
        return self.tables[kind, version]

    def _write_table(self, rows: DataFrame, kind: str, version: int, buckets: int) -> DataFrame:
        count = self.spark.range(1).select(F.lit(buckets).alias("buckets"))
        count.write.mode("overwrite").parquet(self._path(f"{kind}_buckets", version))
        self.tables[kind, version] = bucketed(rows, self._path(kind, version), "url", buckets)
        return self.tables[kind, version].rows

    def _forget(self, version: int) -> None:
        """Drops what an update that has failed left behind."""
        for kind in KINDS:
            self.tables.pop((kind, version), None)
            removed(self.spark, self._path(kind, version))

    def _fetch_of(self, links: list[Bucketed], walked: DataFrame, folder: str):
        """Look-ups for a walk of the seeds in ``walked``."""
        tables, asked = list(links), 0

        def reader(reach: tuple[str, str] | None) -> Fetch:
            nonlocal tables, asked
            if len(tables) > 1 and asked >= LONG:
                tables = [self._around(tables, walked, f"{folder}/links")]
            asked += 1
            parts = [t.rows if reach is None else t.rows.filter(F.col("url").between(*reach)) for t in tables]

            def fetch(urls: DataFrame) -> DataFrame:
                if len(parts) > 1:  # looked up in each, so not worked out for each
                    urls = written(urls, f"{work_dir(self.spark, self.work)}/urls")
                met = [fetch_join(t.dealt(urls), part) for t, part in zip(tables, parts)]
                return reduce(DataFrame.unionByName, met)

            return fetch

        return reader

    def _around(self, tables: list[Bucketed], walked: DataFrame, path: str) -> Bucketed:
        """One table of the links from the first base of the seeds to what begins with the last."""
        first, last = walked.agg(F.min("base"), F.max("base")).first()
        rows = reduce(DataFrame.unionByName, [t.rows for t in tables])
        if first is not None:
            rows = rows.filter((F.col("url") >= first) & (F.col("url") <= last + chr(0x10FFFF)))
        buckets = buckets_for(self.spark, sum(t.buckets for t in tables) * BUCKET_ROWS)
        self.own = bucketed(rows, path, "url", buckets)
        return self.own

    # A wave

    def _newer(self, pages: DataFrame) -> DataFrame:
        """Captures of the wave that are newer than what is known of their URL."""
        timed = "captured_at" in pages.columns
        captured = F.col("captured_at") if timed else F.lit(None).cast("timestamp")
        named = pages.select(
            over(page_key, "url").alias("url"), "page_id", response_gate(pages).alias("ok"), captured.alias("captured_at")
        )
        hosts = self.seeds.select(F.col("origin").alias("_origin")).distinct()
        own = named.withColumn("_origin", over(url_origin, "url")).join(hosts, "_origin", "left_semi")
        newest = written(latest_captures(own.drop("_origin"), "url", "ok", "captured_at"), f"{self.work}/newest")
        known = latest_captures(self._read("captures", _CAPTURES).drop("version"), "url", "ok", "captured_at")
        old = known.select("url", F.struct("captured_at", "page_id").alias("_old"))
        later = F.col("_old").isNull() | (F.struct("captured_at", "page_id") > F.col("_old"))
        return newest.join(old, "url", "left").filter(later).drop("_old").select("url", "page_id", "ok", "captured_at")

    def update(self, pages: DataFrame) -> dict[str, int]:
        """Takes in a wave of captures. Tells how many pages were parsed, have changed, and
        how many seeds were walked again and pages saved for it."""
        version = max(self.versions("done"), default=0) + 1
        self._forget(version)
        old = self._links()
        captures, told = observed(self._newer(pages), self._path("captures", version), parsed=F.count_if("ok"))
        fresh = page_links(pages, captures.filter("ok").select("page_id", "url"))
        links = self._write_table(fresh, "links", version, buckets_for(self.spark, told["parsed"]))

        own = captures.select("url", "ok").join(links.select("url", F.col("sha1").alias("_new")), "url", "left")
        if old:
            known = reduce(DataFrame.unionByName, [t.rows for t in old]).select("url", F.col("sha1").alias("_known"))
            own = own.join(known, "url", "left")
        else:
            own = own.withColumn("_known", F.lit(None).cast("string"))
        same = F.col("_new").eqNullSafe(F.col("_known"))
        changed, counted = observed(
            own.filter(~same).select("url"), f"{self.work}/changed/{version}",
            rows=F.count(F.lit(1)), first=F.min("url"), last=F.max("url"),
        )
        again = links.join(own.filter(same).select("url"), "url", "left_semi").select("url", "page_id")
        again.write.mode("overwrite").parquet(self._path("same", version))

        restarts, walked = self._restarts(changed, counted, version)
        result = {"parsed": told["parsed"], "changed": counted["rows"], "seeds": walked["rows"], "saved": 0}
        if walked["rows"]:
            result["saved"] = self._walk_again(restarts, version)
        self.spark.range(1).write.mode("overwrite").parquet(self._path("done", version))
        if len(self._links()) >= COMPACT:
            whole = reduce(DataFrame.unionByName, [t.rows for t in self._links()])
            self._write_table(whole, "whole", version, buckets_for(self.spark, whole.count()))
            self.spark.range(1).write.mode("overwrite").parquet(self._path("compacted", version))
        return result

    def _restarts(self, changed: DataFrame, counted: dict, version: int) -> tuple[DataFrame, dict]:
        """``seed_id, restart``: the least depth at which a changed URL was in a seed's queue."""
        first = self.seeds.join(changed, F.col("base") == F.col("url"), "left_semi").select(
            "seed_id", F.lit(0).alias("depth")
        )
        queue = self._counting(self._read("queue", _QUEUE))
        if counted["rows"]:
            queue = queue.filter(F.col("url").between(counted["first"], counted["last"]))
        met = queue.join(changed, "url", "left_semi").select("seed_id", "depth")
        if not self.versions("saved"):  # nothing was walked before
            first = self.seeds.select("seed_id", F.lit(0).alias("depth"))
        least = first.unionByName(met).groupBy("seed_id").agg(F.min("depth").alias("restart"))
        return observed(least, f"{self.work}/restarts/{version}", rows=F.count(F.lit(1)))

    def _walk_again(self, restarts: DataFrame, version: int) -> int:
        """Walks the seeds concerned from their depth on and appends what they save."""
        cfg = self.cfg
        rows = self._counting(self._read("saved", _SAVED))
        above = rows.join(restarts, "seed_id").filter(F.col("depth") < F.col("restart"))
        above, kept = observed(above, f"{self.work}/above/{version}", rows=F.count(F.lit(1)))
        seen = above.select("seed_id", "url", "sha1")
        edge = above.filter(F.col("depth") == F.col("restart") - 1)
        edge = _open_seeds(edge, seen, cfg.max_pages, kept["rows"]).filter(depth_limit(F.col("depth"), cfg.depth))
        entering = {
            r["restart"]: next_frontier(edge.filter(F.col("restart") == r["restart"]))
            for r in restarts.select("restart").distinct().collect()  # depths: few
        }
        if 0 in entering:
            entering[0] = first_frontier(self.seeds.join(restarts.filter("restart = 0"), "seed_id", "left_semi"))
        folder = f"{self.work}/walk/{version}"
        levels = _Levels(self.spark, folder, seen if kept["rows"] else None)
        links = self._links()
        index = reduce(DataFrame.unionByName, [t.rows for t in links])
        walked = self.seeds.join(restarts, "seed_id", "left_semi")
        fetch_of = self._fetch_of(links, walked, folder)
        _walk(None, fetch_of, index, self.policies, cfg, levels, folder, entering, kept["rows"])
        names = [c.split()[0] for c in _SAVED.split(", ")]
        found, told = observed(levels.table().select(*names), self._path("saved", version), rows=F.count(F.lit(1)))
        queued = found.select("seed_id", F.explode("targets").alias("url"), (F.col("depth") + 1).alias("depth"))
        # What the kept level has put into the queue counts from the restart on again.
        queued = queued.unionByName(
            edge.select("seed_id", F.explode("targets").alias("url"), (F.col("depth") + 1).alias("depth"))
        )
        queued = queued.groupBy("seed_id", "url").agg(F.min("depth").alias("depth"))
        queued.repartitionByRange("url").sortWithinPartitions("url").write.mode("overwrite").parquet(
            self._path("queue", version)
        )
        restarts.write.mode("overwrite").parquet(self._path("restarts", version))
        if self.own is not None:
            self.own.removed()
            self.own = None
        removed(self.spark, folder)
        return told["rows"]

    def saved(self) -> DataFrame:
        """The pages a crawl of all captures so far saves, as ``crawl`` gives them."""
        same = self._read("same", _SAME)
        newest = same.groupBy("url").agg(F.max_by("page_id", "version").alias("_same"), F.max("version").alias("_when"))
        rows = self._counting(self._read("saved", _SAVED).withColumn("_saved", F.col("version")))
        page_id = F.when(F.col("_when") > F.col("_saved"), F.col("_same")).otherwise(F.col("page_id"))
        return rows.join(newest, "url", "left").withColumn("page_id", page_id).select(*SAVED)
