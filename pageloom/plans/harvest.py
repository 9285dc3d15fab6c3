"""Sitemap harvest, and both routes over a batch of seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.config import HarvestConfig
from pageloom.functions.core import over
from pageloom.operators.filters import include_exclude, lang_keep, response_gate
from pageloom.operators.joins import (
    latest_captures,
    page_key,
    robots_join,
    robots_policies,
    split_routes,
)
from pageloom.plans.crawl import SAVED, crawl
from pageloom.session import work_dir, written
from pageloom.sources.sitemaps import sitemap_urls


def sitemap_harvest(
    seeds: DataFrame,
    sitemaps: DataFrame,
    pages: DataFrame,
    robots: DataFrame | None = None,
    cfg: HarvestConfig = HarvestConfig(),
) -> DataFrame:
    """Pages listed by each seed's sitemaps; an acyclic plan, no HTML read."""
    urls = sitemap_urls(seeds, sitemaps, cfg.distinct_sitemap_urls)
    if robots is not None and cfg.sitemap_robots:
        policies = robots_policies(robots, cfg.agent)
        urls = robots_join(urls, policies, cfg.robots_missing).filter("allowed")
    if cfg.sitemap_patterns:
        urls = urls.filter(include_exclude(F.col("url"), cfg.include, cfg.exclude))
    urls = urls.filter(lang_keep(F.col("url"), cfg.lang))
    extra = [c for c in ("captured_at",) if c in pages.columns]
    captures = pages.select(
        over(page_key, "url").alias("_key"), "page_id", *extra, response_gate(pages).alias("_ok")
    )
    fetched = latest_captures(captures, "_key", "_ok").filter("_ok")
    return (
        urls.withColumn("_key", over(page_key, "url"))
        .join(fetched.select("_key", "page_id"), "_key")
        .select(
            "seed_id",
            "seed",
            "url",
            F.lit(0).alias("depth"),
            F.col("ord").cast("array<bigint>").alias("ord"),
            "page_id",
            F.lit(None).cast("string").alias("error"),
        )
    )


def harvest(
    seeds: DataFrame,
    pages: DataFrame,
    sitemaps: DataFrame | None = None,
    robots: DataFrame | None = None,
    cfg: HarvestConfig = HarvestConfig(),
) -> DataFrame:
    """Saved pages of all seeds with the ``route`` each was found by."""
    patterns = (cfg.include or cfg.exclude) and not cfg.sitemap_patterns
    if not cfg.sitemap or sitemaps is None or patterns:
        return crawl(seeds, pages, robots, cfg).withColumn("route", F.lit("crawl"))
    listed = written(
        sitemap_harvest(seeds, sitemaps, pages, robots, cfg),
        f"{work_dir(pages.sparkSession)}/sitemap",
    ).withColumn("route", F.lit("sitemap"))
    if not cfg.crawl_without_sitemap:
        return listed
    _, rest = split_routes(seeds, listed)
    walked = crawl(rest, pages, robots, cfg).withColumn("route", F.lit("crawl"))
    return listed.select(*SAVED, "route").unionByName(walked)
