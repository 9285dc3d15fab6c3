"""The lookups of a harvest as joins.

No side is forced to be broadcast. Spark broadcasts by measured size, and AQE
splits a partition that one hot origin makes too large. What is joined is
narrow: URLs, ids and hashes, never page bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.core import over
from pageloom.functions.robots import robots_allowed, robots_policy
from pageloom.functions.urls import normalize_url, url_origin, url_parts
from pageloom.schemas import EXPORT_KEYS


def page_key(url: Column) -> Column:
    """Both sides of J1 compare the normalised URL, or the raw one if unusable."""
    return F.coalesce(normalize_url(url, url), url)


def latest_captures(pages: DataFrame, key: str = "url", *carried: str) -> DataFrame:
    """One page id per URL, that of the newest capture, with its ``carried`` columns.
    Pre-aggregated before the shuffle, so a URL captured a billion times costs one row
    per task."""
    order = ["captured_at"] if "captured_at" in pages.columns else []
    newest = list(dict.fromkeys([*order, "page_id", *carried]))
    return pages.groupBy(key).agg(F.max(F.struct(*newest)).alias("_newest")).select(
        key, *[F.col(f"_newest.{c}").alias(c) for c in ("page_id", *carried)]
    )


def fetch_join(frontier: DataFrame, captures: DataFrame, how: str = "inner") -> DataFrame:
    """URLs to their captures; ``captures`` has one row per ``url``."""
    return frontier.join(captures, "url", how)


def seen_anti(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Drop what a seed has taken from its queue before."""
    return candidates.join(seen.select("seed_id", "url"), ["seed_id", "url"], "left_anti")


def first_by_hash(pages: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Per seed and content the first page by ``ord``; nothing saved before.

    An aggregate rather than a window: copies fold into one row per task, so a
    text that fills a third of a site is no single task's load.
    """
    rest = [c for c in pages.columns if c not in ("seed_id", "sha1", "ord")]
    firsts = (
        pages.groupBy("seed_id", "sha1")
        .agg(F.min(F.struct("ord", *rest)).alias("_first"))
        .select("seed_id", "sha1", "_first.*")
    )
    if earlier is not None:
        firsts = firsts.join(
            earlier.select("seed_id", "sha1"), ["seed_id", "sha1"], "left_anti"
        )
    return firsts.select(*pages.columns)


def robots_policies(robots: DataFrame, agent: str) -> DataFrame:
    """``origin, policy``: the rules that bind ``agent``, one row per origin."""
    return robots.select(
        "origin", over(robots_policy, "status", "body", agent=agent).alias("policy")
    )


def robots_join(candidates: DataFrame, policies: DataFrame, missing: bool = True) -> DataFrame:
    """Adds ``allowed``. One row per origin on the right, rules in an array,
    so no page is paired with single rules."""
    named = policies.select(F.col("origin").alias("_origin"), F.col("policy").alias("_policy"))
    return (
        candidates.withColumn("_origin", over(url_origin, "url"))
        .join(named, "_origin", "left")
        .withColumn("allowed", over(robots_allowed, "_policy", "url", missing=missing))
        .drop("_origin", "_policy")
    )


def scope_join(
    urls: DataFrame, seeds: DataFrame, scope: str = "scope", url: str = "url"
) -> DataFrame:
    """Every URL with each seed whose scope it is in.

    The prefix test becomes an equi-join: a URL is cut to the lengths that scopes of
    its host have, so it is listed once per such length and meets only the seeds it
    belongs to. Seeds are never paired with all URLs of their host.
    """
    host = ["_scheme", "_authority"]

    def located(side: DataFrame, column: str, path: str) -> DataFrame:
        parts = side.withColumn("_parts", over(url_parts, column))
        return parts.select(
            *side.columns,
            F.col("_parts.scheme").alias("_scheme"),
            F.lower(F.col("_parts.authority")).alias("_authority"),
            F.col("_parts.path").alias(path),
        )

    scopes = located(seeds, scope, "_prefix")
    # Distinct, not grouped by host: so the join has an exchange of its own on either
    # side, and AQE can split that of a host with very many URLs.
    lengths = scopes.select(*host, F.length("_prefix").alias("_length")).distinct()
    cut = (
        located(urls, url, "_path")
        .join(lengths, host)
        .filter(F.col("_length") <= F.length("_path"))
        .withColumn("_prefix", F.substring(F.col("_path"), F.lit(1), F.col("_length")))
    )
    return cut.drop("_path", "_length").join(scopes, [*host, "_prefix"]).drop(*host, "_prefix")


def diff_join(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Status of every output path against the last export.

    Both sides are one row per key and carry hashes only.
    """
    keys = list(EXPORT_KEYS)
    new = current.select(*keys, F.col("content_sha1").alias("_new"))
    old = previous.select(*keys, F.col("content_sha1").alias("_old"))
    status = (
        F.when(F.col("_new").isNull(), "missing")
        .when(F.col("_old").isNull(), "new")
        .when(F.col("_new") == F.col("_old"), "unchanged")
        .otherwise("changed")
    )
    return new.join(old, keys, "full").select(*keys, status.alias("status"))


def split_routes(seeds: DataFrame, sitemap_saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds with at least one page from a sitemap, and the others."""
    served = sitemap_saved.select("seed_id").distinct()
    return seeds.join(served, "seed_id", "left_semi"), seeds.join(
        served, "seed_id", "left_anti"
    )
