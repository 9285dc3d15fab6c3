"""Predicates. All are plain Columns, so Catalyst can push them down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.core import let
from pageloom.functions.urls import url_parts

SALTS = 64


def response_gate(pages: DataFrame) -> Column:
    """Success and HTML. A capture table without those columns passes."""
    gate = F.lit(True)
    if "status" in pages.columns:
        gate = gate & (F.col("status") == 200)
    if "content_type" in pages.columns:
        gate = gate & F.coalesce(F.col("content_type"), F.lit("")).contains("html")
    return F.coalesce(gate, F.lit(False))


def same_scope(seed: Column, candidate: Column) -> Column:
    """Same scheme and host, and the seed's path begins the candidate's."""
    return let(
        url_parts(seed),
        lambda a: let(
            url_parts(candidate),
            lambda b: (a.scheme == b.scheme)
            & (a.authority == b.authority)
            & b.path.startswith(a.path),
        ),
    )


def include_exclude(url: Column, include: str | None, exclude: str | None) -> Column:
    """Search, not full match; Java regex dialect."""
    keep = F.lit(True)
    if include:
        keep = keep & url.rlike(include)
    if exclude:
        keep = keep & ~url.rlike(exclude)
    return keep


def http_scheme(url: Column) -> Column:
    """P7."""
    return url_parts(url).scheme.isin("http", "https")


def depth_limit(depth: Column, limit: int) -> Column:
    """P5: whether a page at ``depth`` may expand its links."""
    return F.lit(True) if limit == 0 else depth < limit


def lang_keep(url: Column, lang: str) -> Column:
    """First non-empty path segment equals ``lang``; an empty hint keeps all."""
    if not lang:
        return F.lit(True)
    first = F.regexp_extract(url_parts(url).path, "^/*([^/]*)", 1)
    return F.lower(first) == lang.lower()


def first_n_per_key(
    df: DataFrame, keys: list[str], order: list[Column], n: Column | int, spread_by: str, most: int
) -> DataFrame:
    """The first ``n`` rows of each key, exactly, with a hot key shared out.

    Each key is cut to ``most`` rows within ``SALTS`` shares first; only those
    few rows meet in one task for the final cut.
    """
    salt = F.pmod(F.xxhash64(spread_by), F.lit(SALTS))
    shares = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    limit = F.lit(n) if isinstance(n, int) else n
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(shares))
        .filter(F.col("_rank") <= most)
        .withColumn("_rank", F.row_number().over(whole))
        .filter(F.col("_rank") <= limit)
        .drop("_salt", "_rank")
    )
