"""Sitemap documents to URL lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.core import let, over, strip_ws
from pageloom.functions.urls import normalize_seed, url_resolve
from pageloom.operators.joins import scope_join
from pageloom.schemas import SITEMAPS
from pageloom.session import work_dir, written

_LOCS = "array<struct<loc:string>>"
_XML_SCHEMA = f"sitemap {_LOCS}, url {_LOCS}"
_ROOT = r"(?s)^(?:[^<]|<[?!][^>]*+>)*+<([^\s/>]++)"


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SITEMAPS).parquet(path)


def _locations(items: Column) -> Column:
    """Stripped non-blank locations in document order."""
    stripped = F.transform(F.coalesce(items, F.array()), lambda i: strip_ws(i["loc"]))
    return F.filter(stripped, lambda u: u != "")


def parsed_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """``url, status, content_type, root, children, urls`` per document.

    Namespaces are ignored; broken XML gives empty lists.
    """
    xml = F.from_xml(F.col("xml"), _XML_SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    return sitemaps.select(
        "url",
        "status",
        "content_type",
        F.regexp_extract("xml", _ROOT, 1).alias("root"),
        xml.alias("_xml"),
    ).select(
        "url",
        "status",
        "content_type",
        "root",
        over(_locations, "_xml.sitemap").alias("children"),
        over(_locations, "_xml.url").alias("urls"),
    )


def sitemap_gate() -> Column:
    """Success and XML."""
    return (F.col("status") == 200) & F.coalesce(
        F.col("content_type"), F.lit("")
    ).contains("xml")


def sitemap_places(seed: Column) -> Column:
    """Addresses of a seed's sitemaps: at its host's root and next to it."""

    def resolved(base: Column) -> Column:
        return F.array(*[url_resolve(base, F.lit(p)) for p in ("/sitemap.xml", "sitemap.xml")])

    return F.array_distinct(let(normalize_seed(seed), resolved))


def sitemap_candidates(seeds: DataFrame) -> DataFrame:
    """``seed_id, seed, place, sitemap_url``, both places of each seed.

    A seed at the host root has the same address twice; it is kept once, or
    every page below would be listed twice.
    """
    places = over(sitemap_places, "seed")
    return seeds.select("seed_id", "seed", F.posexplode(places).alias("place", "sitemap_url"))


def listed_urls(sitemaps: DataFrame) -> DataFrame:
    """``sitemap_url, child_no, pos, url`` of every accepted document.

    A urlset lists its own URLs; an index lists those of its children, one level
    deep. A child needs success only, not an XML content type. The XML is parsed once
    and its lists written; the branches read those.
    """
    folder = work_dir(sitemaps.sparkSession)
    docs = written(parsed_sitemaps(sitemaps), f"{folder}/sitemaps")
    accepted = docs.filter(sitemap_gate())
    own = accepted.filter(F.col("root").endswith("urlset")).select(
        F.col("url").alias("sitemap_url"), F.lit(0).alias("child_no"), "urls"
    )
    children = docs.filter(F.col("status") == 200).select(
        F.col("url").alias("child_url"), "urls"
    )
    indexed = (
        accepted.filter(F.col("root").endswith("sitemapindex"))
        .select(
            F.col("url").alias("sitemap_url"),
            F.posexplode("children").alias("child_no", "child_url"),
        )
        .join(children, "child_url")
        .select("sitemap_url", "child_no", "urls")
    )
    return own.unionByName(indexed).select(
        "sitemap_url", "child_no", F.posexplode("urls").alias("pos", "url")
    )


def sitemap_urls(
    seeds: DataFrame, sitemaps: DataFrame, distinct: bool = True
) -> DataFrame:
    """``seed_id, seed, url, ord`` of the listed URLs in each seed's scope."""
    return scoped_urls(seeds, listed_urls(sitemaps), distinct)


def scoped_urls(seeds: DataFrame, listed: DataFrame, distinct: bool = True) -> DataFrame:
    """``sitemap_urls`` of a table of listed URLs.

    URLs meet their seeds by scope prefix, then the document must be one of the
    seed's two places. So a host with many seeds and a large sitemap never pairs
    every seed with every URL.
    """
    scoped = sitemap_candidates(seeds).withColumn("scope", over(normalize_seed, "seed"))
    places = scoped.groupBy("seed_id", "seed", "scope").agg(
        F.map_from_entries(F.collect_list(F.struct("sitemap_url", "place"))).alias("_places")
    )
    found = (
        scope_join(listed, places)
        .withColumn("_place", F.try_element_at("_places", F.col("sitemap_url")))
        .filter(F.col("_place").isNotNull())
        .withColumn("ord", F.array("_place", "child_no", "pos"))
        .select("seed_id", "seed", "url", "ord")
    )
    if distinct:
        return found.groupBy("seed_id", "seed", "url").agg(F.min("ord").alias("ord"))
    return found


def sitemap_stats(seeds: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """A3: listed and in-scope URLs per seed, duplicates included.

    Totals come from one count per document, not from pairing seeds with URLs.
    """
    listed = listed_urls(sitemaps)
    sizes = listed.groupBy("sitemap_url").agg(F.count("*").alias("_urls"))
    total = (
        sitemap_candidates(seeds)
        .join(sizes, "sitemap_url")
        .groupBy("seed_id", "seed")
        .agg(F.sum("_urls").alias("total"))
    )
    inside = (
        scoped_urls(seeds, listed, distinct=False)
        .groupBy("seed_id")
        .agg(F.count("*").alias("in_scope"))
    )
    return total.join(inside, "seed_id", "left").select(
        "seed", "total", F.coalesce("in_scope", F.lit(0)).alias("in_scope")
    )
