"""Inputs derived from the given tables, the same in Spark and in SQL.

The tables hold no seeds, sitemaps, robots texts or links between captured
pages, so these are computed from ``pages``. Nothing here gathers a whole site
in one row: a sitemap document lists at most ``LOCS`` pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.session import spread
from pageloom.sources.pages import read_pages

LOCS = 10_000  # locations per derived sitemap document
SITES = 5  # sites of the derived link graph

# Common table expression with the parts of a page URL, by plain regexes.
PARTS = r"""p AS (
  SELECT page_id, url, html,
    regexp_extract(url, '^(https?)://', 1) AS scheme,
    regexp_extract(url, '^https?://([^/?#]*)', 1) AS authority,
    regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin,
    regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
    split_part(url, '#', 1) AS page_url
  FROM pages)"""


def slug_sql(root_path: str, path: str, ext: str = "md") -> str:
    """Output path of a URL path below a root path, spelled out in SQL."""
    named = (
        f"CASE WHEN {path} LIKE '%/' THEN {path} || 'index' "
        f"WHEN {path} = '' THEN 'index' ELSE {path} END"
    )
    bare = rf"regexp_replace({named}, '\.html$', '')"
    folder = f"regexp_replace({bare}, '/index$', '')"
    root = f"rtrim({root_path}, '/')"
    flat = (
        f"CASE WHEN {bare} LIKE '%/index' AND {folder} <> {root} AND {folder} <> {root} || '/' "
        f"THEN CASE WHEN {folder} IN ('', '/') THEN 'index' ELSE {folder} END ELSE {bare} END"
    )
    safe = f"trim(regexp_replace({flat}, '[^a-zA-Z0-9/_-]', '-', 'g'), '/')"
    return f"CASE WHEN {safe} = '' THEN 'index' ELSE {safe} END || '.{ext}'"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages for queries that parse them; the small tables are one split each."""
    return spread(pages(spark, sf_dir), "page_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def origin_of(url: str = "url"):
    return F.regexp_extract(url, r"^(https?://[^/?#]*)", 1)


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per origin of the pages."""
    return pages(spark, sf_dir).select(origin_of().alias("origin")).distinct()


def seeds(spark: SparkSession, sf_dir: str, path: str = "/") -> DataFrame:
    """A seed per origin, numbered by the origin's first page."""
    return (
        pages(spark, sf_dir)
        .groupBy(F.concat(origin_of(), F.lit(path)).alias("seed"))
        .agg(F.min("page_id").alias("seed_id"))
        .select("seed_id", "seed")
    )


def sitemap_documents(listed: DataFrame) -> DataFrame:
    """Sitemap documents for rows of ``root, page_id, url, has_index``.

    Each root gets documents of up to LOCS pages; roots with ``has_index`` also
    get an index that lists these and one document that is missing.
    """
    located = listed.select(
        "root",
        "has_index",
        F.floor(F.col("page_id") / LOCS).cast("bigint").alias("part"),
        "page_id",
        F.replace("url", F.lit("&"), F.lit("&amp;")).alias("loc"),
    )
    locs = F.transform(
        F.array_sort(F.collect_list(F.struct("page_id", "loc"))),
        lambda p: F.concat(F.lit("<url><loc> "), p["loc"], F.lit(" </loc></url>")),
    )
    head = '<{} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    docs = located.groupBy("root", "has_index", "part").agg(
        F.concat(
            F.lit(head.format("urlset")), F.array_join(locs, ""), F.lit("</urlset>")
        ).alias("xml")
    )
    address = F.concat("root", F.lit("sitemap-"), "part", F.lit(".xml"))
    entry = F.concat(F.lit("<sitemap><loc>"), address, F.lit("</loc></sitemap>"))
    index = (
        located.filter("has_index")
        .select("root", "part")
        .distinct()
        .groupBy("root")
        .agg(
            F.concat(
                F.lit(head.format("sitemapindex")),
                F.array_join(F.array_sort(F.collect_list(entry)), ""),
                F.lit("<sitemap><loc>"),
                F.col("root"),
                F.lit("missing.xml</loc></sitemap></sitemapindex>"),
            ).alias("xml")
        )
    )

    def captured(df: DataFrame, url) -> DataFrame:
        return df.select(
            url.alias("url"),
            F.lit(200).alias("status"),
            F.lit("application/xml").alias("content_type"),
            "xml",
        )

    return captured(docs, address).unionByName(
        captured(index, F.concat("root", F.lit("sitemap.xml")))
    )


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every origin; those whose name has even length have an index."""
    origin = origin_of()
    return sitemap_documents(
        pages(spark, sf_dir).select(
            F.concat(origin, F.lit("/")).alias("root"),
            "page_id",
            "url",
            (F.length(origin) % 2 == 0).alias("has_index"),
        )
    )


ROBOTS_BODY = (
    "# rules\nUser-agent: other\nDisallow: /\n\nUser-agent: *\n"
    "Disallow: /fr/\nAllow: /de/1\nDisallow: /de/\n"
)


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robots text per origin; the status depends on the origin's length."""
    status = (
        F.when(F.length("origin") % 5 == 0, 404)
        .when(F.length("origin") % 5 == 1, 403)
        .when(F.length("origin") % 5 == 2, F.lit(None))
        .otherwise(200)
    )
    return origins(spark, sf_dir).select(
        "origin", status.cast("int").alias("status"), F.lit(ROBOTS_BODY).alias("body")
    )


def graph_url(page_id):
    """Address of a page in the derived link graph: SITES sites, whose pages are
    numbered from 1; the first is the site's seed."""
    number = F.floor(page_id / SITES) + 1
    return F.concat(
        F.lit("https://s"),
        F.pmod(page_id, F.lit(SITES)),
        F.lit(".example/d/"),
        F.when(number == 1, F.lit("")).otherwise(number.cast("string")),
    )


def graph_pages(spark: SparkSession, sf_dir: str, copies: bool = False) -> DataFrame:
    """The pages under graph addresses, page n linking to 2n, 2n+1 and n+1.

    With ``copies`` every third page has the HTML of the page before it.
    """
    base = html_pages(spark, sf_dir)
    number = (F.floor(F.col("page_id") / SITES) + 1).cast("bigint")
    rows = base.select("page_id", number.alias("n"), "html")
    source = rows
    if copies:
        before = rows.select(
            (F.col("page_id") + SITES).alias("page_id"), F.col("html").alias("_before"),
            F.col("n").alias("_n"),
        )
        source = rows.join(before, "page_id", "left").select(
            "page_id",
            F.when(F.col("n") % 3 == 0, F.col("_n")).otherwise(F.col("n")).alias("n"),
            F.when(F.col("n") % 3 == 0, F.col("_before")).otherwise(F.col("html")).alias("html"),
        )
    links = F.concat(
        *[
            F.concat(F.lit('<a href="/d/'), target, F.lit('#top">next</a>'))
            for target in (F.col("n") * 2, F.col("n") * 2 + 1, F.col("n") + 1)
        ]
    )
    return source.select(
        "page_id",
        graph_url(F.col("page_id")).alias("url"),
        F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), links)).alias("html"),
    )


def graph_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first address of each site."""
    site = F.pmod("page_id", F.lit(SITES))
    return pages(spark, sf_dir).select(
        site.alias("seed_id"), graph_url(site).alias("seed")
    ).distinct()


TOPS = 16  # pages of each tree below this number are seeds


def _tree_path(number):
    """The bits of a page's number after the first, as folders."""
    return F.regexp_replace(F.substring(F.bin(number), 2, 64), "(.)", "$1/")


def tree_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as SITES trees of folders: page n lies in the folder of page n // 2 and
    links to 2n, 2n+1 and n+1."""
    rows = html_pages(spark, sf_dir).select(
        "page_id", F.pmod("page_id", F.lit(SITES)).alias("site"),
        (F.floor(F.col("page_id") / SITES) + 1).cast("bigint").alias("n"), "html",
    )
    links = F.concat(
        *[
            F.concat(F.lit('<a href="/d/'), _tree_path(target), F.lit('">next</a>'))
            for target in (F.col("n") * 2, F.col("n") * 2 + 1, F.col("n") + 1)
        ]
    )
    return rows.select(
        "page_id",
        "n",
        F.concat(F.lit("https://t"), "site", F.lit(".example/d/"), _tree_path(F.col("n"))).alias("url"),
        F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), links)).alias("html"),
    )


def tree_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pages of each tree, whose folders lie in each other."""
    tops = tree_pages(spark, sf_dir).filter(F.col("n") < TOPS)
    return tops.select(F.col("page_id").alias("seed_id"), F.col("url").alias("seed"))


TREE_SQL = rf"""t AS (
  SELECT page_id, site, n, bits, 'https://t' || site || '.example/d/'
    || regexp_replace(bits, '(.)', '\1/', 'g') AS url
  FROM (SELECT page_id, page_id % {SITES} AS site, page_id // {SITES} + 1 AS n,
    substr(bin(page_id // {SITES} + 1), 2) AS bits FROM pages))"""

GRAPH_SQL = f"""g AS (
  SELECT page_id, page_id % {SITES} AS site, page_id // {SITES} + 1 AS n,
    'https://s' || (page_id % {SITES}) || '.example/d/' AS seed,
    'https://s' || (page_id % {SITES}) || '.example/d/'
      || CASE WHEN page_id // {SITES} = 0 THEN '' ELSE (page_id // {SITES} + 1)::VARCHAR END AS url
  FROM pages)"""
