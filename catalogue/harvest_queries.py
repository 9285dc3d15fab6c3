"""Sitemaps, crawls, exports, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.content_queries import CLEANED, MARKDOWN, PLAIN, TITLE
from catalogue.inputs import (
    GRAPH_SQL,
    LOCS,
    PARTS,
    SITES,
    TOPS,
    TREE_SQL,
    graph_pages,
    graph_seeds,
    graph_url,
    html_pages,
    origin_of,
    pages,
    seeds,
    sitemap_documents,
    sitemaps,
    slug_sql,
    tree_pages,
    tree_seeds,
)
from catalogue.registry import query
from catalogue.url_queries import PLACED, placed
from pageloom.config import HarvestConfig
from pageloom.functions.urls import content_sha1
from pageloom.operators.aggregates import first_seen, last_write_wins
from pageloom.operators.content import link_targets
from pageloom.operators.joins import first_by_hash, scope_join
from pageloom.plans.crawl import crawl
from pageloom.plans.export import (
    changed_rows,
    diff_status,
    export_log,
    export_rows,
    planned_writes,
    raw_html_rows,
    standing_export,
    write_changes,
    write_export,
)
from pageloom.plans.harvest import harvest, sitemap_harvest
from pageloom.plans.recrawl import Recrawl
from pageloom.plans.shared import shared_crawl
from pageloom.schemas import PAGES, PAGES_FULL
from pageloom.session import work_dir
from pageloom.sources import sitemaps as S
from pageloom.sources.exports import read_export
from pageloom.streaming.captures import stream_dedup, stream_diff_export, stream_pages
from pageloom.streaming.newest import FOUND as NEWEST
from pageloom.streaming.newest import stream_newest

_DOC = f"origin || '/sitemap-' || (page_id // {LOCS}) || '.xml'"


@query(
    "sitemap_urls",
    rf"""WITH {PARTS}, d AS (
      SELECT origin, {_DOC} AS doc, page_id // {LOCS} AS part, url,
        row_number() OVER (PARTITION BY {_DOC} ORDER BY page_id) - 1 AS pos FROM p)
    SELECT doc AS sitemap_url, 0::BIGINT AS child_no, pos, url FROM d
    UNION ALL
    SELECT origin || '/sitemap.xml',
      dense_rank() OVER (PARTITION BY origin ORDER BY part::VARCHAR) - 1, pos, url
    FROM d WHERE length(origin) % 2 = 0""",
)
def sitemap_urls(spark, sf_dir):
    listed = S.listed_urls(sitemaps(spark, sf_dir))
    return listed.withColumns({c: F.col(c).cast("bigint") for c in ("child_no", "pos")})


@query(
    "sitemap_index",
    rf"""WITH {PARTS}, c AS (
      SELECT DISTINCT origin || '/sitemap.xml' AS url, {_DOC} AS child_url FROM p
      WHERE length(origin) % 2 = 0
      UNION SELECT DISTINCT origin || '/sitemap.xml', origin || '/missing.xml' FROM p
      WHERE length(origin) % 2 = 0)
    SELECT url, child_url FROM c""",
)
def sitemap_index(spark, sf_dir):
    docs = S.parsed_sitemaps(sitemaps(spark, sf_dir)).filter(S.sitemap_gate())
    return docs.select("url", F.explode("children").alias("child_url"))


@query(
    "sitemap_candidates",
    rf"""WITH {PARTS}, o AS (SELECT DISTINCT origin FROM p)
    SELECT origin || '/en' AS seed, 0::BIGINT AS place, origin || '/sitemap.xml' AS sitemap_url
    FROM o
    UNION ALL SELECT origin || '/en', 1, origin || '/en/sitemap.xml' FROM o
    UNION ALL SELECT origin || '/', 0, origin || '/sitemap.xml' FROM o""",
)
def sitemap_candidates(spark, sf_dir):
    both = seeds(spark, sf_dir, "/en").unionByName(seeds(spark, sf_dir, "/"))
    return S.sitemap_candidates(both).select(
        "seed", F.col("place").cast("bigint").alias("place"), "sitemap_url"
    )


@query(
    "sitemap_stats",
    rf"""WITH {PARTS} SELECT origin || '/en/' AS seed, count(*) AS total,
      count(*) FILTER (WHERE path LIKE '/en/%') AS in_scope
    FROM p WHERE length(origin) % 2 = 0 GROUP BY ALL""",
)
def sitemap_stats(spark, sf_dir):
    return S.sitemap_stats(seeds(spark, sf_dir, "/en/"), sitemaps(spark, sf_dir))


@query(
    "sitemap_harvest",
    rf"""WITH {PARTS} SELECT origin || '/en/' AS seed, url, page_id FROM p
    WHERE length(origin) % 2 = 0 AND path LIKE '/en/%' AND page_id % 7 <> 0""",
)
def sitemap_harvest_query(spark, sf_dir):
    captured = pages(spark, sf_dir).withColumn(
        "status", F.when(F.col("page_id") % 7 == 0, 404).otherwise(200)
    )
    saved = sitemap_harvest(seeds(spark, sf_dir, "/en/"), sitemaps(spark, sf_dir), captured)
    return saved.select("seed", "url", "page_id")


_STEP = "x.n IN (2 * r.n, 2 * r.n + 1, r.n + 1)"


# Page n is reached over its halves, so its depth is below its number of bits.
BITS = "(SELECT 1 + floor(log2(max(n))) FROM g)"
UNLIMITED = HarvestConfig(max_pages=None)


def _reach(depth: str, where: str = "true", sites: str = "true") -> str:
    """Pages of the derived graph by least depth, which is at most ``depth``."""
    return f"""r(site, n, d) AS (
      SELECT site, n, 0 FROM g WHERE n = 1 AND {sites}
      UNION SELECT r.site, x.n, d + 1 FROM r JOIN g x ON x.site = r.site AND {_STEP}
      WHERE d < {depth} AND ({where})),
    least AS (SELECT site, n, min(d) AS depth FROM r GROUP BY ALL)"""


@query(
    "bfs_depth",
    f"""WITH RECURSIVE {GRAPH_SQL}, {_reach(BITS)}
    SELECT seed, url, depth::BIGINT AS depth FROM least JOIN g USING (site, n)""",
)
def bfs_depth(spark, sf_dir):
    saved = crawl(graph_seeds(spark, sf_dir), graph_pages(spark, sf_dir), cfg=UNLIMITED)
    return saved.select("seed", "url", F.col("depth").cast("bigint").alias("depth"))


@query(
    "crawl_seen_filter",
    f"""WITH RECURSIVE {GRAPH_SQL}, {_reach(BITS)}
    SELECT seed, url, depth::BIGINT AS depth FROM least JOIN g USING (site, n)""",
)
def crawl_seen_filter(spark, sf_dir):
    """P8, J2 by the filter of seen URLs."""
    cfg = HarvestConfig(max_pages=None, seen_filter=1 << 12)
    saved = crawl(graph_seeds(spark, sf_dir), graph_pages(spark, sf_dir), cfg=cfg)
    return saved.select("seed", "url", F.col("depth").cast("bigint").alias("depth"))


def _graph_robots(spark, sf_dir):
    return graph_seeds(spark, sf_dir).select(
        F.regexp_extract("seed", "^(https://[^/]*)", 1).alias("origin"),
        F.lit(200).alias("status"),
        F.lit("User-agent: *\nAllow: /d/60\nDisallow: /d/6\n").alias("body"),
    )


@query(
    "crawl_filters",
    f"""WITH RECURSIVE {GRAPH_SQL}, {_reach(
        "4",
        "NOT (starts_with(x.n::VARCHAR, '6') AND NOT starts_with(x.n::VARCHAR, '60')) "
        "AND x.n NOT IN (5, 11)")}
    SELECT seed, url, depth::BIGINT AS depth FROM least JOIN g USING (site, n)""",
)
def crawl_filters(spark, sf_dir):
    cfg = HarvestConfig(max_pages=None, depth=4, include=r"^https://s\d\.", exclude=r"/d/(5|11)$")
    saved = crawl(
        graph_seeds(spark, sf_dir), graph_pages(spark, sf_dir), _graph_robots(spark, sf_dir), cfg
    )
    return saved.select("seed", "url", F.col("depth").cast("bigint").alias("depth"))


@query(
    "crawl_rules",
    f"""WITH RECURSIVE {GRAPH_SQL}, {_reach(
        "(SELECT max(n) FROM g)",
        "NOT (starts_with(x.n::VARCHAR, '6') AND NOT starts_with(x.n::VARCHAR, '60')) "
        "AND x.n NOT IN (5, 11)")}
    SELECT seed, url, depth::BIGINT AS depth FROM least JOIN g USING (site, n)""",
)
def crawl_rules(spark, sf_dir):
    """P3, P4 on whole sites; a page behind refused ones may lie deep."""
    cfg = HarvestConfig(max_pages=None, include=r"^https://s\d\.", exclude=r"/d/(5|11)$")
    saved = crawl(
        graph_seeds(spark, sf_dir), graph_pages(spark, sf_dir), _graph_robots(spark, sf_dir), cfg
    )
    return saved.select("seed", "url", F.col("depth").cast("bigint").alias("depth"))


@query(
    "crawl_shared",
    f"""WITH RECURSIVE {TREE_SQL}, r(top, site, n, d) AS (
      SELECT n, site, n, 0 FROM t WHERE n < {TOPS}
      UNION SELECT r.top, r.site, x.n, d + 1 FROM r
      JOIN t x ON x.site = r.site AND {_STEP}
      JOIN t s ON s.site = r.site AND s.n = r.top AND starts_with(x.bits, s.bits)
      WHERE d < (SELECT 1 + floor(log2(max(n))) FROM t)),
    least AS (SELECT top, site, n, min(d) AS depth FROM r GROUP BY ALL)
    SELECT s.page_id AS seed_id, s.url AS seed, t.url, t.page_id, depth::BIGINT AS depth
    FROM least JOIN t USING (site, n) JOIN t s ON s.site = least.site AND s.n = top""",
)
def crawl_shared(spark, sf_dir):
    """C1 for seeds whose folders lie in each other, in one walk."""
    pages_ = tree_pages(spark, sf_dir).drop("n")
    saved = shared_crawl(tree_seeds(spark, sf_dir), pages_, cfg=UNLIMITED)
    return saved.select("seed_id", "seed", "url", "page_id", F.col("depth").cast("bigint").alias("depth"))


@query(
    "crawl_waves",
    f"""WITH RECURSIVE {GRAPH_SQL}, {_reach("(SELECT max(n) FROM g)", "x.page_id % 25 <> 9")}
    SELECT seed, url, depth::BIGINT AS depth,
      CASE WHEN page_id % 10 = 3 THEN page_id + 1000000000 ELSE page_id END AS page_id
    FROM least JOIN g USING (site, n)""",
)
def crawl_waves(spark, sf_dir):
    """C1 kept up to date over three waves: most pages; the others, and some once more with
    the text that is known; some that are refused by then."""
    rows = graph_pages(spark, sf_dir)
    state = Recrawl(spark, f"{work_dir(spark)}/log", graph_seeds(spark, sf_dir), cfg=UNLIMITED)
    modulo = F.col("page_id") % 10

    def wave(part, at, name=0, status=200):
        return part.select(
            (F.col("page_id") + name).alias("page_id"),
            "url",
            "html",
            F.lit(status).alias("status"),
            F.lit("text/html").alias("content_type"),
            F.timestamp_seconds(F.lit(at)).alias("captured_at"),
        )

    state.update(wave(rows.filter(modulo != 7), 1))
    state.update(wave(rows.filter(modulo == 7), 2).unionByName(wave(rows.filter(modulo == 3), 2, 10**9)))
    state.update(wave(rows.filter(F.col("page_id") % 25 == 9), 3, 2 * 10**9, 404))
    return state.saved().select("seed", "url", F.col("depth").cast("bigint").alias("depth"), "page_id")


# Six pages of a site lie less than four levels deep.
@query(
    "crawl_max_pages",
    f"""WITH RECURSIVE {GRAPH_SQL}, r(site, n, d, path) AS (
      SELECT site, n, 0, []::BIGINT[] FROM g WHERE n = 1
      UNION ALL SELECT r.site, x.n, d + 1,
        list_append(path, list_position([2 * r.n, 2 * r.n + 1, r.n + 1], x.n)::BIGINT)
      FROM r JOIN g x ON x.site = r.site AND {_STEP} WHERE d < 4),
    first AS (SELECT site, n, min(d) AS depth, arg_min(path, (d, path)) AS path
      FROM r GROUP BY ALL),
    saved AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY depth, path) AS k
      FROM first)
    SELECT seed, url, depth::BIGINT AS depth FROM saved JOIN g USING (site, n) WHERE k <= 6""",
)
def crawl_max_pages(spark, sf_dir):
    cfg = HarvestConfig(max_pages=6)
    saved = crawl(graph_seeds(spark, sf_dir), graph_pages(spark, sf_dir), cfg=cfg)
    return saved.select("seed", "url", F.col("depth").cast("bigint").alias("depth"))


@query(
    "crawl_dedup",
    f"""WITH {GRAPH_SQL}, h AS (
      SELECT g.page_id, g.seed, g.url, CASE WHEN g.n % 3 = 0 THEN b.html ELSE a.html END AS html
      FROM g JOIN pages a USING (page_id) LEFT JOIN pages b ON b.page_id = g.page_id - {SITES})
    SELECT seed, min(page_id) AS page_id, arg_min(url, page_id) AS url
    FROM h GROUP BY seed, sha1(html)""",
)
def crawl_dedup(spark, sf_dir):
    """J3 on every page of every site, copies included."""
    copied = graph_pages(spark, sf_dir, copies=True)
    rows = copied.select(
        F.pmod("page_id", F.lit(SITES)).alias("seed_id"),
        F.regexp_extract("url", "^(https://[^/]*/d/)", 1).alias("seed"),
        content_sha1(F.col("html")).alias("sha1"),
        F.col("page_id").alias("ord"),
        "page_id",
        "url",
    )
    return first_by_hash(rows).select("seed", "page_id", "url")


@query(
    "first_seen",
    rf"""WITH {PARTS}, h AS (
      SELECT page_id, origin, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM p),
    f AS (SELECT page_id, origin, unnest(hrefs) AS href,
      generate_subscripts(hrefs, 1) AS pos FROM h)
    SELECT url, m.page_id AS page_id, m.pos::BIGINT AS pos FROM (
      SELECT origin || href AS url, min({{'page_id': page_id, 'pos': pos}}) AS m
      FROM f GROUP BY ALL)""",
)
def first_seen_query(spark, sf_dir):
    found = link_targets(html_pages(spark, sf_dir))
    queue = found.select(
        F.xxhash64(origin_of()).alias("seed_id"),
        F.col("target").alias("url"),
        F.struct("page_id", "pos").alias("ord"),
    )
    return first_seen(queue).select(
        "url", "ord.page_id", F.col("ord.pos").cast("bigint").alias("pos")
    )


@query(
    "harvest_routes",
    f"""WITH RECURSIVE {GRAPH_SQL}, {_reach(BITS, sites="site % 2 = 1")}
    SELECT 'sitemap' AS route, seed, count(*) AS pages FROM g WHERE site % 2 = 0 GROUP BY ALL
    UNION ALL SELECT 'crawl', seed, count(*) FROM least JOIN g USING (site, n) GROUP BY ALL""",
)
def harvest_routes(spark, sf_dir):
    captured = graph_pages(spark, sf_dir)
    even = captured.filter(F.pmod("page_id", F.lit(SITES)) % 2 == 0)
    maps = sitemap_documents(
        even.select(
            F.regexp_extract("url", "^(https://[^/]*/d/)", 1).alias("root"),
            "page_id",
            "url",
            F.lit(True).alias("has_index"),
        )
    )
    saved = harvest(
        graph_seeds(spark, sf_dir),
        captured,
        maps,
        cfg=HarvestConfig(sitemap=True, max_pages=None),
    )
    return saved.groupBy("route", "seed").agg(F.count("*").alias("pages"))


def _saved(spark, sf_dir):
    """All pages, each found through the seed of its origin."""
    return scope_join(
        pages(spark, sf_dir).select("page_id", "url"),
        seeds(spark, sf_dir),
        scope="seed",
    ).select(
        "seed_id",
        "seed",
        "url",
        F.lit(0).alias("depth"),
        F.array("page_id").alias("ord"),
        "page_id",
    )


def _export(spark, sf_dir, fmt="md", **options):
    return export_rows(
        _saved(spark, sf_dir),
        html_pages(spark, sf_dir),
        HarvestConfig(format=fmt, **options),
        date=F.lit(1700000000),
    )


# Both schemes of a host share a directory; the seed that comes later writes last.
_WON = f"""{PLACED}, won AS (
  SELECT domain, out_path, arg_max(page_id, (seed_id, page_id)) AS page_id
  FROM w JOIN (SELECT origin, min(page_id) AS seed_id FROM w GROUP BY origin) USING (origin)
  GROUP BY domain, out_path)"""


@query(
    "markdown_export",
    f"""WITH {_WON}, {MARKDOWN}
    SELECT domain, out_path, 'md' AS format, {TITLE} AS title, pages.url,
      E'---\\ntitle: ' || replace({TITLE}, ':', '-') || E'\\nurl: ' || pages.url
        || E'\\ndate_scraped: 1700000000\\n---\\n' || markdown AS content
    FROM won JOIN pages USING (page_id) JOIN md USING (page_id)""",
)
def markdown_export(spark, sf_dir):
    rows = _export(spark, sf_dir)
    return rows.select("domain", "out_path", "format", "title", "url", "content")


@query("summary_totals", f"WITH {PLACED} SELECT count(DISTINCT (domain, out_path)) AS count FROM w")
def summary_totals(spark, sf_dir):
    return planned_writes(_saved(spark, sf_dir), "md").agg(F.count("*").alias("count"))


@query(
    "domain_partition",
    f"""WITH {_WON}, {PLAIN} SELECT domain, count(*) AS files, sum(length(content))::BIGINT AS chars
    FROM won JOIN plain USING (page_id) GROUP BY domain""",
)
def domain_partition(spark, sf_dir):
    """K2: what the partitioned sink holds after a full text export."""
    path = f"{work_dir(spark)}/export"
    write_export(_export(spark, sf_dir, "txt"), path)
    files, chars = F.count("*").alias("files"), F.sum(F.length("content")).alias("chars")
    return spark.read.parquet(path).groupBy("domain").agg(files, chars)


@query(
    "export_tree",
    f"""WITH {_WON}, {CLEANED} SELECT domain, replace(out_path, '.md', '.html') AS out_path,
      'html' AS format, html_cleaned AS content FROM won JOIN cleaned USING (page_id)""",
)
def export_tree(spark, sf_dir):
    """Cleaned HTML as documents."""
    path = f"{work_dir(spark)}/export"
    write_export(_export(spark, sf_dir, "html"), path)
    return spark.read.parquet(path).select("domain", "out_path", "format", "content")


@query(
    "raw_html_sidecar",
    f"""WITH {_WON} SELECT domain, replace(out_path, '.md', '.raw.html') AS out_path,
      sha1(html) AS sha1 FROM won JOIN pages USING (page_id)""",
)
def raw_html_sidecar(spark, sf_dir):
    rows = raw_html_rows(
        _saved(spark, sf_dir), pages(spark, sf_dir), HarvestConfig(format="txt", save_html=True)
    )
    return rows.select("domain", "out_path", F.sha1("content").alias("sha1"))


@query(
    "diff_skip",
    f"""WITH {PLACED}, c AS (SELECT domain, out_path, max(page_id) AS page_id FROM w GROUP BY ALL)
    SELECT domain, out_path FROM c WHERE page_id % 5 = 0 OR page_id % 10 = 3""",
)
def diff_skip(spark, sf_dir):
    """K3 with the last export changed or emptied in places."""
    hashes = pages(spark, sf_dir).select(
        "page_id", content_sha1(F.col("html")).alias("content_sha1")
    )
    current = (
        last_write_wins(placed(spark, sf_dir), order="page_id")
        .join(hashes, "page_id")
        .withColumn("format", F.lit("md"))
    )
    previous = current.filter(F.col("page_id") % 10 != 3).withColumn(
        "content_sha1", F.when(F.col("page_id") % 5 == 0, "old").otherwise(F.col("content_sha1"))
    )
    return changed_rows(current, previous).select("domain", "out_path")


def _version(spark, sf_dir, keep, text):
    """An export of those pages, with texts of their own."""
    won = last_write_wins(placed(spark, sf_dir).select("domain", "out_path", "page_id", "url"), order="page_id")
    rows = won.filter(keep).withColumns(
        {
            "format": F.lit("md"),
            "title": F.lit(""),
            "content": F.concat(F.lit("text "), "page_id", text),
            "captured_at": F.lit(None).cast("timestamp"),
        }
    )
    return rows.withColumn("content_sha1", content_sha1(F.col("content"))).drop("page_id")


@query(
    "export_versions",
    f"""WITH {PLACED}, c AS (SELECT domain, out_path, max(page_id) AS page_id FROM w GROUP BY ALL)
    SELECT 0 AS version, domain, out_path, 'text ' || page_id || ' one' AS content FROM c WHERE page_id % 3 <> 0
    UNION ALL SELECT 1, domain, out_path, 'text ' || page_id || CASE WHEN page_id % 5 = 0 THEN ' two' ELSE ' one' END
    FROM c WHERE page_id % 3 <> 1
    UNION ALL SELECT 2, domain, out_path, 'text ' || page_id || ' one' FROM c""",
)
def export_versions(spark, sf_dir):
    """Complete exports in which pages go and come back, read as of each version."""
    path = f"{work_dir(spark)}/export"
    page_id, one = F.col("page_id"), F.lit(" one")
    edited = F.when(page_id % 5 == 0, " two").otherwise(one)
    write_changes(_version(spark, sf_dir, page_id % 3 != 0, one), path, 0, complete=True)
    write_changes(_version(spark, sf_dir, page_id % 3 != 1, edited), path, 1, complete=True)
    write_changes(_version(spark, sf_dir, F.lit(True), one), path, 2, complete=True)
    read = [
        standing_export(spark, path, n).select(F.lit(n).alias("version"), "domain", "out_path", "content") for n in range(3)
    ]
    return read[0].unionByName(read[1]).unionByName(read[2])


@query(
    "export_log",
    f"""WITH {PLACED}, c AS (SELECT domain, out_path, max(page_id) AS page_id FROM w GROUP BY ALL)
    SELECT 0::BIGINT AS version, count(*) FILTER (page_id % 3 <> 0) AS written, 0::BIGINT AS removed FROM c
    UNION ALL SELECT 1, count(*) FILTER (page_id % 3 = 0 OR (page_id % 3 = 2 AND page_id % 5 = 0)),
      count(*) FILTER (page_id % 3 = 1) FROM c""",
)
def export_log_query(spark, sf_dir):
    path = f"{work_dir(spark)}/export"
    page_id = F.col("page_id")
    edited = F.when(page_id % 5 == 0, " two").otherwise(" one")
    write_changes(_version(spark, sf_dir, page_id % 3 != 0, F.lit(" one")), path, 0, complete=True)
    write_changes(_version(spark, sf_dir, page_id % 3 != 1, edited), path, 1, complete=True)
    return export_log(spark, path)


@query(
    "previous_export",
    f"""WITH {PLACED}, c AS (SELECT domain, out_path, max(page_id) AS page_id FROM w GROUP BY ALL)
    SELECT domain, replace(out_path, '.md', '.txt') AS out_path, CASE
      WHEN page_id % 10 = 3 THEN 'missing' WHEN page_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS status
    FROM c""",
)
def previous_export(spark, sf_dir):
    """A stored export against one in which texts have changed or gone."""
    path = f"{work_dir(spark)}/export"
    saved = placed(spark, sf_dir).select("domain", "out_path", "page_id", "url")
    last = last_write_wins(saved, order="page_id").withColumns(
        {
            "out_path": F.replace("out_path", F.lit(".md"), F.lit(".txt")),
            "format": F.lit("txt"),
            "title": F.lit(""),
            "content": F.concat(F.lit("text of "), "url"),
            "captured_at": F.lit(None).cast("timestamp"),
        }
    )
    stored = last.withColumn("content_sha1", content_sha1(F.col("content")))
    write_export(stored.drop("page_id"), path)
    edited = F.when(F.col("page_id") % 5 == 0, "new text").otherwise(F.col("content"))
    current = last.filter("page_id % 10 <> 3").withColumn("content_sha1", content_sha1(edited))
    return diff_status(current, read_export(spark, path)).select("domain", "out_path", "status")


@query(
    "sitemap_gate",
    rf"""WITH {PARTS} SELECT {_DOC} AS sitemap_url, count(*) AS urls FROM p
    WHERE length(authority) % 3 <> 0 AND length(authority) % 4 <> 0 GROUP BY ALL""",
)
def sitemap_gate(spark, sf_dir):
    """Documents that were refused or are not XML list nothing."""
    docs = sitemaps(spark, sf_dir)
    host = F.length(F.regexp_extract("url", "^https?://([^/]*)", 1))
    docs = docs.filter(~F.col("url").endswith("/sitemap.xml")).withColumns(
        {
            "status": F.when(host % 3 == 0, 404).otherwise(200),
            "content_type": F.when(host % 4 == 0, "text/html").otherwise(F.col("content_type")),
        }
    )
    return S.listed_urls(docs).groupBy("sitemap_url").agg(F.count("*").alias("urls"))


def _run(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


@query(
    "stream_dedup",
    """SELECT split_part(url, '#', 1) AS url,
      CASE WHEN bool_or(page_id % 2 = 0) THEN 0 ELSE 1 END AS wave FROM pages GROUP BY ALL""",
)
def stream_dedup_query(spark, sf_dir):
    """ST1: the captures and copies of them, each wave a run of its own; a page is told by the
    first wave that has its URL."""
    folder = work_dir(spark)
    rows = pages(spark, sf_dir)
    for n, part in enumerate((rows.filter("page_id % 2 = 0"), rows, rows.filter("page_id % 3 = 0"))):
        part.write.mode("append").parquet(f"{folder}/in/wave={n}")
        found = spark.readStream.schema(f"{PAGES}, wave int").parquet(f"{folder}/in")
        unique = stream_dedup(found).select("url", "wave")
        _run(
            unique.writeStream.format("parquet")
            .option("path", f"{folder}/urls")
            .option("checkpointLocation", f"{folder}/checkpoint")
        )
    return spark.read.schema("url string, wave int").parquet(f"{folder}/urls")


# Waves of captures: all pages; even ones again, some of them changed; all of them as they
# were before the second wave.
_CAPTURED = """c AS (
  SELECT wave, moment, page_id + name AS page_id, split_part(url, '#', 1) AS url, sha1(html || mark) AS sha1
  FROM (SELECT 1 AS wave, 10 AS moment, page_id, 0 AS name, url, html, '' AS mark FROM pages
    UNION ALL SELECT 2, 20, page_id, 1000000000, url, html, CASE WHEN page_id % 3 = 0 THEN 'x' ELSE '' END
      FROM pages WHERE page_id % 2 = 0
    UNION ALL SELECT 3, 15, page_id, 2000000000, url, html, '' FROM pages)),
  o AS (SELECT *, moment * 10000000000 + page_id AS place FROM c),
  b AS (SELECT *, max(place) OVER earlier AS known, arg_max(sha1, place) OVER earlier AS known_sha1 FROM o
    WINDOW earlier AS (PARTITION BY url ORDER BY wave, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(
    "stream_newest",
    f"""WITH {_CAPTURED} SELECT url, page_id, sha1, CASE WHEN known IS NULL THEN 'new'
      WHEN sha1 = known_sha1 THEN 'unchanged' ELSE 'changed' END AS status
    FROM b WHERE known IS NULL OR place > known""",
)
def stream_newest_query(spark, sf_dir):
    """ST1 with a memory of newest captures, over three waves and as many restarts."""
    folder = work_dir(spark)
    rows = pages(spark, sf_dir)
    edited = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html"))

    def captures(part, name, moment, html="html"):
        return part.select(
            (F.col("page_id") + name).alias("page_id"), "url", html, F.timestamp_seconds(F.lit(moment)).alias("captured_at")
        )

    waves = (
        captures(rows, 0, 10),
        captures(rows.filter("page_id % 2 = 0"), 10**9, 20, edited.alias("html")),
        captures(rows, 2 * 10**9, 15),
    )
    for wave in waves:
        wave.write.mode("append").parquet(f"{folder}/in")
        found = stream_newest(stream_pages(spark, f"{folder}/in", f"{PAGES}, captured_at timestamp"), keep_seconds=3600)
        _run(
            found.writeStream.format("parquet")
            .option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/checkpoint")
        )
    return spark.read.schema(NEWEST).parquet(f"{folder}/out").select("url", "page_id", "sha1", "status")


# Two waves of captures of the given addresses. Of the second, ids leave modulo 5: 0 new
# pages, 1 unchanged, 2 changed, 3 refused, 4 changed but captured before the first wave.
_WAVES = """waves AS (
  SELECT 0 AS batch, page_id, 'page ' || page_id || ' one' AS content, 200 AS status, 10 AS moment
  FROM pages WHERE page_id % 5 <> 0
  UNION ALL SELECT 1, page_id + 1000000000,
    CASE WHEN page_id % 5 = 1 THEN 'page ' || page_id || ' one' ELSE 'page ' || page_id || ' two' END,
    CASE WHEN page_id % 5 = 3 THEN 404 ELSE 200 END, CASE WHEN page_id % 5 = 4 THEN 5 ELSE 20 END
  FROM pages)"""


def _waves(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", "url", (F.col("page_id") % 5).alias("kind"))

    def capture(name, version, status, at):
        text = F.concat(F.lit("page "), F.col("page_id"), version)
        return rows.select(
            (F.col("page_id") + name).alias("page_id"),
            "url",
            F.concat(F.lit("<html><body><article>"), text, F.lit("</article></body></html>")).alias("html"),
            F.lit(status).alias("status") if isinstance(status, int) else status.alias("status"),
            F.lit("text/html").alias("content_type"),
            F.timestamp_seconds(at).alias("captured_at"),
            "kind",
        )

    second = F.when(F.col("kind") == 1, " one").otherwise(" two")
    refused = F.when(F.col("kind") == 3, 404).otherwise(200)
    return (
        capture(0, F.lit(" one"), 200, F.lit(10)).filter("kind <> 0").drop("kind"),
        capture(10**9, second, refused, F.when(F.col("kind") == 4, 5).otherwise(20)).drop("kind"),
    )


@query(
    "stream_diff_export",
    f"""WITH {PLACED}, {_WAVES},
    f AS (SELECT origin, min(page_id) AS seed_id FROM w GROUP BY origin),
    c AS (SELECT v.*, w.domain, replace(w.out_path, '.md', '.txt') AS out_path, w.page_url, f.seed_id
      FROM waves v JOIN w ON w.page_id = v.page_id % 1000000000 JOIN f USING (origin)),
    u AS (SELECT * FROM c
      QUALIFY row_number() OVER (PARTITION BY batch, page_url ORDER BY moment DESC, page_id DESC) = 1),
    k AS (SELECT * FROM u WHERE status = 200 QUALIFY row_number() OVER (
      PARTITION BY batch, domain, out_path ORDER BY seed_id DESC, moment DESC, page_id DESC) = 1)
    SELECT n.batch::INT AS batch_id, n.domain, n.out_path, n.content FROM k n
    LEFT JOIN k o ON n.batch = 1 AND o.batch = 0 AND o.domain = n.domain AND o.out_path = n.out_path
    WHERE o.page_id IS NULL OR (n.moment >= o.moment AND n.content <> o.content)""",
)
def stream_diff_export_query(spark, sf_dir):
    """ST2: new, unchanged, changed, refused and late captures after a first wave."""
    folder = work_dir(spark)
    schema = PAGES_FULL
    for wave in _waves(spark, sf_dir):
        wave.write.mode("append").parquet(f"{folder}/in")
        stream_diff_export(
            stream_pages(spark, f"{folder}/in", schema),
            seeds(spark, sf_dir),
            f"{folder}/export",
            f"{folder}/checkpoint",
            HarvestConfig(format="txt"),
        ).start().awaitTermination()
    stored = spark.read.parquet(f"{folder}/export")
    return stored.select("batch_id", "domain", "out_path", "content")
