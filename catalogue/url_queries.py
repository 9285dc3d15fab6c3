"""URL functions, predicates and the reports built on URLs alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.inputs import PARTS, html_pages, origin_of, origins, pages, robots, seeds, slug_sql, table
from catalogue.registry import query
from pageloom.functions import urls as U
from pageloom.functions.events import parse_links
from pageloom.operators import aggregates as A
from pageloom.operators import filters as P
from pageloom.operators import joins as J
from pageloom.sources.robots import robots_rules
from pageloom.sources.seeds import clean_seed_lines


@query(
    "seed_list",
    "SELECT page_id, url AS seed FROM pages WHERE page_id % 5 <> 0",
)
def seed_list(spark, sf_dir):
    line = (
        F.when(F.col("page_id") % 5 == 0, F.lit(" \t "))
        .when(F.col("page_id") % 5 == 1, F.concat(F.lit("\t"), "url", F.lit("  ")))
        .otherwise(F.concat("url", F.lit(" ")))
    )
    return clean_seed_lines(pages(spark, sf_dir).select("page_id", line.alias("value")))


@query(
    "url_parts",
    r"""WITH u AS (
      SELECT page_id, CASE WHEN page_id % 3 = 0
        THEN regexp_replace(url, '^([^?#]*)', '\1;v=1') ELSE url END AS url FROM pages)
    SELECT page_id,
      regexp_extract(url, '^([a-z]+):', 1) AS scheme,
      regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS authority,
      regexp_extract(url, '^[a-z]+://[^/?#]*([^;?#]*)', 1) AS path,
      regexp_extract(url, '^[^;?#]*;([^?#]*)', 1) AS params,
      regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query,
      regexp_extract(url, '#(.*)$', 1) AS fragment
    FROM u""",
)
def url_parts(spark, sf_dir):
    url = F.when(
        F.col("page_id") % 3 == 0, F.regexp_replace("url", "^([^?#]*)", "$1;v=1")
    ).otherwise(F.col("url"))
    return (
        pages(spark, sf_dir).select("page_id", U.url_parts(url).alias("u")).select("page_id", "u.*")
    )


@query("url_defrag", "SELECT page_id, split_part(url, '#', 1) AS url FROM pages")
def url_defrag(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.url_defrag(F.col("url")).alias("url"))


@query("url_host_lower", "SELECT page_id, url FROM pages")
def url_host_lower(spark, sf_dir):
    mixed = F.regexp_replace("url", "example", "Example")
    return pages(spark, sf_dir).select("page_id", U.url_host_lower(mixed).alias("url"))


@query(
    "url_resolve",
    rf"""WITH {PARTS}, h AS (SELECT unnest(['../x', '?q=1', '//H.example/y#f', '/z#f', 'w']) AS href)
    SELECT page_id, href, CASE href
      WHEN '../x' THEN origin
        || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') || 'x'
      WHEN '?q=1' THEN origin || path || '?q=1'
      WHEN '//H.example/y#f' THEN scheme || '://H.example/y#f'
      WHEN '/z#f' THEN origin || '/z#f'
      ELSE origin || regexp_replace(path, '[^/]*$', '') || 'w' END AS resolved
    FROM p, h""",
)
def url_resolve(spark, sf_dir):
    hrefs = F.array(*[F.lit(h) for h in ("../x", "?q=1", "//H.example/y#f", "/z#f", "w")])
    return (
        pages(spark, sf_dir)
        .select("page_id", "url", F.explode(hrefs).alias("href"))
        .select("page_id", "href", U.url_resolve(F.col("url"), F.col("href")).alias("resolved"))
    )


@query(
    "normalize_url",
    rf"""WITH {PARTS}, h AS (
      SELECT page_id, scheme, origin, path,
        regexp_extract_all(html, '<a href="([^"]*)"', 1)
          || ['../x', '?q=1', '//H.example/y', 'mailto:a@b', ''] AS hrefs FROM p),
    f AS (
      SELECT *, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos FROM h)
    SELECT page_id, pos::BIGINT AS pos, href, CASE
      WHEN href = '' OR href LIKE 'mailto:%' THEN NULL
      WHEN href = '//H.example/y' THEN scheme || '://h.example/y'
      WHEN href = '?q=1' THEN origin || path || '?q=1'
      WHEN href = '../x' THEN origin
        || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') || 'x'
      ELSE origin || href END AS target
    FROM f""",
)
def normalize_url(spark, sf_dir):
    extra = F.array(*[F.lit(h) for h in ("../x", "?q=1", "//H.example/y", "mailto:a@b", "")])
    found = html_pages(spark, sf_dir).select(
        "page_id", "url", parse_links(F.col("html")).alias("links")
    )
    return found.select(
        "page_id", "url", F.posexplode(F.concat("links.hrefs", extra)).alias("pos", "href")
    ).select(
        "page_id",
        F.col("pos").cast("bigint").alias("pos"),
        "href",
        U.normalize_url(F.col("url"), F.col("href")).alias("target"),
    )


@query(
    "normalize_seed",
    rf"""WITH {PARTS} SELECT page_id,
      CASE WHEN path <> '' AND path NOT LIKE '%/' THEN url || '/' ELSE url END AS seed FROM p""",
)
def normalize_seed(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.normalize_seed(F.col("url")).alias("seed"))


@query(
    "crawl_base",
    rf"""WITH {PARTS} SELECT page_id,
      origin || path || CASE WHEN path LIKE '%/' THEN '' ELSE '/' END AS base FROM p""",
)
def crawl_base(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.crawl_base(F.col("url")).alias("base"))


@query(
    "domain_key",
    rf"""WITH {PARTS} SELECT page_id,
      CASE WHEN page_id % 9 = 0 THEN 'unknown' ELSE authority END AS domain FROM p""",
)
def domain_key(spark, sf_dir):
    seed = F.when(F.col("page_id") % 9 == 0, F.lit("no/host")).otherwise(F.col("url"))
    return pages(spark, sf_dir).select("page_id", U.domain_key(seed).alias("domain"))


@query(
    "slugify_path",
    f"""WITH {PARTS} SELECT page_id, {slug_sql("'/'", "path")} AS from_root,
      {slug_sql("'/en/328'", "path", "json")} AS from_page FROM p""",
)
def slugify_path(spark, sf_dir):
    root = F.concat(origin_of(), F.lit("/"))
    return pages(spark, sf_dir).select(
        "page_id",
        U.slugify_path(root, F.col("url")).alias("from_root"),
        U.slugify_path(F.concat(root, F.lit("en/328")), F.col("url"), "json").alias("from_page"),
    )


def placed(spark, sf_dir):
    """Pages with domain and output path below their origin."""
    root = F.concat(origin_of(), F.lit("/"))
    return pages(spark, sf_dir).select(
        U.domain_key(F.col("url")).alias("domain"),
        U.slugify_path(root, F.col("url")).alias("out_path"),
        "page_id",
        "url",
    )


PLACED = f"""{PARTS}, w AS (SELECT authority AS domain, {slug_sql("'/'", "path")} AS out_path,
      page_id, url, page_url, html, origin FROM p)"""


@query(
    "slug_collisions",
    f"""WITH {PLACED} SELECT domain, out_path, count(*) AS pages, max(url) AS last_url
    FROM w GROUP BY ALL HAVING count(*) > 1""",
)
def slug_collisions(spark, sf_dir):
    return A.slug_collisions(placed(spark, sf_dir))


@query(
    "last_write_wins",
    f"""WITH {PLACED} SELECT domain, out_path, max(page_id) AS page_id,
      max_by(url, page_id) AS url FROM w GROUP BY ALL""",
)
def last_write_wins(spark, sf_dir):
    return A.last_write_wins(placed(spark, sf_dir), order="page_id")


@query(
    "pages_per_domain",
    f"""WITH {PLACED} SELECT domain, count(DISTINCT out_path) AS count
    FROM w GROUP BY domain
    UNION ALL SELECT NULL, count(*) FROM (SELECT DISTINCT domain, out_path FROM w)""",
)
def pages_per_domain(spark, sf_dir):
    return A.pages_per_domain(A.last_write_wins(placed(spark, sf_dir), order="page_id"))


@query(
    "pages_per_seed",
    f"WITH {PARTS} SELECT origin || '/' AS seed, count(*) AS pages FROM p GROUP BY ALL",
)
def pages_per_seed(spark, sf_dir):
    saved = J.scope_join(
        pages(spark, sf_dir).select("page_id", "url"),
        seeds(spark, sf_dir),
        scope="seed",
    )
    return A.pages_per_seed(saved)


@query(
    "files_by_format",
    """SELECT ['md', 'json', 'txt', 'html'][page_id % 4 + 1] AS format, count(*) AS files
    FROM pages GROUP BY ALL""",
)
def files_by_format(spark, sf_dir):
    formats = F.array(*[F.lit(f) for f in ("md", "json", "txt", "html")])
    fmt = F.get(formats, (F.col("page_id") % 4).cast("int"))
    root = F.concat(origin_of(), F.lit("/"))
    files = pages(spark, sf_dir).select(
        U.slugify_path(root, F.col("url"), fmt).alias("out_path")
    )
    return A.files_by_format(
        files.withColumn("format", F.substring_index("out_path", ".", -1))
    )


@query("summary", "SELECT count(*) AS count, 'sites' AS out FROM pages")
def summary(spark, sf_dir):
    return A.summary(pages(spark, sf_dir), "sites")


@query("content_sha1", "SELECT page_id, sha1(html) AS sha1 FROM pages")
def content_sha1(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.content_sha1(F.col("html")).alias("sha1"))


@query(
    "distinct_content",
    """SELECT sha1(text) AS sha1, min(doc_id) AS first_id, count(*) AS copies
    FROM documents GROUP BY ALL""",
)
def distinct_content(spark, sf_dir):
    return A.distinct_content(table(spark, sf_dir, "documents"), "text", "doc_id")


@query(
    "same_scope",
    rf"""WITH {PARTS}, s AS (
      SELECT DISTINCT origin, scheme, authority, prefix
      FROM p, (SELECT unnest(['/en/', '/en', '', '/fr/4']) AS prefix))
    SELECT p.page_id, s.origin || s.prefix AS seed FROM p JOIN s
      ON p.scheme = s.scheme AND p.authority = s.authority AND starts_with(p.path, s.prefix)""",
)
def same_scope(spark, sf_dir):
    prefixes = F.array(*[F.lit(p) for p in ("/en/", "/en", "", "/fr/4")])
    roots = (
        origins(spark, sf_dir)
        .select("origin", F.explode(prefixes).alias("prefix"))
        .select(F.concat("origin", "prefix").alias("seed"))
    )
    return J.scope_join(
        pages(spark, sf_dir).select("page_id", "url"), roots, scope="seed"
    ).select("page_id", "seed")


@query(
    "include_exclude",
    r"""SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https://')
      AND NOT regexp_matches(url, '(/(fr|de|es)/|\?utm_)')""",
)
def include_exclude(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", "url")
    return rows.filter(
        P.include_exclude(F.col("url"), r"^https://", r"(/(fr|de|es)/|\?utm_)")
    )


@query(
    "http_scheme",
    "SELECT page_id FROM pages WHERE page_id % 3 > 0",
)
def http_scheme(spark, sf_dir):
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("ftp:"), "url")).otherwise(
        F.col("url")
    )
    return pages(spark, sf_dir).filter(P.http_scheme(url)).select("page_id")


@query(
    "lang_keep",
    rf"WITH {PARTS} SELECT page_id, url FROM p WHERE split_part(path, '/', 2) = 'fr'",
)
def lang_keep(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", "url")
    return rows.filter(P.lang_keep(F.col("url"), "FR"))


@query(
    "response_gate",
    "SELECT page_id FROM pages WHERE page_id % 7 <> 0 AND page_id % 11 <> 0",
)
def response_gate(spark, sf_dir):
    responses = (
        pages(spark, sf_dir)
        .select("page_id")
        .withColumn("status", F.when(F.col("page_id") % 7 == 0, 404).otherwise(200))
        .withColumn(
            "content_type",
            F.when(F.col("page_id") % 11 == 0, "application/pdf").otherwise(
                "text/html; charset=utf-8"
            ),
        )
    )
    return responses.filter(P.response_gate(responses)).select("page_id")


@query(
    "robots_rules",
    rf"""WITH {PARTS}, r AS (
      SELECT * FROM (VALUES (0, 'other', 0, false, '/'), (1, '*', 0, false, '/fr/'),
        (1, '*', 1, true, '/de/1'), (1, '*', 2, false, '/de/'))
        AS r(group_no, agent, rule_no, allow, prefix))
    SELECT origin, group_no::BIGINT AS group_no, agent, rule_no::BIGINT AS rule_no, allow, prefix
    FROM (SELECT DISTINCT origin FROM p WHERE length(origin) % 5 > 2), r""",
)
def robots_rules_query(spark, sf_dir):
    rules = robots_rules(robots(spark, sf_dir))
    return rules.withColumns(
        {c: F.col(c).cast("bigint") for c in ("group_no", "rule_no")}
    )


@query(
    "robots_allowed",
    rf"""WITH {PARTS} SELECT page_id, url, CASE length(origin) % 5
      WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false
      ELSE path LIKE '/de/1%' OR NOT (path LIKE '/fr/%' OR path LIKE '/de/%') END AS allowed
    FROM p""",
)
def robots_allowed(spark, sf_dir):
    policies = J.robots_policies(robots(spark, sf_dir), agent="bot/1.0")
    return J.robots_join(pages(spark, sf_dir).select("page_id", "url"), policies)


@query(
    "max_pages",
    rf"""WITH {PARTS} SELECT origin, page_id FROM p
    QUALIFY row_number() OVER (PARTITION BY origin ORDER BY page_id) <= 3""",
)
def max_pages(spark, sf_dir):
    rows = pages(spark, sf_dir).select(origin_of().alias("origin"), "page_id")
    return P.first_n_per_key(rows, ["origin"], [F.col("page_id")], 3, "page_id", 3)


@query(
    "page_number",
    rf"""WITH {PARTS} SELECT origin, page_id,
      row_number() OVER (PARTITION BY origin ORDER BY page_id) AS number FROM p""",
)
def page_number(spark, sf_dir):
    rows = pages(spark, sf_dir).select(origin_of().alias("origin"), "page_id")
    return A.page_number(rows, "origin", "page_id")


@query(
    "domain_totals",
    rf"""WITH {PARTS} SELECT authority AS domain, count(*) AS pages,
      count(DISTINCT page_url) AS urls FROM p GROUP BY ALL""",
)
def domain_totals(spark, sf_dir):
    keyed = pages(spark, sf_dir).select(
        U.domain_key(F.col("url")).alias("domain"), U.url_defrag(F.col("url")).alias("url")
    )
    return keyed.groupBy("domain").agg(
        F.count("*").alias("pages"), F.count_distinct("url").alias("urls")
    )


@query(
    "diff_status",
    f"""WITH {PLACED}, c AS (
      SELECT domain, out_path, max(page_id) AS page_id, sha1(max_by(html, page_id)) AS sha
      FROM w GROUP BY ALL),
    n AS (SELECT * FROM c WHERE page_id % 10 <> 7),
    o AS (SELECT domain, out_path, CASE WHEN page_id % 5 = 0 THEN 'old' ELSE sha END AS sha
      FROM c WHERE page_id % 10 <> 3)
    SELECT coalesce(n.domain, o.domain) AS domain, coalesce(n.out_path, o.out_path) AS out_path,
      'md' AS format, CASE WHEN n.sha IS NULL THEN 'missing' WHEN o.sha IS NULL THEN 'new'
        WHEN n.sha = o.sha THEN 'unchanged' ELSE 'changed' END AS status
    FROM n FULL JOIN o ON n.domain = o.domain AND n.out_path = o.out_path""",
)
def diff_status(spark, sf_dir):
    hashes = pages(spark, sf_dir).select("page_id", F.sha1("html").alias("content_sha1"))
    current = (
        A.last_write_wins(placed(spark, sf_dir), order="page_id")
        .join(hashes, "page_id")
        .withColumn("format", F.lit("md"))
    )
    previous = current.filter(F.col("page_id") % 10 != 3).withColumn(
        "content_sha1", F.when(F.col("page_id") % 5 == 0, "old").otherwise(F.col("content_sha1"))
    )
    return J.diff_join(current.filter(F.col("page_id") % 10 != 7), previous)
