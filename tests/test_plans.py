"""Crawl, harvest, export and streams on small sites, against a plain queue."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from pageloom.config import HarvestConfig
from pageloom.plans.crawl import crawl
from pageloom.plans.export import (
    changed_rows,
    diff_status,
    export_rows,
    raw_html_rows,
    standing_export,
    write_changes,
    write_export,
)
from pageloom.plans.harvest import harvest
from pageloom.sources.tree import published, read_tree, write_tree
from pageloom.streaming.captures import stream_dedup, stream_diff_export, stream_pages

H = "https://h"
A_PAGE = '<a href="b">b</a><a href="c">c</a>'
MINI = [
    (1, f"{H}/docs/", 200, "text/html",
     '<a href="a">a</a><a href="b">b</a><a href="/other">o</a><a href="a#frag">f</a>'
     '<a href="mailto:x@y">m</a>'),
    (2, f"{H}/docs/a", 200, "text/html", A_PAGE),
    (3, f"{H}/docs/b", 200, "text/html", A_PAGE),
    (4, f"{H}/docs/c", 200, "text/html; charset=utf-8",
     '<a href="a">a</a><meta http-equiv="refresh" content="0;url=d"><a href="../docs/e">e</a>'),
    (5, f"{H}/docs/e", 200, "application/pdf", "x"),
]
SCHEMA = "page_id bigint, url string, status int, content_type string, html string"


def _pages(spark, rows=MINI):
    return spark.createDataFrame(rows, SCHEMA)


def _seeds(spark, *seeds):
    return spark.createDataFrame(list(enumerate(seeds)), "seed_id bigint, seed string")


def _saved(df):
    return [(r.url, r.depth) for r in sorted(df.collect(), key=lambda r: (r.depth, r.ord))]


def test_mini_site(spark):
    pages, seeds = _pages(spark), _seeds(spark, f"{H}/docs")
    ordered = [(f"{H}/docs/", 0), (f"{H}/docs/a", 1), (f"{H}/docs/c", 2)]

    def run(**options):
        return _saved(crawl(seeds, pages, cfg=HarvestConfig(**options)))

    assert run() == ordered
    assert run(depth=1) == ordered[:2]
    assert run(max_pages=2) == ordered[:2]
    assert run(exclude="c$") == ordered[:2]
    assert run(include="/docs/a") == []
    denied = spark.createDataFrame(
        [(H, 200, "User-agent: *\nDisallow: /docs/c")], "origin string, status int, body string"
    )
    assert _saved(crawl(seeds, pages, denied)) == ordered[:2]


def _queue(seed, pages, max_pages, depth_limit):
    """The crawl as a queue over one site."""
    todo, seen, texts, saved = deque([(seed, 0)]), set(), set(), []
    while todo and len(saved) < max_pages:
        url, depth = todo.popleft()
        if url in seen:
            continue
        seen.add(url)
        if url not in pages:
            continue
        links, text = pages[url]
        if text in texts:
            continue
        texts.add(text)
        saved.append((url, depth))
        if depth_limit == 0 or depth < depth_limit:
            todo.extend((u, depth + 1) for u in links if u.startswith(seed))
    return saved


def test_random_sites_against_a_queue(spark):
    rng = random.Random(2)
    sites = {}
    for s in range(4):
        urls = [f"https://s{s}/d/"] + [f"https://s{s}/d/{i}" for i in range(1, 25)]
        for i, url in enumerate(urls):
            links = [rng.choice(urls + [f"https://s{s}/x", f"https://s{s}/d/gone"])
                     for _ in range(rng.randint(0, 4))]
            copy = rng.random() < 0.3 and i > 1
            links = sites[urls[i - 1]][0] if copy else links
            text = "".join(f'<a href="{u}">l</a>' for u in links)
            sites[url] = (links, text if copy else text + f"<p>{url if i % 4 else s}</p>")
    rows = [(i, u, 200, "text/html", t) for i, (u, (_, t)) in enumerate(sites.items())]
    seeds = _seeds(spark, *[f"https://s{s}/d/" for s in range(4)])
    for max_pages, depth in ((1000, 0), (7, 0), (1000, 2)):
        found = crawl(seeds, _pages(spark, rows).repartition(3), cfg=HarvestConfig(
            max_pages=max_pages, depth=depth))
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r.depth, r.ord)):
            got.setdefault(r.seed, []).append((r.url, r.depth))
        for s in range(4):
            seed = f"https://s{s}/d/"
            assert got[seed] == _queue(seed, sites, max_pages, depth)


def test_routes(spark):
    maps = spark.createDataFrame(
        [(f"{H}/docs/sitemap.xml", 200, "text/xml",
          f"<urlset><url><loc>{H}/docs/c</loc></url><url><loc>{H}/docs/e</loc></url></urlset>")],
        "url string, status int, content_type string, xml string",
    )
    other = [(9, "https://k/", 200, "text/html", "k")]
    pages, seeds = _pages(spark, MINI + other), _seeds(spark, f"{H}/docs/", "https://k/")

    def routes(**options):
        rows = harvest(seeds, pages, maps, cfg=HarvestConfig(**options)).collect()
        return sorted((r.route, r.url) for r in rows)

    assert routes(sitemap=True) == [("crawl", "https://k/"), ("sitemap", f"{H}/docs/c")]
    assert routes(sitemap=True, crawl_without_sitemap=False) == [("sitemap", f"{H}/docs/c")]
    assert {r for r, _ in routes()} == {"crawl"}
    assert {r for r, _ in routes(sitemap=True, exclude="zzz")} == {"crawl"}


def _export(spark, fmt="md", date=0, rows=MINI, **options):
    pages = _pages(spark, rows)
    saved = pages.select(
        F.lit(0).cast("bigint").alias("seed_id"), F.lit(f"{H}/docs/").alias("seed"), "url",
        F.lit(0).alias("depth"), F.array(F.col("page_id")).alias("ord"), "page_id")
    return export_rows(saved, pages, HarvestConfig(format=fmt, **options), date=F.lit(date))


def test_diff_with_itself_is_empty(spark):
    first = _export(spark).cache()
    assert changed_rows(_export(spark, date=99), first).count() == 0
    assert {r.status for r in diff_status(first, first).collect()} == {"unchanged"}
    edited = [(i, u, s, c, h + "<p>more</p>" if i == 2 else h) for i, u, s, c, h in MINI]
    fresh = changed_rows(_export(spark, rows=edited), first).collect()
    assert [r.out_path for r in fresh] == ["docs/a.md"]


def test_batches_hold_changes_only(spark, tmp_path):
    path = str(tmp_path / "export")
    edited = [(i, u, s, c, h + "<p>more</p>" if i == 2 else h) for i, u, s, c, h in MINI]
    write_changes(_export(spark), path, 0)
    write_changes(_export(spark, date=9), path, 1)
    write_changes(_export(spark, rows=edited[:3]), path, 2)
    write_changes(_export(spark, rows=edited[:3]), path, 2)  # run again after a failure
    stored = spark.read.parquet(path)
    assert {r.batch_id: r["count"] for r in stored.groupBy("batch_id").count().collect()} == {
        0: len(MINI), 2: 1}
    standing = {r.out_path: r.content for r in standing_export(spark, path).collect()}
    assert len(standing) == len(MINI) and "more" in standing["docs/a.md"]


def test_versions_of_an_export(spark, tmp_path):
    from pageloom.plans.export import export_log, versions

    path = str(tmp_path / "export")
    assert standing_export(spark, path).count() == 0 and export_log(spark, path).count() == 0
    write_changes(_export(spark), path, 0, complete=True)
    write_changes(_export(spark, rows=MINI[1:]), path, 1, complete=True)  # docs/index.md has gone
    write_changes(_export(spark, rows=MINI[:1]), path, 2)  # is back; the others stay
    write_changes(_export(spark, rows=MINI[:2]), path, 5, complete=True)

    def paths(version=None):
        return sorted(r.out_path for r in standing_export(spark, path, version).collect())

    every = ["docs/a.md", "docs/b.md", "docs/c.md", "docs/e.md", "docs/index.md"]
    assert paths(0) == paths(2) == every and paths(1) == every[:-1]
    assert paths() == paths(5) == ["docs/a.md", "docs/index.md"]
    log = {r.version: (r.written, r.removed) for r in export_log(spark, path).collect()}
    assert log == {0: (5, 0), 1: (0, 1), 2: (1, 0), 5: (0, 3)} and versions(spark, path) == [0, 1, 2, 5]
    with pytest.raises(ValueError):
        standing_export(spark, path, 3)


def test_a_version_without_manifest_is_not_read(spark, tmp_path, monkeypatch):
    from pageloom.plans import export as E

    path = str(tmp_path / "export")
    write_changes(_export(spark), path, 0)
    edited = [(i, u, s, c, h + "<p>more</p>") for i, u, s, c, h in MINI]
    with monkeypatch.context() as broken:
        broken.setattr(E, "vanished_rows", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            write_changes(_export(spark, rows=edited), path, 1, complete=True)
    assert not any("more" in r.content for r in standing_export(spark, path).collect())
    write_changes(_export(spark, rows=edited), path, 1)
    assert all("more" in r.content or r.out_path == "docs/e.md" for r in standing_export(spark, path).collect())


def test_colliding_paths_keep_the_last(spark):
    rows = MINI + [(7, f"{H}/docs/a.html?x", 200, "text/html", "late")]
    kept = {r.out_path: r.url for r in _export(spark, "txt", rows=rows).collect()}
    assert kept["docs/a.txt"] == f"{H}/docs/a.html?x"


def test_sinks(spark, tmp_path):
    rows = _export(spark).cache()
    write_export(rows, str(tmp_path / "table"))
    back = spark.read.parquet(str(tmp_path / "table"))
    assert sorted(r.out_path for r in back.collect()) == sorted(r.out_path for r in rows.collect())
    saved = _pages(spark).select(
        F.lit(0).cast("bigint").alias("seed_id"), F.lit(f"{H}/docs/").alias("seed"), "url",
        F.lit(0).alias("depth"), F.array(F.col("page_id")).alias("ord"), "page_id")
    raw = {r.out_path: r.content for r in raw_html_rows(saved, _pages(spark)).collect()}
    assert raw["docs/e.raw.html"] == "x"


def test_trees_are_published_whole(spark, tmp_path):
    root = str(tmp_path / "tree")
    rows = _export(spark).cache()
    assert published(root) == []
    write_tree(rows, root)
    write_tree(rows.repartition(4), root)  # once more, by more tasks
    files = {str(p.relative_to(tmp_path / "tree" / "version=0")): p.read_text()
             for p in (tmp_path / "tree" / "version=0").rglob("*") if p.is_file()}
    assert files == {f"{r.domain}/{r.out_path}": r.content for r in rows.collect()}
    assert files["h/docs/index.md"].startswith("---\ntitle: \nurl: https://h/docs/\ndate_scraped: 0\n---\n")
    size = sum(len(text.encode()) for text in files.values())
    assert published(root) == [{"version": 0, "files": len(MINI), "bytes": size}]
    write_tree(rows.limit(2), f"file://{root}", version=3)
    assert [m["version"] for m in published(root)] == [0, 3] and read_tree(spark, root).count() == 2
    back = sorted(map(tuple, read_tree(spark, root, 0).collect()))
    assert back == sorted((r.domain, r.out_path, r.content) for r in rows.collect())
    assert not list((tmp_path / "tree" / "_staged").iterdir())


def test_a_failed_tree_leaves_nothing_listed(spark, tmp_path):
    root = str(tmp_path / "tree")
    rows = _export(spark).repartition(4)
    broken = rows.withColumn("content", F.when(F.col("out_path").contains("/c."), F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    outside = rows.withColumn("out_path", F.when(F.col("out_path").contains("/c."), "../../x").otherwise(F.col("out_path")))
    for bad in (broken, outside):
        with pytest.raises(Exception):  # noqa: B017
            write_tree(bad, root, version=1)
        assert published(root) == [] and not (tmp_path / "tree" / "version=1").exists()
        assert not list((tmp_path / "tree" / "_staged").iterdir()) and not (tmp_path / "x").exists()
    write_tree(rows, root, version=1)
    with pytest.raises(Exception):  # noqa: B017
        write_tree(rows.limit(1), root, version=1, overwrite=False)
    assert read_tree(spark, root, 1).count() == len(MINI)
    with pytest.raises(ValueError):
        read_tree(spark, root, 2)


def test_stream_of_captures(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    pages = _pages(spark).select("page_id", "url", "html").coalesce(1)
    pages.write.parquet(source)
    seeds = _seeds(spark, f"{H}/docs/")

    def run():
        query = stream_diff_export(
            stream_pages(spark, source), seeds, out, checkpoint, HarvestConfig()).start()
        query.awaitTermination()
        return spark.read.parquet(out)

    assert run().count() == len(MINI)
    assert run().count() == len(MINI)
    pages.write.mode("append").parquet(source)  # the same captures once more
    assert run().count() == len(MINI)
    edited = pages.withColumn("html", F.when(F.col("page_id") == 2, "new").otherwise(F.col("html")))
    edited.write.mode("append").parquet(source)
    latest = run()
    assert latest.count() == len(MINI) + 1
    assert latest.filter("content LIKE '%new%'").count() == 1


def test_stream_dedup_is_batch_dedup(spark, tmp_path):
    source = str(tmp_path / "in")
    pages = _pages(spark).select("page_id", "url", "html")
    pages.unionByName(pages).repartition(3).write.parquet(source)
    unique = stream_dedup(stream_pages(spark, source), by="sha1").select("sha1")
    query = (
        unique.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = sorted(r.sha1 for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r.s for r in pages.select(F.sha1("html").alias("s")).distinct().collect())


def test_hot_host_is_split_by_aqe(spark):
    """A host with most of the pages: its join partition is shared out."""
    from pageloom.operators.joins import scope_join

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        pages = spark.range(0, 40_000, 1, 8).selectExpr(
            "concat('https://', if(id % 3 > 0, 'hot', concat('h', id % 97)), '/', id) AS url")
        seeds = spark.createDataFrame(
            [("https://hot/",)] + [(f"https://h{i}/",) for i in range(97)], "scope string")
        joined = scope_join(pages, seeds)
        assert joined.count() == 40_000
        rows = joined.groupBy("scope").count()
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_newest_capture_counts(spark):
    rows = MINI + [
        (11, f"{H}/docs/", 200, "text/html", '<a href="c">only c</a>'),
        (12, f"{H}/docs/a", 404, "text/html", "gone"),
        (13, f"{H}/docs/c#top", 200, "text/html", "old c"),
    ]
    times = {11: 50, 12: 60, 13: 1}
    pages = _pages(spark, rows)
    clock = F.lit(10)
    for page_id, at in times.items():
        clock = F.when(F.col("page_id") == page_id, at).otherwise(clock)
    pages = pages.withColumn("captured_at", F.timestamp_seconds(clock))
    seeds = _seeds(spark, f"{H}/docs/")
    saved = crawl(seeds, pages)
    ids = {r.url: r.page_id for r in saved.collect()}
    assert ids == {f"{H}/docs/": 11, f"{H}/docs/c": 4}
    maps = spark.createDataFrame(
        [(f"{H}/docs/sitemap.xml", 200, "text/xml",
          f"<urlset><url><loc>{H}/docs/a</loc></url><url><loc>{H}/docs/c</loc></url></urlset>")],
        "url string, status int, content_type string, xml string",
    )
    listed = harvest(seeds, pages, maps, cfg=HarvestConfig(sitemap=True))
    assert [(r.url, r.page_id) for r in listed.collect()] == [(f"{H}/docs/c", 4)]
    rows = {r.out_path: r for r in export_rows(saved, pages).collect()}
    assert "date_scraped: 50\n" in rows["docs/index.md"].content
    assert rows["docs/c.md"].captured_at.timestamp() == 10


def test_stream_state_has_a_watermark(spark, tmp_path):
    source = str(tmp_path / "in")
    pages = _pages(spark).withColumn("captured_at", F.timestamp_seconds("page_id"))
    pages = pages.select("page_id", "url", "html", "captured_at")
    pages.unionByName(pages).write.parquet(source)
    schema = "page_id bigint, url string, html string, captured_at timestamp"
    unique = stream_dedup(stream_pages(spark, source, schema), delay="1 hour").select("url")
    query = (
        unique.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(u for _, u, *_ in MINI)


def test_language_and_sitemap_options(spark):
    rows = [(1, f"{H}/", 200, "text/html", '<a href="/en/a">a</a><a href="/fr/b">b</a>'),
            (2, f"{H}/en/a", 200, "text/html", "a"), (3, f"{H}/fr/b", 200, "text/html", "b")]
    pages, seeds = _pages(spark, rows), _seeds(spark, f"{H}/")
    maps = spark.createDataFrame(
        [(f"{H}/sitemap.xml", 200, "text/xml",
          f"<urlset><url><loc>{H}/en/a</loc></url><url><loc>{H}/fr/b</loc></url>"
          f"<url><loc>{H}/en/a</loc></url></urlset>")],
        "url string, status int, content_type string, xml string",
    )
    robots = spark.createDataFrame(
        [(H, 200, "User-agent: *\nDisallow: /fr")], "origin string, status int, body string")

    def urls(**options):
        cfg = HarvestConfig(sitemap=True, **options)
        return sorted(r.url[len(H):] for r in harvest(seeds, pages, maps, robots, cfg).collect())

    assert urls() == ["/en/a", "/fr/b"]
    assert urls(distinct_sitemap_urls=False) == ["/en/a", "/en/a", "/fr/b"]
    assert urls(lang="FR") == ["/fr/b"]
    assert urls(sitemap_robots=True) == ["/en/a"]
    assert urls(exclude="/en/", sitemap_patterns=True) == ["/fr/b"]


def test_extraction_of_a_stream(spark, tmp_path):
    from pageloom.operators.content import extract_content

    source = str(tmp_path / "in")
    _pages(spark).select("page_id", "url", "html").write.parquet(source)
    found = extract_content(stream_pages(spark, source), ("plain_text",))
    query = (
        found.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    texts = {r.page_id: r.plain_text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(texts) == len(MINI) and texts[5] == "x"


def test_crawl_without_limit_passes_the_default(spark):
    """More pages on one site than the default limit; a tree three levels deep."""
    pages = spark.range(0, 10_200).selectExpr(
        "id AS page_id", "concat('https://big/', if(id = 0, '', string(id))) AS url",
        "concat('p', id, array_join(transform(sequence(1, 101), "
        "i -> concat('<a href=\"/', string(id * 101 + i), '\">l</a>')), '')) AS html")
    seeds = _seeds(spark, "https://big/")
    assert crawl(seeds, pages, cfg=HarvestConfig(max_pages=None)).count() == 10_200
    assert crawl(seeds, pages).count() == 10_000


def test_crawl_of_a_long_chain(spark):
    """Deep sites: places are numbered anew and levels are merged."""
    rows = [(i, f"https://h/{i or ''}", 200, "text/html",
             f'<a href="/{i + 1}">a</a><a href="/{i + 2}">b</a>p{i}') for i in range(45)]
    saved = crawl(_seeds(spark, "https://h/"), _pages(spark, rows))
    assert _saved(saved) == [(f"https://h/{i or ''}", (i + 1) // 2) for i in range(45)]
    assert max(len(r.ord) for r in saved.collect()) <= 17


def test_crawl_parses_own_gated_pages_only(spark):
    from pageloom.plans.crawl import link_index
    from pageloom.session import work_dir

    rows = MINI + [(20, "https://else/", 200, "text/html", "x"), (21, f"{H}/docs/z", 404, "text/html", "y")]
    index = link_index(_pages(spark, rows), _seeds(spark, f"{H}/docs/"), work_dir(spark))
    assert {r.page_id for r in index.rows.collect()} == {1, 2, 3, 4}
    index.removed()


def test_what_stands_is_read_from_few_tables(spark, tmp_path):
    from pageloom.plans import export as E

    path = str(tmp_path / "export")
    row = _export(spark).limit(1).cache()
    for batch in range(2 * E.SNAPSHOT_BATCHES + 3):
        if batch in (0, 15, 16, 31, 33):
            E.write_changes(row, path, batch)
    standing = E.standing_hashes(spark, path, 34)
    files = {f.split("_standing/")[1].split("/part")[0] for f in standing.inputFiles()}
    assert files == {"snapshots/batch=31", "batches/batch=33"} and standing.count() == 1


def test_stream_gates_and_orders_captures(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "page_id bigint, url string, html string, status int, content_type string, captured_at timestamp"

    def wave(*rows):
        made = [(i, f"{H}/docs/{u}", h, s, c, at) for i, u, h, s, c, at in rows]
        table = spark.createDataFrame(made, schema.replace("captured_at timestamp", "at bigint"))
        table.withColumn("captured_at", F.timestamp_seconds("at")).drop("at").coalesce(1).write.mode("append").parquet(source)
        denied = spark.createDataFrame([(H, 200, "User-agent: *\nDisallow: /docs/no")], "origin string, status int, body string")
        stream_diff_export(stream_pages(spark, source, schema), _seeds(spark, f"{H}/docs/"), out, checkpoint,
                           HarvestConfig(format="txt", exclude="skip"), denied).start().awaitTermination()
        return {r.out_path: r.content for r in standing_export(spark, out).collect()}

    page = "text/html"
    first = wave((9, "a", "old a", 200, page, 10), (2, "a", "new a", 200, page, 20), (3, "gone", "x", 404, page, 10),
                 (4, "f.pdf", "x", 200, "application/pdf", 10), (5, "no", "x", 200, page, 10), (6, "skip", "x", 200, page, 10),
                 (7, "b", "b1", 200, page, 10))
    assert first == {"docs/a.txt": "new a", "docs/b.txt": "b1"}
    # a late capture, one that is unchanged, and then one from before the unchanged one
    assert wave((20, "a", "late a", 200, page, 15), (21, "b", "b1", 200, page, 30)) == first
    assert wave((22, "b", "b0", 200, page, 25)) == first
    assert wave((23, "b", "b2", 200, page, 40))["docs/b.txt"] == "b2"


def test_work_folder_without_a_cluster_setting(spark):
    from pageloom.session import removed, work_dir, written

    root = spark.conf.get("spark.checkpoint.dir", None)
    assert root is None or work_dir(spark).startswith(root)
    path = work_dir(spark, "/tmp/pageloom-own")
    assert path.startswith("/tmp/pageloom-own/pageloom/")
    assert written(spark.range(3), path).count() == 3
    removed(spark, path)


def test_link_errors_are_reported(spark, monkeypatch):
    import pyarrow as pa

    from pageloom.functions import events

    monkeypatch.setattr(events._LinkReader, "handle_starttag", lambda *a: 1 / 0)
    found = events._links_of(pa.array(["<a href='x'>", None, "plain"])).to_pylist()
    assert [r["error"] for r in found] == ["ZeroDivisionError: division by zero", None, None]
