"""One walk for many seeds against a plain queue for each, and distributed ranks."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from pageloom.config import HarvestConfig
from pageloom.operators.aggregates import page_number
from pageloom.plans.shared import copied_seeds, shared_crawl

SCHEMA = "page_id bigint, url string, status int, content_type string, html string"


def queue(seed, pages, max_pages, depth_limit):
    todo, seen, texts, saved = deque([(seed, 0)]), set(), set(), []
    while todo and len(saved) < max_pages:
        url, depth = todo.popleft()
        if url in seen:
            continue
        seen.add(url)
        if url not in pages or pages[url][1] in texts:
            continue
        links, text = pages[url]
        texts.add(text)
        saved.append((url, depth))
        if depth_limit == 0 or depth < depth_limit:
            todo.extend((u, depth + 1) for u in links if u.startswith(seed))
    return saved


def site(host, rng, copies):
    """Pages on nested paths; every folder is a seed of its own."""
    urls = [f"https://{host}/"]
    for _ in range(40):
        parent = rng.choice([u for u in urls if u.endswith("/")])
        urls.append(parent + f"{len(urls)}" + rng.choice(["/", "/", ".html"]))
    pages = {}
    for i, url in enumerate(urls):
        links = rng.sample(urls, 4) + [url + "gone", "https://else/"]
        text = "".join(f'<a href="{u}">l</a>' for u in links) + f"<p>{url}</p>"
        if len(pages) > 1 and rng.random() < copies:
            links, text = rng.choice(list(pages.values()))
        if rng.random() < 0.95:
            pages[url] = (links, text)
    return urls, pages


@pytest.mark.parametrize("copies, max_pages, depth", [(0.0, 10_000, 0), (0.0, 10_000, 2), (0.25, 10_000, 0), (0.1, 6, 0)])
def test_overlapping_seeds_against_queues(spark, copies, max_pages, depth):
    rng = random.Random(int(copies * 100) + max_pages + depth)
    pages, seeds = {}, []
    for host in ("a", "b"):
        urls, own = site(host, rng, copies)
        pages |= own
        seeds += [u for u in urls if u.endswith("/")]
    seeds.append(seeds[0])  # the same seed twice
    rows = [(i, u, 200, "text/html", t) for i, (u, (_, t)) in enumerate(pages.items())]
    table = spark.createDataFrame(list(enumerate(seeds)), "seed_id bigint, seed string")
    cfg = HarvestConfig(max_pages=max_pages, depth=depth)
    found = shared_crawl(table, spark.createDataFrame(rows, SCHEMA), cfg=cfg).collect()
    got = {}
    for r in found:
        got.setdefault(r.seed_id, []).append((r.url, r.depth))
    for i, seed in enumerate(seeds):
        assert sorted(got.get(i, [])) == sorted(queue(seed, pages, max_pages, depth)), seed


def test_rows_of_a_level_do_not_grow_with_seeds(spark, monkeypatch):
    """60 seeds that all reach the same pages make as many rows as one."""
    from pageloom.plans import shared

    pages = [(i, f"https://h/{i or ''}", 200, "text/html", f'<a href="/{i + 1}">n</a><a href="/{i + 2}">m</a>p{i}') for i in range(12)]
    sizes = []
    real = shared.observed

    def counted(df, path, **told):
        rows, seen = real(df, path, **told)
        if "/levels/" in path:
            sizes.append(rows.count())
        return rows, seen

    monkeypatch.setattr(shared, "observed", counted)
    seeds = spark.createDataFrame([(i, "https://h/") for i in range(60)], "seed_id bigint, seed string")
    found = shared_crawl(seeds, spark.createDataFrame(pages, SCHEMA))
    assert found.count() == 60 * 12 and sum(sizes) == 12


def test_more_seeds_than_bits_in_a_word(spark):
    pages = [(0, "https://h/", 200, "text/html", '<a href="/1">n</a>'), (1, "https://h/1", 200, "text/html", "x")]
    seeds = spark.createDataFrame([(i, "https://h/") for i in range(150)], "seed_id bigint, seed string")
    found = shared_crawl(seeds, spark.createDataFrame(pages, SCHEMA))
    counts = {r.seed_id: r["count"] for r in found.groupBy("seed_id").count().collect()}
    assert counts == {i: 2 for i in range(150)}


def test_rules_and_empty_tables(spark):
    pages = spark.createDataFrame(
        [(0, "https://h/", 200, "text/html", '<a href="/no/1">a</a><a href="/skip">b</a><a href="/c">c</a>'),
         (1, "https://h/no/1", 200, "text/html", "1"), (2, "https://h/skip", 200, "text/html", "2"),
         (3, "https://h/c", 200, "text/html", "3")], SCHEMA)
    seeds = spark.createDataFrame([(0, "https://h/"), (1, "https://h/c"), (2, "https://nowhere/")], "seed_id bigint, seed string")
    robots = spark.createDataFrame([("https://h", 200, "User-agent: *\nDisallow: /no")], "origin string, status int, body string")
    found = shared_crawl(seeds, pages, robots, HarvestConfig(exclude="skip"))
    assert sorted((r.seed_id, r.url, r.depth) for r in found.collect()) == [(0, "https://h/", 0), (0, "https://h/c", 1)]
    assert shared_crawl(seeds.filter("false"), pages).count() == 0
    assert shared_crawl(seeds, pages.filter("false")).count() == 0


def test_copied_seeds(spark):
    rows = [("o", 0, "x", 0b0111), ("o", 0, "x", 0b0101), ("o", 0, "y", 0b1000), ("o", 1, "x", 0b1000), ("o", 1, "z", 0b1000)]
    found = copied_seeds(spark.createDataFrame(rows, "origin string, word int, sha1 string, bits bigint")).collect()
    assert [tuple(r) for r in found] == [("o", 0, 0b0101)]


def test_ranks_of_a_hot_key_with_sparse_orders(spark):
    rows = spark.range(0, 30_000, 1, 7).select(
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 97 > 0, F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        F.xxhash64("id").alias("order"),
        "id",
    )
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # which would join partitions as small as these
    try:
        found = page_number(rows, "key", "order")
    finally:
        spark.conf.set(coalesce, "true")
    assert found.columns == ["key", "order", "id", "number"]
    want = {}
    for r in rows.collect():
        want.setdefault(r.key, []).append((r.order, r.id))
    number = {i: n for own in want.values() for n, (_, i) in enumerate(sorted(own), 1)}
    assert {r.id: r.number for r in found.collect()} == number
    # no window over a key's rows, and the hot key lies in several partitions
    counts = spark.read.parquet(found.inputFiles()[0].rsplit("/", 1)[0])
    assert counts.filter("key = 'hot'").select("_part").distinct().count() > 1


def test_ranks_of_ties_and_no_rows(spark):
    rows = spark.createDataFrame([("a", 1)] * 400 + [(None, 1), (None, 2)], "key string, order int")
    numbers = page_number(rows, "key", "order").collect()
    assert sorted(r.number for r in numbers if r.key) == list(range(1, 401))
    assert sorted((r.order, r.number) for r in numbers if not r.key) == [(1, 1), (2, 2)]
    assert page_number(rows.filter("false"), "key", "order").count() == 0
