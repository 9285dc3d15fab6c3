"""Scope, robots, sitemap and text rules."""

import random
import re
from urllib.robotparser import RobotFileParser

from pyspark.sql import functions as F

from pageloom.functions import render as R
from pageloom.functions import text as X
from pageloom.functions.robots import robots_allowed, robots_policy
from pageloom.operators.filters import first_n_per_key, same_scope
from pageloom.operators.joins import latest_captures, scope_join
from pageloom.sources.seeds import read_seeds
from pageloom.sources.sitemaps import listed_urls, sitemap_urls


def test_same_scope(evaluate):
    seed = "https://h/docs/"
    rows = [(seed, "https://h/docs/a"), (seed, "https://h/docs"), (seed, "http://h/docs/a"),
            (seed, "https://h:443/docs/a"), (seed, "https://h/docs2"), ("https://h", "https://h/x")]
    assert evaluate(same_scope, rows, "s string, c string") == [
        True, False, False, False, False, True]


def test_scope_join_is_the_scope_predicate(spark):
    rng = random.Random(3)
    segments = ["a", "ab", "b", ""]

    def path():
        return "".join("/" + rng.choice(segments) for _ in range(rng.randint(0, 4)))

    urls = list({f"https://h{rng.randint(0, 1)}{path()}" for _ in range(60)})
    scopes = list({f"https://h{rng.randint(0, 1)}{path()}" for _ in range(30)})
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    seeds = spark.createDataFrame([(s,) for s in scopes], "scope string")
    got = sorted((r.url, r.scope) for r in scope_join(pages, seeds).collect())
    paired = pages.crossJoin(seeds).filter(same_scope(F.col("scope"), F.col("url")))
    assert got == sorted((r.url, r.scope) for r in paired.collect())


def _stdlib_verdict(status, body, agent, url):
    parser = RobotFileParser()
    if status in (401, 403):
        parser.disallow_all = True
    elif status is not None and 400 <= status < 500:
        parser.allow_all = True
    elif status == 200:
        parser.parse(body.splitlines())
    return parser.can_fetch(agent, url)


def test_robots_are_the_standard_rules(spark):
    rng = random.Random(5)
    lines = ["User-agent: *", "User-agent: bot", "user-agent:  BO # x", "User-agent: other", "",
             " ", "# note", "Disallow: /a", "Disallow:", "Allow: /a/b", "Disallow: /a%2Fc",
             "Disallow: /q?x", "Disallow: *", "Crawl-delay: 3", "Request-rate: 1/2",
             "Sitemap: http://h/s", "junk", "Allow: /é", "Disallow: /%zz", "disallow : /d"]
    urls = ["http://h", "http://h/", "http://h/a", "http://h/a/b", "http://h/a%2Fc/d",
            "http://h/q?x=1", "http://h/%C3%A9", "http://h/%zz", "http://h/d+e", "http://h/*"]
    rows = []
    for i in range(400):
        body = "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))
        status = rng.choice([200] * 8 + [401, 404, 500, None])
        rows.append((i, status, body, rng.choice(urls)))
    table = spark.createDataFrame(rows, "i int, status int, body string, url string")
    for agent in ("bot", "Robot/1.0", "zzz"):
        policy = robots_policy(F.col("status"), F.col("body"), agent)
        judged = table.withColumn("policy", policy).withColumn(
            "allowed", robots_allowed(F.col("policy"), F.col("url"))
        )
        wrong = [
            (r.status, r.body, r.url, r.allowed)
            for r in judged.collect()
            if r.allowed != _stdlib_verdict(r.status, r.body, agent, r.url)
        ]
        assert not wrong, (agent, wrong[:3])


def test_seeds_file(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text(" https://a/ \n\n\t\nhttps://b/\nhttps://a/\n")
    rows = read_seeds(spark, str(tmp_path / "seeds.txt")).orderBy("seed_id").collect()
    assert [r.seed for r in rows] == ["https://a/", "https://b/", "https://a/"]


NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
MAPS = [
    ("https://h/sitemap.xml", 200, "text/xml",
     f"<?xml version='1.0'?><sitemapindex {NS}><sitemap><loc>https://h/s1.xml</loc></sitemap>"
     "<sitemap><loc> </loc></sitemap><sitemap><loc>https://h/bad.xml</loc></sitemap>"
     "<sitemap><loc>https://h/nested.xml</loc></sitemap></sitemapindex>"),
    ("https://h/s1.xml", 200, "text/plain",
     f"<urlset {NS}><url><loc>https://h/a</loc></url><url><loc>https://x/b</loc></url></urlset>"),
    ("https://h/bad.xml", 404, "text/xml", "<urlset><url><loc>https://h/no</loc></url></urlset>"),
    ("https://h/nested.xml", 200, "text/xml",
     "<sitemapindex><sitemap><loc>https://h/s1.xml</loc></sitemap></sitemapindex>"),
    ("https://h/d/sitemap.xml", 200, "application/xml",
     "<!-- c --><s:urlset xmlns:s='x'><s:url><s:loc>https://h/d/p</s:loc></s:url></s:urlset>"),
    ("https://k/sitemap.xml", 200, "text/html", "<urlset><url><loc>https://k/a</loc></url></urlset>"),
    ("https://m/sitemap.xml", 200, "text/xml",
     "<urlset><url><loc> </loc></url><url></url>"
     "<url><loc>https://m/a?x=1&amp;y=2</loc></url></urlset>"),
    ("https://n/sitemap.xml", 200, "text/xml", "not xml"),
    ("https://o/sitemap.xml", 200, "text/xml", "<feed><url><loc>https://o/a</loc></url></feed>"),
]


def test_sitemaps(spark):
    maps = spark.createDataFrame(MAPS, "url string, status int, content_type string, xml string")
    listed = {(r.sitemap_url, r.url) for r in listed_urls(maps).collect()}
    assert listed == {
        ("https://h/nested.xml", "https://h/a"),
        ("https://h/nested.xml", "https://x/b"),
        ("https://h/sitemap.xml", "https://h/a"),
        ("https://h/sitemap.xml", "https://x/b"),
        ("https://h/d/sitemap.xml", "https://h/d/p"),
        ("https://m/sitemap.xml", "https://m/a?x=1&y=2"),
    }
    seeds = spark.createDataFrame(
        [(1, "https://h/"), (2, "https://h/d"), (3, "https://m"), (4, "https://k/")],
        "seed_id bigint, seed string",
    )
    found = sorted((r.seed_id, r.url) for r in sitemap_urls(seeds, maps).collect())
    assert found == [(1, "https://h/a"), (2, "https://h/d/p"), (3, "https://m/a?x=1&y=2")]


TEXTS = [
    (X.strip_icon_entities, "a&#xf123;b&#65;", "ab&#65;"),
    (X.bold_to_header, "x **a** y **b**", "x ## a y ## b"),
    (X.bold_to_header, "**a\nb**", "**a\nb**"),
    (X.note_break, "a\nnote(x)", "a\n\n\nnote(x)"),
    (X.note_break, "s(x)", "\n\ns(x)"),
    (X.merge_lang_label, "t\nbash\n\n```\nls", "t\n```bash\n\nls"),
    (X.drop_number_runs, "a\n1\n2\n3\nb", "a\nb"),
    (X.drop_number_runs, "a\n\n1\n\n2\n3\n\nb", "a\nb"),
    (X.drop_number_runs, "a\n1\n2\nb", "a\n1\n2\nb"),
    (X.drop_number_runs, "1\n2\n3\n", "\n"),
    (X.collapse_blank_lines, "a\n\n\n\nb", "a\n\nb"),
]


def test_text_rules(evaluate):
    for rule, text, want in TEXTS:
        assert evaluate(rule, [(text,)], "t string") == [want], (rule.__name__, text)


def test_number_runs_against_backtracking(evaluate):
    rng = random.Random(11)
    pieces = ["1", "22", " ", "\n", "\n", "a", "\t", "٣", " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    pattern = re.compile(r"(?:^|\n)(?:\s*\d+\s*\n){3,}", re.MULTILINE)
    got = evaluate(X.drop_number_runs, [(t,) for t in texts], "t string")
    wrong = [(t, g) for t, g in zip(texts, got) if g != pattern.sub("\n", t)]
    assert not wrong, wrong[:5]


def test_long_number_run(evaluate):
    assert evaluate(X.drop_number_runs, [("a\n" + "7\n" * 100_000 + "b",)], "t string") == ["a\nb"]


def test_render(evaluate):
    args = [("A: B", "https://h/x", 'T"é\n', 0)]
    schema = "t string, u string, c string, d bigint"
    assert evaluate(R.render_md, args, schema) == [
        '---\ntitle: A- B\nurl: https://h/x\ndate_scraped: 0\n---\nT"é\n']
    assert evaluate(R.render_json, args, schema) == [
        '{\n  "title": "A: B",\n  "url": "https://h/x",\n  "date_scraped": 0,\n'
        '  "content": "T\\"é\\n"\n}']


def test_first_n_of_a_hot_key(spark):
    rows = spark.range(5000).selectExpr("id % 3 = 0 AS other", "id AS v").selectExpr(
        "if(other, concat('k', v % 7), 'hot') AS k", "v"
    )
    got = first_n_per_key(rows, ["k"], [F.col("v")], 9, "v", 9).collect()
    want = {}
    for r in rows.orderBy("v").collect():
        want.setdefault(r.k, [])
        if len(want[r.k]) < 9:
            want[r.k].append(r.v)
    assert sorted((r.k, r.v) for r in got) == sorted((k, v) for k, vs in want.items() for v in vs)


def test_latest_capture(spark):
    rows = spark.createDataFrame(
        [("u", 1, 5), ("u", 2, 4), ("w", 3, 1)], "url string, page_id bigint, t int"
    ).withColumn("captured_at", F.timestamp_seconds("t"))
    assert sorted((r.url, r.page_id) for r in latest_captures(rows).collect()) == [("u", 1), ("w", 3)]
