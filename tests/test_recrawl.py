"""A crawl kept up to date equals one from scratch after every wave."""

import random

import pytest
from pyspark.sql import functions as F

from pageloom.config import HarvestConfig
from pageloom.plans import recrawl
from pageloom.plans.crawl import crawl
from pageloom.plans.recrawl import Recrawl

SCHEMA = "page_id bigint, url string, status int, content_type string, html string, at bigint"


def captures(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    return table.withColumn("captured_at", F.timestamp_seconds("at")).drop("at")


def in_order(saved):
    rows = sorted(saved.collect(), key=lambda r: (r.seed_id, r.depth, r.ord))
    return [(r.seed_id, r.url, r.depth, r.page_id) for r in rows]


def waves(rng):
    """Three waves of captures of two sites: most pages, then a few changes of every kind."""
    urls = [f"https://h{s}/{'' if i == 0 else i}" for s in range(2) for i in range(40)]
    number, last = 0, {}

    def capture(url, at, status=200, same=False):
        nonlocal number
        number += 1
        if not (same and url in last):
            links = "".join(f'<a href="{rng.choice(urls)}">l</a>' for _ in range(3))
            # some texts are those of another page
            last[url] = rng.choice([links + url + str(number)] * 4 + [*last.values()][:1])
        return (number, url, status, "text/html", last[url], at)

    yield [capture(u, 10) for u in urls if rng.random() < 0.85 or u.endswith("/")]
    yield [capture(u, 20, same=True) for u in rng.sample(urls, 6)] + [capture(u, 20) for u in rng.sample(urls, 3)]
    late = [capture(u, 5) for u in rng.sample(urls, 2)]  # from before the first wave
    yield late + [capture(u, 30, rng.choice([200, 404])) for u in rng.sample(urls, 4)]
    yield []


@pytest.mark.parametrize("seed, limit, depth", [(1, None, 0), (2, 12, 0), (3, None, 3)])
def test_three_waves(spark, tmp_path, seed, limit, depth):
    seeds = spark.createDataFrame([(0, "https://h0/"), (1, "https://h1/"), (2, "https://h0/")], "seed_id bigint, seed string")
    cfg = HarvestConfig(max_pages=limit, depth=depth)
    state = Recrawl(spark, str(tmp_path / "log"), seeds, cfg=cfg)
    rows = []
    for wave in waves(random.Random(seed)):
        rows += wave
        told = state.update(captures(spark, wave))
        assert told["parsed"] <= len(wave)
        assert in_order(state.saved()) == in_order(crawl(seeds, captures(spark, rows), cfg=cfg))
    assert told == {"parsed": 0, "changed": 0, "seeds": 0, "saved": 0}
    # a new session finds the log as it is
    again = Recrawl(spark, str(tmp_path / "log"), seeds, cfg=cfg)
    assert in_order(again.saved()) == in_order(state.saved())
    assert again.update(captures(spark, rows))["parsed"] == 0


def test_a_deep_change_walks_little(spark, tmp_path, monkeypatch):
    """On a chain only what lies below the change is walked again, of its seed alone."""
    monkeypatch.setattr(recrawl, "COMPACT", 3)
    rows = [(100 * s + i, f"https://h{s}/{i or ''}", 200, "text/html", f'<a href="/{i + 1}">n</a>{s} {i}', 1)
            for s in range(2) for i in range(12)]
    seeds = spark.createDataFrame([(0, "https://h0/"), (1, "https://h1/")], "seed_id bigint, seed string")
    state = Recrawl(spark, str(tmp_path / "log"), seeds)
    assert state.update(captures(spark, rows)) == {"parsed": 24, "changed": 24, "seeds": 2, "saved": 24}
    edit = (900, "https://h0/9", 200, "text/html", '<a href="/10">n</a>edited', 2)
    assert state.update(captures(spark, [edit])) == {"parsed": 1, "changed": 1, "seeds": 1, "saved": 3}
    cut = (901, "https://h0/10", 404, "text/html", "", 3)
    assert state.update(captures(spark, [cut])) == {"parsed": 0, "changed": 1, "seeds": 1, "saved": 0}
    assert state.versions("compacted") == [3]
    elsewhere = (902, "https://h0/alone", 200, "text/html", "x", 4)  # nothing links to it
    assert state.update(captures(spark, [elsewhere])) == {"parsed": 1, "changed": 1, "seeds": 0, "saved": 0}
    back = (903, "https://h0/10", 200, "text/html", '<a href="/11">n</a>back', 5)
    assert state.update(captures(spark, [back])) == {"parsed": 1, "changed": 1, "seeds": 1, "saved": 2}
    assert in_order(state.saved()) == in_order(crawl(seeds, captures(spark, [*rows, edit, cut, elsewhere, back])))


def test_a_failed_wave_is_done_again(spark, tmp_path, monkeypatch):
    rows = [(i, f"https://h/{i or ''}", 200, "text/html", f'<a href="/{i + 1}">n</a>{i}', 1) for i in range(4)]
    seeds = spark.createDataFrame([(0, "https://h/")], "seed_id bigint, seed string")
    state = Recrawl(spark, str(tmp_path / "log"), seeds)
    state.update(captures(spark, rows[:2]))
    with monkeypatch.context() as broken:
        broken.setattr(Recrawl, "_walk_again", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            state.update(captures(spark, rows[2:]))
    assert state.update(captures(spark, rows[2:])) == {"parsed": 2, "changed": 2, "seeds": 1, "saved": 2}
    assert in_order(state.saved()) == in_order(crawl(seeds, captures(spark, rows)))


def test_a_long_walk_looks_into_one_table(spark, tmp_path, monkeypatch):
    """Few levels look URLs up version by version; many, or other partitions, change no result."""
    rows = [(100 * s + i, f"https://h{s}/{i or ''}", 200, "text/html", f'<a href="/{i + 1}">n</a>{s} {i}', 1)
            for s in range(3) for i in range(9)]
    seeds = spark.createDataFrame([(s, f"https://h{s}/") for s in range(3)], "seed_id bigint, seed string")
    looked = []
    kept = recrawl.written

    def written(df, path):
        looked.extend([path] if path.endswith("/urls") else [])
        return kept(df, path)

    monkeypatch.setattr(recrawl, "written", written)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        state = Recrawl(spark, str(tmp_path / "log"), seeds)
        state.update(captures(spark, rows))
        tables = spark.catalog.listTables()
        edits = [(900 + s, f"https://h{s}/2", 200, "text/html", f'<a href="/3">n</a>edit {s}', 2) for s in (0, 1)]
        assert state.update(captures(spark, edits)) == {"parsed": 2, "changed": 2, "seeds": 2, "saved": 14}
        assert len(looked) == recrawl.LONG
        assert len(spark.catalog.listTables()) == len(tables) + 1  # the links of the wave
        assert in_order(state.saved()) == in_order(crawl(seeds, captures(spark, [*rows, *edits])))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
