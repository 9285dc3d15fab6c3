"""The filter of seen keys: never a miss, and most candidates need no look-up."""

import random

from pyspark.sql import functions as F

from pageloom.config import HarvestConfig
from pageloom.operators.membership import SeenFilter, key_filter, with_maybe
from pageloom.plans import crawl as C
from pageloom.session import work_dir


def test_no_key_is_missed_and_few_pass_by_chance(spark):
    rows = spark.range(0, 20_000).select(F.col("id").alias("seed_id"), F.sha1(F.col("id").cast("string")).alias("url"))
    keys = ["seed_id", "url"]
    known = key_filter(rows.filter("seed_id < 5000"), keys, 2_000)  # 25 bits a key
    assert known.count() <= 2_000
    found = with_maybe(rows, known, keys, 2_000)
    assert found.columns == ["seed_id", "url", "_maybe"]
    assert found.filter("seed_id < 5000 AND NOT _maybe").count() == 0
    assert found.filter("seed_id >= 5000 AND _maybe").count() < 0.02 * 15_000


def test_unseen_is_exact_for_any_size(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), f"u{rng.randrange(300)}") for _ in range(600)]
    schema = "seed_id bigint, url string"
    seen, asked = spark.createDataFrame(rows[:300], schema), spark.createDataFrame(rows[300:], schema)
    want = sorted(set(rows[300:]) - set(rows[:300]))
    for words in (1, 7, 5_000):
        passed = SeenFilter(spark, work_dir(spark), ["seed_id", "url"], words)
        passed.add(seen.limit(100).unionByName(seen))
        passed.add(seen.filter("false"))
        assert sorted(set(map(tuple, passed.unseen(asked, seen).collect()))) == want
        assert passed.told[0]["asked"] == 300 and (words > 1) == (passed.told[0]["looked_up"] < 300)


def test_crawls_look_up_what_may_be_seen_only(spark, monkeypatch):
    filters = []
    real = C.SeenFilter

    def kept(*args):
        filters.append(real(*args))
        return filters[-1]

    monkeypatch.setattr(C, "SeenFilter", kept)
    rows = [(i, f"https://h/{i or ''}", f'<a href="/{2 * i + 1}">l</a><a href="/{2 * i + 2}">r</a><a href="/">home</a>{i}')
            for i in range(127)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    seeds = spark.createDataFrame([(0, "https://h/")], "seed_id bigint, seed string")
    plain = C.crawl(seeds, pages)
    found = C.crawl(seeds, pages, cfg=HarvestConfig(seen_filter=4_096))
    order = lambda df: sorted((r.depth, r.ord, r.url, r.page_id) for r in df.collect())
    assert order(found) == order(plain)
    asked, looked_up = (sum(t[k] for t in filters[0].told) for k in ("asked", "looked_up"))
    # the links back to the first page, one a level, and hardly any other
    assert asked > 200 and len(filters[0].told) <= looked_up <= len(filters[0].told) + 5
