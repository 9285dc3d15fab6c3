"""Thin levels, many to a job, against a plain queue and against a job a level."""

import random

import pytest

from pageloom.config import HarvestConfig
from pageloom.plans import crawl as plan
from pageloom.plans import stretch
from pageloom.plans.crawl import crawl
from test_plans import _pages, _queue, _saved, _seeds


def _rows(sites):
    return [(i, u, 200, "text/html", t) for i, (u, (_, t)) in enumerate(sites.items())]


def _page(links, text):
    return links, "".join(f'<a href="{u}">l</a>' for u in links) + text


def test_a_chain_is_few_jobs(spark, monkeypatch):
    """Next links, to some pages that are refused; behind each of those a new way in."""
    urls = ["https://s/d/"] + [f"https://s/d/{i:04}" for i in range(1, 160)]
    sites = {u: _page([urls[i + 1], urls[i // 2]] if i + 1 < len(urls) else [], u) for i, u in enumerate(urls)}
    levels = []
    level_pages = plan.level_pages
    monkeypatch.setattr(plan, "level_pages", lambda *a: levels.append(1) or level_pages(*a))
    found = crawl(_seeds(spark, "https://s/d/"), _pages(spark, _rows(sites)), cfg=HarvestConfig())
    assert _saved(found) == _queue("https://s/d/", sites, 10_000, 0) == [(u, i) for i, u in enumerate(urls)]
    assert len(levels) < 40


@pytest.mark.parametrize("limit, depth, room", [(None, 0, 1 << 20), (None, 0, 1200), (17, 0, 1200), (None, 9, 1 << 20)])
def test_random_sites_as_a_queue(spark, monkeypatch, limit, depth, room):
    """Copies, refused pages, links back and forth; blocks that hold all, and few pages each."""
    monkeypatch.setattr(plan, "SLIM_LEVELS", 1)
    monkeypatch.setattr(plan, "SLIM_SHARE", 1)
    monkeypatch.setattr(stretch, "ROOM", room)
    monkeypatch.setattr(stretch, "SMALLEST", 1)
    walked = []
    walk = stretch.walk_stretch
    monkeypatch.setattr(plan, "walk_stretch", lambda *a: walked.append(walk(*a)) or walked[-1])
    rng = random.Random(3)
    sites = {}
    for s in range(3):
        urls = [f"https://s{s}/d/"] + [f"https://s{s}/d/{i:03}" for i in range(1, 70)]
        for i, url in enumerate(urls):
            links = [urls[min(i + rng.randint(-3, 3), 69) % 70] for _ in range(rng.randint(1, 3))]
            links += [f"https://s{s}/x", f"https://s{s}/d/gone", urls[min(i + 1, 69)]]
            sites[url] = _page(links, f"<p>{url}</p>")
            if rng.random() < 0.2 and i > 1:
                sites[url] = sites[urls[i - 1]]
    seeds = _seeds(spark, *[f"https://s{s}/d/" for s in range(3)])
    cfg = HarvestConfig(max_pages=limit, depth=depth, exclude="https://s1/d/.*7$")
    found = crawl(seeds, _pages(spark, _rows(sites)).repartition(3), cfg=cfg).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.depth, r.ord)):
        got.setdefault(r.seed, []).append((r.url, r.depth))
    kept = {u: p for u, p in sites.items() if not (u.startswith("https://s1") and u.endswith("7"))}
    for s in range(3):
        seed = f"https://s{s}/d/"
        assert got[seed] == _queue(seed, kept, limit or 10_000, depth)
    assert any(w is not None and w[1] > 1 for w in walked)
    assert len({r.page_id for r in found}) == len(found)
