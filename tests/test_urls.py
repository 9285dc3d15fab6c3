"""URL rules against hand-made values and the standard library."""

import random
from urllib.parse import urldefrag, urljoin, urlparse

import pytest

from pageloom.functions import urls as U

BASE = "https://h.example/docs/a/b.html?q=1"

NORMALIZED = {
    "c": "https://h.example/docs/a/c",
    "./c": "https://h.example/docs/a/c",
    "../c": "https://h.example/docs/c",
    "../../../c": "https://h.example/c",
    "/x": "https://h.example/x",
    "//K.Example/Y": "https://k.example/Y",
    "?z=2": "https://h.example/docs/a/b.html?z=2",
    "#top": BASE,
    "https:": BASE,
    "HTTP://Up.Example:80/P?Q#F": "http://up.example:80/P?Q",
    "mailto:a@b": None,
    "javascript:void(0)": None,
    "": None,
    None: None,
    "a b": "https://h.example/docs/a/a b",
    "/p;x=1": "https://h.example/p;x=1",
    "d/..": "https://h.example/docs/a/",
    ".": "https://h.example/docs/a/",
    "..": "https://h.example/docs/",
    "http://h?": "http://h",
    "/a?": "https://h.example/a",
    "/%7Ea": "https://h.example/%7Ea",
    "/ü": "https://h.example/ü",
}

SLUGS = [
    ("https://h/docs/", "https://h/docs/", "docs/index.md"),
    ("https://h/docs/", "https://h/docs/guide/", "docs/guide.md"),
    ("https://h/docs/", "https://h/docs/guide/index.html", "docs/guide.md"),
    ("https://h/docs/", "https://h/docs/a.html?x=1", "docs/a.md"),
    ("https://h/docs/", "https://h/docs/v1.2/a b", "docs/v1-2/a-b.md"),
    ("https://h/docs/", "https://h/docs/é%20z", "docs/--20z.md"),
    ("https://h/docs/", "https://h/", "index.md"),
    ("https://h/", "https://h/", "index.md"),
    ("https://h/", "https://h", "index.md"),
    ("https://h/", "https://h/a/index", "a.md"),
    ("https://h/", "https://h/a.htm", "a-htm.md"),
    ("https://h/", "https://h/p;x=1/q;y=2", "p-x-1/q.md"),
    ("https://h/", "https://h/.html", "index.md"),
    ("https://h/", "https://h/a//b/", "a/b.md"),
]


def test_normalize_url_values(evaluate):
    got = evaluate(U.normalize_url, [(BASE, h) for h in NORMALIZED], "b string, h string")
    assert dict(zip(NORMALIZED, got)) == NORMALIZED


def _expected(base, href):
    if not href:
        return None
    try:
        u = urlparse(urldefrag(urljoin(base, href))[0])
    except ValueError:
        return None
    if u.scheme not in ("http", "https"):
        return None
    return u._replace(netloc=u.netloc.lower()).geturl()


def test_normalize_url_is_the_standard_algorithm(evaluate):
    rng = random.Random(7)
    pieces = ["a", "B", "..", ".", "/", "//", "?", "#", ";", "x=1", ":", "http:", "https://",
              "H.Ex", " ", "%2F", "é", "index.html", "...", "a.b"]
    bases = ["https://h.ex", "https://h.ex/", "http://U@H.ex:8/a/b;p?q#f", "https://h.ex/a//b/../c",
             "https://h.ex/a/./", "https://h.ex/?q"]
    rows = [
        (rng.choice(bases), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))))
        for _ in range(3000)
    ]
    got = evaluate(U.normalize_url, rows, "b string, h string")
    wrong = [(r, g, _expected(*r)) for r, g in zip(rows, got) if g != _expected(*r)]
    assert not wrong, wrong[:10]


def test_normalized_urls_stay(evaluate):
    urls = [u for u in NORMALIZED.values() if u]
    assert evaluate(U.normalize_url, [(u, u) for u in urls], "b string, h string") == urls


@pytest.mark.parametrize("scheme", ["http", "https"])
def test_parts_are_the_standard_parts(evaluate, scheme):
    urls = [f"{scheme}://U@Host:80/a;b/c;d=1?q?r#f#g", f"{scheme}://h", f"{scheme}://h?x",
            f"{scheme}://h/a|b c", "no scheme/here", "", "//h/p", "?q", "#f"]
    got = evaluate(U.url_parts, [(u,) for u in urls], "u string")
    want = [tuple(urlparse(u)) for u in urls]
    assert [tuple(g) for g in got] == want


def test_slugs(evaluate):
    got = evaluate(U.slugify_path, [s[:2] for s in SLUGS], "r string, p string")
    assert got == [s[2] for s in SLUGS]


def test_seed_and_base(evaluate):
    seeds = ["https://h", "https://h/docs", "https://h/docs?x=1", "https://h/a.html", "https://H/"]
    normal = evaluate(U.normalize_seed, [(s,) for s in seeds], "s string")
    assert normal == ["https://h", "https://h/docs/", "https://h/docs?x=1/", "https://h/a.html/",
                      "https://H/"]
    bases = evaluate(U.crawl_base, [(s,) for s in normal], "s string")
    assert bases == ["https://h/", "https://h/docs/", "https://h/docs/", "https://h/a.html/",
                     "https://h/"]


def test_domain(evaluate):
    assert evaluate(U.domain_key, [("http://a.b:1/c",), ("x/y",)], "s string") == [
        "a.b:1", "unknown"]
