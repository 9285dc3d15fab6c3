"""Near duplicates and components against brute force."""

import random
import re
from collections import defaultdict

import pytest
from conftest import SF

from pageloom.llm.components import components
from pageloom.llm.near_dedup import near_dedup
from pageloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words):
    found = WORD.findall((text or "").translate(LOWER))
    if len(found) >= words:
        return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}
    return {tuple(found)} if found else set()


def brute(rows, words, num=80, den=100):
    """id -> (set size, component) by counting shared shingles of all pairs."""
    sets = {i: shingles(t, words) for i, t in rows}
    holders, shared = defaultdict(list), defaultdict(int)
    for i, own in sets.items():
        for s in own:
            for j in holders[s]:
                shared[j, i] += 1
            holders[s].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, j), n in shared.items():
        if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus():
    """Families of edited copies, one large and chained; passages that many texts share."""
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    fresh = lambda n: draw.choices(vocabulary, k=n)
    texts = [None, "", "  \t\n", "one", "ONE", "one two", "one two three four", "One two\nthree four"]
    shared = fresh(60)
    for _ in range(60):  # half of each text is a common passage
        texts.append(" ".join(shared + fresh(60)))
    for size, edits in ((120, 6), (5, 2), (3, 12), (2, 1), (2, 0)):
        base = fresh(300)
        for _ in range(size):
            copy = list(base)
            for at in draw.sample(range(300), edits):
                copy[at] = draw.choice(vocabulary)
            texts.append(" ".join(copy))
    chain = fresh(200)
    for _ in range(30):  # each is near the one before only
        for at in draw.sample(range(200), 4):
            chain[at] = draw.choice(vocabulary)
        texts.append(" ".join(chain))
    order = list(range(len(texts)))
    draw.shuffle(order)
    return [(i * 3 + 1, texts[at]) for i, at in enumerate(order)]


@pytest.mark.parametrize("words", [4, 5])
def test_against_all_pairs(spark, words):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0, "") for r in rows], "doc_id long, text string, n int, sig string")
    got = near_dedup(docs, words=words)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = brute(rows, words)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()}
    assert found == want
    assert {r.doc_id for r in got.filter("kept").collect()} == {i for i, (_, c) in want.items() if i == c}


def test_defined_results(spark):
    same = "a b c d e f g"
    rows = [(7, same), (7, same), (None, same), (None, "q r s t u v"), (3, None), (4, ""), (None, None), (9, same.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_dedup(docs, words=4).collect()), key=repr)
    assert got == sorted(
        [
            (7, 4, 7, True), (7, 4, 7, True), (None, 4, 7, True), (None, 3, None, True), (3, 0, 3, True),
            (4, 0, 4, True), (None, 0, None, True), (9, 4, 7, False),
        ],
        key=repr,
    )
    assert near_dedup(docs.filter("false")).count() == 0


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op5_minhash_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4)


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)]
    edges += [(1000 + i, 1001 + i) for i in range(40)]  # a path
    edges += [(2000, 2000 + i) for i in range(1, 60)]  # a star
    edges += [(5, 5), (None, 4), (6, None)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.component for r in found} == {i: root(i) for i in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
