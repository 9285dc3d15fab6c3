"""Top-k search against a full scan in Python integers."""

import math

import pytest
from conftest import SF
from oracle import compare, connect
from pyspark.sql import functions as F

from pageloom.llm.queries import ORACLES, QUERIES
from pageloom.llm.topk_search import rank_key, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, q string, c int"
ROWS = [
    (0, [0.5, -0.25, 0.0]),
    (1, [0.5, -0.25, 0.0]),
    (2, [0.5, -0.25, 0.0]),
    (3, [0.0, 0.0, 0.0]),
    (4, [0.1]),
    (5, []),
    (6, None),
    (7, [0.1, None, 0.2]),
    (8, [float("nan"), 0.0, 1.0]),
    (9, [float("inf"), 0.0, 1.0]),
    (None, [1.0, 1.0, 1.0]),
    (50, [-0.3, 0.7, 0.001]),
    (100, [0.5, -0.25, 0.0]),
    (100, [0.5, -0.25, 0.0]),
    *[(200 + i, [math.sin(i), math.cos(i), (i % 7) / 7]) for i in range(90)],
]


def brute(rows, k):
    import numpy as np

    vectors = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, v in {(i, tuple(v)) for i, v in vectors if i % 50 == 0}:
        scores = [(sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q]
        best = sorted(scores, key=lambda s: (-s[0], s[1]))[:k]
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("k,candidates,queries", [(5, 4096, 1024), (5, 7, 2), (1, 10, 1), (500, 16, 3)])
def test_against_a_scan(spark, k, candidates, queries):
    table = spark.createDataFrame([(*r, 1, "", 2) for r in ROWS], SCHEMA)
    got = top_k(table, F.col("vec_id") % 50 == 0, k, candidate_block=candidates, query_block=queries)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(ROWS, k)


def test_components_of_any_size(spark):
    rows = [
        (0, [1.0, 2.0]), (1, [1e7, 0.0]), (2, [3.0, 4.0]), (3, [1e300, -1e290]), (4, [-1e300, 5.0]),
        (50, [2.0**24, 1.0]), (100, [2.0**40, -3.5]), (150, [1e300, 1e17]), (200, [-7.0]), (5, [1.7e308, 1.0]),
        (6, [2.0**24, 1.0]), (250, [float("inf"), 0.0]),
    ]
    taking = [(i, v) for i, v in rows if all(math.isfinite(256 * x) for x in v)]
    whole = {i: [math.floor(256 * x) for x in v] for i, v in taking}
    wanted = []
    for q in (i for i in whole if i % 50 == 0):
        scores = [(sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q]
        for rank, (score, i) in enumerate(sorted(scores, key=lambda s: (-s[0], s[1]))[:5], 1):
            wanted.append((q, rank, i, min(max(score, -(2**63)), 2**63 - 1)))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for blocks in ((4096, 1024), (2, 1)):
        got = top_k(table, F.col("vec_id") % 50 == 0, 5, candidate_block=blocks[0], query_block=blocks[1])
        assert sorted(map(tuple, got.collect())) == sorted(wanted)


def test_keys_are_in_order():
    numbers = [0, 1, -1, 255, 256, -255, -256, 2**70, -(2**70), 2**63, -(2**63), 7**300, -(7**300)]
    assert sorted(numbers, key=rank_key) == sorted(numbers)


def test_without_queries_or_rows(spark):
    none = F.col("vec_id") == -1
    assert top_k(spark.createDataFrame([(*ROWS[0], 1, "", 2)], SCHEMA), none).count() == 0
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_oracle(spark):
    name = "op3_topk_search"
    assert compare(spark, connect(SF), SF, QUERIES[name], ORACLES[name]) is None
