"""Exact deduplication against a dictionary of normalised texts."""

import hashlib

import pytest
from conftest import SF
from oracle import compare, connect

from pageloom.llm.exact_dedup import build_index, exact_dedup
from pageloom.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [
    (1, "Same Text"),
    (2, "same text"),
    (3, "same  text"),
    (4, None),
    (5, ""),
    (6, "É"),
    (7, "é"),
    (9, "SAME TEXT"),
    (9, "SAME TEXT"),
    (None, "same text"),
    (None, "alone"),
    (10, "x" * 300_000),
    (11, "X" * 300_000),
    *[(100 + i, f"text {i % 37}") for i in range(200)],
]


def brute(rows):
    norms = [(t or "").translate(LOWER) for _, t in rows]
    groups = {}
    for (i, _), n in zip(rows, norms):
        groups.setdefault(n, []).append(i)
    out = []
    for (i, _), n in zip(rows, norms):
        keep = max((x for x in groups[n] if x is not None), default=None)
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("key_bits,capacity", [(63, 16_384), (63, 8), (3, 4), (0, 4)])
def test_against_a_dictionary(spark, key_bits, capacity):
    """Few key bits put different texts under one key, so chains are compared by bytes."""
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in ROWS], "doc_id long, text string, key int, norm string")
    got = exact_dedup(docs, capacity=capacity, key_bits=key_bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ROWS)


def test_directory_doubles_until_buckets_fit(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "concat('t', id) as text")
    index = build_index(docs, capacity=20)
    sizes = [r["count"] for r in index.entries.groupBy("bucket").count().collect()]
    assert sum(sizes) == 500 and max(sizes) <= 20
    slots = index.directory.collect()
    assert len(slots) == 1 << index.depth
    # Every bucket is one range of keys, pointed to by 2 ** (depth - local depth) slots.
    for bucket in {r.bucket for r in slots}:
        own = sorted(r.slot for r in slots if r.bucket == bucket)
        depth = {r.local_depth for r in slots if r.bucket == bucket}
        assert own == list(range(own[0], own[0] + len(own))) and len(own) == 1 << (index.depth - depth.pop())


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_oracle(spark):
    name = "op1_exact_dedup"
    assert compare(spark, connect(SF), SF, QUERIES[name], ORACLES[name]) is None
