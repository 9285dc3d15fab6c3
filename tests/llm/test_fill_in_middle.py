"""Fill-in-the-middle documents against regular expressions, and the boundary set."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm.boundary_set import ARRAY, BITMAP, RUNS, BoundarySet
from pageloom.llm.fill_in_middle import boundaries, cut, fill_in_middle, restored

SCHEMA = "doc_id long, text string"


def plain(doc_id, text):
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_regular_expressions(spark):
    parts = ["Word", "naïve", " ", "\n", "12", "🙂", "é", "<", "P>", "a<b", "<S", "ß", "\x00"]
    rows = [(i, "".join(parts[(i * 7 + j * j) % len(parts)] for j in range(i % 60))) for i in range(400)]
    rows += [(400, "a <P> b"), (401, "<M>"), (402, None), (None, "one two three"), (403, "x" * 200_000 + " y" * 50_000)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS form", "3 AS id", "4 AS cuts")
    found = fill_in_middle(docs)
    found = found.withColumn("restored", restored(found.output, found.form)).collect()
    texts = {i: t or "" for i, t in rows}
    assert len(found) == len(rows)
    for r in found:
        wanted = plain(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == wanted
        assert r.restored == texts[r.doc_id]
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_empty_table_and_repeats(spark):
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []
    twice = fill_in_middle(spark.createDataFrame([(5, "a b c")] * 2, SCHEMA)).collect()
    assert twice[0] == twice[1]


@settings(max_examples=60, deadline=None)
@given(st.text(), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts_of_any_text(text, one, other):
    text = text.encode("utf-8", "ignore").decode()
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((one % (len(tokens) + 1), other % (len(tokens) + 1)))
    assert cut(text, one, other) == (len(tokens), len("".join(tokens[:a])), len("".join(tokens[:b])))


@pytest.mark.parametrize(
    "positions, forms",
    [
        (np.arange(0, 300_000, 97), {ARRAY}),
        (np.flatnonzero(np.random.default_rng(1).random(3 << 16) < 0.5), {BITMAP}),
        (np.concatenate([np.arange(10, 60_000), np.arange(200_000, 260_000)]), {RUNS}),
        (np.array([0]), {ARRAY}),
        (np.array([], np.int64), set()),
    ],
)
def test_select_in_every_form(positions, forms):
    found = BoundarySet(positions)
    assert len(found) == len(positions)
    assert {c.form for c in found.containers} == forms
    for rank in [*range(0, len(positions), 311), *([len(positions) - 1] if len(positions) else [])]:
        assert found.select(rank) == positions[rank]
    with pytest.raises(IndexError):
        found.select(len(positions))


def test_boundaries_use_several_containers():
    text = "ab " * 50_000
    found = boundaries(text)
    assert len(found.containers) == 3 and found.select(len(found) - 1) == len(text)
