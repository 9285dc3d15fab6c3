"""Alignment of two tokenizers against both libraries and plain loops."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm import incidence
from pageloom.llm.incidence import Csr, align, shared_group_links
from pageloom.llm.token_alignment import Aligner, align_tokens, token_alignment, vocabularies

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"
TEXTS = [
    "Hello world, this is text.",
    "naïve café 12 345 über straße",
    "  leading and  double   spaces \n\n newline\ttab ",
    "日本語のテキスト and English",
    "emoji 🙂👩‍👩‍👧 <|endoftext|> <s> </s> <unk> <0x41>",
    "a ▁ b holds the mark",
    "the the the the quick brown fox don't I'm we'll",
    "x" * 5_000,
    "ab1 cd a\x00b \x85  ",
    "",
    None,
    "z",
    " ",
]


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(text, libraries):
    """Ids, groups and links of one text, token by token."""
    words = vocabularies(A, B)
    a_ids = libraries[0].encode(" " + (text or ""), add_special_tokens=False).ids if text else []
    b_ids = libraries[1].encode(text) if text else []
    whole = (" " + (text or "")).encode()
    if b"".join(words.a[i] for i in a_ids) != whole or b"".join(words.b[i] for i in b_ids) != whole:
        return [], [], [], []
    ends = []
    for ids, tokens in ((a_ids, words.a), (b_ids, words.b)):
        at, own = 0, []
        for i in ids:
            at += len(tokens[i])
            own.append(at)
        ends.append(own)
    links = [(a_ids[i], b_ids[j]) for i, x in enumerate(ends[0]) for j, y in enumerate(ends[1]) if x == y]
    groups, a_part, b_part, j = [], [], [], 0
    for i, end in enumerate(ends[0]):
        a_part.append(a_ids[i])
        while j < len(b_ids) and ends[1][j] <= end:
            b_part.append(b_ids[j])
            j += 1
        if end in ends[1]:
            groups.append((a_part, b_part))
            a_part, b_part = [], []
    return a_ids, b_ids, groups, links


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def test_against_the_libraries(spark, libraries):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (3, TEXTS[0]), (3, TEXTS[0])]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS links", "3 AS n_a", "'g' AS groups")
    found = token_alignment(docs, A, B, part_chars=50).collect()
    wanted = [plain(t, libraries) for _, t in rows]
    counts = Counter(pair for *_, links in wanted for pair in links)
    most = {}
    for (_, b), c in counts.items():
        most[b] = max(c, most.get(b, 0))
    expected = []
    for (i, _), (a, b, groups, links) in zip(rows, wanted):
        digest = hashlib.sha256(written(groups).encode()).hexdigest() if a else ""
        best = sum(counts[p] == most[p[1]] for p in links)
        expected.append((i, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), digest))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    order = lambda r: (r[0] is None, r[0] or 0, r[7])
    assert sorted((tuple(r[n] for n in names) for r in found), key=order) == sorted(expected, key=order)


def test_groups_and_links_of_given_rows(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    words = vocabularies(A, B)
    for r in align_tokens(docs, A, B).collect():
        text = docs_text(docs)[r.doc_id]
        a, b, groups, links = plain(text, libraries)
        assert r.groups == written(groups)
        assert [(words.pair_a[i], words.pair_b[i]) for i in r.links] == links
        assert r.n_group_pairs == sum(len(x) * len(y) for x, y in groups)


_TEXTS = {}


def docs_text(docs):
    if not _TEXTS:
        _TEXTS.update({r.doc_id: r.text for r in docs.collect()})
    return _TEXTS


def test_empty_table(spark):
    assert token_alignment(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_small_table_of_segments(libraries):
    tool = Aligner(A, B, most_bytes=5_000)
    for text in [t for t in TEXTS if t] * 2:
        sums, groups, _ = tool.rows([text])[0]
        a, b, wanted, _ = plain(text, libraries)
        assert (sums[0], sums[1], groups) == (len(a), len(b), written(wanted))


def dense(m):
    out = np.zeros((len(m.indptr) - 1, m.columns), np.int64)
    np.add.at(out, (m.rows, m.indices), m.data)
    return out


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(1, 6), st.integers(0, 10**6))
def test_row_products(n, k, m, seed):
    draw = np.random.default_rng(seed)
    x, y = draw.integers(0, 3, (n, k)), draw.integers(0, 3, (k, m))

    def sparse(table):
        rows, columns = np.nonzero(table)
        indptr = np.searchsorted(rows, np.arange(len(table) + 1))
        return Csr(indptr, columns, table[rows, columns], table.shape[1])

    assert (dense(sparse(x).times(sparse(y))) == x @ y).all()
    assert (dense(sparse(x).transposed()) == x.T).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=40), st.integers(0, 10**6), st.sampled_from([3, 1 << 20]))
def test_alignment_in_windows(sizes, seed, window):
    total = sum(sizes)
    draw = np.random.default_rng(seed)
    cuts = np.unique(np.append(draw.integers(1, total + 1, 10), total))
    other = np.diff(cuts, prepend=0)
    whole, incidence.WINDOW = incidence.WINDOW, window
    try:
        found = align(np.array(sizes), other)
        groups = [p for a, b in shared_group_links(found) for p in zip(a.tolist(), b.tolist())]
    finally:
        incidence.WINDOW = whole
    ends = np.cumsum(sizes).tolist()
    assert list(zip(found.link_a.tolist(), found.link_b.tolist())) == [
        (i, j) for i, x in enumerate(ends) for j, y in enumerate(cuts.tolist()) if x == y
    ]
    begins = [e - s for e, s in zip(ends, sizes)]
    assert found.overlaps == sum(
        x < d and c < y for x, y in zip(begins, ends) for c, d in zip([0, *cuts[:-1].tolist()], cuts.tolist())
    )
    assert sorted(groups) == [
        (i, j) for i in range(len(sizes)) for j in range(len(cuts)) if found.group_a[i] == found.group_b[j]
    ]
    assert len(groups) == found.group_sizes.sum()
