"""Katz backoff against plain loops, its sums to one, and its defined cases."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pageloom.llm.katz import discounts, katz_scores, lm_scores, model_backoffs, model_grams, model_words
from pageloom.llm.packing import pack, pack_floats, pack_words, unpack, unpack_floats, unpack_words

SCHEMA = "doc_id long, text string, lang string"


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]  # None: the end


def plain_katz(texts, learned):
    """Scores by the definition, word by word."""
    words, pairs, after = Counter(), Counter(), Counter()
    for text in learned:
        tokens = words_of(text)
        words.update(tokens)
        pairs.update(zip(["<begin>", *tokens], tokens))
        after.update(["<begin>", *tokens[:-1]])

    def good_turing(counter):
        n = Counter(counter.values())
        return dict(enumerate(discounts([n[r] for r in range(1, 7)]), 1))

    d1, d2 = good_turing(words), good_turing(pairs)
    total = sum(words.values())

    def free(counts, d):
        found = sum((1 - d[c]) * c for c in counts if c in d)
        return found if any(c in d for c in counts) else 1.0

    left = free(words.values(), d1)
    n = total + (not any(c in d1 for c in words.values()))

    def one(w):
        return d1.get(words[w], 1) * words[w] / n if words[w] else left / n

    followers = {}
    for (v, w), c in pairs.items():
        followers.setdefault(v, {})[w] = c

    def two(v, w):
        if not after[v]:
            return one(w)
        counts = followers[v].values()
        t = after[v] + (not any(c in d2 for c in counts))
        c = pairs[v, w]
        if c:
            return d2.get(c, 1) * c / t
        return free(counts, d2) / t / (1 - sum(one(x) for x in followers[v])) * one(w)

    out = []
    for text in texts:
        tokens = words_of(text)
        base = sum(math.log10((words[w] + 1) / (total + len(words) + 1)) for w in tokens)
        score = sum(math.log10(two(v, w)) for v, w in zip(["<begin>", *tokens], tokens))
        out.append((len(tokens), sum(words[w] > 0 for w in tokens), total, base, score))
    return out


def corpus(n=300):
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "ÄRGER", "naïve", "x y"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(draw.choices(vocabulary, weights, k=draw.randint(0, 30))) for _ in range(n)]
    texts += [None, "", " \t\n", "the THE the " * 400, "never seen before", "\x1cone\x0btwo"]
    return [(i, t, "en") for i, t in enumerate(texts)]


@pytest.mark.parametrize("options", [{}, {"block_tokens": 300, "word_buckets": 3, "bucket_tokens": 500, "hot": 40}])
def test_scores_against_loops(spark, options):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")
    found = {r.doc_id: r for r in lm_scores(docs, **options).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    wanted = plain_katz([t for _, t, _ in rows], [t for i, t, _ in rows if not out[i]])
    assert len(found) == len(rows)
    for (i, *_), (n, known, total, base, score) in zip(rows, wanted):
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-9)
        assert r.score == pytest.approx(score, abs=1e-8)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    _, model = katz_scores(docs, F.col("doc_id") % 4 != 0, hot=60)
    words = {r.id: r.probability for r in model_words(model).collect()}
    unknown = 1 - sum(words.values())
    assert 0 < unknown < 1
    grams = {}
    for r in model_grams(model).collect():
        grams.setdefault(r.history, {})[r.id] = r["count"]
    d = dict(enumerate(model.discount, 1))
    backoffs = {r.history: r for r in model_backoffs(model).collect()}
    assert set(backoffs) == set(grams)
    for history, seen in grams.items():
        b = backoffs[history]
        mass = sum(d.get(c, 1) * c / b.total for c in seen.values())
        rest = unknown + sum(p for i, p in words.items() if i not in seen)
        assert mass + b.backoff * rest == pytest.approx(1, abs=1e-9)


def test_good_turing_and_its_fallback():
    n = [1000, 300, 140, 80, 52, 37]
    found = discounts(n)
    cut = 6 * n[5] / n[0]
    assert found[1] == pytest.approx((3 * n[2] / (2 * n[1]) - cut) / (1 - cut))
    assert discounts([10, 0, 3, 0, 0, 0]) == [0.5, 0.75, 1 - 0.5 / 3, 0.875, 0.9]


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(None, "a b", "x"), (None, "a b", "x"), (1, "a b", "x"), (1, None, None), (2, "a c", "x")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "doc_id", "text", "'n' AS id", "1 AS block", "2 AS score", "3 AS held_out", "4 AS learns"
    )
    found = lm_scores(docs).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == [(0, 3), (0, 3), (1, 1), (1, 3), (2, 3)]
    assert len({r.score for r in found if r.n_tokens == 3 and r.doc_id != 2}) == 1


def test_empty_and_nothing_to_learn(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lm_scores(empty).collect() == []
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, "en")], SCHEMA)
    scores, _ = katz_scores(docs, F.lit(False))
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in scores.collect()] == [(0, 0, 0.0, 0.0)] * 2


def test_long_text_in_one_block(spark):
    docs = spark.createDataFrame([(1, "word other " * 60_000, "en"), (2, "word", "en")], SCHEMA)
    scores, _ = katz_scores(docs, F.lit(True), block_tokens=1_000, hot=1_000)
    assert {r.doc_id: r.n_tokens for r in scores.collect()} == {1: 120_001, 2: 2}


def test_packing():
    numbers = [0, 3, 3, 70_000, 2**40]
    assert unpack(pack(numbers)).tolist() == unpack(pack(numbers, True), True).tolist() == numbers
    assert unpack(pack([])).tolist() == []
    assert unpack_floats(pack_floats([-1.5, 0.0])).tolist() == [-1.5, 0.0]
    assert unpack_words(pack_words([b"a", b"\n"])) == [b"a", b"\n"]
    assert unpack_words(pack_words([])) == []
