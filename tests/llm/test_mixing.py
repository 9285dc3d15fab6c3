"""Raking against plain loops, and what is sampled."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from pageloom.llm.mixing import TARGETS, fit_mix, mix, mix_documents, rake, topic, word_tokens
from pageloom.llm.queries import QUERIES

ROWS = [
    *[(i, "w " * (1 + i % 9), "en" if i % 3 else "fr", "a" if i % 4 else "b") for i in range(400)],
    (500, None, "en", "a"),
    (501, "", None, None),
    (502, "only here", "xx", "c"),
    (502, "only here", "xx", "c"),
    (None, "no id", "en", "a"),
]
TARGET = {"source": {"a": 0.5, "b": 0.4}, "lang": {"en": 0.5, "fr": 0.45}}


def table(spark):
    rows = [(*r, "", 1.0) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, cell string, probability double")


def loops(cells, targets):
    """Raking over a dictionary of cells."""
    weights = dict.fromkeys(cells, 1.0)
    for _ in range(500):
        for axis, target in enumerate(targets):
            total = sum(weights[c] * t for c, t in cells.items())
            for value, share in target.items():
                held = sum(weights[c] * t for c, t in cells.items() if c[axis] == value)
                for c in cells:
                    if c[axis] == value and held:
                        weights[c] *= share * total / held
    return weights


def test_against_loops(spark):
    columns = {"source": F.col("source"), "lang": F.col("lang")}
    raked = fit_mix(table(spark), columns, word_tokens(F.col("text")), TARGET)
    cells = {}
    for _, text, lang, source in ROWS:
        key = (source if source in TARGET["source"] else "other", lang if lang in TARGET["lang"] else "other")
        cells[key] = cells.get(key, 0) + len((text or "").split())
    cells = {c: t for c, t in cells.items() if t}
    wanted = loops(cells, [{"a": 0.5, "b": 0.4, "other": 0.1}, {"en": 0.5, "fr": 0.45, "other": 0.05}])
    most = max(wanted.values())
    for (source, lang), weight in wanted.items():
        at = raked.names[0].index(source), raked.names[1].index(lang)
        assert raked.probability[at] == pytest.approx(weight / most, rel=1e-6)


def test_shares_of_a_large_sample(spark):
    rows = spark.range(60_000).selectExpr(
        "id as doc_id", "repeat('w ', int(1 + id % 7)) as text", "if(id % 10 < 8, 'en', 'fr') as lang",
        "if(id % 3 = 0, 'a', 'b') as source",
    )
    target = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.6, "fr": 0.4}}
    columns = {c: F.col(c) for c in target}
    kept = mix(rows, columns, word_tokens(F.col("text")), target).filter("kept")
    total = kept.agg(F.sum("tokens")).first()[0]
    for column, shares in target.items():
        for r in kept.groupBy(column).agg(F.sum("tokens").alias("n")).collect():
            assert r.n / total == pytest.approx(shares[r[column]], abs=0.02)


def test_defined_results(spark):
    columns = {"source": F.col("source"), "lang": F.col("lang")}
    first = mix(table(spark), columns, word_tokens(F.col("text")), TARGET)
    rows = first.collect()
    assert len(rows) == len(ROWS) and first.columns[-4:] == ["tokens", "cell", "probability", "kept"]
    assert all(0 <= r.probability <= 1 for r in rows)
    assert len({r.kept for r in rows if r.doc_id == 502}) == 1
    again = mix(table(spark).repartition(7), columns, word_tokens(F.col("text")), TARGET)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, rows))
    assert mix(table(spark).filter("false"), columns, word_tokens(F.col("text")), TARGET).count() == 0
    nothing = mix(table(spark).filter("text = ''"), columns, word_tokens(F.col("text")), TARGET)
    assert [(r.tokens, r.kept) for r in nothing.collect()] == [(0, True)]


def test_contradicting_targets():
    tokens = np.array([[10.0, 0.0], [0.0, 10.0]])  # only matching values occur
    weights = rake(tokens, [np.array([0.5, 0.5]), np.array([0.9, 0.1])], rounds=50)
    assert np.isfinite(weights).all()
    assert (tokens * weights).sum(axis=0) == pytest.approx([0.9, 0.1])


def test_unnamed_values_stay_where_targets_leave_nothing(spark):
    rows = [(i, "w " * 5, ["en", "fr", "de", "es", "it", None][i % 6], "src0" if i % 2 else "b") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = mix_documents(docs, TARGETS).collect()
    assert all(r.probability > 0 for r in found)
    total = sum(r.tokens * r.probability for r in found)
    held = sum(r.tokens * r.probability for r in found if r.lang in ("it", None))
    assert held / total == pytest.approx(1 / 3, abs=1e-6)
    alone = mix_documents(docs.filter("lang = 'it' or lang is null"), TARGETS).collect()
    assert len(alone) == 80 and all(r.probability > 0 for r in alone)
    dropped = mix_documents(docs, {"lang": {"en": 1.0, "other": 0.0}}).filter("kept")
    assert {r.lang for r in dropped.collect()} == {"en"}


def test_query(spark):
    rows = QUERIES["op4_mixing"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert {r.doc_id: r.tokens for r in rows} == {i: len((d.text or "").split()) for i, d in docs.items()}
    sums = {}
    for r in rows:
        sums[r.cell] = sums.get(r.cell, 0) + r.tokens * r.probability
    total = sum(sums.values())
    for axis, (column, shares) in enumerate(TARGETS.items()):
        for value, share in shares.items():
            held = sum(n for c, n in sums.items() if c.split("/")[axis] == value)
            assert held / total == pytest.approx(share, abs=1e-6), column


def test_topics(spark, evaluate):
    rows = [("Licensed", ), ("a@b", ), ("a | b", ), ("plain", ), (None, )]
    assert evaluate(topic, rows, "t string") == ["legal", "contact", "table", "prose", "prose"]
    assert mix_documents(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
