"""Language identification and quality: held-out accuracy and defined results."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from pageloom.llm.byte_windows import text_bytes, windows
from pageloom.llm.language_id import fit_language, identify_language, language_id
from pageloom.llm.quality import FEATURES, features, fit, fit_quality, quality, score_quality
from pageloom.llm.queries import QUERIES


def test_windows_cover_all_bytes_once():
    texts = pa.array(["abc", "", None, "é" * 10, "x", "", "yz" * 9])
    data, offsets = text_bytes(texts.slice(0))
    assert bytes(data).decode() == "".join(t or "" for t in texts.to_pylist())
    for size in (1, 4, 7, 1000):
        seen = np.zeros(len(texts), int)
        for begin, end, held, cuts in windows(offsets, size):
            assert len(held) and cuts[0] == 0
            seen[held] += np.diff(np.append(cuts, end - begin))
        assert seen.tolist() == np.diff(offsets).tolist()
    sliced, cut = text_bytes(texts.slice(3, 2))
    assert bytes(sliced).decode() == "é" * 10 + "x" and cut.tolist() == [0, 20, 21]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_held_out_languages(spark):
    found = QUERIES["op9_language_id"](spark, SF)
    rows = found.join(documents(spark), "doc_id").collect()
    assert len(rows) == documents(spark).count()
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert np.mean([r.accepted for r in held]) > 0.97


def test_language_edge_cases(spark):
    docs = documents(spark)
    model = fit_language(docs, F.lit(True), rows_per_label=40)
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "日本語"), (None, "the of and"), (6, "the of and " * 90_000), (7, "of the x")]
    table = spark.createDataFrame([(*r, "zz", 0.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in identify_language(table, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert not any(got[i].accepted or got[i].score for i in (1, 2, 3))
    assert got[4].lang_pred in model.labels and got[7].lang_pred in model.labels
    assert got[6].lang_pred == "en" == got[None].lang_pred and got[6].score > 0.8
    again = identify_language(table, fit_language(docs, F.lit(True), rows_per_label=40))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got.values()))
    unlabelled = table.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id(unlabelled).collect()} == {"und"}
    assert {r.lang_pred for r in language_id(table).filter("doc_id = 6").collect()} == {"zz"}
    assert language_id(table.filter("false")).count() == 0


def test_unlearned_texts_are_rejected(spark):
    docs = documents(spark)
    unlearned = ["日本語の文章", "日本語", "Это предложение", "нет", "Η γλώσσα είναι", "שלום עולם טוב", "이것은 한국어", "zqxj vkwq pfgx bzzk"]
    clean = ["of the x", "of the", "ok", "a", "Von.", "les et de", "Der Vertrag wurde gestern unterschrieben", "Le contrat a été signé"]
    rows = [(i, text) for i, text in enumerate(unlearned + clean)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for labels in (["en", "fr", "de", "es"], ["en", "fr"], ["en"]):
        model = fit_language(docs.filter(F.col("lang").isin(labels)), F.lit(True))
        got = {r.doc_id: r for r in identify_language(table, model).collect()}
        assert not any(got[i].accepted for i in range(len(unlearned))), labels
        if len(labels) == 4:
            assert all(got[len(unlearned) + i].accepted for i in range(len(clean)))
        own = identify_language(docs.filter(F.col("lang").isin(labels)), model)
        assert own.filter("not accepted").count() <= 0.01 * own.count()


def test_held_out_quality(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = QUERIES["op2_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").collect()
    good, bad = [[r.score for r in rows if r.quality == q] for q in (1, 0)]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_learns_pairs():
    draw = np.random.default_rng(1)
    x = draw.uniform(-1, 1, (3000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # neither feature tells anything alone
    model = fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert {(i, j) for i, j, _ in model.pairs} >= {(1, 0)}
    odds = np.full(1000, model.intercept)
    bins = model.bins(x[2000:])
    for row in range(1000):  # a score is the sum of the looked-up values
        odds[row] += sum(t[bins[row, i]] for i, t in enumerate(model.tables))
        odds[row] += sum(t[bins[row, i], bins[row, j]] for i, j, t in model.pairs)
    assert np.allclose(odds, model.log_odds(x[2000:]))


def test_features_do_not_depend_on_batches():
    texts = ["", "a b c", "SHOUT!! " * 300, "é" * 5000, None, "x " * 700_000]
    whole = features(pa.array(texts))
    assert whole.shape == (len(texts), len(FEATURES)) and np.isfinite(whole).all()
    for i, text in enumerate(texts):
        assert np.allclose(features(pa.array([text], pa.string()))[0], whole[i])
    assert whole[2][FEATURES.index("shout")] == pytest.approx(0.25)


def plain_features(text):
    """The features of a text, character by character and word by word."""
    import re
    from collections import Counter

    kinds = {
        "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "numeral": "0123456789",
        "space": " \t\r\v\f", "line": "\n", "stop": ".?", "comma": ",;:", "shout": "!", "bar": "|",
        "symbol": "#$%&*+/<=>@\\^_`{}~", "quote": "'\"()[]-",
    }
    data = (text or "").encode()
    out = {k: sum(b in v.encode() for b in data) / max(1, len(data)) for k, v in kinds.items()}
    out["other"] = 1 - sum(out.values()) if data else 0.0
    words = re.findall(rb"[^\x20\x09-\x0D]+", data.lower())
    n = max(1, len(words))
    counts = Counter(words)
    out |= {
        "log_bytes": np.log1p(len(data)),
        "log_words": np.log1p(len(words)),
        "word_bytes": sum(map(len, words)) / n,
        "short_words": sum(len(w) <= 3 for w in words) / n,
        "long_words": sum(len(w) > 14 for w in words) / n,
        "distinct_words": len(counts) / n,
        "top_word": max(counts.values(), default=0) / n,
        "doubled_words": sum(a == b for a, b in zip(words, words[1:])) / n,
        "line_words": np.log1p(len(words) / (data.count(b"\n") + 1)),
    }
    return [out[name] for name in FEATURES]


def test_features_against_loops(spark):
    texts = ["", None, "a b c", "SHOUT!! 12 12\n\n", "é|— ok ok ok", "tab\tand\x0bline\x0cfeed  "]
    texts += [r.text for r in documents(spark).limit(60).collect()]
    assert np.allclose(features(pa.array(texts, pa.string())), [plain_features(t) for t in texts])


def test_quality_does_not_depend_on_the_order_of_rows(spark):
    docs = documents(spark).select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    both = labels.limit(20)
    odd = labels.unionByName(both.withColumn("quality", 1 - F.col("quality")))  # these have both labels
    twice = docs.unionByName(docs.withColumn("text", F.reverse("text")))  # two texts under each id
    one, other = (
        {(r.doc_id, r.held_out): r.score for r in quality(d, l).filter("doc_id % 7 = 0").orderBy("score").collect()}
        for d, l in ((twice, odd), (twice.repartition(5, "text"), odd.repartition(3)))
    )
    assert one == other
    without = labels.join(both.select("doc_id"), "doc_id", "left_anti")
    x, y = (fit_quality(docs, table, F.lit(True)).log_odds(np.zeros((1, len(FEATURES)))) for table in (odd, without))
    assert x == y


def test_quality_query_columns_may_stand_in_the_input(spark):
    docs = documents(spark).limit(20).select("doc_id", "text", F.lit(1).alias("score"), F.lit(2).alias("held_out"),
                                             F.lit(3).alias("predicted"), F.lit(4).alias("label"), F.lit(5).alias("x"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert quality(docs, labels).columns == ["doc_id", "held_out", "score", "predicted"]
    assert quality(docs, labels).count() == 20


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, 5), (2, "", 5), (None, "text", 5), (4, "word " * 200_000, 5)], "doc_id long, text string, quality int"
    )
    schema = "doc_id long, quality int"
    for labels, want in (([], 0.5), ([(4, None)], 0.5), ([(1, 1), (2, 1)], 1.0), ([(4, 0), (99, 0)], 0.0)):
        model = fit_quality(docs, spark.createDataFrame(labels, schema), F.lit(True))
        scores = [r.score for r in score_quality(docs, model).collect()]
        assert len(scores) == 4 and all(abs(s - want) < 1e-5 for s in scores)
    assert quality(docs.filter("false"), spark.createDataFrame([], schema)).count() == 0
