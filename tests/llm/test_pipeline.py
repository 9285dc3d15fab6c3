"""The pipeline: what each stage keeps, on its own input."""

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF
from test_exact_dedup import brute as equal_texts
from test_near_dedup import brute as near_texts

from pageloom.llm.common import saved, table
from pageloom.llm.mixing import mix_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    """The documents before the first stage and after each one."""
    docs = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(saved(stage(spark, docs[-1], SF), name))
    return docs


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_return_documents(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "near_dedup", "mixing", "sentencepiece",
    ]
    assert all(df.columns == COLUMNS for df in steps[:-1])


def test_clean_languages_stay(steps):
    assert len(ids(steps[1])) >= 0.99 * len(ids(steps[0]))


def test_exact_copies(steps):
    assert ids(steps[2]) == sorted(r[0] for r in equal_texts(pairs(steps[1])) if r[3])


def test_near_copies(steps):
    want = near_texts(pairs(steps[2]), 5)
    assert ids(steps[3]) == sorted(i for i, (_, c) in want.items() if i == c)


def test_mix(steps):
    assert ids(steps[4]) == ids(mix_documents(steps[3]).filter("kept"))


def test_encoding(steps):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: library.encode(t or "") for i, t in pairs(steps[4])}
    assert {r.doc_id: r.ids for r in steps[5].collect()} == want


def test_run(spark, steps):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(steps[-1])


def test_odd_rows(spark):
    """NULLs, empty and repeated rows pass without a crash; empty tables stay empty."""
    long = "the of and to in " * 30_000
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "12", "en", None, 2), (None, "the of and", "en", "s", 10),
        (5, "the and of it", "en", "s", 1), (5, "the and of it", "en", "s", 1), (6, long, "en", "s", 9), (7, "le de la et", "fr", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF)
        assert stage(spark, docs.filter("false"), SF).count() == 0, name
        assert result.count() <= docs.count(), name


def test_decisions_hold_for_id_and_text(spark):
    """NULL ids, and different texts under one id, are judged each by its own text."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def run(stage, rows):
        docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], schema)
        return sorted(((r.doc_id, r.text) for r in stage(spark, docs, SF).collect()), key=repr)

    rows = [(None, "alone"), (None, "Copy"), (1, "copy"), (2, "other"), (2, "twice"), (3, "TWICE"), (4, None)]
    want = [(None, "alone"), (1, "copy"), (2, "other"), (3, "TWICE"), (4, None)]
    assert run(corpus_pipeline.drop_exact_copies, rows) == sorted(want, key=repr)
    words = [f"w{i}" for i in range(60)]
    one, near = " ".join(words), " ".join([*words, "end"])
    far, far_near = " ".join(words[::-1]), " ".join([*words[::-1], "end"])
    rows = [(None, far), (None, far_near), (None, near), (1, one), (2, near), (2, "quite another text of its own"), (5, one)]
    got = run(corpus_pipeline.drop_near_copies, rows)
    assert len(got) == 3 and {(1, one), (2, "quite another text of its own")} <= set(got)
    assert [r[1] in (far, far_near) for r in got if r[0] is None] == [True]
