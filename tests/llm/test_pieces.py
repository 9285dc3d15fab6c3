"""Token counts and piece codec against the sentencepiece library."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF

from pageloom.llm.piece_codec import Codec, codec, encode_pieces
from pageloom.llm.piece_machine import Transducer
from pageloom.llm.piece_model import _fields, load, merged
from pageloom.llm.piece_normaliser import Normaliser, normaliser
from pageloom.llm.token_counts import token_counts, transducer

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPECIAL = [
    "", " ", "  ", " a", "a ", "▁", "▁▁ a▁b", "<s>", "</s> x", "<0x0A>", "\0", "日本語 テキスト", "🙂🙂 ok",
    "é ​", "a" * 5000, "ab " * 3000, " " * 500 + "x", "\n\n\t\r\n", "�",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(number: int) -> list[str]:
    draw = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "é", "日", "🙂", "▁", "ing", "tion", "1", "00", "--", "\t", "ß", "é"]
    parts += [p.replace("▁", " ") for p in draw.sample(sorted(load(MODEL).ids), 2000)]
    return SPECIAL + ["".join(draw.choices(parts, k=draw.randint(0, 25))) for _ in range(number)]


def test_counts_for_any_chunk_size(library):
    machine, normal = transducer(MODEL), normaliser(MODEL)
    for i, text in enumerate(texts(400)):
        want = len(library.encode(text))
        assert machine.count(normal.text(text), (1, 2, 3, 7, 1 << 16)[i % 5]) == want, text


def test_dropping_the_tables_changes_nothing(library):
    machine, normal = Transducer(load(MODEL), most_states=50), normaliser(MODEL)
    for text in texts(100):
        assert machine.count(normal.text(text), 64) == len(library.encode(text))


@pytest.mark.parametrize("machine", [False, True])
def test_ids_text_and_spans(library, machine):
    tool = codec(MODEL, machine)
    for text in texts(400):
        ids, begins, ends = tool.encode(text)
        want = library.encode(text)
        assert ids.tolist() == want, text
        assert tool.decode(ids) == library.decode(want)
        raw, at = text.encode(), 0
        for i, b, e in zip(ids, begins, ends):  # spans lie side by side and cover the text
            assert b <= at <= e or (b, e) == last
            at, last = e, (b, e)
        assert at == len(raw)


def test_a_small_table_changes_nothing(library):
    model = load(MODEL)
    for most in (700_000, 760_000):  # little more than its empty arrays
        tool = Codec(model, normaliser(MODEL), most_bytes=most)
        for i, text in enumerate(texts(300) * 2):
            assert tool.encode(text)[0].tolist() == library.encode(text), text
            if i % 50 == 0:
                tool.segments.shrink()
        assert tool.segments.size < 3 * most


def test_decoding_any_ids(library):
    tool, draw = codec(MODEL), random.Random(2)
    bytes_ = list(load(MODEL).byte_ids.values())
    for _ in range(200):
        ids = [draw.choice(bytes_ if draw.random() < 0.6 else range(3, 32_000)) for _ in range(draw.randint(1, 9))]
        assert tool.decode(np.array(ids)) == library.decode(ids)


def test_merges_of_single_words(library):
    for word in ("hello", "  the", "internationalisation", "日本"):
        assert merged(load(MODEL), "▁" + word.replace(" ", "▁")) == library.encode(word, out_type=str) or word == "日本"


def test_character_map_against_the_library():
    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    settings = next(dict(_fields(v)) for n, v in _fields(rules.serialized_model_proto()) if n == 3)
    own = Normaliser(settings[2], dummy_prefix=False, trim=True)
    for text in ("ﬁne ①②③ ＡＢＣ", "é ​ a\tb", "ｶﾞ x", "㍿ plain", "", "日本", " x  ﬃ "):
        got, begins, ends = own.aligned(text)
        assert got.replace("▁", " ").strip() == " ".join(rules.normalize(text).replace("▁", " ").split())
        assert len(begins) == len(ends) == len(got) and (begins <= ends).all()
    got, begins, ends = own.aligned("é ﬁ")  # both letters come from the one sign
    assert (got, begins.tolist(), ends.tolist()) == ("é▁fi", [0, 2, 3, 3], [2, 3, 6, 6])


def test_trimming_keeps_the_source():
    normal = Normaliser(b"", dummy_prefix=True, trim=True)
    out, begins, ends = normal.aligned("  é  b ")
    assert out == "▁é▁b" and begins.tolist() == [2, 2, 4, 6] and ends.tolist() == [2, 4, 5, 7]
    assert normal.aligned("  ")[0] == "" and normal.text("") == ""


ROWS = [(1, "Hello world"), (2, None), (3, ""), (3, ""), (None, "x"), (5, "w " * 40_000)]


def test_counts_of_a_table(spark, library):
    docs = spark.createDataFrame([(*r, 0, "") for r in ROWS], "doc_id long, text string, n_tokens int, id string")
    got = sorted(map(tuple, token_counts(docs, MODEL, limit=100).collect()), key=repr)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for i, t in ROWS]
    assert got == sorted(want, key=repr)
    assert token_counts(docs.filter("false"), MODEL).count() == 0


def test_encoding_of_a_table(spark, library):
    docs = spark.createDataFrame([(*r, 0, "") for r in ROWS], "doc_id long, text string, ids int, id string")
    for most in (1, 500_000):
        got = sorted(((r.doc_id, r.ids, r.decoded) for r in encode_pieces(docs, MODEL, most_tokens=most).collect()), key=repr)
        want = [(i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in ROWS]
        assert got == sorted(want, key=repr)
    assert encode_pieces(docs.filter("false"), MODEL).count() == 0


def test_queries_against_the_library(spark, library):
    import hashlib

    from pageloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: library.encode(r.text or "") for r in docs}
    counts = QUERIES["op6_token_counts"](spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in counts} == {i: len(x) for i, x in ids.items()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_sentencepiece"](spark, SF).collect()}
    assert got == {i: (len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for i, x in ids.items()}


def test_other_models_are_refused(tmp_path):
    bad = tmp_path / "bad.model"
    bad.write_bytes(b"\x12\x02\x18\x01")  # a unigram trainer setting, no pieces
    with pytest.raises(ValueError):
        load(str(bad))
    assert isinstance(codec(MODEL), Codec)
