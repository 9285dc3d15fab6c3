"""Clean training corpus: the stages in order, each over all that the one before kept.

Every stage takes and returns the columns of documents, but the last, which returns the
encoded documents. The copy stages decide on each id and text: a row with NULL doc_id
passes them by its text alone and counts as the last of all ids where near copies are
compared; different texts under one id are judged apart. Rows that repeat with id and
text pass a stage together. Empty tables pass all stages.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import ascii_lower, saved, table
from pageloom.llm.exact_dedup import exact_dedup
from pageloom.llm.language_id import fit_language, identify_language
from pageloom.llm.mixing import mix_documents
from pageloom.llm.near_dedup import near_dedup
from pageloom.llm.piece_codec import encode_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _only(docs: DataFrame, found: DataFrame, text: Column) -> DataFrame:
    """The documents with a kept row in ``found`` that has their id and ``text``'s digest."""
    rows = found.filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_text"))
    same = docs.doc_id.eqNullSafe(rows._kept_id) & (_digest(text) == rows._kept_text)
    return docs.join(rows, same, "left_semi")


def _numbered(docs: DataFrame) -> DataFrame:
    """A number for each id and text, in the order of the ids; NULLs come last."""
    rows = docs.select("doc_id", _digest(F.col("text")).alias("text_sha256")).distinct()
    rows = rows.orderBy(F.asc_nulls_last("doc_id"), "text_sha256")
    # Numbers grow with the sorted partitions; written once, they stay as they are.
    return saved(rows.withColumn("number", F.monotonically_increasing_id()), "numbered")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no known language, go."""
    model = fit_language(docs, F.lit(True))
    return identify_language(docs, model, keep=docs.columns).filter("accepted").select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return _only(docs, exact_dedup(docs), ascii_lower(docs.text))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words, similarity 0.8, the smallest id stays."""
    numbered = _numbered(docs)
    same = docs.doc_id.eqNullSafe(numbered.doc_id) & (_digest(docs.text) == numbered.text_sha256)
    texts = docs.join(numbered, same).select("number", "text")
    found = near_dedup(texts, id_col="number", words=5, num=80, den=100)
    return _only(docs, found.join(numbered, "number"), docs.text)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target shares of source, language and topic."""
    return mix_documents(docs).filter("kept").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, begins, ends, decoded and n_tokens of each document left."""
    return encode_pieces(docs, MODEL).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

# Language identification and signatures are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written and read again."""
    documents = table(spark, sf_dir, "documents")
    return reduce(lambda docs, s: saved(s[1](spark, docs, sf_dir), s[0]), STAGES, documents)
