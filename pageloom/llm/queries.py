"""The operators as queries over the given tables, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import table
from pageloom.llm.exact_dedup import exact_dedup
from pageloom.llm.fill_in_middle import fill_in_middle, restored
from pageloom.llm.katz import lm_scores
from pageloom.llm.language_id import language_id
from pageloom.llm.mixing import mix_documents
from pageloom.llm.near_dedup import near_dedup
from pageloom.llm.piece_codec import encode_pieces
from pageloom.llm.quality import quality
from pageloom.llm.quotation import as_quoting, link_quotes
from pageloom.llm.token_alignment import token_alignment
from pageloom.llm.token_counts import token_counts
from pageloom.llm.topk_search import top_k
from pageloom.llm.warc import read_archive, write_archive


MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(as_quoting(table(spark, sf_dir, "conversations")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"), folds=3, held_out=1)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write_archive(table(spark, sf_dir, "pages"), revisit_from=0)
    records = read_archive(archive, payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "tokens", "cell", "probability", "kept")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), words=4)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), MODEL)


def piece_digests(encoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(encode_pieces(table(spark, sf_dir, "documents"), MODEL, machine=True))


def op11_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), folds=7, held_out=2)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"), BYTE_MODEL, MODEL)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_topk_search": op3_topk_search,
    "op4_mixing": op4_mixing,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quotation_linking": op8_quotation_linking,
    "op9_language_id": op9_language_id,
    "op10_warc": op10_warc,
    "op11_katz_backoff": op11_katz_backoff,
    "op12_token_alignment": op12_token_alignment,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM n JOIN g USING (norm)
    """,
    "op3_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s
        )
        SELECT query_id, place::INT AS rank, vec_id, score FROM r WHERE place <= 5
    """,
    # Quotes of turns are derived as in as_quoting; an original is the first equal text.
    "op8_quotation_linking": """
        WITH RECURSIVE c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
        f AS (SELECT conv_id, text, min(turn) AS original FROM c GROUP BY conv_id, text),
        q AS (
            SELECT c.*, CASE WHEN c.turn % 4 = 3 THEN c.turn - 2 WHEN c.turn % 4 <> 0 THEN c.turn - 1 END AS quoted
            FROM c
        ),
        r AS (
            SELECT q.conv_id, q.turn, q.role, q.text, f.original IS NOT NULL AS by_quote,
                coalesce(f.original, b.turn) AS reply_to
            FROM q LEFT JOIN c o ON o.conv_id = q.conv_id AND o.turn = q.quoted
            LEFT JOIN f ON f.conv_id = q.conv_id AND f.text = o.text
            LEFT JOIN c b ON b.conv_id = q.conv_id AND b.turn = q.turn - 1
        ),
        t AS (
            SELECT conv_id, turn, turn AS thread, 0::BIGINT AS depth FROM r WHERE reply_to IS NULL
            UNION ALL
            SELECT r.conv_id, r.turn, t.thread, t.depth + 1 FROM r JOIN t
            ON r.conv_id = t.conv_id AND r.reply_to = t.turn
        )
        SELECT r.conv_id, r.turn, r.role, r.text, r.reply_to, r.by_quote, t.thread, t.depth,
            '<|' || coalesce(r.role, '') || '|>' || chr(10) || r.text AS formatted
        FROM r JOIN t ON r.conv_id = t.conv_id AND r.turn = t.turn
    """,
    # Base 32: five hex digits are 20 bits, which are four letters.
    "op10_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
        ),
        f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html)
        SELECT page_id,
            octet_length(encode(html))::BIGINT AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda g: substr(
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (1 + ((('0x' || substr(hex, 5 * (g // 4) + 1, 5))::BIGINT >> (5 * (3 - g % 4))) & 31))::INT,
                1)), '') AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM p JOIN f USING (html)
    """,
    # Prefix, middle and suffix are lists of tokens; DuckDB's slices count from 1.
    "op13_fill_in_middle": """
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex,
                regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens
            FROM documents
        ),
        h AS (
            SELECT *, len(tokens)::BIGINT AS n,
                list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(hex, i::INT, 8))::BIGINT) AS h FROM t
        ),
        c AS (
            SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                    OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM h
        ),
        p AS (
            SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle,
                array_to_string(tokens[b + 1:], '') AS suffix FROM c
        )
        SELECT doc_id, n, form,
            CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text
                WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM p
    """,
}
