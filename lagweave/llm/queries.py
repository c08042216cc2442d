"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bitslices, media, mixing, quality, sentencepieces, simhash, tokens, toxicity, webarchives

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The weights of op2: web twice as much as books and code; German and French over Spanish; the large source held down.
MIX = mixing.Mix(weights={"domain": {"web": 2}, "lang": {"en": 6, "de": 2, "fr": 2}, "source": {"src0": 3, "src7": 2}}, hundredths=60, epochs=2, seed=17)


def op1_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives."""
    archives = webarchives.write_archives(table(spark, sf_dir, "pages"))
    return webarchives.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain, n_tokens, whole_epochs, part_tokens of the documents that the mix takes."""
    return mixing.mix_table(table(spark, sf_dir, "documents"), MIX)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32 of every document."""
    return sentencepieces.piece_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_BPE)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sizes, digests and feature of every document's image."""
    return media.media_table(table(spark, sf_dir, "documents"))


def op6_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 best of all rows for each row whose id is divisible by 20."""
    return bitslices.top_inner_products(table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    return tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from token files."""
    return tokens.read_token_files(tokens.write_token_files(table(spark, sf_dir, "documents"), BYTE_BPE))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, rejected of every document."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_web_archives": op1_web_archives,
    "op2_mixing": op2_mixing,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_media": op4_media,
    "op5_simhash": op5_simhash,
    "op6_bit_sliced_top_k": op6_bit_sliced_top_k,
    "op7_quality": op7_quality,
    "op10_toxicity": op10_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_token_files": op9_token_files,
}

ORACLE_SQL: dict[str, str] = {
    "op1_web_archives": """
        WITH p AS (SELECT page_id, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS payload_bytes, sha1(COALESCE(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 1000) END AS response FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id <> response THEN response END AS refers_to
        FROM m
    """,
    "op2_mixing": r"""
        WITH d AS (
            SELECT doc_id, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
                CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n, COALESCE(CAST(doc_id AS VARCHAR), '') AS name, md5(COALESCE(text, '')) AS m,
                COALESCE(['web', 'books', 'code'][TRY_CAST(regexp_extract(source, '([0-9]{1,9})$', 1) AS INTEGER) % 3 + 1], 'other') AS domain
            FROM documents
        ), leaves AS (
            SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens, CAST(2 * sum(n) AS BIGINT) AS capacity,
                CASE domain WHEN 'web' THEN 2 ELSE 1 END AS w1, CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w2,
                CASE source WHEN 'src0' THEN 3 WHEN 'src7' THEN 2 ELSE 1 END AS w3
            FROM d GROUP BY domain, lang, source
        ), total AS (SELECT CAST(sum(tokens) * 60 // 100 AS BIGINT) AS above FROM leaves),
        l1_a AS (SELECT *, above - COALESCE(sum(capacity) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
            sum(weight) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
            FROM (SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity, max(w1) AS weight FROM leaves GROUP BY ALL) n CROSS JOIN total WINDOW b AS (ORDER BY CAST(capacity AS DOUBLE) / weight, domain)),
        l1_b AS (SELECT *, CAST(capacity AS HUGEINT) * rest <= CAST(weight AS HUGEINT) * room AS is_full FROM l1_a),
        l1_c AS (SELECT *, max(CASE WHEN NOT is_full THEN rest END) OVER () AS o_rest,
            arg_max(room, rest) FILTER (WHERE NOT is_full) OVER () AS o_room FROM l1_b),
        l1 AS (SELECT domain, CAST(CASE WHEN is_full THEN capacity
            ELSE (CAST(o_rest - rest + weight AS HUGEINT) * o_room) // o_rest - (CAST(o_rest - rest AS HUGEINT) * o_room) // o_rest END AS BIGINT) AS budget FROM l1_c),
        l2_a AS (SELECT *, above - COALESCE(sum(capacity) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
            sum(weight) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
            FROM (SELECT n.*, p.budget AS above FROM (SELECT domain, lang, CAST(sum(capacity) AS BIGINT) AS capacity, max(w2) AS weight FROM leaves GROUP BY ALL) n JOIN l1 p USING (domain)) n WINDOW b AS (PARTITION BY domain ORDER BY CAST(capacity AS DOUBLE) / weight, lang)),
        l2_b AS (SELECT *, CAST(capacity AS HUGEINT) * rest <= CAST(weight AS HUGEINT) * room AS is_full FROM l2_a),
        l2_c AS (SELECT *, max(CASE WHEN NOT is_full THEN rest END) OVER (PARTITION BY domain ) AS o_rest,
            arg_max(room, rest) FILTER (WHERE NOT is_full) OVER (PARTITION BY domain ) AS o_room FROM l2_b),
        l2 AS (SELECT domain, lang, CAST(CASE WHEN is_full THEN capacity
            ELSE (CAST(o_rest - rest + weight AS HUGEINT) * o_room) // o_rest - (CAST(o_rest - rest AS HUGEINT) * o_room) // o_rest END AS BIGINT) AS budget FROM l2_c),
        l3_a AS (SELECT *, above - COALESCE(sum(capacity) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
            sum(weight) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
            FROM (SELECT n.*, p.budget AS above FROM (SELECT domain, lang, source, CAST(sum(capacity) AS BIGINT) AS capacity, max(w3) AS weight FROM leaves GROUP BY ALL) n JOIN l2 p USING (domain, lang)) n WINDOW b AS (PARTITION BY domain, lang ORDER BY CAST(capacity AS DOUBLE) / weight, source)),
        l3_b AS (SELECT *, CAST(capacity AS HUGEINT) * rest <= CAST(weight AS HUGEINT) * room AS is_full FROM l3_a),
        l3_c AS (SELECT *, max(CASE WHEN NOT is_full THEN rest END) OVER (PARTITION BY domain, lang ) AS o_rest,
            arg_max(room, rest) FILTER (WHERE NOT is_full) OVER (PARTITION BY domain, lang ) AS o_room FROM l3_b),
        l3 AS (SELECT domain, lang, source, CAST(CASE WHEN is_full THEN capacity
            ELSE (CAST(o_rest - rest + weight AS HUGEINT) * o_room) // o_rest - (CAST(o_rest - rest AS HUGEINT) * o_room) // o_rest END AS BIGINT) AS budget FROM l3_c),
        plan AS (SELECT l3.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS part FROM l3 JOIN leaves USING (domain, lang, source)),
        s AS (
            SELECT d.*, whole, part, COALESCE(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || whole || ':' || name || ':' || m), n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM d JOIN plan USING (domain, lang, source)
        )
        SELECT doc_id, domain, n AS n_tokens, CAST(whole AS BIGINT) AS whole_epochs, CAST(greatest(0, least(n, part - start)) AS BIGINT) AS part_tokens
        FROM s WHERE n > 0 AND (whole > 0 OR start < part)
    """,
    "op6_bit_sliced_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 20
    """,
}
