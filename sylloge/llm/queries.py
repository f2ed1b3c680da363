"""The corpus operators applied to whole tables with production parameters, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_documents
from .common import table
from .exact_dedup import exact_duplicates
from .license_digests import DIGESTS
from .licenses import license_scan, lines_sql, spelled_sql
from .mixing import schedule
from .neighbours import nearest_neighbours
from .pii import find_pii
from .secrets import find_secrets
from .simhash import near_duplicates
from .substrings import repeated_passages
from .toxicity import toxic_documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_licenses": op2_licenses,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_pii": op7_pii,
    "op8_secrets": op8_secrets,
    "op9_substrings": op9_substrings,
    "op10_neighbours": op10_neighbours,
}

_DIGESTS = ", ".join(f"('{d}', '{n}')" for d, n in sorted(DIGESTS.items()))

ORACLE_SQL = {
    "op2_licenses": rf"""
        WITH docs AS (
            SELECT doc_id, lines, string_split_regex(trim(array_to_string(lines, chr(10)), chr(10)), '\n\n+') AS paragraphs
            FROM (SELECT doc_id, {lines_sql("text")} AS lines FROM documents WHERE text IS NOT NULL)
        ), u AS (
            SELECT doc_id, 'document' AS unit, 0::BIGINT AS place, array_to_string(list_filter(lines, lambda l: l <> ''), ' ') AS body FROM docs
            UNION ALL
            SELECT doc_id, 'paragraph', unnest(range(len(paragraphs))), replace(unnest(paragraphs), chr(10), ' ') FROM docs WHERE len(paragraphs) > 1
            UNION ALL
            SELECT doc_id, 'line', unnest(range(len(lines))), unnest(lines) FROM docs WHERE len(lines) > 1
        )
        SELECT doc_id, unit, place, license
        FROM u JOIN (VALUES {_DIGESTS}) AS k(digest, license) ON sha256({spelled_sql("body")}) = digest
    """,
    "op5_mixing": r"""
        WITH t AS (
            SELECT source, doc_id, sum(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')))::BIGINT AS n_tokens
            FROM documents GROUP BY ALL HAVING sum(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+'))) > 0
        ), s AS (
            SELECT source, sum(n_tokens)::BIGINT AS n, ((sum(n_tokens)::BIGINT + 2047) // 2048)::BIGINT AS blocks FROM t GROUP BY source
        ), w AS (
            SELECT source, blocks, sum(pow(n::DOUBLE, 0.9)) OVER (ORDER BY source NULLS FIRST) AS cum,
                sum(pow(n::DOUBLE, 0.9)) OVER (ORDER BY source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low,
                row_number() OVER (ORDER BY source DESC NULLS LAST) = 1 AS final
            FROM s
        ), p AS (
            SELECT source, blocks, floor(coalesce(low, 0) / (SELECT max(cum) FROM w) * 4294967296)::BIGINT AS lo,
                CASE WHEN final THEN 4294967296 ELSE floor(cum / (SELECT max(cum) FROM w) * 4294967296)::BIGINT END AS hi
            FROM w
        ), z AS (
            SELECT max(((blocks + 4 + floor(log2(greatest(blocks, 2)))::BIGINT) * 4294967296 + (hi - lo) - 1) // (hi - lo))::BIGINT AS slots FROM p
        ), slots AS (
            SELECT i AS slot, (i * 2654435769) % 4294967296 AS point FROM (SELECT unnest(range((SELECT slots FROM z))) AS i)
        ), ranked AS (
            SELECT p.source, slot, blocks, row_number() OVER (PARTITION BY p.source ORDER BY slot) - 1 AS r
            FROM slots JOIN p ON point >= lo AND point < hi
        ), placed AS (
            SELECT source, doc_id, n_tokens, ((sum(n_tokens) OVER (
                PARTITION BY source
                ORDER BY md5('mix-1:' || coalesce(source, '') || ':' || coalesce(doc_id::VARCHAR, '')), doc_id) - n_tokens) // 2048)::BIGINT AS block
            FROM t
        )
        SELECT doc_id, placed.source, n_tokens, block, slot, (r // blocks)::BIGINT AS epoch
        FROM placed JOIN ranked ON placed.source IS NOT DISTINCT FROM ranked.source AND block = r % blocks
        WHERE slot <= (SELECT max(slot) FROM ranked WHERE r = blocks - 1)
    """,
    "op6_exact_dedup": """
        SELECT doc_id, kept_doc_id
        FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_doc_id FROM documents WHERE text IS NOT NULL)
        WHERE doc_id <> kept_doc_id
    """,
}
