"""Queries of this subpackage over a data folder, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from teesta.llm.langid import wrong_labels
from teesta.llm.leakage import find_leaks
from teesta.llm.packing import divided_documents, packing_audit, packing_report
from teesta.llm.pii import personal_items
from teesta.llm.scans import scanning_traces
from teesta.llm.spans import document_pairs, fuzzy_passages, shared_amounts


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return wrong_labels(_t(spark, d, "redacted_signal"), _t(spark, d, "lang_sample"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_items(_t(spark, d, "redacted_signal"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scanning_traces(_t(spark, d, "redacted_signal"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return divided_documents(_t(spark, d, "documents"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(_t(spark, d, "documents"))


def p8_capacities(spark: SparkSession, d: str) -> DataFrame:
    return packing_audit(_t(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_item"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return document_pairs(_t(spark, d, "documents"))


def p10_shared_amounts(spark: SparkSession, d: str) -> DataFrame:
    return shared_amounts(_t(spark, d, "documents"))


def p10_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Passages shared but for edits, between classes of equal texts."""
    return fuzzy_passages(_t(spark, d, "documents"))[1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p4_found, p7_found, p8_found, p8_report, p8_capacities, p9_found, p10_found, p10_shared_amounts, p10_fuzzy)}


def oracle_sql() -> dict[str, str]:
    return {
        "p10_found": """
            WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 300),
            w AS (SELECT doc_id, text, unnest(range(1, n - 298)) AS i FROM t),
            h AS (SELECT DISTINCT doc_id, md5_number(substring(text, i, 300)) AS h FROM w),
            s AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
            k AS (SELECT doc_id, h FROM h JOIN s USING (h))
            SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id""",
        "p8_found": "SELECT doc_id FROM documents WHERE strlen(text) + 1 > 8192",
        "p8_capacities": """
            WITH t AS (SELECT strlen(text) + 1 AS n FROM documents WHERE text IS NOT NULL)
            SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum((n + 8191) // 8192) AS BIGINT) AS pieces, count(*) FILTER (n > 8192) AS divided, true AS capacities_kept, true AS well_filled FROM t""",
        "p9_found": r"""
            WITH w AS (
              SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{M}\p{Nd}\s]', '', 'g'), '\s+'), lambda x: x <> '') AS ws FROM documents
              UNION ALL
              SELECT 'i', item_id, list_filter(string_split_regex(regexp_replace(lower(item_text), '[^\p{L}\p{M}\p{Nd}\s]', '', 'g'), '\s+'), lambda x: x <> '') FROM eval_item),
            r AS (SELECT side, id, array_to_string(ws[i : i + 11], ' ') AS run FROM (SELECT side, id, ws, unnest(range(1, len(ws) - 10)) AS i FROM w))
            SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM r d JOIN r i ON d.side = 'd' AND i.side = 'i' AND d.run = i.run""",
    }
