"""Audits, summaries and smaller text steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teesta.operators import models as M
from teesta.operators import stats as S
from teesta.operators import text as T
from teesta.plans.texts import COLUMNS, _examples
from teesta.sources.tables import table

TERMS = ("dengue", "malaria", "test kits", "kits")


def catalogue_audit(s: SparkSession, d: str) -> DataFrame:
    """P-AUDIT: blanks, figures that can't be, ranges and sources of the health rows, in one aggregate a district."""
    h = table(s, d, "hmis_row")
    return h.groupBy("district_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.trim(F.coalesce("district_name", F.lit(""))) == "").alias("blank_names"), F.count_if(F.col("malaria_tests") < 0).alias("negative_tests"),
        F.min("period_start").alias("first_period"), F.max("period_start").alias("last_period"), F.count_distinct("unit_id").alias("units"),
    )


def vintage_summary(s: SparkSession, d: str) -> DataFrame:
    """AGG-41."""
    v = table(s, d, "recent_vintage")
    return v.groupBy("point_id").agg(F.count(F.lit(1)).alias("vintages"), F.sum("observed_days").alias("observed_days"), F.count_if(F.coalesce(F.col("fill_days") >= 0, F.lit(False))).alias("usable"), F.max("last_observed_day").alias("last_observed_day"))


def snapshot_conflicts(s: SparkSession, d: str) -> DataFrame:
    """STM-15: digests that stand under several sources, lengths or fixture flags."""
    x = table(s, d, "source_snapshot").where("content_sha256 is not null")
    return x.groupBy("content_sha256").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("sources"), F.count_distinct("byte_length").alias("lengths")).where("sources > 1 or lengths > 1")


def pending_documents(s: SparkSession, d: str) -> DataFrame:
    """FLT-14, FLT-11, FLT-12: successful PDF retrievals with a digest under a prefix."""
    x = table(s, d, "source_snapshot")
    return x.where((F.col("status_code") == 200) & (F.col("content_type") == "application/pdf") & F.col("content_sha256").isNotNull() & F.col("source_id").startswith("src_0")).select("snapshot_id", "content_sha256")


def transliteration(s: SparkSession, d: str) -> DataFrame:
    """STR-36."""
    return table(s, d, "documents").where("lang = 'or'").select("doc_id", T.transliterated(F.col("text")).alias("text_hi"))


def glossary_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """STR-16: terms protected, the rest changed, terms restored."""
    return table(s, d, "documents").select("doc_id", T.restored(F.upper(T.protected(F.col("text"), TERMS)), TERMS).alias("text"))


def collapsed_runs(s: SparkSession, d: str) -> DataFrame:
    """STR-18: a word said three times or more in a row, said once; texts are made to stammer first."""
    x = table(s, d, "documents").where("text is not null")
    return x.select("doc_id", T.collapsed_runs(F.concat(F.lit("very very very very "), "text", F.lit(" end end"))).alias("text"))


def capped_sentence_counts(s: SparkSession, d: str) -> DataFrame:
    """STR-15."""
    x = table(s, d, "documents").select("doc_id", T.capped_sentences(F.col("text")).alias("s"))
    return x.select("doc_id", F.size("s").alias("n"), F.array_max(F.transform("s", F.length)).alias("longest"))


def feature_block_ablation(s: SparkSession, d: str) -> DataFrame:
    """ML-10: the ridge with and without blocks of columns, on the same split."""
    x = _examples(s, d)
    train, test = x.where("target_week < '1999-01-01'"), x.where("week >= '1999-01-01'")
    out = None
    for name, columns in (("all", COLUMNS), ("counts", ("e4", "e52")), ("rate", ("rate_logit",))):
        m = M.fit_ridge_logistic(train, columns, "target")
        one = S.scores(test.withColumn("p", m.probability()), "p", "target").select(F.lit(name).alias("variant"), "n", F.round("brier", 5).alias("brier"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (catalogue_audit, vintage_summary, snapshot_conflicts, pending_documents, transliteration, glossary_roundtrip, collapsed_runs, capped_sentence_counts, feature_block_ablation)}

_OR, _HI = "".join(chr(0x0B00 + i) for i in T._PAIRED), "".join(chr(0x0900 + i) for i in T._PAIRED)
ORACLE = {
    "catalogue_audit": "SELECT district_id, count(*) AS n, count(*) FILTER (trim(coalesce(district_name, '')) = '') AS blank_names, count(*) FILTER (malaria_tests < 0) AS negative_tests, min(period_start) AS first_period, max(period_start) AS last_period, count(DISTINCT unit_id) AS units FROM hmis_row GROUP BY 1",
    "vintage_summary": "SELECT point_id, count(*) AS vintages, CAST(sum(observed_days) AS BIGINT) AS observed_days, count(*) FILTER (fill_days >= 0) AS usable, max(last_observed_day) AS last_observed_day FROM recent_vintage GROUP BY 1",
    "snapshot_conflicts": "SELECT content_sha256, count(*) AS n, count(DISTINCT source_id) AS sources, count(DISTINCT byte_length) AS lengths FROM source_snapshot WHERE content_sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source_id) > 1 OR count(DISTINCT byte_length) > 1",
    "pending_documents": "SELECT snapshot_id, content_sha256 FROM source_snapshot WHERE status_code = 200 AND content_type = 'application/pdf' AND content_sha256 IS NOT NULL AND source_id LIKE 'src\\_0%' ESCAPE '\\'",
    "transliteration": f"SELECT doc_id, translate(text, '{_OR}', '{_HI}') AS text_hi FROM documents WHERE lang = 'or'",
    "glossary_roundtrip": "SELECT doc_id, replace(replace(replace(replace(upper(replace(replace(replace(replace(text, 'test kits', chr(57346)), 'malaria', chr(57345)), 'dengue', chr(57344)), 'kits', chr(57347))), chr(57344), 'dengue'), chr(57345), 'malaria'), chr(57346), 'test kits'), chr(57347), 'kits') AS text FROM documents",
}
