"""Relational queries over the test tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teesta.operators import relational as R
from teesta.sources.tables import table

REFUSED = ["measles", "jaundice"]


def signal_counts_by_district_universe(s: SparkSession, d: str) -> DataFrame:
    """AGG-1, JN-8, FLT-2."""
    sig = table(s, d, "redacted_signal").alias("g").join(table(s, d, "source_snapshot").select("snapshot_id", "status_code"), F.col("source_snapshot_id") == F.col("snapshot_id"), "left")
    live = R.released(sig, "processing_state", "disease", "active_direct", REFUSED)
    facts = live.where(F.col("district_id").isNotNull()).groupBy("district_id").agg(F.count(F.lit(1)).alias("n"), F.min("retrieved_at").alias("first_at"), F.max("retrieved_at").alias("last_at"))
    return R.with_observation_state(table(s, d, "district_gazetteer").select("district_id", "canonical_name"), facts, "district_id", "n")


def list_signals_filtered(s: SparkSession, d: str) -> DataFrame:
    """FLT-1, JN-1, SRT-1: four left joins, optional predicates, newest 50."""
    g = table(s, d, "redacted_signal")
    x = R.filtered(g, equal={"assertion_class": "affirmed", "disease": None}, least={"retrieved_at": F.lit("2023-01-01").cast("timestamp")})
    snap = table(s, d, "source_snapshot").select("snapshot_id", "is_fixture")
    reg = table(s, d, "source_registry").select("source_id", "source_name")
    gaz = table(s, d, "district_gazetteer").select("district_id", "canonical_name")
    j = x.join(snap, x["source_snapshot_id"] == snap["snapshot_id"], "left").join(reg, "source_id", "left").join(gaz, "district_id", "left")
    return j.orderBy(F.desc("retrieved_at"), F.desc("signal_id")).limit(50).select("signal_id", "source_name", "canonical_name", "is_fixture")


def fixture_mode_null_semantics(s: SparkSession, d: str) -> DataFrame:
    """FLT-3, FLT-4, JN-2."""
    g = table(s, d, "redacted_signal").select("signal_id", "source_snapshot_id")
    snap = table(s, d, "source_snapshot").select("snapshot_id", F.when(F.col("status_code") == 200, F.col("is_fixture")).alias("is_fixture"))
    j = g.join(snap, g["source_snapshot_id"] == snap["snapshot_id"], "left")
    parts = [R.fixture_mode(j, "is_fixture", m).agg(F.lit(m).alias("mode"), F.count(F.lit(1)).alias("n")) for m in ("live_only", "fixture_only", "all")]
    parts.append(R.auto_fixture_mode(j, "is_fixture").agg(F.lit("auto").alias("mode"), F.count(F.lit(1)).alias("n")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def current_version_join(s: SparkSession, d: str) -> DataFrame:
    """JN-4, WIN-21: the current row of each unit and month, superseded ones dropped."""
    h = table(s, d, "hmis_row").select("unit_id", "period_start", "row_id", "submitted_at", "malaria_tests")
    current = R.latest(h, ["unit_id", "period_start"], ["submitted_at", "row_id"])
    return h.join(current.select("row_id"), "row_id").select("unit_id", "period_start", "row_id", "malaria_tests")


def contamination_having_distinct(s: SparkSession, d: str) -> DataFrame:
    """AGG-4, JN-5, TXT-4."""
    return R.contaminated(table(s, d, "redacted_signal"), "content_sha256", "source_id", "district_id").select("signal_id", "content_sha256")


def anti_join_unregistered(s: SparkSession, d: str) -> DataFrame:
    """JN-6/7."""
    reg = table(s, d, "source_registry").where("enabled")
    return R.unregistered(table(s, d, "source_snapshot"), reg, "source_id").select("snapshot_id", "source_id")


def upsert_do_nothing(s: SparkSession, d: str) -> DataFrame:
    """SNK-5."""
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return R.insert_new(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(-1.0)), "o_orderkey")


def upsert_latest(s: SparkSession, d: str) -> DataFrame:
    """SNK-5."""
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return R.upsert(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(-1.0)), ["o_orderkey"], ["o_custkey"])


def registry_seed(s: SparkSession, d: str) -> DataFrame:
    """SNK-7, FLT-13."""
    r = table(s, d, "source_registry")
    return R.seeded(r.where("source_id < 'src_30'"), r.where("source_id > 'src_10'"), "source_id")


def backlog_counts_densified(s: SparkSession, d: str) -> DataFrame:
    """AGG-2."""
    return R.densified_counts(table(s, d, "redacted_signal"), "processing_state", ["active_direct", "privacy_review_required", "ambiguous_entity_linkage", "withdrawn", "archived"])


def error_histogram(s: SparkSession, d: str) -> DataFrame:
    """AGG-3, AGG-27."""
    return R.histogram_of_codes(table(s, d, "redacted_signal"), "disease")


def latest_partition_map(s: SparkSession, d: str) -> DataFrame:
    """PRJ-3/4, PRJ-5: the latest period's metric by unit, thousandfold to three places, with its state."""
    h = R.latest_partition(table(s, d, "hmis_row"), "period_start")
    v = F.when(~F.isnan("malaria_test_positivity"), F.col("malaria_test_positivity"))
    return h.select("row_id", F.round(v * 1000, 3).alias("metric"), F.when(v.isNotNull(), "observed").otherwise("unknown").alias("observation_state"))


def source_state_case(s: SparkSession, d: str) -> DataFrame:
    """PRJ-2, STM-14: disabled, then error, then success, then uncontacted."""
    snap = table(s, d, "source_snapshot").groupBy("source_id").agg(F.count_if(F.col("status_code") >= 400).alias("errors"), F.count_if(F.col("status_code") == 200).alias("hits"))
    r = table(s, d, "source_registry").join(snap, "source_id", "left")
    return r.select("source_id", F.when(~F.col("enabled"), "disabled").when(F.col("errors") > F.col("hits"), "error").when(F.col("hits") > 0, "success").otherwise("uncontacted").alias("state"))


def contract_violations(s: SparkSession, d: str) -> DataFrame:
    """P-CONTRACT, P-CONTRACT-2, STM-16."""
    h = table(s, d, "hmis_row")
    p = F.col("malaria_test_positivity")
    return R.violations(h, "row_id", {
        "tests_below_zero": F.col("malaria_tests") >= 0, "positivity_out_of_range": p.between(0, 1) & ~F.isnan(p),
        "positives_above_tests": F.col("malaria_positive_records") <= F.col("malaria_tests"), "name_missing": F.trim(F.coalesce("district_name", F.lit(""))) != "",
        "period_not_month_start": F.substring("period_start", 9, 2) == "01",
    })


def contract_duplicates(s: SparkSession, d: str) -> DataFrame:
    return R.duplicate_identities(table(s, d, "hmis_row"), ["unit_id", "period_start"])


def sentinel_parse(s: SparkSession, d: str) -> DataFrame:
    """P-SENTINEL, PRJ: texts with sentinels to numbers."""
    raw = table(s, d, "station_observation").select("obs_id", F.when(F.col("rainfall_mm").isNull(), "NULL").when(F.col("rainfall_mm") > 300, "-999").otherwise(F.concat(F.lit(" "), F.format_number("rainfall_mm", 1))).alias("raw"))
    return raw.select("obs_id", R.sentinel_number(F.col("raw")).alias("value"))


def crosstab_with_totals(s: SparkSession, d: str) -> DataFrame:
    """AGG-26."""
    return R.crosstab_with_totals(table(s, d, "redacted_signal"), "district_id", "disease")


def coverage_summary(s: SparkSession, d: str) -> DataFrame:
    """AGG-29, AGG-30, AGG-31."""
    g = table(s, d, "redacted_signal")
    return g.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("district_id").alias("districts"), F.count_distinct("disease").alias("diseases"), F.bool_and("event_review_eligible").alias("all_eligible"), F.bool_or("event_review_eligible").alias("any_eligible"))


def retrieval_timeline(s: SparkSession, d: str) -> DataFrame:
    """WIN-18."""
    return R.timeline(table(s, d, "events"), F.to_date("ts"))


def topk_per_group(s: SparkSession, d: str) -> DataFrame:
    """WIN-20, STM-19."""
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return R.top_per_group(o, "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], 10)


def global_topk(s: SparkSession, d: str) -> DataFrame:
    """SRT-2, SRT-3, AGG-35."""
    return table(s, d, "orders").where("o_totalprice is not null").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


def url_owner_election(s: SparkSession, d: str) -> DataFrame:
    """WIN-19, TXT-5: one owner for each address."""
    x = table(s, d, "source_snapshot").where("final_url is not null").select("final_url", "snapshot_id", "created_at", "status_code")
    rank = F.when(F.col("status_code") == 200, 0).when(F.col("status_code") < 400, 1).otherwise(2)
    return R.owner(x, "final_url", rank, ["created_at", "snapshot_id"]).select("final_url", "snapshot_id")


def json_payload_expand(s: SparkSession, d: str) -> DataFrame:
    """SRT-9, PRJ-6: JSON payloads read by schema."""
    e = table(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return e


def content_keys(s: SparkSession, d: str) -> DataFrame:
    """STR-30..32: content keys and short ids."""
    g = table(s, d, "redacted_signal")
    k = R.content_key(["source_id", "district_id", "disease", "assertion_class", "content_sha256"])
    return g.select("signal_id", k.alias("content_key"), F.concat(F.lit("sig_"), F.substring(k, 1, 20)).alias("short_id"))


def event_positive_panel(s: SparkSession, d: str) -> DataFrame:
    """AGG-43, AGG-44: distinct positive (district, week) pairs, rows against distinct."""
    g = table(s, d, "redacted_signal").where(F.col("assertion_class") == "affirmed").select("district_id", F.to_date(F.date_trunc("week", "retrieved_at")).alias("week"), "disease")
    return g.groupBy("disease").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("district_id", "week").alias("cells"))


def wide_daily_series(s: SparkSession, d: str) -> DataFrame:
    """AGG-42: long to wide, gaps left as gaps."""
    o = table(s, d, "station_observation").where("district_id is not null").groupBy("district_id", "observed_on", "network").agg(F.round(F.max("temperature_c"), 3).alias("v"))
    return o.groupBy("district_id", "observed_on").pivot("network", ["AWS_ARG", "METAR"]).agg(F.max("v"))


def ext_set_operations(s: SparkSession, d: str) -> DataFrame:
    """SET-*: union, intersect and except of customer keys."""
    a, b = table(s, d, "orders").select(F.col("o_custkey").alias("k")), table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    parts = {"intersect": a.intersect(b), "except": b.exceptAll(a), "union": a.union(b).distinct()}
    out = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def ext_rollup_pricing(s: SparkSession, d: str) -> DataFrame:
    """EXT: rollup over the return flags."""
    l = table(s, d, "lineitem")
    return l.rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (signal_counts_by_district_universe, list_signals_filtered, fixture_mode_null_semantics, current_version_join, contamination_having_distinct, anti_join_unregistered, upsert_do_nothing, upsert_latest, registry_seed, backlog_counts_densified, error_histogram, latest_partition_map, source_state_case, contract_violations, contract_duplicates, sentinel_parse, crosstab_with_totals, coverage_summary, retrieval_timeline, topk_per_group, global_topk, url_owner_election, json_payload_expand, content_keys, event_positive_panel, wide_daily_series, ext_set_operations, ext_rollup_pricing)}

_MODE = "SELECT signal_id, is_fixture FROM redacted_signal LEFT JOIN (SELECT snapshot_id, CASE WHEN status_code = 200 THEN is_fixture END AS is_fixture FROM source_snapshot) ON source_snapshot_id = snapshot_id"
ORACLE = {
    "signal_counts_by_district_universe": """
      SELECT district_id, canonical_name, n, first_at, last_at, CASE WHEN n IS NULL THEN 'unknown' ELSE 'observed' END AS observation_state
      FROM district_gazetteer LEFT JOIN (
        SELECT district_id, count(*) AS n, min(retrieved_at) AS first_at, max(retrieved_at) AS last_at FROM redacted_signal
        WHERE processing_state = 'active_direct' AND coalesce(disease, '') NOT IN ('measles', 'jaundice') GROUP BY 1) USING (district_id)""",
    "list_signals_filtered": """
      SELECT signal_id, source_name, canonical_name, is_fixture FROM redacted_signal g LEFT JOIN source_snapshot ON source_snapshot_id = snapshot_id
      LEFT JOIN source_registry r ON g.source_id = r.source_id LEFT JOIN district_gazetteer z ON g.district_id = z.district_id
      WHERE assertion_class = 'affirmed' AND retrieved_at >= '2023-01-01' ORDER BY g.retrieved_at DESC, signal_id DESC LIMIT 50""".replace("AND retrieved_at", "AND g.retrieved_at"),
    "fixture_mode_null_semantics": f"""
      WITH j AS ({_MODE})
      SELECT 'live_only' AS mode, count(*) AS n FROM j WHERE NOT coalesce(is_fixture, false) UNION ALL SELECT 'fixture_only', count(*) FROM j WHERE is_fixture
      UNION ALL SELECT 'all', count(*) FROM j
      UNION ALL SELECT 'auto', count(*) FROM j WHERE NOT EXISTS (SELECT 1 FROM j WHERE NOT coalesce(is_fixture, false)) OR NOT coalesce(is_fixture, false)""",
    "current_version_join": "SELECT unit_id, period_start, row_id, malaria_tests FROM hmis_row QUALIFY row_number() OVER (PARTITION BY unit_id, period_start ORDER BY submitted_at DESC, row_id DESC) = 1",
    "contamination_having_distinct": "SELECT signal_id, content_sha256 FROM redacted_signal WHERE content_sha256 IN (SELECT content_sha256 FROM redacted_signal GROUP BY 1 HAVING count(DISTINCT source_id) > 1 AND count(DISTINCT district_id) > 1)",
    "anti_join_unregistered": "SELECT snapshot_id, source_id FROM source_snapshot s WHERE NOT EXISTS (SELECT 1 FROM source_registry r WHERE r.enabled AND r.source_id = s.source_id)",
    "upsert_do_nothing": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_custkey, -1.0 FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0",
    "upsert_latest": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0",
    "registry_seed": "SELECT source_id, CASE WHEN source_id <= 'src_10' THEN 'retired_not_in_current_registry' WHEN source_id >= 'src_30' THEN 'new' ELSE 'kept' END AS seed_state FROM source_registry",
    "backlog_counts_densified": "SELECT v AS processing_state, count(signal_id) AS n FROM unnest(['active_direct', 'privacy_review_required', 'ambiguous_entity_linkage', 'withdrawn', 'archived']) t(v) LEFT JOIN redacted_signal ON processing_state = v GROUP BY 1",
    "error_histogram": "SELECT coalesce(disease, 'unrecorded') AS disease, count(*) AS n FROM redacted_signal GROUP BY 1",
    "latest_partition_map": "SELECT row_id, round(v * 1000, 3) AS metric, CASE WHEN v IS NULL THEN 'unknown' ELSE 'observed' END AS observation_state FROM (SELECT row_id, CASE WHEN NOT isnan(malaria_test_positivity) THEN malaria_test_positivity END AS v FROM hmis_row WHERE period_start = (SELECT max(period_start) FROM hmis_row))",
    "source_state_case": "SELECT r.source_id, CASE WHEN NOT enabled THEN 'disabled' WHEN errors > hits THEN 'error' WHEN hits > 0 THEN 'success' ELSE 'uncontacted' END AS state FROM source_registry r LEFT JOIN (SELECT source_id, count(*) FILTER (status_code >= 400) AS errors, count(*) FILTER (status_code = 200) AS hits FROM source_snapshot GROUP BY 1) s ON r.source_id = s.source_id",
    "contract_violations": """
      SELECT row_id, 'tests_below_zero' AS rule FROM hmis_row WHERE malaria_tests < 0
      UNION ALL SELECT row_id, 'positivity_out_of_range' FROM hmis_row WHERE malaria_test_positivity NOT BETWEEN 0 AND 1 OR isnan(malaria_test_positivity)
      UNION ALL SELECT row_id, 'positives_above_tests' FROM hmis_row WHERE malaria_positive_records > malaria_tests
      UNION ALL SELECT row_id, 'name_missing' FROM hmis_row WHERE trim(coalesce(district_name, '')) = ''
      UNION ALL SELECT row_id, 'period_not_month_start' FROM hmis_row WHERE substr(period_start, 9, 2) <> '01'""",
    "contract_duplicates": "SELECT unit_id, period_start, count(*) AS n FROM hmis_row GROUP BY ALL HAVING count(*) > 1",
    "sentinel_parse": "SELECT obs_id, CASE WHEN rainfall_mm <= 300 THEN round(rainfall_mm, 1) END AS value FROM station_observation",
    "crosstab_with_totals": """
      WITH x AS (SELECT coalesce(district_id, 'UNRESOLVED') AS a, coalesce(disease, 'UNRESOLVED') AS b FROM redacted_signal)
      SELECT coalesce(a, 'ALL') AS district_id, coalesce(b, 'ALL') AS disease, count(*) AS n FROM x GROUP BY CUBE (a, b)""",
    "coverage_summary": "SELECT language, count(*) AS n, count(DISTINCT district_id) AS districts, count(DISTINCT disease) AS diseases, bool_and(event_review_eligible) AS all_eligible, bool_or(event_review_eligible) AS any_eligible FROM redacted_signal GROUP BY 1",
    "retrieval_timeline": "SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS cumulative FROM (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1)",
    "topk_per_group": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank_in_group FROM orders QUALIFY rank_in_group <= 10",
    "global_topk": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "url_owner_election": "SELECT final_url, snapshot_id FROM source_snapshot WHERE final_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY final_url ORDER BY CASE WHEN status_code = 200 THEN 0 WHEN status_code < 400 THEN 1 ELSE 2 END, created_at NULLS FIRST, snapshot_id) = 1",
    "json_payload_expand": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "content_keys": "SELECT signal_id, k AS content_key, 'sig_' || substr(k, 1, 20) AS short_id FROM (SELECT signal_id, sha256(concat(coalesce(source_id, ''), chr(31), coalesce(district_id, ''), chr(31), coalesce(disease, ''), chr(31), coalesce(assertion_class, ''), chr(31), coalesce(content_sha256, ''))) AS k FROM redacted_signal)",
    "event_positive_panel": "SELECT disease, count(*) AS n_rows, count(DISTINCT CASE WHEN district_id IS NOT NULL THEN district_id || '|' || date_trunc('week', retrieved_at)::DATE END) AS cells FROM redacted_signal WHERE assertion_class = 'affirmed' GROUP BY 1",
    "wide_daily_series": "SELECT district_id, observed_on, round(max(temperature_c) FILTER (network = 'AWS_ARG'), 3) AS AWS_ARG, round(max(temperature_c) FILTER (network = 'METAR'), 3) AS METAR FROM station_observation WHERE district_id IS NOT NULL GROUP BY ALL",
    "ext_set_operations": "SELECT 'intersect' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT ALL SELECT o_custkey FROM orders) UNION ALL SELECT 'union', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)",
    "ext_rollup_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
}
