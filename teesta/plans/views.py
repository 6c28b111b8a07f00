"""Views, filters, warning layers and answers over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from teesta.operators import cues as C
from teesta.operators import questions as Q
from teesta.operators import signals as S
from teesta.sources.tables import table

DIAGNOSED = "malaria_positive_records"


def signal_view(s: SparkSession, d: str) -> DataFrame:
    """PRJ-1, STR-33, NLQ-11."""
    return S.signal_view(table(s, d, "redacted_signal"), table(s, d, "source_snapshot"), table(s, d, "district_gazetteer"))


def candidate_alerts(s: SparkSession, d: str) -> DataFrame:
    """FLT-6: what an ambiguous entity state decided is left out."""
    g = table(s, d, "redacted_signal")
    return S.candidate_alerts(g, g.where("processing_state = 'ambiguous_entity_linkage'"), "signal_id").select("signal_id", "disease", "district_id")


def time_range(s: SparkSession, d: str) -> DataFrame:
    """FLT-5."""
    return S.within_times(table(s, d, "redacted_signal"), "retrieved_at", "2023-03-01T00:00:00+05:30", "2023-09-30T23:59:59Z").select("signal_id")


def _yearly(s: SparkSession, d: str) -> DataFrame:
    h = table(s, d, "hmis_row").withColumn("year", F.substring("period_start", 1, 4).try_cast("int"))
    return Q.yearly(h, "district_id", "year", DIAGNOSED)


def annual_totals(s: SparkSession, d: str) -> DataFrame:
    """AGG-5."""
    return _yearly(s, d)


def annual_trend(s: SparkSession, d: str) -> DataFrame:
    """NLQ-4."""
    return Q.annual_trend(_yearly(s, d), "district_id", "year", 2022, 2023)


def observation_answer(s: SparkSession, d: str) -> DataFrame:
    """NLQ-5, SRT-3."""
    names = ["OD-DIST-besubali", "OD-DIST-lapomura", "OD-DIST-nowhere"]
    return Q.observation_answer(_yearly(s, d), "district_id", names)


def layered_answer(s: SparkSession, d: str) -> DataFrame:
    """NLQ-6, JN-18: the last month's figure of a district, else its whole series', else the number of its warnings."""
    h = table(s, d, "hmis_row").where(F.col("district_id").isNotNull())
    last = h.where("period_start = '2024-12-01'").groupBy("district_id").agg(F.sum("dengue_positive_records").alias("v"))
    whole = h.groupBy("district_id").agg(F.avg("dengue_positive_records").alias("v"))
    warned = table(s, d, "district_warning").where("district_id is not null").groupBy("district_id").agg(F.count(F.lit(1)).alias("v"))
    x = Q.layered(table(s, d, "district_gazetteer"), "district_id", [("month", last, "v"), ("series", whole, "v"), ("warnings", warned, "v")])
    return x.select("district_id", F.round("value", 6).alias("value"), "layer")


def off_scope_places(s: SparkSession, d: str) -> DataFrame:
    """NLQ-8."""
    known = table(s, d, "district_gazetteer").select(F.explode(F.split("aliases", r"\|")).alias("name"))
    return Q.off_scope_places(table(s, d, "redacted_signal"), "signal_id", "evidence_text", known, "name")


def evidence_answer(s: SparkSession, d: str) -> DataFrame:
    """NLQ-9, SRT-8, STR-35, STR-39."""
    return Q.evidence_answer(table(s, d, "redacted_signal").where("language = 'en'"), "signal_id", "evidence_text", "retrieved_at", "malaria samples tested in the week", 200)


def warning_view(s: SparkSession, d: str) -> DataFrame:
    """STR-38, AGG-10, PRJ-7."""
    return S.decoded_warnings(table(s, d, "district_warning"), "warning_id", "outlook")


def warning_scope(s: SparkSession, d: str) -> DataFrame:
    """JN-16: warnings of districts another layer covers."""
    covered = table(s, d, "recent_vintage").where("fill_days = 0").select("district_id").distinct()
    return table(s, d, "district_warning").join(covered, "district_id", "left_semi").select("warning_id", "district_id")


def district_collapse(s: SparkSession, d: str) -> DataFrame:
    """JN-17: the latest of four products for every district any of them has."""
    products = {
        "issued": (table(s, d, "district_warning").select("district_id", F.col("issued_for_date").alias("o"), F.col("issued_for_date").alias("value")), "o"),
        "observed": (table(s, d, "station_observation").select("district_id", F.col("observed_on").alias("o"), F.col("observed_on").alias("value")), "o"),
        "last_day": (table(s, d, "recent_vintage").select("district_id", F.col("retrieved_at").alias("o"), F.col("last_observed_day").alias("value")), "o"),
        "fever": (table(s, d, "hmis_row").select("district_id", F.col("period_start").alias("o"), F.col(DIAGNOSED).cast("string").alias("value")), "o"),
    }
    return S.collapsed(products, "district_id")


def fresh_gauges(s: SparkSession, d: str) -> DataFrame:
    """FLT-9."""
    x = S.fresh_only(table(s, d, "station_observation"), "district_id", "observed_on", "rainfall_mm", "2023-06-15")
    return x.select(F.coalesce("district_id", F.lit("none")).alias("district_id"), "n", "stale", "largest")


def data_gate(s: SparkSession, d: str) -> DataFrame:
    """FLT-10, AGG-32."""
    edges = table(s, d, "weekly_climate").where("district_id is not null").groupBy("district_id").agg(F.max(F.when(F.col("day_count") == 7, F.col("week_start"))).alias("edge"))
    return S.data_gate(edges, "edge", "2024-01-15")


def link_rank(s: SparkSession, d: str) -> DataFrame:
    """FLT-7, FLT-8, STR-27, STR-28, SRT-5: addresses as links, labelled by the disease they were read for."""
    g = table(s, d, "redacted_signal").select(F.col("source_snapshot_id").alias("snapshot_id"), "disease").groupBy("snapshot_id").agg(F.min("disease").alias("label"))
    x = table(s, d, "source_snapshot").select("snapshot_id", "final_url", F.col("content_type").alias("context"), (F.col("content_type") == "application/pdf").alias("pdf")).join(g, "snapshot_id", "left")
    return S.ranked_links(x, "snapshot_id", "final_url", "label", "context", "pdf")


WEIGHTS = {"rain_mm": 0.8, "t2m_c": -0.5, "tmax_c": 0.3, "tmin_c": 0.6, "rh_pct": 1.1}
CENTRES = {"rain_mm": (30.0, 25.0), "t2m_c": (26.0, 4.0), "tmax_c": (31.0, 4.0), "tmin_c": (21.0, 4.0), "rh_pct": (70.0, 12.0)}


def driver_top4(s: SparkSession, d: str) -> DataFrame:
    """SRT-7, ML-13."""
    return S.top_drivers(table(s, d, "weekly_climate"), "climate_row_id", WEIGHTS, CENTRES)


def monthly_bundle(s: SparkSession, d: str) -> DataFrame:
    """JN-19, WIN-12: months of a district with their climate; lags advance over months without climate, whose rows are left out afterwards."""
    h = table(s, d, "hmis_row").where("district_id is not null and period_start is not null").groupBy("district_id", F.to_date("period_start").alias("month")).agg(F.sum("dengue_positive_records").alias("cases"))
    c = table(s, d, "weekly_climate").where("district_id is not null and day_count = 7").groupBy("district_id", F.trunc("week_start", "month").alias("month")).agg(F.round(F.avg("rh_pct"), 4).alias("humidity"))
    w = Window.partitionBy("district_id").orderBy("month")  # one row a month
    x = h.join(c, ["district_id", "month"], "left").select("*", F.lag("cases", 1).over(w).alias("lag1"), F.lag("cases", 2).over(w).alias("lag2"), F.lead("month").over(w).isNull().alias("last"))
    # The last row's own outcome is the first lag of what is served next.
    return x.where(F.col("humidity").isNotNull()).select("district_id", "month", "cases", "humidity", "lag1", "lag2", F.when(F.col("last"), F.col("cases")).alias("served_lag1"))


QUERIES = {
    f.__name__: f
    for f in (
        signal_view, candidate_alerts, time_range, annual_totals, annual_trend, observation_answer, layered_answer, off_scope_places, evidence_answer, warning_view, warning_scope, district_collapse,
        fresh_gauges, data_gate, link_rank, driver_top4, monthly_bundle,
    )
}

_YEARLY = f"y AS (SELECT district_id, substring(period_start, 1, 4)::INT AS year, CAST(sum({DIAGNOSED}) AS BIGINT) AS total FROM hmis_row WHERE {DIAGNOSED} IS NOT NULL AND district_id IS NOT NULL GROUP BY 1, 2)"
_IN = lambda c, xs: "(" + " OR ".join(f"contains({c}, '{x}')" for x in xs) + ")"

ORACLE = {
    "signal_view": """SELECT signal_id, initial(coalesce(disease, 'unspecified')) || ' in ' || coalesce(canonical_name, shown, 'an unresolved place') AS title, coalesce(canonical_name, shown) AS district,
        CASE WHEN processing_state <> 'active_direct' THEN 'held_' || processing_state WHEN assertion_class <> 'affirmed' THEN 'not_reviewable' WHEN event_review_eligible THEN 'awaiting_review' ELSE 'published' END AS review_state,
        CASE WHEN coalesce(is_fixture, false) THEN evidence_text ELSE '[live text not retained]' END AS shown_text
      FROM (SELECT *, upper(regexp_replace(g.district_id, '^[A-Z]+-DIST-', '')[1]) || substring(regexp_replace(g.district_id, '^[A-Z]+-DIST-', ''), 2) AS shown
            FROM redacted_signal g LEFT JOIN source_snapshot p ON p.snapshot_id = g.source_snapshot_id LEFT JOIN district_gazetteer z ON z.district_id = g.district_id)""".replace("initial(coalesce(disease, 'unspecified'))", "upper(coalesce(disease, 'unspecified')[1]) || substring(coalesce(disease, 'unspecified'), 2)"),
    "candidate_alerts": "SELECT signal_id, disease, district_id FROM redacted_signal WHERE assertion_class = 'affirmed' AND event_review_eligible AND processing_state <> 'ambiguous_entity_linkage'",
    "time_range": "SELECT signal_id FROM redacted_signal WHERE retrieved_at >= TIMESTAMPTZ '2023-02-28 18:30:00+00' AND retrieved_at <= TIMESTAMPTZ '2023-09-30 23:59:59+00'",
    "annual_totals": f"WITH {_YEARLY} FROM y",
    "annual_trend": f"""WITH {_YEARLY}, n AS (SELECT district_id, count(*) FILTER (year BETWEEN 2022 AND 2023) >= 2 AS ok FROM y GROUP BY 1), z AS (SELECT y.*, ok FROM y JOIN n USING (district_id) WHERE NOT ok OR year BETWEEN 2022 AND 2023)
      SELECT district_id, any_value(ok) AS in_window, min(year) AS first_year, max(year) AS last_year, arg_min(total, year) AS first_total, arg_max(total, year) AS last_total, arg_max(year, (total, -year)) AS peak_year,
        arg_min(year, (total, year)) AS lowest_year, arg_max(total, year) - arg_min(total, year) AS change FROM z GROUP BY 1""",
    "observation_answer": f"""WITH {_YEARLY}, p AS (SELECT district_id, CAST(sum(total) AS BIGINT) AS total FROM y GROUP BY 1)
      SELECT * FROM (SELECT 'ranking' AS answer, district_id, total FROM p ORDER BY total DESC, district_id LIMIT 5)
      UNION ALL SELECT 'statewide', 'ALL', CAST(sum(total) AS BIGINT) FROM p
      UNION ALL SELECT 'comparison', w, total FROM (VALUES ('OD-DIST-besubali'), ('OD-DIST-lapomura'), ('OD-DIST-nowhere')) t(w) LEFT JOIN p ON district_id = w""",
    "layered_answer": """WITH m AS (SELECT district_id, sum(dengue_positive_records)::DOUBLE AS v FROM hmis_row WHERE period_start = '2024-12-01' GROUP BY 1), a AS (SELECT district_id, avg(dengue_positive_records) AS v FROM hmis_row GROUP BY 1),
      w AS (SELECT district_id, count(*)::DOUBLE AS v FROM district_warning GROUP BY 1)
      SELECT g.district_id, round(coalesce(m.v, a.v, w.v), 6) AS value, CASE WHEN m.v IS NOT NULL THEN 'month' WHEN a.v IS NOT NULL THEN 'series' WHEN w.v IS NOT NULL THEN 'warnings' ELSE 'unavailable' END AS layer
      FROM district_gazetteer g LEFT JOIN m USING (district_id) LEFT JOIN a USING (district_id) LEFT JOIN w USING (district_id)""",
    "off_scope_places": r"""WITH x AS (SELECT signal_id, unnest(list_distinct(list_concat(regexp_extract_all(evidence_text, '\b(?:in|at|for|from|near|around|about|across)\s+([A-Z][A-Za-z]{2,})', 1), regexp_extract_all(evidence_text, '\b([A-Z][A-Za-z]{2,})\s+(?:[Dd]istrict)\b', 1)))) AS place FROM redacted_signal WHERE evidence_text IS NOT NULL),
      k AS (SELECT DISTINCT lower(unnest(string_split(aliases, '|'))) AS k FROM district_gazetteer)
      SELECT signal_id, place FROM x WHERE lower(place) NOT IN (SELECT k FROM k)""",
    "evidence_answer": r"""WITH n AS (SELECT signal_id, retrieved_at, evidence_text FROM redacted_signal WHERE language = 'en' AND evidence_text IS NOT NULL ORDER BY retrieved_at DESC, signal_id DESC LIMIT 200),
      z AS (SELECT *, round(len(list_intersect(['malaria', 'samples', 'tested', 'in', 'the', 'week'], list_distinct(regexp_extract_all(lower(evidence_text), '[\p{L}\p{M}\p{Nd}_]+')))) / 6.0, 6) AS score FROM n),
      p AS (SELECT *, row_number() OVER (ORDER BY score DESC, retrieved_at DESC, signal_id) AS position FROM z)
      SELECT CAST(position AS INT) AS position, signal_id, score, '[E' || position || '] ' || substring(translate(regexp_replace(evidence_text, '\p{Cc}', ' ', 'g'), '<>', '‹›'), 1, 400) AS record FROM p WHERE position <= 4""",
    "warning_view": f"""WITH m AS (SELECT MAP {{{", ".join(f"'{k}': '{v}'" for k, v in C.HAZARDS.items())}}} AS labels),
      x AS (SELECT warning_id, len(outlook) AS days, list_max(list_transform(outlook, lambda d: CASE d.severity WHEN 'watch' THEN 1 WHEN 'alert' THEN 2 WHEN 'warning' THEN 3 ELSE 0 END)) AS peak,
        flatten(list_transform(outlook, lambda d: regexp_extract_all(coalesce(d.codes, ''), '[0-9]+'))) AS codes FROM district_warning)
      SELECT warning_id, ['no_warning', 'watch', 'alert', 'warning'][coalesce(peak, 0) + 1] AS peak_severity,
        coalesce(array_to_string(list_transform(list_filter(codes, lambda c, i: list_position(codes, c) = i), lambda c: coalesce(labels[c], 'unmapped_code_' || c)), '; '), '') AS hazards, coalesce(days, 0) AS days FROM x, m""",
    "warning_scope": "SELECT warning_id, district_id FROM district_warning WHERE district_id IN (SELECT district_id FROM recent_vintage WHERE fill_days = 0)",
    "district_collapse": f"""WITH a AS (SELECT district_id, max(issued_for_date) AS issued FROM district_warning WHERE district_id IS NOT NULL GROUP BY 1), b AS (SELECT district_id, max(observed_on) AS observed FROM station_observation WHERE district_id IS NOT NULL GROUP BY 1),
      c AS (SELECT district_id, last_observed_day AS last_day FROM recent_vintage WHERE district_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY district_id ORDER BY retrieved_at DESC NULLS LAST, last_observed_day DESC NULLS LAST) = 1),
      h AS (SELECT district_id, {DIAGNOSED}::VARCHAR AS fever FROM hmis_row WHERE district_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY district_id ORDER BY period_start DESC NULLS LAST, {DIAGNOSED}::VARCHAR DESC NULLS LAST) = 1)
      SELECT district_id, issued, observed, last_day, fever FROM a FULL JOIN b USING (district_id) FULL JOIN c USING (district_id) FULL JOIN h USING (district_id)""",
    "fresh_gauges": "SELECT coalesce(district_id, 'none') AS district_id, count(*) FILTER (observed_on = '2023-06-15') AS n, count(*) FILTER (observed_on IS DISTINCT FROM '2023-06-15') AS stale, max(rainfall_mm) FILTER (observed_on = '2023-06-15' AND NOT isnan(rainfall_mm)) AS largest FROM station_observation GROUP BY district_id",
    "data_gate": """WITH e AS (SELECT district_id, max(week_start) FILTER (day_count = 7) AS edge FROM weekly_climate WHERE district_id IS NOT NULL GROUP BY 1)
      SELECT CASE WHEN count(*) = count(edge) THEN min(edge) END AS common_edge, coalesce(count(*) = count(edge) AND count(*) > 0 AND DATE '2024-01-15' - min(edge) <= 21, false) AS current FROM e""",
    "link_rank": f"""WITH g AS (SELECT source_snapshot_id AS snapshot_id, min(disease) AS label FROM redacted_signal GROUP BY 1),
      x AS (SELECT s.snapshot_id, final_url AS u, label, concat_ws(' ', lower(label), lower(content_type)) AS near, coalesce(content_type = 'application/pdf', false) AS p,
        list_filter(string_split(lower(regexp_extract(final_url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '/'), lambda q: q <> '') AS seg FROM source_snapshot s LEFT JOIN g USING (snapshot_id) WHERE final_url IS NOT NULL),
      f AS (SELECT *, {_IN("near", C.DISEASES)} AS d, {_IN("near", C.HEALTH_MARKERS)} AS h, len(seg) = 0 OR list_has_any(seg, [{", ".join(f"'{q}'" for q in C.NAVIGATION_SEGMENTS)}]) OR (len(seg) = 1 AND seg[1] IN ({", ".join(f"'{q}'" for q in C.SECTION_PATHS)})) OR (len(seg) >= 2 AND seg[-2] = 'page' AND regexp_matches(seg[-1], '^[0-9]+$')) AS nav FROM x),
      z AS (SELECT *, CAST(d AS INT) * 5 + CAST(h AS INT) * 3 + CAST({_IN("near", C.NOTICE_MARKERS)} AS INT) + CAST(p AS INT) - 4 * CAST({_IN("lower(u)", C.CHROME_MARKERS)} AS INT) - 10 * CAST(nav AS INT) - CAST(trim(coalesce(label, '')) = '' AS INT) AS link_score FROM f)
      SELECT CAST(row_number() OVER (ORDER BY d DESC, h DESC, p DESC, link_score DESC, u, snapshot_id) AS INT) AS position, snapshot_id, link_score FROM z WHERE NOT nav AND (d OR h OR p OR (link_score > 0 AND trim(coalesce(label, '')) <> '')) QUALIFY row_number() OVER (ORDER BY d DESC, h DESC, p DESC, link_score DESC, u, snapshot_id) <= 60""",
    "driver_top4": f"""WITH x AS (SELECT climate_row_id, unnest([{", ".join(f"{{'n': '{n}', 'c': round(({n} - {CENTRES[n][0]}::DOUBLE) / {CENTRES[n][1]}::DOUBLE * {w}::DOUBLE, 4)}}" for n, w in WEIGHTS.items())}], recursive := true) FROM weekly_climate),
      r AS (SELECT *, row_number() OVER (PARTITION BY climate_row_id ORDER BY abs(c) DESC, n) AS k FROM x WHERE c IS NOT NULL AND NOT isnan(c))
      SELECT w.climate_row_id, coalesce(string_agg(n || CASE WHEN c >= 0 THEN '+' ELSE '-' END, ',' ORDER BY k), '') AS drivers FROM weekly_climate w LEFT JOIN r ON r.climate_row_id = w.climate_row_id AND k <= 4 GROUP BY 1""",
    "monthly_bundle": """WITH h AS (SELECT district_id, period_start::DATE AS month, CAST(sum(dengue_positive_records) AS BIGINT) AS cases FROM hmis_row WHERE district_id IS NOT NULL AND period_start IS NOT NULL GROUP BY 1, 2),
      c AS (SELECT district_id, date_trunc('month', week_start)::DATE AS month, round(avg(rh_pct), 4) AS humidity FROM weekly_climate WHERE district_id IS NOT NULL AND day_count = 7 GROUP BY 1, 2),
      x AS (SELECT *, lag(cases, 1) OVER w AS lag1, lag(cases, 2) OVER w AS lag2, lead(month) OVER w IS NULL AS last FROM h LEFT JOIN c USING (district_id, month) WINDOW w AS (PARTITION BY district_id ORDER BY month))
      SELECT district_id, month, cases, humidity, lag1, lag2, CASE WHEN last THEN cases END AS served_lag1 FROM x WHERE humidity IS NOT NULL""",
}
