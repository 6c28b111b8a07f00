"""Panel queries. lineitem by the supplier's nation stands for a daily measure of a district, orders for events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teesta.operators import panel as P
from teesta.sources.tables import table


def _daily(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day"), "l_quantity")
    n = table(s, d, "supplier").select("s_suppkey", "s_nationkey")
    return l.join(n, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("nation"), "day").agg(F.sum("l_quantity").alias("v"))


def _weekly(s: SparkSession, d: str) -> DataFrame:
    return _daily(s, d).groupBy("nation", P.week_of(F.col("day")).alias("week")).agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("days"))


def _events(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", P.week_of(F.to_date("o_orderdate")).alias("week"))
    c = table(s, d, "customer").select("c_custkey", "c_nationkey")
    e = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation"), "week").agg(F.lit(1).alias("hit"))
    return P.spine(e, "nation", "week", "7 days").join(e, ["nation", "week"], "left").select("nation", "week", F.coalesce("hit", F.lit(0)).alias("event"))


def iso_week_rollup(s: SparkSession, d: str) -> DataFrame:
    """AGG-6."""
    return P.week_rollup(_daily(s, d), "nation", "day", "v", 100.0).select("nation", "week", "days", F.round("total", 2).alias("total"), "wet_days", F.round(F.element_at("values", 1), 2).alias("first_value"))


def complete_weeks_only(s: SparkSession, d: str) -> DataFrame:
    """AGG-6, AGG-34."""
    return _weekly(s, d).where("days = 7").select("nation", "week", F.round("v", 2).alias("v"))


def month_rollup_min_days(s: SparkSession, d: str) -> DataFrame:
    """AGG-7."""
    return P.month_rollup(_daily(s, d), "nation", "day", "v", 10).select("nation", "month", F.round("total", 2).alias("total"), "days")


def trailing_sums_contiguous(s: SparkSession, d: str) -> DataFrame:
    """WIN-1, WIN-2."""
    x = P.trailing(_weekly(s, d), "nation", "week", "v")
    return x.select("nation", "week", *[F.round(f"sum_{n}w", 2).alias(f"sum_{n}w") for n in (1, 2, 4, 8)])


def isoweek_anomaly_expanding(s: SparkSession, d: str) -> DataFrame:
    """WIN-3, WIN-4."""
    return P.expanding_anomaly(_weekly(s, d), "nation", "week", "v").select("nation", "week", F.round("anomaly", 4).alias("anomaly"))


def longest_dry_run(s: SparkSession, d: str) -> DataFrame:
    """WIN-5."""
    return P.longest_run(_daily(s, d), "nation", "day", F.col("v") < 100)


def history_windows(s: SparkSession, d: str) -> DataFrame:
    """WIN-6..8, JN-11."""
    x = P.history(_events(s, d), "nation", "week", "event")
    return x.select("nation", "week", "event", "events_4w", "events_52w", F.round("rate_logit", 6).alias("rate_logit"), "weeks_since")


def horizon_lead_target(s: SparkSession, d: str) -> DataFrame:
    """WIN-9, JN-9."""
    return P.lead_target(_events(s, d), "nation", "week", "event", 4)


def expanding_p75_threshold(s: SparkSession, d: str) -> DataFrame:
    """WIN-10, WIN-11."""
    m = _daily(s, d).groupBy("nation", F.trunc("day", "month").alias("month")).agg(F.sum("v").alias("v"))
    x = P.expanding_threshold(m, "nation", "month", "v")
    return x.select("nation", "month", F.round("threshold", 3).alias("threshold"), F.round("excess", 3).alias("excess"), F.round("excess_lag1", 3).alias("excess_lag1"))


def asof_vintage(s: SparkSession, d: str) -> DataFrame:
    """JN-10: what each unit's figure was known to be at one moment."""
    h = table(s, d, "hmis_row")
    return P.as_of(h, ["unit_id", "period_start"], "submitted_at", "row_id", "dengue_positive_records", F.lit("2022-06-30").cast("timestamp")).select("unit_id", "period_start", "dengue_positive_records")


def asof_join_vintage(s: SparkSession, d: str) -> DataFrame:
    """JN-10: the vintage known when each week of a point was received."""
    p = table(s, d, "weekly_climate").select("climate_row_id", "point_id", "received_at").where("received_at is not null")
    f = table(s, d, "recent_vintage").select("point_id", "retrieved_at", "vintage_id")
    return P.as_of_join(p, f.withColumn("v", F.col("vintage_id")), ["point_id"], "received_at", "retrieved_at", "vintage_id", "v").select("climate_row_id", F.col("v").alias("vintage_id"))


def latest_vintage(s: SparkSession, d: str) -> DataFrame:
    """WIN-15, STM-9."""
    from teesta.operators.relational import latest

    return latest(table(s, d, "recent_vintage").select("point_id", "vintage_id", "retrieved_at", "observed_days"), ["point_id"], ["retrieved_at", "vintage_id"]).select("point_id", "vintage_id", "observed_days")


def lag_rates_complete8(s: SparkSession, d: str) -> DataFrame:
    """WIN-13."""
    return P.lag_rates(_weekly(s, d), "nation", "week", "v").select("nation", "week", *[F.round(f"lag_mean_{n}w", 4).alias(f"lag_mean_{n}w") for n in (1, 4, 8)])


def statewide_lag_mean(s: SparkSession, d: str) -> DataFrame:
    """WIN-14."""
    return P.state_lag_mean(_weekly(s, d), "week", "v").select("week", F.round("state_mean", 4).alias("state_mean"))


def completeness_audit(s: SparkSession, d: str) -> DataFrame:
    """AGG-8."""
    x = _weekly(s, d).withColumn("share", F.col("days") / 7)
    return P.completeness(x, "nation", "week", "share", 52, 0.8).select("nation", "weeks", "first_week", "last_week", "all_complete", "contiguous", "eligible")


def recent_window_features(s: SparkSession, d: str) -> DataFrame:
    """AGG-33, STM-12."""
    x = P.window_features(_daily(s, d), "nation", "day", "v", F.lit("2000-06-30").cast("date"))
    return x.select("nation", *[F.round(f"sum_{n}d", 2).alias(f"sum_{n}d") for n in (7, 14, 28, 56)], *[F.round(f"coverage_{n}d", 4).alias(f"coverage_{n}d") for n in (7, 14, 28, 56)], "limiting_window")


def anchor_and_edge(s: SparkSession, d: str) -> DataFrame:
    """AGG-32, AGG-34."""
    return P.anchor_week(_weekly(s, d), "week", "days", 400).crossJoin(P.data_edge(_daily(s, d), table(s, d, "nation").select(F.col("n_nationkey").alias("nation")), "nation", "day"))  # two single rows


def week_label_distance(s: SparkSession, d: str) -> DataFrame:
    """P-AUDIT, STR-40: distance in weeks from a labelled ISO week to a date's, the shortest over the year's end."""
    o = table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    label = (F.col("o_orderkey") % 52 + 1).cast("int")
    gap = F.abs(label - F.weekofyear("day"))
    return o.select("o_orderkey", F.least(gap, 52 - gap).alias("distance"))


QUERIES = {f.__name__: f for f in (iso_week_rollup, complete_weeks_only, month_rollup_min_days, trailing_sums_contiguous, isoweek_anomaly_expanding, longest_dry_run, history_windows, horizon_lead_target, expanding_p75_threshold, asof_vintage, asof_join_vintage, latest_vintage, lag_rates_complete8, statewide_lag_mean, completeness_audit, recent_window_features, anchor_and_edge, week_label_distance)}

_D = "day_ AS (SELECT s_nationkey AS nation, l_shipdate::DATE AS day, sum(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"
_W = f"{_D}, week_ AS (SELECT nation, date_trunc('week', day)::DATE AS week, sum(v) AS v, count(*) AS days FROM day_ GROUP BY ALL)"
_E = """e0 AS (SELECT DISTINCT c_nationkey AS nation, date_trunc('week', o_orderdate)::DATE AS week FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'),
  ev AS (SELECT s.nation, s.week, CASE WHEN e0.week IS NULL THEN 0 ELSE 1 END AS event FROM (SELECT nation, unnest(generate_series(min(week), max(week), INTERVAL 7 DAY))::DATE AS week FROM e0 GROUP BY nation) s LEFT JOIN e0 ON e0.nation = s.nation AND e0.week = s.week)"""
ORACLE = {
    "iso_week_rollup": f"WITH {_D} SELECT nation, date_trunc('week', day)::DATE AS week, count(*) AS days, round(sum(v), 2) AS total, count(*) FILTER (v >= 100) AS wet_days, round(arg_min(v, day), 2) AS first_value FROM day_ GROUP BY 1, 2",
    "complete_weeks_only": f"WITH {_W} SELECT nation, week, round(v, 2) AS v FROM week_ WHERE days = 7",
    "month_rollup_min_days": f"WITH {_D} SELECT nation, date_trunc('month', day)::DATE AS month, round(sum(v), 2) AS total, count(*) AS days FROM day_ GROUP BY 1, 2 HAVING count(*) >= 10",
    "trailing_sums_contiguous": f"WITH {_W} SELECT nation, week, round(v, 2) AS sum_1w, " + ", ".join(f"CASE WHEN week - lag(week, {n - 1}) OVER w = {7 * (n - 1)} THEN round(sum(v) OVER (PARTITION BY nation ORDER BY week ROWS {n - 1} PRECEDING), 2) END AS sum_{n}w" for n in (2, 4, 8)) + " FROM week_ WINDOW w AS (PARTITION BY nation ORDER BY week)",
    "isoweek_anomaly_expanding": f"WITH {_W}, x AS (SELECT *, isoyear(week) AS y, week(week) AS k FROM week_) SELECT nation, week, round(CASE WHEN count(v) OVER w >= 3 THEN CASE WHEN stddev_pop(v) OVER w < 1e-6 THEN 0 ELSE (v - avg(v) OVER w) / stddev_pop(v) OVER w END END, 4) AS anomaly FROM x WINDOW w AS (PARTITION BY nation, k ORDER BY y RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "longest_dry_run": f"WITH {_D}, i AS (SELECT nation, v, sum(CASE WHEN v < 100 THEN 0 ELSE 1 END) OVER (PARTITION BY nation ORDER BY day) AS g FROM day_), r AS (SELECT nation, g, count(*) FILTER (v < 100) AS n FROM i GROUP BY 1, 2) SELECT nation, max(n) AS longest_run FROM r GROUP BY 1",
    "history_windows": f"""WITH {_E}, p AS (SELECT *, row_number() OVER w AS pos, count(event) OVER past AS n, sum(event) OVER past AS e, max(CASE WHEN event = 1 THEN pos_ END) OVER past AS last FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY week) AS pos_ FROM ev)
        WINDOW w AS (PARTITION BY nation ORDER BY week), past AS (PARTITION BY nation ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT nation, week, event, CAST(sum(event) OVER (PARTITION BY nation ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS BIGINT) AS events_4w, CAST(sum(event) OVER (PARTITION BY nation ORDER BY week ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) AS BIGINT) AS events_52w,
        CASE WHEN n > 0 THEN round(ln((e + 0.5) / (n - e + 0.5)), 6) END AS rate_logit, least(260, coalesce(pos - last, 260)) AS weeks_since FROM p""",
    "horizon_lead_target": f"WITH {_E} SELECT nation, week, event, target FROM (SELECT *, lead(event, 4) OVER (PARTITION BY nation ORDER BY week) AS target FROM ev) WHERE target IS NOT NULL",
    "expanding_p75_threshold": f"WITH {_D}, m AS (SELECT nation, date_trunc('month', day)::DATE AS month, sum(v) AS v FROM day_ GROUP BY 1, 2), t AS (SELECT *, CASE WHEN count(v) OVER w >= 24 THEN quantile_cont(v, 0.75) OVER w END AS th FROM m WINDOW w AS (PARTITION BY nation ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT nation, month, round(th, 3) AS threshold, round(v - th, 3) AS excess, round(lag(v - th) OVER (PARTITION BY nation ORDER BY month), 3) AS excess_lag1 FROM t WHERE th IS NOT NULL",
    "asof_vintage": "SELECT unit_id, period_start, dengue_positive_records FROM hmis_row WHERE submitted_at <= '2022-06-30' QUALIFY row_number() OVER (PARTITION BY unit_id, period_start ORDER BY submitted_at DESC, row_id DESC) = 1",
    "asof_join_vintage": "SELECT climate_row_id, arg_max(vintage_id, (retrieved_at, vintage_id)) AS vintage_id FROM weekly_climate w LEFT JOIN recent_vintage v ON v.point_id = w.point_id AND v.retrieved_at <= w.received_at WHERE w.received_at IS NOT NULL GROUP BY 1",
    "latest_vintage": "SELECT point_id, vintage_id, observed_days FROM recent_vintage QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY retrieved_at DESC, vintage_id DESC) = 1",
    "lag_rates_complete8": f"WITH {_W} SELECT nation, week, " + ", ".join(f"CASE WHEN week - lag(week, 8) OVER w = 56 THEN round(avg(v) OVER (PARTITION BY nation ORDER BY week ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 4) END AS lag_mean_{n}w" for n in (1, 4, 8)) + " FROM week_ WINDOW w AS (PARTITION BY nation ORDER BY week)",
    "statewide_lag_mean": f"WITH {_W}, s AS (SELECT week, sum(v) AS s, count(v) AS n FROM week_ GROUP BY 1) SELECT week, round(sum(s) OVER w / sum(n) OVER w, 4) AS state_mean FROM s WINDOW w AS (ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)",
    "completeness_audit": f"WITH {_W} SELECT nation, count(*) AS weeks, min(week) AS first_week, max(week) AS last_week, bool_and(days / 7.0 >= 0.8) AS all_complete, (max(week) - min(week)) / 7 + 1 = count(*) AS contiguous, (max(week) - min(week)) / 7 + 1 = count(*) AND bool_and(days / 7.0 >= 0.8) AND count(*) >= 52 AS eligible FROM week_ GROUP BY 1",
    "recent_window_features": f"WITH {_D}, a AS (SELECT nation, v, DATE '2000-06-30' - day AS age FROM day_), f AS (SELECT nation, " + ", ".join(f"sum(v) FILTER (age BETWEEN 0 AND {n - 1}) AS s{n}, count(v) FILTER (age BETWEEN 0 AND {n - 1}) / {n}.0 AS c{n}" for n in (7, 14, 28, 56)) + " FROM a GROUP BY 1) SELECT nation, " + ", ".join(f"round(s{n}, 2) AS sum_{n}d, round(c{n}, 4) AS coverage_{n}d" for n in (7, 14, 28, 56)) + ", CASE least(c7, c14, c28, c56) WHEN c56 THEN 56 WHEN c28 THEN 28 WHEN c14 THEN 14 ELSE 7 END AS limiting_window FROM f",
    "anchor_and_edge": f"WITH {_W} SELECT (SELECT max(week) FROM (SELECT week, min(days) AS least FROM week_ GROUP BY 1) WHERE least = 7 AND (SELECT max(week) FROM week_) - week <= 7 * 399) AS anchor_week, (SELECT CASE WHEN count(*) FILTER (m IS NULL) = 0 THEN min(m) END FROM (SELECT n_nationkey, (SELECT max(day) FROM day_ WHERE nation = n_nationkey) AS m FROM nation)) AS data_edge",
    "week_label_distance": "SELECT o_orderkey, least(g, 52 - g) AS distance FROM (SELECT o_orderkey, abs(o_orderkey % 52 + 1 - week(o_orderdate)) AS g FROM orders)",
}
