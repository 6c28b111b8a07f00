"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teesta.operators import stats as S
from teesta.plans.panels import _weekly
from teesta.sources.tables import table

LEVELS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _forecast(s: SparkSession, d: str) -> DataFrame:
    """orders with a stand-in forecast: a fixed function of the key, and whether the order is urgent."""
    o = table(s, d, "orders")
    return o.select("o_orderkey", F.to_date("o_orderdate").alias("day"), ((F.col("o_orderkey") * 37 % 101) / 101).alias("p"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))


def station_summary_upper_median(s: SparkSession, d: str) -> DataFrame:
    """AGG-9."""
    return S.upper_median(table(s, d, "station_observation"), ["district_id"], "temperature_c")


def ensemble_quantiles(s: SparkSession, d: str) -> DataFrame:
    """AGG-11, SRC-8."""
    l = table(s, d, "lineitem").select(F.year("l_shipdate").alias("year"), "l_suppkey", "l_quantity")
    x = S.ensemble_summary(l, ["year"], "l_suppkey", "l_quantity")
    return x.select("year", "ensemble_size", *[F.round(c, 6).alias(c) for c in ("mean", "p10", "p90")])


def quantile_grid_circular(s: SparkSession, d: str) -> DataFrame:
    """AGG-12."""
    w = _weekly(s, d).select("nation", F.weekofyear("week").alias("week_no"), "v")
    g = S.quantile_grid(w, "nation", "week_no", "v", LEVELS)
    return g.select("nation", "week_no", *[F.round(F.element_at("grid", i + 1), 3).alias(f"q{i}") for i in range(len(LEVELS))])


def percentile_from_grid(s: SparkSession, d: str) -> DataFrame:
    """AGG-12, ML-13: each week placed in its grid, with a band."""
    w = _weekly(s, d).select("nation", "week", F.weekofyear("week").alias("week_no"), "v")
    g = S.quantile_grid(w, "nation", "week_no", "v", LEVELS)
    x = w.join(g, ["nation", "week_no"])
    pct = S.percentile_from_grid(F.col("v"), F.col("grid"), LEVELS)
    return x.select("nation", "week", F.round(pct, 4).alias("percentile")).withColumn("band", F.when(F.col("percentile") >= 0.9, "high").when(F.col("percentile") >= 0.5, "raised").otherwise("low"))


def shrunken_climatology(s: SparkSession, d: str) -> DataFrame:
    """AGG-13, ML-1."""
    o = table(s, d, "orders").join(table(s, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    t = o.select(F.col("c_nationkey").alias("nation"), F.weekofyear("o_orderdate").alias("week_no"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))
    return S.shrunken_climatology(t, "nation", "week_no", "y").select("nation", "week_no", F.round("probability", 8).alias("probability"))


def month_rates_hierarchical(s: SparkSession, d: str) -> DataFrame:
    """AGG-14, AGG-24, ML-4."""
    o = table(s, d, "orders").select("o_orderstatus", F.month("o_orderdate").alias("month"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))
    return S.hierarchical_rates(o, "o_orderstatus", "month", "y").select("o_orderstatus", "month", F.round("rate", 8).alias("rate"))


def brier_log_skill(s: SparkSession, d: str) -> DataFrame:
    """AGG-15."""
    x = S.scores(_forecast(s, d), "p", "y")
    return x.select("n", *[F.round(c, 8).alias(c) for c in ("brier", "log_score", "base_rate", "brier_skill")])


def auc_ties(s: SparkSession, d: str) -> DataFrame:
    """AGG-16, WIN-16."""
    return S.auc(_forecast(s, d), "p", "y").select(F.round("auc", 8).alias("auc"))


def reliability_bins(s: SparkSession, d: str) -> DataFrame:
    """AGG-17."""
    return S.reliability_bins(_forecast(s, d), "p", "y", "o_orderkey").select("bin", "n", *[F.round(c, 8).alias(c) for c in ("low", "high", "mean_p", "rate")])


def expected_calibration_error(s: SparkSession, d: str) -> DataFrame:
    """AGG-18."""
    return S.calibration_error(S.reliability_bins(_forecast(s, d), "p", "y", "o_orderkey")).select(F.round("ece", 8).alias("ece"))


def fixed_bins(s: SparkSession, d: str) -> DataFrame:
    """AGG-19."""
    return S.fixed_bins(_forecast(s, d), "p", "y").select("bin", "n", F.round("mean_p", 8).alias("mean_p"), F.round("rate", 8).alias("rate"))


def pit_histogram(s: SparkSession, d: str) -> DataFrame:
    """AGG-20: the random number of a row is made from its key's digits, as SQL can."""
    u = F.pmod(F.col("o_orderkey") * 7919, F.lit(10_007)) / F.lit(10_007.0)
    return S.pit_histogram(_forecast(s, d), u, "p", "y").select("bin", "n", F.round("chi_squared", 6).alias("chi_squared"))


def bootstrap_blocks(s: SparkSession, d: str) -> DataFrame:
    """AGG-21: the score and its difference from a constant forecast, drawn together."""
    x = _forecast(s, d).withColumn("block", F.pmod("o_orderkey", F.lit(52))).withColumn("even", F.lit(0.5))
    return S.block_bootstrap(x, "block", "p", "y", "even")


def spearman_priority_burden(s: SparkSession, d: str) -> DataFrame:
    """AGG-22."""
    c = table(s, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("a"), F.round(F.avg("c_acctbal"), 2).alias("b"))
    return S.spearman(c, "a", "b").select(F.round("spearman", 8).alias("spearman"))


def priority_score(s: SparkSession, d: str) -> DataFrame:
    """AGG-23, WIN-17, ML-14, SRT-6."""
    c = table(s, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 2).alias("p")).withColumn("context", F.col("c_nationkey") / 25)
    return S.priority(c, "c_nationkey", "p", "context").select("c_nationkey", F.round("priority", 6).alias("priority"))


def class_breaks(s: SparkSession, d: str) -> DataFrame:
    """AGG-28."""
    return S.class_breaks(table(s, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("v")), "v")


def month_weights_blend(s: SparkSession, d: str) -> DataFrame:
    """AGG-39, AGG-40."""
    o = table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), 29).alias("b"))
    rates = table(s, d, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("r")).where("month <> 2")
    return S.blended(S.month_weights(o, "o_orderkey", "a", "b"), rates, "o_orderkey", "r", 0.5).select("o_orderkey", F.round("blend", 8).alias("blend"))


def standardised_columns(s: SparkSession, d: str) -> DataFrame:
    """AGG-36."""
    return S.standardised(table(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


def trailing_rate_360(s: SparkSession, d: str) -> DataFrame:
    """AGG-25: rate of the last 360 rows in time."""
    return _forecast(s, d).orderBy(F.desc("day"), F.desc("o_orderkey")).limit(360).agg(F.round(F.avg("y"), 8).alias("rate"))


QUERIES = {f.__name__: f for f in (station_summary_upper_median, ensemble_quantiles, quantile_grid_circular, percentile_from_grid, shrunken_climatology, month_rates_hierarchical, brier_log_skill, auc_ties, reliability_bins, expected_calibration_error, fixed_bins, pit_histogram, bootstrap_blocks, spearman_priority_burden, priority_score, class_breaks, month_weights_blend, standardised_columns, trailing_rate_360)}

_F = "f AS (SELECT o_orderkey, o_orderdate::DATE AS day, (o_orderkey * 37 % 101) / 101.0::DOUBLE AS p, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS y FROM orders)"
_BINS = f"{_F}, b AS (SELECT *, least((row_number() OVER (ORDER BY p, o_orderkey) - 1) // greatest(1, (SELECT count(*) FROM f) // 10), 9) AS bin FROM f)"
_WEEK = "week_ AS (SELECT nation, date_trunc('week', day)::DATE AS week, sum(v) AS v FROM (SELECT s_nationkey AS nation, l_shipdate::DATE AS day, sum(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) GROUP BY ALL)"
_GRID = f"{_WEEK}, x AS (SELECT nation, v, ((least(week(week), 52) - 1 + o + 52) % 52) + 1 AS week_no FROM week_, unnest([-3, -2, -1, 0, 1, 2, 3]) t(o)), g0 AS (SELECT nation, week_no, quantile_cont(v, {LEVELS}) AS q FROM x GROUP BY 1, 2), g AS (FROM g0 UNION ALL SELECT nation, 53, q FROM g0 WHERE week_no = 52)"
_PIT = "u AS (SELECT *, (o_orderkey * 7919) % 10007 / 10007.0::DOUBLE AS u FROM f)"
ORACLE = {
    "station_summary_upper_median": "SELECT district_id, count(temperature_c) AS n, max(temperature_c) AS largest, list_sort(list(temperature_c) FILTER (temperature_c IS NOT NULL))[count(temperature_c) // 2 + 1] AS median FROM station_observation WHERE district_id IS NOT NULL GROUP BY 1",
    "ensemble_quantiles": "SELECT year, count(*) AS ensemble_size, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.1), 6) AS p10, round(quantile_cont(m, 0.9), 6) AS p90 FROM (SELECT year(l_shipdate) AS year, l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "quantile_grid_circular": f"WITH {_GRID} SELECT nation, week_no, " + ", ".join(f"round(q[{i + 1}], 3) AS q{i}" for i in range(len(LEVELS))) + " FROM g",
    "percentile_from_grid": f"WITH {_GRID}, z AS (SELECT w.nation, w.week, round(CASE WHEN v <= q[1] THEN 0.0 WHEN v >= q[7] THEN 1.0 " + " ".join(f"WHEN v <= q[{i + 2}] THEN {LEVELS[i]} + (v - q[{i + 1}]) / (q[{i + 2}] - q[{i + 1}]) * {LEVELS[i + 1] - LEVELS[i]!r}" for i in range(6)) + " END, 4) AS percentile FROM week_ w JOIN g ON g.nation = w.nation AND g.week_no = week(w.week)) SELECT *, CASE WHEN percentile >= 0.9 THEN 'high' WHEN percentile >= 0.5 THEN 'raised' ELSE 'low' END AS band FROM z",
    "pit_histogram": f"WITH {_F}, {_PIT}, c AS (SELECT least(9, floor((CASE WHEN y = 1 THEN 1 - p + u * p ELSE u * (1 - p) END) * 10))::INT AS bin, count(*) AS n FROM u GROUP BY 1), e AS (SELECT b::INT AS bin, coalesce(n, 0) AS n FROM range(10) t(b) LEFT JOIN c ON c.bin = b) SELECT bin, n, round(sum(pow(n - m, 2) / m) OVER (), 6) AS chi_squared FROM (SELECT *, sum(n) OVER () / 10.0 AS m FROM e)",
    "shrunken_climatology": """WITH t AS (SELECT c_nationkey AS nation, week(o_orderdate) AS week_no, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS y FROM orders JOIN customer ON o_custkey = c_custkey), b AS (SELECT (sum(y) + 0.5) / (count(*) + 1) AS g FROM t),
      k AS (SELECT nation, (sum(y) + 5) / (count(*) * any_value(g) + 5) AS r FROM t, b GROUP BY 1), w AS (SELECT wk AS week_no, (sum(y) + 1) / (count(*) * any_value(g) + 1) AS m FROM (SELECT y, ((least(week_no, 52) - 1 + o + 52) % 52) + 1 AS wk FROM t, unnest([-3, -2, -1, 0, 1, 2, 3]) u(o)), b GROUP BY 1)
      SELECT nation, week_no, round(least(0.6, greatest(5e-5, g * r * m)), 8) AS probability FROM k, w, b""",
    "month_rates_hierarchical": """WITH t AS (SELECT o_orderstatus, month(o_orderdate) AS month, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS y FROM orders), g AS (SELECT avg(y) AS g FROM t), m AS (SELECT month, (sum(y) + 5 * any_value(g)) / (count(*) + 5) AS m FROM t, g GROUP BY 1)
      SELECT o_orderstatus, month, round((sum(y) + 5 * any_value(m)) / (count(*) + 5), 8) AS rate FROM t JOIN m USING (month) GROUP BY 1, 2""",
    "brier_log_skill": f"WITH {_F}, a AS (SELECT count(*) AS n, avg((p - y) ** 2) AS brier, avg(-CASE WHEN y = 1 THEN ln(greatest(1e-6, least(1 - 1e-6, p))) ELSE ln(1 - greatest(1e-6, least(1 - 1e-6, p))) END) AS log_score, avg(y) AS base_rate FROM f) SELECT n, round(brier, 8) AS brier, round(log_score, 8) AS log_score, round(base_rate, 8) AS base_rate, round(1 - brier / (base_rate * (1 - base_rate)), 8) AS brier_skill FROM a",
    "auc_ties": f"WITH {_F}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM f) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 8) AS auc FROM r",
    "reliability_bins": f"WITH {_BINS} SELECT bin, count(*) AS n, round(min(p), 8) AS low, round(max(p), 8) AS high, round(avg(p), 8) AS mean_p, round(avg(y), 8) AS rate FROM b GROUP BY 1",
    "expected_calibration_error": f"WITH {_BINS}, c AS (SELECT count(*) AS n, avg(p) AS m, avg(y) AS r FROM b GROUP BY bin) SELECT round(sum(n * abs(m - r)) / sum(n), 8) AS ece FROM c",
    "fixed_bins": f"WITH {_F}, x AS (SELECT least(4, floor(p * 5))::INT AS bin, count(*) AS n, avg(p) AS m, avg(y) AS r FROM f GROUP BY 1) SELECT i AS bin, coalesce(n, 0) AS n, round(coalesce(m, 0), 8) AS mean_p, round(coalesce(r, 0), 8) AS rate FROM range(5) t(i) LEFT JOIN x ON bin = i",
    "spearman_priority_burden": "WITH c AS (SELECT c_nationkey, count(*) AS a, round(avg(c_acctbal), 2) AS b FROM customer GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM c) SELECT round(corr(ra, rb), 8) AS spearman FROM r",
    "priority_score": "WITH c AS (SELECT c_nationkey, round(avg(c_acctbal), 2) AS p FROM customer GROUP BY 1) SELECT c_nationkey, round(100 * (0.8 * percent_rank() OVER (ORDER BY p) + 0.2 * c_nationkey / 25.0), 6) AS priority FROM c",
    "class_breaks": "WITH u AS (SELECT v, count(*) AS n FROM (SELECT count(*) AS v FROM customer GROUP BY c_nationkey) GROUP BY 1), x AS (SELECT *, (row_number() OVER (ORDER BY v) - 1) * least(5, count(*) OVER ()) // count(*) OVER () AS class_no FROM u) SELECT class_no, min(v) AS low, max(v) AS high, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY 1",
    "month_weights_blend": "WITH d AS (SELECT o_orderkey, month(unnest(generate_series(o_orderdate::DATE, o_orderdate::DATE + 29, INTERVAL 1 DAY))) AS m FROM orders), w AS (SELECT o_orderkey, m, count(*) / 30.0 AS weight FROM d GROUP BY 1, 2), r AS (SELECT month(o_orderdate) AS m, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS r FROM orders WHERE month(o_orderdate) <> 2 GROUP BY 1) SELECT o_orderkey, round(sum(weight * coalesce(r, 0.5)), 8) AS blend FROM w LEFT JOIN r USING (m) GROUP BY 1",
    "standardised_columns": "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM customer",
    "trailing_rate_360": f"WITH {_F} SELECT round(avg(y), 8) AS rate FROM (SELECT y FROM f ORDER BY day DESC, o_orderkey DESC LIMIT 360)",
}
