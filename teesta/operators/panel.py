"""Panels of series by period: roll-ups, trailing and expanding windows, vintages.

Windows run over one row per series and period, so their size is bounded by the
calendar and not by how many raw rows a series has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def week_of(day: Column) -> Column:
    """Monday of the ISO week."""
    return F.date_sub(day, F.weekday(day))


def iso_year(day: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), day)


def spine(df: DataFrame, key: str, period: str, step: str) -> DataFrame:
    """key, period for each step between a series' first and last period."""
    b = df.groupBy(key).agg(F.min(period).alias("_a"), F.max(period).alias("_b"))
    return b.select(key, F.explode(F.sequence("_a", "_b", F.expr(f"interval {step}"))).alias(period)).withColumn(period, F.col(period).cast("date"))


def week_rollup(daily: DataFrame, key: str, day: str, value: str, wet: float = 1.0) -> DataFrame:
    """key, week, days, total, mean, wet_days and the values in day order. One row per key and day is expected; null values aren't days."""
    d = daily.where(F.col(value).isNotNull()).select(key, F.col(day).alias("_d"), F.col(value).alias("_v"))
    return d.groupBy(key, week_of(F.col("_d")).alias("week")).agg(
        F.count(F.lit(1)).alias("days"), F.sum("_v").alias("total"), F.avg("_v").alias("mean"), F.count_if(F.col("_v") >= wet).alias("wet_days"),
        F.transform(F.array_sort(F.collect_list(F.struct("_d", "_v"))), lambda x: x["_v"]).alias("values"),
    )


def month_rollup(daily: DataFrame, key: str, day: str, value: str, least_days: int = 28) -> DataFrame:
    """Months with values on at least `least_days` days."""
    d = daily.where(F.col(value).isNotNull())
    return d.groupBy(key, F.trunc(day, "month").alias("month")).agg(F.sum(value).alias("total"), F.count_distinct(day).alias("days")).where(F.col("days") >= least_days)


def trailing(panel: DataFrame, key: str, week: str, value: str, sizes: Sequence[int] = (1, 2, 4, 8)) -> DataFrame:
    """Trailing sums over the last n weeks; null unless the n rows are n successive weeks."""
    w = Window.partitionBy(key).orderBy(week)
    out = panel
    for n in sizes:
        whole = F.lit(True) if n == 1 else F.datediff(F.col(week), F.lag(week, n - 1).over(w)) == 7 * (n - 1)
        out = out.withColumn(f"sum_{n}w", F.when(whole, F.sum(value).over(w.rowsBetween(-(n - 1), 0))))
    return out


def expanding_anomaly(panel: DataFrame, key: str, week: str, value: str, least: int = 3, floor: float = 1e-6) -> DataFrame:
    """z of a week against the same ISO week of strictly earlier ISO years; null under `least` of them, 0 where they don't vary."""
    x = panel.withColumn("_y", iso_year(F.col(week)).cast("int")).withColumn("_w", F.weekofyear(week))
    w = Window.partitionBy(key, "_w").orderBy("_y").rangeBetween(Window.unboundedPreceding, -1)
    n, m, s = F.count(value).over(w), F.avg(value).over(w), F.stddev_pop(value).over(w)
    return x.withColumn("anomaly", F.when(n >= least, F.when(s < floor, 0.0).otherwise((F.col(value) - m) / s))).drop("_y", "_w")


def longest_run(daily: DataFrame, key: str, day: str, holds: Column) -> DataFrame:
    """Longest stretch of successive rows for which `holds`, per key, by islands."""
    w = Window.partitionBy(key).orderBy(day)
    x = daily.withColumn("_h", F.coalesce(holds, F.lit(False))).withColumn("_i", F.sum(F.when(~F.col("_h"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.where("_h").groupBy(key, "_i").agg(F.count(F.lit(1)).alias("_n"))
    return daily.select(key).distinct().join(runs.groupBy(key).agg(F.max("_n").alias("_m")), key, "left").select(key, F.coalesce("_m", F.lit(0)).alias("longest_run"))


def history(panel: DataFrame, key: str, week: str, event: str, lag: int = 1, cap: int = 260) -> DataFrame:
    """Event counts of the last 4 and 52 weeks, expanding logit of the rate and weeks since the last event, all ending `lag` weeks before.

    `panel` has one row for every week of a series; `event` is 0 or 1.
    """
    w = Window.partitionBy(key).orderBy(week)
    past = w.rowsBetween(Window.unboundedPreceding, -lag)
    x = panel.withColumn("_pos", F.row_number().over(w))
    n, e = F.count(event).over(past), F.sum(event).over(past)
    last = F.last(F.when(F.col(event) == 1, F.col("_pos")), ignorenulls=True).over(past)
    return x.select(
        *panel.columns,
        F.sum(event).over(w.rowsBetween(-lag - 3, -lag)).alias("events_4w"),
        F.sum(event).over(w.rowsBetween(-lag - 51, -lag)).alias("events_52w"),
        F.when(n > 0, F.log((e + 0.5) / (n - e + 0.5))).alias("rate_logit"),
        F.least(F.lit(cap), F.coalesce(F.col("_pos") - last, F.lit(cap))).alias("weeks_since"),
    )


def lead_target(panel: DataFrame, key: str, week: str, event: str, horizon: int) -> DataFrame:
    """The event `horizon` weeks on; rows without one are dropped."""
    return panel.withColumn("target", F.lead(event, horizon).over(Window.partitionBy(key).orderBy(week))).where(F.col("target").isNotNull())


def expanding_threshold(panel: DataFrame, key: str, month: str, value: str, share: float = 0.75, least: int = 24) -> DataFrame:
    """Exact quantile of the strictly earlier months, from `least` of them on; excess over it and its lags over threshold-bearing months."""
    w = Window.partitionBy(key).orderBy(month).rowsBetween(Window.unboundedPreceding, -1)
    x = panel.withColumn("threshold", F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(share)).over(w)))
    x = x.where(F.col("threshold").isNotNull()).withColumn("excess", F.col(value) - F.col("threshold"))
    v = Window.partitionBy(key).orderBy(month)
    return x.withColumns({f"excess_lag{i}": F.lag("excess", i).over(v) for i in (1, 2, 3)})


def as_of(facts: DataFrame, keys: Sequence[str], known: str, tie: str, value: str, moment: Column) -> DataFrame:
    """The value of each key as known at one moment: the latest `known` not after it; ties by the greatest `tie`."""
    return facts.where(F.col(known) <= moment).groupBy(*keys).agg(F.max_by(value, F.struct(known, tie)).alias(value), F.max(known).alias(known))


def as_of_join(probes: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, known: str, tie: str, value: str, block_days: float = 28.0) -> DataFrame:
    """Each probe with the value known at its time. Facts and probes are put in one order and the last fact is carried on: no pairing of every probe with every earlier fact.

    A fact known at the probe's very time counts. Probes without an earlier fact
    get null; null keys match nothing; repeated probes come out as often. Times
    are cut into blocks, so that a hot key is sorted by many tasks; what is known
    at a block's begin comes from one row per key and block.
    """
    f = facts.select(*keys, F.col(known).alias("_t"), F.lit(0).alias("_k"), F.struct(F.col(known), F.col(tie), F.col(value)).alias("_f"), F.lit(None).cast(probes.schema[at].dataType).alias(at)).where(F.col("_t").isNotNull())
    rest = [c for c in probes.columns if c not in (*keys, at)]
    p = probes.select(*keys, F.col(at).cast(f.schema["_t"].dataType).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(f.schema["_f"].dataType).alias("_f"), F.col(at), *rest)
    both = f.withColumns({c: F.lit(None).cast(probes.schema[c].dataType) for c in rest}).unionByName(p)
    both = both.withColumn("_b", F.floor(F.unix_micros(F.col("_t").cast("timestamp")) / F.lit(block_days * 86_400_000_000)))
    w = Window.partitionBy(*keys, "_b").orderBy("_t", "_k", F.col(f"_f.`{tie}`")).rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_got", F.last("_f", ignorenulls=True).over(w)).where("_k = 1")
    ends = both.groupBy(*keys, "_b").agg(F.max("_f").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_b", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    got = got.join(carried, [*keys, "_b"], "left").withColumn("_got", F.coalesce("_got", "_carry"))
    return got.select(*probes.columns, F.col(f"_got.`{value}`").alias(value), F.col(f"_got.`{known}`").alias(known))


def completeness(panel: DataFrame, key: str, week: str, share: str, least_weeks: int = 52, least_share: float = 0.8) -> DataFrame:
    """Per key: weeks, whether contiguous, whether every week's share suffices, eligible."""
    a = panel.groupBy(key).agg(F.count(F.lit(1)).alias("weeks"), F.min(week).alias("first_week"), F.max(week).alias("last_week"), F.bool_and(F.col(share) >= least_share).alias("all_complete"))
    x = a.withColumn("contiguous", F.datediff("last_week", "first_week") / 7 + 1 == F.col("weeks"))
    return x.withColumn("eligible", F.col("contiguous") & F.col("all_complete") & (F.col("weeks") >= least_weeks))


def lag_rates(panel: DataFrame, key: str, week: str, value: str, lags: int = 8) -> DataFrame:
    """Means of the last 1, 4 and 8 earlier weeks where all `lags` are there in succession."""
    w = Window.partitionBy(key).orderBy(week)
    whole = F.datediff(F.col(week), F.lag(week, lags).over(w)) == 7 * lags
    return panel.select(*panel.columns, *[F.when(whole, F.avg(value).over(w.rowsBetween(-n, -1))).alias(f"lag_mean_{n}w") for n in (1, 4, 8)])


def state_lag_mean(panel: DataFrame, week: str, value: str, weeks: int = 4) -> DataFrame:
    """week and the mean over all series of the `weeks` earlier weeks: aggregated by week first."""
    s = panel.groupBy(week).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    w = Window.orderBy(week).rowsBetween(-weeks, -1)  # one row per calendar week
    return s.select(week, (F.sum("_s").over(w) / F.sum("_n").over(w)).alias("state_mean"))


def window_features(daily: DataFrame, key: str, day: str, value: str, anchor: Column, sizes: Sequence[int] = (7, 14, 28, 56)) -> DataFrame:
    """Sums over the last n days to the anchor, their coverage, and the widest window of least coverage."""
    age = F.datediff(anchor, F.col(day))
    inside = lambda n: (age >= 0) & (age < n)
    aggs = [x for n in sizes for x in (F.sum(F.when(inside(n), F.col(value))).alias(f"sum_{n}d"), (F.count(F.when(inside(n), F.col(value))) / n).alias(f"coverage_{n}d"))]
    out = daily.groupBy(key).agg(*aggs)
    worst = F.array_min(F.array(*[F.struct(F.col(f"coverage_{n}d").alias("c"), F.lit(-n).alias("n")) for n in sizes]))
    return out.withColumn("limiting_window", -worst["n"])


def anchor_week(weekly: DataFrame, week: str, days: str, back: int = 8) -> DataFrame:
    """The latest week that is whole for every series that has it, not more than `back` weeks before the last."""
    w = weekly.groupBy(week).agg(F.min(days).alias("_least"))
    last = weekly.agg(F.max(week).alias("_last"))
    return w.crossJoin(F.broadcast(last)).where((F.col("_least") == 7) & (F.datediff("_last", F.col(week)) <= 7 * (back - 1))).agg(F.max(week).alias("anchor_week"))  # one row


def data_edge(daily: DataFrame, universe: DataFrame, key: str, day: str) -> DataFrame:
    """The least of the series' last days; null if any of the universe has none."""
    last = universe.select(key).join(daily.groupBy(key).agg(F.max(day).alias("_d")), key, "left")
    return last.agg(F.when(F.count_if(F.col("_d").isNull()) == 0, F.min("_d")).alias("data_edge"))
