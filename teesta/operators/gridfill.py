"""Irregular readings onto a regular grid.

Harmonic seasonal regression with trend, fitted per series by distributed
normal equations, predicts the missing grid periods; the residuals at the two
observed neighbours of a gap are bridged linearly across it, so a filled
stretch meets the observations at either end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teesta.functions.harmonic import fit_normal_equations, harmonic_features, predict


def usable(value: Column) -> Column:
    """A finite number not below zero; null, NaN and infinities are not usable."""
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < F.lit(float("inf")))


def regular_grid(
    readings: DataFrame,
    keys: Sequence[str],
    period: str,
    value: str,
    order: Sequence[str],
    step_days: int = 1,
    season_days: float = 365.25,
    harmonics: int = 2,
    only_filled: bool = False,
) -> DataFrame:
    """One row for every `step_days` period between a series' first and last usable reading.

    `readings` has the series `keys`, a date column `period` (already on the
    grid), the number `value`, and the columns `order`: of several usable
    readings of one period the one greatest in `order` holds (all equal: the
    largest value). Other columns are ignored, whatever their names.
    Returns keys, period, value, `predicted`, and `grid_state` 'observed' or
    'filled'. Rows with null keys, null period or no usable value are no
    readings; a series without readings yields no rows; of an empty table an
    empty table comes out. Filled values are not below zero.

    Size: raw rows are aggregated to one per series and period before they are
    gathered by series, so however often a hot series was delivered its window
    holds at most one row per calendar period.
    """
    r = readings.select(*keys, F.col(period).cast("date").alias("_p"), F.col(value).cast("double").alias("_v"), F.struct(*[F.col(c) for c in order], F.col(value).cast("double").alias("_last")).alias("_o"))
    for k in keys:
        r = r.where(F.col(k).isNotNull())
    r = r.where(F.col("_p").isNotNull() & usable(F.col("_v")))
    one = r.groupBy(*keys, "_p").agg(F.max_by("_v", "_o").alias("_v")).withColumn("_t", F.datediff("_p", F.lit("2000-01-01").cast("date")).cast("double"))
    features = lambda t: harmonic_features(t, season_days, harmonics, 3652.5)
    fit = fit_normal_equations(one, keys, "_v", features(F.col("_t")))
    w = Window.partitionBy(*keys).orderBy("_p")
    seq = one.select(*keys, "_p", "_v", F.lead("_p").over(w).alias("_np"), F.lead("_v").over(w).alias("_nv"))
    step = F.expr(f"interval {int(step_days)} days")
    gaps = seq.where(F.datediff("_np", "_p") > step_days)
    b = fit.select(*keys, "beta")
    t_of = lambda c: F.datediff(c, F.lit("2000-01-01").cast("date")).cast("double")
    filled = (
        gaps.join(b, list(keys))
        .withColumn("_r0", F.col("_v") - predict(F.col("beta"), features(t_of(F.col("_p")))))
        .withColumn("_r1", F.col("_nv") - predict(F.col("beta"), features(t_of(F.col("_np")))))
        .withColumn("_day", F.explode(F.sequence(F.date_add("_p", step_days), F.date_sub("_np", 1), step)))
        .withColumn("predicted", predict(F.col("beta"), features(t_of(F.col("_day")))))
        .withColumn("_w", F.datediff("_day", "_p") / F.datediff("_np", "_p"))
        .select(
            *keys,
            F.col("_day").alias(period),
            F.greatest(F.lit(0.0), F.col("predicted") + F.col("_r0") * (1 - F.col("_w")) + F.col("_r1") * F.col("_w")).alias(value),
            "predicted",
            F.lit("filled").alias("grid_state"),
        )
    )
    if only_filled:
        return filled
    seen = seq.join(b, list(keys)).select(*keys, F.col("_p").alias(period), F.col("_v").alias(value), predict(F.col("beta"), features(t_of(F.col("_p")))).alias("predicted"), F.lit("observed").alias("grid_state"))
    return seen.unionByName(filled)


def daily_rain_readings(weekly_climate: DataFrame) -> DataFrame:
    """`daily_rain_mm` unfolded: element i belongs to `first_day + i`. Weeks without a first day or an array give nothing."""
    return (
        weekly_climate.select("point_id", F.col("first_day").cast("date").alias("first_day"), "received_at", "climate_row_id", F.posexplode("daily_rain_mm").alias("_i", "value"))
        .select("point_id", F.expr("date_add(first_day, _i)").alias("period_day"), "value", "received_at", F.col("climate_row_id").alias("row_order"))
    )


def fill_day_readings(recent_vintage: DataFrame) -> DataFrame:
    """`fill_days` under the Monday of the ISO week of `retrieved_at` in UTC."""
    day = F.date_from_unix_date(F.floor(F.unix_micros("retrieved_at") / F.lit(86_400_000_000)).cast("int"))
    return recent_vintage.select(
        "point_id",
        F.date_sub(day, F.weekday(day)).alias("period_day"),
        F.col("fill_days").cast("double").alias("value"),
        F.col("retrieved_at").alias("received_at"),
        F.col("vintage_id").alias("row_order"),
    )


def climate_grid(weekly_climate: DataFrame, recent_vintage: DataFrame, only_filled: bool = False) -> DataFrame:
    """Both series of every point on their grids: series_name, point_id, period_day, value, predicted, grid_state."""
    parts = []
    for name, readings, step in (("daily_rain_mm", daily_rain_readings(weekly_climate), 1), ("fill_days", fill_day_readings(recent_vintage), 7)):
        g = regular_grid(readings, ["point_id"], "period_day", "value", ["received_at", "row_order"], step, only_filled=only_filled)
        parts.append(g.select(F.lit(name).alias("series_name"), "*"))
    return parts[0].unionByName(parts[1])


def missing_periods(weekly_climate: DataFrame, recent_vintage: DataFrame) -> DataFrame:
    """series_name, point_id, period_day (yyyy-MM-dd) of each period the grid had to fill."""
    g = climate_grid(weekly_climate, recent_vintage, only_filled=True)
    return g.where(F.col("value").isNotNull()).select("series_name", "point_id", F.date_format("period_day", "yyyy-MM-dd").alias("period_day"))
