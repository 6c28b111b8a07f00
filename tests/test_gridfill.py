import datetime as dt
import math

from pyspark.sql import functions as F

from teesta.operators.gridfill import daily_rain_readings, fill_day_readings, missing_periods, regular_grid, usable

SCHEMA = "k string, day date, v double, o int, _v string, beta string"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_gaps_are_filled_and_duplicates_settled(spark):
    rows = [("a", day(0), 1.0, 1, "x", "y"), ("a", day(0), 9.0, 2, "x", "y"), ("a", day(0), 9.0, 2, "x", "y"), ("a", day(3), 3.0, 1, None, None), ("a", day(5), -1.0, 1, None, None), ("a", None, 1.0, 1, None, None), (None, day(1), 1.0, 1, None, None), ("b", day(0), None, 1, None, None), ("c", day(0), float("nan"), 1, None, None), ("d", day(0), 2.0, 1, None, None)]
    g = regular_grid(spark.createDataFrame(rows, SCHEMA), ["k"], "day", "v", ["o"]).collect()
    got = {(r["k"], r["day"], r["grid_state"]) for r in g}
    assert got == {("a", day(0), "observed"), ("a", day(1), "filled"), ("a", day(2), "filled"), ("a", day(3), "observed"), ("d", day(0), "observed")}
    assert {r["v"] for r in g if (r["k"], r["day"]) == ("a", day(0))} == {9.0}
    assert all(r["v"] >= 0 for r in g)


def test_season_is_recovered(spark):
    value = lambda n: 20 + 5 * math.sin(2 * math.pi * (n + 8766) / 365.25)
    rows = [("a", day(n), value(n), 1, None, None) for n in range(900) if not 300 <= n < 330]
    g = regular_grid(spark.createDataFrame(rows, SCHEMA), ["k"], "day", "v", ["o"], only_filled=True).collect()
    assert len(g) == 30
    assert max(abs(r["v"] - value((r["day"] - day(0)).days)) for r in g) < 0.5


def test_empty_and_missing_periods(spark):
    w = spark.createDataFrame([(1, "p", day(0), [1.0, None, -1.0, 2.0], None), (2, "p", day(9), None, None), (3, "p", None, [1.0], None)], "climate_row_id bigint, point_id string, first_day date, daily_rain_mm array<double>, received_at timestamp")
    v = spark.createDataFrame([(1, "p", dt.datetime(2024, 1, 3, 12), 3), (2, "p", dt.datetime(2024, 1, 17, 12), 0), (3, "p", dt.datetime(2024, 1, 10, 12), -999)], "vintage_id bigint, point_id string, retrieved_at timestamp, fill_days int")
    got = {tuple(r) for r in missing_periods(w, v).collect()}
    assert got == {("daily_rain_mm", "p", "2024-01-02"), ("daily_rain_mm", "p", "2024-01-03"), ("fill_days", "p", "2024-01-08")}
    assert missing_periods(w.limit(0), v.limit(0)).count() == 0
    assert daily_rain_readings(w).where("point_id = 'p'").count() == 5
    assert fill_day_readings(v).select(F.min("period_day")).first()[0] == dt.date(2024, 1, 1)


def test_usable(spark):
    got = spark.sql("SELECT 1d v UNION ALL SELECT double('NaN') UNION ALL SELECT double('Infinity') UNION ALL SELECT -0.1d UNION ALL SELECT null").select(usable(F.col("v"))).collect()
    assert [bool(r[0]) for r in got] == [True, False, False, False, False]
