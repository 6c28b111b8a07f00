import math
import random

import pytest

from teesta.operators import spikes
from teesta.operators.spikes import FieldRule, flag_spikes, frozen_stretches, grouped_median, keyed, one_reading, source_tails, suspect_readings

COLS = "obs_id bigint, station string, reading_no bigint, observed_on string, rainfall_mm double, temperature_c double, relative_humidity_pct double, threshold string, _v int"


def rows(values, station="s"):
    return [(i, station, i, "2024-01-02", 0.0, v, 50.0 + i % 3, "clash", 1) for i, v in enumerate(values)]


def brute_frozen(values, least=8):
    out, i = set(), 0
    seen = [(n, v) for n, v in enumerate(values) if v is not None]
    while i < len(seen):
        j = i
        while j < len(seen) and seen[j][1] == seen[i][1]:
            j += 1
        if j - i >= least and seen[i][1] != 0:
            out |= {n for n, _ in seen[i:j]}
        i = j
    return out


@pytest.mark.parametrize("block", [4, 16, 1000])
def test_frozen_stretches_cross_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(spikes, "BLOCK", block)
    r = random.Random(3)
    values = [r.choice([1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0, None, 0.0]) for _ in range(400)] + [5.0] * 70 + [0.0] * 20
    df = one_reading(keyed(spark.createDataFrame(rows(values), COLS), "obs_id", "station", "reading_no", ["temperature_c"], None), ["temperature_c"])
    spans = frozen_stretches(df, ["temperature_c"], 8).collect()
    got = {n for s in spans for n in range(s["_from"], s["_to"] + 1) if values[n] is not None}
    assert got == brute_frozen(values)


@pytest.mark.parametrize("block", [64, 1000])
def test_flags_do_not_depend_on_blocks(spark, monkeypatch, block):
    """A hot source cut into many blocks gets the same medians, tails and flags as one held in a single block."""
    monkeypatch.setattr(spikes, "BLOCK", block)
    monkeypatch.setattr(spikes, "SUBBLOCK", 32)
    r = random.Random(9)
    values = [round(20 + r.gauss(0, 2), 1) for _ in range(600)]
    values[70:90] = [21.5] * 20
    values[300], values[301] = 48.0, -60.0
    got = {(x["obs_id"], x["impossible"], x["frozen"], x["stands_off"]) for x in flag_spikes(spark.createDataFrame(rows(values), COLS)).where("field_name = 'temperature_c' and (impossible or frozen or stands_off)").collect()}
    ordered = sorted(values)
    middle = (ordered[299] + ordered[300]) / 2
    away = sorted(abs(v - middle) for v in values)
    yard = (away[299] + away[300]) / 2
    frozen = brute_frozen(values)
    expected = {(i, not -10 <= v <= 55, i in frozen, abs(v - middle) > 6 * yard) for i, v in enumerate(values)}
    assert got == {e for e in expected if any(e[1:])}


def test_pareto_cutoff_decides_who_is_a_candidate(spark):
    """Without a cutoff nothing stands off; the cutoff is the tail's quantile at the risk asked for and lies below the rule's distance."""
    r = random.Random(5)
    values = [r.gauss(25, 2) for _ in range(4000)]
    df = spark.createDataFrame(rows(values), COLS)
    t = source_tails(df, fields={"temperature_c": FieldRule(-10.0, 55.0, 6.0)}, risk=1e-3).first()
    assert t["cutoff"] == t["pareto"] < 6 * t["yardstick"]
    # The absolute residual of a normal with deviation 2 is exceeded in one of a thousand cases at 6.58.
    assert math.isclose(t["pareto"], 6.58, rel_tol=0.2)
    flagged = flag_spikes(df, fields={"temperature_c": FieldRule(-10.0, 55.0, 6.0)}, risk=1e-3)
    assert 0 < flagged.where("extreme").count() < 20


def test_median_is_exact(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1.0, 2.0, 9.0)] + [("b", 3.0), ("b", None)], "k string, v double")
    assert {tuple(r) for r in grouped_median(df, ["k"], "v", "m").collect()} == {("a", 1.5), ("b", 3.0)}


def test_flags(spark):
    r = random.Random(1)
    values = [round(20 + r.random() * 4, 1) for _ in range(200)]
    values[50], values[60] = 99.0, 40.0
    data = rows(values) + [(1000, "s", 60, "2024-01-02", 0.0, 40.0, 50.0, None, None), (1001, None, 5, None, None, 80.0, None, None, None), (1002, "s", None, None, None, float("nan"), 101.0, None, None)]
    got = {(x["obs_id"], x["field_name"]) for x in suspect_readings(spark.createDataFrame(data, COLS)).collect()}
    assert {(50, "temperature_c"), (60, "temperature_c"), (1000, "temperature_c"), (1001, "temperature_c"), (1002, "relative_humidity_pct")} <= got
    assert all(f != "temperature_c" or i in (50, 60, 1000, 1001) for i, f in got)


def test_empty(spark):
    assert flag_spikes(spark.createDataFrame([], COLS)).count() == 0
    assert FieldRule(0, 1, 2).positive_only is False
