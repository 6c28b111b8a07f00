import datetime as dt

from teesta.operators.timestamps import normalise_timestamps

REG = [("in", "Asia/Kolkata", "dmy"), ("us", "America/New_York", "mdy"), ("free", "UTC", None)]


def micros(*a):
    return int(dt.datetime(*a, tzinfo=dt.UTC).timestamp() * 1e6)


def run(spark, rows, context=None):
    reg = spark.createDataFrame(REG, "source_id string, time_zone string, date_order string")
    df = spark.createDataFrame([(i, s, v, "2024-03-05", "clash") for i, (s, v) in enumerate(rows)], "id bigint, src string, t string, near string, status string")
    return {r["id"]: (r["utc_micros"], r["status"]) for r in normalise_timestamps(df, reg, "id", "src", "t", context).collect()}


def test_formats(spark):
    cases = [
        ("in", "2024-03-05T10:00:00", micros(2024, 3, 5, 4, 30)), ("in", "20240305T100000Z", micros(2024, 3, 5, 10)), ("us", "2024-03-05 10:00:00", micros(2024, 3, 5, 15)),
        ("in", " 2024-03-05t10:00:00z ", micros(2024, 3, 5, 10)), ("in", "1709632800", micros(2024, 3, 5, 10)), ("in", "1709632800123", micros(2024, 3, 5, 10) + 123_000),
        ("in", "05-MAR-24 1530 hrs", micros(2024, 3, 5, 10)), ("in", "Tue, 05 Mar 2024 10:00:00 +0200", micros(2024, 3, 5, 8)), ("us", "March 5, 2024 10:00:00", micros(2024, 3, 5, 15)),
        ("in", "5 Mar 2024 10:00:00 IST", micros(2024, 3, 5, 4, 30)), ("in", "5 Mar 2024 10:00:00 CEST", micros(2024, 3, 5, 8)), ("in", "05/03/2024 3:30 PM", micros(2024, 3, 5, 10)), ("us", "03/05/2024 10:00", micros(2024, 3, 5, 15)),
        ("free", "2024/03/05 12:05 AM", micros(2024, 3, 5, 0, 5)), ("in", "२०२४-०३-०५ १०:००:००", micros(2024, 3, 5, 4, 30)), ("in", "2024-03-05 10:00:00,737", micros(2024, 3, 5, 4, 30) + 737_000),
        ("in", "2024-03-05T10:00:00.123456-05:00", micros(2024, 3, 5, 15) + 123_456), ("in", "2024-03-05", micros(2024, 3, 4, 18, 30)),
    ]
    got = run(spark, [(s, v) for s, v, _ in cases])
    assert [got[i][0] for i in range(len(cases))] == [w for _, _, w in cases]


def test_nothing_and_unknown(spark):
    got = run(spark, [("in", None), ("in", ""), ("in", "n/a"), ("in", "0000-00-00 00:00:00"), ("in", "2024-02-31 10:00:00"), ("lost", "2024-03-05 10:00:00"), (None, "2024-03-05T10:00:00Z"), ("us", "2024-11-03 01:30:00")])
    assert [got[i][1] for i in range(8)] == ["missing"] * 5 + ["no_zone", "ok", "repeated_hour"]
    assert got[5][0] is None and got[6][0] == micros(2024, 3, 5, 10)


def test_order_by_mixture(spark):
    # No declared order: the clear values of the source settle the unclear one; without them it stays ambiguous.
    assert run(spark, [("free", "04/03/2024 10:00"), *[("free", f"{d}/03/2024 10:00") for d in range(13, 29)]])[0] == (micros(2024, 3, 4, 10), "ok")
    assert run(spark, [("free", "04/03/2024 10:00")])[0][1] == "ambiguous_order"
    assert run(spark, [("free", "03/05/2024 10:00")] * 3, "near")[0] == (micros(2024, 3, 5, 10), "ok")


def test_empty(spark):
    assert run(spark, []) == {}


def test_zones_with_several_meanings(spark):
    """An abbreviation means what its source's zone says; where nothing speaks for another meaning, the first."""
    reg = spark.createDataFrame([("il", "Asia/Jerusalem", "dmy"), ("in", "Asia/Kolkata", "dmy"), ("ny", "America/New_York", "mdy")], "source_id string, time_zone string, date_order string")
    rows = [(f"{s}{i}", s, f"2023-01-{i:02d} 10:00:00 IST") for s in ("il", "in", "ny") for i in range(1, 20)] + [("y", "in", "05-Apr-21 1030 hrs"), ("z", "in", "2023-01-05 10:00:00 EST")]
    df = spark.createDataFrame(rows, "k string, s string, v string")
    got = {r["k"]: (r["utc_micros"], r["reading"], r["status"]) for r in normalise_timestamps(df, reg, "k", "s", "v").collect()}
    noon = 1672567200 * 1_000_000  # 2023-01-01 10:00 UTC
    assert got["il1"] == (noon - 2 * 3_600_000_000, "zone_120", "ok") and got["in1"] == (noon - 19_800_000_000, "zone_330", "ok") and got["ny1"][0] == noon - 19_800_000_000
    assert got["y"][1:] == ("day_first", "ok") and got["z"][2] == "ok"
