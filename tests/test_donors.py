import random

from teesta.operators.donors import cells_without_value, fill_health_cells, filled_health_rows, nearest_donors

COLS = "row_id bigint, month_no int, district_id string, district_name string, malaria_microscopy_tests int, malaria_microscopy_positive_records int, malaria_rdt_positive_records int, malaria_positive_records int, malaria_tests int, malaria_test_positivity double, dengue_positive_records int, childhood_diarrhoea_records int, _value string, beta string"


def row(i, **k):
    base = dict(row_id=i, month_no=i % 12 + 1, district_id="a", district_name="A", malaria_microscopy_tests=100 + i, malaria_microscopy_positive_records=3, malaria_rdt_positive_records=2, malaria_positive_records=5, malaria_tests=200 + 2 * i, malaria_test_positivity=0.02, dengue_positive_records=i % 7, childhood_diarrhoea_records=9, _value="x", beta="y") | k
    return tuple(base[c.split()[0]] for c in COLS.split(", "))


def test_cells(spark):
    data = [row(i) for i in range(40)] + [row(100, malaria_tests=None), row(101, malaria_tests=-1), row(102, malaria_tests=999999), row(103, malaria_tests=0), row(104, malaria_tests=0, malaria_positive_records=0), row(105, malaria_test_positivity=float("nan")), row(106, malaria_test_positivity=1.5), row(107, dengue_positive_records=9999), row(108, district_name=" "), row(109, district_name="unknown"), row(110, district_id="z", district_name=None), row(111, district_id=None, district_name=None)]
    df = spark.createDataFrame(data, COLS)
    got = {tuple(r) for r in cells_without_value(df).collect()}
    assert got == {(100, "malaria_tests"), (101, "malaria_tests"), (102, "malaria_tests"), (103, "malaria_tests"), (105, "malaria_test_positivity"), (106, "malaria_test_positivity"), (107, "dengue_positive_records"), (108, "district_name"), (109, "district_name"), (110, "district_name"), (111, "district_name")}
    filled = {(r["row_id"], r["field_name"]): r for r in fill_health_cells(df).collect()}
    assert filled[108, "district_name"]["filled_value"] == "A"
    assert filled[110, "district_name"]["donor_row_id"] is None
    donor = filled[100, "malaria_tests"]["donor_row_id"]
    wide = {r["row_id"]: r for r in filled_health_rows(df).collect()}
    assert len(wide) == len(data) and wide[100]["malaria_tests"] == wide[donor]["malaria_tests"] and wide[100]["filled"] == {"malaria_tests": donor} and wide[0]["filled"] == {}
    assert cells_without_value(df.limit(0)).count() == 0


def test_nearest_donor_is_found_across_buckets(spark):
    r = random.Random(5)
    cells = [("g", i, r.choice([1.0, 2.0, r.random() * 10]), None if r.random() < 0.3 else str(i)) for i in range(600)]
    df = spark.createDataFrame(cells, "k string, _id bigint, _pred double, _value string")
    for rows_a_bucket in (10_000, 20):
        for x in nearest_donors(df, ["k"], rows_a_bucket, 32).collect():
            best = min(abs(p - x["_pred"]) for _, i, p, v in cells if v is not None)
            assert abs(abs(cells[x["_donor"]][2] - x["_pred"]) - best) < 1e-12
