import hashlib
import json

import pytest
from pyspark.sql import functions as F

from teesta.sources import files as S


def test_csv_contract(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿b,a\n1,x\n,y\nq,z\n", encoding="utf-8")
    df = S.read_csv_exact(spark, str(tmp_path / "a.csv"), ["a", "b"])
    good, bad = S.typed(df, {"b": "int"}, "a")
    assert {tuple(r) for r in good.collect()} == {("x", 1), ("y", None), ("z", None)}
    assert [tuple(r) for r in bad.collect()] == [("z", "b", "q")]
    with pytest.raises(S.ContractError):
        S.read_csv_exact(spark, str(tmp_path / "a.csv"), ["a"])


def test_daily_parameters(spark, tmp_path):
    j = {"header": {"fill_value": -999.0}, "properties": {"parameter": {"T": {"20240101": 1.5, "20240102": -999.0}, "R": {"20240101": 0.0}}}, "parameters": {"T": {"units": "C"}}}
    (tmp_path / "d.json").write_text(json.dumps(j))
    d = S.read_daily_parameters(spark, str(tmp_path / "d.json"))
    assert {(r["parameter"], str(r["day"]), r["value"], r["is_fill_value"]) for r in d.collect()} == {("T", "2024-01-01", 1.5, False), ("T", "2024-01-02", None, True), ("R", "2024-01-01", 0.0, False)}
    assert not S.grid_completeness(d).first()["whole"]


def test_ensemble_features_feed(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"daily": {"rain": [1, 2], "rain_member01": [3, 4], "rain_member02": [5, None], "other": [1, 1]}}))
    assert {r["member"] for r in S.read_ensemble(spark, str(tmp_path / "e.json"), "rain", 2).collect()} == {0, 1}
    g = {"features": [{"properties": {"id": "a"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}, {"properties": {"id": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]], [[[2, 2], [3, 2], [3, 3]]]]}}]}
    (tmp_path / "g.json").write_text(json.dumps(g))
    assert sorted((r["id"], len(r["ring"])) for r in S.read_features(spark, str(tmp_path / "g.json"), ["id"]).collect()) == [("a", 3), ("b", 3), ("b", 3)]
    (tmp_path / "r.xml").write_text("<rss><channel><item><title>T</title><link>u</link></item><item><title>V</title></item></channel></rss>")
    assert {r["title"] for r in S.read_feed(spark, str(tmp_path / "r.xml")).collect()} == {"T", "V"}


def test_vintages_registry_and_scans(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.bin").write_bytes(b"%PDF-1")
    m = spark.createDataFrame([("a.bin", hashlib.sha256(b"%PDF-1").hexdigest()), ("b.bin", "00")], "object_name string, sha256 string")
    v = S.verified_vintages(spark, str(tmp_path / "v"), m)
    assert {(r["object_name"], r["digest_state"]) for r in v.collect()} == {("a.bin", "ok"), ("b.bin", "absent")}
    assert v.where("content is not null").select(S.sniffed(F.col("content"))).first()[0] == "pdf"
    (tmp_path / "s.json").write_text(json.dumps({"sources": [{"id": "a", "name": "A", "url": "u"}, {"id": "a", "name": "A", "url": "u"}, {"id": "b", "name": "", "url": "u"}]}))
    assert sorted(r["problem"] for r in S.read_registry(spark, str(tmp_path / "s.json")).collect()) == ["duplicate_id", "duplicate_id", "missing_field"]
    t = spark.createDataFrame([(1, "see OR/KHU/2023/12/345 and OR/GAN/2023/1/9"), (2, None)], "i int, t string")
    assert {r["district_code"] for r in S.scan_outbreak_ids(t, "i", "t").collect()} == {"KHU", "GAN"}
    w = spark.createDataFrame([(1, 2, 3)], "id int, `P one` int, Q int")
    al = spark.createDataFrame([("P one", "p"), ("Q", "q")], "alias string, place string")
    assert {tuple(r) for r in S.unpivot_months(w, ["id"], aliases=al).collect()} == {(1, "p", 2), (1, "q", 3)}
    assert str(spark.range(1).select(S.fiscal_month(F.lit("2023-24"), F.lit(2))).first()[0]) == "2024-02-01"
    man = S.write_with_manifest(t, str(tmp_path / "out"), "i").first()
    assert man["row_count"] == 2 and man["group_count"] == 2
    u, failed = S.collect_products({"x": t, "y": ValueError("down")})
    assert u.count() == 2 and failed == [("y", "down")]


def test_every_file_has_the_header(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b\n1,2\n")
    assert [tuple(r) for r in S.read_csv_exact(spark, str(tmp_path), ["b", "a"]).collect()] == [("2", "1")]
    (tmp_path / "two.csv").write_text("b,a\n9,8\n")
    with pytest.raises(Exception, match="(?i)header"):
        S.read_csv_exact(spark, str(tmp_path), ["a", "b"]).collect()


def test_repeated_rows_count_in_the_digest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    one = S.write_with_manifest(rows, str(tmp_path / "p"), "b").first()
    two = S.write_with_manifest(rows.unionByName(spark.createDataFrame([(3, "z"), (3, "z")], "a int, b string")), str(tmp_path / "q"), "b").first()
    assert one["digest"] != two["digest"] and two["row_count"] == 4
