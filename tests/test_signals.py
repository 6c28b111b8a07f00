import pytest
from pyspark.sql import functions as F

from teesta.operators import questions as Q
from teesta.operators import signals as S
from teesta.operators import text as T

DISEASES, PLACES = [("malaria", "malaria"), ("dengue", "dengue")], [("d1", "Angul"), ("d1", "New Angul"), ("d2", "Puri")]


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(DISEASES, "group string, term string"), spark.createDataFrame(PLACES, "group string, term string")


def test_terms_stand_where_they_are_told_to(spark, terms):
    texts = spark.createDataFrame([(1, "Purity in\nNew   Angul; Angul"), (2, "Purist, Puri"), (3, None), (4, "")], "id int, t string")
    want = {(1, "d1", "New Angul", 11), (2, "d2", "Puri", 9)}
    assert {tuple(r) for r in T.match_terms(texts, "id", "t", terms[1], "group", "term").collect()} == want
    assert {tuple(r) for r in T.match_terms(texts, "id", "t", terms[1], "group", "term", most_terms=1).collect()} == want
    assert T.match_terms(texts.limit(0), "id", "t", terms[1], "group", "term").count() == 0
    assert T.match_terms(texts, "id", "t", terms[1].limit(0), "group", "term").count() == 0


def test_sentence_links(spark, terms):
    rows = [
        ("one", "Malaria in Puri. Dengue is rare", None), ("pub", "Malaria rose. No case of dengue in Puri", "d1"), ("both", "Malaria in Puri and Angul", None), ("among", "Malaria in Puri and Angul", "d2"),
        ("other", "Malaria in Puri", "d1"), ("none", "Nothing here", "d1"), ("null", None, "d1"), ("two", "Malaria and dengue spread", None),
    ]
    df = spark.createDataFrame(rows, "id string, t string, p string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    got = {tuple(r) for r in S.sentence_links(df, "id", "t", "at", "p", *terms).collect()}
    assert got == {
        ("one", "malaria", "d2", "affirmed", False), ("one", "dengue", None, "affirmed", True), ("pub", "malaria", "d1", "affirmed", False), ("pub", "dengue", "d2", "not_affirmed", False),
        ("both", "malaria", None, "affirmed", True), ("among", "malaria", "d2", "affirmed", False), ("other", "malaria", "d2", "affirmed", False), ("two", None, None, "affirmed", True),
    }


def test_process(spark, terms):
    rows = [("a", "The malaria cases in Puri are reported"), ("b", "Call +91 98765 43210 for malaria in Puri with the team"), ("c", "ମ୍ୟାଲେରିଆ ବଢୁଛି malaria in Puri"), ("n", None), ("e", "")]
    df = spark.createDataFrame(rows, "id string, t string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    got = {r["id"]: r for r in S.process(df, "id", "t", "at", *terms).collect()}
    assert (got["a"]["route"], got["a"]["coverage_state"], got["a"]["eligible"]) == ("en", "active_direct", True)
    assert got["b"]["redacted"] == "Call [REDACTED] for malaria in Puri with the team" and got["b"]["coverage_state"] == "privacy_review_required" and not got["b"]["eligible"]
    assert got["c"]["route"] == "mixed" and got["n"]["route"] == "und" and got["n"]["warnings"] == "no_disease,no_district" and got["e"]["route"] == "und"


def test_routes_by_votes(spark):
    odia = "ଓଡ଼ିଶା ସରକାର"
    texts = {f"{odia}\nThe department reported cases in the district\nand the health of all": "en", f"{odia}\n{odia} ଜିଲ୍ଲା\nok": "or", "स्वास्थ्य विभाग ने कहा": "hi", "dal pahuncha gaon": "und", f"{odia} abcdefgh": "mixed", "12": "und"}
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    assert {r["t"]: r["r"] for r in df.select("t", T.language_route(F.col("t")).alias("r")).collect()} == texts


def test_review_scores(spark):
    rows = [("a", "Same  text", "malaria", "d1", 0, "en"), ("b", "same text", "malaria", "d1", 24, "en"), ("c", "same text", "malaria", "d2", 24, "en"), ("d", "x", "malaria", "d1", 30, "hi"), ("e", None, None, None, 5, None), ("f", "same text", "malaria", "d1", 400, "or")]
    df = spark.createDataFrame(rows, "id string, t string, dis string, dst string, h int, lang string").withColumn("at", F.timestamp_seconds(F.col("h") * 3600))
    got = {(r["id"], r["id_b"]): (r["score"], r["cross_language"]) for r in S.copy_candidates(df, "id", "t", "dis", "dst", "at", "lang").collect()}
    assert got == {("b", "a"): (round(0.7 * (0.8 + 0.2 * 0.75) + 0.3, 4), False), ("f", "a"): (0.8, True)}
    far = {(r["id"], r["id_b"], r["score"]) for r in S.cross_language_candidates(df, "id", "dis", "dst", "at", "lang").collect()}
    assert far == {("d", "b", round(0.8 + 0.2 * (1 - 6 / 96), 4)), ("f", "b", 0.8), ("f", "d", 0.8)}


def test_times_need_an_offset(spark):
    df = spark.range(3).select(F.timestamp_seconds(F.col("id") * 3600).alias("t"))
    assert S.within_times(df, "t", "1970-01-01T01:00:00Z", "1970-01-01T07:30:00+05:30").count() == 2
    for start, end in (("2024-01-01T00:00:00", None), ("2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z")):
        with pytest.raises(ValueError):
            S.within_times(df, "t", start, end)


def test_answers_over_years(spark):
    t = Q.yearly(spark.createDataFrame([("a", 2020, 1), ("a", 2021, None), ("a", 2022, 5), ("a", 2023, 3), ("b", 2020, 2), (None, 2020, 9)], "k string, y int, v int"), "k", "y", "v")
    assert {tuple(r) for r in t.collect()} == {("a", 2020, 1), ("a", 2022, 5), ("a", 2023, 3), ("b", 2020, 2)}
    got = {r["k"]: (r["in_window"], r["first_year"], r["last_year"], r["change"], r["peak_year"]) for r in Q.annual_trend(t, "k", "y", 2022, 2023).collect()}
    assert got == {"a": (True, 2022, 2023, -2, 2022), "b": (False, 2020, 2020, 0, 2020)}
    layers = Q.layered(spark.createDataFrame([("a",), ("c",)], "k string"), "k", [("x", t.where("k = 'q'"), "total"), ("y", t.where("y = 2020"), "total")])
    assert {tuple(r) for r in layers.collect()} == {("a", 1.0, "y"), ("c", None, "unavailable")}


def test_warnings_and_links(spark):
    w = spark.createDataFrame([(1, [(1, "2,99", "watch"), (2, "2", "alert")]), (2, None), (3, [(1, None, "odd")])], "id int, o array<struct<day_no:int,codes:string,severity:string>>")
    assert {tuple(r) for r in S.decoded_warnings(w, "id", "o").collect()} == {(1, "alert", "Heavy Rain; unmapped_code_99", 2), (2, "no_warning", "", 0), (3, "no_warning", "", 1)}
    links = [(1, "https://a.org/doc/1", "malaria notice", "", False), (2, "https://a.org/tag/malaria", "malaria", "", False), (3, "https://a.org/doc/2", "weather", "", False), (4, "https://a.org/doc/3", "", "", True), (5, None, "malaria", "", True)]
    got = S.ranked_links(spark.createDataFrame(links, "id int, u string, l string, c string, p boolean"), "id", "u", "l", "c", "p")
    assert [(r["id"], r["link_score"]) for r in got.orderBy("position").collect()] == [(1, 6), (4, 0)]
    assert spark.range(1).select(T.repaired_label(F.lit("Download PDF"), F.lit("Circular 4"))).first()[0] == "Circular 4 Download PDF"
