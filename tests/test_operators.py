import datetime as dt
import random

from pyspark.sql import functions as F

from teesta.operators import models as M
from teesta.operators import panel as P
from teesta.operators import questions as Q
from teesta.operators import relational as R
from teesta.operators import spatial as G
from teesta.operators import stats as S
from teesta.operators import text as T
from teesta.plans import texts as X
from teesta.streaming import flows as W


def test_missing_is_unknown_never_zero(spark):
    u = spark.createDataFrame([("a",), ("b",)], "k string")
    f = spark.createDataFrame([("a", 0)], "k string, n int")
    assert {tuple(r) for r in R.with_observation_state(u, f, "k", "n").collect()} == {("a", 0, "observed"), ("b", None, "unknown")}


def test_release_and_fixture_nulls(spark):
    df = spark.createDataFrame([(1, "live", None, None), (2, "live", "no", True), (3, "x", None, False)], "i int, state string, decision string, flag boolean")
    assert [r["i"] for r in R.released(df, "state", "decision", "live", ["no"]).collect()] == [1]
    assert {m: R.fixture_mode(df, "flag", m).count() for m in ("live_only", "fixture_only", "all")} == {"live_only": 2, "fixture_only": 1, "all": 3}


def test_upserts(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "n"), (2, "m"), (3, "z")], "k int, v string")
    assert {tuple(r) for r in R.upsert(a, b, ["k"], ["v"]).collect()} == {(1, "x"), (2, "n"), (3, "z")}
    assert R.insert_new(a, b, "k").count() == 3
    assert R.violations(a, "k", {"odd": F.col("k") % 2 == 0}).collect()[0]["rule"] == "odd"
    assert R.sentinel_number(F.lit(" 1,234.5 ")) is not None


def test_as_of_join_equals_brute_force(spark):
    r = random.Random(2)
    t = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    facts = [("k" if r.random() < 0.8 else "j", t(r.randrange(3000)), i, i) for i in range(200)]
    probes = [(i, r.choice(["k", "j", "none", None]), t(r.randrange(3000))) for i in range(200)]
    f = spark.createDataFrame(facts, "key string, known timestamp, tie int, v int")
    p = spark.createDataFrame(probes, "id int, key string, at timestamp")
    got = {x["id"]: x["v"] for x in P.as_of_join(p, f, ["key"], "at", "known", "tie", "v", 3.0).collect()}
    want = {i: max(((kn, tie, v) for key, kn, tie, v in facts if key == k and kn <= at), default=(0, 0, None))[2] for i, k, at in probes}
    assert got == want


def test_windows_do_not_bridge_gaps(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=7 * n) for n in (0, 1, 3, 4)]
    df = spark.createDataFrame([("a", d, 1.0) for d in days], "k string, week date, v double")
    assert [r["sum_2w"] for r in P.trailing(df, "k", "week", "v").orderBy("week").collect()] == [None, 2.0, None, 2.0]


def test_auc_and_row_numbers(spark):
    r = random.Random(4)
    rows = [(i, round(r.random(), 1), int(r.random() < 0.3)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, p double, y int")
    pos, neg = [p for _, p, y in rows if y], [p for _, p, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(S.auc(df, "p", "y").first()[0] - want) < 1e-9
    assert S.auc(df.where("y = 1"), "p", "y").first()[0] is None
    n = S.row_numbers(df, ["p", "i"], "n").orderBy("n").collect()
    assert [x["n"] for x in n] == list(range(1, 301)) and [(x["p"], x["i"]) for x in n] == sorted((p, i) for i, p, _ in rows)


def test_point_in_concave_ring(spark):
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    shapes = spark.createDataFrame([("s", [(float(x), float(y)) for x, y in ring])], "id string, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 2.0, 0.5), (2, 2.0, 3.0), (3, None, 1.0), (4, 0.5, 2.0)], "p int, x double, y double")
    assert {tuple(r) for r in G.locate(pts, "p", "x", "y", shapes, "id", "ring").collect()} == {(1, "s"), (2, None), (3, None), (4, "s")}


def test_models_learn_a_signal(spark):
    r = random.Random(6)
    rows = [(x, r.random(), int(r.random() < (0.9 if x > 0.5 else 0.1))) for x in (r.random() for _ in range(1500))]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    for p in (M.fit_ridge_logistic(df, ["a", "b"], "y").probability(), M.fit_boosted_trees(df, ["a", "b"], "y", rounds=8).probability()):
        x = df.select(p.alias("p"), "a").agg(F.avg(F.when(F.col("a") > 0.6, F.col("p"))), F.avg(F.when(F.col("a") < 0.4, F.col("p")))).first()
        assert x[0] > x[1] + 0.2


def test_duplicate_candidates_equal_brute_force(spark):
    r = random.Random(8)
    base = [" ".join(r.choice("abcdefgh") + str(r.randrange(30)) for _ in range(40)) for _ in range(6)]
    rows = []
    for i in range(60):
        w = r.choice(base).split()
        if r.random() < 0.7:
            w[r.randrange(40)] = "zz"
        rows.append((i, " ".join(w), "d", "p", dt.datetime(2024, 1, 1), "en"))
    rows += [(900, None, None, None, None, None), (901, "", "d", "p", dt.datetime(2024, 1, 1), "en")]
    df = spark.createDataFrame(rows, "id int, t string, d string, p string, at timestamp, l string")
    m, c = T.duplicate_candidates(df, "id", "t", "d", "p", "at", "l")
    cls = {x["id"]: x["class_id"] for x in m.collect()}
    texts = {cls[i]: t for i, t, *_ in rows if t}
    runs = {k: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for k, t in texts.items()}
    want = {(a, b) for a in runs for b in runs if a < b and len(runs[a] & runs[b]) / len(runs[a] | runs[b]) >= 0.8}
    assert {(x["class_a"], x["class_b"]) for x in c.collect()} == want and 900 not in cls


def test_near_copies_meet_whatever_their_language_label(spark):
    words = [f"w{i}" for i in range(60)]
    at = dt.datetime(2024, 1, 1)
    rows = [(1, " ".join(words), "en"), (2, " ".join(words), None), (3, " ".join([*words[:-1], "zz"]), "hi"), (4, " ".join(f"v{i}" for i in range(60)), "en")]
    df = spark.createDataFrame([(i, t, "d", "p", at, lang) for i, t, lang in rows], "id int, t string, d string, p string, at timestamp, l string")
    m, c = T.duplicate_candidates(df, "id", "t", "d", "p", "at", "l")
    got = {x["id"]: (x["class_id"], x["language"]) for x in m.collect()}
    assert got[1][0] == got[2][0] != got[3][0] and [got[i][1] for i in (1, 2, 3)] == ["en", None, "hi"]
    assert [{x["class_a"], x["class_b"]} for x in c.collect()] == [{got[1][0], got[3][0]}]


def test_text_helpers(spark):
    one = spark.range(1)
    assert one.select(T.canonical_url(F.lit("HTTPS://Ex.ORG:443//a//b/?z=1&utm_source=q&b=2#f"))).first()[0] == "https://ex.org/a/b?b=2&z=1"
    assert one.select(T.citations(F.lit("[E 2] [E1] [E 9] [E2]"), F.lit(3))).first()[0] == [2, 1]
    assert one.select(T.grounded(F.lit("had 12 of 3"), F.lit("12 and 3 and 4"))).first()[0]
    said = lambda q, sick: one.select(Q.intent(F.lit(q), F.lit(sick))).first()[0]
    assert said("compare dengue evidence in two places", True) == "evidence_search" and said("compare dengue cases", True) == "incidence_request" and said("compare cases", False) == "evidence_search"
    assert said("what will there be next week", False) == "evidence_search" and said("will dengue spread next week", True) == "forecast_request" and said("which medicine for dengue", True) == "clinical_advice_request"
    assert one.select(Q.horizon_weeks(F.lit("in the next two months")), Q.horizon_months(F.lit("12 weeks"))).first() == (8, 3)
    assert not one.select(T.grounded(F.lit("5 of 7"), F.lit("7"))).first()[0] and one.select(T.grounded(F.lit("2 records of 7"), F.lit("7"), F.lit(3))).first()[0]
    urls = {"http://A.org": "http://a.org/", "https://a.org/x/./y/../z//?UTM_a=1&ref=2&k=3#f": "https://a.org/x/z?k=3", "no address": "no address", "https://a.org:8080/p/": "https://a.org:8080/p"}
    assert all(one.select(T.canonical_url(F.lit(u))).first()[0] == v for u, v in urls.items())
    assert one.select(T.is_navigation(F.lit("https://a.org/tag/x")), T.is_navigation(F.lit("https://a.org/story/page/3")), T.is_navigation(F.lit("https://a.org/story/3"))).first() == (True, True, False)
    page = spark.createDataFrame([(1, "<title>T</title><nav><a href='/x'>nav</a></nav><p>Hello <a href='/d.pdf'>pdf</a></p>"), (2, None), (3, "<p>broken <b")], "id int, b string")
    got = {r["id"]: r for r in T.read_pages(page, "id", "b").collect()}
    assert got[1]["visible_text"] == "Hello pdf" and got[1]["title"] == "T" and got[2]["visible_text"] == ""


def test_base_rate_of_each_fold(spark):
    rows = [(dt.date(1997, 5, 1), 1), (dt.date(1998, 5, 1), 0), (dt.date(1999, 5, 1), 0), (dt.date(2000, 5, 1), 1)]
    x = spark.createDataFrame(rows, "target_week date, target int")
    assert {tuple(r) for r in M.fold_base_rates(x, "target_week", [1997, 1998, 1999, 2000], "target").collect()} == {(1997, None), (1998, 1.0), (1999, 0.5), (2000, 1 / 3)}


def test_reference_sizes(spark, tmp_path):
    rows = [(i % 17 / 17.0, i % 5 / 5.0, int(i * 7 % 17 > 8)) for i in range(600)]
    x = spark.createDataFrame(rows, "a double, b double, y int")
    assert len(M.fit_boosted_trees(x, ["a", "b"], "y").trees) == 60
    text = "x" * 120_000 + " malaria " + "y" * 30_000
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    span = X.evidence_spans(spark, str(tmp_path)).first()
    assert 2300 <= len(span["span"]) <= 2400 and "malaria" in span["span"] and text[span["begin"] : span["begin"] + len(span["span"])] == span["span"]
    import inspect

    assert inspect.signature(S.block_bootstrap).parameters["replicates"].default == 2000


def test_boosted_cells_equal_boosted_rows(spark):
    rows = [(i % 17 / 17.0, i % 5 / 5.0, int(i * 7 % 17 > 8 or i % 5 == 1)) for i in range(600)]
    import numpy as np

    a, y = np.array([r[:2] for r in rows]), np.array([r[2] for r in rows], float)
    m = M.fit_boosted_trees(spark.createDataFrame(rows, "a double, b double, y int"), ["a", "b"], "y", rounds=6)
    z = np.full(600, m.base)

    def leaves(t, at):
        if "v" in t:
            yield at, t["v"]
        else:
            left = a[:, "ab".index(t["c"])] <= t["t"]
            yield from leaves(t["l"], at & left)
            yield from leaves(t["r"], at & ~left)

    for t in m.trees:
        p, step = 1 / (1 + np.exp(-z)), np.zeros(600)
        for at, v in leaves(t, np.ones(600, bool)):
            assert abs(v + (p - y)[at].sum() / ((p * (1 - p))[at].sum() + 5.0)) < 1e-9
            step[at] = v
        z = z + step * m.rate


def test_pages_whose_body_stands_in_chrome(spark):
    body = "Fever cases were found in the village and samples sent. " * 5
    pages = [
        (1, f"<nav>menu</nav><header><p>{body}</p></header>"),
        (2, f"<form><p>{body}</p></form><nav>menu</nav>"),
        (3, f"<div class='megamenu-nav'>{body}<header>chief</header>"),
        (4, f"</b><div id='top' class='x-sidebar'>side</div><p>{body}</p>"),
        (5, "<p>short</p><footer>foot</footer><nav>menu and more</nav>"),
    ]
    got = {r["id"]: r for r in T.read_pages(spark.createDataFrame(pages, "id int, b string"), "id", "b").collect()}
    assert [got[i]["visible_text"] for i in (1, 2, 3, 4)] == [body.strip()] * 4 == [got[i]["page_text"] for i in (1, 2, 3, 4)]
    assert got[5]["page_text"] == "short\nfoot\nmenu and more"


def test_page_text_reads_every_line(spark, tmp_path):
    line = "Fever cases were found in the village and samples were sent to the laboratory of the district"
    spark.createDataFrame([(1, f"{line}\n\n a  <b> \n{line}"), (2, "few\nwords")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["visible_text"], r["page_text"]) for r in X.html_page_text(spark, str(tmp_path)).collect()}
    assert got == {1: (f"{line}\na b\n{line}",) * 2, 2: ("few\nwords", "home\nfew\nwords\nfoot")}


def test_small_text_steps(spark):
    one = spark.range(1)
    assert one.select(T.transliterated(T.transliterated(F.lit("ଓଡ଼ିଶା।")), "or")).first()[0] == "ଓଡ଼ିଶା।"
    assert one.select(T.collapsed_runs(F.lit("no no no no case, ha ha"))).first()[0] == "no case, ha ha"
    assert one.select(T.capped_sentences(F.lit("aa bb cc. dd"), 5)).first()[0] == ["aa bb", "cc.", "dd"]
    assert one.select(T.restored(T.protected(F.lit("test kits and kits"), ["kits", "test kits"]), ["kits", "test kits"])).first()[0] == "test kits and kits"
    assert one.select(T.composed(F.lit("Ａe\u0301  \u200dX"))).first()[0] is not None


def test_stream_equals_table(spark, tmp_path):
    rows = [(i, i % 7, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), ["view", "error", "purchase"][i % 3], float(i)) for i in range(300)]
    e = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp, event_type string, value double")
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in W.fold_attempts(e, "user_id", "ts", "event_type", "event_id", "purchase", "error").collect()}
    q = W.fold_attempts_stream(stream, "user_id", "ts", "event_type", "event_id", "purchase", "error").writeStream.format("memory").queryName("folded").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.sql("SELECT * FROM folded").collect()} == want
    q = W.windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.sql("SELECT * FROM weeks").collect()} == {tuple(r) for r in W.windowed_counts(e, "ts", "event_type").collect()}
