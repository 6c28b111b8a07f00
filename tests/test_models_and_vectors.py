import random

import numpy as np
from pyspark.sql import functions as F

from teesta.operators import models as M
from teesta.operators import stats as S
from teesta.operators import text as T


def test_nearest_vectors_equal_brute_force(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(90, 6)).round(2)
    v[7] = v[3]
    rows = [(i, [float(x) for x in v[i]]) for i in range(90)] + [(200, None), (201, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id bigint, e array<double>").repartition(5)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = set()
    for q in range(0, 90, 20):
        near = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in range(90) if i != q)[:4]
        want |= {(q, i, n + 1) for n, (_, i) in enumerate(near)}
    for block in (2, 4096):
        got = T.nearest_vectors(df, df.where("id % 20 = 0 and id < 100"), "id", "e", 4, block)
        assert {(x["query_id"], x["id"], x["rank_in_group"]) for x in got.collect()} == want
    assert T.nearest_vectors(df, df.limit(0), "id", "e").count() == 0
    assert T.nearest_vectors(df.limit(0), df, "id", "e").count() == 0


def test_ranks_without_one_sorting_task(spark):
    r = random.Random(2)
    values = [r.randrange(30) for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(999, None)], "id int, v int")
    ordered = sorted(values)
    want = {v: (2 * ordered.index(v) + ordered.count(v) + 1) / 2 for v in set(values)}
    got = {x["id"]: x["rank"] for x in S.average_ranks(df, "v", "rank").collect()}
    assert got.pop(999) is None and got == {i: want[v] for i, v in enumerate(values)}
    p = {x["id"]: x["priority"] for x in S.priority(df.where("v is not null").withColumn("c", F.lit(0.0)), "id", "v", "c").collect()}
    assert all(abs(p[i] - 80 * ordered.index(v) / 199) < 1e-9 for i, v in enumerate(values))


def test_bootstrap_draws_model_and_reference_together(spark):
    rows = [(b, 0.9 if b % 2 else 0.1, b % 2) for b in range(40) for _ in range(3)]
    df = spark.createDataFrame(rows, "b int, p double, y int").withColumn("even", F.lit(0.5))
    x = S.block_bootstrap(df, "b", "p", "y", "even", replicates=200).first()
    assert abs(x["brier"] - 0.01) < 1e-9 and abs(x["delta"] - 0.24) < 1e-9 and x["better"] == 1.0 and abs(x["delta_low"] - 0.24) < 1e-9
    assert S.block_bootstrap(df, "b", "p", "y", replicates=50).columns == ["brier", "low", "high"]


def test_ladder_choice_and_serving(spark):
    rows = [(k, m, int((k + m) % 5 == 0), (m + 1) % 2) for k in range(4) for m in range(1, 13) for _ in range(6)]
    df = spark.createDataFrame(rows, "k int, m int, y int, recent int")
    got = {x["contestant"]: (x["brier"], x["chosen"]) for x in M.ladder(df, df, "k", "m", "recent", "y").collect()}
    assert got["key_month"][1] and sum(c for _, c in got.values()) == 1 and got["key_month"][0] < got["month"][0] <= got["unconditional"][0]
    r = random.Random(1)
    data = [(i, float(r.gauss(0, 1))) for i in range(400)]
    x = spark.createDataFrame([(i, v, int(v + r.gauss(0, 1) > 0)) for i, v in data], "i int, v double, y int").withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")))
    best, scored = M.nested_ridge(x, ["v"], "y", "day", (1.0, 8.0))
    assert best in (1.0, 8.0) and min(b for _, b in scored) == dict(scored)[best]
    rows = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.95), ("b", 1, 0.1), ("c", 1, None)], "k string, t int, p double")
    out = M.served(rows, "k", "t", F.col("p"), spark.createDataFrame([("a",), ("c",)], "k string"))
    assert {tuple(z) for z in out.collect()} == {("a", 2, 0.6, "served"), ("b", 1, None, "not_qualified"), ("c", 1, None, "no_history")}
