import random

from teesta.streaming import flows, queue

COLS = "job string, event_no long, at long, action string, payload long, token_lag int"


def log(seed, jobs=12, n=400):
    r = random.Random(seed)
    return [(f"j{r.randrange(jobs)}", i, i * 40 + r.randrange(30), r.choice(["enqueue", "claim", "claim", "complete", "fail", "odd"]), r.choice([0, 0, 0, 1]), r.choice([0, 0, 0, 1])) for i in range(n)]


def test_rules_one_by_one():
    s, o = queue.step(queue.NEW, "enqueue", 0, 5, None, 300)
    assert o == "enqueued" and queue.step(s, "enqueue", 1, 5, None, 300)[1] == "replayed" and queue.step(s, "enqueue", 1, 6, None, 300)[1] == "conflict"
    s, o = queue.step(s, "claim", 10, 0, None, 300)
    assert o == "claimed" and s[3] == 1 and queue.step(s, "claim", 20, 0, None, 300)[1] == "refused"
    again, o = queue.step(s, "claim", 310, 0, None, 300)
    assert o == "reclaimed" and again[3] == 2
    assert queue.step(again, "complete", 320, 0, 1, 300)[1] == "stale" and queue.step(again, "complete", 700, 0, 2, 300)[1] == "expired"
    done, o = queue.step(again, "complete", 320, 0, 2, 300)
    assert o == "completed" and queue.step(done, "complete", 330, 0, 2, 300) == (done, "replayed") and queue.step(done, "claim", 9999, 0, None, 300)[1] == "refused"
    for wait in (2, 4):
        s, o = queue.step(s, "fail", 100, 0, s[3], 300)
        assert o == "failed" and s[5] == 100 + wait and queue.step(s, "claim", 100, 0, None, 300)[1] == "refused"
        s, o = queue.step(s, "claim", 100 + wait, 0, None, 300)
        assert o == "claimed"
        s = (*s[:4], 400, s[5])
    assert queue.step(s, "fail", 110, 0, s[3], 300)[1] == "died"


def test_batch_equals_plain_fold(spark):
    rows = log(3)
    df = spark.createDataFrame([*rows, (None, 1, 1, "claim", 0, 0), ("x", 2, 2, None, 0, 0)], COLS)
    got = {(x["job"], x["event_no"]): (x["outcome"], x["phase"], x["attempts"], x["fence"]) for x in queue.fold_queue(df).collect()}
    want, state = {}, {}
    for job, no, at, action, pay, lag in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        s = state.get(job, queue.NEW)
        s, o = queue.step(s, action, at, pay, s[3] - lag if lag else None, 300)
        state[job], want[job, no] = s, (o, s[0], s[2], s[4 - 1])
    assert got == want
    assert queue.fold_queue(df.limit(0)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = log(8, 6, 200)
    batch = {tuple(x) for x in queue.fold_queue(spark.createDataFrame(rows, COLS)).collect()}
    for i in range(2):
        spark.createDataFrame(rows[i * 100 : (i + 1) * 100], COLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(COLS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    flows.run_once(queue.fold_queue_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()} == batch


def test_frontier_and_decisions(spark):
    links = spark.createDataFrame([("a", "u1", 2, 1), ("b", "u1", 1, 2), ("b", "u1", 9, 3), ("a", "u2", 5, 4), ("a", None, 1, 5)], "s string, u string, t int, k int")
    got = {tuple(x) for x in queue.frontier(links, "s", "u", "t", "k", 1).collect()}
    assert got == {("u1", "b", 1, 9, 3, True), ("u2", "a", 5, 5, 1, True)}
    d = spark.createDataFrame([("t", 1, 1, 0, "x"), ("t", 2, 2, 0, "y"), ("t", 3, 3, 1, "z"), (None, 1, 1, 0, "x")], "k string, a int, n int, e int, v string")
    assert [tuple(x) for x in queue.review_decisions(d, "k", "a", "n", "e", "v").collect()] == [("t", 2, "z", 2, 1)]
    assert queue.review_decisions(d.limit(0), "k", "a", "n", "e", "v").count() == 0
