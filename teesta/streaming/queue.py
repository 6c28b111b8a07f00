"""A durable queue as a fold over ordered events, one state a job, the same in batch and on a stream.

Jobs are enqueued once under a key, claimed under a lease with a fencing token,
completed exactly once by the holder of the current token, and tried again with
growing delay when they fail, until they are dead. The fold keeps one small
state a job, so events pass through in order and nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# phase, payload, attempts, fence, leased until, claimable from
State = tuple[str, int, int, int, int, int]
NEW: State = ("none", 0, 0, 0, 0, 0)
STATE = "phase string, payload long, attempts int, fence int, until long, ready long"
RESULT = "job {key}, event_no long, action string, outcome string, phase string, attempts int, fence int"

# Tries before a job is dead, and the longest wait between tries in seconds.
MOST_ATTEMPTS = 3
LONGEST_WAIT = 300


def step(state: State, action: str, at: int, payload: int, token: int | None, lease: int) -> tuple[State, str]:
    """The state after one event, and its outcome. `token` is the fence the worker holds; null stands for the current one."""
    phase, held, attempts, fence, until, ready = state
    if action == "enqueue":
        if phase == "none":
            return ("queued", payload, 0, 0, 0, at), "enqueued"
        return state, "replayed" if payload == held else "conflict"
    if action == "claim":
        if phase == "queued" and ready <= at:
            return ("leased", held, attempts, fence + 1, at + lease, ready), "claimed"
        if phase == "leased" and until <= at:
            return ("leased", held, attempts, fence + 1, at + lease, ready), "reclaimed"
        return state, "refused"
    if phase == "completed" and action == "complete":
        return state, "replayed"
    if phase != "leased":
        return state, "refused"
    if token is not None and token != fence:
        return state, "stale"
    if until <= at:
        return state, "expired"
    if action == "complete":
        return ("completed", held, attempts, fence, 0, ready), "completed"
    if action == "fail":
        if attempts + 1 >= MOST_ATTEMPTS:
            return ("dead", held, attempts + 1, fence, 0, ready), "died"
        return ("queued", held, attempts + 1, fence, 0, at + min(LONGEST_WAIT, 2 ** (attempts + 1))), "failed"
    return state, "refused"


def _rows(job, events: pd.DataFrame, state: State, lease: int) -> tuple[State, list[tuple]]:
    out = []
    for no, action, at, payload, lag in zip(events["event_no"], events["action"], events["at"], events["payload"], events["token_lag"], strict=True):
        # A worker that was overtaken holds a token some fences old.
        state, outcome = step(state, action, int(at), int(payload), state[3] - int(lag) if lag else None, lease)
        out.append((job, int(no), action, outcome, state[0], state[2], state[3]))
    return state, out


_NAMES = ["job", "event_no", "action", "outcome", "phase", "attempts", "fence"]


def fold_queue(events: DataFrame, lease: int = 300) -> DataFrame:
    """job, event_no, action, outcome, phase, attempts, fence after each event, in order of (at, event_no) within a job.

    `events`: job, event_no, at (seconds), action ('enqueue', 'claim',
    'complete', 'fail'; others are refused), payload, token_lag. Null jobs and
    actions are left out. Rows pass in sorted batches with one state held, so a
    job of any length needs no more memory than another.
    """
    kind = events.schema["job"].dataType.simpleString()
    x = events.where(F.col("job").isNotNull() & F.col("action").isNotNull()).select("job", "event_no", "at", "action", F.coalesce("payload", F.lit(0)).cast("long").alias("payload"), F.coalesce("token_lag", F.lit(0)).cast("int").alias("token_lag"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, state = None, NEW
        for b in batches:
            out: list[tuple] = []
            for key, rows in b.groupby((b["job"] != b["job"].shift()).cumsum(), sort=False):
                first = rows["job"].iloc[0]
                if first != job:
                    job, state = first, NEW
                state, got = _rows(first, rows, state, lease)
                out += got
            yield pd.DataFrame(out, columns=_NAMES)

    return x.repartition("job").sortWithinPartitions("job", "at", "event_no").mapInPandas(run, RESULT.format(key=kind))


def fold_queue_stream(events: DataFrame, lease: int = 300) -> DataFrame:
    """The same on a stream: each batch gives the outcomes of its events, in order; the state of a job is kept between batches."""
    kind = events.schema["job"].dataType.simpleString()

    def fold(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state: State = tuple(kept.get) if kept.exists else NEW
        rows = pd.concat(list(batches)).sort_values(["at", "event_no"])
        state, out = _rows(key[0], rows, state, lease)
        kept.update(state)
        yield pd.DataFrame(out, columns=_NAMES)

    x = events.where("job is not null and action is not null")
    return x.groupBy("job").applyInPandasWithState(fold, RESULT.format(key=kind), STATE, "append", GroupStateTimeout.NoTimeout)


def frontier(links: DataFrame, source: str, url: str, seen: str, key: str, slots: int = 3) -> DataFrame:
    """url, source, first_seen, last_seen, times, reserved of each link once: the first source to see it owns it.

    Seen again only `last_seen` moves. Of each source the `slots` links first
    seen are reserved for work. Null urls are no links.
    """
    x = links.where(F.col(url).isNotNull())
    one = x.groupBy(url).agg(F.min_by(source, F.struct(seen, key)).alias("source"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.count(F.lit(1)).alias("times"))
    # Spark cuts each partition to `slots` rows a source before it is gathered.
    top = one.select("source", url, F.row_number().over(Window.partitionBy("source").orderBy("first_seen", url)).alias("_n")).where(F.col("_n") <= slots)
    return one.join(top.select(url, F.lit(True).alias("_r")), url, "left").select(F.col(url).alias("url"), "source", "first_seen", "last_seen", "times", F.coalesce("_r", F.lit(False)).alias("reserved"))


def review_decisions(decided: DataFrame, task: str, at: str, number: str, expected: str, verdict: str) -> DataFrame:
    """task, version, verdict, accepted, rejected: decisions on a task in order, each valid only against the version it saw.

    A decision that names another version than the current one is rejected; an
    accepted one supersedes the last and raises the version.
    """
    kind = decided.schema[task].dataType.simpleString()
    x = decided.where(F.col(task).isNotNull()).select(F.col(task).alias("task"), F.col(at).alias("at"), F.col(number).alias("no"), F.col(expected).cast("int").alias("expected"), F.col(verdict).alias("verdict"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, version, last, good, bad = None, 0, None, 0, 0
        for b in batches:
            out: list[tuple] = []
            for key, want, what in zip(b["task"], b["expected"], b["verdict"], strict=True):
                if key != task:
                    if task is not None:
                        out.append((task, version, last, good, bad))
                    task, version, last, good, bad = key, 0, None, 0, 0
                if want == version:
                    version, last, good = version + 1, what, good + 1
                else:
                    bad += 1
            yield pd.DataFrame(out, columns=["task", "version", "verdict", "accepted", "rejected"])
        if task is not None:
            yield pd.DataFrame([(task, version, last, good, bad)], columns=["task", "version", "verdict", "accepted", "rejected"])

    return x.repartition("task").sortWithinPartitions("task", "at", "no").mapInPandas(run, f"task {kind}, version int, verdict string, accepted int, rejected int")
