"""The same logic on streams: windows, first-seen keys, attempts folded into states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, at: str, kind: str, size: str = "7 days", slide: str | None = None, start: str = "4 days", late: str = "2 days") -> DataFrame:
    """window_start, kind, n, total over event time; weeks begin on Mondays. Works on streams and tables alike."""
    e = events.withColumn(at, F.col(at).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(at, late)
    w = F.window(at, size, slide or size, start) if slide is None else F.window(at, size, slide, start)
    return e.groupBy(w.alias("_w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("_w.start").alias("window_start"), kind, "n", "total")


def first_seen(events: DataFrame, key: str, at: str, late: str = "2 days") -> DataFrame:
    """Each key once: on a stream within the watermark, on a table for good."""
    if events.isStreaming:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return events.groupBy(key).agg(F.min_by(F.struct(*[c for c in events.columns if c != key]), at).alias("_r")).select(key, "_r.*")


def sessions(events: DataFrame, user: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """user, begin, end, n of sessions parted by `gap` without an event."""
    e = events.withColumn(at, F.col(at).cast("timestamp"))
    return e.groupBy(user, F.session_window(at, gap).alias("_s")).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("_s.start").alias("begin"), F.col("_s.end").alias("end"), "n")


FOLD = "key long, attempts long, done long, errors long, last_kind string"


def fold_attempts(events: DataFrame, key: str, at: str, kind: str, number: str, success: str, failure: str) -> DataFrame:
    """Per key the state after all events in order: attempts, done, errors since the last success, last kind; a table's form.

    `number` settles the order at equal times. Everything is an aggregate that
    combines before the shuffle: errors since the last success are those later
    than the greatest success.
    """
    pos = F.struct(F.col(at), F.col(number))
    e = events.select(F.col(key).alias("key"), pos.alias("_p"), F.col(kind).alias("_k"))
    last_ok = e.where(F.col("_k") == success).groupBy("key").agg(F.max("_p").alias("_ok"))
    x = e.join(last_ok, "key", "left")
    return x.groupBy("key").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("_k") == success).alias("done"), F.count_if((F.col("_k") == failure) & (F.col("_ok").isNull() | (F.col("_p") > F.col("_ok")))).alias("errors"), F.max_by("_k", "_p").alias("last_kind"))


def fold_attempts_stream(events: DataFrame, key: str, at: str, kind: str, number: str, success: str, failure: str) -> DataFrame:
    """The same fold with kept state per key; each batch gives the new state of the keys it touches. Events older than what was folded are passed over."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, done, errors, last, seen_at, seen_no = state.get if state.exists else (0, 0, 0, "", -1, -1)
        rows = pd.concat(list(batches)).sort_values([at, number])
        for t, n, what in zip(rows[at].astype("int64"), rows[number], rows[kind], strict=True):
            if (t, n) <= (seen_at, seen_no):
                continue
            attempts, seen_at, seen_no, last = attempts + 1, int(t), int(n), what
            if what == success:
                done, errors = done + 1, 0
            elif what == failure:
                errors += 1
        state.update((attempts, done, errors, last, seen_at, seen_no))
        yield pd.DataFrame([(k[0], attempts, done, errors, last)], columns=["key", "attempts", "done", "errors", "last_kind"])

    return events.groupBy(key).applyInPandasWithState(fold, FOLD, "attempts long, done long, errors long, last_kind string, seen_at long, seen_no long", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """One tick: everything there is, in bounded batches, then an end."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
