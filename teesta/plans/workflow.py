"""Queries of the queue, the link frontier and review tasks. Events stand for jobs' actions, a user for a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teesta.sources.tables import table
from teesta.streaming import flows, queue

LEASE = 6 * 3600


def _actions(s: SparkSession, d: str) -> DataFrame:
    kinds = {"view": "enqueue", "click": "claim", "purchase": "complete", "error": "fail"}
    action = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")], F.lit("claim"))
    return table(s, d, "events").select(
        F.col("user_id").alias("job"), F.col("event_id").alias("event_no"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("at"),
        action.alias("action"), F.when(F.col("event_id") % 7 == 0, 1).otherwise(0).cast("long").alias("payload"), F.when(F.col("event_id") % 5 == 0, 1).otherwise(0).alias("token_lag"),
    )


def queue_fold(s: SparkSession, d: str) -> DataFrame:
    """STM-2..5: what became of every event."""
    return queue.fold_queue(_actions(s, d), LEASE).select("event_no", "outcome", "phase", "attempts", "fence")


def stale_fence(s: SparkSession, d: str) -> DataFrame:
    """STM-6: events of workers whose token was overtaken or whose lease ran out."""
    return queue.fold_queue(_actions(s, d), LEASE).where(F.col("outcome").isin("stale", "expired")).select("job", "event_no", "action", "outcome", "fence")


def queue_states(s: SparkSession, d: str) -> DataFrame:
    """STM-4, STM-5, AGG-2: outcomes counted by action."""
    return queue.fold_queue(_actions(s, d), LEASE).groupBy("action", "outcome").agg(F.count(F.lit(1)).alias("n"))


def stream_dedup(s: SparkSession, d: str) -> DataFrame:
    """STM-2, STM-13: each key once, in batch form; tests hold the stream against it."""
    e = table(s, d, "events").select("user_id", "event_type", "ts", "event_id").withColumn("idempotency_key", F.concat_ws(":", "user_id", "event_type"))
    return flows.first_seen(e, "idempotency_key", "event_id").select("idempotency_key", "event_id")


def link_frontier(s: SparkSession, d: str) -> DataFrame:
    """STM-8, STM-19."""
    x = table(s, d, "source_snapshot").select("snapshot_id", "source_id", "final_url", "created_at")
    return queue.frontier(x, "source_id", "final_url", "created_at", "snapshot_id").select("url", "source", "times", "reserved")


def review_versions(s: SparkSession, d: str) -> DataFrame:
    """STM-7: decisions of a user's events on a task a day, each against the version it saw."""
    e = table(s, d, "events").where("event_type in ('purchase', 'error')")
    x = e.select(F.concat_ws(":", "user_id", F.to_date("ts")).alias("task"), "ts", "event_id", (F.col("event_id") % 2).alias("expected"), "event_type")
    return queue.review_decisions(x, "task", "ts", "event_id", "expected", "event_type")


def review_tasks(s: SparkSession, d: str) -> DataFrame:
    """STM-17, JN-3: one task for each affirmed, eligible signal, with its snapshot and source; signals reviewed before (ambiguous ones) get none."""
    g = table(s, d, "redacted_signal")
    wanted = g.where("assertion_class = 'affirmed' and event_review_eligible").select("signal_id", "source_id", "source_snapshot_id", "disease")
    had = g.where("processing_state = 'ambiguous_entity_linkage'").select("signal_id")
    tasks = wanted.join(had, "signal_id", "left_anti").distinct()
    snap = table(s, d, "source_snapshot").select(F.col("snapshot_id").alias("source_snapshot_id"), "is_fixture", "access_path")
    reg = table(s, d, "source_registry").select("source_id", "source_name")
    x = tasks.join(snap, "source_snapshot_id", "left").join(reg, "source_id", "left")
    return x.select(F.concat(F.lit("task_"), F.substring(F.sha2("signal_id", 256), 1, 20)).alias("task_id"), "signal_id", "disease", "source_name", "is_fixture", "access_path", F.lit("open").alias("state"))


QUERIES = {f.__name__: f for f in (queue_fold, stale_fence, queue_states, stream_dedup, link_frontier, review_versions, review_tasks)}

_FOLD = f"""
  o AS (SELECT user_id AS job, event_id AS no, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n, floor(epoch(ts))::BIGINT AS t,
          CASE event_type WHEN 'view' THEN 'enqueue' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'claim' END AS a,
          CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS pay, event_id % 5 = 0 AS old FROM events),
  f AS (SELECT DISTINCT job, 0::BIGINT AS n, 0::BIGINT AS no, '' AS a, 'none' AS phase, 0 AS held, 0 AS attempts, 0 AS fence, 0::BIGINT AS until, 0::BIGINT AS ready, '' AS oc FROM o
    UNION ALL
    SELECT job, n, no, a,
      CASE oc WHEN 'enqueued' THEN 'queued' WHEN 'claimed' THEN 'leased' WHEN 'reclaimed' THEN 'leased' WHEN 'completed' THEN 'completed' WHEN 'failed' THEN 'queued' WHEN 'died' THEN 'dead' ELSE phase END,
      CASE oc WHEN 'enqueued' THEN pay ELSE held END,
      CASE WHEN oc IN ('failed', 'died') THEN attempts + 1 ELSE attempts END,
      CASE WHEN oc IN ('claimed', 'reclaimed') THEN fence + 1 ELSE fence END,
      CASE WHEN oc IN ('claimed', 'reclaimed') THEN t + {LEASE} WHEN oc IN ('completed', 'failed', 'died') THEN 0 ELSE until END,
      CASE oc WHEN 'enqueued' THEN t WHEN 'failed' THEN t + least(300, CAST(pow(2, attempts + 1) AS BIGINT)) ELSE ready END,
      oc
    FROM (SELECT o.job, o.n, o.no, o.a, o.t, o.pay, f.phase, f.held, f.attempts, f.fence, f.until, f.ready,
        CASE WHEN o.a = 'enqueue' THEN CASE WHEN f.phase = 'none' THEN 'enqueued' WHEN o.pay = f.held THEN 'replayed' ELSE 'conflict' END
             WHEN o.a = 'claim' THEN CASE WHEN f.phase = 'queued' AND f.ready <= o.t THEN 'claimed' WHEN f.phase = 'leased' AND f.until <= o.t THEN 'reclaimed' ELSE 'refused' END
             WHEN f.phase = 'completed' AND o.a = 'complete' THEN 'replayed' WHEN f.phase <> 'leased' THEN 'refused' WHEN o.old THEN 'stale' WHEN f.until <= o.t THEN 'expired'
             WHEN o.a = 'complete' THEN 'completed' WHEN f.attempts + 1 >= 3 THEN 'died' ELSE 'failed' END AS oc
      FROM f JOIN o ON o.job = f.job AND o.n = f.n + 1))"""

ORACLE = {
    "queue_fold": f"WITH RECURSIVE {_FOLD} SELECT no AS event_no, oc AS outcome, phase, attempts, fence FROM f WHERE n > 0",
    "stale_fence": f"WITH RECURSIVE {_FOLD} SELECT job, no AS event_no, a AS action, oc AS outcome, fence FROM f WHERE n > 0 AND oc IN ('stale', 'expired')",
    "queue_states": f"WITH RECURSIVE {_FOLD} SELECT a AS action, oc AS outcome, count(*) AS n FROM f WHERE n > 0 GROUP BY 1, 2",
    "stream_dedup": "SELECT user_id || ':' || event_type AS idempotency_key, min(event_id) AS event_id FROM events GROUP BY 1",
    "link_frontier": """WITH x AS (SELECT final_url AS url, arg_min(source_id, (created_at, snapshot_id)) AS source, min(created_at) AS first_seen, count(*) AS times FROM source_snapshot WHERE final_url IS NOT NULL GROUP BY 1)
      SELECT url, source, times, row_number() OVER (PARTITION BY source ORDER BY first_seen, url) <= 3 AS reserved FROM x""",
    "review_versions": """WITH RECURSIVE o AS (SELECT user_id || ':' || ts::DATE AS task, event_id % 2 AS want, event_type AS v, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('purchase', 'error')),
      f AS (SELECT DISTINCT task, 0::BIGINT AS n, 0 AS version, NULL::VARCHAR AS verdict, 0 AS accepted, 0 AS rejected FROM o
        UNION ALL SELECT o.task, o.n, CASE WHEN want = version THEN version + 1 ELSE version END, CASE WHEN want = version THEN v ELSE verdict END,
          CASE WHEN want = version THEN accepted + 1 ELSE accepted END, CASE WHEN want = version THEN rejected ELSE rejected + 1 END FROM f JOIN o ON o.task = f.task AND o.n = f.n + 1)
      SELECT task, version, verdict, accepted, rejected FROM f QUALIFY row_number() OVER (PARTITION BY task ORDER BY n DESC) = 1""",
    "review_tasks": """SELECT DISTINCT 'task_' || substring(sha256(signal_id), 1, 20) AS task_id, signal_id, disease, source_name, is_fixture, access_path, 'open' AS state
      FROM redacted_signal g LEFT JOIN source_snapshot s ON s.snapshot_id = g.source_snapshot_id LEFT JOIN source_registry r ON r.source_id = g.source_id
      WHERE assertion_class = 'affirmed' AND event_review_eligible AND processing_state <> 'ambiguous_entity_linkage'""",
}
