"""Stateless streams and job tables (T1, T3-T7); merging, re-checks and timers have modules of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpencil.lexicon import Lexicon
from redpencil.operators.candidates import scope
from redpencil.operators.checker import check
from redpencil.operators.decisions import NARROW
from redpencil.streaming.stateful import PROGRESS, STALL_SECONDS


def fast_issues(stream: DataFrame, lex: Lexicon, rules: set[int] | None = None) -> DataFrame:
    """Rule issues of arriving content; stateless, so it scales with input."""
    return check(stream, lex, rules)


def with_decisions(stream: DataFrame, decided: DataFrame) -> DataFrame:
    """Stream-static join; ``decided`` holds one status per narrow key."""
    key = NARROW
    d = decided.select(*key, F.col("status").alias("_status"))
    return (stream.join(d, key, "left").withColumn("status", F.coalesce("_status", "status")).drop("_status"))


def reject_stale(stream: DataFrame, current: DataFrame) -> DataFrame:
    """T4: mark results whose fingerprint no longer holds."""
    keys = scope(["source_id"], stream, current)
    now = current.select(*keys, F.col("fingerprint").alias("_now"))
    return stream.join(now, keys, "left").withColumn("stale", F.expr("not (fingerprint <=> _now)")).drop("_now")


def job_state(events: DataFrame) -> DataFrame:
    """T3 in batch: latest status per phase, then per job; progress as shown."""
    phase = events.where("phase is not null").groupBy("job_id", "phase").agg(
        F.max_by("status", "ts").alias("status"), F.min("ts").alias("started_at"), F.max("ts").alias("ts"))
    job = phase.groupBy("job_id").agg(F.max_by(F.struct("phase", "status"), F.struct("ts", "phase")).alias("l"),
                                      F.max("ts").alias("updated_at"))
    base = "case l.phase " + " ".join(f"when '{p}' then {v}" for p, v in PROGRESS.items()) + " else 48 end"
    return job.select(
        "job_id", F.col("l.phase").alias("phase"),
        F.expr("case when l.phase in ('completed', 'failed') then l.phase when l.status = 'failed' then 'failed' "
               "else 'running' end").alias("status"),
        F.expr(f"case when l.phase = 'completed' then 96 when l.status = 'completed' then least(96, {base} + 6) "
               f"else {base} end").alias("progress"), "updated_at")


def stalled_jobs(events: DataFrame, now: str) -> DataFrame:
    """T5 in batch: jobs without a terminal event for longer than the limit."""
    last = events.groupBy("job_id").agg(
        F.max("ts").alias("updated_at"),
        F.expr("bool_or(phase in ('completed', 'failed'))").alias("ended"))
    return last.where(f"not ended and unix_seconds(timestamp '{now}') - unix_seconds(updated_at) > {STALL_SECONDS}")


def periodic_metrics(events: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Tumbling QA metrics; the watermark lets state go and rows append."""
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
            .select(F.col("w.start").alias("window_start"), "event_type", "events", "value"))
