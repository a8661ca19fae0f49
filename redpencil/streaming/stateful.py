"""Keyed state with timers: re-checks of changed content (T2) and jobs that end or fall silent."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from redpencil.operators.decisions import fingerprint

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SOURCE = ["workspace_id", "source_type", "source_id"]


def use_keyed_state(spark) -> None:
    """Keyed state with timers needs this state store; set it before such a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _millis(ts) -> int:
    return int(ts.timestamp() * 1000)


class _LastVersion(StatefulProcessor):
    """The fingerprint a source was last checked with."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "fingerprint string, at bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.last.get() if self.last.exists() else None
        seen, at = held if held is not None else (None, None)
        for row in sorted(rows, key=lambda r: (r["ts"], r["fingerprint"])):
            now = _millis(row["ts"])
            if at is not None and now < at:
                continue  # a version older than the one already checked
            at = now
            if row["fingerprint"] != seen:
                seen = row["fingerprint"]
                yield row
        if at is not None:
            self.last.update((seen, at))

    def close(self) -> None:
        pass


def recheck_stream(stream: DataFrame, parts: list[str] | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The versions of each source that differ from the one checked before.

    ``stream``: workspace_id, source_type, source_id, ts and the columns ``parts`` that make the content
    (text, and the lexicon's fingerprint where that counts too). A text that goes back to an older
    form is checked again. ``ttl_ms`` lets the state of a source go that was silent for so long; its
    next version counts as new; such a stream has a clock and so does not end by itself under
    ``availableNow``. Versions arrive in order of ts; one older than the last is no
    current content and is passed over. A task holds the versions of one source and micro-batch.
    """
    parts = parts or ["text"]
    rows = stream.withColumn("fingerprint", fingerprint(*SOURCE, *parts))
    return rows.groupBy(*SOURCE).transformWithState(
        _LastVersion(ttl_ms), rows.schema, "Append", "None" if ttl_ms is None else "ProcessingTime")


def recheck_batch(versions: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """The same over a table of versions."""
    rows = versions.withColumn("fingerprint", fingerprint(*SOURCE, *(parts or ["text"])))
    w = W.partitionBy(*SOURCE).orderBy("ts", "fingerprint")
    return (rows.withColumn("_before", F.lag("fingerprint").over(w))
            .where("not (fingerprint <=> _before)").drop("_before"))


# Progress per phase; a completed phase adds six, up to 96.
PROGRESS = {"ocr": 42, "caption_ai": 58, "image_ai": 72, "self_check": 86, "merge": 94}
TERMINAL = ("completed", "failed")
STALL_SECONDS = 270
JOB = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("phase", T.StringType()), T.StructField("status", T.StringType()),
                    T.StructField("progress", T.IntegerType()), T.StructField("updated_at", T.TimestampType())])


def _progress(phase: str, status: str) -> int:
    base = PROGRESS.get(phase, 48)
    return 96 if phase == "completed" else min(96, base + 6) if status == "completed" else base


class _Job(StatefulProcessor):
    """A job's last event, whether it has ended, and the timers that end it or forget it."""

    def __init__(self, stall_ms: int, keep_ms: int, event_time: bool) -> None:
        self.stall_ms, self.keep_ms, self.event_time = stall_ms, keep_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "phase string, status string, at bigint, ended boolean")

    def _wake(self, at_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at_ms)

    def _row(self, job_id: str, phase: str, status: str, shown: str, at: int) -> Row:
        import datetime

        return Row(job_id=job_id, phase=phase, status=shown, progress=_progress(phase, status),
                   updated_at=datetime.datetime.fromtimestamp(at / 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (job_id,) = key
        state = self.job.get() if self.job.exists() else None
        phase, status, at, ended = state if state is not None else (None, None, None, False)
        if ended:
            for _ in rows:  # a job that has ended stays so
                pass
            return
        shown = None
        for now, p, s in sorted((_millis(r["ts"]), str(r["phase"]), str(r["status"])) for r in rows):
            if at is not None and now < at:
                continue
            if self.event_time and at is not None and now - at > self.stall_ms:
                shown, ended = "stalled", True
                break
            phase, status, at = p, s, now
            if p in TERMINAL or s == "failed":
                shown, ended = p if p in TERMINAL else "failed", True
                break
            shown = "running"
        if shown is None:
            return
        self.job.update((phase, status, at, ended))
        clock = at if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        self._wake(clock + (self.keep_ms if ended else self.stall_ms))
        yield self._row(job_id, phase, status, shown, at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        phase, status, at, ended = self.job.get()
        if ended:
            self.job.clear()  # nothing is kept of dead jobs
            return
        self.job.update((phase, status, at, True))
        clock = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        self._wake(clock + self.keep_ms)
        yield self._row(key[0], phase, status, "stalled", at)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, stall_seconds: int = STALL_SECONDS, keep_seconds: int = 86_400, event_time: bool = False,
               delay: str = "0 seconds") -> DataFrame:
    """Each change of a job's state; a silent job is closed by a timer and reported as stalled.

    ``events``: job_id, phase, status, ts. A job ends with a terminal phase, a failed step, or
    ``stall_seconds`` without an event; events after its end do not reopen it, and its state goes
    ``keep_seconds`` later. With ``event_time`` the events' own clock counts (the watermark trails by
    ``delay``), and a gap inside a batch stalls a job as it would between batches; otherwise the
    wall clock counts. A task holds the event times of one job and micro-batch.
    """
    rows = events.select("job_id", "phase", "status", "ts")
    if event_time:
        rows = rows.withWatermark("ts", delay)
    return rows.groupBy("job_id").transformWithState(
        _Job(stall_seconds * 1000, keep_seconds * 1000, event_time), JOB, "Update", "EventTime" if event_time else "ProcessingTime")


def job_ends(events: DataFrame, stall_seconds: int = STALL_SECONDS) -> DataFrame:
    """T3, T5 over an event table, by its own clock: the last state of each job.

    The first gap longer than ``stall_seconds``, the first terminal event or failed step, or, for jobs
    still open, silence up to the table's last event decides.
    """
    w = W.partitionBy("job_id").orderBy("ts", "phase", "status")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = (events.select("job_id", "phase", "status", ms.alias("at"), "ts")
         .withColumn("_next", F.lead("at").over(w)))
    last = e.agg(F.max("at").alias("_last"))
    ends = F.col("phase").isin(*TERMINAL) | (F.col("status") == "failed")
    gap = F.coalesce(F.col("_next"), F.col("_last")) - F.col("at") > stall_seconds * 1000
    e = e.join(F.broadcast(last)).withColumn("_kind", F.when(ends, 1).when(gap, 2))  # one row
    pick = F.struct(F.coalesce(F.when(F.col("_kind").isNotNull(), F.col("at")), F.lit(2**62)).alias("k"), (-F.col("at")).alias("n"))
    first = e.groupBy("job_id").agg(F.min_by(F.struct("phase", "status", "_kind", "ts"), pick).alias("s"))
    base = "case s.phase " + " ".join(f"when '{p}' then {v}" for p, v in PROGRESS.items()) + " else 48 end"
    return first.select(
        "job_id", F.col("s.phase").alias("phase"),
        F.expr("case when s._kind = 1 then if(s.phase in ('completed', 'failed'), s.phase, 'failed') "
               "when s._kind = 2 then 'stalled' else 'running' end").alias("status"),
        F.expr(f"case when s.phase = 'completed' then 96 when s.status = 'completed' then least(96, {base} + 6) else {base} end").alias("progress"),
        F.col("s.ts").alias("updated_at"))
