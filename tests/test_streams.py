"""Streams equal their batch forms, however the rows are cut."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from redpencil.operators import candidates as cd
from redpencil.streaming import stateful as sf
from redpencil.streaming.issue_store import IssueStore

ISSUE = ("workspace_id string, source_type string, source_id string, issue_id string, severity string, original string, "
         "span_start int, span_end int, origin string, ord long")
ROWS = [("w1", "caption", "1", "rule", "low", "ab", 0, 2, "rule", 0), ("w1", "caption", "1", "gone", "high", "bc", 1, 3, "candidate", 1),
        ("w1", "caption", "1", "short", "low", "xy", 10, 12, "candidate", 2), ("w1", "caption", "1", "long", "low", "xyz", 10, 13, "candidate", 3),
        ("w2", "caption", "1", "kept", "low", "bc", 1, 3, "candidate", 4), ("w1", "image", "1", "i1", "low", "q", 0, 1, "candidate", 5),
        ("w1", "image", "1", "i2", "critical", "q", 0, 1, "candidate", 6), ("w1", "image", "2", "late", "low", "q", 4, 9, "rule", 7),
        (None, "image", "2", "null", "low", "q", 4, 9, "candidate", 8)]


@pytest.mark.parametrize(("cuts", "buckets"), [([9], 5), ([3, 6, 9], 1), ([1, 3, 4, 6, 9], 5), ([4, 4, 9], 1)])
def test_any_cut_gives_the_batch_merge(spark, tmp_path, cuts, buckets):
    df = spark.createDataFrame(ROWS, ISSUE)
    want = {r.issue_id for r in cd.merge_issues(df.where("origin = 'rule'").drop("ord"), df.where("origin <> 'rule'")).collect()}
    assert want == {"rule", "long", "kept", "i2", "late", "null"}
    store, start = IssueStore(spark, str(tmp_path / "store"), df.schema, buckets), 0
    for epoch, stop in enumerate(cuts):
        batch = spark.createDataFrame(ROWS[start:stop], ISSUE)
        store.write(batch, epoch)
        if epoch % 2:
            store.write(batch, epoch)  # replayed
        start = stop
    assert {r.issue_id for r in store.issues().collect()} == want


def test_untouched_buckets_are_not_rewritten(spark, tmp_path):
    store = IssueStore(spark, str(tmp_path / "store"), spark.createDataFrame([], ISSUE).schema, 16)
    rows = [("w", "caption", str(i), f"i{i}", "low", "a", 0, 1, "rule", i) for i in range(60)]
    store.write(spark.createDataFrame(rows, ISSUE), 0)
    store.write(spark.createDataFrame([("w", "caption", "3", "new", "low", "b", 5, 6, "candidate", 99)], ISSUE), 1)
    written = [p.name for p in (tmp_path / "store/merged/epoch=1").iterdir() if p.name.startswith("bucket=")]
    assert len(written) == 1 and store.issues().count() == 61


def _versions(spark, rows):
    return spark.createDataFrame([("w", "caption", s, t, datetime.datetime(2024, 1, 1, 0, m)) for s, t, m in rows],
                                 "workspace_id string, source_type string, source_id string, text string, ts timestamp")


def _stream(spark, df, folder, cuts, order):
    """The rows as a file stream, one file a batch."""
    rows, start = df.orderBy(order).collect(), 0
    for n, stop in enumerate(cuts):
        spark.createDataFrame(rows[start:stop], df.schema).coalesce(1).write.mode("append").parquet(str(folder))
        start = stop
        time.sleep(1.1)  # files are taken in the order of their times
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def _collect(stream, folder, mode):
    parts = []

    def keep(batch, epoch):
        parts.extend(batch.collect())
    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination()
    return parts


@pytest.mark.parametrize("cuts", [[7], [2, 5, 7]])
def test_a_text_that_goes_back_is_checked_again(spark, tmp_path, cuts):
    sf.use_keyed_state(spark)
    df = _versions(spark, [("1", "A", 0), ("1", "A", 1), ("1", "B", 2), ("2", "A", 3), ("1", "A", 4), ("2", "A", 5), ("1", "A", 6)])
    want = sorted((r.source_id, r.text, r.ts) for r in sf.recheck_batch(df).collect())
    assert [w[:2] for w in want] == [("1", "A"), ("1", "A"), ("1", "B"), ("2", "A")]
    got = _collect(sf.recheck_stream(_stream(spark, df, tmp_path / "in", cuts, "ts")), tmp_path / "state", "append")
    assert sorted((r.source_id, r.text, r.ts) for r in got) == want


EVENTS = [("done", "ocr", "running", 0), ("silent", "ocr", "running", 1), ("done", "completed", "completed", 2), ("failed", "merge", "failed", 3),
          ("done", "ocr", "running", 4), ("gap", "ocr", "completed", 5), ("failed", "merge", "running", 6), ("gap", "merge", "running", 30),
          ("gap", "completed", "completed", 31), ("open", "ocr", "completed", 58), ("open", "self_check", "completed", 60)]


def _events(spark):
    return spark.createDataFrame([(j, p, s, datetime.datetime(2024, 1, 1, 1, m // 60, m % 60)) for j, p, s, m in EVENTS],
                                 "job_id string, phase string, status string, ts timestamp")


@pytest.mark.parametrize("cuts", [[11], [4, 8, 11]])
def test_jobs_end_or_stall_by_their_own_clock(spark, tmp_path, cuts):
    sf.use_keyed_state(spark)
    df = _events(spark)
    want = {r.job_id: (r.phase, r.status, r.progress) for r in sf.job_ends(df, 10).collect()}
    assert want == {"done": ("completed", "completed", 96), "silent": ("ocr", "stalled", 42), "failed": ("merge", "failed", 94),
                    "gap": ("ocr", "stalled", 48), "open": ("self_check", "running", 92)}
    got = {}
    for r in _collect(sf.job_states(_stream(spark, df, tmp_path / "in", cuts, "ts"), 10, 5, event_time=True), tmp_path / "state", "update"):
        got[r.job_id] = (r.phase, r.status, r.progress)
    assert got == want


def test_a_silent_job_is_closed_by_the_wall_clock(spark, tmp_path):
    sf.use_keyed_state(spark)
    df = _events(spark).where("job_id in ('silent', 'failed')")
    parts = []
    stream = sf.job_states(_stream(spark, df, tmp_path / "in", [3], "ts"), 2, 1)
    q = (stream.writeStream.outputMode("update").foreachBatch(lambda b, e: parts.extend(b.collect()))
         .option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start())
    stop = time.time() + 60
    while time.time() < stop and not any(r.status == "stalled" for r in parts):
        time.sleep(0.5)
    time.sleep(4)
    q.stop()
    assert [(r.job_id, r.status) for r in parts if r.status == "stalled"] == [("silent", "stalled")]
    assert [r.status for r in parts if r.job_id == "failed"] == ["failed"]
    left = spark.read.format("statestore").option("stateVarName", "job").load(str(tmp_path / "state"))
    assert left.count() == 0  # nothing is kept of dead jobs
