"""Report sinks, activity, run trace and lexicon append against small fixtures."""

from redpencil.operators import decisions as dc
from redpencil.plans import report as rp

ISSUE = ("workspace_id string, issue_id string, source_type string, source_id string, severity string, original string, "
         "suggestion string, reason string, is_definite boolean, span_start int, status string")
ISSUES = [("w", "i1", "caption", "s", "high", "a", "b", "r", True, 4, "open"), ("w", "i2", "image", "t", "low", "c", "d", "q", False, 1, "ignored"),
          ("w", "i3", "caption", "s", "high", "e", "f", "r", True, 2, "accepted"), ("w", "i4", "caption", "s", "high", "x", "y", "r", True, 1, "resolved")]


def tables(spark):
    return (spark.createDataFrame([("w", "One", "2026-01-01 00:00:00"), ("v", "Two", "2026-01-10 12:00:00")], "workspace_id string, name string, created_at string"),
            spark.createDataFrame(ISSUES, ISSUE),
            spark.createDataFrame([("w", "s", "good\ntext"), ("v", "s", " ")], "workspace_id string, source_id string, corrected string"))


def test_markdown_report_is_whole_and_in_order(spark, tmp_path):
    ws, issues, fixed = tables(spark)
    path = str(tmp_path / "report")
    rp.write_report(rp.report_lines(ws, issues, fixed, ["workspace_id"], "now"), ["workspace_id"], path)
    text = lambda w: "".join(f.read_text() for f in sorted((tmp_path / "report" / f"workspace_id={w}").glob("part-*")))
    empty = "# QA Report — {}\n\nTạo lúc: now\n\n## Tổng quan\n\n- Tổng số issue: **{}**\n- Lỗi chắc chắn: **{}**\n- Gợi ý: 0\n- Cần người review: 0\n\n| Nguồn | Số issue |\n|---|---:|\n"
    assert text("v") == empty.format("Two", 0, 0) + "\n"
    assert text("w") == (empty.format("One", 2, 2) + "| Caption | 2 |\n\n## HIGH (2)\n\n- **[Caption]** `e` → `f` — r _(accepted)_\n- **[Caption]** `a` → `b` — r\n\n"
                         "## LOW (1)\n\n- **[Ảnh]** `c` → `d` — q _(ignored)_\n\n## Caption đã sửa\n\n```\ngood\ntext\n```\n\n## Đã bỏ qua (1)\n\n- `c` — q\n")


def test_json_report_holds_issues_text_and_report(spark, tmp_path):
    ws, issues, fixed = tables(spark)
    month = ws.selectExpr("workspace_id", "7 as total")
    rp.write_report_json(rp.report_records(ws, issues, fixed, month, ["workspace_id"], "now"), ["workspace_id"], str(tmp_path / "json"))
    got = {(r.workspace_id, r.section): r["count"] for r in spark.read.json(str(tmp_path / "json")).groupBy("workspace_id", "section").count().collect()}
    assert got == {("w", "issue"): 4} | {(w, s): 1 for w in "wv" for s in ("workspace", "summary", "corrected", "monthly_report")}


def test_activity_has_twelve_minutes_for_a_run_and_a_daily_average(spark):
    ws, issues, _ = tables(spark)
    sess = spark.createDataFrame([("w",), ("w",)], "workspace_id string")
    got = {r.workspace_id: tuple(r)[1:] for r in rp.activity(ws, sess, issues, ws.where("workspace_id = 'w'"), ["workspace_id"], "2026-01-11 00:00:00").collect()}
    assert got == {"w": (29.0, 10, 2.9), "v": (1.0, 1, 1.0)}


def test_run_trace_counts_states_and_durations(spark):
    steps = spark.createDataFrame([(1, "ocr", "completed", 5, 2), (1, "ocr", "failed", 9, None), (1, "merge", "skipped", None, None)],
                                  "run_id int, step string, status string, duration_ms long, items int")
    one = rp.run_trace(steps, ("run_id",)).first()
    assert (one.steps, one.running, one.completed, one.failed, one.skipped, one["items"], one.timed, one.duration_ms, one.longest_ms) == (3, 0, 1, 1, 1, 2, 2, 14, 9)
    assert rp.run_trace(steps).count() == 2


def test_terms_are_appended_once_and_pairs_overwrite(spark):
    lex = spark.createDataFrame([("brand_terms", None, "A", None, 0), ("product_terms", "x", "y", None, 3)], "list string, wrong string, right string, priority string, ord int")
    new = spark.createDataFrame([("brand_terms", None, " A ", 0), ("brand_terms", None, "B", 1), ("product_terms", "x ", "z", 0), ("risky_words", "free", "gift", 0),
                                 ("product_terms", " ", "q", 1), ("brand_terms", None, None, 2)], "list string, wrong string, right string, ord int")
    out, rejects = dc.append_terms(lex, new)
    assert {tuple(r) for r in out.collect()} == {("brand_terms", None, "A", None, 0), ("brand_terms", None, "B", None, 2), ("product_terms", "x", "z", None, 3),
                                                 ("risky_words", "free", "gift", "medium", 0)}
    assert {(r.list, r.right) for r in rejects.collect()} == {("product_terms", "q"), ("brand_terms", None)}
