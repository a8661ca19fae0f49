"""Summaries and reports over issue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redpencil.functions import text as tx
from redpencil.functions.exprs import lit
from redpencil.operators.batches import numbered
from redpencil.operators.structure_rules import date_tokens, reformat_date

ACTIVE = "status not in ('ignored', 'resolved')"
OPEN = "status in ('open', 'needs_human_review')"

# Labels of categories, violations and final statuses.
CATEGORY = (
    "case when type = 'spacing' then 'Spacing' when type = 'punctuation' then 'Punctuation' "
    "when type = 'hashtag' then 'Hashtag' when type in ('brand_term', 'terminology') then 'Brand Style' "
    "when type = 'ocr_low_confidence' then 'Đọc chữ trên ảnh' "
    "when type in ('layout_risk', 'platform_format') then 'Layout' "
    "when lower(reason) like '%dấu tiếng việt%' or lower(reason) like '%thiếu dấu%' then 'Vietnamese Tone' "
    "when type = 'spelling' then 'Spelling' when type = 'grammar' then 'Grammar' else 'Style' end")

VIOLATION = (
    "case type when 'brand_term' then 'Sai tên thương hiệu / Brand Style' when 'spacing' then 'Sai khoảng trắng' "
    "when 'punctuation' then 'Sai dấu câu' when 'spelling' then 'Sai chính tả tiếng Việt' "
    "when 'hashtag' then 'Sai format hashtag' when 'grammar' then 'Sai ngữ pháp / từ lặp' "
    f"when 'ocr_low_confidence' then 'Chữ trên ảnh cần kiểm tra' else {CATEGORY} end")

FINAL_STATUS = (f"case when coalesce(bool_or({OPEN} and severity = 'needs_review'), false) then 'Cần review' "
                f"when coalesce(bool_or({OPEN}), false) then 'Vi phạm' else 'Đạt chuẩn' end")


def summary(issues: DataFrame, by: list[str]) -> DataFrame:
    """A1: counts per group, with severity and source maps."""
    a = issues.where(ACTIVE)
    total = a.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_issues"), F.count_if("is_definite").alias("definite_errors"),
        F.count_if(F.expr("not is_definite and severity <> 'needs_review'")).alias("suggestions"),
        F.count_if(F.expr("severity = 'needs_review'")).alias("needs_review"),
        *[F.count_if(F.col("severity") == s).alias(f"_s_{s}") for s in tx.SEVERITIES],
        *[F.count_if(F.col("source_type") == s).alias(f"_o_{s}") for s in ("caption", "image", "layout")])

    def as_map(prefix, names):
        pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"{prefix}{n}").alias("v")) for n in names])
        return F.map_from_entries(F.filter(pairs, lambda p: p["v"] > 0))

    return (total.withColumn("by_severity", as_map("_s_", tx.SEVERITIES))
            .withColumn("by_source", as_map("_o_", ("caption", "image", "layout")))
            .select(*by, "total_issues", "definite_errors", "suggestions", "needs_review", "by_severity", "by_source"))


def sessions(content: DataFrame, issues: DataFrame, assets: DataFrame | None = None, input_chars: int | None = None) -> DataFrame:
    """A2, A3: one row per text (and asset) with counts and final status; the text is shown whole or
    up to ``input_chars`` characters."""
    key = ["workspace_id", "source_type", "source_id"]
    i = issues.withColumn("category", F.expr(CATEGORY))
    per_cat = i.groupBy(*key, "category").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"bool_or({OPEN} and severity = 'needs_review')").alias("review"),
        F.expr(f"bool_or({OPEN})").alias("open"))
    per = per_cat.groupBy(*key).agg(
        F.sum("n").alias("issue_count"), F.max("review").alias("review"), F.max("open").alias("open"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("category_counts"))
    has_images = (assets.select("workspace_id").distinct().withColumn("_img", F.lit(True)) if assets is not None else None)
    c = content.where("trim(text) <> ''").select(
        *key, F.expr("trim(text)" if input_chars is None else f"substring(trim(text), 1, {input_chars})").alias("user_input"))
    if has_images is not None:
        c = c.join(has_images, "workspace_id", "left").withColumn(
            "format", F.expr("if(_img, 'Text + Image', 'Text')")).withColumn(
            "format", F.coalesce("format", F.lit("Text"))).drop("_img")
        c = c.withColumn("forced", F.lit(False)).unionByName(assets.select(
            "workspace_id", F.lit("image").alias("source_type"), F.col("asset_id").alias("source_id"),
            F.col("filename").alias("user_input"), F.lit("Image").alias("format"),
            F.expr("ocr_status in ('failed', 'low_confidence')").alias("forced")))
    else:
        c = c.withColumn("format", F.lit("Text")).withColumn("forced", F.lit(False))
    j = c.join(per, key, "left")
    return j.select(
        *key, "format", "user_input", F.expr("coalesce(issue_count, 0)").alias("issue_count"), "category_counts",
        F.expr("case when forced or coalesce(review, false) then 'Cần review' when coalesce(open, false) "
               "then 'Vi phạm' else 'Đạt chuẩn' end").alias("final_status"))


def kpis(sess: DataFrame, by: list[str]) -> DataFrame:
    """Volume, content mix, first-pass yield, activity estimate."""
    pct = lambda c: f"cast(floor(100.0D * {c} / greatest(total, 1) + 0.5D) as int)"
    g = sess.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("format") == "Text").alias("text_only"),
        F.count_if(F.col("format") == "Text + Image").alias("text_image"),
        F.count_if(F.col("format") == "Image").alias("image_only"),
        F.count_if(F.col("issue_count") == 0).alias("clean"), F.sum("issue_count").alias("issues"))
    return g.select(
        "*", F.expr(pct("text_only")).alias("text_only_percent"), F.expr(pct("text_image")).alias("text_image_percent"),
        F.expr("floor(1000.0D * clean / greatest(total, 1) + 0.5D) / 10D").alias("fpy_percent"),
        F.expr("greatest(1D, least(480D, total * 7 + issues * 0.75D + 12))").alias("active_minutes"))


def activity(workspaces: DataFrame, sess: DataFrame, issues: DataFrame, runs: DataFrame, by: list[str], at: str) -> DataFrame:
    """Estimated minutes, with twelve only where a run was traced, and their average per day from
    ``created_at`` of ``workspaces`` to ``at``; one row per workspace."""
    total = sess.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    found = issues.groupBy(*by).agg(F.count(F.lit(1)).alias("_issues"))
    traced = runs.select(*by).distinct().withColumn("_run", F.lit(True))
    j = workspaces.join(total, by, "left").join(found, by, "left").join(traced, by, "left")
    minutes = "coalesce(_total, 0) * 7 + coalesce(_issues, 0) * 0.75D + if(coalesce(_run, false), 12, 0)"
    days = f"(unix_millis(cast({lit(at)} as timestamp)) - unix_millis(cast(created_at as timestamp))) / 86400000D"
    return (j.withColumn("active_minutes", F.expr(f"greatest(1D, least(480D, {minutes}))"))
            .withColumn("active_days", F.expr(f"greatest(1, cast(ceil({days}) as bigint))"))
            .select(*by, "active_minutes", "active_days", F.expr("active_minutes / active_days").alias("daily_minutes")))


def top_violations(issues: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """Most frequent violations with their share.

    Counts first (a handful of labels per group), ranks afterwards; a group
    with fewer kinds is padded with empty rows.
    """
    n = issues.groupBy(*by, F.expr(VIOLATION).alias("label")).agg(F.count(F.lit(1)).alias("violations"))
    all_ = W.partitionBy(*by)
    rank = F.row_number().over(all_.orderBy(F.desc("violations"), "label"))
    top = (n.withColumn("percent", F.expr("cast(floor(100.0D * violations / sum(violations) over "
                                          f"(partition by {', '.join(by)}) + 0.5D) as int)"))
           .withColumn("rank", rank).where(F.col("rank") <= k))
    slots = n.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return (slots.join(top, [*by, "rank"], "left")
            .select(*by, "rank", F.coalesce("label", F.lit("Không phát sinh thêm nhóm lỗi")).alias("label"),
                    F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("percent", F.lit(0)).alias("percent")))


def category_frequency(issues: DataFrame, by: list[str]) -> DataFrame:
    """A7."""
    return issues.groupBy(*by, F.expr(CATEGORY).alias("category")).agg(F.count(F.lit(1)).alias("issues"))


def peak_hours(events: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """Busiest hour as a two-hour window."""
    h = events.groupBy(*by, F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    best = h.groupBy(*by).agg(F.max_by(F.struct("hour", "n"), F.struct("n", -F.col("hour"))).alias("b"))
    return best.select(*by, F.expr("format_string('%02d:00 - %02d:00', b.hour, (b.hour + 2) % 24)").alias("peak_hours"),
                       F.col("b.n").alias("sessions"))


def step_duration(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """A10: mean duration of timed steps, else the run's wall time, in seconds."""
    s = steps.where("duration_ms > 0").groupBy("run_id").agg(F.avg("duration_ms").alias("ms"))
    wall = "greatest(0D, cast(unix_millis(completed_at) - unix_millis(started_at) as double))"
    return runs.join(s, "run_id", "left").select(
        "run_id", F.expr(f"coalesce(ms, {wall}, 0D) / 1000D").alias("seconds"))


# States of a step.
STEP_STATES = ("running", "completed", "failed", "skipped")


def run_trace(steps: DataFrame, by: tuple[str, ...] = ("run_id", "step")) -> DataFrame:
    """Steps by state, the items they counted and their durations, per run and step or per ``by``.

    ``steps``: (run_id, step, status, duration_ms, items); a step that was skipped or still runs has no duration.
    """
    return steps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("steps"), *[F.count_if(F.col("status") == s).alias(s) for s in STEP_STATES],
        F.sum("items").alias("items"), F.count("duration_ms").alias("timed"), F.sum("duration_ms").alias("duration_ms"),
        F.max("duration_ms").alias("longest_ms"))


def insights(k: DataFrame, top: DataFrame, peaks: DataFrame, by: list[str]) -> DataFrame:
    """Up to four sentences per group."""
    lead = top.where("rank = 1").select(*by, "label", "violations", "percent")
    j = k.join(lead, by, "left").join(peaks, by, "left")
    items = ("array_compact(array("
             "if(coalesce(violations, 0) > 0, concat('Train on: ', label, ' (', percent, '%).'), 'Input quality is stable.'), "
             "concat('Content is mostly reviewed in ', coalesce(peak_hours, '09:00 - 11:00'), '.'), "
             "if(fpy_percent < 70, 'First-pass yield is low: add a checklist before upload.', null), "
             "if(text_image_percent > 50, 'Many texts come with images: watch image text.', null)))")
    return j.select(*by, F.expr(f"slice({items}, 1, 4)").alias("insights"))


def issue_groups(labelled: DataFrame, show_done: bool = False, by: tuple[str, ...] = ("workspace_id",)) -> DataFrame:
    """Open issues numbered per card of a workspace, severe ones first.

    The rows are sorted over ranges, so a card may hold any number of issues and needs no task for itself.
    """
    rows = labelled if show_done else labelled.where(OPEN)
    ranked = rows.withColumn("_card", F.struct(*by, "card_key")).withColumn("_rank", F.expr(tx.severity_rank("severity")))
    return numbered(ranked, "_card", ["_rank", "issue_id"]).withColumn("position", (F.col("place") + 1).cast("int")).drop("_card", "_rank", "place")


def coverage(targets: DataFrame, issues: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Open and manual counts and coverage status per target.

    ``targets``: (target, deep_running); ``issues`` carry ``target``;
    ``assets``: (target, ocr_status, boxes).
    """
    manual = f"{OPEN} and {tx.needs_manual_check('severity', 'status', 'type')}"
    i = issues.groupBy("target").agg(F.count_if(F.col("status") == "open").alias("open_count"),
                                     F.count_if(F.expr(manual)).alias("manual_count"))
    j = targets.join(i, "target", "left").na.fill(0, ["open_count", "manual_count"])
    if assets is not None:
        a = assets.groupBy("target").agg(
            F.expr("bool_or(ocr_status = 'failed')").alias("failed"),
            F.expr("bool_or(ocr_status = 'low_confidence' or boxes = 0)").alias("doubtful"))
        j = j.join(a, "target", "left")
    else:
        j = j.withColumn("failed", F.lit(False)).withColumn("doubtful", F.lit(False))
    return j.select("target", "open_count", "manual_count", F.expr(
        "case when deep_running then 'still_checking' when failed then 'could_not_fully_read' "
        "when doubtful or manual_count > 0 then 'needs_review' else 'checked' end").alias("coverage"))


def workspace_index(ws: DataFrame) -> DataFrame:
    """Latest summary row per workspace."""
    return ws.groupBy("workspace_id").agg(F.max_by(F.struct("name", "kind"), "updated_at").alias("w"),
                                          F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at")
                                          ).select("workspace_id", "w.name", "w.kind", "created_at", "updated_at")


# -- date formats across a workspace (X1, X2) -----------------------------------------

def date_candidates(content: DataFrame, id_cols: list[str]) -> DataFrame:
    d = content.select(*id_cols, F.expr(f"inline_outer({date_tokens('text')})")).where("s is not null")
    return d


def date_standard(tokens: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Most frequent format per workspace, the first seen on a tie; only
    where at least two formats compete."""
    g = tokens.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    w = W.partitionBy(*by)
    return (g.withColumn("formats", F.count(F.lit(1)).over(w))
            .withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "first")))
            .where("rank = 1 and formats > 1").select(*by, F.col("key").alias("standard")))


def date_issues(tokens: DataFrame, standard: DataFrame, by: list[str]) -> DataFrame:
    """Tokens not in the workspace's format, rewritten in it."""
    tok = "named_struct('d', d, 'm', m, 'y', y)"
    from redpencil.functions.exprs import let
    j = tokens.join(standard, by).where("key <> standard")
    return (j.withColumn("suggestion", F.expr(let(tok, lambda v: reformat_date(v, "standard"))))
            .where("lower(o) <> lower(suggestion)"))


# -- sinks ---------------------------------------------------------------------------

def markdown_lines(issues: DataFrame, by: list[str]) -> DataFrame:
    """Report lines in order, one row per line (write with ``write.text``
    after sorting within the workspace): a heading per severity, then its issues."""
    live = issues.where("status <> 'resolved'").withColumn("sev", F.expr(tx.severity_rank("severity")))
    heads = live.groupBy(*by, "sev", "severity").agg(F.count(F.lit(1)).alias("n")).select(
        *by, "sev", F.lit("").alias("source_id"), F.lit(-1).alias("pos"),
        F.expr("concat('## ', upper(severity), ' (', n, ')')").alias("line"))
    rows = live.select(
        *by, "sev", "source_id", F.coalesce("span_start", F.lit(0)).alias("pos"),
        F.expr("concat('- **[', source_type, ']** `', original, '` → `', suggestion, '` — ', reason, "
               "if(status <> 'open', concat(' _(', status, ')_'), ''))").alias("line"))
    ignored = issues.where("status = 'ignored'").select(
        *by, F.lit(9).alias("sev"), "source_id", F.coalesce("span_start", F.lit(0)).alias("pos"),
        F.expr("concat('- `', original, '` — ', reason)").alias("line"))
    return heads.unionByName(rows).unionByName(ignored)


# Labels of sources in a report.
SOURCE_LABEL = "case source_type when 'caption' then 'Caption' when 'image' then 'Ảnh' when 'layout' then 'Layout' else source_type end"
REPORT_ORDER = ["part", "at", "source_id", "pos", "line"]


def report_lines(workspaces: DataFrame, issues: DataFrame, corrected: DataFrame, by: list[str], generated_at: str) -> DataFrame:
    """The lines of whole reports, in the order of ``REPORT_ORDER``: title, overview, count per source,
    a part per severity, corrected captions, ignored issues.

    ``workspaces``: by, name; ``corrected``: by, source_id, corrected, one per caption (C1).
    """
    def lines(df, part, at, line, source="''", pos="0"):
        return df.select(*by, F.expr(f"cast({part} as int)").alias("part"), F.expr(f"cast({at} as int)").alias("at"),
                         F.expr(f"coalesce({source}, '')").alias("source_id"), F.expr(f"cast({pos} as int)").alias("pos"),
                         F.expr(line).alias("line"))

    s = workspaces.select(*by, "name").join(summary(issues, by), by, "left").na.fill(
        0, ["total_issues", "definite_errors", "suggestions", "needs_review"])
    # The report's headings and line forms.
    top = ["concat('# QA Report — ', coalesce(name, ''))", "''", f"concat('Tạo lúc: ', {lit(generated_at)})", "''",
           "'## Tổng quan'", "''", "concat('- Tổng số issue: **', total_issues, '**')",
           "concat('- Lỗi chắc chắn: **', definite_errors, '**')", "concat('- Gợi ý: ', suggestions)",
           "concat('- Cần người review: ', needs_review)", "''", "'| Nguồn | Số issue |'", "'|---|---:|'"]
    head = s.select(*by, F.posexplode(F.expr(f"array({', '.join(top)})")).alias("i", "l"))
    per = issues.where(ACTIVE).groupBy(*by, "source_type").agg(F.count(F.lit(1)).alias("n"))
    rank = f"coalesce({tx.severity_rank('severity')}, 9)"
    live = issues.where("status <> 'resolved'")
    group = live.groupBy(*by, "severity").agg(F.count(F.lit(1)).alias("n"))
    text = corrected.where("trim(corrected) <> ''")
    ignored = issues.where("status = 'ignored'")
    passed = ignored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    once = text.select(*by).distinct()
    parts = [
        lines(head, 0, 0, "l", pos="i"),
        lines(per, 1, 0, f"concat('| ', {SOURCE_LABEL}, ' | ', n, ' |')", source="source_type"), lines(s, 1, 1, "''"),
        lines(group, f"10 + {rank}", 0, "concat('## ', upper(severity), ' (', n, ')')"),
        lines(group, f"10 + {rank}", 0, "''", pos="1"),
        lines(live, f"10 + {rank}", 1, f"concat('- **[', {SOURCE_LABEL}, ']** `', coalesce(original, ''), '` → `', coalesce(suggestion, ''), "
              "'` — ', coalesce(reason, ''), if(status <> 'open', concat(' _(', status, ')_'), ''))",
              source="source_id", pos="coalesce(span_start, 0)"),
        lines(group, f"10 + {rank}", 2, "''"),
        lines(once, 30, 0, "'## Caption đã sửa'"), lines(once, 30, 0, "''", pos="1"),
        lines(text, 30, 1, "'```'", source="source_id"), lines(text, 30, 1, "corrected", source="source_id", pos="1"),
        lines(text, 30, 1, "'```'", source="source_id", pos="2"), lines(text, 30, 1, "''", source="source_id", pos="3"),
        lines(passed, 40, 0, "concat('## Đã bỏ qua (', n, ')')"), lines(passed, 40, 0, "''", pos="1"),
        lines(ignored, 40, 1, "concat('- `', coalesce(original, ''), '` — ', coalesce(reason, ''))", source="source_id",
              pos="coalesce(span_start, 0)"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_report(lines: DataFrame, by: list[str], path: str) -> None:
    """A folder per workspace with its report in files that follow each other by name; a large report
    is cut into ranges, and a later write leaves other workspaces."""
    order = [*by, *REPORT_ORDER]
    (lines.repartitionByRange(*order).sortWithinPartitions(*order)
     .select(*by, F.col("line").alias("value")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*by).text(path))


def report_records(workspaces: DataFrame, issues: DataFrame, corrected: DataFrame, monthly: DataFrame, by: list[str],
                   generated_at: str) -> DataFrame:
    """Whole reports as JSON records (by, section, body): workspace, summary, every issue, every
    corrected caption and the monthly report; a record per row, so no report is gathered in one place.

    ``monthly``: by and any columns, a row per workspace.
    """
    def records(df, section):
        return df.select(*by, F.lit(section).alias("section"), F.to_json(F.struct(*df.columns)).alias("body"))

    named = workspaces.select(*by, "name").withColumn("generated_at", F.lit(generated_at))
    totals = workspaces.select(*by).join(summary(issues, by), by, "left").na.fill(
        0, ["total_issues", "definite_errors", "suggestions", "needs_review"])
    return (records(named, "workspace").unionByName(records(totals, "summary")).unionByName(records(issues, "issue"))
            .unionByName(records(corrected.select(*by, "source_id", "corrected"), "corrected"))
            .unionByName(records(monthly, "monthly_report")))


def write_report_json(records: DataFrame, by: list[str], path: str) -> None:
    """A folder per workspace and section; a later write leaves other workspaces."""
    (records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "section").json(path))


def detailed_log(sess: DataFrame) -> DataFrame:
    """The detailed log sheet."""
    groups = ("coalesce(nullif(array_join(transform(map_entries(category_counts), "
              "e -> concat(e.key, ': ', e.value)), '; '), ''), 'Không có')")
    return sess.select("workspace_id", "source_type", "source_id", "format", "user_input", "issue_count",
                       F.expr(groups).alias("groups"), "final_status")


def dashboard(k: DataFrame, by: list[str]) -> DataFrame:
    """The dashboard sheet, one KPI per row."""
    cols = ["total", "text_only_percent", "text_image_percent", "fpy_percent", "active_minutes"]
    stack = ", ".join(f"'{c}', cast({c} as double)" for c in cols)
    return k.select(*by, F.expr(f"stack({len(cols)}, {stack}) as (metric, value)"))
