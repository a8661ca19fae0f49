"""Corrected text (P18, C1-C6): eligible fixes, application, range shifts, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redpencil.functions.exprs import chunks, cut, fresh, let, running, scan
from redpencil.operators.candidates import scope

KEY = ["source_type", "source_id"]
_ITEM = "struct<s:int,e:int,g:string>"
_SEGMENT = "struct<seg_start:int,seg_end:int,issue_id:string>"


def eligible(mode: str) -> str:
    """Accepted fixes always; open ones by mode."""
    open_ok = {"accepted_only": "false", "definite": "(is_definite and confidence >= 0.85)", "all_open": "true"}[mode]
    return (f"(span_start is not null and original <> suggestion and "
            f"(status = 'accepted' or (status = 'open' and {open_ok})))")


def accepted_patches(issues: DataFrame, content: DataFrame, mode: str) -> DataFrame:
    """The fixes that would be applied: right to left, quote verified, no overlap.

    One row per text with ``text`` and ``patches`` sorted by position.
    """
    key = scope(KEY, issues, content)
    e = issues.where(eligible(mode)).select(*key, "issue_id", "span_start", "span_end", "original", "suggestion")
    t = content.select(*key, "text")
    item = F.struct((-F.col("span_start")).alias("o"), F.col("issue_id"), F.col("span_start").alias("s"),
                    F.col("span_end").alias("e"), F.col("suggestion").alias("g"), F.col("original").alias("q"))
    # a text meets all its fixes at once, not each of them
    per = e.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("c")).join(t, key)
    x = fresh("x")
    quoted = let(chunks("text"), lambda p: f"filter(c, {x} -> {cut(p, 'text', f'{x}.s', f'{x}.e - {x}.s')} = {x}.q)")
    y, i, z = fresh("y"), fresh("i"), fresh("z")
    # a fix is taken where it ends at or before the start of the one taken last
    kept = let(quoted, lambda v: let(
        f"if(size({v}) = 0, cast(array() as array<int>), {running(v, '2147483647', lambda st, x: f'if({x}.e > {st}, {st}, {x}.s)')})",
        lambda last: f"filter({v}, ({y}, {i}) -> {y}.e <= {last}[{i}])"))
    found = per.select(*key, F.expr(f"transform(reverse({kept}), {z} -> named_struct('o', {z}.o, 'issue_id', {z}.issue_id, 's', {z}.s, 'e', {z}.e, 'g', {z}.g))").alias("patches"))
    return found.where("size(patches) > 0")


def apply_patches(issues: DataFrame, content: DataFrame, mode: str = "definite") -> DataFrame:
    """Corrected text of every content row, with the applied issue ids."""
    p = accepted_patches(issues, content, mode)
    j = content.join(p, scope(KEY, content, p), "left")
    x, y = fresh("x"), fresh("y")
    pieces = lambda p: scan(
        "patches", "0", "string",
        lambda st, v: f"{v}.e",
        lambda st, v: f"array({cut(p, 'text', st, f'{v}.s - {st}')}, {v}.g)",
    )
    whole = (f"case when patches is null then text else "
             f"transform(array({let(chunks('text'), pieces)}), {x} -> concat(array_join({x}.out, ''), substring(text, {x}.st + 1)))[0] end")
    return (j.withColumn("corrected", F.expr(whole))
            .withColumn("applied", F.expr(
                f"coalesce(transform(patches, {y} -> {y}.issue_id), cast(array() as array<string>))"))
            .drop("patches"))


def shift_ranges(issues: DataFrame, applied: DataFrame) -> DataFrame:
    """After patches, later issues move and overlapped ones are resolved.

    ``applied``: (issue_id) of patched issues, with workspace_id where the issues carry one. The shift
    of an issue is the sum of length changes of the patches that end before it.  All frames run from
    the start of their order, so a text costs the sort of its issues.
    """
    own = scope(["issue_id"], issues, applied)
    a = applied.select(*own, F.lit(True).alias("_hit")).distinct()
    i = issues.join(a, own, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    target = scope(["source_type", "source_id", "artboard_id", "box_id"], issues)
    delta = F.when(F.col("_hit"), F.length("suggestion") - (F.col("span_end") - F.col("span_start"))).otherwise(0)
    # Patches do not overlap, so "ends at or before my start" is a prefix in end order.
    ends = i.select("*", F.col("span_end").alias("_at"), delta.alias("_d"), F.lit(0).alias("_q"))
    asks = i.select("*", F.col("span_start").alias("_at"), F.lit(0).alias("_d"), F.lit(1).alias("_q"))
    w = W.partitionBy(*target).orderBy("_at", "_q").rowsBetween(W.unboundedPreceding, 0)
    events = ends.unionByName(asks).withColumn("_shift", F.sum("_d").over(w))
    # The patch that starts last before this issue decides overlap on the left, the next one on the right.
    up = W.partitionBy(*target).orderBy("span_start", "span_end").rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy(*target).orderBy(F.desc("span_start"), F.desc("span_end")).rowsBetween(W.unboundedPreceding, -1)
    nxt = F.min(F.when(F.col("_hit"), F.col("span_start"))).over(down)
    prv = F.max(F.when(F.col("_hit"), F.col("span_end"))).over(up)
    out = events.where("_q = 1").withColumn("_next", nxt).withColumn("_prev", prv)
    stale = F.expr("not _hit and span_start is not null and (coalesce(_next < span_end, false) "
                   "or coalesce(_prev > span_start, false))")
    return (out.withColumn("status", F.when(F.col("_hit"), "accepted").when(stale, "resolved").otherwise(F.col("status")))
            .withColumn("span_end", F.expr("if(_hit, null, span_end + _shift)"))
            .withColumn("span_start", F.expr("if(_hit, null, span_start + _shift)"))
            .select(*issues.columns))


def segments(issues: DataFrame, content: DataFrame) -> DataFrame:
    """Cut each text into plain and highlighted parts (open issues in order;
    overlapping or stale ranges are skipped).  Parts concatenate to the text."""
    o = issues.where("source_type = 'caption' and status = 'open' and span_start is not null")
    item = F.struct(F.col("span_start").alias("s"), F.col("span_end").alias("e"), "issue_id")
    key = scope(KEY, issues, content)
    per = o.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("c"))
    j = content.select(*key, "text", F.length("text").alias("n")).join(per, key, "left").withColumn(
        "c", F.expr("coalesce(c, cast(array() as array<struct<s:int,e:int,issue_id:string>>))"))
    seg = lambda s, e, i: f"named_struct('seg_start', {s}, 'seg_end', {e}, 'issue_id', {i})"
    skip = lambda st, x: f"({x}.s < {st} or {x}.e > n)"
    null_id = "cast(null as string)"
    folded = scan(
        "c", "0", _SEGMENT,
        lambda st, x: f"if({skip(st, x)}, {st}, {x}.e)",
        lambda st, x: (f"case when {skip(st, x)} then cast(array() as array<{_SEGMENT}>) "
                       f"when {x}.s > {st} then array({seg(st, f'{x}.s', null_id)}, {seg(f'{x}.s', f'{x}.e', f'{x}.issue_id')}) "
                       f"else array({seg(f'{x}.s', f'{x}.e', f'{x}.issue_id')}) end"),
    )
    f = fresh("f")
    parts = (f"transform(array({folded}), {f} -> if({f}.st < n, "
             f"concat({f}.out, array({seg(f'{f}.st', 'n', null_id)})), {f}.out))[0]")
    v = fresh("v")
    texts = let(chunks("text"), lambda p: (
        f"transform({parts}, {v} -> named_struct('segment', {cut(p, 'text', f'{v}.seg_start', f'{v}.seg_end - {v}.seg_start')}, 'issue_id', {v}.issue_id))"))
    return (j.select(*key, F.posexplode(F.expr(texts)).alias("pos", "p"))
            .select(*key, "pos", F.col("p.segment").alias("segment"),
                    F.col("p.issue_id").alias("issue_id")))


def preview(issues: DataFrame, content: DataFrame) -> DataFrame:
    """Corrected text and decision counts per text."""
    key = scope(KEY, issues, content)
    counts = issues.groupBy(*key).agg(
        F.count_if(F.col("status") == "accepted").alias("accepted"),
        F.count_if(F.col("status") == "ignored").alias("ignored"),
        F.count_if((F.col("severity") == "needs_review") & (F.col("status") == "open")).alias("needs_review"))
    fixed = apply_patches(issues, content, "definite").select(*key, "corrected", F.size("applied").alias("pending"))
    return fixed.join(counts, key, "left").na.fill(0, ["accepted", "ignored", "needs_review"])
