"""Externally proposed candidate issues: locate, validate, merge, agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redpencil.functions import text as tx
from redpencil.functions.exprs import contains, fresh, let, lit, overlaps
from redpencil.lexicon import Lexicon
from redpencil.operators import ranges as rg
from redpencil.operators.groups import connected, containing_pairs, kept_rows


def scope(base: list[str], *tables: DataFrame) -> list[str]:
    """The key of a text within its workspace; tables of a single workspace may leave workspace_id out."""
    return ["workspace_id", *base] if all("workspace_id" in t.columns for t in tables) else base


def located(text: str, original: str, before: str, after: str) -> str:
    """Start of a quote, or null.  Context picks among occurrences; without
    a context match the first occurrence counts."""
    b, a = f"coalesce({before}, '')", f"coalesce({after}, '')"
    with_context = f"instr({text}, concat({b}, {original}, {a}))"
    return (f"case when coalesce({original}, '') = '' or instr({text}, {original}) = 0 then null "
            f"when {with_context} > 0 then {with_context} - 1 + length({b}) "
            f"else instr({text}, {original}) - 1 end")


def heading_range(text: str) -> str:
    """The first line with text, if it is an all-capitals heading: struct(s, e)."""
    head = rf"^{tx.WS}*([^\n\r]+)"
    lead = f"length(regexp_extract({text}, {lit(rf'^{tx.WS}*')}, 0))"

    def run(h: str) -> str:
        letters = tx.letter_count(h)
        upper = f"regexp_count({h}, {lit(chr(92) + 'p{Lu}')})"
        lower = f"regexp_count({h}, {lit(chr(92) + 'p{Ll}')})"
        ok = (f"{letters} >= 2 and {lower} = 0 and {upper} >= 0.8 * {letters} "
              f"and {tx.word_count(h)} <= 14 and length({h}) <= 120")
        return f"if({ok}, named_struct('s', {lead}, 'e', {lead} + length({h})), null)"

    return let(tx.rtrim_ws(f"regexp_extract({text}, {lit(head)}, 1)"), run)


def _touches_protected(lex: Lexicon) -> str:
    """The edit would change a link or a protected term."""
    terms = lex.protected()
    known = "array(" + ", ".join(lit(t) for t in terms) + ")" if terms else "cast(array() as array<string>)"
    here = "named_struct('s', span_start, 'e', span_end)"
    u, t, p = fresh("u"), fresh("t"), fresh("p")
    in_url = f"exists(_urls, {u} -> {overlaps(here, u)})"
    norm = lambda x: f"lower(trim({x}))"
    case_fix = f"exists({known}, {t} -> {norm('original')} = lower({t}) and original <> {t} and suggestion = {t})"
    exact = f"(array_contains({known}, trim(original)) and suggestion <> original)"
    term_text = f"substring(text, {p}.s + 1, {p}.e - {p}.s)"
    breaks = (f"exists(_terms, {p} -> {overlaps(here, p)} and ({exact} or {contains(p, here)} "
              f"or ({contains(here, p)} and not contains(suggestion, {term_text}))))")
    return f"({in_url} or (not {case_fix} and {breaks}))"


def validate(candidates: DataFrame, content: DataFrame, lex: Lexicon) -> DataFrame:
    """Candidates whose quote exists and whose edit is allowed.

    Links and terms are found once per quoted text (semi-join first), then the
    candidates join on their workspace and source_id.
    """
    keys = scope(["source_id"], candidates, content)
    wanted = content.join(candidates.select(*keys).distinct(), keys, "left_semi")
    low = tx.folded("text")
    texts = (wanted.select(*keys, "text")
             .withColumn("_urls", F.expr(rg.url_ranges("text", low)))
             .withColumn("_terms", F.expr(rg.term_ranges(low, lex.protected())))
             .withColumn("_heading", F.expr(heading_range("text"))))
    c = candidates.where(
        "coalesce(original, '') <> '' and coalesce(suggestion, '') <> '' "
        "and type is not null and severity is not null and reason is not null")
    j = (c.join(texts, keys)
         .withColumn("span_start", F.expr(located("text", "original", "context_before", "context_after")))
         .where("span_start is not null")
         .withColumn("span_end", F.expr("span_start + length(original)"))
         .where(f"not {_touches_protected(lex)}"))
    letters = tx.letter_count("original")
    shouted = (f"(source_type = 'caption' and {tx.case_only_change('original', 'suggestion')} "
               f"and _heading is not null and span_start >= _heading.s and span_end <= _heading.e "
               f"and {letters} >= 2 and not original rlike {lit(chr(92) + 'p{Ll}')})")
    return (j.where(f"not coalesce({shouted}, false)")
            .withColumn("confidence", F.expr("coalesce(least(1D, greatest(0D, confidence)), 0.6D)"))
            .withColumn("is_definite", F.expr("coalesce(is_definite, false)"))
            .withColumn("context_before", F.expr(tx.context_before("text", "span_start")))
            .withColumn("context_after", F.expr(tx.context_after("text", "span_end")))
            .withColumn("status", F.lit("open"))
            .drop("text", "_urls", "_terms", "_heading"))


def validate_boxes(candidates: DataFrame, boxes: DataFrame, lex: Lexicon) -> DataFrame:
    """Candidates quoting a text box; the box must be checkable."""
    keys = scope(["box_id"], candidates, boxes)
    b = boxes.select(*keys, "asset_id", F.col("text").alias("box_text"), F.col("bbox").alias("box_bbox"),
                     F.col("confidence").alias("box_confidence"), "visual_role", "visual_should_check")
    j = (candidates.join(b, keys)
         .where("trim(box_text) <> '' and coalesce(visual_should_check, true) "
                "and coalesce(visual_role, 'unknown') in ('graphic_text', 'unknown')")
         .where("contains(box_text, original)")
         .where(tx.self_check_passes("self_check", "severity", "is_definite"))
         .withColumn("type", F.expr(tx.candidate_type("type")))
         .withColumn("severity", F.expr(tx.candidate_severity("severity")))
         .withColumn("suggestion", F.expr("coalesce(suggestion, original)"))
         .where(tx.compatible("original") != tx.compatible("suggestion"))
         .where(f"not (type in ('brand_term', 'style') and {tx.case_only_change('original', 'suggestion')})"))
    as_content = boxes.select(*keys[:-1], F.col("box_id").alias("source_id"), "text")
    checked = validate(
        j.withColumn("source_id", F.col("box_id")).withColumn("source_type", F.lit("image")), as_content, lex)
    return (checked.withColumn("source_id", F.col("asset_id"))
            .withColumn("bbox", F.expr(text_bbox("box_text", "box_bbox", "span_start", "span_end")))
            .withColumn("is_definite", F.expr("is_definite or (confidence >= 0.82 and severity <> 'suggestion')"))
            .drop("box_bbox", "box_confidence", "visual_role", "visual_should_check"))


def text_bbox(text: str, bbox: str, start: str, end: str) -> str:
    """Pixel box of a span, assuming even letter widths."""
    lead = f"length({text}) - length({tx.ltrim_ws(text)})"
    trail = f"length({text}) - length({tx.rtrim_ws(text)})"

    def run(lead_v: str) -> str:
        stop = f"greatest({lead_v} + 1, length({text}) - ({trail}))"

        def with_stop(stop_v: str) -> str:
            n = f"greatest(1, {stop_v} - {lead_v})"
            s = f"greatest({lead_v}, least({start}, {stop_v}))"
            e = f"greatest({s} + 1, least({end}, {stop_v}))"
            width = f"greatest(1D, {bbox}.x1 - {bbox}.x0)"
            pad = f"greatest(4D, floor({width} * 0.01D + 0.5D))"
            x0 = f"{bbox}.x0 + (({s}) - {lead_v}) / cast({n} as double) * {width}"
            x1 = f"{bbox}.x0 + (({e}) - {lead_v}) / cast({n} as double) * {width}"
            half_up = lambda v: f"cast(floor({v} + 0.5D) as double)"
            return (f"named_struct('x0', greatest({bbox}.x0, {half_up(f'{x0} - {pad}')}), 'y0', {bbox}.y0, "
                    f"'x1', least({bbox}.x1, {half_up(f'{x1} + {pad}')}), 'y1', {bbox}.y1)")
        return let(stop, with_stop)

    return f"if({start} is null or {start} < 0 or {end} <= {start}, {bbox}, {let(lead, run)})"


def signature() -> Column:
    """Identity of a candidate for the verifier."""
    return F.sha2(F.to_json(F.struct(
        "type", "severity", tx.compatible("original").alias("original"), tx.compatible("suggestion").alias("suggestion"), "source_type", "source_id",
        "artboard_id", "box_id")), 256)


def keep_verified(candidates: DataFrame, verdicts: DataFrame, answered: DataFrame | None = None,
                  keys: list[str] | None = None) -> DataFrame:
    """Keep candidates named by the verifier; sources it has not answered keep all of theirs.

    ``verdicts``: (keys, signature), ``answered``: (keys) of every source with an answer, also one
    that keeps nothing; it defaults to the sources of the verdicts.
    """
    keys = keys or scope(["source_id"], candidates, verdicts)
    c = candidates.withColumn("signature", signature())
    heard = (verdicts if answered is None else answered).select(*keys).distinct()
    kept = c.join(verdicts.select(*keys, "signature").distinct(), [*keys, "signature"], "left_semi").select(*c.columns)
    unheard = c.join(heard, keys, "left_anti").select(*c.columns)
    return kept.unionByName(unheard).drop("signature")


def overlap_islands(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number maximal groups of overlapping spans within ``keys``."""
    w = W.partitionBy(*keys).orderBy("span_start", "span_end")
    before = F.max("span_end").over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("span_start") >= before), 1).otherwise(0)
    return (df.withColumn("_opens", opens)
            .withColumn("island", F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_opens"))


def merge_issues(rules: DataFrame, candidates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rule issues win; among candidates a longer or more severe one
    replaces the first one it clashes with.

    ``candidates`` carries ``ord`` (arrival order).  Both sides share columns.
    The fold runs per island of overlapping candidates, never per source.
    """
    keys = keys or scope(["source_type", "source_id"], rules, candidates)
    r = rules.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("span_start").alias("rs"),
                     F.col("span_end").alias("re"), F.col("original").alias("ro"))
    same = [F.col(k) == F.col(f"r_{k}") for k in keys]
    clash = F.expr("(rs < span_end and span_start < re) or (ro = original and rs = span_start)")
    free = candidates.join(r, [*same, clash], "left_anti")
    shared = [c for c in rules.columns if c in candidates.columns and c != "ord"]
    item = F.struct("ord", *shared)
    groups = overlap_islands(free, keys).groupBy(*keys, "island").agg(F.array_sort(F.collect_list(item)).alias("c"))
    a, x, k, i, y = (fresh(n) for n in "axkiy")
    clashes = (f"(({k}.span_start < {x}.span_end and {x}.span_start < {k}.span_end) "
               f"or ({k}.original = {x}.original and {k}.span_start = {x}.span_start))")
    better = (f"({x}.span_end - {x}.span_start > {y}.span_end - {y}.span_start "
              f"or {tx.severity_rank(x + '.severity')} < {tx.severity_rank(y + '.severity')})")
    first = f"array_position(transform({a}, {k} -> {clashes}), true)"
    swapped = f"transform({a}, ({y}, {i}) -> if({i} + 1 = {first} and {better}, {x}, {y}))"
    fold = (f"aggregate(slice(c, 2, size(c)), slice(c, 1, 1), ({a}, {x}) -> "
            f"if({first} = 0, concat({a}, array({x})), {swapped}))")
    kept = groups.select(F.expr(f"inline(if(size(c) = 1, c, {fold}))")).select(*shared)
    return rules.select(*shared).unionByName(kept)


# -- related issues, unique push, clusters, consensus (J13-J16) -----------------------

def related(a: str, b: str) -> str:
    """J13 for two issues of one block (same source and box)."""
    ao, bo = tx.comparable(f"{a}.original"), tx.comparable(f"{b}.original")
    ag, bg = tx.comparable(f"{a}.suggestion"), tx.comparable(f"{b}.suggestion")
    caption = (f"({a}.source_type <> 'caption' or coalesce({a}.span_start < {b}.span_end "
               f"and {b}.span_start < {a}.span_end, false))")
    same = f"({ao} = {bo} and {ag} = {bg} and {a}.type = {b}.type)"
    nested = (f"((contains({ao}, {bo}) or contains({bo}, {ao})) "
              f"and (contains({ag}, {bg}) or contains({bg}, {ag})))")
    return f"({caption} and ({same} or {nested}))"


BLOCK = ["workspace_id", "source_type", "source_id", "box_id"]
# The stored issue row; columns an input lacks are null.
ISSUE_FIELDS = {
    "ord": "bigint", "workspace_id": "string", "issue_id": "string", "source_type": "string", "source_id": "string",
    "artboard_id": "string", "box_id": "string", "type": "string", "severity": "string", "original": "string",
    "suggestion": "string", "reason": "string", "confidence": "double", "is_definite": "boolean", "span_start": "int",
    "span_end": "int", "bbox": "struct<x0:double,y0:double,x1:double,y1:double>", "context_before": "string",
    "context_after": "string", "status": "string", "created_by": "string"}
ISSUE = list(ISSUE_FIELDS)
ISSUE_TYPE = "struct<" + ",".join(f"{k}:{t}" for k, t in ISSUE_FIELDS.items()) + ">"


def full_rows(issues: DataFrame) -> DataFrame:
    """Issues with exactly the stored columns."""
    return issues.select(*[(F.col(k) if k in issues.columns else F.lit(None)).cast(t).alias(k) for k, t in ISSUE_FIELDS.items()])


def _combine(old: str, new: str) -> str:
    """Fold ``new`` into the related issue ``old``."""
    narrower = (f"(length({new}.original) < length({old}.original) "
                f"and contains({tx.comparable(old + '.original')}, {tx.comparable(new + '.original')}))")
    pick = lambda c: f"if({narrower}, {new}.{c}, {old}.{c})"
    reason = pick("reason")
    creators = (f"if(array_contains(split({old}.created_by, '[+]'), {new}.created_by), {old}.created_by, "
                f"concat({old}.created_by, '+', {new}.created_by))")
    reasons = (f"if({new}.reason <> '' and not contains({reason}, {new}.reason), "
               f"concat({reason}, ' / ', {new}.created_by, ': ', {new}.reason), {reason})")
    severity = (f"if({tx.severity_rank(new + '.severity')} < {tx.severity_rank(old + '.severity')}, "
                f"{new}.severity, {old}.severity)")
    values = {k: f"{old}.{k}" for k in ISSUE} | {k: pick(k) for k in ("issue_id", "type", "original", "suggestion")} | {
        "severity": severity, "reason": reasons, "confidence": f"greatest({old}.confidence, {new}.confidence)",
        "is_definite": f"({old}.is_definite or {new}.is_definite)", "created_by": creators,
        "bbox": f"coalesce({pick('bbox')}, {new}.bbox)",
    }
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


def push_unique(existing: str, incoming: str) -> str:
    """Push issues one by one onto an array of unrelated issues."""
    a, x, k, y, i = (fresh(n) for n in "axkyi")
    first = f"array_position(transform({a}, {k} -> {related(k, x)}), true)"
    merged = let(first, lambda f: (
        f"if({f} = 0, concat({a}, array({x})), "
        f"transform({a}, ({y}, {i}) -> if({i} + 1 = {f}, {_combine(y, x)}, {y})))"))
    return f"aggregate({incoming}, {existing}, ({a}, {x}) -> {merged})"


def unique_issues(issues: DataFrame) -> DataFrame:
    """J14 over a table: one fold per block; caption blocks split by overlap.  Full issue rows."""
    g = _grouped(issues)
    fold = push_unique(f"cast(array() as array<{ISSUE_TYPE}>)", "c")
    return g.select(F.expr(f"inline({fold})"))


def nested_groups(rows: DataFrame) -> DataFrame:
    """``rows`` (full issues without a place in a text) with ``island``: issues that J13 can relate share one.

    Two such issues are related if one original holds the other and one suggestion the other. Equal
    pairs of texts are one node; nodes meet by rare runs of letters, so a block of any number of
    issues falls into the groups that its texts make. A combined issue carries the texts of one of
    its members, so what J14 to J16 do stays inside a group.
    """
    texts = [F.expr(tx.comparable("original")).alias("ao"), F.expr(tx.comparable("suggestion")).alias("ag")]
    fold = [F.coalesce(F.concat(F.lit("="), F.col(k)), F.lit("null")).alias(f"_{k}") for k in BLOCK]
    block = [f"_{k}" for k in BLOCK]
    keyed = rows.select(*rows.columns, *fold, *texts)
    nodes = kept_rows(keyed.groupBy(*block, "ao", "ag").agg(F.min(F.struct("ord", "issue_id")).alias("head")).withColumn(
        "node", F.monotonically_increasing_id()), "nodes")
    whole = nodes.where("ao is not null and ag is not null")
    pairs = containing_pairs(whole, block, "ao")
    ends = nodes.select("node", "ag")
    both = (pairs.join(ends.select(F.col("node").alias("a"), F.col("ag").alias("ag_a")).hint("merge"), "a")
            .join(ends.select(F.col("node").alias("b"), F.col("ag").alias("ag_b")).hint("merge"), "b")
            .where("contains(ag_a, ag_b) or contains(ag_b, ag_a)").select("a", "b"))
    groups = connected(nodes, both)
    island = nodes.join(groups.hint("merge"), "node").select(*block, "ao", "ag", F.col("group").alias("island"))
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"g.{c}")) for c in [*block, "ao", "ag"]]
    return keyed.alias("k").join(island.hint("merge").alias("g"), same).select(*[F.col(f"k.{c}") for c in rows.columns], F.col("g.island").alias("island"))


def _grouped(issues: DataFrame) -> DataFrame:
    """The issues of each group that J13 can relate, in order, as one array: nested texts, or overlapping places of a caption."""
    rows = full_rows(issues)
    images = nested_groups(rows.where("source_type <> 'caption' or span_start is null"))
    captions = overlap_islands(rows.where("source_type = 'caption' and span_start is not null"), BLOCK)
    both = images.unionByName(captions.withColumn("island", F.col("island").cast("bigint")))
    return both.groupBy(*BLOCK, "island").agg(F.array_sort(F.collect_list(F.struct(*ISSUE))).alias("c"))


def clusters(issues: DataFrame) -> DataFrame:
    """Every issue joins the first cluster holding a related issue; ``cluster`` counts within ``island``."""
    g = _clustered(_grouped(issues))
    return g.select(*BLOCK, "island", F.posexplode("clusters").alias("cluster", "members"))


def _clustered(groups: DataFrame) -> DataFrame:
    """(block, island, clusters) from the ordered issues ``c`` of each group."""
    a, x, k, y, i = (fresh(n) for n in "axkyi")
    z = fresh("z")
    first = f"array_position(transform({a}, {k} -> exists({k}, {z} -> {related(z, x)})), true)"
    step = let(first, lambda f: (
        f"if({f} = 0, concat({a}, array(array({x}))), "
        f"transform({a}, ({y}, {i}) -> if({i} + 1 = {f}, concat({y}, array({x})), {y})))"))
    fold = f"aggregate(c, cast(array() as array<array<{ISSUE_TYPE}>>), ({a}, {x}) -> {step})"
    return groups.select(*BLOCK, "island", F.expr(fold).alias("clusters"))


CONFIRM = "Needs confirmation: found by one image review step only."


def accept_by_consensus(candidates: DataFrame, current: DataFrame) -> DataFrame:
    """Clusters backed by a rule, by two sources or by a confident definite
    finding are accepted; of the others the best one is staged for review.
    Result: the block's issues, full rows, after pushing (J14) onto the current ones."""
    now = full_rows(current)
    # candidates and current issues that can be related form one group; groups do not touch each other
    tagged = full_rows(candidates.where("source_type = 'image'")).withColumn("_new", F.lit(True)).unionByName(
        now.where("source_type = 'image'").withColumn("_new", F.lit(False)))
    tagged = kept_rows(nested_groups(tagged), "tagged")
    of = lambda new: tagged.where("_new" if new else "not _new").groupBy(*BLOCK, "island").agg(F.array_sort(F.collect_list(F.struct(*ISSUE))).alias("c"))
    per_group = _clustered(of(True))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")) for k in [*BLOCK, "island"]]
    j = per_group.alias("c").join(of(False).withColumnRenamed("c", "current").hint("merge").alias("p"), same, "left").select(
        "c.clusters", F.expr(f"coalesce(current, cast(array() as array<{ISSUE_TYPE}>))").alias("current"))
    state, members = fresh("state"), fresh("members")
    e, m, n, v = (fresh(x) for x in "emnv")
    backed = f"exists({state}, {e} -> exists({members}, {m} -> {related(e, m)}))"
    sources = (f"size(array_distinct(filter(flatten(transform({members}, {m} -> "
               f"transform(split({m}.created_by, '[+]'), {v} -> trim({v})))), {n} -> {n} <> '')))")
    best = f"array_max(transform({members}, {m} -> {m}.confidence))"
    sure = (f"exists({members}, {m} -> {m}.is_definite and {m}.confidence >= 0.9 "
            f"and {m}.severity not in ('suggestion', 'needs_review'))")
    accepted = f"({backed} or ({sources} >= 2 and {best} >= 0.68) or {sure})"
    rank = lambda x: tx.severity_rank(x + ".severity")

    def ordered(key) -> str:
        p, q = fresh("p"), fresh("q")
        return (f"transform(array_sort(transform({members}, ({p}, {q}) -> named_struct({key(p)}, 'i', {q}, 'h', {p}))), "
                f"{p} -> {p}.h)")

    by_severity = ordered(lambda p: f"'a', {rank(p)}, 'b', -{p}.confidence, 'c', -length({p}.original)")
    by_confidence = ordered(lambda p: f"'a', -{p}.confidence, 'b', {rank(p)}, 'c', -length({p}.original)")
    staged = {
        **{k: f"s.{k}" for k in ISSUE}, "severity": "'needs_review'",
        "confidence": "least(0.74D, greatest(0.5D, s.confidence))", "is_definite": "false", "status": "'open'",
        "reason": f"if(contains(s.reason, {lit(CONFIRM)}), s.reason, concat(s.reason, ' ', {lit(CONFIRM)}))",
        "created_by": "concat(s.created_by, '+needs_review_staging')",
    }
    s = fresh("s")
    one = "named_struct(" + ", ".join(f"'{k}', {v.replace('s.', s + '.')}" for k, v in staged.items()) + ")"
    review = f"transform(filter(slice({by_confidence}, 1, 1), {s} -> trim({s}.original) <> ''), {s} -> {one})"
    # each cluster is judged against the issues as the clusters before it have left them
    step = push_unique(state, f"if({accepted}, {by_severity}, {review})")
    touched = j.select(F.expr(f"inline(aggregate(clusters, current, ({state}, {members}) -> {step}))"))
    # groups without a candidate, and issues of other sources, stay as they are
    same = [F.col(f"i.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*BLOCK, "island"]]
    rest = tagged.where("not _new").alias("i").join(per_group.select(*BLOCK, "island").hint("merge").alias("b"), same, "left_anti").select(*ISSUE)
    return touched.unionByName(rest).unionByName(now.where("source_type <> 'image'").select(*ISSUE))
