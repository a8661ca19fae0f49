"""Text boxes read from images (B1-B17) and layout checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redpencil.functions import text as tx
from redpencil.functions.exprs import fresh, lit, spans
from redpencil.lexicon import Lexicon
from redpencil.operators import batches
from redpencil.operators.groups import connected, kept_rows
from redpencil.operators.structure_rules import DATE_TOKEN

# Words that mark a box as a sentence or an instruction.
_SIGNALS = ("ngày|tháng|năm|giờ|phút|tham gia|đăng ký|đối tượng|hình thức|thời gian|địa điểm|lưu ý|ưu đãi|"
            "khuyến mãi")


def compact_terms(lexicon: DataFrame) -> DataFrame:
    """B2: distinct letter-and-digit keys of canonical and mapped terms."""
    single = lexicon.where(F.col("list").isin("brand_terms", "protected_terms", "do_not_change")).select("right")
    pairs = lexicon.where(F.col("list").isin("preferred_spellings", "product_terms", "preferred_wording"))
    both = single.select(F.col("right").alias("term")).unionByName(
        pairs.select(F.explode(F.array("wrong", "right")).alias("term")))
    return (both.where("term is not null").select(F.expr(tx.compact_key("term")).alias("compact"))
            .where("length(compact) >= 3").distinct())


def sentence_signal(x: str) -> str:
    return (f"({tx.word_count(x)} > 4 or {x} rlike '[.!?;:|]' or {x} rlike '(?i)#|@|https?://' "
            f"or {x} rlike {lit('(?iu)(?<![A-Za-z0-9_])(' + _SIGNALS + ')(?![A-Za-z0-9_])')})")


def classify(boxes: DataFrame, compact: DataFrame) -> DataFrame:
    """B1: visual role by rule.  ``compact`` is the distinct key table (B2)."""
    plain = tx.collapse_ws("trim(text)")
    alnum = tx.alnum_count("_t")
    noise = (f"({alnum} = 0 or (not _t rlike '[0-9]' and (({alnum} = 1 and length(_t) <= 2 and confidence < 0.72) "
             f"or ({alnum} <= 2 and length(_t) <= 3 and confidence < 0.45))))")
    mark_ok = f"(not {sentence_signal('_t')} and {tx.word_count('_t')} between 1 and 4 and length(_t) <= 48)"
    known = compact.select("compact", F.lit(True).alias("_known"))
    b = (boxes.withColumn("_t", tx.nfkc(F.col("text"))).withColumn("_t", F.expr(plain.replace("text", "_t")))
         .withColumn("compact", F.expr(tx.compact_key("_t"))).join(known, "compact", "left"))
    role = (f"case when _t = '' then 'decorative_text' when {noise} then 'icon_noise' "
            f"when _known and {mark_ok} then 'logo_wordmark' "
            f"when confidence < 0.58 then 'unknown' else 'graphic_text' end")
    return (b.withColumn("visual_role", F.expr(role))
            .withColumn("visual_should_check", F.expr("visual_role in ('graphic_text', 'unknown')"))
            .withColumn("visual_confidence", F.expr(
                "case visual_role when 'decorative_text' then 0.92D when 'icon_noise' then 0.78D "
                "when 'logo_wordmark' then 0.88D when 'unknown' then greatest(0.4D, confidence) else 0.74D end"))
            .drop("_t", "_known", "compact"))


def overlay_roles(boxes: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposed roles win unless they would lose likely copy.

    ``proposals``: (box_id, role, should_check, confidence), one per box.
    """
    p = proposals.select("box_id", F.col("role").alias("p_role"), F.col("should_check").alias("p_check"),
                         F.col("confidence").alias("p_conf"), F.lit(True).alias("p_some"))
    known = "('graphic_text', 'logo_wordmark', 'decorative_text', 'icon_noise', 'unknown')"
    j = (boxes.join(p, "box_id", "left")
         .withColumn("_role", F.expr(f"if(p_role in {known}, p_role, 'unknown')"))
         .withColumn("_check", F.expr("_role in ('graphic_text', 'unknown')"))
         .withColumn("_conf", F.expr("coalesce(least(1D, greatest(0D, p_conf)), visual_confidence)"))
         .withColumn("_fixed", F.expr("p_some is null or (visual_role = 'logo_wordmark' and not visual_should_check)"))
         .withColumn("_was", F.expr(f"if(visual_role in {known}, visual_role, 'unknown')"))
         .withColumn("_loses", F.expr(
             f"visual_should_check and _was in ('graphic_text', 'unknown') and not _check "
             f"and coalesce(_conf, 0) < 0.75 and ({sentence_signal('text')} or {tx.word_count('text')} >= 3)")))
    out = {
        "visual_role": "case when _fixed then visual_role when _loses then _was else _role end",
        "visual_confidence": "case when _fixed then visual_confidence when _loses then "
                             "greatest(coalesce(visual_confidence, 0.6D), least(coalesce(_conf, 0.6D), 0.82D)) else _conf end",
        "visual_should_check": "case when _fixed then visual_should_check when _loses then true else _check end",
    }
    keep = [F.expr(out[c]).alias(c) if c in out else F.col(c) for c in boxes.columns]
    return j.select(*keep)


CHECKABLE = ("(trim(text) <> '' and coalesce(visual_should_check, true) "
             "and coalesce(visual_role, 'unknown') in ('graphic_text', 'unknown'))")
TINY_NOISE = f"({tx.alnum_count('text')} <= 2 and not text rlike '[0-9]')"
REVIEWABLE = f"(trim(text) <> '' and not {TINY_NOISE} and confidence >= 0.5)"


def role_summary(boxes: DataFrame) -> DataFrame:
    """B5."""
    return boxes.groupBy("visual_role").agg(
        F.count(F.lit(1)).alias("boxes"), F.count_if(F.expr(CHECKABLE)).alias("checkable"))


def filter_lines(lines: DataFrame) -> DataFrame:
    """Lines with a text signal, exact repeats on a 4-pixel grid dropped."""
    signal = f"({tx.alnum_count('text')} >= 2 and (text rlike {lit(chr(92) + 'p{L}')} or text rlike '[0-9]{{2,}}'))"
    grid = [F.expr(f"cast(floor(bbox.{c} / 4 + 0.5) as bigint)") for c in ("x0", "y0", "x1", "y1")]
    w = W.partitionBy("asset_id", F.expr(tx.comparable("text")), *grid).orderBy("ord")
    return (lines.where(signal).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
            .withColumn("text", F.expr(f"trim({tx.collapse_ws('text')})")))


_BOX = "struct<ord:bigint,box_id:string,text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>"


def _overlap_ratio(a: str, b: str) -> str:
    w = f"greatest(0D, least({a}.bbox.x1, {b}.bbox.x1) - greatest({a}.bbox.x0, {b}.bbox.x0))"
    h = f"greatest(0D, least({a}.bbox.y1, {b}.bbox.y1) - greatest({a}.bbox.y0, {b}.bbox.y0))"
    area = lambda v: f"greatest(1D, {v}.bbox.x1 - {v}.bbox.x0) * greatest(1D, {v}.bbox.y1 - {v}.bbox.y0)"
    return f"({w} * {h} / least({area(a)}, {area(b)}))"


def dedupe_boxes(boxes: DataFrame) -> DataFrame:
    """Same text and overlap above .45 of the smaller area; the most
    confident reading stays, in the place of the first.

    Boxes of one asset and text are dealt to the cells of a grid that they touch, and pairs that
    overlap enough meet in a cell; only boxes that such pairs join are folded together, so a text
    repeated over a huge image never meets in one group. Boxes that are equal in text and place are
    one candidate for pairs.
    """
    from pyspark.sql.types import _parse_datatype_string

    key = [F.col("asset_id"), F.expr(tx.comparable("text")).alias("_key")]
    spot = kept_rows(boxes.select(*key, "bbox").distinct().withColumn("node", F.monotonically_increasing_id()), "spots")
    # cells about as wide as the boxes of the text, so that most touch few of them and none more than some thousand
    side = lambda c: F.greatest(F.avg(F.expr(f"abs(bbox.{c}1 - bbox.{c}0)")), F.max(F.expr(f"abs(bbox.{c}1 - bbox.{c}0)")) / 32, F.lit(1.0))
    size = spot.groupBy("asset_id", "_key").agg(side("x").alias("_w"), side("y").alias("_h"))
    same_text = [F.col("s.asset_id").eqNullSafe(F.col("z.asset_id")), F.col("s._key").eqNullSafe(F.col("z._key"))]
    j = spot.alias("s").join(size.alias("z"), same_text).select("s.*", "_w", "_h")
    span = lambda c, w: f"sequence(cast(floor(least(bbox.{c}0, bbox.{c}1) / {w}) as bigint), cast(floor(greatest(bbox.{c}0, bbox.{c}1) / {w}) as bigint))"
    cells = j.withColumn("_cx", F.explode(F.expr(span("x", "_w")))).withColumn("_cy", F.explode(F.expr(span("y", "_h"))))
    one = cells.select("asset_id", "_key", "_cx", "_cy", F.col("node").alias("a"), F.struct("bbox").alias("p"))
    two = cells.select(F.col("asset_id").alias("_a2"), F.col("_key").alias("_k2"), F.col("_cx").alias("_x2"), F.col("_cy").alias("_y2"),
                       F.col("node").alias("b"), F.struct("bbox").alias("q"))
    met = one.join(two, one["asset_id"].eqNullSafe(two["_a2"]) & one["_key"].eqNullSafe(two["_k2"]) & (F.col("_cx") == F.col("_x2")) & (F.col("_cy") == F.col("_y2")))
    pairs = met.where(f"a < b and {_overlap_ratio('p', 'q')} > 0.45").select("a", "b").distinct()
    island = spot.join(connected(spot, pairs), "node").select("asset_id", "_key", "bbox", F.col("group").alias("_island"))
    item = F.struct("ord", "box_id", "text", "confidence", "bbox").cast(_parse_datatype_string(_BOX))
    b = boxes.select("*", key[1])
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"i.{c}")) for c in ("asset_id", "_key", "bbox")]
    g = b.alias("b").join(island.alias("i"), same).select("b.*", "_island").groupBy("asset_id", "_island").agg(F.array_sort(F.collect_list(item)).alias("c"))
    a, x, k, y, i = (fresh(n) for n in "axkyi")
    first = f"array_position(transform({a}, {k} -> {_overlap_ratio(k, x)} > 0.45), true)"
    better = (f"named_struct('ord', {y}.ord, 'box_id', {y}.box_id, 'text', {x}.text, 'confidence', {x}.confidence, "
              f"'bbox', {x}.bbox)")
    fold = (f"aggregate(slice(c, 2, size(c)), slice(c, 1, 1), ({a}, {x}) -> if({first} = 0, concat({a}, array({x})), "
            f"transform({a}, ({y}, {i}) -> if({i} + 1 = {first} and {x}.confidence > {y}.confidence, {better}, {y}))))")
    return g.select("asset_id", F.expr(f"inline({fold})"))


def rescale(bbox: str, scale_x: str, scale_y: str, width: str, height: str) -> str:
    """Payload pixels to original pixels, rounded and clamped."""
    def px(v, s, top):
        return f"cast(greatest(0, least({top}, floor({bbox}.{v} / {s} + 0.5))) as double)"
    return (f"named_struct('x0', {px('x0', scale_x, width)}, 'y0', {px('y0', scale_y, height)}, "
            f"'x1', {px('x1', scale_x, width)}, 'y1', {px('y1', scale_y, height)})")


def correct_text(boxes: DataFrame, corrections: DataFrame, lex: Lexicon) -> DataFrame:
    """Take over a proposed reading only when it is safe.

    ``corrections``: (box_id, corrected_text, confidence), one per box.
    """
    c = corrections.select("box_id", F.expr(f"trim({tx.collapse_ws('corrected_text')})").alias("_new"),
                           F.expr("least(1D, greatest(0D, coalesce(confidence, 0D)))").alias("_conf"))
    j = (boxes.join(c, "box_id", "left")
         .withColumn("_a", tx.compatible("text")).withColumn("_b", tx.compatible("_new")))
    terms = [t.lower() for t in lex.do_not_change if t.strip()]
    t = fresh("t")
    survive = "true" if not terms else (
        f"forall(array({', '.join(lit(x) for x in terms)}), {t} -> not contains(_a, {t}) or contains(_b, {t}))")
    sim = tx.similarity("_a", "_b")
    usable = "coalesce(_new, '') <> '' and _conf >= 0.86 and length(_new) <= 240"
    same = "_a = _b"
    safe = (f"{tx.digit_signature('text')} = {tx.digit_signature('_new')} and {survive} and {sim} >= 0.72 "
            f"and not (confidence >= 0.84 and _conf < 0.93 and {sim} < 0.88)")
    verdict = f"case when not coalesce({usable}, false) then 'keep' when {same} then 'confirm' when {safe} then 'replace' else 'keep' end"
    raised = "greatest(confidence, least(0.98D, _conf))"
    j = j.withColumn("_verdict", F.expr(verdict))
    out = {"text": "if(_verdict = 'replace', _new, text)", "confidence": f"if(_verdict = 'keep', confidence, {raised})"}
    return j.select(*[F.expr(out[k]).alias(k) if k in out else F.col(k) for k in boxes.columns],
                    F.col("_verdict").alias("verdict"))


def read_status(boxes: DataFrame) -> DataFrame:
    """Average confidence and read status per asset."""
    return boxes.groupBy("asset_id").agg(F.avg("confidence").alias("avg_confidence")).withColumn(
        "ocr_status", F.expr("if(avg_confidence < 0.6, 'low_confidence', 'done')"))


def low_confidence_issues(boxes: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Poorly read boxes become review issues (tiny noise is skipped), quoted whole or up to ``max_chars``."""
    quote = "text" if max_chars is None else f"substring(text, 1, {max_chars})"
    rows = boxes.where(f"{CHECKABLE} and not ({TINY_NOISE} and confidence < 0.62) and confidence < 0.5")
    return rows.select(
        F.concat(F.lit("issue_ocrconf_"), "box_id").alias("issue_id"), F.lit("image").alias("source_type"),
        F.col("asset_id").alias("source_id"), "box_id", F.lit("ocr_low_confidence").alias("type"),
        F.lit("needs_review").alias("severity"), F.expr(quote).alias("original"),
        F.expr(quote).alias("suggestion"),
        F.expr("concat('Text may be misread (', cast(floor(confidence * 100 + 0.5) as int), '%).')").alias("reason"),
        "confidence", F.lit(False).alias("is_definite"), "bbox", F.lit("open").alias("status"),
        F.lit("ocr_service").alias("created_by"))


def rule_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes read well enough for the rule checker, as content rows."""
    return boxes.where(f"{CHECKABLE} and confidence >= 0.62").select(
        "workspace_id", F.lit("image").alias("source_type"), F.col("asset_id").alias("source_id"), "box_id", "text")


# Budget of a batch.
MAX_BATCH_BOXES, MAX_BATCH_CHARS, BATCH_OVERHEAD = 36, 5200, 80


def budget_batches(boxes: DataFrame, group: str = "workspace_id", max_boxes: int = MAX_BATCH_BOXES,
                   max_chars: int = MAX_BATCH_CHARS, overhead: int = BATCH_OVERHEAD) -> DataFrame:
    """Consecutive boxes share a batch until ``max_boxes`` boxes or ``max_chars`` characters; every box gets one."""
    sized = boxes.select(group, "ord", "box_id", (F.length("text") + overhead).alias("_size"))
    return batches.budget_batches(sized, group, ["ord", "box_id"], "_size", max_boxes, max_chars).select(
        group, "ord", "box_id", F.col("batch_id").cast("int").alias("batch_id"))


def review_score(text: str, confidence: str, words: tuple[str, ...] = ()) -> str:
    """How much a box deserves a look; ``words`` are names that deserve one by themselves."""
    # Words of labels.
    labels = ("đối tượng|hình thức|thời gian|địa điểm|deadline|hạn chót|đăng ký|tham gia|giải thưởng|thể lệ|"
              "lưu ý|link|form")
    date = fresh("d")
    ok = (f"exists({spans(text, DATE_TOKEN)}, {date} -> "
          f"cast(regexp_extract({date}.o, {lit(DATE_TOKEN)}, 1) as int) between 1 and 31 and "
          f"cast(regexp_extract({date}.o, {lit(DATE_TOKEN)}, 3) as int) between 1 and 12)")
    return (f"(case when {confidence} < 0.8 then 5 when {confidence} < 0.9 then 3 else 0 end "
            f"+ if({text} rlike '[;:]', 3, 0) + if({ok}, 3, 0) "
            f"+ if({text} rlike {lit(rf' {{2,}}|#{tx.WS}+|{tx.NOT_WS} +[.,!?;:]')}, 5, 0) "
            f"+ if(lower({text}) rlike {lit(labels)}, 4, 0) "
            + (f"+ if(lower({text}) rlike {lit('|'.join(tx.escape(x.lower()) for x in words))}, 3, 0) " if words else "")
            + f"+ if(length({text}) <= 140, 1, 0))")


# A quick look takes at least and at most so many boxes.
FEWEST, MOST = 10, 24


def review_top_k(boxes: DataFrame, group: str = "workspace_id", fewest: int = FEWEST, most: int = MOST,
                 words: tuple[str, ...] = ()) -> DataFrame:
    """All boxes of small groups; of others the ``fewest`` .. ``most`` best-scored.

    k depends on how many score above zero, so only the top ``most`` rows per group are ever
    ranked against each other (grouped rank limit).
    """
    scored = boxes.withColumn("score", F.expr(review_score("text", "confidence", words)))
    totals = scored.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("score") > 0).alias("_pos"))
    w = W.partitionBy(group).orderBy(F.desc("score"), F.asc("confidence"), F.asc("ord"))
    top = scored.withColumn("rank", F.row_number().over(w)).where(f"rank <= {most}")
    return (top.join(totals, group).where(f"_n <= {most} or rank <= least({most}, greatest({fewest}, _pos))").drop("_n", "_pos"))


def first_detected(detected: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` texts per asset by ``ord`` (texts that share the last place all stay), and the rejected rest.

    Only the head of an asset is ranked (grouped rank limit); the rest is told by the last place taken.
    """
    w = W.partitionBy("asset_id").orderBy("ord")
    head = detected.where("trim(text) <> ''").withColumn("_n", F.rank().over(w)).where(f"_n <= {most}").drop("_n")
    last = head.groupBy(F.col("asset_id").alias("_a")).agg(F.max("ord").alias("_last"))
    rest = (detected.where("trim(text) <> ''").join(last, F.col("asset_id").eqNullSafe(F.col("_a")), "left")
            .where("coalesce(ord > _last, ord is not null)").drop("_a", "_last")
            .withColumn("reject_reason", F.lit("over_limit")))
    return head, rest


def split_detected(boxes: DataFrame, detected: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Detected texts that no box of their asset reads already, all or the first ``most`` per asset;
    and the new texts that ``most`` cuts, with ``reject_reason``."""
    d = (detected.where("trim(text) <> ''")
         .withColumn("text", F.expr(f"trim({tx.collapse_ws('text')})"))
         .withColumn("confidence", F.expr("greatest(0.35D, least(0.82D, coalesce(confidence, 0.62D)))")))
    have = boxes.select("asset_id", F.expr(tx.comparable("text")).alias("_key")).distinct()
    new = d.withColumn("_key", F.expr(tx.comparable("text"))).join(have, ["asset_id", "_key"], "left_anti").drop("_key")
    if most is None:
        return new, new.where("false").withColumn("reject_reason", F.lit("over_limit"))
    return first_detected(new, most)


def add_detected(boxes: DataFrame, detected: DataFrame, most: int | None = None) -> DataFrame:
    """Detected texts that no box reads already, all or the first ``most`` per asset."""
    return split_detected(boxes, detected, most)[0]


# -- layout (B18-B21) -----------------------------------------------------------------

def upscaled(layers: DataFrame, assets: DataFrame) -> DataFrame:
    """Images shown at more than 150 % of their size."""
    j = layers.join(assets.select("asset_id", F.col("width").alias("aw"), F.col("height").alias("ah")), "asset_id")
    scale = "greatest(width / cast(aw as double), height / cast(ah as double))"
    return (j.withColumn("scale", F.expr(scale)).where("scale > 1.5")
            .select("artboard_id", "asset_id", "scale", F.lit("layout_risk").alias("type"), F.lit("medium").alias("severity")))


def ratio_mismatch(layers: DataFrame, assets: DataFrame) -> DataFrame:
    """Cover-fitted images whose shape differs by more than 25 %."""
    j = layers.where("fit_mode = 'cover'").join(
        assets.select("asset_id", F.col("width").alias("aw"), F.col("height").alias("ah")), "asset_id")
    off = "abs(aw / cast(ah as double) - width / cast(height as double)) / (width / cast(height as double))"
    return (j.withColumn("off", F.expr(off)).where("off > 0.25")
            .select("artboard_id", "asset_id", "off", F.lit("platform_format").alias("type"), F.lit("low").alias("severity")))


_EDGES = ("x0", "y0", "x1", "y1")


def _first_true(steps: str, condition) -> str:
    """The first element of an array for which ``condition(element)`` holds, where it holds for all after that one."""
    st, k = fresh("st"), fresh("k")
    mid = f"cast(({st}.lo + {st}.hi) div 2 as int)"
    found = (f"aggregate(sequence(1, length(bin(size({steps})))), named_struct('lo', 0, 'hi', size({steps})), ({st}, {k}) -> "
             f"case when {st}.lo >= {st}.hi then {st} when {condition(f'get({steps}, {mid})')} then named_struct('lo', {st}.lo, 'hi', {mid}) "
             f"else named_struct('lo', {mid} + 1, 'hi', {st}.hi) end).lo")
    return f"get({steps}, {found})"


def _first_boxes(boxes: DataFrame) -> DataFrame:
    """Per asset and edge (x0, y0, x1, y1) the boxes that lie further out at this edge than all boxes before them, by ``ord``.

    Whatever a layer cuts off at one edge, the first box it hits there is one of these. Boxes are counted
    down to the first one of each place, then of each coordinate, before the coordinates of an asset are put in order.
    """
    places = boxes.groupBy("asset_id", "bbox").agg(F.min(F.struct("box_ord", "box_id")).alias("b"))
    edges = F.explode(F.array(*[F.struct(F.lit(k).alias("d"), F.col(f"bbox.{c}").cast("double").alias("v")) for k, c in enumerate(_EDGES)])).alias("e")
    ends = places.select("asset_id", "bbox", "b", edges).select("asset_id", "e.d", "e.v", F.struct("b.box_ord", "b.box_id", "bbox").alias("b"))
    ends = ends.where("v is not null").groupBy("asset_id", "d", "v").agg(F.min("b").alias("b"))
    outward = W.partitionBy("asset_id", "d").orderBy(F.expr("if(d < 2, v, null)").asc(), F.expr("if(d >= 2, v, null)").desc())
    key = F.struct("b.box_ord", "b.box_id")
    steps = ends.withColumn("_k", key).withColumn("_before", F.min("_k").over(outward.rowsBetween(W.unboundedPreceding, -1))).where(
        "_before is null or _k < _before")
    step = F.struct("b.box_ord", "b.box_id", "b.bbox", "v")
    return steps.groupBy("asset_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("d") == k, step))).alias(f"_{c}") for k, c in enumerate(_EDGES)])


def cropped_text(layers: DataFrame, assets: DataFrame, boxes: DataFrame, artboards: DataFrame) -> DataFrame:
    """Text cropped by its layer or within 48 pixels of the artboard edge;
    the first such box per layer.

    Each edge of a box is judged by itself and the further out it is the sooner it is hit, so a layer
    needs only the boxes of ``_first_boxes``, found by bisection; layers and boxes of an asset never
    meet in pairs. Layers without a positive, finite scale are compared with every box.
    """
    shown = (layers.join(assets.select("asset_id", F.col("width").alias("aw"), F.col("height").alias("ah")), "asset_id")
             .join(artboards.select("artboard_id", F.col("width").alias("bw"), F.col("height").alias("bh")), "artboard_id"))
    sx, sy = "width / cast(aw as double)", "height / cast(ah as double)"
    shown = (shown.withColumn("_s", F.expr(f"if(fit_mode = 'cover', greatest({sx}, {sy}), least({sx}, {sy}))"))
             .withColumn("_dx", F.expr("(aw * _s - width) / 2")).withColumn("_dy", F.expr("(ah * _s - height) / 2")))
    # rows without an order number come last and have no name
    last = (1 << 63) - 1
    read = boxes.where("confidence >= 0.5 and trim(text) <> ''").select(
        "asset_id", "bbox", F.expr(f"coalesce(ord, {last}L)").alias("box_ord"), F.expr("if(ord is null, null, box_id)").alias("box_id"))
    place = {"x0": "x + {v} * _s - _dx", "y0": "y + {v} * _s - _dy", "x1": "x + {v} * _s - _dx", "y1": "y + {v} * _s - _dy"}
    cut = {"x0": "{p} < x", "y0": "{p} < y", "x1": "{p} > x + width", "y1": "{p} > y + height"}
    near = {"x0": "{p} < 48", "y0": "{p} < 48", "x1": "bw - ({p}) < 48", "y1": "bh - ({p}) < 48"}
    at = lambda c, v: place[c].format(v=v)
    any_ = lambda rules, box: " or ".join(f"({r.format(p=at(c, f'{box}.{c}'))})" for c, r in rules.items())
    hit = lambda c, v: f"({cut[c].format(p=at(c, v))} or {near[c].format(p=at(c, v))})"
    plain = "coalesce(_s > 0 and _s + abs(_dx) + abs(_dy) + abs(x) + abs(y) + abs(width) + abs(height) < double('Infinity'), false)"
    firsts = ", ".join(_first_true(f"_{c}", lambda z, c=c: hit(c, f"{z}.v")) for c in _EDGES)
    by_steps = (shown.where(plain).join(_first_boxes(read), "asset_id").withColumn("f", F.expr(f"array_min(array({firsts}))")).where("f is not null")
                .select("artboard_id", "layer_id", "f.box_ord", "f.box_id", F.expr(any_(cut, "f.bbox")).alias("cropped")))
    odd = (shown.where(f"not {plain}").join(read, "asset_id").where(f"{any_(cut, 'bbox')} or {any_(near, 'bbox')}")
           .select("artboard_id", "layer_id", "box_ord", "box_id", F.expr(any_(cut, "bbox")).alias("cropped")))
    first = by_steps.unionByName(odd).groupBy("artboard_id", "layer_id").agg(F.min(F.struct("box_ord", "box_id", "cropped")).alias("f"))
    return first.select("artboard_id", "layer_id", F.col("f.box_id").alias("box_id"),
                        F.expr(f"if(f.cropped and f.box_ord < {last}L, 'high', 'medium')").alias("severity"))


def repeated_images(layers: DataFrame, artboards: DataFrame) -> DataFrame:
    """A slide reuses the image of an earlier slide."""
    slides = artboards.where("format = 'carousel_slide'").select("artboard_id", "ord")
    w = W.partitionBy("asset_id").orderBy("ord", "layer_id")
    return (layers.join(slides, "artboard_id").withColumn("previous", F.lag("artboard_id").over(w))
            .where("previous is not null and previous <> artboard_id")
            .select("artboard_id", "asset_id", "previous"))
