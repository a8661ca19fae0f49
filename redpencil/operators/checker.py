"""The rule checker as one narrow projection (J4-J7 included).

text -> links, protected ranges, headings -> hits of all rules -> guards ->
suppression and overlap resolution per island -> issue rows.  No shuffle: each
text is judged where it is read, so the job scales with the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpencil.functions import text as tx
from redpencil.functions.exprs import (
    HIT_TYPE, any_contains, any_overlap, chunks, contains, cut, empty, field, fresh, let, lit, merge_ranges, running, spans,
)
from redpencil.lexicon import Lexicon
from redpencil.operators import ranges as rg
from redpencil.operators import rulebook as rb
from redpencil.operators import structure_rules as st
from redpencil.operators.dictionary import candidate_hits, candidate_terms, phrase_hits, with_candidates
from redpencil.operators.span_rules import span_hits, static_rules

ALL_RULES = set(range(1, 80))
CAPTION_RULES = {1, 2, 73, 74, 79}
HEADING_AWARE_SPANS = {34, 35}
CONTEXT = 12  # signs before and after an issue


def _heading_aware(found: str, headings: str) -> str:
    """P12 for name rules: upper case inside capitals headings."""
    h, w = fresh("h"), fresh("w")
    up = f"({h}.r = 350 or {h}.r = 340)"
    g = f"if({up} and {rg.in_heading(h, headings)}, upper({h}.g), {h}.g)"
    return (
        f"filter(transform({found}, {h} -> named_struct('r', {h}.r, 'k', {h}.k, 's', {h}.s, 'e', {h}.e, "
        f"'o', {h}.o, 'g', {g})), {w} -> {w}.r div 10 <> 35 or {tx.comparable(w + '.o')} <> {tx.comparable(w + '.g')})"
    )


def all_hits(t: str, low: str, caption: str, excluded: str, headings: str,
             lex: Lexicon, rules: set[int], candidates: str | None = None) -> list[str]:
    """Hits of the selected rules, before guards, as a few array expressions."""
    parts = []
    static = [r for r in static_rules(lex) if r.code // 10 in rules]
    aware = [r for r in static if r.code // 10 in HEADING_AWARE_SPANS]
    plain = [r for r in static if r.code // 10 not in HEADING_AWARE_SPANS]
    if plain:
        parts.append(span_hits(t, low, plain))
    if aware:
        parts.append(_heading_aware(span_hits(t, low, aware), headings))
    single = {
        7: lambda: st.repeated_lines(t, low), 8: lambda: st.repeated_phrases(t, low), 12: lambda: st.numbered_list_format(t),
        13: lambda: st.bullet_list_format(t), 14: lambda: st.heading_words(headings, excluded),
        15: lambda: st.heading_phrases(headings, excluded), 16: lambda: st.term_variants(t, low),
        24: lambda: st.repeated_hashtags(t), 46: lambda: st.combining_marks(t), 50: lambda: st.unexplained_acronyms(t, lex),
        59: lambda: st.brackets(t), 60: lambda: st.quotes(t), 77: lambda: st.date_formats(t),
    }
    edges = {1: st.leading_blanks, 2: st.trailing_blanks, 73: st.first_letter_case, 79: st.final_punctuation}
    parts += [make() for rule, make in single.items() if rule in rules]
    parts += [f"if({caption}, {make(t)}, {empty(HIT_TYPE)})" for rule, make in edges.items() if rule in rules]
    dictionary = set(rb.DICTIONARY_RULES) & rules
    if dictionary:
        parts.append(phrase_hits(t, low, caption, headings, lex, dictionary))
        if candidates:
            parts.append(candidate_hits(t, low, caption, headings, candidates, dictionary))
    return parts


def guarded(hits: str, urls: str, protected: str, lex: Lexicon) -> str:
    """Drop edits of links and protected terms.

    Review-only hits (suggestion = original) survive only from rules that ask
    for review; risky words pass unguarded.
    """
    h = fresh("h")
    same = f"{h}.o = {h}.g"
    in_url = f"({any_overlap(h, urls)} and not {rb.link_cleanup(h + '.r')})"
    in_term = any_contains(h, protected)
    case = tx.case_only(f"{h}.o", f"{h}.g")
    terms = [t.lower() for t in lex.protected()]
    is_term = f"lower(trim({h}.o)) in ({', '.join(lit(t) for t in terms)})" if terms else "false"
    keep = (
        f"case when {h}.r div 10 = {rb.RISKY_RULE} then true "
        f"when {same} and {h}.r div 10 >= {rb.FIRST_STRICT_RULE} then false "
        f"when {in_url} then false "
        f"when {same} then not {in_term} "
        f"else {case} or not ({in_term} or {is_term}) end"
    )
    return f"filter({hits}, {h} -> {keep})"


def islands(hits: str) -> str:
    """Split start-sorted hits into groups that do not overlap each other.

    Suppression and resolution only look at overlapping hits, so each island
    is settled alone; this keeps the greedy step from being quadratic in the
    hits of a long text.
    """
    x, y, i, b, j = (fresh(n) for n in "xyibj")
    order = (f"array_sort({hits}, ({x}, {y}) -> case when {x}.s < {y}.s then -1 when {x}.s > {y}.s then 1 "
             f"when {x}.e < {y}.e then -1 when {x}.e > {y}.e then 1 else 0 end)")

    def cut_up(v: str) -> str:
        # an island opens where all hits before have ended
        first = let(running(v, "-1", lambda st, h: f"greatest({st}, {h}.e)"), lambda ends: (
            f"filter(sequence(0, size({v}) - 1), {i} -> {i} = 0 or get({v}, {i}).s >= {ends}[{i}])"))
        return let(first, lambda at: (
            f"transform({at}, ({b}, {j}) -> slice({v}, {b} + 1, coalesce(get({at}, {j} + 1), size({v})) - {b}))"))

    return let(order, lambda v: f"if(size({v}) = 0, {empty(f'array<{HIT_TYPE}>')}, {cut_up(v)})")


def settle(island: str) -> str:
    """J6 then J7 inside one island."""
    emit_key = lambda v: [f"{v}.r div 10", f"{v}.k", f"{v}.s"]
    rank_key = lambda v: [
        f"not {rb.definite(v + '.r')}", f"{v}.s - {v}.e", f"-{rb.lookup(v + '.r', 'confidence')}", f"{v}.r div 10", f"{v}.k", f"{v}.s"]

    def ordered(arr: str, key) -> str:
        z, w = fresh("z"), fresh("w")
        # flat rows: an ordering of nested ones is built anew for every comparison
        row = [f"'_{n}', {part}" for n, part in enumerate(key(z))] + [f"'{c}', {z}.{c}" for c in "rkseog"]
        hit = ", ".join(f"'{c}', {w}.{c}" for c in "rkseog")
        return f"transform(array_sort(transform({arr}, {z} -> named_struct({', '.join(row)}))), {w} -> named_struct({hit}))"

    h, i, p, d = (fresh(n) for n in "hipd")
    dictionary = ", ".join(str(r) for r in rb.DICTIONARY_RULES)
    # what lies in a suppressed hit lies in the hit that suppressed it, so all earlier ones may be asked
    pushed = let(ordered(island, emit_key), lambda all_: (
        f"filter({all_}, ({h}, {i}) -> not ({h}.r div 10 in ({dictionary}) and exists(slice({all_}, 1, {i}), {p} -> {contains(p, h)})))"))
    pushed = f"if(exists({island}, {d} -> {d}.r div 10 in ({dictionary})), {pushed}, {island})"
    return f"if(size({island}) = 1, {island}, {spread(ordered(pushed, rank_key))})"


def spread(ranked: str) -> str:
    """Best first, each hit that overlaps none accepted before it.

    Accepted hits stay in the order of their places, so a hit finds its neighbours by bisection.  The fold holds
    their places and numbers only, since every step copies what it holds.
    """
    k, c, b, n, i, x = (fresh(v) for v in ("k", "c", "b", "n", "i", "x"))
    number = lambda at: f"cast({at} & 4294967295 as int)"

    def run(v: str) -> str:
        middle = f"cast(({b}.lo + {b}.hi) div 2 as int)"
        halve = let(middle, lambda mid: (
            f"if({b}.lo >= {b}.hi, {b}, if(get({v}, {number(f'get({k}, {mid})')}).e > {c}.s, named_struct('lo', {b}.lo, 'hi', {mid}), "
            f"named_struct('lo', {mid} + 1, 'hi', {b}.hi)))"))
        # the first accepted hit that ends behind the start of this one
        place = (f"aggregate(sequence(0, cast(log2(size({k}) + 1) as int)), named_struct('lo', 0, 'hi', size({k})), ({b}, {n}) -> {halve}).lo")
        step = lambda m: let(place, lambda at: (
            f"if({at} < size({k}) and get({v}, {number(f'get({k}, {at})')}).s < {c}.e, {k}, "
            f"concat(slice({k}, 1, {at}), array(cast({c}.s as bigint) * 4294967296 + {m}), slice({k}, {at} + 1, size({k}))))"))
        at = f"transform({v}, ({x}, {i}) -> named_struct('s', {x}.s, 'e', {x}.e, 'i', {i}))"
        kept = f"aggregate({at}, cast(array() as array<bigint>), ({k}, {c}) -> {step(f'{c}.i')})"
        y = fresh("y")
        return f"transform({kept}, {y} -> get({v}, {number(y)}))"

    return let(ranked, run)


def bind(expr: str, **columns: str) -> str:
    """Bind columns to lambda variables around ``expr`` (names are substituted).

    Keeps the optimizer from inlining a costly column into a per-element lambda.
    """
    for name, column in columns.items():
        inner = expr
        expr = let(column, lambda v, inner=inner, name=name: inner.replace(name, v))
    return expr


def with_hits(content: DataFrame, lex: Lexicon, rules: set[int] | None = None, *, guard: bool = True,
              resolve: bool = True, table: DataFrame | None = None) -> DataFrame:
    """``content`` plus an array column ``hits``; all stages are projections.

    ``table``: further lexicon rows, any number of them.  They are joined to the words of the texts
    first; their hits and protected terms then pass the same guards, suppression and resolution.
    """
    rules = ALL_RULES if rules is None else rules
    names = content.columns
    content = content.withColumn("text", F.expr(tx.strip_reserved("text")))
    if table is not None:
        content = with_candidates(content, table)
    caption = "coalesce(source_type, 'caption') = 'caption'" if "source_type" in content.columns else "true"
    df = (content.withColumn("_low", F.expr(tx.folded("text")))
          .withColumn("_urls", F.expr(rg.url_ranges("text", "_low")))
          .withColumn("_terms", F.expr(rg.term_ranges("_low", lex.protected()))))
    if table is not None:
        more = bind(candidate_terms("text", "_low", "@candidates"), **{"@candidates": "_candidates"})
        df = df.withColumn("_more", F.expr(more)).withColumn("_terms", F.expr(merge_ranges("concat(_terms, _more)")))
    df = (df.withColumn("_excluded", F.expr("concat(_urls, _terms)")))
    needs_headings = rules & ({14, 15} | HEADING_AWARE_SPANS | set(rb.DICTIONARY_RULES))
    heads = rg.uppercase_headings("text", "_excluded") if needs_headings else empty(
        "struct<ls:int,le:int,s:int,t:string>")
    df = df.withColumn("_headings", F.expr(heads))
    bound = {"@excluded": "_excluded", "@headings": "_headings", "@candidates": "_candidates"}
    parts = all_hits("text", "_low", caption, "@excluded", "@headings", lex, rules, "@candidates" if table is not None else None)
    df = df.withColumns({
        f"_part{i}": F.expr(bind(part, **{k: v for k, v in bound.items() if k in part}))
        for i, part in enumerate(parts)
    })
    df = df.withColumn("_raw", F.expr(f"concat({', '.join(f'_part{i}' for i in range(len(parts)))})"))
    if guard:
        df = df.withColumn("_raw", F.expr(bind(
            guarded("_raw", "@urls", "@terms", lex), **{"@urls": "_urls", "@terms": "_terms"})))
    if resolve:
        i = fresh("i")
        df = (df.withColumn("_islands", F.expr(islands("_raw")))
              .withColumn("hits", F.expr(f"flatten(transform(_islands, {i} -> {settle(i)}))")))
    else:
        df = df.withColumn("hits", F.col("_raw"))
    return df.select(*names, "hits")


def with_context(hits: str, text: str) -> str:
    """P5 for all hits of a text, so that their rows need not carry the text."""
    h = fresh("h")
    return let(chunks(text), lambda p: (
        f"transform({hits}, {h} -> named_struct({', '.join(f'{chr(39)}{c}{chr(39)}, {h}.{c}' for c in 'rkseog')}, "
        f"'before', {cut(p, text, f'greatest({h}.s - {CONTEXT}, 0)', f'least({h}.s, {CONTEXT})')}, 'after', {cut(p, text, f'{h}.e', str(CONTEXT))}))"))


def unpack(found: DataFrame) -> DataFrame:
    """One row per hit.

    The outer generator keeps the optimizer from inferring ``size(hits) > 0``
    and pushing it, with the whole rule expression inlined, below the project:
    that would run every rule twice.
    """
    others = [c for c in found.columns if c != "hits"]
    return found.select(*others, F.expr("inline_outer(hits)")).where("r is not null").drop("p")


def rule_hits(content: DataFrame, lex: Lexicon, rules: set[int], id_cols: list[str], **options) -> DataFrame:
    """Rows of the selected rules: raw by default options of ``with_hits``."""
    found = with_hits(content, lex, rules, **options)
    return (unpack(found.select(*id_cols, "hits"))
            .select(*id_cols, F.col("r").alias("code"), F.col("s").alias("span_start"),
                    F.col("e").alias("span_end"), F.col("o").alias("original"), F.col("g").alias("suggestion")))


def check(content: DataFrame, lex: Lexicon, rules: set[int] | None = None, table: DataFrame | None = None) -> DataFrame:
    """Content rows -> issue rows; ``table`` adds a lexicon of any size (list, wrong, right, priority, ord).

    ``content`` needs workspace_id, source_type, source_id and text; artboard_id
    and box_id are taken over when present.
    """
    ids = ["workspace_id", "source_type", "source_id"]
    optional = [F.col(c) if c in content.columns else F.lit(None).cast("string").alias(c)
                for c in ("artboard_id", "box_id")]
    found = with_hits(content.select(*ids, *optional, "text"), lex, rules, table=table)
    rows = unpack(found.withColumn("hits", F.expr(with_context("hits", "text"))).drop("text"))
    issue_id = F.sha2(F.to_json(F.struct(*ids, "artboard_id", "box_id", "r", "s", "e", "o", "g")), 256)
    return rows.select(
        issue_id.alias("issue_id"), *ids, "artboard_id", "box_id",
        F.expr(rb.lookup("r", "type")).alias("type"),
        F.expr(rb.lookup("r", "severity")).alias("severity"),
        F.col("o").alias("original"), F.col("g").alias("suggestion"),
        F.expr(rb.lookup("r", "reason")).alias("reason"),
        F.expr(rb.lookup("r", "confidence")).alias("confidence"),
        F.expr(rb.definite("r")).alias("is_definite"),
        F.col("s").alias("span_start"), F.col("e").alias("span_end"),
        F.expr("cast(null as struct<x0:double,y0:double,x1:double,y1:double>)").alias("bbox"),
        F.col("before").alias("context_before"), F.col("after").alias("context_after"),
        F.lit("open").alias("status"), F.lit("rule_checker").alias("created_by"),
        F.concat(F.lit("R"), F.expr("cast(r div 10 as string)")).alias("reason_code"),
    )
