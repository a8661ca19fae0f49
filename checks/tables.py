"""Queries for everything around the rules: joins, boxes, patches, reports, streams."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from checks.base import POSTS, PRE, POST, documents, lexicon, posts, q, spans_cte, table, view, w
from checks.rules import ORACLE_SQL as RULE_SQL
from redpencil.functions import text as tx
from redpencil.functions.exprs import fresh
from redpencil.operators import boxes as bx
from redpencil.operators import candidates as cd
from redpencil.operators import checker, decisions as dc, patches as pt, ranges as rg
from redpencil.plans import report as rp
from redpencil.session import shared_folder
from redpencil.sources import lexicons as lx
from redpencil.sources import replies as rl
from redpencil.streaming import incremental as inc

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn
    return add


def shared(name: str, spark_expr, sql: str):
    QUERIES[name] = spark_expr
    ORACLE_SQL[name] = sql


# -- derived tables, in SQL both engines accept --------------------------------------

_V = "cast(floor(value) as int)"
_SRC = "concat('d', cast(floor(user_id / 20) as bigint))"  # every source id stands in many workspaces
ISSUES = f"""select concat('i', event_id) as issue_id, concat('w', user_id % 20) as workspace_id,
  case event_id % 5 when 0 then 'image' when 1 then 'layout' else 'caption' end as source_type,
  {_SRC} as source_id, case when event_id % 3 = 0 then concat('a', user_id % 7) end as artboard_id,
  case when event_id % 5 = 0 then concat('b', event_id % 11) end as box_id,
  case {_V} % 7 when 0 then 'spacing' when 1 then 'punctuation' when 2 then 'spelling' when 3 then 'grammar'
    when 4 then 'brand_term' when 5 then 'ocr_low_confidence' else 'style' end as type,
  case {_V} % 6 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low'
    when 4 then 'suggestion' else 'needs_review' end as severity,
  concat(event_type, ' ', {_V} % 9) as original, concat(event_type, ' ', {_V} % 4) as suggestion,
  case {_V} % 3 when 0 then 'Thiếu dấu tiếng Việt' else 'reason' end as reason,
  cast({_V} % 100 as double) / 100 as confidence, {_V} % 2 = 0 as is_definite,
  cast(event_id % 97 as int) as span_start, cast(event_id % 97 + 1 + {_V} % 8 as int) as span_end,
  case event_id % 7 when 0 then 'accepted' when 1 then 'ignored' when 2 then 'resolved'
    when 3 then 'needs_human_review' else 'open' end as status, event_type as created_by, ts, event_id as ord from events"""

# every occurrence of these words, and of two pairs of them that overlap the words
_FIX_WORDS = ["the", "of", "les", "de", "and", "un", "in"]
_FIX_PAIRS = ["the of", "in the"]
_FIX_COLUMNS = [
    "concat(doc_id, '-', span_start, '-', length(original)) as issue_id", "source as workspace_id", "'caption' as source_type",
    "cast(doc_id as string) as source_id", "cast(null as string) as artboard_id", "cast(null as string) as box_id", "original",
    "upper(original) as suggestion", "span_start", "cast(span_start + length(original) as int) as span_end",
    "case when (doc_id + span_start) % 5 = 0 then 'ignored' when (doc_id + span_start) % 5 = 1 then 'accepted' else 'open' end as status",
    "(n_chars + span_start) % 3 <> 0 as is_definite", "0.8 + cast((n_chars + span_start) % 20 as double) / 100 as confidence", "'medium' as severity"]
_FIX_SQL = f"""(with posts as (select doc_id, text from documents), {spans_cte('wd', r'[\p{L}\p{N}_]+', w())},
  g as (select doc_id, cast(s as int) as span_start, o, lead(o) over v as o2, lead(gap) over v as g2, gap from wd window v as (partition by doc_id order by s)),
  h as (select doc_id, span_start, o as original from g where o in ({", ".join(q(x) for x in _FIX_WORDS)})
    union all select doc_id, span_start, concat(o, ' ', o2) from g where gap = ' ' and concat(o, ' ', o2) in ({", ".join(q(x) for x in _FIX_PAIRS)}))
  select h.*, n_chars, source from h join documents using (doc_id))"""
FIXES = f"select {', '.join(_FIX_COLUMNS)} from {_FIX_SQL}"
# every document stands under the same id in its own workspace and in one more that has no fixes
TEXTS = ("select 'caption' as source_type, cast(doc_id as string) as source_id, source as workspace_id, text from documents union all "
         "select 'caption', cast(doc_id as string), 'mirror', text from documents")

# boxes: each word (even turns) or sentence (odd turns) of every conversation text
_BOX_COLS = """concat('w', conv_id % 10) as workspace_id, concat('as', conv_id % 400) as asset_id,
  (conv_id * 100 + turn) * 10000 + i as ord, concat('bx', conv_id, '-', turn, '-', i) as box_id, piece as text,
  cast((conv_id * 7 + turn * 13 + i * 3) % 100 as double) / 100 as confidence, cast(turn * 10 + i * 4 as double) as x0,
  cast(conv_id % 5 * 8 as double) as y0, cast(turn * 10 + i * 4 + 90 as double) as x1, cast(conv_id % 5 * 8 + 24 as double) as y1"""
BOXES = f"""select {_BOX_COLS} from (select conv_id, turn, unnest(p) as piece, unnest(range(len(p))) as i from
  (select conv_id, turn, string_split(text, case when turn % 2 = 0 then ' ' else '. ' end) as p from conversations))"""


def issues(spark, d):
    return view(spark, d, ISSUES, "events")


def fixes(spark, d):
    from redpencil.functions.exprs import chunks, cut, let, lit, spans
    x, i = fresh("x"), fresh("i")
    found = documents(spark, d).select("doc_id", "n_chars", "source", "text", F.expr(spans("text", r"[\p{L}\p{N}_]+")).alias("w"))
    pair = lambda p: cut(p, "text", f"{x}.s", f"get(w, {i} + 1).e - {x}.s")
    hits = let(chunks("text"), lambda p: (f"concat(transform(w, {x} -> named_struct('span_start', {x}.s, 'original', {x}.o)), "
            f"transform(w, ({x}, {i}) -> named_struct('span_start', {x}.s, 'original', {pair(p)})))"))
    fits = f"filter({hits}, {x} -> coalesce({x}.original in ({', '.join(lit(v) for v in [*_FIX_WORDS, *_FIX_PAIRS])}), false))"
    return found.select("doc_id", "n_chars", "source", F.expr(f"inline({fits})")).selectExpr(*_FIX_COLUMNS)


def texts(spark, d):
    return view(spark, d, TEXTS, "documents")


def boxes(spark, d):
    pieces = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.expr("split(text, if(turn % 2 = 0, ' ', '[.] '))")).alias("i", "piece"))
    b = pieces.selectExpr(*[c.strip() for c in re.split(r",(?![^(]*[)])", _BOX_COLS)])
    return b.withColumn("bbox", F.struct("x0", "y0", "x1", "y1")).drop("x0", "y0", "x1", "y1")


def content(spark, d):
    t = documents(spark, d)
    return t.select(F.col("source").alias("workspace_id"), F.lit("caption").alias("source_type"),
                    F.col("doc_id").cast("string").alias("source_id"), "text", "lang")


# -- flagship: the whole checker ------------------------------------------------------

@register("check_summary")
def _(spark, d):
    """E1 + A1: all rules, guards, suppression, resolution; counted per source."""
    found = checker.check(content(spark, d), lexicon())
    return found.groupBy("workspace_id", "reason_code", "type", "severity").agg(
        F.count(F.lit(1)).alias("issues"), F.count_if("is_definite").alias("definite"))


@register("check_posts")
def _(spark, d):
    """All rules over posts in which every rule family fires."""
    c = posts(spark, d).select(F.col("source").alias("workspace_id"), F.lit("caption").alias("source_type"),
                               F.col("doc_id").cast("string").alias("source_id"), "text")
    found = checker.check(c, lexicon())
    return found.groupBy("reason_code").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("source_id").alias("texts"))


FIVE = {71: 0.90, 57: 0.94, 63: 0.99, 21: 0.93, 53: 0.94}
_DOCS = "select doc_id, text from documents"
_RAW5 = " union all ".join(
    f"select doc_id, span_start as s, span_end as e, original as o, suggestion as g, {r} as rule, {c} as conf from ("
    + RULE_SQL[f"rule_{r}"].replace(POSTS, _DOCS) + ")" for r, c in FIVE.items())
RESOLVE = f"""with recursive u as (select h.*, text from ({_RAW5}) h join documents using (doc_id)),
  x as (with posts as ({_DOCS}), {spans_cte('uu', r"https?://[^\s<>\x22\x27`]+|www\.[^\s<>\x22\x27`]+|(?:^|[^@\p{L}\p{N}_-])(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:com|net|org|io|vn|app|dev|ai|co|me|edu|gov|info|biz|xyz|site|online|cloud|gg|ly)(?:/[^\s<>\x22\x27`]*)?", w(), flags="gi")}
    select doc_id, s + length(o) - length(regexp_replace(o, '^[^a-zA-Z0-9]', '')) as s, s + length(regexp_replace(o, '[),.!?;:]+$', '')) as e from uu),
  pass as (select * from u where o <> g and (rule = 21 or not exists (select 1 from x where x.doc_id = u.doc_id and x.s < u.e and u.s < x.e))),
  isl as (select *, sum(opens) over (partition by doc_id order by s, e, rule) as island from
    (select *, case when s < max(e) over (partition by doc_id order by s, e, rule rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from pass)),
  rk as (select *, row_number() over (partition by doc_id, island order by s - e, -conf, rule, s) as k from isl),
  f(doc_id, island, k, acc, s, e, o, g, rule, hit) as (
    select doc_id, island, k, [{{'s': s, 'e': e}}], s, e, o, g, rule, true from rk where k = 1
    union all
    select r.doc_id, r.island, r.k, case when len(list_filter(f.acc, lambda a: a.s < r.e and r.s < a.e)) > 0 then f.acc
      else list_append(f.acc, {{'s': r.s, 'e': r.e}}) end, r.s, r.e, r.o, r.g, r.rule,
      len(list_filter(f.acc, lambda a: a.s < r.e and r.s < a.e)) = 0
    from f join rk r on r.doc_id = f.doc_id and r.island = f.island and r.k = f.k + 1)
  select doc_id, cast(s as int) as span_start, cast(e as int) as span_end, o as original, g as suggestion, concat('R', rule) as rule
  from f where hit"""


@register("resolve_overlaps", RESOLVE)
def _(spark, d):
    """J4 + J7: five rules over whole documents, guarded and resolved."""
    lex = lexicon()
    for name in ("brand_terms", "product_terms", "preferred_spellings"):
        setattr(lex, name, type(getattr(lex, name))())
    hits = checker.rule_hits(documents(spark, d), lex, set(FIVE), ["doc_id"])
    return hits.select("doc_id", "span_start", "span_end", "original", "suggestion",
                       F.expr("concat('R', code div 10)").alias("rule"))


# -- normalisers and predicates (P1-P20) ----------------------------------------------

def _norm(spark, d):
    return documents(spark, d).select(
        "doc_id", F.length(F.expr(tx.comparable("text"))).alias("comparable_len"),
        F.md5(F.expr(tx.compact_key("text"))).alias("compact"), F.md5(F.expr(tx.digit_signature("text"))).alias("digits"),
        F.expr(tx.word_count("text")).alias("words"), F.expr(tx.letter_count("text")).alias("letters"),
        F.expr(tx.alnum_count("text")).alias("alnum"))


shared("normalise_text", _norm, r"""select doc_id, length(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) as comparable_len,
  md5(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')) as compact, md5(array_to_string(regexp_extract_all(text, '[0-9]+'), '|')) as digits,
  len(regexp_extract_all(text, '[\p{L}\p{N}]+')) as words, len(regexp_extract_all(text, '\p{L}')) as letters,
  len(regexp_extract_all(text, '[\p{L}\p{N}]')) as alnum from documents""")

shared("nfkc_text", lambda s, d: documents(s, d).select("doc_id", F.length(tx.nfkc(F.concat("text", F.lit(" ﬁ ½ Ａ")))).alias("n")),
       "select doc_id, length(text) + length(' fi 1⁄2 A') as n from documents")

shared("label_predicate", lambda s, d: view(s, d, POSTS, "documents").select(
    "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
    "doc_id", "pos", F.expr(tx.is_label("split_part(line, ':', 1)")).alias("is_label"),
    F.expr(tx.is_value("split_part(line, ' ', 2)")).alias("is_value")).where("is_label or is_value"),
    None or "")
from checks import rules as _r  # noqa: E402

ORACLE_SQL["label_predicate"] = (
    f"with posts as ({POSTS}), l as (select doc_id, unnest(string_split(text, chr(10))) as line, "
    f"generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from posts), "
    f"m as (select doc_id, cast(pos as int) as pos, {_r.label(chr(115) + 'plit_part(line, chr(58), 1)')} as is_label, "
    f"{_r.value('split_part(line, chr(32), 2)')} as is_value from l) select * from m where is_label or is_value")

shared("candidate_normalise", lambda s, d: issues(s, d).select(
    "issue_id", F.expr(tx.candidate_type("if(type = 'style', 'brand_consistency', concat(type, if(is_definite, '', 'x')))")).alias("type"),
    F.expr(tx.candidate_severity("if(is_definite, severity, 'odd')")).alias("severity"),
    F.expr(tx.needs_manual_check("severity", "status", "type")).alias("manual"),
    F.expr(tx.severity_rank("severity")).alias("rank")),
    f"""select issue_id, case when type = 'style' then 'brand_term' when is_definite then type else 'spelling' end as type,
    case when is_definite then severity else 'needs_review' end as severity,
    (severity = 'needs_review' or status = 'needs_human_review' or type = 'ocr_low_confidence') as manual,
    list_position(['critical','high','medium','low','suggestion','needs_review'], severity) - 1 as rank from ({ISSUES})""")

shared("preserve_case", lambda s, d: issues(s, d).select(
    "issue_id", F.expr(tx.preserve_case("if(is_definite, upper(original), initcap(original))", "concat('x', suggestion)")).alias("shaped"),
    F.expr(tx.case_only("original", "upper(original)")).alias("case_only")),
    f"""select issue_id, case when is_definite then upper(concat('x', suggestion)) else concat('X', suggestion) end as shaped,
    true as case_only from ({ISSUES})""")

shared("self_check", lambda s, d: issues(s, d).withColumn("c", F.expr(
    "if(status = 'open', null, named_struct('exact_substring', status <> 'ignored', 'visible_or_in_ocr', true, "
    "'not_protected_term', status <> 'resolved', 'not_ocr_uncertainty', status <> 'accepted'))")).select(
    "issue_id", F.expr(tx.self_check_passes("c", "severity", "is_definite")).alias("passes")),
    f"""select issue_id, case when status = 'open' then true when status in ('ignored', 'resolved') then false
    when status = 'accepted' then severity = 'needs_review' or not is_definite else true end as passes from ({ISSUES})""")

shared("display_reason", lambda s, d: issues(s, d).select("issue_id", F.expr(tx.display_reason(
    "concat('Incorrect OCR of ', original, '. OCR text')")).alias("reason")),
    f"select issue_id, concat('Text may be misread: ', original, '. text read from the image') as reason from ({ISSUES})")

shared("workspace_search", lambda s, d: issues(s, d).where(tx.project_name_filter("workspace_id", "' W1'")).select("issue_id"),
       f"select issue_id from ({ISSUES}) where contains(lower(workspace_id), 'w1')")

# -- ranges (J1-J5) -------------------------------------------------------------------

_URL_RE2 = (r"https?://[^\s<>\x22\x27`]+|www\.[^\s<>\x22\x27`]+|(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:com|net|org|io|vn|app|dev|ai|co|me"
            r"|edu|gov|info|biz|xyz|site|online|cloud|gg|ly)(?:/[^\s<>\x22\x27`]*)?")


def _merge_sql(src: str) -> str:
    return (f"select doc_id, cast(min(s) as int) as span_start, cast(max(e) as int) as span_end from (select *, sum(o) over (partition by doc_id order by s, e) as isl from "
            f"(select *, case when s <= max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as o from {src})) group by doc_id, isl")


def _ranges(kind):
    def run(spark, d):
        src = (table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text")) if kind == "url"
               else documents(spark, d))
        e = rg.url_ranges("text", "lower(text)") if kind == "url" else rg.term_ranges(
            "lower(text)", ["the of", "of the", "the", "les", "de la", "and in"])
        x = src.select("doc_id", F.expr(f"inline_outer({e})")).where("s is not null")
        return x.select("doc_id", F.col("s").alias("span_start"), F.col("e").alias("span_end"))
    return run


shared("url_ranges", _ranges("url"),
       f"with posts as (select page_id as doc_id, url as text from pages), {spans_cte('m', _URL_RE2, w(), flags='gi')}, "
       f"n as (select doc_id, s, s + length(regexp_replace(o, '[),.!?;:]+$', '')) as e from m) " + _merge_sql("n"))
_TERMS = ["the of", "of the", "the", "les", "de la", "and in"]
shared("protected_ranges", _ranges("term"),
       f"with posts as ({_DOCS}), {spans_cte('wd', r'[\p{L}\p{N}_]+', w())}, "
       f"g as (select doc_id, s, e, lower(o) as o, lower(concat(o, ' ', lead(o) over v)) as o2, lead(e) over v as e2, gap from wd window v as (partition by doc_id order by s)), "
       f"n as (select doc_id, s, e from g where o in ({', '.join(q(t) for t in _TERMS if ' ' not in t)}) union all "
       f"select doc_id, s, e2 from g where gap = ' ' and o2 in ({', '.join(q(t) for t in _TERMS if ' ' in t)})) " + _merge_sql("n"))


@register("protected_terms", "select distinct p_brand as term from part")
def _(spark, d):
    """J2 on a lexicon table derived from part brands (list, wrong, right)."""
    p = table(spark, d, "part")
    lexi = p.select(F.expr("case p_partkey % 3 when 0 then 'brand_terms' when 1 then 'do_not_change' else 'product_terms' end").alias("list"),
                    F.col("p_name").alias("wrong"), F.concat(F.lit(" "), "p_brand").alias("right"))
    from redpencil.lexicon import protected_terms
    return protected_terms(lexi)


@register("dictionary_join", f"""with posts as ({_DOCS}), {spans_cte('wd', r'[\p{L}\p{N}_]+', w())},
  k as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as wrong from benchmark)
  select doc_id, wrong as list, cast(s as int) as span_start, cast(e as int) as span_end, o as original, upper(wrong) as suggestion from wd join k on k.wrong = lower(o)""")
def _(spark, d):
    """DICT for a lexicon of any size: words met by hash join."""
    from redpencil.operators.dictionary import joined_hits
    words = table(spark, d, "benchmark").select(F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)")).alias("wrong")).distinct()
    return joined_hits(documents(spark, d).select("doc_id", "text"), words.select(F.col("wrong").alias("list"), "wrong", F.upper("wrong").alias("right")), ["doc_id"])


@register("check_large_lexicon", f"""with posts as ({_DOCS}), {spans_cte('wd', r'[\p{L}\p{N}_]+', w())},
  g as (select doc_id, s, lead(e) over v as e, concat(o, ' ', lead(o) over v) as o, gap from wd window v as (partition by doc_id order by s)),
  b as (select item_id as doc_id, text from benchmark), bw as (select doc_id, s, o, gap from (with posts as (select * from b), {spans_cte('wd', r'[\p{L}\p{N}_]+', w())} select * from wd)),
  k as (select distinct lower(concat(o, ' ', lead(o) over v)) as w, gap from bw window v as (partition by doc_id order by s))
  select doc_id, cast(s as int) as span_start, cast(e as int) as span_end, o as original, 'OK GO' as suggestion from g
  where gap = ' ' and lower(o) in (select w from k where gap = ' ' and w is not null)""")
def _(spark, d):
    """R66 with a lexicon table: all neighbouring words of all benchmark texts, matched inside the checker."""
    x, i = fresh("x"), fresh("i")
    from redpencil.functions.exprs import spans
    pairs = table(spark, d, "benchmark").select("text", F.expr(spans("text", r"[\p{L}\p{N}_]+")).alias("w")).select(F.explode(F.expr(
        f"filter(transform(slice(w, 1, greatest(size(w) - 1, 0)), ({x}, {i}) -> substring(text, {x}.s + 1, w[{i} + 1].e - {x}.s)), "
        f"{x} -> {x} rlike '^[^ ]+ [^ ]+$' and not {x} rlike '[^\\\\p{{L}}\\\\p{{N}}_ ]')")).alias("pair"))
    lexi = pairs.select(F.lower("pair").alias("wrong")).distinct().select(
        F.lit("product_terms").alias("list"), "wrong", F.lit("OK GO").alias("right"), F.lit(None).cast("string").alias("priority"), F.lit(0).alias("ord"))
    from redpencil.lexicon import Lexicon
    return checker.rule_hits(documents(spark, d).select("doc_id", "text"), Lexicon(), {66}, ["doc_id"], guard=False, resolve=False, table=lexi).drop("code")


# -- candidates (J8-J16) --------------------------------------------------------------

_AT = "cast(doc_id * 7919 % greatest(n_chars - 6, 1) + 2 as int)"
CANDS = f"""select source as workspace_id, cast(d.doc_id as string) as source_id, 'caption' as source_type, cast(null as string) as artboard_id,
  cast(null as string) as box_id, 'style' as type, 'low' as severity, substr(text, {_AT}, 6) as original,
  reverse(substr(text, {_AT}, 6)) as suggestion, 'r' as reason, cast(n_chars % 13 as double) / 10 as confidence,
  n_chars % 2 = 0 as is_definite, case when n_chars % 3 = 0 then substr(text, {_AT} - 1, 1) end as context_before,
  case when n_chars % 5 = 0 then 'zz' end as context_after, 'reviewer' as created_by, doc_id as ord from documents d"""
_CB = "coalesce(context_before, '')"
_CA = "coalesce(context_after, '')"
_LOC = (f"case when instr(text, concat({_CB}, original, {_CA})) > 0 then instr(text, concat({_CB}, original, {_CA})) - 1 + length({_CB}) "
        f"else instr(text, original) - 1 end")


@register("locate_quotes", f"""select c.source_id, cast({_LOC} as int) as span_start from ({CANDS}) c join documents d
  on cast(d.doc_id as string) = c.source_id where original <> '' and instr(text, original) > 0""")
def _(spark, d):
    """J8."""
    j = view(spark, d, CANDS, "documents").join(texts(spark, d).select("workspace_id", "source_id", "text"), ["workspace_id", "source_id"])
    return (j.select("source_id", F.expr(cd.located("text", "original", "context_before", "context_after")).alias("span_start"))
            .where("span_start is not null"))


@register("locate_benchmark", """select item_id, doc_id, cast(instr(d.text, b.text) - 1 as int) as span_start
  from benchmark b join documents d on instr(d.text, b.text) > 0""")
def _(spark, d):
    """J8 at large: whole benchmark texts quoted in documents, found through the words they start
    with (hash join) instead of comparing every pair."""
    from redpencil.functions.exprs import chunks, cut, let, spans
    opening = r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+(?:[^\p{L}\p{N}]+[\p{L}\p{N}]+){0,2})"
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"), F.expr(f"regexp_extract(text, r'{opening}', 1)").alias("key"))
    x, i, n = fresh("x"), fresh("i"), fresh("n")
    grams = let(chunks("text"), lambda p: (
        f"flatten(transform(sequence(0, 2), {n} -> transform(slice(w, 1, greatest(size(w) - {n}, 0)), ({x}, {i}) -> "
        f"{cut(p, 'text', f'{x}.s', f'w[{i} + {n}].e - {x}.s')})))"))
    docs = documents(spark, d).select("doc_id", "text", F.expr(spans("text", r"[\p{L}\p{N}]+")).alias("w"))
    keyed = docs.select("doc_id", F.explode(F.array_distinct(F.expr(grams))).alias("key"))
    pairs = keyed.join(b, "key").select("doc_id", "item_id", "quote").distinct()
    hits = pairs.join(documents(spark, d).select("doc_id", "text"), "doc_id").where("instr(text, quote) > 0")
    return hits.select("item_id", "doc_id", F.expr("cast(instr(text, quote) - 1 as int)").alias("span_start"))


@register("validate_candidates", f"""with c as (select c.*, text, cast({_LOC} as int) as s from ({CANDS}) c join documents d
  on cast(d.doc_id as string) = c.source_id where original <> '' and instr(text, original) > 0),
  t as (select doc_id, s, e from (with posts as ({_DOCS}), {spans_cte('u', _URL_RE2, w(), flags='gi')} select doc_id, s, e from u)),
  fl as (select *, trim(regexp_extract(text, '^\\s*([^\\n\\r]+)', 1)) as h, length(regexp_extract(text, '^\\s*')) as hs from c),
  k as (select *, len(regexp_extract_all(h, '\\p{{L}}')) >= 2 and not regexp_matches(h, '\\p{{Ll}}') and len(regexp_extract_all(h, '\\p{{Lu}}')) >= 0.8 * len(regexp_extract_all(h, '\\p{{L}}'))
    and len(regexp_extract_all(h, '[\\p{{L}}\\p{{N}}]+')) <= 14 and length(h) <= 120 as cap from fl)
  select source_id, s as span_start, s + length(original) as span_end, original, suggestion, least(1.0, greatest(0.0, confidence)) as confidence, is_definite,
    substr(text, greatest(s - 12, 0) + 1, least(s, 12)) as context_before, substr(text, s + length(original) + 1, 12) as context_after from k
  where not exists (select 1 from t where cast(t.doc_id as string) = source_id and t.s < k.s + length(original) and k.s < t.e)
    and not (cap and original <> suggestion and lower(original) = lower(suggestion) and s >= hs and s + length(original) <= hs + length(h) and len(regexp_extract_all(original, '\\p{{L}}')) >= 2 and not regexp_matches(original, '\\p{{Ll}}'))""")
def _(spark, d):
    """J9 without protected terms (those are covered by tests)."""
    from redpencil.lexicon import Lexicon
    v = cd.validate(view(spark, d, CANDS, "documents"), texts(spark, d), Lexicon())
    return v.select("source_id", "span_start", "span_end", "original", "suggestion", "confidence", "is_definite",
                    "context_before", "context_after")


@register("validate_box_candidates")
def _(spark, d):
    """J10."""
    b = boxes(spark, d).withColumn("visual_role", F.lit("graphic_text")).withColumn("visual_should_check", F.lit(True))
    c = b.select("box_id", F.lit("caption").alias("source_type"), F.lit("").alias("source_id"), F.lit(None).cast("string").alias("artboard_id"),
                 F.lit("spelling").alias("type"), F.lit("high").alias("severity"), F.col("text").alias("original"),
                 F.expr("concat(text, 'x')").alias("suggestion"), F.lit("r").alias("reason"), "confidence",
                 F.lit(False).alias("is_definite"), F.lit(None).cast("string").alias("context_before"),
                 F.lit(None).cast("string").alias("context_after"), F.lit("reviewer").alias("created_by"), "ord",
                 F.expr("cast(null as struct<exact_substring:boolean,visible_or_in_ocr:boolean,not_ocr_uncertainty:boolean,not_protected_term:boolean>)").alias("self_check"))
    v = cd.validate_boxes(c, b, lexicon())
    return v.select("source_id", "box_id", "original", "suggestion", "confidence", "is_definite", "bbox.x0", "bbox.x1")


_SIG = "concat_ws('|', type, severity, lower(original), lower(suggestion), source_type, coalesce(artboard_id, ''), coalesce(box_id, ''))"


@register("verifier_filter", f"""with c as (select *, {_SIG} as sig from ({ISSUES})), v as (select distinct workspace_id, source_id, sig from c where status = 'open' and ord % 2 = 0)
  select issue_id from c where exists (select 1 from v where v.workspace_id = c.workspace_id and v.source_id = c.source_id and v.sig = c.sig)
    or not exists (select 1 from v where v.workspace_id = c.workspace_id and v.source_id = c.source_id)""")
def _(spark, d):
    """J11."""
    c = issues(spark, d)
    v = c.where("status = 'open' and ord % 2 = 0").select("workspace_id", "source_id", cd.signature().alias("signature"))
    return cd.keep_verified(c, v).select("issue_id")


@register("merge_rule_wins", f"""with i as ({ISSUES}), r as (select * from i where ord % 2 = 0), c as (select * from i where ord % 2 = 1)
  select source_type, source_id, issue_id from c where not exists (select 1 from r where r.workspace_id = c.workspace_id and r.source_type = c.source_type and r.source_id = c.source_id
   and ((r.span_start < c.span_end and c.span_start < r.span_end) or (r.original = c.original and r.span_start = c.span_start)))""")
def _(spark, d):
    """J12, first half: candidates that clash with a rule issue go."""
    i = issues(spark, d)
    r = i.where("ord % 2 = 0").select(F.col("source_type").alias("a"), F.col("source_id").alias("b"), F.col("workspace_id").alias("w"), F.col("span_start").alias("rs"),
                                      F.col("span_end").alias("re"), F.col("original").alias("ro"))
    c = i.where("ord % 2 = 1")
    out = c.join(r, (F.col("source_type") == F.col("a")) & (F.col("source_id") == F.col("b")) & (F.col("workspace_id") == F.col("w"))
                 & F.expr("(rs < span_end and span_start < re) or (ro = original and rs = span_start)"), "left_anti")
    return out.select("source_type", "source_id", "issue_id")


@register("consensus")
def _(spark, d):
    """J16."""
    i = issues(spark, d).where("source_type = 'image'")
    out = cd.accept_by_consensus(i.where("ord % 3 <> 0"), i.where("ord % 3 = 0"))
    return out.groupBy("source_id", "severity").agg(F.count(F.lit(1)).alias("issues"), F.max("confidence").alias("confidence"))


# -- decisions and scopes (J17-J28, C4) -----------------------------------------------

_KEY = "workspace_id, source_type, source_id, original, suggestion"
DECISIONS = f"select {_KEY}, status, ts, ord from ({ISSUES}) where status in ('accepted', 'ignored')"


def _decisions(spark, d):
    return view(spark, d, DECISIONS, "events")


shared("latest_decisions", lambda s, d: dc.latest_decisions(_decisions(s, d)),
       f"select {_KEY}, arg_max(status, ts) as status from ({DECISIONS}) group by all")
shared("carry_over", lambda s, d: dc.carry_over(issues(s, d), _decisions(s, d)).select("issue_id", "status"),
       f"select i.issue_id, coalesce(p.status, i.status) as status from ({ISSUES}) i left join (select {_KEY}, arg_max(status, ts) as status "
       f"from ({DECISIONS}) group by all) p using ({_KEY})")
shared("scoped_replace", lambda s, d: dc.replace_scope(
    issues(s, d), issues(s, d).where("is_definite").withColumn("status", F.lit("open")),
    issues(s, d).where("workspace_id in ('w1', 'w2', 'w3')"),
    ["workspace_id"]).select("issue_id", "status"),
    f"select issue_id, status from ({ISSUES}) where workspace_id not in ('w1', 'w2', 'w3') union all "
    f"select issue_id, 'open' from ({ISSUES}) where workspace_id in ('w1', 'w2', 'w3') and is_definite")


def _upsert(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))
    new = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("k"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("kind"))
    return dc.replace_by_id(old, new, "k")


shared("field_upsert", _upsert, """select coalesce(n.k, o.k) as k, coalesce(n.name, o.name) as name, coalesce(n.kind, o.kind) as kind
  from (select c_custkey as k, c_name as name, c_mktsegment as kind from customer) o
  full join (select s_suppkey * 3 as k, s_name as name, cast(null as varchar) as kind from supplier) n on n.k = o.k""")


def _stale(spark, d):
    c = table(spark, d, "documents")
    res = c.select("doc_id", F.expr("if(n_chars % 4 = 0, 'old', text)").alias("text")).withColumn("fingerprint", dc.fingerprint("doc_id", "text"))
    cur = c.select("doc_id", "text").withColumn("fingerprint", dc.fingerprint("doc_id", "text"))
    ok, bad = dc.split_stale(res, cur, ["doc_id"])
    return ok.select("doc_id", F.lit(False).alias("stale")).unionByName(bad.select("doc_id", F.lit(True).alias("stale")))


shared("stale_results", _stale, "select doc_id, n_chars % 4 = 0 as stale from documents")


def _cache(spark, d):
    c = documents(spark, d).withColumn("h", F.sha2("text", 256)).withColumn("l", F.col("lang"))
    work = c.withColumn("key", dc.cache_key("qa", "v1", "h", "l"))
    return dc.cache_misses(work, work.where("n_chars % 2 = 0")).groupBy("lang").agg(F.count(F.lit(1)).alias("misses"))


shared("cache_misses", _cache, """select lang, count(distinct text) as misses from documents a where not exists
  (select 1 from documents b where b.lang = a.lang and b.text = a.text and b.n_chars % 2 = 0) group by lang""")
shared("add_terms", lambda s, d: dc.add_terms(issues(s, d), issues(s, d).where("status = 'ignored'")).select("issue_id", "status"),
       f"""with i as ({ISSUES}), t as (select distinct original, suggestion from i where status = 'ignored')
       select issue_id, case when exists (select 1 from t where t.original = i.original and t.suggestion = i.suggestion) then 'ignored' else status end as status from i""")

_HELD = """select 'product_terms' as list, concat(event_type, user_id) as wrong, concat('r', event_id) as right, cast(null as string) as priority, event_id as ord from events where event_id % 2 = 0
  union all select 'brand_terms', null, concat('b', user_id), null, event_id from events where event_id % 2 = 0"""
_ADDED = """select 'product_terms' as list, concat(event_type, user_id) as wrong, concat(' n', event_id) as right, event_id as ord from events where event_id % 2 = 1
  union all select 'brand_terms', null, concat('b', user_id, ' '), event_id from events where event_id % 2 = 1"""
shared("append_terms", lambda s, d: dc.append_terms(view(s, d, _HELD, "events"), view(s, d, _ADDED, "events"))[0].select("list", "wrong", "right", "ord"),
       f"""with u as (select list, wrong, "right", ord from ({_HELD}) union all select list, wrong, trim("right") as "right", 1000000000000 + ord from ({_ADDED})),
       g as (select list, wrong, arg_max("right", ord) as "right", min(ord) as place from u where wrong is not null group by all union all select list, null, "right", min(ord) from u where wrong is null group by all),
       t as (select list, max(ord) as top from ({_HELD}) group by all)
       select list, wrong, "right", case when place < 1000000000000 then place else top + 1 + place - 1000000000000 end as ord from g join t using (list)""")
BOARDS = """select concat('a', k) as artboard_id, k as ord, case k % 3 when 0 then 'visual' when 1 then 'caption' else 'note' end as kind,
  concat('Card ', k) as label, 1080.0 as width, 1350.0 as height, 'carousel_slide' as format from (select distinct user_id % 7 as k from events)"""
LAYERS = """select concat('l', p_partkey) as layer_id, concat('a', p_partkey % 7) as artboard_id, concat('d', p_partkey % 50) as asset_id,
  cast(p_size as double) as x, 0.0 as y, cast(p_size * 40 as double) as width, cast(p_retailprice as double) as height,
  case when p_partkey % 2 = 0 then 'cover' else 'contain' end as fit_mode from part"""
ASSETS = """select concat('d', s_suppkey) as asset_id, cast(s_suppkey % 400 + 200 as int) as width, cast(s_nationkey * 20 + 300 as int) as height,
  concat('img', s_suppkey, '.png') as filename, case s_suppkey % 5 when 0 then 'failed' when 1 then 'low_confidence' else 'done' end as ocr_status,
  concat('w', s_suppkey % 20) as workspace_id from supplier"""
boards = lambda s, d: view(s, d, BOARDS, "events")
layers = lambda s, d: view(s, d, LAYERS, "part")
assets = lambda s, d: view(s, d, ASSETS, "supplier")

shared("first_artboard", lambda s, d: dc.first_artboard(layers(s, d), boards(s, d)),
       f"select asset_id, arg_min(artboard_id, ord) as artboard_id from ({LAYERS}) join ({BOARDS}) using (artboard_id) group by all")
shared("panel_scope", lambda s, d: dc.panel_scope(issues(s, d), boards(s, d).where("kind <> 'note'"), layers(s, d)).select("issue_id"),
       f"""with b as (select * from ({BOARDS}) where kind <> 'note'), u as (select distinct asset_id from ({LAYERS}) l join b using (artboard_id) where b.kind = 'visual')
       select issue_id from ({ISSUES}) i where case source_type when 'caption' then artboard_id is null or artboard_id in (select artboard_id from b)
         when 'image' then coalesce(artboard_id in (select artboard_id from b), false) or source_id in (select asset_id from u)
         else coalesce(artboard_id in (select artboard_id from b), false) end""")
shared("invalidate", lambda s, d: dc.invalidate(issues(s, d), issues(s, d).where("original like 'error%'"), ["source_type", "source_id"]).select("issue_id"),
       f"""with i as ({ISSUES}) select issue_id from i where status = 'ignored' or not exists
       (select 1 from i c where c.original like 'error%' and c.source_type = i.source_type and c.source_id = i.source_id)""")
shared("delete_assets", lambda s, d: dc.drop_assets(issues(s, d), assets(s, d).where("ocr_status = 'failed'")).select("issue_id"),
       f"select issue_id from ({ISSUES}) where not (source_type = 'image' and source_id in (select asset_id from ({ASSETS}) where ocr_status = 'failed'))")
shared("delete_cards", lambda s, d: dc.drop_cards(issues(s, d), boards(s, d).where("kind = 'note'")).select("issue_id"),
       f"select issue_id from ({ISSUES}) where status <> 'open' or artboard_id is null or artboard_id not in (select artboard_id from ({BOARDS}) where kind = 'note')")
shared("card_labels", lambda s, d: dc.card_labels(issues(s, d), boards(s, d), layers(s, d)).select("issue_id", "card_key", "card_title", "card_order"),
       f"""with b as ({BOARDS}), v as (select asset_id, arg_min(artboard_id, ord) as va from ({LAYERS}) join b using (artboard_id) group by all)
       select issue_id, case source_type when 'caption' then concat('caption:', coalesce(i.artboard_id, 'primary'))
          when 'image' then coalesce('artboard:' || coalesce(b.artboard_id, v.va), 'image-check') else coalesce('layout:' || b.artboard_id, 'layout') end as card_key,
        case source_type when 'caption' then coalesce(b.label, 'Caption Input 1') when 'image' then coalesce(b.label, b2.label, 'Visual Text Scanner') else coalesce(b.label, 'Layout') end as card_title,
        case source_type when 'caption' then case when i.artboard_id is null then -10 else coalesce(b.ord, 1000) end when 'image' then coalesce(b.ord, b2.ord, 900) else coalesce(b.ord, 950) end as card_order
       from ({ISSUES}) i left join b on b.artboard_id = i.artboard_id left join v on source_type = 'image' and i.artboard_id is null and v.asset_id = i.source_id left join b b2 on b2.artboard_id = v.va""")


def _layering(spark, d):
    rows = table(spark, d, "part").select(
        F.expr("if(p_size % 2 = 0, 'preferred_spellings', 'product_terms')").alias("list"), F.col("p_type").alias("wrong"),
        F.col("p_brand").alias("right"), F.lit(None).cast("string").alias("priority"),
        F.expr("cast(p_partkey * 1000 as int)").alias("ord"), (F.col("p_size") % 4 * 30000).alias("layer_ord"))
    return lx.layered(rows).select("list", "wrong", "right", "layer_ord", "ord")


shared("lexicon_layers", _layering, """select case when p_size % 2 = 0 then 'preferred_spellings' else 'product_terms' end as list, p_type as wrong,
  arg_max(p_brand, row(p_size % 4, p_partkey)) as right, min(p_size % 4) * 30000 as layer_ord,
  arg_min(p_partkey, row(p_size % 4, p_partkey)) * 1000 as ord from part group by 1, 2""")
_PROSE = "select c_custkey as id, concat('- ', c_name, ' -> ', upper(c_mktsegment), chr(10), '# ', c_name, ' -> x', chr(10), c_mktsegment, ' => ', c_name) as text from customer"
shared("pairs_from_text", lambda s, d: lx.pairs_from_text(view(s, d, _PROSE, "customer"), "id").select("id", "wrong", "right"),
       "select c_custkey as id, c_name as wrong, upper(c_mktsegment) as right from customer union all select c_custkey, c_mktsegment, c_name from customer")
shared("dedupe_pairs", lambda s, d: lx.dedupe_pairs(table(s, d, "part").select(
    F.col("p_partkey").alias("ord"), F.concat(F.lit(" "), "p_type").alias("wrong"),
    F.expr("if(p_partkey % 2 = 0, upper(p_brand), p_brand)").alias("right"))),
    "select min(p_partkey) as ord, p_type as wrong, arg_min(case when p_partkey % 2 = 0 then upper(p_brand) else p_brand end, p_partkey) as right from part group by p_type, lower(p_brand)")
_SHEETS = """select concat('sheet', n_regionkey) as sheet, n_nationkey as ord, n_name as c1, concat('x', n_nationkey) as c2 from nation
  union all select concat('sheet', r_regionkey), -1, 'Sai', 'Từ đúng' from region where r_regionkey % 2 = 0
  union all select concat('glossary', r_regionkey), 0, r_name, 'y' from region"""
shared("glossary_pairs", lambda s, d: lx.glossary_pairs(view(s, d, _SHEETS, "nation", "region").select("sheet", "ord", F.array("c1", "c2").alias("cells"))),
       """select concat('sheet', n_regionkey) as sheet, n_nationkey as ord, n_name as wrong, concat('x', n_nationkey) as right from nation where n_regionkey % 2 = 0
       union all select concat('glossary', r_regionkey), 0, r_name, 'y' from region""")


def _kits(spark, d):
    k = table(spark, d, "part").select(F.col("p_partkey").alias("kit"), F.to_json(F.struct(
        F.array("p_brand", F.lit(" ")).alias("brand_terms"), F.create_map("p_type", "p_name").alias("product_terms"),
        F.create_map("p_name", F.struct(F.lit("odd").alias("priority"), F.col("p_brand").alias("suggestion"))).alias("risky_words"))).alias("json"))
    return lx.kit_rows(k).select("kit", "list", "wrong", "right", "priority")


shared("kit_rows", _kits, """select p_partkey as kit, 'brand_terms' as list, cast(null as varchar) as wrong, p_brand as right, cast(null as varchar) as priority from part
  union all select p_partkey, 'product_terms', p_type, p_name, null from part union all select p_partkey, 'risky_words', p_name, p_brand, 'medium' from part""")
shared("clean_documents", lambda s, d: documents(s, d).select("doc_id", F.md5(F.expr(lx.clean_document(
    "concat(text, chr(13), chr(10), '  ', chr(9), chr(10), chr(10), chr(10), chr(10), chr(10), 'end ')"))).alias("text")),
    r"""select doc_id, md5(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(concat(text, chr(13), chr(10), '  ', chr(9), chr(10), chr(10), chr(10), chr(10), chr(10), 'end '),
    '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{4,}', concat(chr(10), chr(10), chr(10)), 'g')), '^\s+', '')) as text from documents""")


# -- sources (S1-S8, S17, S18) --------------------------------------------------------

def _workspaces(spark, d):
    c = table(spark, d, "conversations")
    cards = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("c"))
    return cards.select(
        F.col("conv_id").cast("string").alias("id"),
        F.struct(F.concat(F.lit("cap"), "conv_id").alias("id"), F.expr("c[0].text").alias("text")).alias("caption"),
        F.expr("transform(c, x -> named_struct('id', if(x.turn = 0, 'artboard_caption', concat('ab', conv_id, '-', x.turn)), 'format', "
               "if(x.role = 'user', 'caption', 'post'), 'kind', cast(null as string), 'label', x.role, 'width', 1D, 'height', 1D, 'text', x.text, "
               "'layers', cast(array() as array<struct<id:string,asset_id:string,slot_id:string,x:double,y:double,width:double,height:double,fit_mode:string>>)))").alias("artboards"))


def _content_scan(spark, d):
    from redpencil.sources import content as src
    return src.content(_workspaces(spark, d)).select("workspace_id", "source_id", F.length("text").alias("n"))


shared("content_scan", _content_scan, """select cast(conv_id as varchar) as workspace_id, concat('cap', conv_id) as source_id, length(arg_min(text, turn)) as n from conversations group by conv_id
  union all select cast(conv_id as varchar), concat('ab', conv_id, '-', turn), length(text) from conversations where role = 'user' and turn <> 0""")


def _scoped(spark, d):
    from redpencil.sources import content as src
    return src.scoped(src.content(_workspaces(spark, d)), src.PRIMARY_CARD).select("workspace_id", "source_id")


shared("scoped_scan", _scoped, "select distinct cast(conv_id as varchar) as workspace_id, concat('cap', conv_id) as source_id from conversations")


def _ingest(spark, d):
    from redpencil.sources import content as src
    files = table(spark, d, "documents").select(F.concat(F.lit("up/"), "doc_id", F.lit(".png")).alias("path"), F.encode("text", "utf-8").alias("content"))
    return src.ingest_assets(files).select("asset_id", "hash", "filename")


shared("ingest_assets", _ingest, """select concat('asset_', substr(sha256(text), 1, 12)) as asset_id, sha256(text) as hash,
  replace(min(concat('up/', doc_id, '.png')), 'up/', '') as filename from documents group by text""")


def _uploads(spark, d):
    from redpencil.sources import content as src
    f_ = table(spark, d, "orders").select(F.expr("o_custkey").alias("batch_id"), F.concat("o_orderkey", F.expr("if(o_orderkey % 50 = 0, '.gif', '.JPG')")).alias("path"),
                                          F.expr("cast(o_totalprice * 20 as bigint)").alias("length"))
    return src.upload_filter(f_).select("batch_id", "path")


shared("upload_filter", _uploads, """with f as (select o_custkey as batch_id, concat(o_orderkey, case when o_orderkey % 50 = 0 then '.gif' else '.JPG' end) as path,
  cast(floor(o_totalprice * 20) as bigint) as length, o_orderkey % 50 = 0 as gif from orders),
  b as (select batch_id from f group by all having not bool_or(gif or length > 10485760) and sum(length) <= 41943040) select batch_id, path from f semi join b using (batch_id)""")
_REPLY = "concat('Here: ', chr(96), chr(96), chr(96), 'json', chr(10), '[{', chr(34), 'original', chr(34), ':', chr(34), event_type, chr(34), ',', chr(34), 'confidence', chr(34), ':', user_id, '.5}]', chr(10), chr(96), chr(96), chr(96), ' bye')"
shared("candidate_replies", lambda s, d: rl.candidates(view(s, d, f"select event_id, {_REPLY} as reply from events", "events"), ["event_id"]).select("event_id", "original", "confidence"),
       "select event_id, event_type as original, cast(user_id as double) + 0.5 as confidence from events")
_IDS = "case event_id % 3 when 0 then concat('[', chr(34), 'i', event_id, chr(34), ']') when 1 then concat('ok {', chr(34), 'kept', chr(34), ': [', chr(34), 'i', event_id, chr(34), ']}') else concat('{', chr(34), 'issues', chr(34), ': [{', chr(34), 'issue_id', chr(34), ': ', chr(34), 'i', event_id, chr(34), '}]}') end"
shared("verifier_replies", lambda s, d: rl.verified_ids(view(s, d, f"select event_id, {_IDS} as reply from events", "events"), ["event_id"]),
       "select event_id, concat('i', event_id) as issue_id from events")

# -- boxes and layout (B1-B21) --------------------------------------------------------

_BX = f"({BOXES})"
_AL = r"len(regexp_extract_all(text, '[\p{L}\p{N}]'))"
_CK = r"regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')"


_COMPACT = r"select regexp_replace(lower(unnest(string_split(text, ' '))), '[^\p{L}\p{N}]+', '', 'g') as compact from conversations where role = 'user'"


def _compact(spark, d):
    lexi = table(spark, d, "conversations").select("role", F.lit("brand_terms").alias("list"), F.lit(None).cast("string").alias("wrong"),
                                                   F.explode(F.split("text", " ")).alias("right")).where("role = 'user'").drop("role")
    return bx.compact_terms(lexi)


shared("compact_terms", _compact, f"select distinct compact from ({_COMPACT}) where length(compact) >= 3")
_SIGNAL = (r"(len(regexp_extract_all(t, '[\p{L}\p{N}]+')) > 4 or regexp_matches(t, '[.!?;:|]') or regexp_matches(t, '(?i)#|@|https?://') or regexp_matches(t, '(?i)(^|[^A-Za-z0-9_])("
           + bx._SIGNALS + r")([^A-Za-z0-9_]|$)'))")
_ROLES = rf"""b0 as (select *, regexp_replace(trim(text), '\s+', ' ', 'g') as t, {_AL} as al, {_CK} as ck from {_BX}),
  roles as (select *, case when t = '' then 'decorative_text' when al = 0 or (not regexp_matches(t, '[0-9]') and ((al = 1 and length(t) <= 2 and confidence < 0.72)
    or (al <= 2 and length(t) <= 3 and confidence < 0.45))) then 'icon_noise'
    when ck in (select compact from ({_COMPACT})) and length(ck) >= 3 and not {_SIGNAL} and length(t) <= 48 then 'logo_wordmark'
    when confidence < 0.58 then 'unknown' else 'graphic_text' end as visual_role from b0)"""
roles = lambda s, d: bx.classify(boxes(s, d), _compact(s, d))
shared("box_roles", lambda s, d: roles(s, d).select("box_id", "visual_role", "visual_should_check", "visual_confidence"),
       f"""with {_ROLES} select box_id, visual_role, visual_role in ('graphic_text', 'unknown') as visual_should_check,
       case visual_role when 'decorative_text' then 0.92 when 'icon_noise' then 0.78 when 'logo_wordmark' then 0.88 when 'unknown' then greatest(0.4, confidence) else 0.74 end as visual_confidence from roles""")
_PROP = "select box_id, case ord % 4 when 0 then 'decorative_text' when 1 then 'icon_noise' when 2 then 'odd' else 'graphic_text' end as role, true as should_check, cast(ord % 10 as double) / 10 as confidence"
shared("box_role_overlay", lambda s, d: bx.overlay_roles(roles(s, d), boxes(s, d).selectExpr(*_PROP[7:].split(", "))).select("box_id", "visual_role", "visual_should_check"),
       f"""with {_ROLES}, p as (select *, case ord % 4 when 0 then 'decorative_text' when 1 then 'icon_noise' when 2 then 'unknown' else 'graphic_text' end as r, cast(ord % 10 as double) / 10 as c,
         visual_role in ('graphic_text', 'unknown') as was from roles),
       o as (select *, was and r not in ('graphic_text', 'unknown') and c < 0.75 and ({_SIGNAL} or len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+')) >= 3) as loses from p)
       select box_id, case when visual_role = 'logo_wordmark' or loses then visual_role else r end as visual_role,
         case when visual_role = 'logo_wordmark' then false when loses then true else r in ('graphic_text', 'unknown') end as visual_should_check from o""")
shared("box_role_summary", lambda s, d: bx.role_summary(roles(s, d)),
       f"with {_ROLES} select visual_role, count(*) as boxes, count(*) filter (visual_role in ('graphic_text', 'unknown') and trim(text) <> '') as checkable from roles group by all")
shared("box_lines", lambda s, d: bx.filter_lines(boxes(s, d)).select("box_id", "text"),
       rf"""select box_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as text from (select *, row_number() over (partition by asset_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))),
       floor(x0 / 4 + 0.5), floor(y0 / 4 + 0.5), floor(x1 / 4 + 0.5), floor(y1 / 4 + 0.5) order by ord) as n from {_BX} where {_AL} >= 2 and (regexp_matches(text, '\p{{L}}') or regexp_matches(text, '[0-9]{{2,}}'))) where n = 1""")


shared("box_rescale", lambda s, d: boxes(s, d).select("box_id", F.expr(bx.rescale("bbox", "0.37D", "0.5D", "200", "40")).alias("b")).select("box_id", "b.*"),
       f"""select box_id, cast(greatest(0, least(200, floor(x0 / 0.37::double + 0.5))) as double) as x0, cast(greatest(0, least(40, floor(y0 / 0.5 + 0.5))) as double) as y0,
       cast(greatest(0, least(200, floor(x1 / 0.37::double + 0.5))) as double) as x1, cast(greatest(0, least(40, floor(y1 / 0.5 + 0.5))) as double) as y1 from {_BX}""")
shared("box_correction", lambda s, d: bx.correct_text(
    boxes(s, d).withColumn("text", F.expr("regexp_replace(text, '[^ -~]', 'x')")),
    boxes(s, d).withColumn("text", F.expr("regexp_replace(text, '[^ -~]', 'x')")).selectExpr(
        "box_id", "case ord % 4 when 0 then concat(text, 'q') when 1 then upper(text) when 2 then concat(text, ord % 10) else reverse(text) end as corrected_text",
        "0.8D + cast(ord % 20 as double) / 100 as confidence"), lexicon()).select("box_id", "text", "confidence", "verdict"),
    rf"""with b as (select *, regexp_replace(text, '[^ -~]', 'x', 'g') as tt from {_BX}),
     c as (select *, trim(regexp_replace(case ord % 4 when 0 then concat(tt, 'q') when 1 then upper(tt) when 2 then concat(tt, ord % 10) else reverse(tt) end, '\s+', ' ', 'g')) as n,
       0.8::double + cast(ord % 20 as double) / 100 as cf from b),
     k as (select *, lower(trim(regexp_replace(tt, '\s+', ' ', 'g'))) as a, lower(n) as bb from c),
     v as (select *, 1 - levenshtein(a, bb) / cast(greatest(length(a), length(bb), 1) as double) as sim from k),
     z as (select *, case when n = '' or cf < 0.86 or length(n) > 240 then 'keep' when a = bb then 'confirm'
       when array_to_string(regexp_extract_all(tt, '[0-9]+'), '|') = array_to_string(regexp_extract_all(n, '[0-9]+'), '|') and sim >= 0.72
         and not (confidence >= 0.84 and cf < 0.93 and sim < 0.88) then 'replace' else 'keep' end as verdict from v)
     select box_id, case when verdict = 'replace' then n else tt end as text, case when verdict = 'keep' then confidence else greatest(confidence, least(0.98, cf)) end as confidence, verdict from z""")
shared("box_read_status", lambda s, d: bx.read_status(boxes(s, d)),
       f"select asset_id, avg(confidence) as avg_confidence, case when avg(confidence) < 0.6 then 'low_confidence' else 'done' end as ocr_status from {_BX} group by all")
_PLAIN = lambda s, d: boxes(s, d).withColumn("visual_role", F.lit("graphic_text")).withColumn("visual_should_check", F.lit(True))
_TINY = f"({_AL} <= 2 and not regexp_matches(text, '[0-9]'))"
shared("box_low_confidence", lambda s, d: bx.low_confidence_issues(_PLAIN(s, d)).select("box_id", "original", "reason", "confidence"),
       f"select box_id, text as original, concat('Text may be misread (', cast(floor(confidence * 100 + 0.5) as int), '%).') as reason, confidence from {_BX} where trim(text) <> '' and not ({_TINY} and confidence < 0.62) and confidence < 0.5")
shared("box_reviewable", lambda s, d: boxes(s, d).where(bx.REVIEWABLE).select("box_id"),
       f"select box_id from {_BX} where trim(text) <> '' and not {_TINY} and confidence >= 0.5")


@register("box_rules")
def _(spark, d):
    """B12 + E2: rule checker over well-read boxes."""
    found = checker.check(bx.rule_boxes(_PLAIN(spark, d)), lexicon())
    return found.groupBy("reason_code").agg(F.count(F.lit(1)).alias("issues"))


shared("box_batches", lambda s, d: bx.budget_batches(boxes(s, d)),
       f"""with recursive b as (select workspace_id, ord, box_id, length(text) + 80 as cost, row_number() over (partition by workspace_id order by ord) as k from {_BX}),
       r(workspace_id, ord, box_id, k, batch_id, n, chars) as (select workspace_id, ord, box_id, k, 0, 1, cost from b where k = 1 union all
         select b.workspace_id, b.ord, b.box_id, b.k, case when r.n >= 36 or r.chars + b.cost > 5200 then r.batch_id + 1 else r.batch_id end,
           case when r.n >= 36 or r.chars + b.cost > 5200 then 1 else r.n + 1 end, case when r.n >= 36 or r.chars + b.cost > 5200 then b.cost else r.chars + b.cost end
         from r join b on b.workspace_id = r.workspace_id and b.k = r.k + 1) select workspace_id, ord, box_id, batch_id from r""")
_SCORE = (r"(case when confidence < 0.8 then 5 when confidence < 0.9 then 3 else 0 end + case when regexp_matches(text, '[;:]') then 3 else 0 end "
          r"+ case when regexp_matches(text, ' {2,}|#\s+|\S +[.,!?;:]') then 5 else 0 end + case when regexp_matches(lower(text), 'đối tượng|hình thức|thời gian|địa điểm|deadline|hạn chót|đăng ký|tham gia|giải thưởng|thể lệ|lưu ý|link|form') then 4 else 0 end "
          r"+ case when length(text) <= 140 then 1 else 0 end)")
shared("box_top_k", lambda s, d: bx.review_top_k(boxes(s, d)).select("workspace_id", "box_id", "score", "rank"),
       f"""with s as (select *, {_SCORE} as score from {_BX}), r as (select *, row_number() over (partition by workspace_id order by score desc, confidence, ord) as rank,
       count(*) over (partition by workspace_id) as n, count(*) filter (score > 0) over (partition by workspace_id) as pos from s)
       select workspace_id, box_id, score, rank from r where n <= 24 or rank <= least(24, greatest(10, pos))""")
shared("text_bbox", lambda s, d: boxes(s, d).select("box_id", F.expr(cd.text_bbox("text", "bbox", "1", "least(length(text), 5)")).alias("b")).select("box_id", "b.x0", "b.x1"),
       rf"""with b as (select *, length(text) - length(ltrim(text)) as lead, length(text) - length(rtrim(text)) as trail from {_BX}),
       v as (select *, greatest(lead + 1, length(text) - trail) as stop, least(length(text), 5) as e from b), n as (select *, greatest(1, stop - lead) as n, greatest(lead, least(1, stop)) as cs, greatest(1.0::double, x1 - x0) as wd from v),
       m as (select *, greatest(cs + 1, least(e, stop)) as ce, greatest(4.0::double, floor(wd * 0.01 + 0.5)) as pad from n)
       select box_id, case when e <= 1 then x0 else greatest(x0, floor(x0 + (cs - lead) / n::double * wd - pad + 0.5)) end as x0,
         case when e <= 1 then x1 else least(x1, floor(x0 + (ce - lead) / n::double * wd + pad + 0.5)) end as x1 from m""")
shared("box_detected", lambda s, d: bx.add_detected(boxes(s, d).where("ord % 3 = 0"), bx.first_detected(boxes(s, d).where("ord % 3 <> 0"), 16)[0]).select("box_id", "text", "confidence"),
       rf"""with d as (select *, trim(regexp_replace(text, '\s+', ' ', 'g')) as t, row_number() over (partition by asset_id order by ord) as n from {_BX} where ord % 3 <> 0 and trim(text) <> '')
       select box_id, t as text, greatest(0.35, least(0.82, confidence)) as confidence from d where n <= 16 and not exists (select 1 from {_BX} b where b.ord % 3 = 0 and b.asset_id = d.asset_id
         and lower(trim(regexp_replace(b.text, '\s+', ' ', 'g'))) = lower(t))""")
_NEW = rf"""with d as (select *, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from {_BX} where ord % 3 <> 0 and trim(text) <> ''),
       k as (select distinct asset_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as t from {_BX} where ord % 3 = 0),
       n as (select *, row_number() over (partition by asset_id order by ord) as n from d where not exists (select 1 from k where k.asset_id = d.asset_id and k.t = lower(d.t)))"""
shared("box_detected_all", lambda s, d: bx.add_detected(boxes(s, d).where("ord % 3 = 0"), boxes(s, d).where("ord % 3 <> 0")).select("box_id", "text", "confidence"),
       f"{_NEW} select box_id, t as text, greatest(0.35, least(0.82, confidence)) as confidence from n")
shared("box_detected_rejects", lambda s, d: bx.split_detected(boxes(s, d).where("ord % 3 = 0"), boxes(s, d).where("ord % 3 <> 0"), 16)[1].select("box_id", "text", "reject_reason"),
       f"{_NEW} select box_id, t as text, 'over_limit' as reject_reason from n where n > 16")
_LA = f"from ({LAYERS}) l join (select asset_id, width as aw, height as ah from ({ASSETS})) a using (asset_id)"
shared("layout_upscaled", lambda s, d: bx.upscaled(layers(s, d), assets(s, d)).select("artboard_id", "asset_id", "scale"),
       f"select artboard_id, asset_id, greatest(width / aw, height / ah) as scale {_LA} where greatest(width / aw, height / ah) > 1.5")
shared("layout_ratio", lambda s, d: bx.ratio_mismatch(layers(s, d), assets(s, d)).select("artboard_id", "asset_id", "off"),
       f"select artboard_id, asset_id, abs(aw / ah::double - width / height) / (width / height) as off {_LA} where fit_mode = 'cover' and abs(aw / ah::double - width / height) / (width / height) > 0.25")
_DB = f"(select replace(asset_id, 'as', 'd') as asset_id, box_id, ord as box_ord, x0 as bx0, y0 as by0, x1 as bx1, y1 as by1 from {_BX} where confidence >= 0.5 and trim(text) <> '')"
shared("layout_cropped", lambda s, d: bx.cropped_text(layers(s, d), assets(s, d), boxes(s, d).withColumn("asset_id", F.expr("replace(asset_id, 'as', 'd')")), boards(s, d)),
       f"""with j as (select l.*, aw, ah, bw, bh, b.box_id, b.box_ord, bx0, by0, bx1, by1, case when fit_mode = 'cover' then greatest(width / aw, height / ah) else least(width / aw, height / ah) end as sc
         {_LA.replace(') a using (asset_id)', ') a using (asset_id) join (select artboard_id, width as bw, height as bh from (' + BOARDS + ')) using (artboard_id) join ' + _DB + ' b using (asset_id)')}),
       p as (select *, x + bx0 * sc - (aw * sc - width) / 2 as x0, y + by0 * sc - (ah * sc - height) / 2 as y0, x + bx1 * sc - (aw * sc - width) / 2 as x1, y + by1 * sc - (ah * sc - height) / 2 as y1 from j),
       c as (select *, x0 < x or y0 < y or x1 > x + width or y1 > y + height as cropped from p), k as (select * from c where cropped or x0 < 48 or y0 < 48 or bw - x1 < 48 or bh - y1 < 48)
       select artboard_id, layer_id, arg_min(box_id, box_ord) as box_id, case when arg_min(cropped, box_ord) then 'high' else 'medium' end as severity from k group by all""")
shared("layout_repeated", lambda s, d: bx.repeated_images(layers(s, d), boards(s, d)),
       f"""select artboard_id, asset_id, previous from (select artboard_id, asset_id, lag(artboard_id) over (partition by asset_id order by ord, layer_id) as previous
       from ({LAYERS}) join ({BOARDS}) using (artboard_id)) where previous is not null and previous <> artboard_id""")

# -- corrected text (C1-C6) -----------------------------------------------------------

_ACCEPT = f"""e as (select f.* from ({FIXES}) f where original <> suggestion and (f.status = 'accepted' or (f.status = 'open' and is_definite and confidence >= 0.85))),
  isl as (select *, sum(opens) over (partition by source_id order by span_start, span_end) as island from (select *, case when span_start < max(span_end) over
    (partition by source_id order by span_start, span_end rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from e)),
  k as (select *, row_number() over (partition by source_id, island order by span_start desc, issue_id) as k from isl),
  r(source_id, island, k, last, issue_id, span_start, span_end, suggestion, hit) as (select source_id, island, k, span_start, issue_id, span_start, span_end, suggestion, true from k where k = 1 union all
   select k.source_id, k.island, k.k, case when k.span_end > r.last then r.last else k.span_start end, k.issue_id, k.span_start, k.span_end, k.suggestion, k.span_end <= r.last
   from r join k on k.source_id = r.source_id and k.island = r.island and k.k = r.k + 1),
  acc as (select *, coalesce(lag(span_end) over (partition by source_id order by span_start), 0) as prev from r where hit)"""
_CORRECT = f"""with recursive {_ACCEPT}, pieces as (select source_id, string_agg(concat(substr(text, prev + 1, span_start - prev), suggestion), '' order by span_start) as head, max(span_end) as fin, count(*) as n
   from acc join documents d on cast(d.doc_id as varchar) = source_id group by all)
  select source as workspace_id, cast(doc_id as varchar) as source_id, md5(case when head is null then text else concat(head, substr(text, fin + 1)) end) as corrected,
    length(case when head is null then text else concat(head, substr(text, fin + 1)) end) as n, coalesce(n, 0) as applied from documents d left join pieces p on p.source_id = cast(d.doc_id as varchar)
  union all select 'mirror', cast(doc_id as varchar), md5(text), length(text), 0 from documents"""
shared("apply_patches", lambda s, d: pt.apply_patches(fixes(s, d), texts(s, d)).select(
    "workspace_id", "source_id", F.md5("corrected").alias("corrected"), F.length("corrected").alias("n"), F.size("applied").alias("applied")), _CORRECT)
shared("correction_preview", lambda s, d: pt.preview(fixes(s, d), texts(s, d)).select("workspace_id", "source_id", F.length("corrected").alias("n"), "pending", "accepted", "ignored", "needs_review"),
       f"""with c as ({_CORRECT}), k as (select workspace_id, source_id, count(*) filter (status = 'accepted') as accepted, count(*) filter (status = 'ignored') as ignored from ({FIXES}) group by all)
       select workspace_id, source_id, n, applied as pending, coalesce(accepted, 0) as accepted, coalesce(ignored, 0) as ignored, 0 as needs_review from c left join k using (workspace_id, source_id)""")


def _shift(spark, d):
    i = fixes(spark, d).withColumn("suggestion", F.concat("suggestion", F.lit("!!")))
    hit = pt.accepted_patches(i, texts(spark, d), "definite").select(F.explode(F.expr("transform(patches, p -> p.issue_id)")).alias("issue_id"), "workspace_id")
    return pt.shift_ranges(i, hit).select("issue_id", "status", "span_start", "span_end")


shared("shift_ranges", _shift, f"""with recursive {_ACCEPT}, h as (select source_id, issue_id, span_start, span_end, row_number() over (partition by source_id order by span_end) as n from acc),
  f as (select * from ({FIXES})),
  b as (select f.issue_id, h.n, h.span_end as before_end from f asof left join h on f.source_id = h.source_id and f.span_start >= h.span_end),
  o as (select f.issue_id, h.span_end > f.span_start as cut from f asof left join h on f.source_id = h.source_id and f.span_end > h.span_start)
  select f.issue_id, case when x.issue_id is not null then 'accepted' when o.cut then 'resolved' else status end as status,
   case when x.issue_id is null then cast(f.span_start + 2 * coalesce(b.n, 0) as int) end as span_start,
   case when x.issue_id is null then cast(f.span_end + 2 * coalesce(b.n, 0) as int) end as span_end
  from f left join (select issue_id from h) x using (issue_id) join b using (issue_id) join o using (issue_id)""")


_SEGMENTS = f"""with recursive o as (select * from ({FIXES}) where status = 'open'),
  isl as (select *, sum(opens) over (partition by source_id order by span_start, span_end) as island from (select *, case when span_start < max(span_end) over
    (partition by source_id order by span_start, span_end rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from o)),
  k as (select *, row_number() over (partition by source_id, island order by span_start, span_end, issue_id) as k from isl),
  r(source_id, island, k, last, issue_id, span_start, span_end, hit) as (select source_id, island, k, span_end, issue_id, span_start, span_end, true from k where k = 1 union all
   select k.source_id, k.island, k.k, case when k.span_start < r.last then r.last else k.span_end end, k.issue_id, k.span_start, k.span_end, k.span_start >= r.last
   from r join k on k.source_id = r.source_id and k.island = r.island and k.k = r.k + 1),
  m as (select *, coalesce(lag(span_end) over (partition by source_id order by span_start), 0) as prev from r where hit),
  s as (select source_id, span_start as a, span_end as b, issue_id from m union all select source_id, prev, span_start, null from m where prev < span_start
    union all select cast(doc_id as varchar), coalesce(fin, 0), length(text), null from documents left join (select source_id, max(span_end) as fin from m group by all) on source_id = cast(doc_id as varchar)
      where coalesce(fin, 0) < length(text))
  select d.source as workspace_id, source_id, issue_id, md5(substr(text, a + 1, b - a)) as segment, row_number() over (partition by source_id order by a) - 1 as pos
  from s join documents d on cast(d.doc_id as varchar) = source_id
  union all select 'mirror', cast(doc_id as varchar), null, md5(text), 0 from documents where text <> ''"""


@register("segments", _SEGMENTS)
def _(spark, d):
    """Every part with its place and issue; the parts of a text concatenate to it."""
    return pt.segments(fixes(spark, d), texts(spark, d)).select("workspace_id", "source_id", "issue_id", F.md5("segment").alias("segment"), "pos")


# -- reports (A1-A17, X1, X2, S19-S21) ------------------------------------------------

_ACT = "status not in ('ignored', 'resolved')"
shared("issue_summary", lambda s, d: rp.summary(issues(s, d), ["workspace_id"]).select(
    "workspace_id", "total_issues", "definite_errors", "suggestions", "needs_review", F.expr("by_severity['high']").alias("high"), F.expr("by_source['image']").alias("image")),
    f"""select workspace_id, count(*) as total_issues, count(*) filter (is_definite) as definite_errors, count(*) filter (not is_definite and severity <> 'needs_review') as suggestions,
    count(*) filter (severity = 'needs_review') as needs_review, nullif(count(*) filter (severity = 'high'), 0) as high, nullif(count(*) filter (source_type = 'image'), 0) as image from ({ISSUES}) where {_ACT} group by all""")
SOURCES = f"select distinct concat('w', user_id % 20) as workspace_id, 'caption' as source_type, {_SRC} as source_id, concat('text ', user_id) as text from events"
sources = lambda s, d: view(s, d, SOURCES, "events")
sess = lambda s, d: rp.sessions(sources(s, d), issues(s, d), assets(s, d))
_CATSQL = rp.CATEGORY.replace("bool_or", "bool_or")
_OPEN = "status in ('open', 'needs_human_review')"
_SESS = f"""p as (select workspace_id, source_type, source_id, count(*) as n, bool_or({_OPEN} and severity = 'needs_review') as review, bool_or({_OPEN}) as open from ({ISSUES}) group by all),
  c as (select workspace_id, source_type, source_id, text as user_input, case when workspace_id in (select workspace_id from ({ASSETS})) then 'Text + Image' else 'Text' end as format, false as forced from ({SOURCES})
    union all select workspace_id, 'image', asset_id, filename, 'Image', ocr_status in ('failed', 'low_confidence') from ({ASSETS})),
  sess as (select workspace_id, source_type, source_id, user_input, format, coalesce(n, 0) as issue_count, case when forced or coalesce(review, false) then 'Cần review' when coalesce(open, false) then 'Vi phạm' else 'Đạt chuẩn' end as final_status
    from c left join p using (workspace_id, source_type, source_id))"""
shared("report_sessions", lambda s, d: sess(s, d).select("workspace_id", "source_type", "source_id", "format", "user_input", "issue_count", "final_status"),
       f"with {_SESS} select * from sess")
_K = f"""k as (select workspace_id, count(*) as total, count(*) filter (format = 'Text') as text_only, count(*) filter (format = 'Text + Image') as text_image, count(*) filter (format = 'Image') as image_only,
  count(*) filter (issue_count = 0) as clean, cast(sum(issue_count) as bigint) as issues from sess group by all)"""
shared("report_kpis", lambda s, d: rp.kpis(sess(s, d), ["workspace_id"]).select("workspace_id", "total", "text_only_percent", "text_image_percent", "fpy_percent", "active_minutes"),
       f"""with {_SESS}, {_K} select workspace_id, total, cast(floor(100.0 * text_only / total + 0.5) as int) as text_only_percent, cast(floor(100.0 * text_image / total + 0.5) as int) as text_image_percent,
       floor(1000.0::double * clean / total + 0.5) / 10 as fpy_percent, greatest(1.0, least(480.0, total * 7 + issues * 0.75 + 12))::double as active_minutes from k""")
_TOP = f"""n as (select workspace_id, {rp.VIOLATION} as label, count(*) as violations from ({ISSUES}) group by all),
  t as (select *, cast(floor(100.0 * violations / sum(violations) over (partition by workspace_id) + 0.5) as int) as percent, row_number() over (partition by workspace_id order by violations desc, label) as rank from n),
  top as (select s.workspace_id, s.rank, coalesce(label, 'Không phát sinh thêm nhóm lỗi') as label, coalesce(violations, 0) as violations, coalesce(percent, 0) as percent
    from (select distinct workspace_id, unnest([1, 2, 3, 4, 5]) as rank from n) s left join t using (workspace_id, rank))"""
shared("top_violations", lambda s, d: rp.top_violations(issues(s, d), ["workspace_id"]), f"with {_TOP} select * from top")
shared("category_frequency", lambda s, d: rp.category_frequency(issues(s, d), ["workspace_id"]),
       f"select workspace_id, {_CATSQL} as category, count(*) as issues from ({ISSUES}) group by all")
_PEAK = """h as (select event_type, hour(ts) as hh, count(*) as n from events group by all), pk as (select event_type, arg_max(hh, n * 100 - hh) as hh, max(n) as sessions from h group by all)"""
shared("peak_hours", lambda s, d: rp.peak_hours(table(s, d, "events"), ["event_type"]),
       f"with {_PEAK} select event_type, concat(lpad(cast(hh as varchar), 2, '0'), ':00 - ', lpad(cast((hh + 2) % 24 as varchar), 2, '0'), ':00') as peak_hours, sessions from pk")


WORKSPACES = "select concat('w', user_id % 20) as workspace_id, concat('Workspace ', user_id % 20) as name, min(ts) as created_at from events group by user_id % 20"
RUNS = "select distinct concat('w', user_id % 20) as workspace_id from events where user_id % 20 % 3 = 0"
spaces = lambda s, d: view(s, d, WORKSPACES, "events")
daily = lambda s, d: rp.activity(spaces(s, d), sess(s, d), issues(s, d), view(s, d, RUNS, "events"), ["workspace_id"], "2030-01-01")
shared("report_activity", daily,
       f"""with {_SESS}, k as (select workspace_id, count(*) as total from sess group by all), n as (select workspace_id, count(*) as issues from ({ISSUES}) group by all),
       a as (select workspace_id, greatest(1, least(480, coalesce(total, 0) * 7 + coalesce(issues, 0) * 0.75 + case when workspace_id in ({RUNS}) then 12 else 0 end))::double as active_minutes,
         greatest(1, ceil((epoch_ms(timestamp '2030-01-01') - epoch_ms(created_at)) / 86400000.0))::bigint as active_days from ({WORKSPACES}) left join k using (workspace_id) left join n using (workspace_id))
       select *, active_minutes / active_days as daily_minutes from a""")
STEPS = f"""select user_id as run_id, event_type as step, case event_id % 5 when 0 then 'failed' when 1 then 'skipped' when 2 then 'running' else 'completed' end as status,
  case when event_id % 5 in (1, 2) then null else cast(floor(value * 100) as bigint) end as duration_ms, event_id % 4 as items from events"""
shared("run_trace", lambda s, d: rp.run_trace(view(s, d, STEPS, "events")),
       f"""select run_id, step, count(*) as steps, count(*) filter (status = 'running') as running, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed,
       count(*) filter (status = 'skipped') as skipped, cast(sum(items) as bigint) as items, count(duration_ms) as timed, cast(sum(duration_ms) as bigint) as duration_ms, max(duration_ms) as longest_ms from ({STEPS}) group by all""")


def _durations(spark, d):
    e = table(spark, d, "events")
    steps = e.select(F.col("user_id").alias("run_id"), F.expr("if(event_type = 'error', 0, cast(floor(value * 100) as bigint))").alias("duration_ms")).where("run_id % 10 <> 0")
    runs = e.groupBy(F.col("user_id").alias("run_id")).agg(F.min(F.col("ts").cast("timestamp")).alias("started_at"), F.max(F.col("ts").cast("timestamp")).alias("completed_at"))
    return rp.step_duration(steps, runs)


shared("step_duration", _durations, """with s as (select user_id as run_id, avg(cast(floor(value * 100) as bigint)) as ms from events where event_type <> 'error' and cast(floor(value * 100) as bigint) > 0 and user_id % 10 <> 0 group by all),
  r as (select user_id as run_id, epoch_ms(max(ts)) - epoch_ms(min(ts)) as wall from events group by all)
  select run_id, coalesce(ms, wall::double, 0) / 1000 as seconds from r left join s using (run_id)""")
shared("report_insights", lambda s, d: rp.insights(
    rp.kpis(sess(s, d), ["workspace_id"]), rp.top_violations(issues(s, d), ["workspace_id"]), rp.peak_hours(issues(s, d), ["workspace_id"]), ["workspace_id"]
    ).select("workspace_id", F.size("insights").alias("n"), F.expr("insights[0]").alias("first")),
    f"""with {_SESS}, {_K}, {_TOP} select workspace_id, 2 + case when floor(1000.0::double * clean / total + 0.5) / 10 < 70 then 1 else 0 end + case when floor(100.0 * text_image / total + 0.5) > 50 then 1 else 0 end as n,
    case when coalesce(violations, 0) > 0 then concat('Train on: ', label, ' (', percent, '%).') else 'Input quality is stable.' end as first from k left join (select * from top where rank = 1) using (workspace_id)""")
shared("issue_groups", lambda s, d: rp.issue_groups(dc.card_labels(issues(s, d), boards(s, d), layers(s, d))).select("workspace_id", "card_key", "issue_id", "position"),
       f"""with cards as ({ORACLE_SQL["card_labels"]}) select workspace_id, card_key, issue_id, row_number() over (partition by workspace_id, card_key
       order by list_position(['critical','high','medium','low','suggestion','needs_review'], severity), issue_id) as position from ({ISSUES}) join cards using (issue_id) where {_OPEN}""")
shared("coverage", lambda s, d: rp.coverage(
    issues(s, d).select(F.col("workspace_id").alias("target"), F.expr("workspace_id = 'w3'").alias("deep_running")).distinct(),
    issues(s, d).withColumn("target", F.col("workspace_id")),
    assets(s, d).select(F.col("workspace_id").alias("target"), "ocr_status", F.lit(1).alias("boxes")).where("target <> 'w7'")),
    f"""with i as (select workspace_id as target, count(*) filter (status = 'open') as open_count, count(*) filter ({_OPEN} and (severity = 'needs_review' or status = 'needs_human_review' or type = 'ocr_low_confidence')) as manual_count from ({ISSUES}) group by all),
    a as (select workspace_id as target, bool_or(ocr_status = 'failed') as failed, bool_or(ocr_status = 'low_confidence') as doubtful from ({ASSETS}) where workspace_id <> 'w7' group by all)
    select target, open_count, manual_count, case when target = 'w3' then 'still_checking' when failed then 'could_not_fully_read' when doubtful or manual_count > 0 then 'needs_review' else 'checked' end as coverage from i left join a using (target)""")
shared("workspace_index", lambda s, d: rp.workspace_index(table(s, d, "events").select(
    F.col("user_id").alias("workspace_id"), F.concat("event_type", F.lit("-"), "event_id").alias("name"), F.col("event_type").alias("kind"), F.col("ts").alias("updated_at"), F.col("ts").alias("created_at"))),
    "select user_id as workspace_id, arg_max(concat(event_type, '-', event_id), ts) as name, arg_max(event_type, ts) as kind, min(ts) as created_at, max(ts) as updated_at from events group by all")

_DATES = f"with posts as ({POSTS}), {spans_cte('m', _r.DATE, chr(92) + '1' + w(chr(92) + '2') + chr(92) + '3')}, k as (select m.*, source, {_r._FMT} as fmt from m join documents using (doc_id) where cast({_r._D(1)} as int) between 1 and 31 and cast({_r._D(2)} as int) between 1 and 12)"
_DAY = f"case when standard[1] = '2' then {_r.pad(_r._D(1))} else cast(cast({_r._D(1)} as int) as varchar) end"
_MONTH = f"case when standard[3] = '2' then {_r.pad(_r._D(2))} else cast(cast({_r._D(2)} as int) as varchar) end"
_YEAR = (f"case when {_r._D(3)} = '' then '' when standard[4] = '2' and length({_r._D(3)}) = 4 then concat(standard[2], right({_r._D(3)}, 2)) "
         f"when standard[4] = '4' and length({_r._D(3)}) = 2 then concat(standard[2], '20', {_r._D(3)}) else concat(standard[2], {_r._D(3)}) end")
_STD = "c as (select source, fmt, count(*) as n, min(doc_id * 10000000 + s) as first from k group by all), b as (select source, arg_max(fmt, n * 1000000000000000 - first) as standard from c group by all having count(*) > 1)"
_tokens = lambda s, d: rp.date_candidates(posts(s, d), ["source", "doc_id"])
shared("date_standard", lambda s, d: rp.date_standard(_tokens(s, d), ["source"], ["doc_id", "s"]), f"{_DATES}, {_STD} select source, standard from b")


@register("date_consistency", f"{_DATES}, {_STD} select source, doc_id, cast(s as int) as span_start, o as original, concat({_DAY}, standard[2], {_MONTH}, {_YEAR}) as suggestion from k join b using (source) where fmt <> standard and o <> concat({_DAY}, standard[2], {_MONTH}, {_YEAR})")
def _(spark, d):
    """X2."""
    t = _tokens(spark, d)
    out = rp.date_issues(t, rp.date_standard(t, ["source"], ["doc_id", "s"]), ["source"])
    return out.select("source", "doc_id", F.col("s").alias("span_start"), F.col("o").alias("original"), "suggestion")


shared("report_markdown", lambda s, d: rp.markdown_lines(issues(s, d), ["workspace_id"]).groupBy("workspace_id").agg(F.count(F.lit(1)).alias("lines"), F.max("line").alias("last")),
       f"""with i as ({ISSUES}), l as (select workspace_id, concat('## ', upper(severity), ' (', count(*), ')') as line from i where status <> 'resolved' group by workspace_id, severity union all
       select workspace_id, concat('- **[', source_type, ']** `', original, '` → `', suggestion, '` — ', reason, case when status <> 'open' then concat(' _(', status, ')_') else '' end) from i where status <> 'resolved'
       union all select workspace_id, concat('- `', original, '` — ', reason) from i where status = 'ignored') select workspace_id, count(*) as lines, max(line) as last from l group by all""")
_fixed = lambda s, d: sources(s, d).select("workspace_id", "source_id", F.col("text").alias("corrected"))
_out = lambda s, kind: f"{shared_folder(s)}/{kind}-{uuid.uuid4().hex}"
_ALL = f"""i as ({ISSUES}), w as ({WORKSPACES}), cap as ({SOURCES}), lv as (select * from i where status <> 'resolved'), ac as (select * from i where {_ACT}), ig as (select * from i where status = 'ignored')"""


def _report(spark, d):
    rp.write_report(rp.report_lines(spaces(spark, d), issues(spark, d), _fixed(spark, d), ["workspace_id"], "now"), ["workspace_id"], path := _out(spark, "report"))
    return spark.read.text(path).groupBy("workspace_id", F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def _records(spark, d):
    month = rp.kpis(sess(spark, d), ["workspace_id"]).drop("active_minutes").join(daily(spark, d), "workspace_id")
    rp.write_report_json(rp.report_records(spaces(spark, d), issues(spark, d), _fixed(spark, d), month, ["workspace_id"], "now"), ["workspace_id"], path := _out(spark, "json"))
    named = {"issue": "issue_id", "corrected": "corrected", "summary": "total_issues", "monthly_report": "total", "workspace": "name"}
    what = " ".join(f"when '{k}' then get_json_object(body, '$.{v}')" for k, v in named.items())
    return spark.read.json(path, schema="workspace_id string, section string, body string").select(
        "workspace_id", "section", F.expr(f"case section {what} end").alias("what"))


_LABEL = rp.SOURCE_LABEL
shared("report_full", _report,
       f"""with {_ALL}, k as (select workspace_id, name, (select count(*) from ac where ac.workspace_id = w.workspace_id) as t, (select count(*) from ac where ac.workspace_id = w.workspace_id and is_definite) as e,
       (select count(*) from ac where ac.workspace_id = w.workspace_id and not is_definite and severity <> 'needs_review') as g, (select count(*) from ac where ac.workspace_id = w.workspace_id and severity = 'needs_review') as r from w),
       l as (select workspace_id, unnest(['# QA Report — ' || name, '', 'Tạo lúc: now', '', '## Tổng quan', '', '- Tổng số issue: **' || t || '**', '- Lỗi chắc chắn: **' || e || '**', '- Gợi ý: ' || g, '- Cần người review: ' || r, '', '| Nguồn | Số issue |', '|---|---:|', '']) as line from k
       union all select workspace_id, '| ' || {_LABEL} || ' | ' || count(*) || ' |' from ac group by workspace_id, source_type
       union all select workspace_id, unnest(['## ' || upper(severity) || ' (' || n || ')', '', '']) from (select workspace_id, severity, count(*) as n from lv group by all)
       union all select workspace_id, '- **[' || {_LABEL} || ']** `' || original || '` → `' || suggestion || '` — ' || reason || case when status <> 'open' then ' _(' || status || ')_' else '' end from lv
       union all select workspace_id, unnest(['## Caption đã sửa', '']) from (select distinct workspace_id from cap) union all select workspace_id, unnest(['```', text, '```', '']) from cap
       union all select workspace_id, unnest(['## Đã bỏ qua (' || n || ')', '']) from (select workspace_id, count(*) as n from ig group by all) union all select workspace_id, '- `' || original || '` — ' || reason from ig)
       select workspace_id, line, count(*) as n from l group by all""")
shared("report_json", _records,
       f"""with {_ALL}, {_SESS} select workspace_id, 'workspace' as section, name as what from w union all select workspace_id, 'issue', issue_id from i union all select workspace_id, 'corrected', text from cap
       union all select workspace_id, 'summary', cast((select count(*) from ac where ac.workspace_id = w.workspace_id) as varchar) from w
       union all select workspace_id, 'monthly_report', cast(count(*) as varchar) from sess semi join w using (workspace_id) group by workspace_id""")
shared("report_log", lambda s, d: rp.detailed_log(sess(s, d)).select("source_type", "source_id", "groups", "final_status"),
       f"""with {_SESS}, g as (select workspace_id, source_type, source_id, {_CATSQL} as category, count(*) as n from ({ISSUES}) group by all),
       a as (select workspace_id, source_type, source_id, string_agg(concat(category, ': ', n), '; ' order by category) as groups from g group by all)
       select source_type, source_id, coalesce(groups, 'Không có') as groups, final_status from sess left join a using (workspace_id, source_type, source_id)""")
shared("report_dashboard", lambda s, d: rp.dashboard(rp.kpis(sess(s, d), ["workspace_id"]), ["workspace_id"]).where("metric in ('total', 'fpy_percent')"),
       f"""with {_SESS}, {_K} select workspace_id, 'total' as metric, total::double as value from k union all select workspace_id, 'fpy_percent', floor(1000.0::double * clean / total + 0.5) / 10 from k""")

# -- streams (T1-T7) ------------------------------------------------------------------

JOBS = """select concat('j', user_id) as job_id, case event_id % 7 when 0 then 'ocr' when 1 then 'caption_ai' when 2 then 'image_ai' when 3 then 'self_check' when 4 then 'merge'
  when 5 then case when user_id % 3 = 0 then 'completed' else 'merge' end else 'ocr' end as phase,
  case when event_id % 2 = 0 then 'running' else 'completed' end as status, ts from events"""
_JOB = f"""p as (select job_id, phase, arg_max(status, ts) as status, max(ts) as ts from ({JOBS}) group by all),
  j as (select job_id, arg_max(phase, ts) as phase, arg_max(status, ts) as status, max(ts) as updated_at from p group by all)"""
jobs = lambda s, d: view(s, d, JOBS, "events")
shared("job_state", lambda s, d: inc.job_state(jobs(s, d)).select("job_id", "phase", "status", "progress"),
       f"""with {_JOB} select job_id, phase, case when phase = 'completed' then 'completed' else 'running' end as status,
       case when phase = 'completed' then 96 else least(96, case phase when 'ocr' then 42 when 'caption_ai' then 58 when 'image_ai' then 72 when 'self_check' then 86 else 94 end + case when status = 'completed' then 6 else 0 end) end as progress from j""")
shared("stalled_jobs", lambda s, d: inc.stalled_jobs(jobs(s, d).withColumn("ts", F.col("ts").cast("timestamp")), "2030-01-01 00:00:00").select("job_id"),
       f"select job_id from ({JOBS}) group by all having not bool_or(phase = 'completed')")


def _stream(spark, d, name: str):
    """The given table, a file or a folder of files, as a file stream."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")  # a pattern: a stream takes no single file by its bare name


def _run(stream, mode: str):
    """Run a stream over what is there now and read its sink."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q_ = (stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
              .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    else:
        def write(batch, epoch):
            batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")
        q_ = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state")
              .trigger(availableNow=True).start())
    q_.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out" if mode == "append" else f"{folder}/out/*")


@register("stream_fast_issues", RULE_SQL["rule_57"].replace(POSTS, _DOCS).replace("select doc_id, cast(s as int)", "select cast(doc_id as varchar) as source_id, cast(s as int)"))
def _(spark, d):
    """Rule issues of arriving documents equal the batch run."""
    s = _stream(spark, d, "documents").select(F.col("source").alias("workspace_id"), F.lit("caption").alias("source_type"),
                                              F.col("doc_id").cast("string").alias("source_id"), "text")
    from redpencil.lexicon import Lexicon
    return _run(inc.fast_issues(s, Lexicon(), {57}), "append").select("source_id", "span_start", "span_end", "original", "suggestion")


@register("stream_stale", "select doc_id as source_id, n_chars % 4 = 0 as stale from documents")
def _(spark, d):
    """T4."""
    cur = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.md5("text").alias("fingerprint"))
    s = _stream(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.expr("if(n_chars % 4 = 0, 'x', md5(text))").alias("fingerprint"))
    return _run(inc.reject_stale(s, cur), "append").select("source_id", "stale")


@register("stream_decisions", f"""select i.issue_id, coalesce(p.status, i.status) as status from ({ISSUES}) i left join (select {_KEY}, arg_max(status, ts) as status
  from ({DECISIONS}) group by all) p using ({_KEY})""")
def _(spark, d):
    """T6."""
    _stream(spark, d, "events").createOrReplaceTempView("events_stream")
    s = spark.sql(ISSUES.replace("from events", "from events_stream"))
    return _run(inc.with_decisions(s, dc.latest_decisions(_decisions(spark, d))), "append").select("issue_id", "status")


@register("stream_metrics", """select * from (select date_trunc('day', ts) as window_start, event_type, count(*) as events, sum(value) as value
  from events group by 1, 2) where window_start + interval 1 day <= (select max(ts) - interval 1 day from events)""")
def _(spark, d):
    """Windows closed by the watermark."""
    s = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _run(inc.periodic_metrics(s), "append").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
