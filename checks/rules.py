"""One query per rule (R1-R79): raw hits over whole, derived posts."""

from __future__ import annotations

from checks.base import IDS, POST, POSTS, PRE, f, lexicon, packed, posts, q, spans_cte, spans_sql, view, w
from redpencil.functions import text as tx
from redpencil.operators import dictionary as dic
from redpencil.operators.checker import rule_hits
from redpencil.operators.structure_rules import VARIANTS


def _query(rule: int):
    def run(spark, sf_dir):
        hits = rule_hits(posts(spark, sf_dir), lexicon(), {rule}, IDS, guard=False, resolve=False)
        return hits.select("doc_id", "span_start", "span_end", "original", "suggestion")
    return run


QUERIES = {f"rule_{n:02d}": _query(n) for n in range(1, 80)}

# posts with empty lines between, before and after, up to six of them
SPACED = f"select doc_id, concat(repeat(chr(10), cast(n_chars % 4 as int)), text, repeat(chr(10), cast(n_chars % 7 as int)), 'x', repeat(chr(10), 3), text) as text from ({POSTS})"


def _empty_lines(spark, sf_dir):
    """R3."""
    hits = rule_hits(view(spark, sf_dir, SPACED, "documents"), lexicon(), {3}, IDS, guard=False, resolve=False)
    return hits.select("doc_id", "span_start", "span_end", "original", "suggestion")


QUERIES["rule_03"] = _empty_lines

pad = lambda x: f"lpad(cast(cast({x} as int) as varchar), 2, '0')"
H_OK = lambda h, m: f"(cast({h} as int) <= 23 and cast({m} as int) <= 59)"
EMOJI = tx.PICTOGRAPHIC.replace(r"\x{A9}", r"\x{00A9}").replace(r"\x{AE}", r"\x{00AE}")
lower_alt = lambda xs: "(?:" + "|".join(sorted((x for x in xs), key=lambda x: -len(x))) + ")"
PREFIXES, HINTS = lower_alt(tx.LABEL_PREFIXES), lower_alt(tx.LABEL_HINTS)
VALUE = (rf"(?:[0-9]|https?://|www\.|@|#|(?i:{lower_alt(tx.VALUE_WORDS)})(?:[^A-Za-z0-9_]|$)|\p{{Lu}}|{EMOJI})")


def label(x: str) -> str:
    c = (f"lower(trim(regexp_replace(regexp_replace({x}, '^[^\\p{{L}}\\p{{N}}]+', ''), '\\s+', ' ', 'g')))")
    return (f"(len(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}]+')) between 1 and 7 and length({c}) <= 64 "
            f"and not regexp_matches({c}, '[.!?]') and regexp_matches({c}, {q(HINTS)}))")


def value(x: str) -> str:
    return f"regexp_matches(trim({x}), {q('^' + VALUE)})"


def _row(cols: str, source: str, where: str = "true") -> str:
    s, e, o, g = cols.split(" | ")
    return (f"select doc_id, cast({s} as int) as span_start, cast({e} as int) as span_end, {o} as original, "
            f"{g} as suggestion from {source} where {where}")


_POSTS = f"with posts as ({POSTS})"
_LINE_CTES = """l0 as (select doc_id, unnest(string_split(text, chr(10))) as line,
   generate_subscripts(string_split(text, chr(10)), 1) as pos from posts),
 l as (select *, sum(length(line) + 1) over (partition by doc_id order by pos) - length(line) - 1 as off from l0)"""
_LINES = f"{_POSTS}, {_LINE_CTES}"

# Words of each line with offsets.
_TOKENS = f"""{_LINES}, t0 as (select doc_id, pos, off, line, regexp_extract_all(line, '[\\p{{L}}\\p{{N}}]+') as ws,
   regexp_split_to_array(line, '[\\p{{L}}\\p{{N}}]+') as gaps from l),
 t1 as (select doc_id, pos, off, line, unnest(ws) as word, generate_subscripts(ws, 1) as k, gaps from t0 where len(ws) > 0),
 t as (select doc_id, pos, off, line, k, lower(word) as word, length(word) as n, gaps[k + 1] as gap_after,
   sum(length(word) + length(gaps[k])) over (partition by doc_id, pos order by k) - length(word) as s from t1)"""


def _repeated_phrase_sql() -> str:
    parts = []
    for n in (5, 4, 3, 2):
        cols = ", ".join(f"lead(word, {i}) over o as w{i}" for i in range(1, 2 * n))
        same = " and ".join(f"{'word' if i == 0 else f'w{i}'} = w{i + n}" for i in range(n))
        parts.append(
            f"select doc_id, off, line, s, mid_end, fin from (select doc_id, off, line, s, word, {cols}, "
            f"lead(gap_after, {n - 1}) over o as gap, lead(s + n, {n - 1}) over o as mid_end, "
            f"lead(s + n, {2 * n - 1}) over o as fin from t window o as (partition by doc_id, pos order by k)) "
            f"where fin is not null and {same} and regexp_full_match(gap, '[ \\t]+')")
    return (f"{_TOKENS}, h as ({' union all '.join(parts)}) "
            + _row("off + s | off + fin | substr(line, cast(s as bigint) + 1, cast(fin - s as bigint)) | substr(line, cast(s as bigint) + 1, cast(mid_end - s as bigint))", "h"))


def _lists(pattern_num: bool) -> str:
    if pattern_num:
        return f"""{_LINES}, n as (select doc_id, off + length(regexp_extract(line, '^(\\s*)', 1)) as s,
           regexp_extract(line, '^\\s*([0-9]{{1,3}}[.)])\\s', 1) as o from l),
         m as (select *, right(o, 1) as d, substr(o, 1, length(o) - 1) as num from n where o <> ''),
         c as (select doc_id, d, count(*) as n, min(s) as first from m group by all),
         b as (select doc_id, arg_max(d, n * 1000000000 - first) as best, count(*) > 1 as mixed from c group by all),
         z as (select doc_id, count(*) as total, count(distinct regexp_matches(o, '^0[0-9]')) > 1 as pad from m group by all)
         select doc_id, cast(s as int) as span_start, cast(s + length(o) as int) as span_end, o as original,
           concat(case when pad then cast(cast(num as int) as varchar) else num end, best) as suggestion
         from m join b using (doc_id) join z using (doc_id)
         where total >= 2 and (mixed or pad) and o <> concat(case when pad then cast(cast(num as int) as varchar) else num end, best)"""
    return f"""{_LINES}, n as (select doc_id, off + length(regexp_extract(line, '^(\\s*)', 1)) as s,
           regexp_extract(line, '^\\s*([-*•+])\\s', 1) as o from l),
         m as (select * from n where o <> ''),
         c as (select doc_id, o, count(*) as n, min(s) as first from m group by all),
         b as (select doc_id, arg_max(o, n * 1000000000 - first) as best from c group by all)
         {_row('s | s + 1 | o | best', 'm join b using (doc_id)', 'o <> best')}"""


def _excluded() -> str:
    """Link and protected-term ranges, unmerged (overlap tests do not care)."""
    terms = "|".join(sorted((tx.escape(t.lower()) for t in lexicon().protected()), key=lambda t: -len(t)))
    return (f"{spans_cte('u', r'https?://[^\s<>\x22\x27`]+|www\.[^\s<>\x22\x27`]+|(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:com|net|org|io|vn|app|dev|ai|co|me|edu|gov|info|biz|xyz|site|online|cloud|gg|ly)(?:/[^\s<>\x22\x27`]*)?', w(), flags='gi')}, "
            f"{spans_cte('p', PRE + '(' + terms + ')' + POST, chr(92) + '1' + w(chr(92) + '2') + chr(92) + '3', flags='gi')}, "
            f"x as (select doc_id, s, s + length(regexp_replace(o, '[),.!?;:]+$', '')) as e from u union all select doc_id, s, e from p)")


def _heading(words: bool) -> str:
    head = (f"with posts as ({POSTS}), {_excluded()}, " + _LINE_CTES + """,
      fst as (select doc_id, trim(arg_min(line, pos)) as f from l where trim(line) <> '' group by all),
      c0 as (select l.doc_id, pos, off + length(line) - length(ltrim(line)) as hs, trim(line) as t, f from l join fst using (doc_id)),
      c as (select *, len(regexp_extract_all(t, '\\p{L}')) as nl, len(regexp_extract_all(t, '\\p{Ll}')) as nlow from c0
        where length(t) between 1 and 180 and not regexp_matches(t, '[:;]')
          and len(regexp_extract_all(t, '[\\p{L}\\p{N}]+')) between 1 and 32),
      likely as (select * from c where t = f or (nl >= 4 and nl - nlow >= 0.65 * nl)),
      ch as (select doc_id, pos, hs, t, unnest(string_split(t, '')) as c1, generate_subscripts(string_split(t, ''), 1) as ci from likely),
      vis as (select ch.* from ch where not exists (select 1 from x where x.doc_id = ch.doc_id and x.s < hs + ci and hs + ci - 1 < x.e)),
      st as (select doc_id, pos, any_value(hs) as hs, any_value(t) as t, count(*) filter (regexp_matches(c1, '\\p{Lu}')) as up,
        count(*) filter (regexp_matches(c1, '\\p{Ll}')) as lo from vis group by doc_id, pos),
      heads as (select * from st where up >= 4 and up >= 0.65 * (up + lo))""")
    if words:
        tok = spans_cte("k", r"[\p{L}\p{N}][\p{L}\p{N}_-]*", w(), src="heads", key="doc_id, hs", text="t")
        return (f"{head}, {tok} select doc_id, cast(hs + s as int) as span_start, cast(hs + e as int) as span_end, "
                f"o as original, upper(o) as suggestion from k where regexp_matches(o, '\\p{{Ll}}') and not exists "
                f"(select 1 from x where x.doc_id = k.doc_id and x.s < hs + k.e and hs + k.s < x.e)")
    low = r"[\p{L}\p{N}_-]*\p{Ll}[\p{L}\p{N}_-]*"
    run = spans_cte("k", rf"(^|[^\p{{L}}\p{{N}}_-])({low}(?:\s+[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_-]*)*\s+{low})", r"\1" + w(r"\2"),
                    src="heads", key="doc_id, hs", text="t")
    return (f"{head}, {run} select doc_id, cast(hs + s as int) as span_start, cast(hs + e as int) as span_end, "
            f"o as original, upper(o) as suggestion from k")


def _dictionary(rule: int) -> str:
    """Token n-grams against the phrase list (phrases are words and single blanks)."""
    rows = [(c, k, wd.lower(), r, p) for c, k, wd, r, p in dic.entries(lexicon(), {rule})]
    values = ", ".join(f"({q(wd)}, {q(r) if r is not None else 'NULL'}, {'true' if p else 'false'}, {len(wd.split())})"
                       for _, _, wd, r, p in rows)
    sizes = sorted({len(r[2].split()) for r in rows})

    def gram(n: int) -> str:
        lead = lambda c, i: c if i == 0 else f"lead({c}, {i}) over v"
        words = ", ' ', ".join(lead("o", i) for i in range(n))
        single = " and ".join(f"{lead('gap', i)} = ' '" for i in range(n - 1)) or "true"
        return (f"select doc_id, s, {lead('e', n - 1)} as e, concat({words}) as o, lag(gap) over v as before, {single} as ok, {n} as n "
                f"from wd window v as (partition by doc_id order by s)")

    grams = " union all ".join(gram(n) for n in sizes)
    initial = "and (s = 0 or regexp_matches(before, '[.!?]\\s+$'))" if rule == 74 else ""
    cap = ("concat(substr(r, 1, length(regexp_extract(r, '^[^\\p{L}]*'))), "
           "upper(substr(r, length(regexp_extract(r, '^[^\\p{L}]*')) + 1, 1)), substr(r, length(regexp_extract(r, '^[^\\p{L}]*')) + 2))")
    shaped = (f"case when r is null then o when not p then r when o = upper(o) then upper(r) "
              f"when regexp_extract(o, '\\p{{L}}') = upper(regexp_extract(o, '\\p{{L}}')) then {cap} else r end")
    return (f"with posts as ({POSTS}), {spans_cte('wd', r'[\p{L}\p{N}_]+', w())}, g as ({grams}), "
            f"lx(wrong, r, p, n) as (values {values}), "
            f"m as (select doc_id, s, e, r, p, o, before from g join lx on lx.n = g.n and lx.wrong = lower(o) where ok) "
            f"select doc_id, cast(s as int) as span_start, cast(e as int) as span_end, o as original, {shaped} as suggestion "
            f"from m where true {initial}")


def _variants() -> str:
    """Occurrences of every group found separately; two forms must meet."""
    ctes, unions = [], []
    for i, (canon, others, pat) in enumerate(VARIANTS):
        for j, form in enumerate([*others, pat]):
            ctes.append(spans_cte(f"v{i}_{j}", PRE + f"({form})" + POST, r"\1" + w(r"\2") + r"\3", flags="gi"))
            unions.append(f"select doc_id, s, e, o, {i} as grp, {j} as form, {str(j == len(others)).lower()} as own, {q(canon)} as canon from v{i}_{j}")
    fixed = "regexp_matches(canon, '[A-Z][a-zà-ỹ]+[A-Z]|[A-Z]{2,}|[.]')"
    sugg = (f"case when {fixed} then canon when regexp_extract(o, '\\p{{L}}') = upper(regexp_extract(o, '\\p{{L}}')) "
            f"then concat(upper(substr(canon, 1, 1)), substr(canon, 2)) else canon end")
    return (f"with posts as ({POSTS}), {', '.join(ctes)}, a as ({' union all '.join(unions)}), "
            f"b as (select a.*, {sugg} as g from a semi join (select doc_id, grp from a group by all having count(distinct form) > 1) z "
            f"on a.doc_id = z.doc_id and a.grp = z.grp) "
            + _row("s | e | o | g", "b", "not own and lower(o) <> lower(g)"))


_STRIP = "regexp_replace(text, '\\s+$', '')"


def _at_end(ins: str, cond: str) -> str:
    b = _STRIP
    return (f"select doc_id, cast(length({b}) - 1 as int) as span_start, cast(length({b}) as int) as span_end, right({b}, 1) as original, "
            f"case when regexp_matches(right({b}, 1), '[.!?,;:]') then concat({ins}, right({b}, 1)) else concat(right({b}, 1), {ins}) end as suggestion "
            f"from posts where length({b}) > 0 and {cond}")


DATE = (r"(^|[^0-9])((?:[0-9]{1,2}/[0-9]{1,2}(?:/(?:[0-9]{4}|[0-9]{2}))?|[0-9]{1,2}\.[0-9]{1,2}(?:\.(?:[0-9]{4}|[0-9]{2}))?"
        r"|[0-9]{1,2}-[0-9]{1,2}(?:-(?:[0-9]{4}|[0-9]{2}))?))($|[^0-9])")
_D = lambda n: f"split_part(regexp_replace(o, '[.-]', '/', 'g'), '/', {n})"
_YEAR = f"(case when {_D(3)} = '' then 2024 when length({_D(3)}) = 2 then 2000 + cast({_D(3)} as int) else cast({_D(3)} as int) end)"
_BAD_DATE = (f"not (cast({_D(2)} as int) between 1 and 12 and cast({_D(1)} as int) >= 1 and cast({_D(1)} as int) <= "
             f"day(last_day(make_date({_YEAR}, greatest(1, least(12, cast({_D(2)} as int))), 1))))")
_FMT = f"concat(length({_D(1)}), regexp_extract(o, '[./-]'), length({_D(2)}), length({_D(3)}))"


def _date_formats() -> str:
    day = f"case when best[1] = '2' then {pad(_D(1))} else cast(cast({_D(1)} as int) as varchar) end"
    month = f"case when best[3] = '2' then {pad(_D(2))} else cast(cast({_D(2)} as int) as varchar) end"
    year = (f"case when {_D(3)} = '' then '' when best[4] = '2' and length({_D(3)}) = 4 then concat(best[2], right({_D(3)}, 2)) "
            f"when best[4] = '4' and length({_D(3)}) = 2 then concat(best[2], '20', {_D(3)}) else concat(best[2], {_D(3)}) end")
    return (f"with posts as ({POSTS}), {spans_cte('m', DATE, r'\1' + w(r'\2') + r'\3')}, "
            f"k as (select *, {_FMT} as fmt from m where cast({_D(1)} as int) between 1 and 31 and cast({_D(2)} as int) between 1 and 12), "
            f"c as (select doc_id, fmt, count(*) as n, min(s) as first from k group by all), "
            f"b as (select doc_id, arg_max(fmt, n * 1000000000 - first) as best from c group by all) "
            + _row(f"s | e | o | concat({day}, best[2], {month}, {year})", "k join b using (doc_id)", "fmt <> best"))


ORACLES = {
    1: _POSTS + _row("0 | length(regexp_extract(text, '^[ \\t]+')) | regexp_extract(text, '^[ \\t]+') | ''", "posts", "regexp_matches(text, '^[ \\t]')"),
    2: _POSTS + _row("length(text) - length(regexp_extract(text, '[ \\t]+$')) | length(text) | regexp_extract(text, '[ \\t]+$') | ''", "posts", "regexp_matches(text, '[ \\t]$')"),
    3: spans_sql(r"\n{3,}", w(r"\0", "\n\n"), src_sql=SPACED),
    4: _LINES + _row("off | off + length(regexp_extract(line, '^[ \\t]+')) | regexp_extract(line, '^[ \\t]+') | ''", "l", "regexp_matches(line, '^[ \\t]')"),
    5: _LINES + _row("off + length(line) - length(regexp_extract(line, '[ \\t]+$')) | off + length(line) | regexp_extract(line, '[ \\t]+$') | ''", "l", "regexp_matches(line, '[ \\t]$')"),
    6: _LINES + _row("off + length(line) - length(ltrim(line)) | off + length(line) - length(ltrim(line)) + length(trim(line)) | trim(line) | ''", "l", "regexp_full_match(trim(line), '-{3,}|[*]{3,}|~{3,}|_{3,}')"),
    7: _LINES + """, n as (select *, lower(regexp_replace(trim(line), '\\s+', ' ', 'g')) as nl from l),
        r as (select *, row_number() over (partition by doc_id, nl order by pos) as k from n where length(nl) >= 8) """
       + _row("off + length(line) - length(ltrim(line)) | off + length(line) - length(ltrim(line)) + length(trim(line)) | trim(line) | ''", "r", "k > 1"),
    8: _repeated_phrase_sql(),
    9: spans_sql(rf"(^|\n)({EMOJI})([\p{{L}}\p{{N}}#@])", r"\1" + w(r"\2", r"\2 ") + r"\3"),
    10: spans_sql(r"(^|\n)([-*•+])([\p{L}\p{N}#@])", r"\1" + w(r"\2", r"\2 ") + r"\3"),
    11: spans_sql(r"(^|\n)([0-9]{1,2}[.)])([\p{L}#@])", r"\1" + w(r"\2", r"\2 ") + r"\3"),
    12: _lists(True), 13: _lists(False), 14: _heading(True), 15: _heading(False), 16: _variants(),
    17: spans_sql(r"(^|\n)([^\S\n]*)(([^:\n]{1,80}?)[^\S\n]+:([^\S\n]*)([^\n]+))", r"\1\2" + w(r"\3", packed(r"\4", r"\6")),
                  f"concat({f(1)}, ': ', ltrim({f(2)}))", label(f(1))),
    18: spans_sql(r"(^|\n)([^\S\n]*)(([^,|:\n]{1,80}?)[^\S\n]*[,|]([^\S\n]*)([^\n]+))", r"\1\2" + w(r"\3", packed(r"\4", r"\6")),
                  f"concat({f(1)}, ': ', ltrim({f(2)}))", f"{label(f(1))} and {value(f(2))}"),
    19: spans_sql(rf"(^|\n)([^\S\n]*(?i:{PREFIXES}))([^\S\n]+)({VALUE})", r"\1\2" + w(r"\3", ": ") + r"\4"),
    20: spans_sql(r"\[([^\]\n]{1,120})\]\(((?:https?://|www\.)[^\s)]+)\)", w(r"\0", r"\1: \2")),
    21: spans_sql(r"\*\*([^\n]{1,120}?)\*\*|__([^\n]{1,120}?)__", w(r"\0", r"\1\2")),
    22: spans_sql(r"`([^`\n]{1,120})`", w(r"\0", r"\1")),
    23: spans_sql(r"&(?:amp|nbsp|lt|gt);", w(), "case o when '&amp;' then '&' when '&nbsp;' then ' ' when '&lt;' then '<' else '>' end"),
    24: f"with posts as ({POSTS}), {spans_cte('m', r'#[\p{L}\p{N}_]+', w())}, r as (select *, row_number() over (partition by doc_id, lower(o) order by s) as k from m) " + _row("s | e | o | ''", "r", "k > 1"),
    25: spans_sql(r"#[\p{L}\p{N}_]*[-&][\p{L}\p{N}_&-]+", w(), "translate(o, '-&', '')"),
    26: spans_sql(r"#acme_?corp(?:oration)?" + POST, "", flags="gi").replace(q(""), q(""), 1),
    27: spans_sql(r"([\p{L}\p{N}])(#[\p{L}\p{N}_]+)", w(r"\0", r"\1 \2")),
    28: spans_sql(r"@\s+([A-Za-z0-9_.]+)", w(r"\0", r"@\1")),
    29: spans_sql(PRE + "(@nova node)" + POST, r"\1" + w(r"\2", "@NovaNode") + r"\3", flags="gi"),
    30: spans_sql(r"\b([A-Z0-9._%+-]+)\s+@([A-Z0-9.-]+\.[A-Z]{2,})\b", w(r"\0", r"\1@\2"), flags="gi"),
    31: spans_sql(r"\b([A-Z0-9._%+-]+@)\s+([A-Z0-9.-]+\.[A-Z]{2,})\b", w(r"\0", r"\1\2"), flags="gi"),
    32: spans_sql(r"\b(https?://)\s+([^\s]+)", w(r"\0", r"\1\2"), flags="gi"),
    33: spans_sql(r"\b((?:https?://|www\.)[^\s]+[.,;:!?])(\s|$)", w(r"\1", r"\1") + r"\2", "substr(o, 1, length(o) - 1)", flags="gi"),
    34: spans_sql(r"(^|[^#\p{L}\p{N}_])(acme\s*corp(?:oration)?)" + POST, r"\1" + w(r"\2", "Acme Group") + r"\3", flags="gi"),
    35: spans_sql(r"(^|[^#@\p{L}\p{N}_])(?:(vn|vi[eệ]t[\s_-]*n?am)|(tphcm|hcmc|tp\.?\s*hcm))" + POST,
                  r"\1" + w(r"\2\3", packed(r"\2", r"\3")) + r"\4", f"case when {f(1)} <> '' then 'Việt Nam' else 'TP.HCM' end",
                  f"lower(o) <> lower(case when {f(1)} <> '' then 'Việt Nam' else 'TP.HCM' end)", flags="gi"),
    36: spans_sql(r"([0-9]+(?:[.,][0-9]+)?)\s+%", w(r"\0", r"\1%")),
    37: spans_sql(r"(^|[^\p{L}\p{N}])([0-9][0-9.,]*)(\s+)(k|đ|vnđ)($|[^\p{L}\p{N}])", r"\1" + w(r"\2\3\4", r"\2\4") + r"\5", flags="gi"),
    38: spans_sql(r"(^|[^\p{L}\p{N}])([0-9]+(?:[.,][0-9]+)?)(\s*)(kb|mb|gb|tb)($|[^\p{L}\p{N}])", r"\1" + w(r"\2\3\4", packed(r"\2", r"\4")) + r"\5",
                  f"concat({f(1)}, ' ', upper({f(2)}))", f"o <> concat({f(1)}, ' ', upper({f(2)}))", flags="gi"),
    39: spans_sql(r"\b[0-9]{1,3}(?:,[0-9]{3})+\b", w(), "replace(o, ',', '.')"),
    40: spans_sql(r"(^|[^0-9])([0-9]{1,2}:[0-9]{2})(\s*[-–—]\s*)([0-9]{1,2}:[0-9]{2})($|[^0-9])", r"\1" + w(r"\2\3\4", r"\2 - \4") + r"\5", where="o <> g"),
    41: spans_sql(DATE, r"\1" + w(r"\2") + r"\3", "o", _BAD_DATE),
    42: spans_sql(r"(^|[^0-9])([0-9]{1,2}:[0-9]{2})($|[^0-9])", r"\1" + w(r"\2") + r"\3", "o",
                  f"not {H_OK('split_part(o, chr(58), 1)', 'split_part(o, chr(58), 2)')}"),
    43: spans_sql(r"(thứ\s*(?:hai|ba|tư|năm|sáu|bảy|[2-7])|chủ\s*nhật),?\s+([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", w(r"\0", packed(r"\1", r"\2", r"\3", r"\4")),
                  "o", f"cast({f(3)} as int) between 1 and 12 and dayofweek(try_cast(concat({f(4)}, '-', {pad(f(3))}, '-', {pad(f(2))}) as date)) <> "
                       f"coalesce(try_cast(right({f(1)}, 1) as int) - 1, case lower(regexp_replace({f(1)}, '\\s+', ' ', 'g')) when 'chủ nhật' then 0 when 'thứ hai' then 1 "
                       f"when 'thứ ba' then 2 when 'thứ tư' then 3 when 'thứ năm' then 4 when 'thứ sáu' then 5 when 'thứ bảy' then 6 end)", flags="gi"),
    44: spans_sql(PRE + "(hôm nay|ngày mai|ngày mốt|tối nay|sáng mai|chiều mai|tuần này|tuần sau)" + POST, r"\1" + w(r"\2") + r"\3", "o", flags="gi"),
    45: spans_sql(r"(^|[^0-9])(0(?:[\s.-]?[0-9]){7,11})($|[^0-9])", r"\1" + w(r"\2") + r"\3", "o", "len(regexp_extract_all(o, '[0-9]')) <> 10"),
    46: spans_sql(r"\p{L}\p{M}+", w(), "nfc_normalize(o)", "o <> nfc_normalize(o)"),
    47: spans_sql(PRE + "(genz)" + POST, r"\1" + w(r"\2", "Gen Z") + r"\3", flags="gi"),
    48: spans_sql(PRE + "(Top([0-9]{1,3}))" + POST, r"\1" + w(r"\2", r"Top \3") + r"\4"),
    49: spans_sql(rf"(^|\n)([^\S\n]*)([O0Il1][^\S\n])([^\S\n]*)((?i:{PREFIXES}))", r"\1\2" + w(r"\3") + r"\4\5", "''"),
    50: f"with posts as ({POSTS}), {spans_cte('m', PRE + '(BU|PM|POC)' + POST, chr(92) + '1' + w(chr(92) + '2') + chr(92) + '3')}, "
        "r as (select m.*, row_number() over (partition by doc_id, o order by s) as k from m join posts using (doc_id) "
        "where not regexp_matches(substr(text, cast(e as bigint) + 1, 3), '^\\s*\\(')) " + _row("s | e | o | o", "r", "k = 1"),
    51: spans_sql(r"(\S)( {2,})(\S)", w(r"\0", r"\1 \3")),
    52: spans_sql(r"(\S) +([.,!?;:])", w(r"\0", r"\1\2")),
    53: f"with posts as ({POSTS}), {spans_cte('m', r'([,!?;:.])(\p{L})', w(chr(92) + '0', chr(92) + '1 ' + chr(92) + '2'))} "
        + _row("s | e | o | g", "m join posts using (doc_id)",
               "o[1] <> '.' or not regexp_matches(substr(text, cast(greatest(s - 24, 0) as bigint) + 1, cast(s + 24 - greatest(s - 24, 0) as bigint)), '(?i)https?://|www\\.|[\\p{L}\\p{N}_-]+\\.[a-z]{2,}')"),
    54: spans_sql(rf"([\p{{L}}\p{{N}}.,!?;:])({EMOJI})", w(r"\0", r"\1 \2")),
    55: spans_sql(r"\. ?\. ?\.", w(r"\0", "..."), where="o <> '...'"),
    56: spans_sql(r"\.{4,}", w(r"\0", "...")),
    57: spans_sql(r"!!+|,,+|\?\?+|;;+|::+|\.\.+", w(), "substr(o, 1, 1)", "o[1] <> '.' or length(o) = 2"),
    58: spans_sql(r"([(\[])\s+([^\s)\]])|([^\s(\[])\s+([)\]])", w(r"\0", r"\1\2\3\4")),
    60: _POSTS + _at_end("chr(34)", "(len(string_split(text, chr(34))) - 1) % 2 = 1") + " union all "
        + _at_end("chr(39)", "(length(regexp_replace(regexp_replace(text, '(\\p{L})''(\\p{L})', '\\1\\2', 'g'), '[^'']', '', 'g'))) % 2 = 1"),
    61: spans_sql(r"(^|[^#\p{L}\p{N}_])(aiagent)" + POST, r"\1" + w(r"\2", "AI Agent") + r"\3", flags="gi"),
    62: spans_sql(r"(^|[^#\p{L}\p{N}_])((HTTPS|HTTP|JSON|API|CSV|URL|OCR|LLM|QR|UI|UX|AI)(\p{Lu}[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*))" + POST,
                  r"\1" + w(r"\2", r"\3 \4") + r"\5", where="length(o) >= 5 and lower(o) not in ('aiagent', 'openai')"),
    63: spans_sql(r"#\s+([\p{L}\p{N}_]+)", w(r"\0", r"#\1")),
    64: spans_sql(r"([\p{L}\p{N}]+)\s+(-[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*)", w(r"\0", r"\1\2"),
                  where="len(list_filter(" + "[" + ", ".join(q(k) for k in [*lexicon().brand_terms, *lexicon().preferred_spellings.values()]) + "]"
                        + ", lambda k: contains(k, g) or contains(g, string_split(k, ' ')[-1]))) > 0"),
    65: _dictionary(65), 66: _dictionary(66), 67: _dictionary(67), 68: _dictionary(68), 69: _dictionary(69),
    70: _dictionary(70), 74: _dictionary(74),
    71: _TOKENS.replace("[\\p{L}\\p{N}]+", "\\p{L}+") + """, b as (select *, lag(word) over o as pw, lag(gap_after) over o as pg,
          lag(s) over o as ps from t window o as (partition by doc_id, pos order by k)),
        c as (select *, case when pw = word and regexp_full_match(pg, ' +') then 0 else 1 end as brk from b),
        d as (select *, sum(brk) over (partition by doc_id, pos order by k) as run from c),
        r as (select *, row_number() over (partition by doc_id, pos, run order by k) as i from d) """
        + _row("off + ps | off + s + n | substr(line, cast(ps as bigint) + 1, cast(s + n - ps as bigint)) | substr(line, cast(ps as bigint) + 1, cast(n as bigint))", "r", "i % 2 = 0"),
    72: spans_sql(PRE + "(nova node)" + POST, r"\1" + w(r"\2", "NovaNode") + r"\3", flags="gi"),
    73: _POSTS + _row("length(text) - length(ltrim(text, chr(32) || chr(9) || chr(10))) | length(text) - length(ltrim(text, chr(32) || chr(9) || chr(10))) + 1 | "
                      "substr(ltrim(text, chr(32) || chr(9) || chr(10)), 1, 1) | upper(substr(ltrim(text, chr(32) || chr(9) || chr(10)), 1, 1))", "posts",
                      "regexp_matches(text, '^\\s*\\p{Ll}')"),
    75: spans_sql(r"(^|[^0-9])([0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})($|[^0-9])", r"\1" + w(r"\2") + r"\3",
                  f"concat_ws('/', {pad(_D(1))}, {pad(_D(2))}, {_D(3)})", f"cast({_D(1)} as int) between 1 and 31 and cast({_D(2)} as int) between 1 and 12"),
    77: _date_formats(),
    78: spans_sql(r"(^|\n)([^;\n]+)(;)(\S?)([^\n]*)", r"\1\2" + w(r"\3\4", packed(r"\2", r"\4", r"\5")) + r"\5",
                  f"case when {f(2)} = '' then ':' else concat(': ', {f(2)}) end",
                  f"{label(f'regexp_extract({f(1)}, {q(chr(91) + chr(94) + ".!?" + chr(93) + "*$")})')} and ({f(2)} <> '' or trim({f(3)}) <> '')"),
    79: _POSTS + f", z as (select doc_id, {_STRIP} as b from posts) "
        + _row("length(b) - 1 | length(b) | right(b, 1) | case when right(b, 1) = ',' then '.' else concat(right(b, 1), '.') end", "z",
               "right(b, 1) = ',' or (regexp_matches(right(b, 1), '[\\p{L}\\p{N}]') and not regexp_matches(b, '#[\\p{L}\\p{N}_]+$'))"),
}
ORACLES[26] = spans_sql(r"(#acme_?corp(?:oration)?)" + POST, w(r"\1", "#AcmeGroup") + r"\2", flags="gi")


def _times() -> str:
    """Each written form separately, then united."""
    forms = [
        (r"(^|[^\p{L}\p{N}])([0-9]{1,2}h[0-9]{2})($|[^\p{L}\p{N}])", "lower(o)", "split_part(x, 'h', 1)", "split_part(x, 'h', 2)"),
        (r"(^|[^\p{L}\p{N}])([0-9]{1,2}h)($|[^\p{L}\p{N}])", "lower(o)", "split_part(x, 'h', 1)", "'0'"),
        (r"(^|[^\p{L}\p{N}])([0-9]{1,2}\s+giờ\s+[0-9]{1,2})($|[^\p{L}\p{N}])", "lower(o)", "regexp_extract(x, '^[0-9]+')", "regexp_extract(x, '[0-9]+$')"),
        (r"(^|[^\p{L}\p{N}])([0-9]{1,2}\s+giờ)($|[^\p{L}\p{N}])", "lower(o)", "regexp_extract(x, '^[0-9]+')", "'0'"),
        (r"(^|[^\p{L}\p{N}])([0-9]:[0-9]{2})($|[^\p{L}\p{N}])", "o", "split_part(x, ':', 1)", "split_part(x, ':', 2)"),
    ]
    ctes = ", ".join(spans_cte(f"t{i}", p, r"\1" + w(r"\2") + r"\3", flags="gi") for i, (p, *_) in enumerate(forms))
    rows = " union all ".join(
        f"select {i} as kind, doc_id, s, e, o, {h} as hh, {m} as mm from (select *, {x} as x from t{i})" for i, (_, x, h, m) in enumerate(forms))
    ok = H_OK("hh", "mm")
    g = f"concat({pad('hh')}, ':', {pad('mm')})"
    return (f"with posts as ({POSTS}), {ctes}, a as (select * from ({rows}) where {ok}) "
            + _row(f"a.s | a.e | a.o | {g}", "a", f"a.o <> {g} and (kind <> 3 or not exists (select 1 from a b where b.kind = 2 "
                                                  "and b.doc_id = a.doc_id and a.s >= b.s and a.e <= b.e))"))


def _brackets() -> str:
    tokens = spans_cte("m", r"((?:^|\n)[^\S\n]*[0-9]{1,3}\))(\s)|([()\[\]])", r"\1\2" + w(r"\3"))
    opener = "case when o = ')' then '(' else '[' end"
    missing = "translate(reverse(stack), '([', ')]')"
    return (f"with recursive posts as ({POSTS}), {tokens}, tk as (select *, row_number() over (partition by doc_id order by s) as k from m where o <> ''), "
            f"r(doc_id, k, stack, s, bad, o) as (select doc_id, cast(0 as bigint), '', cast(0 as hugeint), false, '' from (select distinct doc_id from tk) "
            f"union all select t.doc_id, t.k, case when t.o in ('(', '[') then concat(r.stack, t.o) when right(r.stack, 1) = {opener.replace('o =', 't.o =')} "
            f"then substr(r.stack, 1, length(r.stack) - 1) else r.stack end, cast(t.s as hugeint), "
            f"t.o in (')', ']') and right(r.stack, 1) <> {opener.replace('o =', 't.o =')}, t.o from r join tk t on t.doc_id = r.doc_id and t.k = r.k + 1), "
            f"z as (select doc_id, arg_max(stack, k) as stack from r group by all), "
            f"p as (select doc_id, {_STRIP} as b, {missing} as x from z join posts using (doc_id) where stack <> '') "
            + _row("s | s + 1 | o | ''", "r", "bad") + " union all "
            + _row("length(b) - 1 | length(b) | right(b, 1) | case when regexp_matches(right(b, 1), '[.!?,;:]') then concat(x, right(b, 1)) else concat(right(b, 1), x) end", "p"))


ORACLES[59] = _brackets()
ORACLES[76] = _times()
ORACLE_SQL = {f"rule_{n:02d}": sql for n, sql in ORACLES.items()}
