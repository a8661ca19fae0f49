"""Rules that are one regular expression plus, at most, a row-local condition.

Each entry marks its matches in a copy of the text; one shared kernel turns all
marks into hits (see ``exprs.spans_many``).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from redpencil.functions import text as tx
from redpencil.functions.exprs import CLOSE, MID, OPEN, empty, field, fields, folded_lines, fresh, gate, let, lit, mark, spans_many, wrap
from redpencil.functions.exprs import HIT_TYPE
from redpencil.lexicon import ACRONYMS, INTENTIONAL_CAMEL, Lexicon, normalise_term

A, B, EMOJI, WS, NWS = tx.NOT_AFTER_WORD, tx.NOT_BEFORE_WORD, tx.PICTOGRAPHIC, tx.WS, tx.NOT_WS
LWS = tx.LINE_WS
NOT_AFTER_ALNUM, NOT_BEFORE_ALNUM = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
# ASCII word boundary, spelled out because Java's \b is Unicode-aware on some versions.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


@dataclass(frozen=True)
class SpanRule:
    code: int
    pattern: str
    template: str = wrap()
    gate: str | None = None              # cheap SQL condition on {t} and {low}
    keep: Callable[[str], str] | None = None    # hit variable -> condition
    suggest: Callable[[str], str] | None = None  # hit variable -> suggestion
    zero_width: bool = False
    in_line: bool = False                # matches stay within a line, and a line without the gate holds none


def has(s: str) -> str:
    return f"contains({{t}}, {lit(s)})"


DIGIT = "{t} rlike '[0-9]'"
_HINTS = tx.trie(tx.LABEL_HINTS).replace(" ", LWS + "+")
# A label hint close to the delimiter in question.
LABEL_COLON = f"contains({{t}}, ':') and {{low}} rlike {lit(rf'(?md)^{LWS}*+[^:{chr(92)}n]{{0,80}}?{_HINTS}[^:{chr(92)}n]*:')}"
LABEL_COMMA = f"{{low}} rlike {lit(rf'(?md)^{LWS}*+[^,|:{chr(92)}n]{{0,80}}?{_HINTS}[^,|:{chr(92)}n]*[,|]')}"
LABEL_SEMI = f"contains({{t}}, ';') and {{low}} rlike {lit(rf'{_HINTS}[^;{chr(92)}n]*;')}"
LABEL_START = f"{{low}} rlike {lit(rf'(?iumd)^{LWS}*+(?:[o0il1]{LWS}+)?{tx.trie(tx.LABEL_PREFIXES)}')}"
EMOJI_GATE = f"{{t}} rlike {lit(tx.MAYBE_PICTOGRAPHIC)}"


def low_has(*needles: str) -> str:
    return tx.contains_any("{low}", needles)


def looks(pattern: str) -> str:
    return f"{{t}} rlike {lit(pattern)}"


def _pad2(x: str) -> str:
    return f"lpad(cast(cast({x} as int) as string), 2, '0')"


def _date_ok(d: str, m: str, y: str) -> str:
    """Does day d exist in month m of year y (strings; y may be empty)?"""
    di, mi = f"cast({d} as int)", f"cast({m} as int)"
    yi = f"(case when {y} = '' then 2024 when length({y}) = 2 then 2000 + cast({y} as int) else cast({y} as int) end)"
    leap = f"(({yi} % 4 = 0 and {yi} % 100 <> 0) or {yi} % 400 = 0)"
    days = f"(case when {mi} = 2 then if({leap}, 29, 28) when {mi} in (4, 6, 9, 11) then 30 else 31 end)"
    return f"({mi} between 1 and 12 and {di} between 1 and {days})"


def _time_ok(h: str, m: str) -> str:
    return f"(cast({h} as int) between 0 and 23 and cast({m} as int) between 0 and 59)"


def _hhmm(h: str, m: str) -> str:
    return f"concat({_pad2(h)}, ':', {_pad2(m)})"


# Weekday names -> day of week (Sunday = 1).
WEEKDAYS = {
    "chủ nhật": 1, "thứ hai": 2, "thứ 2": 2, "thứ ba": 3, "thứ 3": 3, "thứ tư": 4, "thứ 4": 4,
    "thứ năm": 5, "thứ 5": 5, "thứ sáu": 6, "thứ 6": 6, "thứ bảy": 7, "thứ 7": 7,
}
# Relative dates and internal acronyms to be reviewed.
RELATIVE_DATES = ["hôm nay", "ngày mai", "ngày mốt", "tối nay", "sáng mai", "chiều mai", "tuần này", "tuần sau"]
INTERNAL_ACRONYMS = ["BU", "PM", "POC"]
# Rules whose matches, with what they look at around them, stay within a line and whose gate holds for each such line.
IN_LINE = {40, 50, 60, 90, 100, 110, 170, 180, 181, 190, 200, 210, 220, 230, 250, 260, 270, 290, 330, 390, 410, 420, 470, 480, 490, 510,
           520, 530, 540, 550, 560, 570, 620, 750, 760, 761, 764, 780, 781}


def _weekday_differs(h: str) -> str:
    name = tx.collapse_ws(f"lower({field(h + '.g', 1)})")
    expected = f"case {name} " + " ".join(f"when {lit(k)} then {v}" for k, v in WEEKDAYS.items()) + " end"
    d, m, y = (field(f"{h}.g", i) for i in (2, 3, 4))
    date = f"try_to_date(concat_ws('-', {y}, {m}, {d}), 'yyyy-M-d')"
    return f"({expected} is not null and {date} is not null and dayofweek({date}) <> {expected})"


def static_rules(lex: Lexicon) -> list[SpanRule]:
    """All span rules that apply to every source type."""
    g = lambda h, n: field(f"{h}.g", n)
    acronyms = tx.alternation([*ACRONYMS, *lex.acronyms])
    label_value = tx.value_pattern(lex.value_words)
    phone = r"(?<![0-9])(0(?:[\t\n\x0B\f\r \x{A0}.-]?[0-9]){7,11})(?![0-9])"
    date = r"(?<![0-9])([0-9]{1,2})([./-])([0-9]{1,2})(?:\2([0-9]{2}|[0-9]{4}))?(?![0-9])"
    label_line = lambda h: tx.is_label(g(h, 1))
    fix_label = lambda h: f"concat({g(h, 1)}, ': ', {tx.ltrim_ws(g(h, 2))})"
    keep_hm = lambda h: f"{_time_ok(g(h, 1), g(h, 2))} and {h}.o <> {_hhmm(g(h, 1), g(h, 2))}"
    hhmm = lambda h: _hhmm(g(h, 1), g(h, 2))
    same = lambda h: f"{h}.o"
    rules = [
        # whitespace and separators
        SpanRule(30, r"\n{3,}", wrap("$0", "\n\n"), has("\n\n\n")),
        SpanRule(40, r"(?md)^[ \t]+", wrap(), "({t} rlike '(?m)^[ \\\\t]')"),
        SpanRule(50, r"(?md)[ \t]+$", wrap(), "({t} rlike '(?md)[ \\\\t]$')"),
        SpanRule(60, rf"(?md)^({LWS}*)(-{{3,}}|\*{{3,}}|~{{3,}}|_{{3,}})({LWS}*)$",
                 f"$1{OPEN}$2{MID}{CLOSE}$3", tx.contains_any("{t}", ["---", "***", "~~~", "___"])),
        # list markers
        SpanRule(90, rf"(^|\n)({EMOJI})(?=[\p{{L}}\p{{N}}#@])", f"$1{wrap('$2', '$2 ')}", EMOJI_GATE),
        SpanRule(100, r"(^|\n)([-*•+])(?=[\p{L}\p{N}#@])", f"$1{wrap('$2', '$2 ')}",
                 looks(r"(?md)^[-*•+][\p{L}\p{N}#@]")),
        SpanRule(110, r"(^|\n)([0-9]{1,2}[.)])(?=[\p{L}#@])", f"$1{wrap('$2', '$2 ')}",
                 looks(r"(?md)^[0-9]{1,2}[.)]")),
        # labels
        SpanRule(170, rf"(?md)^({LWS}*)(([^:\n]{{1,80}}?){LWS}+:({LWS}*)([^\n]+))$",
                 f"$1{wrap('$2', fields('$3', '$5'))}", LABEL_COLON, label_line, fix_label),
        SpanRule(180, rf"(?md)^({LWS}*)(([^,|:\n]{{1,80}}?)({LWS}*),({LWS}*)([^\n]+))$",
                 f"$1{wrap('$2', fields('$3', '$6'))}", LABEL_COMMA,
                 lambda h: f"{label_line(h)} and {tx.is_value(g(h, 2), lex.value_words)}", fix_label),
        SpanRule(181, rf"(?md)^({LWS}*)(([^,|:\n]{{1,80}}?)({LWS}*)\|({LWS}*)([^\n]+))$",
                 f"$1{wrap('$2', fields('$3', '$6'))}", LABEL_COMMA,
                 lambda h: f"{label_line(h)} and {tx.is_value(g(h, 2), lex.value_words)}", fix_label),
        SpanRule(190, rf"(?md)^({LWS}*(?iu:{tx.alternation(tx.LABEL_PREFIXES)}))({LWS}+)(?![:;,|])(?={label_value})",
                 f"$1{wrap('$2', ': ')}", LABEL_START),
        SpanRule(780, rf"(?md)^([^;\n]++)(;({NWS}))", f"$1{wrap('$2', fields('$1', '$3'))}", LABEL_SEMI,
                 lambda h: tx.is_label(f"regexp_extract({g(h, 1)}, '[^.!?]*$', 0)"),
                 lambda h: f"concat(': ', {g(h, 2)})"),
        SpanRule(781, rf"(?md)^([^;\n]++)(;)(?={LWS}+{NWS})", f"$1{wrap('$2', '$1')}", LABEL_SEMI,
                 lambda h: tx.is_label(f"regexp_extract({h}.g, '[^.!?]*$', 0)"), lambda h: "':'"),
        # leaked markup
        SpanRule(200, rf"(?iu)\[([^\]\n]{{1,120}})\]\(((?:https?://|www\.)(?:(?!\)){NWS})+)\)",
                 wrap("$0", "$1: $2"), has("](")),
        SpanRule(210, r"(\*\*|__)([^\n]{1,120}?)\1", wrap("$0", "$2"), f"({has('**')} or {has('__')})"),
        SpanRule(220, r"`([^`\n]{1,120})`", wrap("$0", "$1"), has("`")),
        SpanRule(230, r"&(?:amp|nbsp|lt|gt);", wrap(), has("&"), None,
                 lambda h: f"case {h}.o when '&amp;' then '&' when '&nbsp;' then ' ' when '&lt;' then '<' else '>' end"),
        # social tokens
        SpanRule(250, r"#[\p{L}\p{N}_]*[-&][\p{L}\p{N}_&-]+", wrap(), has("#"), None,
                 lambda h: f"translate({h}.o, '-&', '')"),
        SpanRule(270, r"([\p{L}\p{N}])(#[\p{L}\p{N}_]+)", wrap("$0", "$1 $2"), has("#")),
        SpanRule(280, rf"@{WS}+([A-Za-z0-9_.]+)", wrap("$0", "@$1"), has("@")),
        SpanRule(300, rf"(?i){EDGE}([A-Z0-9._%+-]++){WS}+@([A-Z0-9.-]+\.[A-Z]{{2,}}){EDGE}",
                 wrap("$0", "$1@$2"), has("@")),
        SpanRule(310, rf"(?i){EDGE}([A-Z0-9._%+-]+@){WS}+([A-Z0-9.-]+\.[A-Z]{{2,}}){EDGE}",
                 wrap("$0", "$1$2"), has("@")),
        SpanRule(320, rf"(?i){EDGE}(https?://){WS}+({NWS}+)", wrap("$0", "$1$2"), has("://")),
        SpanRule(330, rf"(?i){EDGE}((?:https?://|www\.){NWS}+[.,;:!?])(?={WS}|\z)", wrap(),
                 f"({has('://')} or {{t}} rlike '(?i)www[.]')", None,
                 lambda h: f"substring({h}.o, 1, length({h}.o) - 1)"),
        SpanRule(630, rf"#{WS}+([\p{{L}}\p{{N}}_]+)", wrap("$0", "#$1"), has("#")),
        # numbers, dates, times
        SpanRule(360, rf"(?<![0-9])([0-9]+(?:[.,][0-9]+)?){WS}+%", wrap("$0", "$1%"), has("%")),
        SpanRule(370, rf"(?iu){NOT_AFTER_ALNUM}([0-9][0-9.,]*){WS}+(k|đ|vnđ){NOT_BEFORE_ALNUM}",
                 wrap("$0", "$1$2"), DIGIT),
        SpanRule(380, rf"(?i){NOT_AFTER_ALNUM}([0-9]+(?:[.,][0-9]+)?)({WS}*)(kb|mb|gb|tb){NOT_BEFORE_ALNUM}",
                 wrap("$0", fields("$1", "$3")), DIGIT,
                 lambda h: f"{h}.o <> concat({g(h, 1)}, ' ', upper({g(h, 2)}))",
                 lambda h: f"concat({g(h, 1)}, ' ', upper({g(h, 2)}))"),
        SpanRule(390, r"(?<![A-Za-z0-9_])[0-9]{1,3}(?:,[0-9]{3})+(?![A-Za-z0-9_])", wrap(), DIGIT, None,
                 lambda h: f"translate({h}.o, ',', '.')"),
        SpanRule(400, rf"(?<![0-9])([0-9]{{1,2}}:[0-9]{{2}}){WS}*[-–—]{WS}*([0-9]{{1,2}}:[0-9]{{2}})(?![0-9])",
                 wrap("$0", "$1 - $2"), has(":"), lambda h: f"{h}.o <> {h}.g"),
        SpanRule(410, date, wrap("$0", fields("$1", "$3", "$4")), looks("[0-9][./-][0-9]"),
                 lambda h: f"not {_date_ok(g(h, 1), g(h, 2), g(h, 3))}", same),
        SpanRule(420, r"(?<![0-9])([0-9]{1,2}):([0-9]{2})(?![0-9])", wrap("$0", fields("$1", "$2")), has(":"),
                 lambda h: f"not {_time_ok(g(h, 1), g(h, 2))}", same),
        SpanRule(430, rf"(?iu)((?:thứ{WS}*(?:hai|ba|tư|năm|sáu|bảy|[2-7]))|chủ{WS}*nhật),?{WS}+"
                      r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})",
                 wrap("$0", fields("$1", "$2", "$3", "$4")), looks("[0-9]/[0-9]"), _weekday_differs, same),
        SpanRule(440, rf"(?iu){A}{tx.alternation(RELATIVE_DATES)}{B}", wrap("$0", "$0"),
                 low_has(*RELATIVE_DATES)),
        SpanRule(450, phone, wrap("$0", "$0"), has("0"),
                 lambda h: f"regexp_count({h}.o, '[0-9]') <> 10"),
        SpanRule(750, r"(?<![0-9])([0-9]{1,2})([.-])([0-9]{1,2})\2([0-9]{4})(?![0-9])",
                 wrap("$0", fields("$1", "$3", "$4")), looks("[0-9][.-][0-9]"),
                 lambda h: f"cast({g(h, 1)} as int) between 1 and 31 and cast({g(h, 2)} as int) between 1 and 12",
                 lambda h: f"concat_ws('/', {_pad2(g(h, 1))}, {_pad2(g(h, 2))}, {g(h, 3)})"),
        SpanRule(760, rf"(?iu){NOT_AFTER_ALNUM}([0-9]{{1,2}})h([0-9]{{2}}){NOT_BEFORE_ALNUM}",
                 wrap("$0", fields("$1", "$2")), looks("[0-9][hH]"), keep_hm, hhmm),
        SpanRule(761, rf"(?iu){NOT_AFTER_ALNUM}([0-9]{{1,2}})h{NOT_BEFORE_ALNUM}",
                 wrap("$0", fields("$1", "00")), looks("[0-9][hH]"), keep_hm, hhmm),
        SpanRule(762, rf"(?iu){NOT_AFTER_ALNUM}([0-9]{{1,2}}){WS}+giờ{WS}+([0-9]{{1,2}}){NOT_BEFORE_ALNUM}",
                 wrap("$0", fields("$1", "$2")), low_has("ờ"), keep_hm, hhmm),
        # the short form is silent where the long one already reports a valid time
        SpanRule(763, rf"(?iu){NOT_AFTER_ALNUM}([0-9]{{1,2}}){WS}+giờ{NOT_BEFORE_ALNUM}"
                      rf"(?!{WS}+[0-5]?[0-9]{NOT_BEFORE_ALNUM})",
                 wrap("$0", fields("$1", "00")), low_has("ờ"), keep_hm, hhmm),
        SpanRule(764, rf"{NOT_AFTER_ALNUM}([0-9]):([0-9]{{2}}){NOT_BEFORE_ALNUM}",
                 wrap("$0", fields("$1", "$2")), has(":"), keep_hm, hhmm),
        # compact terms, acronyms
        SpanRule(470, rf"(?iu){A}genz{B}", wrap("$0", "Gen Z"), low_has("genz")),
        SpanRule(480, rf"{A}Top([0-9]{{1,3}}){B}", wrap("$0", "Top $1"), has("Top")),
        SpanRule(490, rf"(?md)^({LWS}*)([O0Il1]{LWS})({LWS}*)(?=(?iu:{tx.alternation(tx.LABEL_PREFIXES)}))",
                 f"$1{wrap('$2')}$3", LABEL_START),
        # blanks and punctuation
        SpanRule(510, rf"({NWS})( {{2,}})({NWS})", wrap("$0", "$1 $3"), has("  ")),
        SpanRule(520, rf"({NWS}) +([.,!?;:])", wrap("$0", "$1$2"), looks(" [.,!?;:]")),
        SpanRule(530, r"([,!?;:]|\.)(\p{L})", wrap("$0", "$1 $2"), looks(r"[,!?;:.]\p{L}")),
        # the exact class has some eighty parts; a short one goes before it
        SpanRule(540, rf"(?=(?s:.){tx.MAYBE_PICTOGRAPHIC})([\p{{L}}\p{{N}}.,!?;:])({EMOJI})", wrap("$0", "$1 $2"), EMOJI_GATE),
        SpanRule(550, r"\. ?\. ?\.", wrap("$0", "..."), tx.contains_any("{t}", [". .", ".. ."]),
                 lambda h: f"{h}.o <> '...'"),
        SpanRule(560, r"\.{4,}", wrap("$0", "..."), has("....")),
        SpanRule(570, r"([!,?;:])\1+|(?<!\.)\.{2}(?!\.)", wrap(),
                 tx.contains_any("{t}", ["!!", ",,", "??", ";;", "::", ".."]), None,
                 lambda h: f"substring({h}.o, 1, 1)"),
        SpanRule(580, rf"([(\[]){WS}+((?![)\]]){NWS})|((?![(\[]){NWS}){WS}+([)\]])", wrap("$0", "$1$2$3$4"),
                 "(" + tx.contains_any("{t}", "()[]") + " and " + looks(rf"[(\[]{WS}|[\t\n \x{{A0}}][)\]]") + ")"),
        SpanRule(620, rf"(?<![#\p{{L}}\p{{N}}_])(?<![\p{{L}}\p{{N}}]-)({acronyms})(\p{{Lu}}[\p{{L}}\p{{N}}]+(?:-[\p{{L}}\p{{N}}]+)*+){B}",
                 wrap("$0", "$1 $2"), looks(r"[A-Z]{2}\p{Lu}"),
                 lambda h: f"length({h}.o) >= 5 and not array_contains({_strings(INTENTIONAL_CAMEL)}, lower({h}.o))"
                           f" and not array_contains({_strings(t.lower() for t in lex.protected())}, lower({h}.o))"
                           f" and not array_contains({_strings(_compact_terms(lex))}, lower({h}.o))"),
        SpanRule(710, r"(?iu)(?<!\p{L})(\p{L}++) +\1(?!\p{L})", wrap("$0", "$1")),
    ]
    # Public names that must be written in full.
    rules += [
        SpanRule(350, rf"(?iu)(?<![#@\p{{L}}\p{{N}}_])(?:vn|vi[eệ]t(?:{WS}|[_-])*n?am){B}", wrap("$0", "Việt Nam"),
                 low_has("vn", "viet", "việt")),
        SpanRule(351, rf"(?iu)(?<![#@\p{{L}}\p{{N}}_])(?:tphcm|hcmc|tp\.?{WS}*hcm){B}", wrap("$0", "TP.HCM"), low_has("hcm")),
    ]
    for root, name in lex.legacy_names.items():
        r = tx.escape(root)
        rules += [
            SpanRule(260, rf"(?iu)#{r}_?corp(?:oration)?{B}", wrap("$0", "#" + "".join(name.split())), low_has("corp")),
            SpanRule(340, rf"(?iu)(?<![#\p{{L}}\p{{N}}_]){r}{WS}*corp(?:oration)?{B}", wrap("$0", name), low_has("corp")),
        ]
    mentions = {w: r for w, r in lex.product_terms.items() if " " in w and " " not in r}
    mentions |= spaced_brands(lex)
    for wrong, right in {w.lower(): r for w, r in mentions.items()}.items():
        rules.append(SpanRule(290, rf"(?iu){A}@{tx.escape(wrong)}{B}", wrap("$0", "@" + "".join(right.split())),
                              has("@")))
    for spaced, term in spaced_brands(lex).items():
        rules.append(SpanRule(720, rf"(?iu){A}{tx.escape(spaced)}{B}", wrap("$0", term), low_has(spaced.lower())))
    glued = _compact_terms(lex)
    if glued:
        rules.append(SpanRule(
            610, rf"(?iu)(?<![#\p{{L}}\p{{N}}_])(?<![\p{{L}}\p{{N}}]-){tx.alternation(glued)}{B}(?!-[\p{{L}}\p{{N}}])",
            wrap(), low_has(*glued),
            lambda h: (f"length({h}.o) >= 5 and {h}.o <> {_choose(f'lower({h}.o)', glued)}"
                       f" and not array_contains({_strings(t.lower() for t in lex.protected())}, lower({h}.o))"
                       f" and not array_contains({_strings(INTENTIONAL_CAMEL)}, lower({h}.o))"),
            lambda h: _choose(f"lower({h}.o)", glued)))
    known = [*lex.brand_terms, *lex.preferred_spellings.values()]
    if known:
        x = fresh("x")
        rules.append(SpanRule(
            640, rf"([\p{{L}}\p{{N}}]+){WS}+(-[\p{{L}}\p{{N}}]+(?:-[\p{{L}}\p{{N}}]+)*)", wrap("$0", "$1$2"),
            has("-"),
            lambda h: (f"exists({_strings(known)}, {x} -> contains({x}, {h}.g) or "
                       f"(substring_index({x}, ' ', -1) <> '' and contains({h}.g, substring_index({x}, ' ', -1))))")))
    # the gate of R62 asks for two capitals, which an acronym of the lexicon need not end with
    capitals = all(re.search("[A-Z]{2}$", a) for a in [*ACRONYMS, *lex.acronyms])
    return [replace(r, in_line=r.code in IN_LINE and "\n" not in r.pattern and (capitals or r.code != 620)) for r in rules]


def spaced_brands(lex: Lexicon) -> dict[str, str]:
    """CamelCase brand terms keyed by their spelling with blanks."""
    out = {}
    for term in lex.brand_terms:
        if re.match(r"^[A-Z][a-z]+[A-Z]", term):
            out[re.sub(r"([a-z])([A-Z])", r"\1 \2", term)] = term
    return out


def _compact_terms(lex: Lexicon) -> dict[str, str]:
    return {"".join(t.split()).lower(): t for t in map(normalise_term, lex.protected()) if " " in t}


def _strings(values) -> str:
    values = list(values)
    return "array(" + ", ".join(lit(v) for v in values) + ")" if values else "cast(array() as array<string>)"


def _choose(key: str, mapping: dict[str, str]) -> str:
    return f"case {key} " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in mapping.items()) + " end"


def span_hits(text: str, low: str, rules: list[SpanRule]) -> str:
    """Run span rules over ``text``: ``array<hit>`` with final suggestions."""
    if not rules:
        return empty(HIT_TYPE)
    marks = []
    for r in rules:
        if not r.in_line:
            m = mark(text, r.pattern, r.template)
            marks.append((r.code, gate(r.gate.replace("{t}", text).replace("{low}", low), m, "''") if r.gate else m, r.zero_width))
    h, p = fresh("h"), fresh("h")
    by_code: dict[int, SpanRule] = {r.code: r for r in rules}
    keeps = [(c, r.keep(h)) for c, r in by_code.items() if r.keep]
    suggests = [(c, r.suggest(p)) for c, r in by_code.items() if r.suggest]
    inside = [r for r in rules if r.in_line]

    def with_lines(lines: str) -> str:
        """Most lines pass few gates, so few of them are searched."""
        x, y = fresh("x"), fresh("y")
        passed = lambda r: r.gate.replace("{t}", f"{x}.t").replace("{low}", f"{x}.l")
        return spans_many(marks, [(r.code, f"transform(filter({lines}, {x} -> {passed(r)}), {y} -> named_struct('s', {y}.s, 'm', "
                                           f"{mark(f'{y}.t', r.pattern, r.template)}))", r.zero_width) for r in inside])
    found = let(folded_lines(text, low), with_lines) if inside else spans_many(marks)
    if 530 in by_code:  # R53: a dot inside something like a link is not a sentence end
        keeps.append((530, f"(not startswith({h}.o, '.') or not {tx.urlish_around(text, f'{h}.s', f'{h}.s', 24)})"))
    for c in (610, 620):
        if c in by_code:
            base = dict(keeps).get(c, "true")
            keeps = [(k, v) for k, v in keeps if k != c]
            keeps.append((c, f"({base}) and not {tx.urlish_around(text, f'{h}.s', f'{h}.e', 12)}"))
    if keeps:
        cond = " ".join(f"when {c} then {k}" for c, k in keeps)
        found = f"filter({found}, {h} -> case {h}.r {cond} else true end)"
    g = f"{p}.g"
    if suggests:
        g = f"case {p}.r " + " ".join(f"when {c} then {s}" for c, s in suggests) + f" else {p}.g end"
    return (
        f"transform({found}, {p} -> named_struct('r', {p}.r, 'k', {p}.r % 10, 's', {p}.s, 'e', {p}.e, "
        f"'o', {p}.o, 'g', {g}))"
    )
