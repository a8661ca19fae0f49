"""Rules that compare parts of one text: lines, lists, headings, variants,
brackets, quotes, date formats, caption edges.

All of them work on arrays inside the row; nothing is exploded or shuffled.
"""

from __future__ import annotations

from redpencil.functions import text as tx
from redpencil.functions.exprs import (
    HIT_TYPE, any_overlap, chunks, cut, empty, field, fields, fresh, gate, let, line_array, lit, mark, scan, spans,
    spans_many, wrap,
)
from redpencil.operators import ranges as rg
from redpencil.operators.span_rules import INTERNAL_ACRONYMS
from redpencil.lexicon import Lexicon

LWS, WS, NWS = tx.LINE_WS, tx.WS, tx.NOT_WS
LL = r"\p{Ll}"


def hit(code: int | str, s: str, e: str, o: str, g: str, k: str = "0") -> str:
    return f"named_struct('r', {code}, 'k', {k}, 's', {s}, 'e', {e}, 'o', {o}, 'g', {g})"


def one_if(condition: str, h: str) -> str:
    return f"if({condition}, array({h}), {empty(HIT_TYPE)})"


def repeated(found: str, key) -> str:
    """Elements whose key already occurred earlier in the array."""
    x, i, y = fresh("x"), fresh("i"), fresh("y")

    def run(v: str) -> str:
        return let(f"transform({v}, {y} -> {key(y)})",
                   lambda ks: f"filter({v}, ({x}, {i}) -> array_position({ks}, {key(x)}) <= {i})")
    return let(found, run)


def first_only(found: str, key) -> str:
    x, i, y = fresh("x"), fresh("i"), fresh("y")

    def run(v: str) -> str:
        return let(f"transform({v}, {y} -> {key(y)})",
                   lambda ks: f"filter({v}, ({x}, {i}) -> array_position({ks}, {key(x)}) = {i} + 1)")
    return let(found, run)


# -- caption edges (R1, R2, R73, R79) -------------------------------------------------

def leading_blanks(t: str) -> str:
    o = f"regexp_extract({t}, '^[ \\\\t]+', 0)"
    return one_if(f"{o} <> ''", hit(10, "0", f"length({o})", o, "''"))


def trailing_blanks(t: str) -> str:
    o = f"regexp_extract({t}, '[ \\\\t]+\\\\z', 0)"
    return one_if(f"{t} rlike '[ \\\\t]\\\\z'", hit(20, f"length({t}) - length({o})", f"length({t})", o, "''"))


def first_letter_case(t: str) -> str:
    o = f"regexp_extract({t}, {lit(f'^{WS}*({NWS})')}, 1)"
    s = f"length(regexp_extract({t}, {lit(f'^{WS}*')}, 0))"
    return one_if(f"{o} rlike {lit('^' + LL)}", hit(730, s, f"{s} + 1", o, tx.upper_letter(o)))


def final_punctuation(t: str) -> str:
    def run(b: str) -> str:
        last, e = f"right({b}, 1)", f"length({b})"
        comma = hit(790, f"{e} - 1", e, "','", "'.'")
        bare = hit(791, f"{e} - 1", e, last, f"concat({last}, '.')")
        tag = r"#[\p{L}\p{N}_]+\z"
        return (
            f"case when {last} = ',' then array({comma}) "
            f"when {last} rlike {lit('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')} "
            f"and not {b} rlike {lit(tag)} then array({bare}) else {empty(HIT_TYPE)} end"
        )
    return let(tx.rtrim_ws(t), run)


# -- lines and lists (R7, R12, R13) ---------------------------------------------------

def repeated_lines(t: str, low: str) -> str:
    """R7; texts whose normalised lines are all distinct are skipped early."""
    x, y, z = fresh("x"), fresh("y"), fresh("z")

    def facts(v: str) -> str:
        lead = f"length({v}.t) - length({tx.ltrim_ws(v + '.t')})"
        trimmed = tx.trim_ws(f"{v}.t")
        return let(trimmed, lambda b: (
            f"named_struct('s', {v}.s + ({lead}), 't', {b}, 'n', lower({tx.collapse_ws(b)}))"))

    lines = f"filter(transform({line_array(t)}, {x} -> {facts(x)}), {y} -> length({y}.n) >= 8)"
    again = repeated(lines, lambda v: f"{v}.n")
    found = (f"transform({again}, {z} -> "
             f"{hit(70, f'{z}.s', f'{z}.s + length({z}.t)', f'{z}.t', chr(39) * 2)})")
    n = fresh("n")
    # single blanks stand for themselves
    plain = f"regexp_replace(regexp_replace({low}, {lit(LWS + '{2,}|' + LWS.replace(' ', ''))}, ' '), ' ?\\n ?', '\\n')"
    some = let(f"filter(split({plain}, '\\n'), {n} -> length({n}) >= 8)",
               lambda v: f"size(array_distinct({v})) < size({v})")
    return gate(some, found, empty(HIT_TYPE))


# -- repeated phrases (R8) ------------------------------------------------------------

ALNUM, GAP = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}\n]++"


def _said_twice(n: int) -> str:
    """n words (group 2) said twice with blanks in between (group 1)."""
    first = GAP.join([rf"({ALNUM}++)"] * n)
    again = GAP.join(rf"\{3 + i}(?!{ALNUM})" for i in range(n))
    return rf"(?iu)^(({first})[ \t]+{again})"


def repeated_phrases(t: str, low: str) -> str:
    """Phrases of 5..2 words said twice; overlapping hits all count.

    One pass finds word pairs that come again 2..5 words later; only there the
    four phrase lengths are tested.
    """
    start = (rf"(?<!{ALNUM})(?=({ALNUM}++){GAP}({ALNUM}++)(?:{GAP}{ALNUM}++){{0,3}}?"
             rf"[ \t]++\1(?!{ALNUM}){GAP}\2(?!{ALNUM}))(?=({ALNUM}++(?:{GAP}{ALNUM}++){{3,9}}+))")
    x, w = fresh("x"), fresh("w")

    def at(line: str) -> str:
        tries = []
        for n in (5, 4, 3, 2):
            whole, once = (f"regexp_extract({line}, {lit(_said_twice(n))}, {g})" for g in (1, 2))
            tries.append(hit(80 + 5 - n, f"{x}.s", f"{x}.s + length({whole})", whole, once, str(5 - n)))
        return f"filter(array({', '.join(tries)}), {w} -> {w}.o <> '')"

    words = lambda parts: cut(parts, t, f"{x}.s", f"length({x}.o)")
    found = let(chunks(t), lambda parts: (
        f"flatten(transform({spans(low, start, wrap('$3'), zero_width=True)}, {x} -> {let(words(parts), at)}))"))
    i = fresh("i")

    def some_pair_again(v: str) -> str:
        again = " or ".join(f"(get({v}, {i}) = get({v}, {i} + {n}) and get({v}, {i} + 1) = get({v}, {i} + {n + 1}))"
                            for n in (2, 3, 4, 5))
        return f"exists(sequence(0, greatest(size({v}) - 4, 0)), {i} -> {again})"

    return gate(let(f"split({low}, {lit(r'[^' + ALNUM[1:-1] + ']+')})", some_pair_again), found, empty(HIT_TYPE))


def _majority(values: str) -> str:
    """Most frequent value; the earliest one on a tie."""
    def run(v: str) -> str:
        d, m, c = fresh("d"), fresh("m"), fresh("c")
        count = lambda a: f"size(filter({v}, {c} -> {c} = {a}))"
        return (f"aggregate(array_distinct({v}), cast(null as string), "
                f"({m}, {d}) -> if({m} is null or {count(d)} > {count(m)}, {d}, {m}))")
    return let(values, run)


def numbered_list_format(t: str) -> str:
    """Majority delimiter; zero padding dropped where it is mixed."""
    found = spans(t, rf"(?md)^({LWS}*)([0-9]{{1,3}}[.)])(?={LWS})", f"$1{wrap('$2')}")

    def run(v: str) -> str:
        x, y, h, w = fresh("x"), fresh("y"), fresh("h"), fresh("w")
        padded = lambda a: f"({a}.o rlike '^0[0-9]')"
        number = lambda a: f"substring({a}.o, 1, length({a}.o) - 1)"
        delims = f"transform({v}, {x} -> right({x}.o, 1))"
        mixed_pad = f"(exists({v}, {y} -> {padded(y)}) and exists({v}, {y} -> not {padded(y)}))"

        def judged(best: str) -> str:
            def padding(mp: str) -> str:
                new = f"concat(if({mp}, cast(cast({number(h)} as int) as string), {number(h)}), {best})"
                fixed = f"transform({v}, {h} -> {hit(120, f'{h}.s', f'{h}.e', f'{h}.o', new)})"
                mixed = f"({mp} or size(array_distinct({delims})) > 1)"
                return (f"if(size({v}) >= 2 and {mixed}, filter({fixed}, {w} -> {w}.o <> {w}.g), "
                        f"{empty(HIT_TYPE)})")
            return let(mixed_pad, padding)
        return let(_majority(delims), judged)

    return gate(f"{t} rlike {lit(rf'(?m)^{LWS}*[0-9]{{1,3}}[.)]')}", let(found, run), empty(HIT_TYPE))


def bullet_list_format(t: str) -> str:
    """R13."""
    found = spans(t, rf"(?md)^({LWS}*)([-*•+])(?={LWS})", f"$1{wrap('$2')}")

    def run(v: str) -> str:
        x, h, w = fresh("x"), fresh("h"), fresh("w")
        return let(_majority(f"transform({v}, {x} -> {x}.o)"), lambda best: (
            f"filter(transform({v}, {h} -> {hit(130, f'{h}.s', f'{h}.e', f'{h}.o', best)}), "
            f"{w} -> {w}.o <> {w}.g)"))

    return gate(f"{t} rlike {lit(rf'(?m)^{LWS}*[-*•+]')}", let(found, run), empty(HIT_TYPE))


# -- headings (R14, R15) --------------------------------------------------------------

TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}_-]*+"
LOWER_TOKEN = r"(?=[\p{L}\p{N}_-]*\p{Ll})" + TOKEN


def _shift(found: str, by: str, code: int) -> str:
    x = fresh("x")
    return f"transform({found}, {x} -> {hit(code, f'{x}.s + {by}', f'{x}.e + {by}', f'{x}.o', f'upper({x}.o)')})"


def heading_words(headings: str, excluded: str) -> str:
    """Lower-case words in a capitals heading, outside links and terms."""
    q, w = fresh("q"), fresh("w")
    words = _shift(spans(f"{q}.t", TOKEN), f"{q}.s", 140)
    return (f"flatten(transform({headings}, {q} -> filter({words}, "
            f"{w} -> {w}.o rlike {lit(LL)} and not {any_overlap(w, excluded)})))")


def heading_phrases(headings: str, excluded: str) -> str:
    """The longest run from one lower-case word to another; a protected
    word in lower case ends the run, one in capitals does not."""
    q, w, z, m, r = fresh("q"), fresh("w"), fresh("z"), fresh("m"), fresh("r")
    tokens = f"transform({spans(f'{q}.t', TOKEN)}, {z} -> named_struct('s', {z}.s + {q}.s, 'e', {z}.e + {q}.s, 'o', {z}.o))"
    stops = f"filter({tokens}, {w} -> {w}.o rlike {lit(LL)} and {any_overlap(w, excluded)})"
    blotted = (f"aggregate({stops}, {q}.t, ({m}, {r}) -> overlay({m} placing repeat('\ufdd3', {r}.e - {r}.s) "
               f"from {r}.s - {q}.s + 1 for {r}.e - {r}.s))")
    run = rf"{LOWER_TOKEN}(?:{WS}+{TOKEN})*{WS}+{LOWER_TOKEN}"
    return f"flatten(transform({headings}, {q} -> {_shift(spans(blotted, run), f'{q}.s', 150)}))"


# -- term variants (R16) --------------------------------------------------------------

# Fixed values: (canonical form, other forms, canonical pattern). The canonical form is listed last.
VARIANTS: list[tuple[str, list[str], str]] = [
    ("công ty", [r"(?:cty|c\.ty)"], r"công\s+ty"),
    ("thành phố", [r"tp\.?"], r"thành\s+phố"),
    ("TP.HCM", ["tphcm", r"tp\.?\s+hcm", r"(?:thành\s+phố|tp\.?)\s+hồ\s+chí\s+minh"], r"tp\.hcm"),
    ("Hà Nội", ["hn"], r"hà\s+nội"),
    ("nhân viên", ["nv"], r"nhân\s+viên"),
    ("sinh viên", ["sv"], r"sinh\s+viên"),
    ("cộng tác viên", ["ctv"], r"cộng\s+tác\s+viên"),
    ("đăng ký", ["(?:đk|dk)"], r"đăng\s+ký"),
    ("Facebook", ["fb"], "facebook"),
    ("Instagram", ["ig"], "instagram"),
    ("thương mại điện tử", ["(?:tmđt|tmdt)"], r"thương\s+mại\s+điện\s+tử"),
    ("công nghệ thông tin", ["cntt"], r"công\s+nghệ\s+thông\s+tin"),
    ("ban tổ chức", ["btc"], r"ban\s+tổ\s+chức"),
    ("câu lạc bộ", ["clb"], r"câu\s+lạc\s+bộ"),
    ("đại học", ["(?:đh|dh)"], r"đại\s+học"),
]


def _ws(p: str) -> str:
    return p.replace(r"\s", WS)


def _initials(forms) -> str:
    """Class of the letters that forms start with, in both cases; the long s is an s."""
    import re
    more = {"s": "Sſ"}
    letters = {c for p in forms for c in re.findall(r"(?:^|\(\?:|\|)(\w)", p)}
    return "[" + "".join(sorted(c + more.get(c, c.upper()) for c in letters)) + "]"


# a cheap test that leaves out most places inside words
_NOT_IN_WORD = r"(?<![A-Za-z0-9_])"


def term_variants(t: str, low: str) -> str:
    """A group used in two or more forms; report the non-canonical ones.

    One pass finds the non-canonical forms; only their groups are looked for in the text.
    """
    import re
    short = sorted((p for _, others, _ in VARIANTS for p in others), key=len, reverse=True)
    some = rf"{_NOT_IN_WORD}(?={_initials(short)})(?iu){tx.NOT_AFTER_WORD}(?=({'|'.join(map(_ws, short))}){tx.NOT_BEFORE_WORD})"
    fixed = re.compile(tx.FIXED_CASE)
    names = "array(" + ", ".join(lit(c) for c, _, _ in VARIANTS) + ")"
    cased = "array(" + ", ".join("true" if fixed.search(c) else "false" for c, _, _ in VARIANTS) + ")"
    last = "array(" + ", ".join(str(len(o) + 1) for _, o, _ in VARIANTS) + ")"

    def marks(said: str) -> list[tuple[int, str, bool]]:
        out = []
        for i, (_, others, canon) in enumerate(VARIANTS):
            forms, v = [*others, canon], fresh("v")
            pattern = (rf"{_NOT_IN_WORD}(?={_initials(forms)})(?iu){tx.NOT_AFTER_WORD}(?:{'|'.join(f'({_ws(p)})' for p in forms)}){tx.NOT_BEFORE_WORD}")
            slots = fields(*(f"${n + 1}" for n in range(len(forms))))
            used = f"exists({said}, {v} -> {v} rlike {lit(rf'(?iu)^(?:{chr(124).join(map(_ws, others))}){tx.NOT_BEFORE_WORD}')})"
            out.append((i, gate(used, mark(t, pattern, wrap("$0", slots)), "''"), False))
        return out

    def run(occ: str) -> str:
        x, y, z, h, w, p = fresh("x"), fresh("y"), fresh("z"), fresh("h"), fresh("w"), fresh("p")
        form = lambda a: f"length(regexp_extract({a}.g, '^(\ufdd3*)', 1)) + 1"
        forms = f"array_distinct(transform({occ}, {z} -> named_struct('r', {z}.r, 'f', {form(z)})))"
        odd = let(forms, lambda known: (
            f"filter({occ}, {x} -> {form(x)} <> {last}[{x}.r] and exists({known}, {y} -> {y}.r = {x}.r and {y}.f <> {form(x)}))"))

        def judged(odd: str) -> str:
            def with_headings(up: str) -> str:
                canon = f"{names}[{h}.r]"
                letter = f"regexp_extract({h}.o, {lit(chr(92) + 'p{L}')}, 0)"
                g = (f"case when {cased}[{h}.r] then {canon} when {rg.in_heading(h, up)} then upper({canon}) "
                     f"when {letter} <> '' and {letter} = upper({letter}) then {tx.capitalise_first_letter(canon)} "
                     f"else {canon} end")

                def with_lines(likely: str) -> str:
                    code = f"if(exists({likely}, {p} -> {h}.s between {p}.ls and {p}.le), 161, 160)"
                    out = f"transform({odd}, {h} -> {hit(code, f'{h}.s', f'{h}.e', f'{h}.o', g)})"
                    return f"filter({out}, {w} -> {tx.comparable(w + '.o')} <> {tx.comparable(w + '.g')})"
                return let(rg.likely_headings(t, odd), with_lines)
            return gate(f"size({odd}) > 0", let(rg.uppercase_headings(t, rg.url_ranges(t, low)), with_headings), empty(HIT_TYPE))
        return let(odd, judged)

    return let(f"array_distinct(regexp_extract_all({t}, {lit(some)}, 1))", lambda said: (
        gate(f"size({said}) > 0", let(spans_many(marks(said)), run), empty(HIT_TYPE))))


# -- repeats across the text (R24, R50), Unicode (R46) ---------------------------------

def repeated_hashtags(t: str) -> str:
    z = fresh("z")
    again = repeated(spans(t, r"#[\p{L}\p{N}_]+"), lambda v: f"lower({v}.o)")
    out = f"transform({again}, {z} -> {hit(240, f'{z}.s', f'{z}.e', f'{z}.o', chr(39) * 2)})"
    return gate(f"contains({t}, '#')", out, empty(HIT_TYPE))


def unexplained_acronyms(t: str, lex: Lexicon) -> str:
    import re
    protected = {a for term in lex.protected() for a in re.findall(r"\b[A-Z]{2,5}\b", term)}
    wanted = [a for a in INTERNAL_ACRONYMS if a not in protected]
    if not wanted:
        return empty(HIT_TYPE)
    z = fresh("z")
    pattern = rf"{tx.NOT_AFTER_WORD}{tx.alternation(wanted)}{tx.NOT_BEFORE_WORD}(?!{WS}{{0,2}}\()"
    first = first_only(spans(t, pattern), lambda v: f"{v}.o")
    return f"transform({first}, {z} -> {hit(500, f'{z}.s', f'{z}.e', f'{z}.o', f'{z}.o')})"


COMBINING = r"\p{L}\p{M}+"


def combining_marks(t: str) -> str:
    """Letters written with combining marks where one code point exists."""
    x, w = fresh("x"), fresh("w")
    found = (f"filter(transform({spans(t, COMBINING)}, {x} -> "
             f"{hit(460, f'{x}.s', f'{x}.e', f'{x}.o', tx.nfc_letter(f'{x}.o'))}), {w} -> {w}.o <> {w}.g)")
    return gate(f"{t} rlike {lit(chr(92) + 'p{M}')}", found, empty(HIT_TYPE))


# -- brackets and quotes (R59, R60) ---------------------------------------------------

def _insert_at_end(t: str, code: int, inserted: str) -> str:
    """An insertion before final punctuation, or after the last character."""
    def run(b: str) -> str:
        last, e = f"right({b}, 1)", f"length({b})"
        g = f"if({last} rlike '[.!?,;:]', concat({inserted}, {last}), concat({last}, {inserted}))"
        return one_if(f"{e} > 0 and {inserted} <> ''", hit(code, f"{e} - 1", e, last, g))
    return let(tx.rtrim_ws(t), run)


def brackets(t: str) -> str:
    """A true stack; an unmatched closer is reported and does not pop."""
    pattern = rf"(?md)(^{LWS}*[0-9]{{1,3}}\)(?={WS}))|([()\[\]])"
    x, w = fresh("x"), fresh("w")
    tokens = f"filter({spans(t, pattern, '$1' + wrap('$2'))}, {x} -> {x}.o <> '')"
    opener = lambda c: f"if({c}.o = ')', '(', '[')"

    def run(v: str) -> str:
        folded = scan(
            v, "''", HIT_TYPE,
            lambda st, c: (
                f"case when {c}.o in ('(', '[') then concat({st}, {c}.o) "
                f"when right({st}, 1) = {opener(c)} then substring({st}, 1, length({st}) - 1) else {st} end"),
            lambda st, c: one_if(
                f"{c}.o in (')', ']') and right({st}, 1) <> {opener(c)}",
                hit(590, f"{c}.s", f"{c}.e", f"{c}.o", "''")),
        )
        missing = lambda f: f"translate(reverse({f}.st), '([', ')]')"
        return let(folded, lambda f: f"concat({f}.out, {_insert_at_end(t, 591, missing(f))})")

    return gate(f"{t} rlike '[()\\\\[\\\\]]'", let(tokens, run), empty(HIT_TYPE))


def quotes(t: str) -> str:
    """Odd number of double or single quotes, apostrophes aside."""
    single = r"'(?<!\p{L}')|'(?!\p{L})"
    double_odd = f"regexp_count({t}, '\"') % 2 = 1"
    single_odd = f"regexp_count({t}, {lit(single)}) % 2 = 1"
    return (f"concat(if({double_odd}, {_insert_at_end(t, 600, chr(39) + chr(34) + chr(39))}, {empty(HIT_TYPE)}), "
            f"if({single_odd}, {_insert_at_end(t, 601, chr(34) + chr(39) + chr(34))}, {empty(HIT_TYPE)}))")


# -- date formats within a text (R77) -------------------------------------------------

DATE_TOKEN = r"(?<![0-9])([0-9]{1,2})([./-])([0-9]{1,2})(?:\2([0-9]{4}|[0-9]{2}))?(?![0-9])"


def date_tokens(t: str) -> str:
    """Date tokens as struct(s, e, o, d, m, y, dw, mw, sep, yw, key)."""
    x, y = fresh("x"), fresh("y")
    g = lambda n: field(f"{x}.g", n)
    ok = lambda v: (f"cast({field(v + '.g', 1)} as int) between 1 and 31 "
                    f"and cast({field(v + '.g', 3)} as int) between 1 and 12")
    key = f"concat(length({g(1)}), {g(2)}, length({g(3)}), length({g(4)}))"
    return gate(
        f"{t} rlike '[0-9][./-][0-9]'",
        f"transform(filter({spans(t, DATE_TOKEN, wrap('$0', fields('$1', '$2', '$3', '$4')))}, {y} -> {ok(y)}), "
        f"{x} -> named_struct('s', {x}.s, 'e', {x}.e, 'o', {x}.o, 'd', cast({g(1)} as int), "
        f"'m', cast({g(3)} as int), 'y', {g(4)}, 'key', {key}))",
        empty(DATE_TYPE))


DATE_TYPE = "struct<s:int,e:int,o:string,d:int,m:int,y:string,key:string>"


def reformat_date(tok: str, key: str) -> str:
    """Write a date token in the format of ``key`` (day width, separator,
    month width, year width)."""
    day = f"if(substring({key}, 1, 1) = '2', lpad({tok}.d, 2, '0'), cast({tok}.d as string))"
    month = f"if(substring({key}, 3, 1) = '2', lpad({tok}.m, 2, '0'), cast({tok}.m as string))"
    sep, yw = f"substring({key}, 2, 1)", f"right({key}, 1)"
    year = (f"case when {yw} = '2' and length({tok}.y) = 4 then right({tok}.y, 2) "
            f"when {yw} = '4' and length({tok}.y) = 2 then concat('20', {tok}.y) else {tok}.y end")
    return f"concat({day}, {sep}, {month}, if({tok}.y = '', '', concat({sep}, {year})))"


def date_formats(t: str) -> str:
    """The most frequent format (earliest on a tie) is the standard."""
    def run(v: str) -> str:
        x, h = fresh("x"), fresh("h")
        return let(_majority(f"transform({v}, {x} -> {x}.key)"), lambda best: (
            f"transform(filter({v}, {x} -> {x}.key <> {best}), "
            f"{h} -> {hit(770, f'{h}.s', f'{h}.e', f'{h}.o', reformat_date(h, best))})"))
    return let(date_tokens(t), run)
