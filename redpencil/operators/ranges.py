"""Ranges that rules must respect: links, protected terms, headings."""

from __future__ import annotations

from redpencil.functions import text as tx
from redpencil.functions.exprs import (
    RANGE_TYPE, SEP, any_overlap, empty, fresh, gate, let, line_array, lit, merge_ranges, spans, wrap,
)

# What counts as a bare link.
TLDS = "com|net|org|io|vn|app|dev|ai|co|me|edu|gov|info|biz|xyz|site|online|cloud|gg|ly"
_TAIL = r"""[^\t\n\x0B\f\r \x{A0}\x{2028}\x{2029}\x{3000}<>"'`]"""
URL_PATTERN = (
    rf"(?iu)https?://{_TAIL}+|www\.{_TAIL}+"
    # a domain starts with a label and its dot; that is seen before the label is tried at all its lengths
    rf"|(?-iu:(?<![A-Za-z0-9])(?=[A-Za-z0-9\x{{130}}-\x{{212A}}-]++\.))(?<![@\p{{L}}\p{{N}}_-])(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+(?:{TLDS})(?:/{_TAIL}*)?"
)
HEADING_MAX_WORDS = 32
HEADING_MAX_CHARS = 180


def url_ranges(text: str, low: str) -> str:
    """Link ranges without trailing punctuation, merged."""
    x, y = fresh("x"), fresh("y")
    end = f"{x}.s + length(regexp_replace({x}.o, '[),.!?;:]+$', ''))"
    found = (
        f"filter(transform({spans(text, URL_PATTERN)}, "
        f"{x} -> named_struct('s', {x}.s, 'e', {end})), {y} -> {y}.e > {y}.s)"
    )
    some = f"({tx.contains_any(low, ['://', 'www.'])} or {low} rlike {lit(rf'[.](?:{TLDS})')})"
    return gate(some, merge_ranges(found), empty(RANGE_TYPE))


def term_ranges(low: str, terms: list[str]) -> str:
    """Merged ranges of whole-word, case-insensitive term occurrences.

    A zero-width match per start reports the longest term there; the union is
    the same as scanning once per term.
    """
    terms = sorted({t.lower() for t in terms})
    if not terms:
        return empty(RANGE_TYPE)
    pattern = rf"(?={tx.first_chars(terms)}){tx.NOT_AFTER_WORD}(?=({tx.trie(terms)}){tx.NOT_BEFORE_WORD})"
    x = fresh("x")
    found = (
        f"transform({spans(low, pattern, wrap('$1'), zero_width=True)}, "
        f"{x} -> named_struct('s', {x}.s, 'e', {x}.e))"
    )
    return merge_ranges(found)


def mask(t: str, start: str, ranges: str) -> str:
    """Blot the parts of line ``t`` (at offset ``start``) covered by ``ranges``."""
    r, acc, q = fresh("r"), fresh("m"), fresh("r")
    lo = f"greatest({q}.s - {start}, 0)"
    n = f"(least({q}.e - {start}, length({t})) - {lo})"
    return (
        f"aggregate(filter({ranges}, {r} -> {r}.s < {start} + length({t}) and {start} < {r}.e), {t}, "
        f"({acc}, {q}) -> overlay({acc} placing repeat('{SEP}', {n}) from {lo} + 1 for {n}))"
    )


def _line_facts(lines: str) -> str:
    """Lines with offsets as struct(ls, le, s, t): raw extent, trimmed start, trimmed text."""
    x = fresh("x")
    lead = f"(length({x}.t) - length({tx.ltrim_ws(f'{x}.t')}))"
    return (
        f"transform({lines}, {x} -> named_struct('ls', {x}.s, 'le', {x}.s + length({x}.t), "
        f"'s', {x}.s + {lead}, 't', {tx.trim_ws(f'{x}.t')}))"
    )


def _is_likely(x: str, first: str) -> str:
    letters = tx.letter_count(f"{x}.t")
    lower = f"regexp_count({x}.t, {lit(chr(92) + 'p{Ll}')})"
    return (
        f"({x}.t <> '' and length({x}.t) <= {HEADING_MAX_CHARS} and not {x}.t rlike '[:;]' "
        f"and {tx.word_count(f'{x}.t')} between 1 and {HEADING_MAX_WORDS} "
        f"and ({x}.t = {first} or ({letters} >= 4 and {letters} - {lower} >= 0.65 * {letters})))"
    )


def _first_line(text: str) -> str:
    """The first line that is not blank, trimmed."""
    return tx.trim_ws(f"regexp_extract({text}, {lit(rf'^{tx.WS}*([^{chr(92)}n]*)')}, 1)")


def likely_headings(text: str, hits: str | None = None) -> str:
    """Heading-like lines; with ``hits`` only those where a hit starts."""
    def run(lines: str) -> str:
        x = fresh("x")
        return let(_first_line(text), lambda f: f"filter({lines}, {x} -> {_is_likely(x, f)})")

    def of(lines: str) -> str:
        x, h = fresh("x"), fresh("h")
        return f"filter({lines}, {x} -> exists({hits}, {h} -> {h}.s between {x}.s and {x}.s + length({x}.t)))"
    return let(_line_facts(of(line_array(text)) if hits else line_array(text)), run)


# A line of at most 180 characters between its margins, without colon or
# semicolon, holding four capitals: only such lines are looked at closely.
_CANDIDATE_LINE = (
    rf"(?md)^(?=(?:[^\n\p{{Lu}}]*+\p{{Lu}}){{4}}){tx.LINE_WS}*+[^\n:;]{{4,{HEADING_MAX_CHARS}}}{tx.LINE_WS}*$"
)


def uppercase_headings(text: str, excluded: str) -> str:
    """Heading lines written in capitals, judged outside ``excluded`` ranges.

    Yields struct(ls, le, s, t) per line.
    """
    upper_run = r"^((?:[^\p{L}\p{N}]*+(?:(?!\p{Ll})[\p{L}\p{N}])++(?![\p{L}\p{N}]))*+)"
    has_upper = r"[\p{L}\p{N}]*\p{Lu}[\p{L}\p{N}]*"
    x, y = fresh("x"), fresh("y")
    lead = f"(length({x}.o) - length({tx.ltrim_ws(f'{x}.o')}))"
    lines = (
        f"transform({spans(text, _CANDIDATE_LINE)}, {x} -> named_struct('ls', {x}.s, 'le', {x}.e, "
        f"'s', {x}.s + {lead}, 't', {tx.trim_ws(f'{x}.o')}))"
    )
    def judged(v: str, ranges: str) -> str:
        def stats(m: str) -> str:
            up = f"regexp_count({m}, {lit(chr(92) + 'p{Lu}')})"
            low = f"regexp_count({m}, {lit(chr(92) + 'p{Ll}')})"
            leading = f"regexp_count(regexp_extract({v}.t, {lit(upper_run)}, 1), {lit(has_upper)})"
            return (
                f"({up} >= 4 and ({up} >= 0.65 * ({up} + {low}) "
                f"or ({leading} >= 3 and {up} >= 0.55 * ({up} + {low}))))"
            )
        return let(mask(f"{v}.t", f"{v}.s", ranges), stats)

    def run(found: str, ranges: str) -> str:
        return let(_first_line(text), lambda f: f"filter({found}, {y} -> {_is_likely(y, f)} and {judged(y, ranges)})")

    return let(lines, lambda v: f"if(size({v}) = 0, {v}, {let(excluded, lambda x: run(v, x))})")


def in_heading(h: str, headings: str) -> str:
    x = fresh("x")
    return f"exists({headings}, {x} -> {h}.s >= {x}.ls and {h}.e <= {x}.le)"


__all__ = ["url_ranges", "term_ranges", "likely_headings", "uppercase_headings", "in_heading", "mask",
           "URL_PATTERN", "any_overlap"]
