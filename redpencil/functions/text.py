"""Text predicates and normalisers as Catalyst expressions.

Functions take and return Spark SQL expression strings; ``F.expr`` turns them
into columns.  White space follows the wider Unicode definition used by the
checked texts (NBSP and friends), which Java's ``\\s`` does not include.
"""

from __future__ import annotations

import unicodedata
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpencil.functions.exprs import CLOSE, MID, OPEN, SEP, fresh, let, lit

# Inside of a character class. Java asks the parts of a class one by one, so the rare blanks stand behind one range.
WS_CHARS = (r"\t\n\x0B\f\r \x{00A0}"
            r"[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]")
WS = f"[{WS_CHARS}]"
NOT_WS = f"[^{WS_CHARS}]"
LINE_WS = WS.replace(r"\n", "")
WORD = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"

# Code points with the Extended_Pictographic property.
PICTOGRAPHIC = (
    r"[\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}\x{231A}\x{231B}"
    r"\x{2328}\x{2388}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}\x{25AA}\x{25AB}\x{25B6}\x{25C0}"
    r"\x{25FB}-\x{25FE}\x{2600}-\x{2605}\x{2607}-\x{2612}\x{2614}-\x{2685}\x{2690}-\x{2705}"
    r"\x{2708}-\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}\x{2728}\x{2733}\x{2734}\x{2744}\x{2747}\x{274C}"
    r"\x{274E}\x{2753}-\x{2755}\x{2757}\x{2763}-\x{2767}\x{2795}-\x{2797}\x{27A1}\x{27B0}\x{27BF}"
    r"\x{2934}\x{2935}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}"
    r"\x{1F000}-\x{1F0FF}\x{1F10D}-\x{1F10F}\x{1F12F}\x{1F16C}-\x{1F171}\x{1F17E}\x{1F17F}\x{1F18E}"
    r"\x{1F191}-\x{1F19A}\x{1F1AD}-\x{1F1E5}\x{1F201}-\x{1F20F}\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}"
    r"\x{1F23C}-\x{1F23F}\x{1F249}-\x{1F3FA}\x{1F400}-\x{1F53D}\x{1F546}-\x{1F64F}\x{1F680}-\x{1F6FF}"
    r"\x{1F774}-\x{1F77F}\x{1F7D5}-\x{1F7FF}\x{1F80C}-\x{1F80F}\x{1F848}-\x{1F84F}\x{1F85A}-\x{1F85F}"
    r"\x{1F888}-\x{1F88F}\x{1F8AE}-\x{1F8FF}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1FAFF}"
    r"\x{1FC00}-\x{1FFFD}]"
)

# Words that make a line prefix look like a field label.
LABEL_HINTS = [
    "đối tượng", "hình thức", "thời gian", "địa điểm", "nội dung", "chủ đề", "mục tiêu", "quyền lợi",
    "giải thưởng", "cách thức", "thể lệ", "điều kiện", "lưu ý", "tham gia", "deadline", "hạn chót",
    "timeline", "agenda", "link", "form", "đăng ký", "yêu cầu", "kết quả", "số lượng",
]
# Full field labels.
LABEL_PREFIXES = [
    "đối tượng tham gia", "hình thức tham gia", "thời gian đăng ký", "thời gian tham gia", "thời gian",
    "địa điểm", "nội dung", "chủ đề", "mục tiêu", "quyền lợi", "giải thưởng", "cách thức", "thể lệ",
    "điều kiện", "lưu ý", "deadline", "hạn chót", "timeline", "agenda", "link đăng ký", "link",
    "form đăng ký", "form", "yêu cầu", "kết quả", "số lượng",
]
# Words that open a field value; brand names come from the lexicon.
VALUE_WORDS = ["online", "offline", "hybrid", "cá nhân", "nhóm", "tất cả", "facebook", "linkedin",
               "google", "internal", "external"]


def strip_reserved(text: str) -> str:
    """Replace the engine's sentinels on ingest; keeps every offset."""
    return f"translate({text}, '{OPEN}{MID}{CLOSE}{SEP}', repeat('\\uFFFD', 4))"


def escape(phrase: str) -> str:
    """Regex-escape a literal phrase (Java and RE2 compatible)."""
    return "".join("\\" + c if c in r".*+?^${}()|[]\-/" else c for c in phrase)


def alternation(phrases) -> str:
    """Longest-first alternation of literal phrases."""
    ordered = sorted(set(phrases), key=lambda p: (-len(p), p))
    return "(?:" + "|".join(escape(p) for p in ordered) + ")"


def trie(phrases) -> str:
    """Alternation of literal phrases folded into a prefix tree, longest first.

    Java tries the branches of a flat alternation one by one at every position;
    a tree fails after a character or two however many phrases there are.
    """
    root: dict = {}
    for phrase in phrases:
        node = root
        for c in phrase:
            node = node.setdefault(c, {})
        node[""] = {}

    def render(node: dict) -> str:
        branches = [escape(c) + render(child) for c, child in sorted(node.items()) if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return body + "?" if "" in node else body

    return render(root)


def first_chars(phrases) -> str:
    return "[" + "".join(escape(c) for c in sorted({p[0] for p in phrases})) + "]"


def folded(text: str) -> str:
    """Lower-cased text with unchanged offsets (the dotted capital I is the one
    letter whose lower case is longer)."""
    return f"lower(translate({text}, '\u0130', '\u0131'))"


# Cheap superset of PICTOGRAPHIC, to skip texts without any.
MAYBE_PICTOGRAPHIC = r"[\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F000}-\x{1FFFD}]"


def contains_any(text: str, needles) -> str:
    return "(" + " or ".join(f"contains({text}, {lit(n)})" for n in needles) + ")"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^{WS}+|{WS}+$')}, '')"


def ltrim_ws(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^{WS}+')}, '')"


def rtrim_ws(x: str) -> str:
    return rf"regexp_replace({x}, {lit(WS + '+' + chr(92) + 'z')}, '')"


def collapse_ws(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'{WS}+')}, ' ')"


def comparable(x: str) -> str:
    """Collapse, trim, lower: what relates issues to each other."""
    return f"lower(trim({collapse_ws(x)}))"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in normaliser."""
    return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def compatible(name: str) -> Column:
    """Compatibility composition, then collapse, trim, lower.  Plain ASCII passes the normaliser untouched."""
    x = nfkc(F.col(name))
    return F.lower(F.trim(F.regexp_replace(x, f"{WS}+", " ")))


def _composition_tables() -> tuple[str, str, str]:
    """Canonical pairs, letter decompositions and combining classes, as
    lookup strings built from the Unicode database."""
    pairs, letters, classes = [], [], []
    for cp in range(0xC0, 0x30000):
        c = chr(cp)
        if unicodedata.combining(c):
            classes.append(f"{c}{MID}{unicodedata.combining(c):03d}")
        d = unicodedata.decomposition(c)
        if not d or d.startswith("<") or " " not in d or unicodedata.normalize("NFC", c) != c:
            continue
        base, mark = (chr(int(h, 16)) for h in d.split())
        if unicodedata.combining(mark) and not unicodedata.combining(base):
            pairs.append(f"{base}{mark}{MID}{c}")
            letters.append(f"{c}{MID}{unicodedata.normalize('NFD', c)}")
    return tuple(SEP + SEP.join(t) + SEP for t in (pairs, letters, classes))


_PAIRS, _LETTERS, _CLASSES = _composition_tables()


def _find(table: str, key: str) -> str:
    return (f"substring_index(substring_index({lit(table)}, concat('{SEP}', {key}, '{MID}'), -1), '{SEP}', 1)")


def _known(table: str, key: str) -> str:
    return f"contains({lit(table)}, concat('{SEP}', {key}, '{MID}'))"


def nfc_letter(o: str) -> str:
    """Canonical composition of one letter followed by combining marks.

    Marks are put in canonical order, then taken up one by one unless a mark of
    the same class stands in between.  Runs on matched fragments only.
    """
    m, i, w, a, x = (fresh(n) for n in "miwax")
    base = f"substring({o}, 1, 1)"
    spelled = f"concat(if({_known(_LETTERS, base)}, {_find(_LETTERS, base)}, {base}), substring({o}, 2))"

    def run(s: str) -> str:
        cls = f"if({_known(_CLASSES, m)}, {_find(_CLASSES, m)}, '000')"
        marks = (f"transform(array_sort(transform(filter(split(substring({s}, 2), ''), {m} -> {m} <> ''), "
                 f"({m}, {i}) -> named_struct('c', {cls}, 'i', {i}, 'm', {m}))), {w} -> {w})")
        pair = f"concat({a}.b, {x}.m)"
        free = f"({a}.l = '' or {a}.l < {x}.c)"
        step = (f"if({free} and {_known(_PAIRS, pair)}, "
                f"named_struct('b', {_find(_PAIRS, pair)}, 'r', {a}.r, 'l', {a}.l), "
                f"named_struct('b', {a}.b, 'r', concat({a}.r, {x}.m), 'l', {x}.c))")
        return (f"aggregate({marks}, named_struct('b', substring({s}, 1, 1), 'r', '', 'l', ''), "
                f"({a}, {x}) -> {step}, {a} -> concat({a}.b, {a}.r))")

    return let(spelled, run)


def compact_key(x: str) -> str:
    """Letters and digits only."""
    return rf"regexp_replace(lower({x}), {lit('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+')}, '')"


def digit_signature(x: str) -> str:
    """P3."""
    return f"array_join(regexp_extract_all({x}, {lit('[0-9]+')}, 0), '|')"


def word_count(x: str) -> str:
    """P4."""
    return f"regexp_count({x}, {lit('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+')})"


def letter_count(x: str) -> str:
    return f"regexp_count({x}, {lit(chr(92) + 'p{L}')})"


def alnum_count(x: str) -> str:
    return f"regexp_count({x}, {lit('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')})"


def context_before(text: str, start: str, width: int = 12) -> str:
    """P5."""
    return f"substring({text}, greatest({start} - {width}, 0) + 1, least({start}, {width}))"


def context_after(text: str, end: str, width: int = 12) -> str:
    return f"substring({text}, {end} + 1, {width})"


def is_label(x: str) -> str:
    """1-7 words, at most 64 characters, no sentence end, holds a hint."""

    def run(c: str) -> str:
        hints = alternation(LABEL_HINTS)
        return (
            f"({c} <> '' and {word_count(c)} between 1 and 7 and length({c}) <= 64 "
            f"and not {c} rlike {lit('[.!?]')} and {c} rlike {lit(hints)})"
        )

    cleaned = comparable(f"regexp_replace({x}, {lit(r'^[^\p{L}\p{N}]+')}, '')")
    return let(cleaned, run)


def value_pattern(extra_words=()) -> str:
    """P9 as a pattern to be matched at the start of a trimmed value."""
    words = alternation([*VALUE_WORDS, *(w.lower() for w in extra_words)])
    return (
        r"(?:(?i:[0-9]|https?://|www\.|@|#)"
        rf"|(?iu:{words})(?![A-Za-z0-9_])"
        rf"|(?-i:[\p{{Lu}}]|{PICTOGRAPHIC}))"
    )


def is_value(x: str, extra_words=()) -> str:
    return f"({trim_ws(x)} rlike {lit('^' + value_pattern(extra_words))})"


URLISH = r"(?iu)https?://|www\.|[\p{L}\p{N}_-]+\.[a-z]{2,}"


def urlish_around(text: str, start: str, end: str, width: int) -> str:
    """P10: does the neighbourhood look like a link?"""
    return (
        f"(substring({text}, greatest({start} - {width}, 0) + 1, "
        f"{end} + {width} - greatest({start} - {width}, 0)) rlike {lit(URLISH)})"
    )


# letters that full upper-casing would turn into several, and the one that stands for each; most have none
_WIDE = [c for c in map(chr, range(0xDF, 0xFB18)) if len(c.upper()) > 1]
_WIDE_UPPER = [{"ß": "ẞ"}.get(c, c.title() if len(c.title()) == 1 else c) for c in _WIDE]


def upper_letter(c: str) -> str:
    """One letter in upper case, as one letter."""
    wide = "".join(_WIDE)
    return f"if(instr('{wide}', {c}) > 0, translate({c}, '{wide}', '{''.join(_WIDE_UPPER)}'), upper({c}))"


def capitalise_first_letter(s: str) -> str:
    first = f"regexp_extract({s}, {lit(r'^([^\p{L}]*)(\p{L})', )}, 1)"
    return (
        f"if({s} rlike {lit(r'\p{L}')}, concat({first}, "
        f"upper(substring({s}, length({first}) + 1, 1)), substring({s}, length({first}) + 2)), {s})"
    )


def preserve_case(original: str, suggestion: str) -> str:
    """Carry an all-caps or capitalised shape over to the suggestion."""
    letter = f"regexp_extract({original}, {lit(r'\p{L}')}, 0)"
    return (
        f"case when {letter} = '' then {suggestion} "
        f"when {original} = upper({original}) then upper({suggestion}) "
        f"when {letter} = upper({letter}) then {capitalise_first_letter(suggestion)} "
        f"else {suggestion} end"
    )


# Values whose casing is fixed: inner capitals, acronyms or a dot.
FIXED_CASE = r"[A-Z][a-zà-ỹ]+[A-Z]|[A-Z]{2,}|\."


def case_only(a: str, b: str) -> str:
    """P13 (also true for equal strings, as the guards need)."""
    return f"(lower({a}) = lower({b}))"


def case_only_change(a: str, b: str) -> str:
    return f"({a} <> {b} and lower({a}) = lower({b}))"


# Accepted issue types and severities for external candidates.
IMAGE_TYPES = ["spelling", "spacing", "punctuation", "hashtag", "brand_term", "terminology", "grammar",
               "style", "ambiguity", "ocr_low_confidence"]
SEVERITIES = ["critical", "high", "medium", "low", "suggestion", "needs_review"]


def in_list(x: str, values) -> str:
    return f"{x} in ({', '.join(lit(v) for v in values)})"


def candidate_type(x: str) -> str:
    """P14."""
    return (
        f"case when {x} = 'brand_consistency' then 'brand_term' "
        f"when {in_list(x, IMAGE_TYPES)} then {x} else 'spelling' end"
    )


def candidate_severity(x: str) -> str:
    return f"case when {in_list(x, SEVERITIES)} then {x} else 'needs_review' end"


def severity_rank(x: str) -> str:
    whens = " ".join(f"when '{v}' then {i}" for i, v in enumerate(SEVERITIES))
    return f"case {x} {whens} end"


def self_check_passes(check: str, severity: str, definite: str) -> str:
    """A candidate's own checks; OCR doubt is tolerated for soft findings."""
    no = lambda f: f"coalesce({check}.{f}, true) = false"
    return (
        f"case when {check} is null then true "
        f"when {no('exact_substring')} or {no('visible_or_in_ocr')} or {no('not_protected_term')} then false "
        f"when {no('not_ocr_uncertainty')} then "
        f"({candidate_severity(severity)} = 'needs_review' or coalesce({definite}, true) = false) "
        f"else true end"
    )


def needs_manual_check(severity: str, status: str, type_: str) -> str:
    """P17."""
    return (
        f"({severity} = 'needs_review' or {status} = 'needs_human_review' "
        f"or {type_} = 'ocr_low_confidence')"
    )


def display_reason(x: str) -> str:
    """Plain-language wording of machine reasons from OCR reviewers."""
    steps = [
        (r"(?i)Incorrect OCR of brand terms ([^.]+)\.", "Brand name may be misread: $1."),
        (r"(?i)Incorrect OCR of ([^.]+)\.", "Text may be misread: $1."),
        (r"(?i)Incorrect OCR of ([^.;]+)", "Text may be misread: $1"),
        (r"(?i)\bOCR confidence\b", "reading confidence"),
        (r"(?i)\bOCR text\b", "text read from the image"),
        (r"(?i)\bOCR\b", "image text reading"),
    ]
    out = x
    for pattern, replacement in steps:
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(replacement)})"
    return out


def similarity(a: str, b: str) -> str:
    """1 - distance / longer length, on comparable texts."""
    return (
        f"if({a} = '' and {b} = '', 1D, "
        f"1D - levenshtein({a}, {b}) / cast(greatest(length({a}), length({b}), 1) as double))"
    )


def project_name_filter(name: str, needle: str) -> str:
    """P20."""
    return f"contains(lower({name}), lower(trim({needle})))"


__all__ = [n for n in dir() if not n.startswith("_") and n not in {"annotations", "fresh"}]
