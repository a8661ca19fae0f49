"""The rule book: what each rule reports, independent of how it is found.

A hit carries a code = rule number * 10 + variant; everything constant per
code lives here and is looked up only for hits that survive resolution.
"""

from __future__ import annotations

from dataclasses import dataclass

from redpencil.functions.exprs import lit


@dataclass(frozen=True)
class Finding:
    type: str
    severity: str
    confidence: float
    definite: bool
    reason: str
    link_cleanup: bool = False  # may touch link text


def _f(type_, severity, confidence, definite, reason, link=False):
    return Finding(type_, severity, confidence, definite == "y", reason, link)


FINDINGS: dict[int, Finding] = {
    10: _f("spacing", "low", .98, "y", "Caption starts with blanks."),
    20: _f("spacing", "low", .98, "y", "Caption ends with blanks."),
    30: _f("spacing", "low", .96, "y", "Too many blank lines in a row."),
    40: _f("spacing", "low", .97, "y", "Line starts with blanks."),
    50: _f("spacing", "low", .97, "y", "Line ends with blanks."),
    60: _f("style", "low", .90, "y", "Separator line left over from pasting."),
    70: _f("grammar", "medium", .90, "y", "Line is repeated."),
    **{80 + i: _f("grammar", "medium", .88, "y", "Phrase is repeated.") for i in range(4)},
    90: _f("spacing", "low", .92, "y", "Put a blank after the emoji bullet."),
    100: _f("spacing", "low", .95, "y", "Put a blank after the bullet."),
    110: _f("spacing", "low", .95, "y", "Put a blank after the list number."),
    120: _f("style", "low", .78, "n", "List numbers are written in different ways."),
    130: _f("style", "low", .78, "n", "List uses different bullets."),
    140: _f("style", "medium", .90, "n", "Word should be upper case like the rest of the heading."),
    150: _f("style", "medium", .90, "n", "Phrase should be upper case like the rest of the heading."),
    160: _f("style", "low", .82, "n", "Term is written in different ways in this text."),
    161: _f("style", "medium", .88, "n", "Heading writes a term differently from the text."),
    170: _f("punctuation", "medium", .98, "y", "No blank before the colon of a label."),
    180: _f("punctuation", "high", .94, "y", "Use a colon after a label."),
    181: _f("punctuation", "high", .86, "n", "A colon after a label may be misread as a bar."),
    190: _f("punctuation", "medium", .84, "n", "Label lacks its colon."),
    200: _f("style", "medium", .93, "y", "Markdown link shows in the text.", True),
    210: _f("style", "low", .93, "y", "Markdown emphasis shows in the text.", True),
    220: _f("style", "low", .90, "y", "Markdown back-ticks show in the text.", True),
    230: _f("style", "low", .94, "y", "HTML entity shows in the text."),
    240: _f("hashtag", "low", .90, "y", "Hashtag is repeated."),
    250: _f("hashtag", "medium", .90, "y", "Hashtags take letters, digits and underscores only."),
    260: _f("hashtag", "high", .97, "y", "Hashtag uses a former company name."),
    270: _f("spacing", "medium", .92, "y", "Put a blank before the hashtag."),
    280: _f("spacing", "medium", .94, "y", "No blank after @ in a mention."),
    290: _f("spacing", "medium", .86, "n", "Mentions contain no blanks."),
    300: _f("spacing", "high", .96, "y", "E-mail address is split before @."),
    310: _f("spacing", "high", .96, "y", "E-mail address is split after @."),
    320: _f("spacing", "high", .96, "y", "Link is split after its scheme.", True),
    330: _f("ambiguity", "needs_review", .72, "n", "Link ends with punctuation.", True),
    340: _f("brand_term", "high", .97, "y", "Former company name."),
    350: _f("style", "medium", .93, "y", "Write the country name in full."),
    351: _f("style", "medium", .90, "y", "Write the city name in the usual form."),
    360: _f("spacing", "low", .96, "y", "No blank between number and percent sign."),
    370: _f("spacing", "low", .86, "n", "Write the currency unit next to the number."),
    380: _f("style", "low", .86, "n", "Write data units as number, blank, capitals."),
    390: _f("style", "low", .88, "n", "Separate thousands with dots."),
    400: _f("spacing", "low", .90, "y", "Put blanks around the dash of a time range."),
    410: _f("ambiguity", "needs_review", .90, "n", "Date does not exist."),
    420: _f("ambiguity", "needs_review", .90, "n", "Time does not exist."),
    430: _f("ambiguity", "needs_review", .88, "n", "Weekday does not match the date."),
    440: _f("ambiguity", "needs_review", .70, "n", "Relative date may be read on another day."),
    450: _f("ambiguity", "needs_review", .78, "n", "Phone number has an unusual length."),
    460: _f("spelling", "low", .98, "y", "Letter is written with combining marks."),
    470: _f("style", "low", .86, "n", "Write the term in two words."),
    480: _f("style", "low", .86, "n", "Put a blank between Top and the number."),
    490: _f("ocr_low_confidence", "needs_review", .74, "n", "An icon may be misread as a letter."),
    500: _f("ambiguity", "needs_review", .68, "n", "Explain the acronym where it first occurs."),
    510: _f("spacing", "medium", .99, "y", "More than one blank."),
    520: _f("punctuation", "medium", .98, "y", "No blank before punctuation."),
    530: _f("spacing", "medium", .94, "y", "Put a blank after punctuation."),
    540: _f("spacing", "low", .88, "y", "Put a blank before the emoji."),
    550: _f("punctuation", "low", .96, "y", "Write the ellipsis without blanks."),
    560: _f("punctuation", "low", .96, "y", "An ellipsis has three dots."),
    570: _f("punctuation", "medium", .94, "y", "Punctuation is repeated."),
    580: _f("spacing", "low", .95, "y", "No blanks just inside brackets."),
    590: _f("punctuation", "high", .92, "y", "Closing bracket was never opened."),
    591: _f("punctuation", "high", .90, "y", "Opening bracket is never closed."),
    600: _f("punctuation", "high", .88, "y", "Double quote is never closed."),
    601: _f("punctuation", "medium", .78, "n", "Single quote is never closed."),
    610: _f("spacing", "medium", .94, "y", "Parts of a known name run together."),
    620: _f("spacing", "medium", .90, "y", "Put a blank after the acronym."),
    630: _f("hashtag", "high", .99, "y", "No blank after # in a hashtag."),
    640: _f("spacing", "high", .92, "y", "Blank around the hyphen of a known name."),
    650: _f("spelling", "high", .96, "y", "Misspelled word."),
    651: _f("brand_term", "high", .96, "y", "Misspelled brand or campaign name."),
    660: _f("brand_term", "high", .96, "y", "Misspelled product name."),
    670: _f("spelling", "medium", .90, "y", "Thiếu dấu tiếng Việt (tone marks are missing)."),
    680: _f("spelling", "medium", .93, "y", "Sai dấu tiếng Việt (wrong tone mark)."),
    690: _f("style", "medium", .82, "n", "Wording does not fit the house style."),
    700: _f("style", "high", .78, "n", "Risky wording."),
    701: _f("style", "medium", .78, "n", "Risky wording."),
    702: _f("style", "low", .78, "n", "Risky wording."),
    710: _f("grammar", "medium", .90, "y", "Word is repeated."),
    720: _f("brand_term", "high", .95, "y", "Brand name is written in one word."),
    730: _f("grammar", "low", .88, "y", "Caption starts with a lower-case letter."),
    740: _f("style", "medium", .82, "n", "Wording does not fit the house style."),
    750: _f("style", "medium", .93, "y", "Write dates as DD/MM/YYYY."),
    **{760 + i: _f("style", "medium", .93, "y", "Write times as HH:mm.") for i in range(5)},
    770: _f("style", "medium", .90, "n", "Date formats differ within this text."),
    780: _f("punctuation", "high", .95, "y", "Use a colon and a blank after a label."),
    781: _f("punctuation", "high", .94, "y", "Use a colon after a label, not a semicolon."),
    790: _f("punctuation", "medium", .94, "y", "Caption ends with a comma."),
    791: _f("punctuation", "suggestion", .72, "n", "Caption lacks a final punctuation mark."),
}

DICTIONARY_RULES = (65, 66, 67, 68, 69, 70, 74)  # suppressed inside earlier hits
RISKY_RULE = 70                                   # bypasses the guards
FIRST_STRICT_RULE = 51                            # from here on, review-only hits are dropped


def _array(values) -> str:
    return "array(" + ", ".join(values) + ")"


_codes = sorted(FINDINGS)
_INDEX = {c: i for i, c in enumerate(_codes)}


def _slot(code: str) -> str:
    return f"array_position({_array(str(c) for c in _codes)}, {code})"


def lookup(code: str, attribute: str) -> str:
    """Constant attribute of a finding code, as an array access."""
    def sql(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float):
            return f"{v}D"
        return lit(v)
    values = [sql(getattr(FINDINGS[c], attribute)) for c in _codes]
    return f"element_at({_array(values)}, cast({_slot(code)} as int))"


def definite(code: str) -> str:
    yes = [str(c) for c in _codes if FINDINGS[c].definite]
    return f"array_contains({_array(yes)}, {code})"


def link_cleanup(code: str) -> str:
    return f"{code} in ({', '.join(str(c) for c in _codes if FINDINGS[c].link_cleanup)})"


def codes_of(rule: int) -> list[int]:
    return [c for c in _codes if c // 10 == rule]
