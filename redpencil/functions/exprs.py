"""Catalyst expression kernel: building blocks that stay inside one row.

Every helper returns a Spark SQL expression *string*.  Rules are compositions
of these strings, so the whole checker is a narrow projection: no shuffle, no
Python, no re-read of the text per rule.

Spans are found by letting ``regexp_replace`` wrap every match in Unicode
non-characters (never valid in interchanged text), splitting on the first one
and running a prefix sum over the pieces.  All offsets are code points.
"""

from __future__ import annotations

import itertools

# Sentinels: open, end-of-original, end-of-suggestion, field separator.
OPEN, MID, CLOSE, SEP = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"

HIT_TYPE = "struct<r:int,k:int,s:int,e:int,o:string,g:string>"
RANGE_TYPE = "struct<s:int,e:int>"
LINE_TYPE = "struct<s:int,t:string>"

_names = itertools.count()


def fresh(prefix: str = "v") -> str:
    """A lambda variable name that cannot clash with an outer one."""
    return f"{prefix}{next(_names)}"


def lit(value: str) -> str:
    """SQL string literal without escape processing."""
    if "'" not in value:
        return f"r'{value}'"
    if '"' not in value:
        return f'r"{value}"'
    parts = value.split("'")
    return "concat(" + ", \"'\", ".join(f"r'{p}'" for p in parts) + ")"


def let(value: str, body) -> str:
    """Evaluate ``value`` once and use it many times in ``body(name)``.

    Column pruning and project collapsing may inline an alias into a lambda,
    where it would be evaluated per element; a bound lambda variable cannot be.
    ``value`` is the start of a fold over nothing and ``body`` its end: ``transform``
    would copy what the body gives, with all strings in it, at every binding.
    """
    v, x = fresh("b"), fresh("x")
    return f"aggregate(cast(array() as array<int>), {value}, ({v}, {x}) -> {v}, {v} -> {body(v)})"


def empty(element_type: str) -> str:
    return f"cast(array() as array<{element_type}>)"


def scan(arr: str, init: str, element_type: str, state, emits) -> str:
    """Left fold that also emits rows: ``struct(st, out)``.

    ``state(st, x)`` gives the next state, ``emits(st, x)`` an array of emitted
    elements.  ``aggregate`` copies its accumulator at every element, so the fold runs in blocks
    of the root of the size: an element costs some sqrt(n) copies, not n / 2.
    """
    o, b, a, x = fresh("o"), fresh("k"), fresh("a"), fresh("x")

    def run(v: str) -> str:
        return let(f"cast(greatest(ceil(sqrt(size({v}))), 1) as int)", lambda block: blocks(v, block))

    def blocks(v: str, block: str) -> str:
        inner = (
            f"aggregate(slice({v}, {b} * {block} + 1, {block}), "
            f"named_struct('st', {o}.st, 'out', {empty(element_type)}), "
            f"({a}, {x}) -> named_struct('st', {state(f'{a}.st', x)}, "
            f"'out', concat({a}.out, {emits(f'{a}.st', x)})))"
        )
        step = let(
            inner,
            lambda i: f"named_struct('st', {i}.st, 'out', concat({o}.out, array({i}.out)))",
        )
        folded = (
            f"aggregate(sequence(0, cast(greatest(size({v}) - 1, 0) div {block} as int)), "
            f"named_struct('st', {init}, 'out', cast(array() as array<array<{element_type}>>)), "
            f"({o}, {b}) -> {step})"
        )
        return let(folded, lambda f: f"named_struct('st', {f}.st, 'out', flatten({f}.out))")

    return let(arr, run)


def running(parts: str, zero: str, step, block: int = 512) -> str:
    """``array<int>`` of the state that a left fold over ``parts`` (an array that is not empty) has before each element.

    ``aggregate`` copies its accumulator, with all that is in it, at every element; arrays are copied element by
    element, strings at memory speed.  So the states are written into a string per block and read back once.
    """
    o, b, a, x = fresh("o"), fresh("k"), fresh("a"), fresh("x")
    inner = (
        f"aggregate(slice({parts}, {b} * {block} + 1, {block}), named_struct('st', {o}.st, 'out', ''), "
        f"({a}, {x}) -> named_struct('st', {step(f'{a}.st', x)}, 'out', concat({a}.out, ',', cast({a}.st as string))))"
    )
    joined = let(inner, lambda i: f"named_struct('st', {i}.st, 'out', concat({o}.out, array({i}.out)))")
    folded = (
        f"aggregate(sequence(0, cast((size({parts}) - 1) div {block} as int)), "
        f"named_struct('st', {zero}, 'out', cast(array() as array<string>)), ({o}, {b}) -> {joined}).out"
    )
    return f"cast(split(substring(array_join({folded}, ''), 2), ',') as array<int>)"


def starts(parts: str, length, block: int = 512) -> str:
    """Running sums: where each of the ``parts`` starts; ``length(x)`` is that of a part."""
    return running(parts, "0", lambda st, x: f"{st} + {length(x)}", block)


CHUNK = 512


def chunks(text: str) -> str:
    """``text`` in parts of ``CHUNK`` code points, for ``cut``."""
    return f"regexp_extract_all({text}, r'(?s).{{1,{CHUNK}}}', 0)"


def cut(parts: str, text: str, start: str, n: str) -> str:
    """``substring(text, start + 1, n)`` without counting from the start of the text, by its ``chunks``.

    A long text is cut in many places; each plain substring would walk all signs before it.
    """
    at = f"cast(({start}) div {CHUNK} as int)"
    near = f"concat(get({parts}, {at}), coalesce(get({parts}, {at} + 1), ''))"
    return (f"if(({start}) >= 0 and ({n}) <= {CHUNK}, coalesce(substring({near}, cast(({start}) % {CHUNK} + 1 as int), {n}), ''), "
            f"substring({text}, {start} + 1, {n}))")


def wrap(original: str = "$0", suggestion: str = "") -> str:
    """Replacement template for one marked span."""
    return f"{OPEN}{original}{MID}{suggestion}{CLOSE}"


def fields(*groups: str) -> str:
    """Pack capture groups into the suggestion slot of a mark."""
    return SEP.join(groups)


def field(expr: str, n: int) -> str:
    return f"split_part({expr}, '{SEP}', {n})"


def mark(text: str, pattern: str, template: str | None = None) -> str:
    """``text`` with every match of ``pattern`` replaced by ``template``."""
    return f"regexp_replace({text}, {lit(pattern)}, {lit(template or wrap())})"


def unmark(marked: str, rule: str = "0", zero_width: str = "false", base: str = "0") -> str:
    """Marked text -> ``array<HIT_TYPE>``; the text stands at ``base``.

    ``zero_width`` marks carry a copy of text that is not consumed (overlapping
    matches found through look-ahead), so only the plain part moves the offset.
    """

    x, z, i, j = fresh("x"), fresh("z"), fresh("i"), fresh("j")
    # the first piece stands before all matches; marks stand at the start of a piece, so they are looked for from there
    pieces = (
        f"transform(split({marked}, '{OPEN}'), ({x}, {i}) -> named_struct("
        f"'o', if({i} = 0, '', substring_index({x}, '{MID}', 1)), "
        f"'g', if({i} = 0, '', substring_index(substring_index({x}, '{CLOSE}', 1), '{MID}', -1)), "
        f"'n', if({i} = 0, length({x}), length({x}) - length(substring_index({x}, '{CLOSE}', 1)) - 1)))"
    )

    def run(w: str) -> str:
        return let(starts(w, lambda y: f"{y}.n + if({zero_width}, 0, length({y}.o))"), lambda at: (
            f"transform(slice({w}, 2, size({w})), ({z}, {j}) -> named_struct('r', {rule}, 'k', 0, 's', {base} + {at}[{j} + 1], "
            f"'e', {base} + {at}[{j} + 1] + length({z}.o), 'o', {z}.o, 'g', {z}.g))"))

    return let(pieces, run)


def spans(text: str, pattern: str, template: str | None = None, rule: str = "0",
          zero_width: bool = False) -> str:
    """All matches of one pattern as ``array<HIT_TYPE>``."""
    return unmark(mark(text, pattern, template), rule, "true" if zero_width else "false")


def spans_many(marks: list[tuple[int, str, bool]], in_lines: list[tuple[int, str, bool]] = ()) -> str:
    """Hits of many marked texts; the span kernel appears once in the plan.

    ``marks`` holds ``(rule, marked-text expression, zero_width)``.  ``in_lines`` holds ``(rule, array of struct<s, m>,
    zero_width)``: marked lines with their places, for rules whose matches stay within a line.
    """
    rows = ", ".join(
        f"named_struct('r', {r}, 'z', {'true' if z else 'false'}, 'at', 0, 'm', {m})" for r, m, z in marks
    )
    q, p, x = fresh("q"), fresh("q"), fresh("x")
    found = f"array({rows})" if marks else empty("struct<r:int,z:boolean,at:int,m:string>")
    if in_lines:
        more = ", ".join(
            f"transform({m}, {x} -> named_struct('r', {r}, 'z', {'true' if z else 'false'}, 'at', {x}.s, 'm', {x}.m))" for r, m, z in in_lines)
        found = f"concat({found}, flatten(array({more})))"
    return (
        f"flatten(transform(filter({found}, {p} -> contains({p}.m, '{OPEN}')), "
        f"{q} -> {unmark(f'{q}.m', f'{q}.r', f'{q}.z', f'{q}.at')}))"
    )


def gate(condition: str, expr: str, otherwise: str) -> str:
    """Skip costly work for texts that cannot match."""
    return f"if({condition}, {expr}, {otherwise})"


def line_array(text: str) -> str:
    """LINE: ``array<struct<s, t>>`` of the '\\n'-separated lines with offsets."""
    y, i = fresh("y"), fresh("i")

    def run(v: str) -> str:
        return let(starts(v, lambda x: f"length({x}) + 1"), lambda at: f"transform({v}, ({y}, {i}) -> named_struct('s', {at}[{i}], 't', {y}))")

    return let(f"split({text}, '\\n')", run)


def folded_lines(text: str, low: str) -> str:
    """``array<struct<s, t, l>>``: the lines with their offsets and their part of ``low``, the text in small letters."""
    y, i = fresh("y"), fresh("i")

    def run(v: str) -> str:
        return let(starts(v, lambda x: f"length({x}) + 1"), lambda at: let(f"split({low}, '\\n')", lambda small: (
            f"transform({v}, ({y}, {i}) -> named_struct('s', {at}[{i}], 't', {y}, 'l', {small}[{i}]))")))

    return let(f"split({text}, '\\n')", run)


def merge_ranges(ranges: str) -> str:
    """GAPS: union of half-open ranges; touching ranges become one."""

    def run(v: str) -> str:
        folded = scan(
            f"slice({v}, 2, size({v}))",
            f"{v}[0]",
            RANGE_TYPE,
            lambda st, x: (
                f"if({x}.s > {st}.e, {x}, "
                f"named_struct('s', {st}.s, 'e', greatest({st}.e, {x}.e)))"
            ),
            lambda st, x: f"if({x}.s > {st}.e, array({st}), {empty(RANGE_TYPE)})",
        )
        joined = let(folded, lambda f: f"concat({f}.out, array({f}.st))")
        return f"if(size({v}) = 0, {empty(RANGE_TYPE)}, {joined})"

    return let(f"array_sort({ranges})", run)


def overlaps(a: str, b: str) -> str:
    return f"({a}.s < {b}.e and {b}.s < {a}.e)"


def contains(outer: str, inner: str) -> str:
    return f"({inner}.s >= {outer}.s and {inner}.e <= {outer}.e)"


def any_overlap(h: str, ranges: str) -> str:
    r = fresh("r")
    return f"exists({ranges}, {r} -> {overlaps(h, r)})"


def any_contains(h: str, ranges: str) -> str:
    r = fresh("r")
    return f"exists({ranges}, {r} -> {contains(r, h)})"
