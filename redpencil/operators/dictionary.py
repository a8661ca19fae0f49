"""Dictionary rules (R65-R70, R74): lexicon phrases found as whole words.

Two exact ways to the same hits:

* ``phrase_hits``     lexicon entries folded into the plan; per text start positions come from one
  zero-width alternation, so overlapping and nested phrases are all found.
* ``candidate_hits``  lexicon of any size in a table; the first one or two words of each phrase
  meet the words of the texts in a join, and what is left of the phrase is compared in the text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpencil.functions import text as tx
from redpencil.functions.exprs import HIT_TYPE, chunks, cut, empty, fresh, let, lit, merge_ranges, spans, wrap
from redpencil.lexicon import BUILTIN_SPELLINGS, Lexicon
from redpencil.operators import ranges as rg

WORD_RUN = r"[\p{L}\p{N}_]+"
SIGN = r"[^\p{L}\p{N}_\s]"
CANDIDATE_TYPE = "struct<c:int,k:int,s:int,n:int,w:string,g:string,p:boolean,x:boolean>"


def entries(lex: Lexicon, rules: set[int] | None = None) -> list[tuple]:
    """(code, order, phrase, right, keep_shape) in the order rules emit hits."""
    out = []
    fixed = re.compile(tx.FIXED_CASE)
    canonical = {t.lower() for t in lex.canonical()}

    def shaped(right: str) -> bool:
        return not (right.strip().lower() in canonical or fixed.search(right))

    spelling = {**BUILTIN_SPELLINGS, **lex.preferred_spellings}
    for i, (w, r) in enumerate(spelling.items()):
        if w and w != r:
            brand = any(t in r for t in lex.brand_terms)
            out.append((651 if brand else 650, i, w, r, False))
    for rule, table in ((66, lex.product_terms), (67, lex.missing_tone_map), (68, lex.wrong_tone_map),
                        (69, lex.preferred_wording)):
        for i, (w, r) in enumerate(sorted(table.items(), key=lambda kv: -len(kv[0]))):
            if rule != 66 or (w and w != r):
                out.append((rule * 10, i, w, r, shaped(r)))
    for i, (w, (priority, _)) in enumerate(sorted(lex.risky_words.items(), key=lambda kv: -len(kv[0]))):
        code = {"high": 700, "low": 702}.get(priority, 701)
        out.append((code, i, w, None, False))
    for i, (w, r) in enumerate(lex.preferred_wording.items()):
        out.append((740, i, w, r, shaped(r)))
    return [e for e in out if rules is None or e[0] // 10 in rules]


def _initial(t: str, caption: str, start: str, parts: str) -> str:
    """Does a sentence of a caption start here?"""
    near = cut(parts, t, f"greatest({start} - 256, 0)", f"least({start}, 256)")
    before = let(tx.rtrim_ws(near), lambda b: f"if({b} = '' and {start} > 256, {tx.rtrim_ws(f'left({t}, {start})')}, {b})")
    return (f"({caption} and ({start} = 0 or ({cut(parts, t, f'{start} - 1', '1')} rlike {lit(tx.WS)} and {before} rlike '[.!?]$')))")


def phrase_hits(t: str, low: str, caption: str, headings: str, lex: Lexicon, rules: set[int] | None = None) -> str:
    """All phrase occurrences as ``array<hit>`` with final suggestions."""
    table = entries(lex, rules)
    if not table:
        return empty(HIT_TYPE)
    words = {w.lower() for _, _, w, _, _ in table}
    rows = ", ".join(
        f"named_struct('c', {c}, 'k', {k}, 'w', {lit(w.lower())}, 'n', {len(w)}, "
        f"'g', {lit(r) if r is not None else 'cast(null as string)'}, 'p', {'true' if p else 'false'})"
        for c, k, w, r, p in table
    )
    longest = max(len(e[2]) for e in table)
    pattern = rf"(?={tx.first_chars(words)}){tx.NOT_AFTER_WORD}(?={tx.trie(words)}{tx.NOT_BEFORE_WORD})"
    starts = spans(low, pattern, wrap(""), zero_width=True)
    st, en = fresh("st"), fresh("en")
    def at_start(seg: str, parts: str) -> str:
        initial = _initial(t, caption, f"{st}.s", parts)
        fits = (f"startswith(lower({seg}), {en}.w) "
                f"and not substring({seg}, {en}.n + 1, 1) rlike {lit(tx.WORD)} "
                f"and ({en}.c <> 740 or {initial})")
        hit = (f"named_struct('r', {en}.c, 'k', {en}.k, 's', {st}.s, 'e', {st}.s + {en}.n, "
               f"'o', substring({seg}, 1, {en}.n), 'g', {en}.g, 'p', {en}.p)")
        return f"transform(filter(array({rows}), {en} -> {fits}), {en} -> {hit})"

    def found(parts: str) -> str:
        return f"flatten(transform({starts}, {st} -> {let(cut(parts, t, f'{st}.s', str(longest + 1)), lambda seg: at_start(seg, parts))}))"

    return cased(let(chunks(t), found), headings)


def cased(raw: str, headings: str) -> str:
    """Suggestions in the letter case of the place they go to."""
    h = fresh("h")
    g = (f"case when {h}.g is null then {h}.o when {rg.in_heading(h, headings)} then upper({h}.g) "
         f"when {h}.p then {tx.preserve_case(f'{h}.o', f'{h}.g')} else {h}.g end")
    return (f"transform({raw}, {h} -> named_struct('r', {h}.r, 'k', {h}.k, 's', {h}.s, 'e', {h}.e, "
            f"'o', {h}.o, 'g', {g}))")


def phrase_keys(phrases: DataFrame, phrase: str = "w") -> DataFrame:
    """Add ``key``, ``lead`` (what stands before it in the phrase) and ``first``, the word or sign that must stand in a text.

    The key is the first one or two words with what stands between them, or, for a phrase without a
    letter or digit such as an arrow, its first sign.
    """
    words = rf"^([^\p{{L}}\p{{N}}_]*)({WORD_RUN}(?:[^\p{{L}}\p{{N}}_]+{WORD_RUN})?)"
    signs = rf"^({tx.WS}*)({SIGN})"
    has_word = f"{phrase} rlike {lit(WORD_RUN)}"
    pick = lambda n: f"if({has_word}, regexp_extract({phrase}, {lit(words)}, {n}), regexp_extract({phrase}, {lit(signs)}, {n}))"
    return (phrases.withColumn("key", F.expr(pick(2))).withColumn("lead", F.length(F.expr(pick(1))))
            .withColumn("first", F.expr(f"if({has_word}, regexp_extract(key, {lit(WORD_RUN)}, 0), key)")).where("key <> ''"))


BITS = 1 << 20  # of the filter of lexicon keys; the driver holds it, 128 KB however large the lexicon


class KeyFilter:
    """Which words, word pairs and signs can be keys of a lexicon; a text drops all others before it meets the lexicon."""

    def __init__(self, keyed: DataFrame) -> None:
        both = keyed.select(F.explode(F.array("key", "first")).alias("key"), (~F.col("first").rlike(WORD_RUN)).alias("sign"))
        at = F.pmod(F.xxhash64("key"), F.lit(BITS))
        words = both.groupBy((at / 64).cast("long").alias("i")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("bits"), F.bool_or("sign").alias("sign"))
        bits, self.signs = [0] * (BITS // 64), False
        for r in words.collect():  # BITS / 64 rows at most
            bits[r["i"]] = r["bits"]
            self.signs |= r["sign"]
        # the optimizer folds this into one array of the plan
        self.bits = f"from_json('[{','.join(map(str, bits))}]', 'array<bigint>')"

    def may(self, key: str) -> str:
        at = f"pmod(xxhash64({key}), {BITS})"
        return f"shiftright(element_at({self.bits}, cast({at} div 64 as int) + 1), cast({at} % 64 as int)) % 2 <> 0"


def text_keys(texts: DataFrame, id_cols: list[str], only: KeyFilter | None = None) -> DataFrame:
    """(ids, key, at): each word, and each two neighbouring words with what stands between them.

    With a filter, only keys that it may hold, and signs where the lexicon has any.
    """
    x, i, y, p = fresh("x"), fresh("i"), fresh("y"), fresh("p")
    in_parts = lambda e: f"transform(array({chunks('low')}), {p} -> {e})[0]"
    ones = f"transform(w, {x} -> named_struct('key', {x}.o, 'at', {x}.s))"
    twos = (f"transform(slice(w, 1, greatest(size(w) - 1, 0)), ({x}, {i}) -> "
            f"named_struct('key', {cut(p, 'low', f'{x}.s', f'w[{i} + 1].e - {x}.s')}, 'at', {x}.s))")
    words = texts.select(*id_cols, F.expr(tx.folded("text")).alias("low")).withColumn("w", F.expr(spans("low", WORD_RUN)))
    if only is None:
        return words.select(*id_cols, F.explode(F.expr(in_parts(f"concat({ones}, {twos})"))).alias("g")).select(*id_cols, "g.key", "g.at")
    # a pair is built only where its first word may begin one
    pairs = (f"transform(filter(transform(w, ({x}, {i}) -> named_struct('w', {x}, 'e', get(w, {i} + 1).e)), {y} -> {only.may(f'{y}.w.o')}), "
             f"{y} -> named_struct('one', named_struct('key', {y}.w.o, 'at', {y}.w.s), 'two', "
             f"named_struct('key', {cut(p, 'low', f'{y}.w.s', f'{y}.e - {y}.w.s')}, 'at', {y}.w.s)))")
    keys = f"flatten(transform({pairs}, {x} -> array({x}.one, {x}.two)))"
    if only.signs:
        keys = f"concat({keys}, transform({spans('low', SIGN)}, {x} -> named_struct('key', {x}.o, 'at', {x}.s)))"
    keys = f"filter({keys}, {x} -> coalesce({only.may(f'{x}.key')}, false))"
    return words.select(*id_cols, F.explode(F.expr(in_parts(keys))).alias("g")).select(*id_cols, "g.key", "g.at")


def occurs(t: str, low: str, c: str, t_parts: str, low_parts: str) -> str:
    """Does the candidate's whole phrase stand at its place, as a whole word?  A phrase of one or two
    words that is its own key has been compared by the join."""
    return (f"({c}.x or {c}.s >= 0 and {cut(low_parts, low, f'{c}.s', f'{c}.n')} = {c}.w "
            f"and not {cut(t_parts, t, f'{c}.s + {c}.n', '1')} rlike {lit(tx.WORD)} "
            f"and not ({c}.s > 0 and {cut(t_parts, t, f'{c}.s - 1', '1')} rlike {lit(tx.WORD)}))")


def in_parts(t: str, low: str, body) -> str:
    """``body`` of the chunks of both forms of the text, each made once."""
    return let(chunks(t), lambda a: let(chunks(low), lambda b: body(a, b)))


def table_entries(lexicon: DataFrame) -> DataFrame:
    """(c, o, ord, w, g, p, key, lead, first) of a lexicon table; code 0 marks protected terms.

    ``o`` and ``ord`` order the entries of a rule.
    """
    rows = lexicon.where("trim(coalesce(wrong, right, '')) <> ''")
    norm = F.trim(F.regexp_replace("right", r"\s+", " "))
    canonical = (rows.where(F.col("list").isin("brand_terms", "protected_terms", "do_not_change", "product_terms"))
                 .select(F.lower(F.trim("right")).alias("same")).where("same <> ''").distinct())
    codes = ("case list when 'preferred_spellings' then array(650) when 'product_terms' then array(660) when 'missing_tone_map' then array(670) "
             "when 'wrong_tone_map' then array(680) when 'preferred_wording' then array(690, 740) "
             "when 'risky_words' then array(case priority when 'high' then 700 when 'low' then 702 else 701 end) end")
    phrases = (rows.where("wrong is not null").where("list not in ('preferred_spellings', 'product_terms') or wrong <> right")
               .withColumn("c", F.explode(F.expr(codes))))
    # longer phrases come first, but spellings and sentence starts keep the order of the table
    order = F.expr("cast(if(c in (650, 740), 0, -length(wrong)) as int)")
    fixed = f"right rlike {lit(tx.FIXED_CASE)}"
    shaped = f"c in (670, 680, 690, 660, 740) and same is null and not {fixed}"
    phrases = phrases.join(canonical, F.lower(F.trim(F.col("right"))) == F.col("same"), "left").select(
        F.col("c").cast("int").alias("c"), order.alias("o"), F.col("ord").cast("long").alias("ord"), F.expr(tx.folded("wrong")).alias("w"),
        F.when(F.col("c").between(700, 702), F.lit(None)).otherwise(F.col("right")).alias("g"), F.expr(shaped).alias("p"))
    brands = phrase_keys(rows.where("list = 'brand_terms'").select(F.expr(tx.folded("right")).alias("w"))).select("w", "key")
    named = phrases.where("c = 650").select(F.col("g").alias("text")).distinct()
    named = text_keys(named.withColumn("id", F.col("text")), ["id"]).join(brands, "key").where(f"contains({tx.folded('id')}, w)").select(
        F.col("id").alias("named")).distinct()
    phrases = phrases.join(named, F.col("g") == F.col("named"), "left").withColumn(
        "c", F.expr("cast(if(c = 650 and named is not null, 651, c) as int)")).drop("named")
    terms = rows.where(F.col("list").isin("brand_terms", "protected_terms", "do_not_change", "product_terms", "preferred_spellings")).select(
        F.expr(tx.folded("trim(regexp_replace(right, '\\\\s+', ' '))")).alias("w")).where("w <> ''").distinct()
    terms = terms.select(F.lit(0).alias("c"), F.lit(0).alias("o"), F.lit(0).cast("long").alias("ord"), "w",
                         F.lit(None).cast("string").alias("g"), F.lit(False).alias("p"))
    return phrase_keys(phrases.unionByName(terms))


TABLE_ORDER = 1_000_000  # entries of a table come after inline ones of the same rule


def with_candidates(content: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``content`` plus ``_candidates``: where phrases of the lexicon table may stand in each text.

    Keys that the lexicon cannot hold are dropped inside the text's own row; the others meet it in
    one join whose sides Spark broadcasts or shuffles by their size, and a text gets its candidates
    back by a hash of its row. Entries are ranked among the candidates of their text alone, so the
    lexicon is never sorted.
    """
    keyed = content.withColumn("_row", F.unhex(F.sha2(F.to_json(F.struct(*content.columns)), 256)))
    entries = table_entries(lexicon)
    met = text_keys(keyed.select("_row", "text"), ["_row"], KeyFilter(entries)).join(entries, "key")
    whole_key = (F.col("w") == F.col("key")) & F.col("w").rlike(WORD_RUN)
    item = F.struct(F.expr("c div 10").alias("r"), "o", "ord", "w", (F.col("at") - F.col("lead")).cast("int").alias("s"), "c",
                    F.length("w").cast("int").alias("n"), "g", "p", whole_key.alias("x"))
    v, i = fresh("v"), fresh("i")
    ranked = (f"transform(array_sort(c), ({v}, {i}) -> named_struct('c', {v}.c, 'k', {i} + {TABLE_ORDER}, 's', {v}.s, 'n', {v}.n, "
              f"'w', {v}.w, 'g', {v}.g, 'p', {v}.p, 'x', {v}.x))")
    found = met.groupBy("_row").agg(F.collect_set(item).alias("c")).select(
        "_row", F.expr(ranked).cast(f"array<{CANDIDATE_TYPE}>").alias("_candidates"))
    return keyed.join(found, "_row", "left").withColumn(
        "_candidates", F.coalesce("_candidates", F.expr(f"cast(array() as array<{CANDIDATE_TYPE}>)"))).drop("_row")


def candidate_hits(t: str, low: str, caption: str, headings: str, candidates: str, rules: set[int]) -> str:
    """Hits of a lexicon table from the candidates of the text."""
    c, d = fresh("c"), fresh("d")
    wanted = f"{c}.c div 10 in ({', '.join(map(str, sorted(rules)))})"
    initial = lambda a: f"({c}.c <> 740 or {_initial(t, caption, f'{c}.s', a)})"
    raw = lambda a, b: (
        f"transform(filter({candidates}, {c} -> {wanted} and {occurs(t, low, c, a, b)} and {initial(a)}), {d} -> named_struct('r', {d}.c, 'k', {d}.k, "
        f"'s', {d}.s, 'e', {d}.s + {d}.n, 'o', {cut(a, t, f'{d}.s', f'{d}.n')}, 'g', {d}.g, 'p', {d}.p))")
    return cased(in_parts(t, low, raw), headings)


def candidate_terms(t: str, low: str, candidates: str) -> str:
    """J3 for a lexicon table: merged ranges of its protected terms."""
    c, d = fresh("c"), fresh("d")
    return merge_ranges(in_parts(t, low, lambda a, b: (
        f"transform(filter({candidates}, {c} -> {c}.c = 0 and {occurs(t, low, c, a, b)}), {d} -> named_struct('s', {d}.s, 'e', {d}.s + {d}.n))")))


def joined_hits(content: DataFrame, lexicon: DataFrame, id_cols: list[str]) -> DataFrame:
    """Plain phrase occurrences for a lexicon of any size: (list, wrong, right) met by words."""
    lex = phrase_keys(lexicon.select("list", F.expr(tx.folded("wrong")).alias("w"), "right").where("w <> ''"))
    met = text_keys(content, id_cols, KeyFilter(lex)).join(lex, "key")
    whole_key = (F.col("w") == F.col("key")) & F.col("w").rlike(WORD_RUN)
    item = F.struct("list", "right", "w", (F.col("at") - F.col("lead")).cast("int").alias("s"), F.length("w").cast("int").alias("n"), whole_key.alias("x"))
    found = met.groupBy(*id_cols).agg(F.collect_list(item).alias("c"))
    texts = content.select(*id_cols, "text").join(found, id_cols)
    c, d = fresh("c"), fresh("d")
    kept = let(tx.folded("text"), lambda low: in_parts("text", low, lambda a, b: (  # fold the text once
        f"transform(filter(c, {c} -> {occurs('text', low, c, a, b)}), {d} -> named_struct('list', {d}.list, 's', {d}.s, 'n', {d}.n, "
        f"'o', {cut(a, 'text', f'{d}.s', f'{d}.n')}, 'right', {d}.right))")))
    rows = texts.select(*id_cols, F.explode(F.expr(kept)).alias("c"))
    return rows.select(*id_cols, "c.list", F.col("c.s").alias("span_start"), F.expr("c.s + c.n").alias("span_end"),
                       F.col("c.o").alias("original"), F.col("c.right").alias("suggestion"))
