"""Limits cut nothing unless asked for, and what they cut comes back as rejects."""

from redpencil.operators import boxes as bx
from redpencil.sources import lexicons as lx

BOX = "asset_id string, ord int, box_id string, text string, confidence double"


def test_every_new_text_is_added_and_known_ones_take_no_place(spark):
    known = spark.createDataFrame([("a", i, f"k{i}", f"Known {i}", .9) for i in range(16)], BOX)
    found = spark.createDataFrame([("a", i, f"f{i}", f"known  {i}" if i < 16 else f"new {i}", .9) for i in range(40)], BOX)
    assert {r.box_id for r in bx.add_detected(known, found).collect()} == {f"f{i}" for i in range(16, 40)}
    kept, rejects = (x.collect() for x in bx.split_detected(known, found, most=16))
    assert {r.box_id for r in kept} == {f"f{i}" for i in range(16, 32)}
    assert {(r.box_id, r.reject_reason) for r in rejects} == {(f"f{i}", "over_limit") for i in range(32, 40)}


def test_the_reference_counts_sixteen_texts_before_known_ones_go(spark):
    known = spark.createDataFrame([("a", 0, "k0", "t 3", .9)], BOX)
    found = spark.createDataFrame([(a, i, f"{a}{i}", f"t {i}", .9) for a in "ab" for i in range(20)] + [("a", -1, "blank", " ", .9)], BOX)
    head, rest = bx.first_detected(found, 16)
    assert {r.box_id for r in bx.add_detected(known, head).collect()} == {f"{a}{i}" for a in "ab" for i in range(16)} - {"a3"}
    assert {r.box_id for r in rest.collect()} == {f"{a}{i}" for a in "ab" for i in range(16, 20)}


def test_pairs_of_any_length_stay_and_a_limit_returns_rejects(spark):
    long = "x" * 121
    rows = spark.createDataFrame([(1, "a", "b"), (2, long, "c"), (3, "A", "B"), (4, "d", long)], "ord int, wrong string, right string")
    assert {r.ord for r in lx.dedupe_pairs(rows).collect()} == {1, 2, 4}
    kept, rejects = (x.collect() for x in lx.split_pairs(rows, max_chars=120))
    assert {r.ord for r in kept} == {1} and {(r.ord, r.reject_reason) for r in rejects} == {(2, "over_limit"), (4, "over_limit")}
    text = spark.createDataFrame([(1, f"- {long} -> c\nd => e")], "id int, text string")
    assert {(r.wrong, r.right) for r in lx.pairs_from_text(text, "id").collect()} == {(long, "c"), ("d", "e")}
    assert {(r.wrong, r.right) for r in lx.pairs_from_text(text, "id", max_chars=120).collect()} == {("d", "e")}


def test_a_binding_does_not_copy_what_its_body_gives(spark):
    """transform copies the value of every binding around it; orderings of nested rows are built for each comparison."""
    from redpencil.functions.exprs import let
    from redpencil.operators.checker import settle
    bound = let("array(1, 2)", lambda v: let(f"concat({v}, {v})", lambda w: f"size({w}) + {v}[0]"))
    assert "transform(" not in bound and spark.range(1).selectExpr(f"{bound} as n").first().n == 5
    assert "'h', " not in settle("x")


def test_a_label_with_wide_blanks_passes_the_gate_of_its_line(spark):
    """gates are asked line by line, so they must hold for every line with a hit."""
    from redpencil.lexicon import Lexicon
    from redpencil.operators.checker import rule_hits
    text = spark.createDataFrame([(1, "abc\nThời  gian , 09 giờ\nabc\nThời gian " + " " * 100 + ", 10 giờ")], "id int, text string")
    found = rule_hits(text, Lexicon(), {18}, ["id"], guard=False, resolve=False).collect()
    assert {(r.span_start, r.suggestion) for r in found} == {(4, "Thời  gian: 09 giờ"), (28, "Thời gian: 10 giờ")}


def test_folds_hold_no_hits(spark):
    """Aggregate copies its accumulator at every step, so places are folded, not hits or fixes."""
    from pyspark.sql import functions as F
    from redpencil.functions.exprs import HIT_TYPE
    from redpencil.operators.checker import islands
    assert HIT_TYPE not in islands("h").replace(f"cast(array() as array<array<{HIT_TYPE}>>)", "")
    rows = spark.range(1).select(F.expr("transform(array(array(8, 9), array(0, 4), array(3, 8), array(20, 21)), v -> named_struct("
                                        "'r', 0, 'k', 0, 's', v[0], 'e', v[1], 'o', '', 'g', ''))").alias("h"))
    got = rows.select(F.expr(islands("h")).alias("i")).first().i
    assert [[(h.s, h.e) for h in i] for i in got] == [[(0, 4), (3, 8)], [(8, 9)], [(20, 21)]]
