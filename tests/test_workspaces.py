"""Equal ids in two workspaces stay apart."""

from pyspark.sql import functions as F

from redpencil.lexicon import Lexicon
from redpencil.operators import candidates as cd
from redpencil.operators import patches as pt
from redpencil.streaming.incremental import reject_stale

CAND = ("workspace_id string, source_id string, source_type string, artboard_id string, box_id string, type string, severity string, original string, "
        "suggestion string, reason string, confidence double, is_definite boolean, context_before string, context_after string, created_by string")


def _cand(ws, sid, o, g, box=None):
    return (ws, sid, "caption", None, box, "spelling", "low", o, g, "r", .9, True, None, None, "reviewer")


def test_a_candidate_is_validated_in_its_own_workspace(spark):
    texts = spark.createDataFrame([("w1", "1", "teh cat"), ("w2", "1", "a cat sat on teh mat")], "workspace_id string, source_id string, text string")
    got = cd.validate(spark.createDataFrame([_cand("w1", "1", "teh", "the")], CAND), texts, Lexicon()).collect()
    assert [(r.workspace_id, r.span_start) for r in got] == [("w1", 0)]


def test_a_box_candidate_meets_the_box_of_its_workspace(spark):
    boxes = spark.createDataFrame([(w, "as", "b", t, .9, (0., 0., 9., 9.), "graphic_text", True) for w, t in (("w1", "teh cat"), ("w2", "no"))],
                                  "workspace_id string, asset_id string, box_id string, text string, confidence double, "
                                  "bbox struct<x0:double,y0:double,x1:double,y1:double>, visual_role string, visual_should_check boolean")
    c = spark.createDataFrame([_cand("w1", "", "teh", "the", "b"), _cand("w2", "", "teh", "the", "b")], CAND).withColumn("self_check", F.expr(
        "cast(null as struct<exact_substring:boolean,visible_or_in_ocr:boolean,not_ocr_uncertainty:boolean,not_protected_term:boolean>)"))
    assert [r.workspace_id for r in cd.validate_boxes(c, boxes, Lexicon()).collect()] == ["w1"]


def test_a_rule_issue_silences_candidates_of_its_workspace_only(spark):
    cols = "workspace_id string, ord bigint, source_type string, source_id string, severity string, original string, span_start int, span_end int, issue_id string"
    rules = spark.createDataFrame([("w1", 0, "caption", "1", "low", "ab", 0, 2, "rule")], cols)
    cands = spark.createDataFrame([(w, 1, "caption", "1", "low", "ab", 0, 2, w) for w in ("w1", "w2")], cols)
    assert {r.issue_id for r in cd.merge_issues(rules, cands).collect()} == {"rule", "w2"}
    verdict = cands.where("workspace_id = 'w1'").withColumns({c: F.lit(None).cast("string") for c in ("type", "suggestion", "artboard_id", "box_id")})
    every = cands.withColumns({c: F.lit(None).cast("string") for c in ("type", "suggestion", "artboard_id", "box_id")})
    heard = verdict.select("workspace_id", "source_id", cd.signature().alias("signature"))
    assert {r.issue_id for r in cd.keep_verified(every, heard.where("false"), heard).collect()} == {"w2"}


def test_fixes_change_texts_of_their_workspace_only(spark):
    i = spark.createDataFrame([("w1", "a", "caption", "1", None, None, "teh", "the!", 0, 3, "open", True, .9, "low"),
                               ("w1", "b", "caption", "1", None, None, "cat", "dog", 4, 7, "open", False, .1, "low"),
                               ("w2", "a", "caption", "1", None, None, "teh", "tea", 0, 3, "open", False, .1, "low")],
                              "workspace_id string, issue_id string, source_type string, source_id string, artboard_id string, box_id string, original string, "
                              "suggestion string, span_start int, span_end int, status string, is_definite boolean, confidence double, severity string")
    t = spark.createDataFrame([(w, "caption", "1", "teh cat") for w in ("w1", "w2")], "workspace_id string, source_type string, source_id string, text string")
    assert {r.workspace_id: r.corrected for r in pt.apply_patches(i, t).collect()} == {"w1": "the! cat", "w2": "teh cat"}
    assert {r.workspace_id: r.pending for r in pt.preview(i, t).collect()} == {"w1": 1, "w2": 0}
    moved = pt.shift_ranges(i, i.where("workspace_id = 'w1' and issue_id = 'a'").select("workspace_id", "issue_id"))
    assert {(r.workspace_id, r.issue_id): (r.status, r.span_start) for r in moved.collect()} == {
        ("w1", "a"): ("accepted", None), ("w1", "b"): ("open", 5), ("w2", "a"): ("open", 0)}
    parts = [r for r in pt.segments(i, t).collect() if r.workspace_id == "w2"]
    assert sorted((r.pos, r.segment, r.issue_id) for r in parts) == [(0, "teh", "a"), (1, " cat", None)]


def test_stale_results_are_judged_in_their_workspace(spark):
    cols = "workspace_id string, source_id string, fingerprint string"
    now = spark.createDataFrame([("w1", "1", "x"), ("w2", "1", "y")], cols)
    got = reject_stale(spark.createDataFrame([("w1", "1", "x"), ("w2", "1", "x")], cols), now)
    assert {r.workspace_id: r.stale for r in got.collect()} == {"w1": False, "w2": True}


def test_a_changed_lexicon_rechecks_only_texts_with_its_words(spark, tmp_path):
    from redpencil.operators import word_index as wi
    from redpencil.operators.checker import check

    old = Lexicon(preferred_wording={"ngon lành": "tuyệt vời", "->": "→", "teh": "the", "keep": "hold"}, brand_terms=["Blue Door"])
    new = Lexicon(preferred_wording={"ngon lành": "tuyệt", "teh": "the", "keep": "hold", "new word": "term"}, brand_terms=["Blue Door", "Hold"])
    texts = ["món ngon lành", "a -> b", "teh end", "a new word", "new things", "we keep it, KEEP it", "plain", "blue door", "hold on", ""]
    c = spark.createDataFrame([("w", "caption", str(k), t) for k, t in enumerate(texts)], "workspace_id string, source_type string, source_id string, text string")
    wi.build(c, str(tmp_path / "index"))
    index, (a, b), rules = wi.read(spark, str(tmp_path / "index")), (x.to_df(spark) for x in (old, new)), {66, 69, 70, 74}
    before = check(c, Lexicon(), rules, table=a)
    want = sorted(r.issue_id for r in check(c, Lexicon(), rules, table=b).collect())
    assert sorted(r.issue_id for r in wi.recheck(c, before, index, Lexicon(), a, b, rules).collect()) == want
    # "teh" moves up in its list, which counts as a change; the other texts are not read again
    assert {r.source_id for r in wi.touched(index, a, b).collect()} == {"0", "1", "2", "3", "4", "5", "8"}


def test_cached_results_are_computed_once(spark, tmp_path):
    from pyspark.sql import types as T

    from redpencil.operators.result_cache import ResultCache

    cache = ResultCache(spark, str(tmp_path / "cache"), T.StructType([T.StructField("n", T.IntegerType())]), buckets=4)
    asked = []

    def compute(misses):
        asked.append(sorted(r.key for r in misses.select("key").collect()))
        return misses.select("key", F.when(F.col("key") != "none", F.length("key")).alias("n"))
    work = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    read = lambda df: sorted(((r.key, r.n) for r in df.collect()), key=str)
    assert read(cache.fill(work("a", "bb", "bb", "none"), compute)) == [("a", 1), ("bb", 2), ("bb", 2), ("none", None)]
    assert read(cache.fill(work("bb", "ccc", None), compute)) == [("bb", 2), ("ccc", 3), (None, None)]
    assert read(cache.fill(work("a", "bb", "ccc"), compute)) == [("a", 1), ("bb", 2), ("ccc", 3)]
    assert asked == [["a", "bb", "none"], ["ccc"], []]
    again = ResultCache(spark, str(tmp_path / "cache"), T.StructType([T.StructField("n", T.IntegerType())]), buckets=4)
    assert read(again.fill(work("a", "none"), compute)) == [("a", 1), ("none", None)] and asked[-1] == ["none"]
