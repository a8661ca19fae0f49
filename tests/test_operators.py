"""Folds without an SQL twin, against brute force on small fixtures."""

from pyspark.sql import functions as F

from redpencil.operators import boxes as bx
from redpencil.operators import candidates as cd
from redpencil.operators import patches as pt

ISSUE = ("ord bigint, source_type string, source_id string, box_id string, type string, severity string, original string, "
         "suggestion string, reason string, confidence double, is_definite boolean, span_start int, span_end int, "
         "status string, created_by string")


def issue(spark, rows):
    full = [(i, "image", "s1", "b1", t, sev, o, g, "r" + str(i), c, d, None, None, "open", by)
            for i, (t, sev, o, g, c, d, by) in enumerate(rows)]
    return spark.createDataFrame(full, ISSUE)


def test_related_issues_fold_into_one(spark):
    df = issue(spark, [("spelling", "low", "abc def", "abd def", .6, False, "x"),
                       ("spelling", "high", "abc", "abd", .9, True, "y"),
                       ("style", "low", "zzz", "q", .5, False, "x")])
    got = {(r["original"], r["severity"], r["confidence"], r["created_by"]) for r in cd.unique_issues(df).collect()}
    assert got == {("abc", "high", .9, "x+y"), ("zzz", "low", .5, "x")}


def test_consensus(spark):
    cands = issue(spark, [("spelling", "high", "abc", "abd", .7, False, "x"), ("spelling", "high", "abc", "abd", .6, False, "y"),
                          ("style", "high", "lone", "l", .7, False, "x")])
    none = cands.where("false")
    got = {r["original"]: r for r in cd.accept_by_consensus(cands, none).collect()}
    assert got["abc"]["severity"] == "high" and got["abc"]["created_by"] == "x+y"
    assert got["lone"]["severity"] == "needs_review" and not got["lone"]["is_definite"]


def test_consensus_judges_each_cluster_against_what_the_others_left(spark):
    cands = issue(spark, [("spelling", "high", "the abc", "the abd", .7, True, "x"), ("spelling", "critical", "abc", "abd", .7, False, "y")])
    current = issue(spark, [("spelling", "low", "abc", "abd", .5, False, "rule")])
    got = cd.accept_by_consensus(cands, current).collect()
    assert {(r["severity"], r["created_by"], r["original"]) for r in got} == {("critical", "rule+y+x", "abc")} and got[0].asDict().keys() == set(cd.ISSUE)
    captions = cands.withColumn("source_type", F.lit("caption"))
    assert cd.accept_by_consensus(captions, current).count() == 1


def test_combined_issues_keep_their_columns(spark):
    df = (issue(spark, [("spelling", "low", "abc def", "abd def", .6, False, "x"), ("spelling", "high", "abc", "abd", .9, True, "y")])
          .withColumn("workspace_id", F.lit("w")).withColumn("issue_id", F.concat(F.lit("i"), "ord"))
          .withColumn("bbox", F.expr("if(ord = 1, named_struct('x0', 1D, 'y0', 1D, 'x1', 2D, 'y1', 2D), null)")))
    r = cd.unique_issues(df).first()
    assert (r.issue_id, r.workspace_id, r.bbox.x1) == ("i1", "w", 2.0)
    two = df.withColumn("workspace_id", F.concat(F.lit("w"), "ord"))
    assert cd.unique_issues(two).count() == 2


def test_compatibility_forms_compare_equal(spark):
    lex = __import__("redpencil.lexicon", fromlist=["Lexicon"]).Lexicon()
    b = spark.createDataFrame([("b", "Ａ１２ ﬁne", .5)], "box_id string, text string, confidence double")
    c = spark.createDataFrame([("b", "A12 fine", .9)], "box_id string, corrected_text string, confidence double")
    assert bx.correct_text(b, c, lex).first().verdict == "confirm"


def test_a_verifier_that_keeps_nothing_is_not_silence(spark):
    from redpencil.sources import replies as rl

    heard = rl.verdicts(spark.createDataFrame([("1", '{"kept": []}'), ("2", "no json"), ("3", '{"kept": ["a"]}')], "source_id string, reply string"), ["source_id"])
    assert {r.source_id: list(r.kept) for r in heard.collect()} == {"1": [], "3": ["a"]}
    cands = issue(spark, [("style", "low", "a", "b", .5, False, "x")]).withColumn("artboard_id", F.lit(None).cast("string"))
    cands = cands.withColumn("source_id", F.lit("1")).unionByName(cands.withColumn("source_id", F.lit("2")))
    none = cands.select("source_id", cd.signature().alias("signature")).where("false")
    assert [r.source_id for r in cd.keep_verified(cands, none, heard).collect()] == ["2"]


def test_later_writes_keep_other_workspaces(spark, tmp_path):
    from redpencil.sources import content as src

    ws = lambda i: spark.createDataFrame([(i, f"n{i}")], "id string, name string")
    for i in ("w1", "w2", "w1"):
        src.write_workspaces(ws(i), str(tmp_path / "ws"))
    assert {r.id for r in src.read_workspaces(spark, str(tmp_path / "ws/*")).collect()} == {"w1", "w2"}


def test_merge_prefers_rules_then_longer(spark):
    cols = "ord bigint, source_type string, source_id string, severity string, original string, span_start int, span_end int, issue_id string"
    rules = spark.createDataFrame([(0, "caption", "1", "low", "ab", 0, 2, "rule")], cols)
    cands = spark.createDataFrame([(1, "caption", "1", "high", "bc", 1, 3, "gone"), (2, "caption", "1", "low", "xy", 10, 12, "short"),
                                   (3, "caption", "1", "low", "xyz", 10, 13, "long"), (4, "caption", "1", "low", "q", 20, 21, "free")], cols)
    got = {r["issue_id"] for r in cd.merge_issues(rules, cands).collect()}
    assert got == {"rule", "long", "free"}


def test_late_candidates_merge_into_stored_issues(spark, tmp_path):
    from redpencil.streaming.issue_store import IssueStore

    cols = ("source_type string, source_id string, severity string, original string, span_start int, span_end int, issue_id string, "
            "origin string, ord bigint")
    late = [[("caption", "1", "low", "ab", 0, 2, "rule", "rule", 0)],
            [("caption", "1", "high", "bc", 1, 3, "clash", "candidate", 1), ("caption", "1", "low", "xyz", 10, 13, "new", "candidate", 2)],
            [("caption", "1", "low", "yz", 11, 13, "inside", "candidate", 3), ("caption", "2", "low", "q", 0, 1, "other", "candidate", 4)]]
    store = IssueStore(spark, str(tmp_path / "issues"), spark.createDataFrame([], cols).schema, 8, ["source_type", "source_id"])
    for epoch in (0, 1, 2, 2):  # the last batch is replayed
        store.write(spark.createDataFrame(late[epoch], cols), epoch)
    assert {r.issue_id for r in store.issues().collect()} == {"rule", "new", "other"}


def test_patches_apply_right_to_left(spark):
    i = spark.createDataFrame(
        [("a", "caption", "1", "teh", "the", 0, 3, "open", True, .9), ("b", "caption", "1", "h q", "x", 2, 5, "open", True, .9),
         ("c", "caption", "1", "wrong", "y", 4, 9, "open", True, .9), ("d", "caption", "1", "ck", "k", 7, 9, "open", True, .9)],
        "issue_id string, source_type string, source_id string, original string, suggestion string, span_start int, span_end int, "
        "status string, is_definite boolean, confidence double")
    t = spark.createDataFrame([("caption", "1", "teh quick🥳")], "source_type string, source_id string, text string")
    r = pt.apply_patches(i, t).first()
    assert r["corrected"] == "texuik🥳" and r["applied"] == ["b", "d"]


def test_near_duplicate_boxes(spark):
    b = spark.createDataFrame([("a", 0, "b0", "Sale", .5, (0., 0., 10., 10.)), ("a", 1, "b1", "sale ", .9, (1., 0., 11., 10.)),
                               ("a", 2, "b2", "Sale", .9, (50., 0., 60., 10.))],
                              "asset_id string, ord bigint, box_id string, text string, confidence double, "
                              "bbox struct<x0:double,y0:double,x1:double,y1:double>")
    got = {(r["box_id"], r["text"], r["confidence"]) for r in bx.dedupe_boxes(b).collect()}
    assert got == {("b0", "sale ", .9), ("b2", "Sale", .9)}


def test_validation_keeps_protected_terms(spark, lexicon):
    cols = ("source_id string, source_type string, artboard_id string, box_id string, type string, severity string, original string, "
            "suggestion string, reason string, confidence double, is_definite boolean, context_before string, context_after string, created_by string")
    def row(i, o, g):
        return (i, "caption", None, None, "style", "low", o, g, "r", .8, False, None, None, "reviewer")
    texts = {"1": "GRAND OPENING PARTY\nCome along.", "2": "Come along.\nGRAND OPENING PARTY", "3": "GRAND OPENNING PARTY\nCome along.",
             "4": "Meet us at HarborLight.", "5": "Silver Fern is open.", "6": "See https://recieve.example.org/box now."}
    c = spark.createDataFrame([row("1", "GRAND OPENING", "Grand opening"), row("2", "GRAND OPENING", "Grand opening"),
                               row("3", "OPENNING", "OPENING"), row("4", "HarborLight", "Harbor Light"),
                               row("5", "Silver Fern", "Silver-Fern"), row("6", "recieve", "receive")], cols)
    t = spark.createDataFrame(list(texts.items()), "source_id string, text string")
    assert {r["source_id"] for r in cd.validate(c, t, lexicon).collect()} == {"2", "3"}


def _related(a, b):
    norm = lambda t: " ".join(t.lower().split())
    inside = lambda x, y: x in y or y in x
    return inside(norm(a["original"]), norm(b["original"])) and inside(norm(a["suggestion"]), norm(b["suggestion"]))


def test_clusters_and_unique_issues_against_brute_force(spark):
    import random

    rnd, words = random.Random(4), ["a", "ab", "abc", "b c", "xyz", "xy", "", "long text abc", "q"]
    rows = [(rnd.choice(["spelling", "style"]), rnd.choice(["low", "high"]), rnd.choice(words), rnd.choice(words), rnd.random(), False, "x") for _ in range(60)]
    df = issue(spark, rows).withColumn("source_id", F.concat(F.lit("s"), F.col("ord") % 3))
    found = [r.asDict() for r in df.orderBy("ord").collect()]
    want = []
    for s in ("s0", "s1", "s2"):
        groups = []
        for r in (x for x in found if x["source_id"] == s):
            home = next((g for g in groups if any(_related(m, r) for m in g)), None)
            groups.append([r]) if home is None else home.append(r)
        want += [sorted(m["ord"] for m in g) for g in groups]
    got = [sorted(m.ord for m in r.members) for r in cd.clusters(df).collect()]
    assert sorted(got) == sorted(want)
    pushed = []
    for s in ("s0", "s1", "s2"):
        state = []
        for r in (x for x in found if x["source_id"] == s):
            home = next((k for k, m in enumerate(state) if _related(m, r)), None)
            if home is None:
                state.append(dict(r))
                continue
            old = state[home]
            norm = lambda t: " ".join(t.lower().split())
            if len(r["original"]) < len(old["original"]) and norm(r["original"]) in norm(old["original"]):
                old |= {c: r[c] for c in ("type", "original", "suggestion")}
            old["confidence"] = max(old["confidence"], r["confidence"])
            old["severity"] = "high" if "high" in (old["severity"], r["severity"]) else "low"
        pushed += [(m["source_id"], m["ord"], m["type"], m["original"], m["suggestion"], m["severity"], m["confidence"]) for m in state]
    got = [(r.source_id, r.ord, r.type, r.original, r.suggestion, r.severity, r.confidence) for r in cd.unique_issues(df).collect()]
    assert sorted(got) == sorted(pushed)


def test_a_block_of_many_issues_falls_apart(spark):
    df = spark.range(20_000).selectExpr(
        "id as ord", "'image' as source_type", "'s' as source_id", "'b' as box_id", "'style' as type", "'low' as severity",
        "concat('w', lpad(cast(id div 2 as string), 6, '0'), if(id % 2 = 0, '', ' more')) as original", "concat('g', lpad(cast(id div 2 as string), 6, '0')) as suggestion",
        "'r' as reason", "0.5D as confidence", "false as is_definite", "cast(null as int) as span_start", "cast(null as int) as span_end", "'open' as status", "'x' as created_by")
    got = cd.clusters(df).groupBy(F.size("members").alias("n")).count().collect()
    assert [(r.n, r["count"]) for r in got] == [(2, 10_000)]


def _batches_by_loop(rows, most, budget):
    out, seen = {}, {}
    for g, o, cost in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        batch, n, total = seen.get(g, (0, 0, 0))
        if n and (n >= most or total + cost > budget):
            batch, n, total = batch + 1, 0, 0
        seen[g] = (batch, n + 1, total + cost)
        out[g, o] = batch
    return out


def test_budget_batches_equal_the_loop_at_any_chunk(spark, monkeypatch):
    import random

    from redpencil.operators import batches

    rnd = random.Random(2)
    rows = [(g, o, rnd.choice([1, 5, 30, 99, 200])) for g, n in (("a", 300), ("b", 41), (None, 90), ("c", 1)) for o in range(n)]
    df = spark.createDataFrame(rows, "g string, o int, cost long").repartition(5)
    want = _batches_by_loop(rows, 6, 150)
    for chunk in (16, 4096):
        monkeypatch.setattr(batches, "CHUNK", chunk)
        got = {(r.g, r.o): r.batch_id for r in batches.budget_batches(df, "g", ["o"], "cost", 6, 150).collect()}
        assert got == want


def test_near_duplicate_boxes_against_brute_force(spark):
    import random

    rnd = random.Random(9)
    rows = []
    for k in range(160):
        x, y = rnd.randrange(0, 60), rnd.randrange(0, 20)
        rows.append((rnd.choice("ab"), k, f"b{k}", rnd.choice(["Sale", "sale ", "Off"]), rnd.randrange(100) / 100,
                     (float(x), float(y), float(x + rnd.choice([4, 10, 40])), float(y + rnd.choice([5, 9])))))

    def ratio(p, q):
        w = max(0, min(p[2], q[2]) - max(p[0], q[0])) * max(0, min(p[3], q[3]) - max(p[1], q[1]))
        area = lambda b: max(1, b[2] - b[0]) * max(1, b[3] - b[1])
        return w / min(area(p), area(q))
    want = []
    for a in "ab":
        for key in ("sale", "off"):
            kept = []
            for r in rows:
                if r[0] == a and r[3].strip().lower() == key:
                    at = next((k for k, m in enumerate(kept) if ratio(m[3], r[5]) > .45), None)
                    if at is None:
                        kept.append([r[2], r[3], r[4], r[5]])
                    elif r[4] > kept[at][2]:
                        kept[at][1:] = [r[3], r[4], r[5]]
            want += [(a, m[0], m[1], m[2]) for m in kept]
    b = spark.createDataFrame(rows, "asset_id string, ord bigint, box_id string, text string, confidence double, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert sorted((r.asset_id, r.box_id, r.text, r.confidence) for r in bx.dedupe_boxes(b).collect()) == sorted(want)


def test_long_runs_of_overlapping_hits_settle_as_the_greedy_choice_does(spark):
    import random
    import time

    from redpencil.functions.exprs import HIT_TYPE
    from redpencil.operators.checker import spread

    rnd = random.Random(1)

    def run(n):
        hits = [(rnd.randrange(2 * n), rnd.randrange(0, 40)) for _ in range(n)]
        df = spark.createDataFrame([([(0, k, s, s + w, "", "") for k, (s, w) in enumerate(hits)],)], f"h array<{HIT_TYPE}>")
        start = time.time()
        got = [r.k for r in df.select(F.expr(spread("h")).alias("h")).first().h]
        taken, kept = time.time() - start, []
        free = []
        for k, (s, w) in enumerate(hits):
            if not any(a < s + w and s < b for a, b in free):
                free.append((s, s + w))
                kept.append(k)
        assert sorted(got) == kept
        return taken
    run(50)
    run(500)
    run(3000)
