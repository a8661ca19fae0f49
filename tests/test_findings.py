"""Cases that reviews of the registered queries brought up."""

from pyspark.sql import functions as F


def _documents(spark, folder, texts, files=2):
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    (spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
     .repartition(files).write.parquet(f"{folder}/documents.parquet"))
    return str(folder)


def test_streams_read_tables_of_many_files(spark, tmp_path):
    import __spark_entry__ as e

    d = _documents(spark, tmp_path, ["wow!! yes", "a ,, b", "calm", "four"])
    stale = e.queries()["stream_stale"](spark, d)
    assert {(r["source_id"], r["stale"]) for r in stale.collect()} == {(0, False), (1, False), (2, True), (3, True)}
    found = e.queries()["stream_fast_issues"](spark, d)
    assert {(r["source_id"], r["original"]) for r in found.collect()} == {("0", "!!"), ("1", ",,")}


def test_a_first_letter_stays_one_letter(spark):
    from redpencil.functions import text as tx

    rows = spark.createDataFrame([(c,) for c in "ßaéﬁᾳŉǆ"], "c string").select("c", F.expr(tx.upper_letter("c")).alias("u")).collect()
    assert {r["c"]: r["u"] for r in rows} == {"ß": "ẞ", "a": "A", "é": "É", "ﬁ": "ﬁ", "ᾳ": "ᾼ", "ŉ": "ŉ", "ǆ": "Ǆ"}


def test_chunks_cut_what_substring_cuts(spark):
    from redpencil.functions.exprs import chunks, cut, let

    text = "".join(chr(97 + i % 26) if i % 7 else "𝒳" for i in range(1500)) + "\n\r end"
    at = [(s, n) for s in (-3, 0, 1, 510, 511, 512, 513, 1023, 1024, 1400, len(text) - 1, len(text), len(text) + 9) for n in (0, 1, 2, 511, 512, 513, 2000)]
    df = spark.createDataFrame([(text, s, n) for s, n in at] + [("", 0, 1)], "text string, s int, n int")
    got = df.select(F.expr(let(chunks("text"), lambda p: cut(p, "text", "s", "n"))).alias("c"), F.expr("substring(text, s + 1, n)").alias("x"))
    assert [r for r in got.collect() if r["c"] != r["x"]] == []


def test_a_long_text_costs_its_length(spark):
    import time

    from redpencil.functions.exprs import chunks, cut, let, line_array, spans
    from redpencil.operators.dictionary import WORD_RUN, text_keys

    words = 100_000
    df = spark.createDataFrame([(0, "héllo \n" * words)], "id int, text string")
    start = time.time()
    got = df.select(F.expr(spans("text", WORD_RUN)).alias("w")).select(F.size("w").alias("n"), F.expr("w[99999]").alias("last")).first()
    assert (got["n"], got["last"]["s"], got["last"]["o"]) == (words, 7 * (words - 1), "héllo")
    assert df.select(F.expr(line_array("text")).alias("l")).select(F.expr("l[100000].s")).first()[0] == 7 * words
    keys = text_keys(df, ["id"]).agg(F.count(F.lit(1)), F.max("at")).first()
    assert tuple(keys) == (2 * words - 1, 7 * (words - 1))
    assert time.time() - start < 60  # pairs cut from the start of the text take minutes


def test_nodes_of_issues_are_not_sent_to_the_driver(spark):
    from redpencil.operators import candidates as cd

    df = spark.range(200).selectExpr(
        "id as ord", "'image' as source_type", "concat('s', id % 9) as source_id", "'b' as box_id", "concat('w', id % 20) as original",
        "concat('g', id % 4) as suggestion", "'low' as severity", "'style' as type", "'r' as reason", "0.5D as confidence", "'x' as created_by")
    # files of nodes compress so well that Spark takes large ones for small and broadcasts them
    for plan in (cd.clusters(df), cd.unique_issues(df)):
        plan.collect()
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_cropped_text_is_the_first_of_all_boxes(spark):
    import random

    from redpencil.operators import boxes as bx

    rnd = random.Random(5)
    layer = [(f"l{i}", f"a{i % 3}", f"d{i % 4}", rnd.choice([-30., 0., 60.]), rnd.choice([0., 55., 90.5]), rnd.choice([10., 200.3, 600., 0., -40.]),
              rnd.choice([20., 150.7, 800.]), rnd.choice(["cover", "contain"])) for i in range(120)]
    asset, board = [(f"d{k}", 200 + 90 * k, 300 + 7 * k) for k in range(4)], [(f"a{k}", 500. + 400 * k, 900.) for k in range(3)]
    box = []
    for i in range(400):
        x, y = rnd.random() * 260 + 40, rnd.random() * 250 + 40
        # most boxes lie inside, so the first one that is cut is often a late one
        box.append((f"d{i % 4}", f"b{i}", i * 37 % 401, rnd.random(), "text", (x, y, x + rnd.random() * 40, y + rnd.random() * 30)))
    box.append(("d0", "none", 0, .9, "text", (None, 1., None, 2.)))
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = bx.cropped_text(
        df(layer, "layer_id string, artboard_id string, asset_id string, x double, y double, width double, height double, fit_mode string"),
        df(asset, "asset_id string, width int, height int"),
        df(box, "asset_id string, box_id string, ord bigint, confidence double, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>"),
        df(board, "artboard_id string, width double, height double"))
    sizes, boards, want = {a: (w, h) for a, w, h in asset}, {a: (w, h) for a, w, h in board}, set()
    for lid, aid, did, x, y, w, h, fit in layer:
        (aw, ah), (bw, bh) = sizes[did], boards[aid]
        s = (max if fit == "cover" else min)(w / aw, h / ah)
        dx, dy = (aw * s - w) / 2, (ah * s - h) / 2
        for _, bid, _, _, _, bb in sorted((b for b in box if b[0] == did and b[3] >= .5), key=lambda b: b[2]):
            x0, y0, x1, y1 = (None if v is None else o + v * s - m for v, o, m in zip(bb, (x, y, x, y), (dx, dy, dx, dy), strict=True))
            lt, gt = (lambda a, b: a is not None and a < b), (lambda a, b: a is not None and a > b)
            crop = lt(x0, x) or lt(y0, y) or gt(x1, x + w) or gt(y1, y + h)
            if crop or lt(x0, 48) or lt(y0, 48) or (x1 is not None and bw - x1 < 48) or (y1 is not None and bh - y1 < 48):
                want.add((aid, lid, bid, "high" if crop else "medium"))
                break
    assert {tuple(r) for r in got.collect()} == want and len(want) > 60
    assert "asset_id" not in got.columns
    # a layer meets its asset's row, not its asset's boxes: 2,000 layers over 20,000 boxes that none of them cuts
    far = spark.range(20_000).selectExpr("'d' as asset_id", "string(id) as box_id", "id as ord", "0.9D as confidence", "'t' as text",
                                         "named_struct('x0', 90D + id % 100, 'y0', 90D, 'x1', 95D + id % 100, 'y1', 99D) as bbox")
    big = spark.range(20_000).selectExpr("string(id) as layer_id", "'a' as artboard_id", "'d' as asset_id", "0D as x", "0D as y", "500D as width", "500D as height", "'cover' as fit_mode")
    import time
    start = time.time()
    assert bx.cropped_text(big, df([("d", 500, 500)], "asset_id string, width int, height int"), far,
                           df([("a", 500., 500.)], "artboard_id string, width double, height double")).count() == 0
    assert time.time() - start < 20  # all pairs take minutes


def test_words_of_the_mixture_are_counted_once(spark, tmp_path):
    from redpencil.llm import queries as qs

    d = _documents(spark, tmp_path, ["a b  c", " ", "", "one\ttwo\n", "x"] * 4)
    got = qs.op4_hierarchical_mixing(spark, d)
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()
    plain = qs.mixed(spark.read.parquet(f"{d}/documents.parquet"))
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "epoch", "tokens", "taken").collect()))
    assert rows(got) == rows(plain) and {r["tokens"] for r in got.collect()} >= {3, 2, 1}


def test_counters_of_shingles_travel_as_blocks(spark):
    import numpy as np

    from redpencil.llm import jaccard as jc

    texts = [" ".join(f"w{(i * k) % 97}" for k in range(1, 90)) for i in range(40)] + ["", "one", "A b", "a B"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    want = np.zeros(1 << jc.COUNTER_BITS, np.int64)
    for t in texts:
        np.add.at(want, jc._counter(jc.shingles(t, 3)), 1)
    assert (jc.counters(df, 3) == want).all() and want.max() > 1
    assert not jc.counters(df.where("false"), 3).any()
    assert (jc._counts(np.array([0, 1, 300, 2**31 - 1], "<i4").view(np.uint8).reshape(-1, 4).T.tobytes()) == [0, 1, 300, 2**31 - 1]).all()
    counts = []
    real = type(df).mapInArrow

    def watched(self, fn, kind, *rest, **more):
        counts.append(real(self, fn, kind, *rest, **more))
        return counts[-1]
    type(df).mapInArrow = watched
    try:
        jc.counters(df, 3)
    finally:
        type(df).mapInArrow = real
    assert counts[0].count() <= 5 * (1 << jc.COUNTER_BITS) // jc.COUNTER_BLOCK


def test_issue_rows_do_not_carry_their_text(spark):
    from redpencil.lexicon import Lexicon
    from redpencil.operators.checker import check

    text = "𝒳" * 505 + " wow!!" + " é" * 600 + ",, end"
    df = spark.createDataFrame([("w", "caption", "s", text)], "workspace_id string, source_type string, source_id string, text string")
    found = check(df, Lexicon(), {57})
    rows = [(r["span_start"], r["context_before"], r["context_after"]) for r in found.orderBy("span_start").collect()]
    at = [text.index("!!"), text.index(",,")]
    assert rows == [(s, text[s - 12:s], text[s + 2:s + 14]) for s in at]
    generate = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Generate inline" in line]
    assert generate and all("text#" not in line for line in generate)


def test_the_word_index_holds_words_and_signs_of_texts_with_reserved_signs(spark):
    from redpencil.operators.word_index import words_of

    df = spark.createDataFrame([("w", "caption", "s", "One \ufdd0two\ufdd2 one-x")], "workspace_id string, source_type string, source_id string, text string")
    assert sorted(r["word"] for r in words_of(df).collect()) == ["-", "one", "two", "x", "\ufffd"]


def test_emoji_are_looked_for_where_they_can_be(spark):
    import time

    from redpencil.functions import text as tx
    from redpencil.functions.exprs import mark
    from redpencil.lexicon import Lexicon
    from redpencil.operators.span_rules import static_rules

    rule = next(r for r in static_rules(Lexicon()) if r.code == 540)
    df = spark.createDataFrame([("ab" * 1_000_000 + "x🔥 é™ 👍🏽",)], "text string").cache()

    def timed(pattern):
        start = time.time()
        got = df.select(F.expr(f"right({mark('text', pattern)}, 40)")).first()[0]
        return got, time.time() - start
    plain = rf"([\p{{L}}\p{{N}}.,!?;:])({tx.PICTOGRAPHIC})"
    timed(rule.pattern)
    (want, before), (got, after) = timed(plain), timed(rule.pattern)
    assert got == want and after < before / 2


def test_short_forms_start_with_the_letters_that_sql_takes(spark):
    from redpencil.operators.structure_rules import term_variants

    df = spark.createDataFrame([
        ("ſv và sinh viên",), ("ſv",), ("tp hcm, TP.HCM",), ("tp. hcm và thành phố",), ("nv, nhân viên, ıg, İG và Instagram",)], "text string")
    got = [[(h["s"], h["o"], h["g"]) for h in r[0]] for r in df.select(F.expr(term_variants("text", "lower(text)"))).collect()]
    assert got == [[(0, "ſv", "sinh viên")], [], [(0, "tp hcm", "TP.HCM")], [(0, "tp.", "thành phố")], [(0, "nv", "nhân viên")]]


def test_nodes_without_pairs_stay_out_of_the_rounds(spark, monkeypatch):
    from redpencil.operators import groups

    kept, sizes = groups.kept_rows, []

    def counted(df, name):
        out = kept(df, name)
        sizes.append((name, out.count()))
        return out
    monkeypatch.setattr(groups, "kept_rows", counted)
    nodes = spark.range(1000).withColumnRenamed("id", "node")
    pairs = spark.createDataFrame([(3, 1), (7, 3)], "a bigint, b bigint")
    got = {r["node"]: r["group"] for r in groups.connected(nodes, pairs).collect()}
    assert got == {n: 1 if n in (1, 3, 7) else n for n in range(1000)}
    assert all(n == 3 for name, n in sizes if name == "labels")
