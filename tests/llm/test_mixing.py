import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from redpencil.llm import mixing


def test_shortages_go_to_siblings_before_ancestors():
    weight = lambda p: {("a",): 1, ("b",): 1}.get(p, 1)
    caps = {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}
    assert mixing.budgets(caps, weight, 400) == {("a", "x"): 10, ("a", "y"): 190, ("b", "z"): 200}
    caps[("a", "y")] = 50  # now all of a is short, and b takes over
    assert mixing.budgets(caps, weight, 400) == {("a", "x"): 10, ("a", "y"): 50, ("b", "z"): 340}
    assert mixing.budgets(caps, weight, 10_000) == caps and mixing.budgets({}, weight, 5) == {}
    none = mixing.budgets(caps, lambda p: 0 if p == ("b",) else 1, 400)
    assert none[("b", "z")] == 0 and sum(none.values()) == 60


@pytest.mark.parametrize("seed", range(5))
def test_budgets_against_small_steps(seed):
    rng = random.Random(seed)
    caps = {(d, s): rng.randint(0, 300) for d in "abc" for s in "xyz"[:rng.randint(1, 3)]}
    w = {p: rng.randint(1, 5) for p in [*caps, *{(d,) for d, _ in caps}]}
    total = rng.randint(1, sum(caps.values()))
    got = mixing.budgets(caps, w.get, total)
    assert sum(got.values()) == total
    # pour in tiny drops: each node passes a drop to the open child that is furthest behind its weight
    have: dict = defaultdict(float)
    drop = total / 20_000
    room = lambda p: sum(c - have[q] for q, c in caps.items() if q[:len(p)] == p) > drop / 2
    for _ in range(20_000):
        d = min((p for p in {(q[0],) for q in caps} if room(p)), key=lambda p: have[p] / w[p])
        s = min((q for q in caps if q[:1] == d and room(q)), key=lambda q: have[q] / w[q])
        have[d] += drop
        have[s] += drop
    assert all(abs(have[p] - got[p]) < 2 + total * 0.003 for p in caps)


def docs(spark, n=3000):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)) or None, "en" if i % 3 else "fr", "hot" if i % 2 else f"s{i % 5}") for i in range(n)]
    return spark.createDataFrame([*rows, (None, "no id\there ", None, None), (5, "repeated row", "en", "hot")],
                                 "doc_id long, text string, lang string, source string").withColumn("epoch", F.lit("clash"))


def test_selection_follows_the_budgets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    df = docs(spark)
    weight = lambda p: {("fr",): 4.0, ("en",): 1.0, ("",): 1.0}.get(p, 1.0)
    out = mixing.cut_texts(mixing.mix(df, {"l": F.col("lang"), "s": F.col("source")}, weight, max_epochs=3)).collect()
    tokens = lambda t: len((t or "").split())
    supply, taken, texts = Counter(), Counter(), defaultdict(list)
    for r in df.collect():
        supply[(r.lang or "", r.source or "")] += tokens(r.text)
    for r in out:
        taken[tuple(r.mix_path)] += r.taken
        assert tokens(r.text) == r.taken <= r.tokens
        texts[(tuple(r.mix_path), r.epoch)].append(r)
    goal = mixing.budgets({p: 3 * n for p, n in supply.items()}, weight, sum(supply.values()))
    assert {p: n for p, n in goal.items() if n} == dict(taken)
    for (path, epoch), rows in texts.items():
        assert sum(r.taken < r.tokens for r in rows) <= 1
        if epoch < goal[path] // supply[path]:
            assert sum(r.tokens for r in rows) == supply[path]


def test_a_prefix_of_a_seeded_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    df = docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    take = lambda n: {r.doc_id for r in mixing.mix(df, {"all": F.lit("x")}, lambda p: 1.0, n).where("taken > 0").collect()}
    small, large = take(1000), take(9000)
    assert small < large and len(take(1000) ^ small) == 0


def test_edges(spark):
    df = docs(spark)
    level = {"l": F.col("lang")}
    assert mixing.mix(df.limit(0), level, lambda p: 1.0).count() == 0
    assert mixing.mix(df, level, lambda p: 0.0).count() == 0
    long = spark.createDataFrame([(1, " a\n" * 100_000)], "doc_id long, text string")
    one = mixing.cut_texts(mixing.mix(long, {"x": F.lit(None)}, lambda p: 1.0, 70_000)).first()
    assert one.taken == 70_000 and len(one.text.split()) == 70_000 and one.text.startswith(" a\n a")


def test_columns_of_any_name_pass_through(spark):
    names = ["path", "leaf", "full", "rest", "buckets", "cut", "before", "sum", "c", "rows"]
    df = spark.createDataFrame([(k, "a b c", "s" + str(k % 2)) for k in range(9)], "doc_id long, text string, source string")
    wide = df.select("*", *[F.lit(n).alias(n) for n in names])
    got = mixing.mix(wide, {"source": F.col("source")}, lambda p: 2.0 if p[-1] == "s1" else 1.0, total_tokens=20).collect()
    plain = mixing.mix(df, {"source": F.col("source")}, lambda p: 2.0 if p[-1] == "s1" else 1.0, total_tokens=20).collect()
    key = lambda rows: sorted((r.doc_id, r.epoch, r.taken) for r in rows)
    assert key(got) == key(plain) and all(r[n] == n for r in got for n in names)
