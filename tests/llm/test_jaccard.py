import random
import re

import pytest
from pyspark.sql import functions as F

from redpencil.llm import jaccard
from redpencil.llm.components import components


def brute(rows, words, num, den):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    sets = {i: grams(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and shared * den >= len(sets[a] | sets[b]) * num:
                u, v = sorted((find(a), find(b)))
                top[v] = u
    return {i: (len(sets[i]), find(i)) for i in ids}


def texts(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    common = [rng.choice(vocab) for _ in range(25)]
    rows, base = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35 or not base:
            w = [rng.choice(vocab) for _ in range(rng.randint(1, 60))]
            if rng.random() < 0.5:
                w += common
            base.append(w)
        else:  # edits of earlier texts, most of one of them
            w = list(base[0] if rng.random() < 0.5 else rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w = w[rng.randint(0, 2):] or w
        rows.append((i * 3, " ".join(x.upper() if rng.random() < 0.2 else x for x in w)))
    return rows


@pytest.mark.parametrize(("seed", "words", "num", "den"), [(1, 3, 90, 100), (2, 5, 4, 5), (3, 1, 1, 2)])
def test_components_against_brute_force(spark, seed, words, num, den):
    rows = [*texts(seed), (10_001, None), (10_002, ""), (10_003, " \t\n"), (10_004, "One two"), (10_005, "one\x0btwo"), (10_006, "one"),
            (10_007, "long " * 30_000), (10_008, "é É x"), (10_009, "é é x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(7)
    got = jaccard.jaccard_components(df, words, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, words, num, den)
    assert len(got) == len(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "A b c d e f"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == {(5, 5), (None, None), (9, 5), (7, 7)}
    kept = jaccard.keep_representatives(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["5", "5", "7", "None"]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    links = [*chain, *[(7, k) for k in range(20, 60)], (1, 2), (2, 1), (3, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 7 for k in range(20, 60)) and got[2] == 1
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_follow_the_words():
    h = jaccard.word_hashes("Ab ab\tAB x ab")
    assert h[0] == h[1] == h[3] and h[2] != h[0] and len(h) == 4


def test_an_id_of_two_unlike_texts_keeps_the_links_of_both(spark):
    one, two = "alpha beta gamma delta epsilon zeta eta theta iota kappa", "red orange yellow green blue indigo violet black white grey"
    rows = [(1, one), (1, two), (3, two + " pink"), (4, one + " lambda"), (9, one), (5, "alone here"), (2, two)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, words=1, num=1, den=2).collect())
    assert got == sorted([(1, 10, 1), (1, 10, 1), (3, 11, 1), (4, 11, 1), (9, 10, 1), (5, 2, 5), (2, 10, 1)])
    kept = jaccard.keep_representatives(df.where("doc_id <> 9"), words=1, num=1, den=2)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, one), (1, two), (5, "alone here")])


def test_texts_travel_in_small_batches(spark, monkeypatch):
    key, seen, whole = "spark.sql.execution.arrow.maxRecordsPerBatch", [], jaccard.stored

    def noted(df, name):
        seen.append(int(spark.conf.get(key)))
        return whole(df, name)
    monkeypatch.setattr(jaccard, "stored", noted)
    before = spark.conf.get(key)
    jaccard.keep_representatives(spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "d")], "doc_id long, text string")).collect()
    assert seen and max(seen) <= 256 and spark.conf.get(key) == before


@pytest.mark.parametrize("block", [200_000, 900])
def test_all_links_are_counted(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # components of one block, and of many
    rows = [*texts(4, 90), (9_001, None), (9_002, "alone")]
    rows += [(9_100 + k, rows[0][1].lower()) for k in range(3)]
    sets = {i: frozenset(jaccard.shingles(t or "", 3).tolist()) for i, t in rows}
    linked = lambda a, b: bool(a) and 100 * len(a & b) >= 60 * len(a | b)
    want = {i: sum(linked(a, b) for j, b in sets.items() if j != i) for i, a in sets.items()}
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 60, 100).collect()
    assert {r.doc_id: r.n_links for r in got} == want and max(want.values()) > 9
