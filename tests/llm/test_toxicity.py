import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from redpencil.llm import toxicity as tox


def slow_kernel(a, b):
    """Sum over shared triples, in the open."""
    def features(word):
        out = {}
        ids = [1] + [int(tox._CLASS[ord(c) & 0xFFFF]) for c in word] + [2]
        for i, j, k in combinations(range(len(ids)), 3):
            if k - i < tox.SPAN:
                key = (ids[i], ids[j], ids[k])
                out[key] = out.get(key, 0) + tox.DECAY ** (k - i + 1)
        return out
    x, y = features(a), features(b)
    dot = lambda u, v: sum(w * v.get(k, 0) for k, w in u.items())
    return dot(x, y) / max(dot(x, x), tox.DECAY ** 6) ** 0.5 / max(dot(y, y), tox.DECAY ** 6) ** 0.5


def test_kernel_and_folded_machine_against_brute_force():
    words = ["idiot", "idxiot", "banana", "ab", "a", "chllaente", "éèéè12"]
    marks = ["idiot", "banana", "stone"]
    want = np.array([[slow_kernel(a, b) for b in marks] for a in words])
    assert np.allclose(tox.kernel(words, marks), want, atol=1e-6)
    mix = np.array([0.5, -1.0, 2.0])
    assert np.allclose(tox.decide(words, tox.fold_in(marks, mix), 0.25), want @ mix + 0.25, atol=1e-4)


def test_words_are_found_through_gaps_and_marks():
    assert "idiot" in {u for c in tox.chunks("You I D I O T, okay") for u in tox.units(c)}
    assert tox.units("i-d.i*o_t!!") == ["idiot"] and tox.units("***") == []
    assert all(len(u) <= tox.LONGEST for u in tox.units("ab" * 50_000)) and len(tox.units("ab" * 50)) > 5


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    parts = ["an", "er", "tion", "lo", "mi", "ra", "se", "th", "ou", "de", "ka", "pe"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(rng.randint(20, 60))]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["scumbag", "idiot", "moron"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_texts_and_changed_insults(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string, toxic int")
    model = tox.train(df.where("doc_id % 3 <> 1"))
    got = tox.score(df.where("doc_id % 3 = 1"), model, truth=F.col("toxic")).toPandas()
    assert (got["score"] >= 0.7).astype(int).eq(got["truth"]).mean() > 0.98
    p = tox.probabilities(["an idiot tion", "an id-iot tion", "an i d i o t tion", "an idiiot tion", "an tion er", ""], model)
    assert (p[:4] >= 0.7).all() and (p[4:] < 0.3).all()


def test_edges(spark, corpus):
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "!!!"), (4, "an tion " * 40_000), (None, "idiot")],
                                "doc_id long, text string").withColumn("score", F.lit("clash"))
    assert {r.score for r in tox.score(odd, None).collect()} == {0.0}
    empty = spark.createDataFrame([], "doc_id long, text string, toxic int")
    assert tox.train(empty) is None
    one_sided = tox.train(spark.createDataFrame([(1, "all clean", 0), (2, None, 0), (3, "no label", None)], "doc_id long, text string, toxic int"))
    assert all(r.score < 0.7 for r in tox.score(odd, one_sided).collect())
    model = tox.train(spark.createDataFrame(corpus, "doc_id long, text string, toxic int"))
    kept = tox.drop_toxic(odd, model)
    assert kept.columns == odd.columns and sorted(r.text or "" for r in kept.collect())[:2] == ["", ""] and kept.count() == 5
