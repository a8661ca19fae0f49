import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from redpencil.llm import decontamination as de
from redpencil.llm.fm_index import FmIndex, suffix_order


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_order(symbols):
    s = np.array([*symbols, 0])
    assert suffix_order(s).tolist() == sorted(range(len(s)), key=lambda k: s[k:].tolist())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=25), min_size=1, max_size=6), st.integers(1, 4), st.integers(0, 99))
def test_index_finds_every_occurrence(texts, n, seed):
    known = de._Numbers()
    flat = [known[w] for t in texts for w in t]
    built = FmIndex.build(np.array(flat, np.int64), np.array([len(t) for t in texts]), list(known))
    index = FmIndex.from_bytes(built.to_bytes())
    rng = np.random.default_rng(seed)
    asked = [[[b"a", b"b", b"c", b"z"][k] for k in rng.integers(0, 4, n)] for _ in range(20)]
    which, low, high = index.search(index.numbers(asked))
    got = {}
    for w, a, b in zip(which.tolist(), low.tolist(), high.tolist(), strict=True):
        text, at = index.locate(np.arange(a, b))
        got[w] = sorted(zip(text.tolist(), at.tolist(), strict=True))
    want = {w: [(x, k) for x, t in enumerate(texts) for k in range(len(t) - n + 1) if t[k:k + n] == p] for w, p in enumerate(asked)}
    assert got == {w: v for w, v in want.items() if v}


def brute(docs, items, n):
    split = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(i, w[k:k + n]) for i, t in items for w in [split(t)] for k in range(max(1, len(w) - n + 1)) if w]
    out = []
    for key, text in docs:
        w = split(text)
        hit, names = set(), set()
        for i, p in windows:
            for k in range(len(w) - len(p) + 1):
                if w[k:k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    names.add(i)
        listed = sorted(str(i) for i in names if i is not None)
        out.append((key, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


LONG = " ".join(f"w{k % 7}x" for k in range(900))
DOCS = [(1, "One two THREE four five six"), (2, None), (3, ""), (4, "... !!"), (5, "zero one two, three four; zero"), (5, "two three four"),
        (None, "naïve Été 中文 three"), (7, LONG), (8, "one two three four " * 40), (9, "four five six one two"), (1, "One two THREE four five six")]
ITEMS = [(10, "two three four five"), (2, "naïve ÉTÉ"), (3, None), (4, "--"), (5, "w3x w4x w5x w6x"), (10, "five six"), (None, "zero one two"),
         (12, "été 中文"), (13, "six one")]


@pytest.mark.parametrize(("shard", "block"), [(3, 1000), (4, 2), (10, 1000), (200, 3), (1 << 20, 1000)])
def test_contamination_against_brute_force(spark, shard, block):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in DOCS], "doc_id long, text string, n_words int, row int").repartition(2)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, phrase int")
    got = de.contamination(docs, items, n=3, shard_words=shard, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute(DOCS, ITEMS, 3)


def test_passages_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "Keep this. One  two, THREE four! And this"), (1, "one two"), (2, None)], "doc_id long, text string").withColumn("x", F.lit(1))
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    found = de.search(de.build_index(docs, 3), de.phrases(items, 3))
    got = sorted(de.cut_passages(docs, found).collect(), key=str)
    assert [tuple(r) for r in got] == [(1, "Keep this. ! And this", 1), (1, "one two", 1), (2, None, 1)]


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert de.contamination(docs.limit(0), items).count() == 0
    assert sorted(map(tuple, de.contamination(docs, items.limit(0)).collect()), key=str) == brute(DOCS, [], 10)
