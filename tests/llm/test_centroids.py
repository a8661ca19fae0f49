import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from redpencil.llm import centroids as ct


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 5), st.integers(0, 10_000), st.sampled_from([1, 3, 400]))
def test_threshold_walk_finds_the_nearest(k, dims, seed, spread):
    r = np.random.default_rng(seed)
    x, c = r.integers(-spread, spread + 1, (30, dims)), r.integers(-spread, spread + 1, (k, dims))
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    number, best = ct.nearest(x, c)
    assert number.tolist() == d.argmin(1).tolist() and best.tolist() == d.min(1).tolist()


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    cs = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for n in range(len(cs)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == n]
            if own:
                cs[n] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    placed = [(i, *near(v)) for i, v in kept]
    sha = lambda n: hashlib.sha256(",".join(map(str, cs[n])).encode()).hexdigest()
    return sorted(((i, n, d, sum(e for _, e, m in placed if m == n), sum(e for _, e, _ in placed), sha(n))
                   for i, d, n in placed), key=str)


R = np.random.default_rng(3)
ROWS = [(i, R.normal(0, 1, 4).round(2).tolist()) for i in range(40)] + [
    (7, [0.5] * 4), (7, [0.5] * 4), (None, [0.1] * 4), (100, None), (101, []), (102, [1.0] * 5), (103, [1.0, None, 1.0, 1.0]),
    (104, [math.nan, 0.0, 0.0, 0.0]), (105, [0.0, -math.inf, 0.0, 0.0]), (106, [-0.001, 0.0, 1e-9, -1e-9])]


@pytest.mark.parametrize(("rows", "k"), [(ROWS, 6), (ROWS, 200), (ROWS[:1], 3), ([], 3), (ROWS[43:45], 3)])
def test_clusters_against_brute_force(spark, rows, k):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    got = ct.cluster(df.repartition(3), k=k, rounds=4, dims=4).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k, 4, 4)


def test_too_wide_components_stop(spark):
    df = spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="limit"):
        ct.cluster(df, dims=1)
