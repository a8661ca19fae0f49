"""Quality: ordinal cumulative-link regression on hashed text with shared weights and ordered thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpencil.llm.common import arrow_rows, by_bytes
from redpencil.llm.features import codes, counted, labelled_sample, ngram_buckets

BITS = 16
SIZES = (2, 3)
PER_LABEL = 1000  # texts of each grade that the weights are fitted on
_SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def words_hashed(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (run of non-spaces), in order."""
    gap = np.isin(points, _SPACES)
    starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]]) if len(points) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.zeros(len(points), np.int64)
    first[starts] = starts
    inside = (np.arange(len(points)) - np.maximum.accumulate(first)).astype(np.uint64)
    mixed = (points.astype(np.uint64) + np.uint64(0x51)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed *= (inside + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
    mixed[gap] = 0
    return np.add.reduceat(mixed, starts)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and unit-length weights: words, character n-grams as written, and words that repeat the one before."""
    points = codes(text)
    words = words_hashed(points)
    at, n = counted([*ngram_buckets(points, SIZES, BITS), (words >> np.uint64(64 - BITS)).astype(np.uint32)], BITS)
    x = np.log1p(n)
    x /= np.sqrt((x * x).sum()) or 1.0
    again = float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0
    # one bucket beyond the hashed ones holds the share of repeats
    return np.append(at, 1 << BITS), np.append(x, again)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, epochs: int = 12, rate: float = 0.5,
        ridge: float = 1e-5, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights w and thresholds t, increasing: P(grade <= k) = sigmoid(t[k] - w.x). Adaptive gradient steps on the likelihood.

    The thresholds are the first one and the logarithms of the gaps after it, so their order cannot break.
    """
    w, seen = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-8)
    free, met = np.r_[-1.0, np.zeros(levels - 2)][:levels - 1], np.full(levels - 1, 1e-8)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            (at, x), y = rows[k], int(grades[k])
            t = np.cumsum(np.r_[free[0], np.exp(free[1:])])
            s = float(x @ w[at])
            low = _sigmoid(t[y - 1] - s) if y > 0 else 0.0
            high = _sigmoid(t[y] - s) if y < levels - 1 else 1.0
            p = max(high - low, 1e-9)
            d_low, d_high = low * (1 - low), high * (1 - high)
            g = (d_high - d_low) / p * x + ridge * w[at]  # of minus the log-likelihood
            seen[at] += g * g
            w[at] -= rate * g / np.sqrt(seen[at])
            d_t = np.zeros(levels - 1)
            if y > 0:
                d_t[y - 1] += d_low / p
            if y < levels - 1:
                d_t[y] -= d_high / p
            d_free = np.cumsum(d_t[::-1])[::-1] * np.r_[1.0, np.exp(free[1:])]
            met += d_free * d_free
            free -= 0.1 * d_free / np.sqrt(met)
    return w, np.cumsum(np.r_[free[0], np.exp(free[1:])])


def train(docs: DataFrame, rated: DataFrame | None = None, grade_col: str = "grade", id_col: str = "doc_id", text_col: str = "text",
          per_label: int = PER_LABEL) -> dict | None:
    """Fit on a bounded sample of the documents with a grade (any ordered numbers), whole texts; None without two grades.

    ``rated`` has id and grade; without it the documents carry the grade themselves.
    """
    taken = T.StructType([T.StructField("grade", T.DoubleType()), T.StructField("at", T.ArrayType(T.IntegerType())),
                          T.StructField("x", T.ArrayType(T.FloatType()))])
    made = T.StructType([T.StructField("grades", T.ArrayType(T.DoubleType())), T.StructField("thresholds", T.ArrayType(T.DoubleType())),
                         T.StructField("weights", T.ArrayType(T.FloatType()))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow_rows(([{"grade": g, "at": at.tolist(), "x": x.tolist()}
                            for t, g in zip(*(c.to_pylist() for c in batch.columns), strict=True) for at, x in [features(t)]]
                           for batch in by_bytes(batches)), taken)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades, data = [], []
        for batch in batches:
            grades += batch.column(0).to_pylist()
            data += [(np.asarray(a.as_py(), np.int64), np.asarray(v.as_py(), float)) for a, v in zip(batch.column(1), batch.column(2), strict=True)]
        levels = sorted(set(grades))
        if len(levels) > 1:
            w, t = fit(data, np.searchsorted(levels, grades), len(levels))
            yield from arrow_rows([[{"grades": levels, "thresholds": t.tolist(), "weights": w.tolist()}]], made)

    rows = labelled_sample(docs, docs if rated is None else rated, grade_col, "double", id_col, text_col, per_label)
    sample = rows.mapInArrow(hashed, taken)
    one = sample.repartition(1).sortWithinPartitions(F.xxhash64("at", "x"), "grade")  # a fixed order
    found = one.mapInArrow(learn, made).collect()
    if not found:
        return None
    return {"grades": np.array(found[0]["grades"]), "thresholds": np.array(found[0]["thresholds"]), "weights": np.array(found[0]["weights"], np.float32)}


def grade_one(text: str, model: dict, tail: float) -> tuple[float, float]:
    """Expected grade and the probability of a grade of at least ``tail``."""
    at, x = features(text)
    upto = np.r_[_sigmoid(model["thresholds"] - float(x @ model["weights"][at])), 1.0]
    p = np.diff(np.r_[0.0, upto])
    return float(p @ model["grades"]), float(p[model["grades"] >= tail].sum())


def rate(df: DataFrame, model: dict | None, tail: float, keep_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
         **more: Column) -> DataFrame:
    """id, the columns in ``more``, expected_grade, tail_probability (of a grade >= ``tail``) and kept, for each row's whole text.

    The model has a fixed size and is broadcast. Defined cases: a null text counts as empty and is
    graded by the thresholds alone; without a model expected_grade and tail_probability are null
    and every row is kept; repeated rows each get their row; other columns are not read.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).alias(id_col), *[c.alias(k) for k, c in more.items()],
                     F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("expected_grade", T.DoubleType()),
                           T.StructField("tail_probability", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = [(None, None) if held.value is None else grade_one(t, held.value, tail) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[1] is None or f[1] >= keep_from for f in found])], names=schema.names)

    return rows.mapInArrow(run, schema)
