"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpencil.llm.common import arrow_rows, by_bytes
from redpencil.llm.features import bounded_sample, codes, counted, letters, ngram_buckets

BITS = 15
SIZES = (1, 2, 3)
PER_LABEL = 800  # documents of each language that the weights are fitted on
UNKNOWN = "und"


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    return counted(ngram_buckets(codes(letters(text)), SIZES, BITS), BITS)


def _weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    return x / (np.sqrt((x * x).sum()) or 1.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """Follow the regularised leader, one learning rate a coordinate, elastic-net penalty."""

    def __init__(self, width: int, classes: int, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05) -> None:
        self.z, self.n = np.zeros((width, classes)), np.zeros((width, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def step(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        miss = softmax(x @ w)
        miss[label] -= 1
        g = x[:, None] * miss
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that makes held-back labels likeliest."""
    if not len(labels):
        return 1.0
    tries = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in tries]
    return float(tries[int(np.argmin(loss))])


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[str], idf: np.ndarray, epochs: int = 4, seed: int = 7) -> dict:
    """Weights, classes and temperature; every fifth document is held back for the temperature."""
    names = sorted(set(labels))
    y = np.array([names.index(v) for v in labels])
    rows = [_weighted(at, n, idf) for at, n in docs]
    order, back = np.random.default_rng(seed), np.arange(len(rows)) % 5 == 4
    model = Ftrl(len(idf), len(names))
    for _ in range(epochs):
        for k in order.permutation(np.flatnonzero(~back)):
            model.step(docs[k][0], rows[k], int(y[k]))
    w = model.weights()
    logits = np.array([rows[k] @ w[docs[k][0]] for k in np.flatnonzero(back)]).reshape(-1, len(names))
    return {"names": names, "weights": w, "temperature": calibrate(logits, y[back])}


def document_frequencies(texts: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many of them each bucket occurs: over all rows given.

    Each task adds up its own rows and sends one number for a bucket; the driver gets 2^BITS.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in by_bytes(batches):
            for text in batch.column(0).to_pylist():
                df[_grams(text)[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([-1, *at], pa.int64()), "n": pa.array([n, *df[at]], pa.int64())})

    rows = texts.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BITS)
    found = rows[rows["bucket"] >= 0]
    df[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return int(rows.loc[rows["bucket"] < 0, "n"].sum()), df


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_label: int = PER_LABEL) -> dict | None:
    """Fit on rows with a text and a language; None if there are none.

    Document frequencies cover every row; the weights are fitted on at most about ``per_label``
    documents of each language (whole texts), in one task.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    n, df = document_frequencies(rows, "text")
    if n == 0:
        return None
    idf = np.log((1 + n) / (1 + df)) + 1
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("at", T.ArrayType(T.IntegerType())),
                           T.StructField("n", T.ArrayType(T.IntegerType()))])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[list[dict]]:
            for batch in by_bytes(batches):
                yield [{"lang": lang, "at": at.tolist(), "n": k.astype(int).tolist()}
                       for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True) for at, k in [_grams(text)]]
        return arrow_rows(made(), schema)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, labels = [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            docs += [(np.asarray(a.as_py(), np.int64), np.asarray(k.as_py(), float)) for a, k in zip(batch.column(1), batch.column(2), strict=True)]
        if docs:
            model = fit(docs, labels, idf)
            at = np.flatnonzero(model["weights"].any(1))
            yield from arrow_rows([[{"name": name, "at": at.tolist(), "w": model["weights"][at, c].tolist(), "t": model["temperature"]}
                                    for c, name in enumerate(model["names"])]], out)

    out = T.StructType([T.StructField("name", T.StringType()), T.StructField("at", T.ArrayType(T.IntegerType())),
                        T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("t", T.DoubleType())])
    sample = bounded_sample(rows, "lang", "id", per_label).select("text", "lang").mapInArrow(grams, schema)
    # a fixed order, so that a repeated task learns the same weights
    one = sample.repartition(1).sortWithinPartitions(F.xxhash64("at", "n"), "lang")
    found = sorted(one.mapInArrow(learn, out).collect())
    if not found:
        return None
    weights = np.zeros((1 << BITS, len(found)), np.float32)
    for c, row in enumerate(found):
        weights[row["at"], c] = row["w"]
    return {"names": [r["name"] for r in found], "weights": weights, "temperature": found[0]["t"], "idf": idf.astype(np.float32)}


def predict_one(text: str | None, model: dict | None) -> tuple[str, float]:
    if model is None or text is None or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    at, n = _grams(text)
    p = softmax((_weighted(at, n, model["idf"]) @ model["weights"][at]) / model["temperature"])
    best = int(np.argmax(p))
    return model["names"][best], float(p[best])


def identify(df: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """id, the columns in ``more``, lang_pred and score (calibrated probability) for each row.

    The model has a fixed size (2^BITS buckets by languages) and is broadcast. Defined cases: a
    null text or one without a letter is ``und`` with score 0, as is every text where nothing
    could be learned; repeated rows each get their row; other columns are not read.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).alias(id_col), *[c.alias(k) for k, c in more.items()], F.col(text_col).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            found = [predict_one(t, held.value) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return rows.mapInArrow(predict, schema)
