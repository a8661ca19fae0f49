import numpy as np
from pyspark.sql import functions as F

from redpencil.llm import quality
from redpencil.llm.features import codes


def test_words_hash_by_content_wherever_they_stand():
    h = quality.words_hashed(codes("  ab cd\tab\n\nabc ab "))
    assert len(h) == 5 and h[0] == h[2] == h[4] and len(set(h.tolist())) == 3
    assert len(quality.words_hashed(codes(""))) == len(quality.words_hashed(codes(" \n"))) == 0


def test_gradient_lowers_the_loss_and_thresholds_stay_ordered():
    rng = np.random.default_rng(0)
    truth = rng.normal(size=40)
    rows, grades = [], []
    for _ in range(800):
        at = rng.choice(40, 8, replace=False)
        x = np.ones(8) / 8 ** 0.5
        rows.append((at, x))
        grades.append(int(np.digitize(x @ truth[at] + rng.logistic() * 0.2, [-0.8, 0.1, 0.9])))
    w, t = quality.fit(rows, np.array(grades), 4)
    assert (np.diff(t) > 0).all()
    s = np.array([x @ w[at] for at, x in rows])
    upto = np.c_[1 / (1 + np.exp(-(t[None, :] - s[:, None]))), np.ones(len(s))]
    expected = np.diff(np.c_[np.zeros(len(s)), upto], axis=1) @ np.arange(4)
    assert np.corrcoef(expected, grades)[0, 1] > 0.8


def test_held_out_grades(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rated = docs.select("doc_id", "text").join(labels.select("doc_id", F.col("quality").alias("grade")), "doc_id")
    model = quality.train(rated.where("doc_id % 4 <> 1"))
    got = quality.rate(rated.where("doc_id % 4 = 1"), model, tail=1, truth=F.col("grade")).toPandas()
    assert (got["kept"].astype(int) == got["truth"]).mean() > 0.94
    assert got["tail_probability"].between(0, 1).all() and got["expected_grade"].between(0, 1).all()


def test_edges(spark):
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "word " * 60_000), (None, "x")], "doc_id long, text string")
    odd = odd.withColumn("kept", F.lit("clash"))
    assert all(r.kept and r.expected_grade is None for r in quality.rate(odd, None, tail=1).collect())
    empty = spark.createDataFrame([], "doc_id long, text string, grade int")
    assert quality.train(empty) is None
    one = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "b", None)], "doc_id long, text string, grade int")
    assert quality.train(one) is None
    both = spark.createDataFrame([(i, "good text here" if i % 2 else "spam spam spam", i % 2) for i in range(60)], "doc_id long, text string, grade int")
    got = quality.rate(odd, quality.train(both), tail=1).collect()
    assert len(got) == 5 and all(0 <= r.tail_probability <= 1 for r in got)


def test_rated_texts_against_the_cumulative_link_written_out(spark):
    rng = np.random.default_rng(11)
    w = rng.normal(size=(1 << quality.BITS) + 1)
    model = {"grades": np.array([0, 1, 4]), "thresholds": np.array([-0.3, 0.9]), "weights": w}
    texts = ["one two two three", "", None, "été 中文 " * 30, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.rate(df, model, tail=1).collect():
        at, x = quality.features(texts[r.doc_id] or "")
        s = sum(float(v) * float(w[k]) for k, v in zip(at, x, strict=True))
        below = [1 / (1 + np.exp(-(t - s))) for t in (-0.3, 0.9)]  # P(grade <= 0), P(grade <= 1)
        share = [below[0], below[1] - below[0], 1 - below[1]]
        assert abs(r.expected_grade - (share[1] + 4 * share[2])) < 1e-9
        assert abs(r.tail_probability - (share[1] + share[2])) < 1e-9 and r.kept == (r.tail_probability >= 0.5)
