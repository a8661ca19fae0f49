import numpy as np
from pyspark.sql import functions as F

from redpencil.llm import langid


def test_held_out_accuracy_and_undecided_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = langid.train(docs.where(part != 2), per_label=60)
    got = langid.identify(docs.where(part == 2), model, truth=F.col("lang")).toPandas()
    assert (got["lang_pred"] == got["truth"]).mean() > 0.97 and got["score"].between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, "123 !?"), (3, ""), (4, "the the and " * 50_000), (None, "und der die")],
                                "doc_id long, text string").withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit(2))
    said = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [said[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and said[4].lang_pred == "en" and len(said) == 5


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([(1, None, "en"), (2, "text", None)], "doc_id long, text string, lang string")
    assert langid.train(empty) is None and langid.train(empty.limit(0)) is None
    assert [r.lang_pred for r in langid.identify(empty, None).collect()] == ["und", "und"]


def test_document_frequencies_against_brute_force(spark):
    texts = ["abc", "abd abd", "", "Äbc!", "abc"]
    n, df = langid.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    want = np.zeros(1 << langid.BITS)
    for t in texts:
        want[langid._grams(t)[0]] += 1
    assert n == 5 and (df == want).all()


def test_penalty_leaves_few_weights_and_temperature_fits():
    rng = np.random.default_rng(1)
    model = langid.Ftrl(50, 2, l1=0.5)
    for _ in range(400):
        y = int(rng.integers(2))
        at = np.array([y, *rng.choice(np.arange(2, 50), 5, replace=False)])
        model.step(at, np.ones(6) / 6 ** 0.5, y)
    w = model.weights()
    assert (np.abs(w[:2]).max(1) > 0.3).all() and (w[2:] == 0).mean() > 0.3
    logits = rng.normal(size=(4000, 3))
    p = langid.softmax(logits / 2.5)
    labels = np.array([rng.choice(3, p=q) for q in p])
    assert 2 < langid.calibrate(logits, labels) < 3.2
