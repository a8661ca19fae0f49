import hashlib

import pytest
from pyspark.sql import functions as F

from redpencil.llm import fingerprint as fp

ROWS = [(3, "b" * 50 + " the quick brown fox"), (1, "été 中文\U0001F600 " * 9), (2, None), (5, ""), (4, "abc"), (9, "lorem ipsum " * 20_000),
        (4, "abd"), (None, "no id here")]


def brute(rows):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    ties = {t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] for t in {t or "" for _, t in rows}}
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]]))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[:len(t) - q] + nxt[:q]
        f = [fp.digest(x.encode()) for x in (t, e, nxt)]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f[0], f[1], fp.likeness(f[0], f[1]), fp.likeness(f[0], f[2])))
    return sorted(out, key=str)


@pytest.mark.parametrize(("rows", "partitions"), [(ROWS, 1), (ROWS, 3), (ROWS, 40), (ROWS[:1], 4), ([], 4)])
def test_trial_against_brute_force(spark, rows, partitions):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit("clash"))
    got = fp.edit_trial(df, partitions=partitions).toPandas()
    assert sorted([(None if i != i else i, *r) for i, *r in got.itertuples(index=False, name=None)], key=str) == brute(rows)


def test_likeness_is_bounded_and_ranks_edits(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(150).collect()]
    better = 0
    for a, b in zip(docs, docs[1:], strict=False):
        x, y = fp.digest(a.encode()), fp.digest(b.encode())
        e = fp.digest((a[:len(a) - len(a) // 4] + b[:len(a) // 4]).encode())
        assert 0 <= fp.likeness(x, y) <= 1 and fp.likeness(x, x) == 1 and fp.likeness(x, y) == fp.likeness(y, x)
        better += fp.likeness(x, e) > fp.likeness(x, y)
    assert better >= 0.97 * (len(docs) - 1)


def test_fingerprints_of_equal_texts_are_equal(spark):
    df = spark.createDataFrame([(1, "x y"), (2, "x y"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(df).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[1] != got[3] and len(got[1]) == 2 + 128
