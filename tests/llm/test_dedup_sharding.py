import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from redpencil.llm import exact_dedup, sharding

DOCS = [(1, "Same Text"), (2, "same text"), (3, "ÉTÉ"), (4, "été"), (5, None), (6, ""), (7, "same text"), (7, "same text"),
        (None, "alone"), (9, "x" * 200_000)]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))


def test_exact_groups_against_brute_force(spark):
    low = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    norm = lambda t: "".join(low.get(c, c) for c in t or "")
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs(spark), keep="max").collect()}
    assert len(got) == len({i for i, _ in DOCS})
    for i, t in DOCS:
        same = [j for j, u in DOCS if norm(u) == norm(t)]
        keep = max((j for j in same if j is not None), default=None)
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(same), i == keep)
        assert r.text_sha256 == hashlib.sha256(norm(t).encode()).hexdigest()


def test_bytes_decide_where_hashes_collide(spark):
    weak = lambda c: F.unhex(F.lpad(F.hex(F.length(c) % 2), 32, "0"))
    got = exact_dedup.exact_groups(docs(spark), keep="min", hash128=weak).collect()
    assert {r.doc_id: r.keep_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 1, None: None, 9: 9}


def test_drop_copies_keeps_columns_and_one_row_a_text(spark):
    out = exact_dedup.drop_copies(docs(spark), keep="max")
    assert out.columns == ["doc_id", "text", "kept"]
    assert Counter(r.doc_id for r in out.collect()) == Counter([7, 3, 4, 6, None, 9])
    assert exact_dedup.drop_copies(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_each_cell_once_and_moves_one_step(spark, n, bits):
    side = 1 << bits
    df = spark.range(side ** n).select(*[(F.floor(F.col("id") / side ** k) % side).cast("int").alias(f"c{k}") for k in range(n)])
    rows = df.withColumn("h", sharding.hilbert_index([F.col(f"c{k}") for k in range(n)], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(side ** n))
    for a, b in zip(rows, rows[1:], strict=False):
        assert sum(abs(a[k] - b[k]) for k in range(n)) == 1


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_are_even_and_gapless(spark, law):
    rows = [(i, None if i % 7 == 0 else f"src{0 if i % 3 == 0 else i % 11}", (i * 37) % 91, f"x{i}") for i in range(1003)]
    df = spark.createDataFrame(rows + [(None, "a", None, "n")], "doc_id long, source string, size long, curve string")
    got = sharding.hilbert_shards(df, 8, ["source", "size", "doc_id"], "size", law=law, carry=["curve"], partitions=5).toPandas()
    assert len(got) == 1004 and sorted(got["position"]) == list(range(1004))
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    weight = got.assign(rows=1).groupby("shard")["rows" if law == "rows" else "size"].sum()
    assert weight.max() - weight.min() <= (1 if law == "rows" else 2 * 91) and len(weight) == 8


def test_empty_table_gives_no_shards(spark):
    df = spark.createDataFrame([], "doc_id long, source string, size long")
    assert sharding.hilbert_shards(df, 8, ["source", "size"], "size").count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 5).alias("size"))
    dealt = sharding.hilbert_shards(df, 4, ["size", "doc_id"], "size")
    sharding.write_shards(df, dealt, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and back.select("shard").distinct().count() == 4
