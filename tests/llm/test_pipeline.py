from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from test_jaccard import brute
from tokenizers import Tokenizer

import corpus_pipeline
from redpencil.llm import mixing, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
        assert k == len(corpus_pipeline.STAGES) - 1 or tables[-1].columns == columns
    rows = [{(r.doc_id, r.text) for r in t.collect()} for t in tables[:4]]

    model = queries.toxicity_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    listed = sorted(rows[0])
    p = toxicity.probabilities([t or "" for _, t in listed], model)
    assert rows[1] == {r for r, q in zip(listed, p, strict=True) if q < 0.7}

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first: dict = {}
    for i, t in sorted(rows[1]):
        first.setdefault((t or "").translate(low), (i, t))
    assert rows[2] == set(first.values())

    found = brute(sorted(rows[2]), 5, 4, 5)
    assert rows[3] == {r for r in rows[2] if found[r[0]][1] == r[0]}

    tokens = lambda t: len((t or "").split())
    supply, taken = Counter(), Counter()
    path = F.array(queries.domain(), F.col("lang"), F.col("source")).alias("path")
    for r in tables[3].select("text", path).collect():
        supply[tuple(r.path)] += tokens(r.text)
    for r in tables[4].select("text", "n_chars", path).collect():
        taken[tuple(r.path)] += tokens(r.text)
        assert r.n_chars == len(r.text)
    goal = mixing.budgets({p: 4 * n for p, n in supply.items()}, queries.mixture_weight, sum(supply.values()))
    assert {p: n for p, n in goal.items() if n} == {p: n for p, n in taken.items() if n}

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, len(whole.encode(r.text, add_special_tokens=False).ids) + 1) for r in tables[4].collect())
    packed = tables[5].toPandas()
    assert packed["length"].sum() == sum(n * c for (_, n), c in want.items())
    fill = packed.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 4096 and len(fill) <= 1.02 * -(-int(fill.sum()) // 4096) + 1


def test_stages_take_odd_and_empty_tables(spark):
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "src1", 0), (3, "word " * 30_000, "fr", "src5", 150_000), (3, "word " * 30_000, "fr", "src5", 150_000),
         (None, "no id", "de", "src0", 5), (4, "Same Text", "en", "src2", 9), (5, "same text", "en", None, 9)],
        "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= 100
            assert docs is odd or out.isEmpty()
