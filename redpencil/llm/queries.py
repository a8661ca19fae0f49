"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redpencil.llm import (
    alignment, centroids, decontamination, exact_dedup, fingerprint, jaccard, langid, mixing, packing, quality, sharding, toxicity, warc)
from redpencil.llm.common import fold, scratch, stored

SHARDS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but toxic, 2 good and clean. A fifth of the ratings is held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.pmod(fold(F.col("doc_id")), F.lit(5)) == 3
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    rated = labels.where(~held_out & F.col("quality").isNotNull()).select("doc_id", grade.alias("grade"))
    model = quality.train(docs.where(~held_out), rated)
    return quality.rate(docs, model, tail=1, held_out=held_out)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn(
        "size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    narrow = docs.select("doc_id", "lang", "source", "size",
                         F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    dealt = sharding.hilbert_shards(narrow, SHARDS, ["lang", "source", "size", "doc_id"], "size", carry=["text_crc32"])
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")


# Shares of the mixture: domains, languages inside a domain, sources inside a language (1 unless named)
DOMAINS = {"web": 5.0, "books": 3.0, "code": 2.0}
LANGUAGES = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}


def domain() -> Column:
    """The domain of a source: its number decides, three tenths of the numbers are books and two code."""
    digit = F.substring(F.col("source"), -1, 1)
    return F.when(digit.isin("5", "6", "7"), "books").when(digit.isin("8", "9"), "code").otherwise("web")


def mixture_weight(path: tuple) -> float:
    return (DOMAINS if len(path) == 1 else LANGUAGES if len(path) == 2 else {}).get(path[-1], 1.0)


def mixed(docs: DataFrame, **counts) -> DataFrame:
    """As many tokens as the documents have, in the shares of the mixture, none more than four times."""
    levels = {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(docs, levels, mixture_weight, max_epochs=4, **counts)


def op4_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the passes of the operator read stored counts; the words of a text are counted once
    sized = stored(_table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", mixing.words_of(F.col("text")).alias("words")), "words")
    return mixed(sized, text_col="words", tokens=lambda words: words).select(
        "doc_id", F.element_at("mix_path", 1).alias("domain"), F.element_at("mix_path", 2).alias("lang"),
        F.element_at("mix_path", 3).alias("source"), "epoch", "tokens", "taken")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="max").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_trial(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.pmod(fold(F.col("doc_id")), F.lit(4)) == 2
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model, held_out=held_out)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


def _toxic_held_out() -> Column:
    return F.pmod(fold(F.col("doc_id")), F.lit(3)) == 1


def toxicity_model(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The machine, trained on the labelled documents outside the held-out third."""
    return toxicity.train(docs.where(~_toxic_held_out()), labels.where(~_toxic_held_out()))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, _table(spark, sf_dir, "labels")), held_out=_toxic_held_out())
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    files = warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, files, folder, with_payload=False).select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_key").cast("long").alias("refers_to"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = public_tokenizers.path
    return alignment.link_statistics(
        _table(spark, sf_dir, "documents"), file("byte_bpe_50k.json"), file("piece_bpe_32k.model"),
        file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_ordinal_quality": op1_ordinal_quality,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_hilbert_sharding": op3_hilbert_sharding,
    "op4_hierarchical_mixing": op4_hierarchical_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quartile_digest": op6_quartile_digest,
    "op7_language_id": op7_language_id,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_decontamination": op11_decontamination,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_token_alignment": op13_token_alignment,
}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_WORDS = rf"regexp_extract_all({_NORM}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_HITS = f"""
    with d as materialized (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
      b as materialized (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
      win as materialized (
        select distinct item, least(10, len(w)) as m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as g
        from b, range(1, greatest(len(w) - 10, 0) + 2) t(i) where len(w) > 0),
      sizes as (select distinct m from win),
      grams as (select r, i, m, array_to_string(w[i:i + m - 1], ' ') as g from d, sizes, range(1, len(w) - m + 2) t(i)),
      hits as materialized (select r, i, m, item from grams join win using (m, g)),
      words as (select r, count(distinct i + k) as n_hit from hits, range(0, m) t(k) group by r),
      items as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names from hits group by r)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
      sha256(coalesce(names, '')) as items_sha256, n_hit is not null as contaminated
    from d left join words using (r) left join items using (r)"""


def _clusters_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """The same rounds as a chain of common tables: a<n> assigns, c<n> moves the centroids."""
    steps = [f"""
        kept as materialized (
          select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
          from embeddings where len(embedding) = {dims}
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        c0 as materialized (select row_number() over (order by h, v) - 1 as c, v from (
          select sha256('2:' || coalesce(cast(vec_id as varchar), '')) as h, v from kept order by h, v limit {k}))"""]
    for n in range(rounds + 1):
        steps.append(f"""
        a{n} as materialized (
          select r, vec_id, v, min((d, c)) as m from (
            select kept.*, c, list_sum(list_transform(list_zip(kept.v, c{n}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
            from kept, c{n}) group by r, vec_id, v)""")
        if n < rounds:
            steps.append(f"""
        s{n} as (select m[2] as c, i, sum(v[i]) as s, count(*) as n from a{n}, range(1, {dims + 1}) t(i) group by all),
        m{n} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from s{n} group by c),
        c{n + 1} as materialized (select c, coalesce(m{n}.v, c{n}.v) as v from c{n} left join m{n} using (c))""")
    return f"""
        with {",".join(steps)}
        select vec_id, cast(m[2] as int) as cluster, cast(m[1] as bigint) as distance,
          cast(sum(m[1]) over (partition by m[2]) as bigint) as cluster_inertia, cast(sum(m[1]) over () as bigint) as inertia,
          sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256
        from a{rounds} join c{rounds} on c = m[2]"""


ORACLE_SQL = {
    "op11_decontamination": _HITS,
    "op12_centroid_clustering": _clusters_sql(),
    "op5_exact_dedup": f"""
        with n as (select doc_id, {_NORM} as norm from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
          doc_id = max(doc_id) over w as kept, sha256(norm) as text_sha256
        from n window w as (partition by norm)""",
    "op10_warc": """
        with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages),
          f as (select *, min(page_id) over (partition by body) as first_id from p)
        select page_id, cast(octet_length(encode(body)) as bigint) as payload_bytes,
          array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            cast(1 + ((cast(('0x' || substr(h, cast(1 + 5 * (i // 4) as bigint), 5)) as bigint) >> cast(15 - 5 * (i % 4) as int)) & 31) as bigint),
            1)), '') as payload_digest,
          case when page_id = first_id then 'response' else 'revisit' end as record_type,
          case when page_id <> first_id then first_id end as refers_to
        from f""",
}
