"""Queries of everything that grows by batches: the merged store, streams, the word index, the result cache."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import lexicon, table, view
from checks.tables import ISSUES, JOBS, documents, issues
from redpencil.operators import candidates as cd
from redpencil.operators import decisions as dc
from redpencil.operators import word_index as wi
from redpencil.operators.result_cache import ResultCache
from redpencil.session import shared_folder
from redpencil.streaming import stateful as sf
from redpencil.streaming.issue_store import IssueStore

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn
    return add


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _sliced(spark, df, parts: int = 3, files: int = 4):
    """The table as a file stream of ``parts`` batches in the order of ts."""
    folder = _folder(spark, "slices")
    low, high = df.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    part = F.least(F.floor((at - (low or 0)) * parts / max((high or 0) - (low or 0), 1)), F.lit(parts - 1))
    for k in range(parts):
        df.where(part == k).repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _through(stream, mode: str, name: str):
    """All rows that a stream puts out, with the epoch of each."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession, name)

    def write(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")
    q = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema, T.StructField("epoch", T.LongType())])).parquet(f"{folder}/out")


# -- J12 and T1: merge of rules and candidates ------------------------------------------

_CLASH = "(({a}.s < {b}.e and {b}.s < {a}.e) or ({a}.o = {b}.o and {a}.s = {b}.s))"
_RANK = "list_position(['critical', 'high', 'medium', 'low', 'suggestion', 'needs_review'], {x}.v)"
_BETTER = f"({{x}}.e - {{x}}.s > {{y}}.e - {{y}}.s or {_RANK.format(x='{x}')} < {_RANK.format(x='{y}')})"
_KEY = "workspace_id, source_type, source_id"
MERGED = f"""with recursive i as ({ISSUES}),
  r as (select *, {{'s': span_start, 'e': span_end, 'o': original}} as h from i where ord % 4 = 0),
  c as (select *, {{'s': span_start, 'e': span_end, 'o': original, 'v': severity, 'i': issue_id}} as h from i where ord % 4 <> 0),
  free as (select * from c where not exists (select 1 from r where r.workspace_id = c.workspace_id and r.source_type = c.source_type
    and r.source_id = c.source_id and {_CLASH.format(a='r.h', b='c.h')})),
  isl as (select *, sum(opens) over (partition by {_KEY} order by span_start, span_end, ord) as island from
    (select *, case when span_start < max(span_end) over (partition by {_KEY} order by span_start, span_end, ord
      rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from free)),
  k as (select {_KEY}, island, h, row_number() over (partition by {_KEY}, island order by ord) as k from isl),
  f(workspace_id, source_type, source_id, island, k, acc) as (
    select {_KEY}, island, k, [h] from k where k = 1 union all
    select k.workspace_id, k.source_type, k.source_id, k.island, k.k,
      case when len(list_filter(acc, lambda a: {_CLASH.format(a='a', b='k.h')})) = 0 then list_append(acc, k.h)
        else list_transform(acc, lambda y, n: case when n = list_position(list_transform(acc, lambda a: {_CLASH.format(a='a', b='k.h')}), true)
          and {_BETTER.format(x='k.h', y='y')} then k.h else y end) end
    from f join k on k.workspace_id = f.workspace_id and k.source_type = f.source_type and k.source_id = f.source_id
      and k.island = f.island and k.k = f.k + 1),
  done as (select unnest(acc) as h from f where (workspace_id, source_type, source_id, island, k) in (select {_KEY}, island, max(k) from k group by all)),
  ids as (select h.i as issue_id from done union all select issue_id from r)
  select issue_id, workspace_id, source_id, severity, span_start, span_end from i join ids using (issue_id)"""
_MERGED_COLUMNS = ["issue_id", "workspace_id", "source_id", "severity", "span_start", "span_end"]


@register("merge_issues", MERGED)
def _(spark, d):
    """Full merge with replacement among candidates."""
    i = issues(spark, d)
    return cd.merge_issues(i.where("ord % 4 = 0"), i.where("ord % 4 <> 0")).select(*_MERGED_COLUMNS)


@register("stream_merged_issues", MERGED)
def _(spark, d):
    """Rules and candidates arrive in three batches; the store holds the batch merge of all of them."""
    i = issues(spark, d).withColumn("origin", F.expr("if(ord % 4 = 0, 'rule', 'candidate')"))
    stream, folder = _sliced(spark, i), _folder(spark, "issue-store")
    store = IssueStore(spark, f"{folder}/store", i.schema, buckets=16)
    q = stream.writeStream.foreachBatch(store.write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return store.issues().select(*_MERGED_COLUMNS)


# -- T2: re-checks ----------------------------------------------------------------------

VERSIONS = """select concat('w', user_id % 20) as workspace_id, 'caption' as source_type, concat('d', cast(floor(user_id / 20) as bigint)) as source_id,
  concat('text of ', event_type) as text, event_id, ts from events"""
_CHANGED = f"""select workspace_id, source_id, event_id from (select *, lag(text) over (partition by workspace_id, source_id order by ts, event_id) as before
  from ({VERSIONS})) where before is null or before <> text"""


@register("changed_versions", _CHANGED)
def _(spark, d):
    return sf.recheck_batch(view(spark, d, VERSIONS, "events")).select("workspace_id", "source_id", "event_id")


@register("stream_changed_content", _CHANGED)
def _(spark, d):
    """A version is checked when it differs from the one before; A, B, A are three checks."""
    sf.use_keyed_state(spark)
    v = view(spark, d, VERSIONS, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _through(sf.recheck_stream(_sliced(spark, v)), "append", "versions").select("workspace_id", "source_id", "event_id")


# -- T3, T5: jobs -----------------------------------------------------------------------

_STALL = 86_400
_PROGRESS = "case phase when 'ocr' then 42 when 'caption_ai' then 58 when 'image_ai' then 72 when 'self_check' then 86 when 'merge' then 94 else 48 end"
_JOB_ENDS = f"""with e as (select *, epoch_ms(ts) as tm, coalesce(epoch_ms(lead(ts) over (partition by job_id order by ts)), (select max(epoch_ms(ts)) from ({JOBS}))) as nxt
    from ({JOBS})),
  k as (select *, case when phase = 'completed' then 1 when nxt - tm > {_STALL * 1000} then 2 end as kind from e),
  p as (select *, row_number() over (partition by job_id order by case when kind is null then 1 else 0 end, case when kind is null then -tm else tm end) as n from k)
  select job_id, phase, case kind when 1 then 'completed' when 2 then 'stalled' else 'running' end as status,
    case when phase = 'completed' then 96 when status = 'completed' then least(96, {_PROGRESS} + 6) else {_PROGRESS} end as progress from p where n = 1"""


@register("job_ends", _JOB_ENDS)
def _(spark, d):
    return sf.job_ends(view(spark, d, JOBS, "events"), _STALL).select("job_id", "phase", "status", "progress")


@register("stream_jobs", _JOB_ENDS)
def _(spark, d):
    """The last state that the stream reports of each job, silence included."""
    sf.use_keyed_state(spark)
    j = view(spark, d, JOBS, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _through(sf.job_states(_sliced(spark, j), _STALL, keep_seconds=400 * _STALL, event_time=True), "update", "jobs")
    # a job that has ended is not reported again, so its last row is the one of its end
    return out.groupBy("job_id").agg(F.max_by(F.struct("phase", "status", "progress"), F.struct(
        F.expr("status not in ('running')"), "epoch", "updated_at")).alias("s")).select("job_id", "s.*")


# -- T2 on lexicon change ---------------------------------------------------------------

_BENCH = "select distinct lower(word) as wrong from (select unnest(regexp_extract_all(text, '[a-zA-Z]+')) as word from benchmark)"
_HITS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@register("lexicon_recheck", f"""with k as ({_BENCH}), w as (select source as workspace_id, doc_id, unnest({_HITS}) as word from documents)
  select workspace_id, cast(doc_id as varchar) as source_id, count(*) as issues from w where word in (select wrong from k where length(wrong) > 3) group by all""")
def _(spark, d):
    """Words of three letters leave the lexicon and longer ones come; only texts that hold one of them are checked again."""
    words = table(spark, d, "benchmark").select(F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)")).alias("wrong")).distinct()
    rows = words.select(F.lit("product_terms").alias("list"), "wrong", F.lit("OK GO").alias("right"), F.lit(None).cast("string").alias("priority"),
                        F.lit(0).alias("ord"))
    old, new = rows.where("length(wrong) between 3 and 7"), rows.where("length(wrong) > 3")
    from redpencil.lexicon import Lexicon
    from redpencil.operators.checker import check
    c = documents(spark, d).select(F.col("source").alias("workspace_id"), F.lit("caption").alias("source_type"),
                                   F.col("doc_id").cast("string").alias("source_id"), "text")
    path = _folder(spark, "word-index")
    wi.build(c, path)
    before = _folder(spark, "issues-before")
    check(c, Lexicon(), {66}, table=old).write.parquet(before)
    now = wi.recheck(c, spark.read.parquet(before), wi.read(spark, path), Lexicon(), old, new, {66})
    return now.groupBy("workspace_id", "source_id").agg(F.count(F.lit(1)).alias("issues"))


# -- J21: cache fill --------------------------------------------------------------------

@register("cache_fill", r"""select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) as words,
  case when exists (select 1 from documents b where b.text = a.text and b.lang = a.lang and b.source in ('src0', 'src1', 'src2')) then 1 else 2 end as run from documents a""")
def _(spark, d):
    """A first run over three sources, then one over all; what the first computed the second reads."""
    from redpencil.functions import text as tx
    work = documents(spark, d).withColumn("h", F.sha2("text", 256)).withColumn("key", dc.cache_key("qa", "v1", "h", "lang")).select("doc_id", "text", "source", "key")
    cache = ResultCache(spark, _folder(spark, "cache"), T.StructType([T.StructField("words", T.IntegerType()), T.StructField("run", T.IntegerType())]))

    def compute(run: int):
        return lambda misses: misses.select("key", F.expr(tx.word_count("text")).cast("int").alias("words"), F.lit(run).alias("run"))
    cache.fill(work.where("source in ('src0', 'src1', 'src2')"), compute(1))
    return cache.fill(work, compute(2)).select("doc_id", F.col("words").cast("long").alias("words"), "run")
