"""Which texts hold which words: a changed lexicon re-checks only the texts it can touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redpencil.functions import text as tx
from redpencil.functions.exprs import lit
from redpencil.lexicon import Lexicon
from redpencil.operators.checker import check
from redpencil.operators.dictionary import SIGN, WORD_RUN, table_entries

KEYS = ["workspace_id", "source_type", "source_id"]
BUCKETS = 64


def _bucket():
    return F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket")


def words_of(content: DataFrame) -> DataFrame:
    """(keys, word): each distinct word and sign of each text, in the letter case that lexicons are compared in."""
    all_ = f"array_distinct(concat(regexp_extract_all(low, {lit(WORD_RUN)}, 0), regexp_extract_all(low, {lit(SIGN)}, 0)))"
    return content.select(*KEYS, F.expr(tx.folded(tx.strip_reserved("text"))).alias("low")).select(*KEYS, F.explode(F.expr(all_)).alias("word"))


def build(content: DataFrame, path: str) -> None:
    """Write the index of ``content``: workspace_id, source_type, source_id, text.  Buckets of words are folders."""
    words_of(content).select(*KEYS, "word", _bucket()).repartition("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(16))).write.partitionBy(
        "bucket").mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def touched(index: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The texts whose issues can differ under ``new``: those with the first word of an entry that only one lexicon has.

    Entries are compared as the checker reads them, so a term that changes how another one is typed
    or cased counts as a change of that one.
    """
    a, b = (table_entries(t).select("c", "o", "ord", "w", "g", "p", "key", "lead", "first") for t in (old, new))
    changed = a.exceptAll(b).unionByName(b.exceptAll(a)).select(F.col("first").alias("word")).distinct()
    # the bucket in the join lets Spark open only the folders of changed words
    return index.join(changed.select("word", _bucket()), ["bucket", "word"], "left_semi").select(*KEYS).distinct()


def recheck(content: DataFrame, issues: DataFrame, index: DataFrame, lex: Lexicon, old: DataFrame, new: DataFrame,
            rules: set[int] | None = None) -> DataFrame:
    """The issues of ``content`` under the lexicon table ``new``, from those under ``old``: equal to a full check.

    ``issues`` and ``index`` belong to the same texts; ``lex`` is the program's own lexicon, unchanged.
    """
    hit = touched(index, old, new)
    kept = issues.join(hit, KEYS, "left_anti")
    again = check(content.join(hit, KEYS, "left_semi"), lex, rules, table=new)
    return kept.select(*again.columns).unionByName(again)
