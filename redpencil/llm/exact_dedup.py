"""Exact duplicates: 128-bit content hash, then a comparison of the bytes inside each hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpencil.llm.common import ascii_lower, stored


def content_hash(text: Column) -> Column:
    """The 128-bit hash of a text, as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                 normalise: Callable[[Column], Column] = ascii_lower,
                 hash128: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Group equal texts and name the row of each group that stays.

    Equal: the same bytes after ``normalise``. ``keep`` is ``min`` or ``max``: the id that stays.
    Returns id, hash128, text_sha256, keep_id, group_size, kept; other columns of the input are
    not read, so clashing names do no harm.

    Rows meet by their hash; within a hash the text itself is a grouping key, so texts that only
    share the hash are told apart by their bytes. Copies are counted before the shuffle, so a
    group that holds a third of all rows reaches the network as one row per task.

    Defined cases: a null text counts as empty; all empty texts are one group; rows that repeat
    both id and text are one document (one output row, each copy counted in group_size); a null
    id is kept only where its group has no other id; an empty table gives an empty result.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    pick = F.min if keep == "min" else F.max
    norm = normalise(F.coalesce(F.col(text_col), F.lit("")))
    base = df.select(F.col(id_col).alias("id"), norm.alias("norm")).select(
        "id", "norm", hash128(F.col("norm")).alias("hash128"), F.sha2("norm", 256).alias("sha"))
    by_bytes = base.groupBy("hash128", "sha", "norm").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size"))
    # rows find their group by both digests, so the bytes need not travel a second time; two texts
    # that shared both would be ambiguous, and stop the job
    groups = stored(
        by_bytes.groupBy("hash128", "sha").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"),
                                               F.max("group_size").alias("group_size"))
        .withColumn("keep_id", F.when(F.col("texts") == 1, F.col("keep_id"))
                    .otherwise(F.raise_error(F.lit("two texts share both digests")).cast(df.schema[id_col].dataType)))
        .drop("texts"), "exact-groups")
    rows = base.select("id", "hash128", "sha").distinct()
    return rows.join(groups, ["hash128", "sha"]).select(
        F.col("id").alias(id_col), "hash128", F.col("sha").alias("text_sha256"), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows that stay, with all columns of the input: one row for each text.

    Rows that repeat both id and text leave one row, any of them.
    """
    groups = exact_groups(df, id_col, text_col, keep)
    names = df.columns
    kept = groups.where("kept").select(F.col(id_col).alias("__id"), F.col("hash128").alias("__hash"))
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.withColumn("__hash_of", content_hash(text))
    met = rows.join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__hash_of") == F.col("__hash")), "left_semi")
    return met.dropDuplicates([id_col, "__hash_of"]).select(*[F.col(f"`{c}`") for c in names])
