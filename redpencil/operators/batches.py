"""Budget batches over an order of any length (B14): chunks of rows, and pointer doubling over chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from redpencil.operators.groups import kept_rows

CHUNK = 4096  # rows of a group that one task walks through


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``place``: the row's number within its group, without passing a group through one task.

    The rows are range-partitioned by group and order and stored; a row's number is its place in its
    partition and the offset of the partition, less that of the group's first row.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    kept = kept_rows(sorted_.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at"), "ordered")
    parts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    placed = kept.join(F.broadcast(offsets), "_part").withColumn("_pos", F.col("_off") + F.col("_in"))
    first = placed.groupBy(group).agg(F.min("_pos").alias("_first")).withColumnRenamed(group, "_g")
    j = placed.join(first, placed[group].eqNullSafe(first["_g"]))
    return j.withColumn("place", F.col("_pos") - F.col("_first")).drop("_part", "_in", "_off", "_pos", "_first", "_g")


def _nexts(cost: np.ndarray, own: int, most: int, budget: int) -> np.ndarray:
    """Where the batch that starts at each of the first ``own`` rows ends."""
    total = np.concatenate([[0], np.cumsum(cost)])
    start = np.arange(own)
    full = np.searchsorted(total, total[:own] + budget, side="right") - 1  # the most rows within the budget
    return np.minimum(np.maximum(full, start + 1), start + most)


def budget_batches(rows: DataFrame, group: str, order: list[str], cost: str, most: int, budget: int) -> DataFrame:
    """``rows`` with ``batch_id``: consecutive rows of a group share a batch until ``most`` rows or ``budget`` cost.

    A batch takes at least one row, whatever it costs. A batch holds at most ``most`` rows, so the
    first batch that starts in a chunk of rows starts at one of its first ``most`` rows: a chunk is
    told by where each of these entries leaves it, and after how many batches. These tables are
    composed by doubling, so a group of n rows needs log(n / CHUNK) small joins and no task of its own.
    """
    placed = kept_rows(numbered(rows, group, order).withColumn("_c", (F.col("place") / CHUNK).cast("long")).withColumn(
        "_i", (F.col("place") % CHUNK).cast("int")).withColumn("_cost", F.col(cost).cast("long")), "placed")
    kind = placed.schema[group].dataType
    narrow = placed.select(F.col(group).alias("g"), F.col("_c").alias("c"), F.col("_i").alias("i"), F.col("_cost").alias("cost"))
    # a batch may run into the next chunk, so its first rows are seen by both
    ahead = narrow.where((F.col("i") < most) & (F.col("c") > 0)).select("g", (F.col("c") - 1).alias("c"), (F.col("i") + CHUNK).alias("i"), "cost")
    both = narrow.unionByName(ahead)
    table = T.StructType([T.StructField("g", kind), T.StructField("c", T.LongType()), T.StructField("leave", T.ArrayType(T.IntegerType())),
                          T.StructField("count", T.ArrayType(T.LongType()))])

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        own = int((pdf["i"] < CHUNK).sum())
        nxt = _nexts(pdf["cost"].to_numpy(np.int64), own, most, budget).tolist()
        leave, count = [0] * own, [0] * own
        for i in range(own - 1, -1, -1):
            leave[i], count[i] = (nxt[i] - CHUNK, 1) if nxt[i] >= own else (leave[nxt[i]], count[nxt[i]] + 1)
        take = min(own, most)
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "c": pdf["c"].iloc[:1], "leave": [[max(v, 0) for v in leave[:take]]], "count": [count[:take]]})

    one = kept_rows(both.groupBy("g", "c").applyInPandas(exits, table), "chunks")
    last = one.agg(F.max("c")).first()[0] or 0
    step = 1
    while step <= last:  # chunk c then stands for the chunks (c - step, c]
        back = one.select(F.col("g").alias("g0"), (F.col("c") + step).alias("c0"), F.col("leave").alias("leave0"), F.col("count").alias("count0"))
        j = one.join(back, one["g"].eqNullSafe(back["g0"]) & (F.col("c") == F.col("c0")), "left")
        then = "if(leave0 is null, leave, transform(leave0, e -> get(leave, e)))"
        more = "if(leave0 is null, count, transform(leave0, (e, k) -> get(count, e) + count0[k]))"
        one = kept_rows(j.select("g", "c", F.expr(then).alias("leave"), F.expr(more).alias("count")), "chunks")
        step *= 2
    entry = one.select("g", (F.col("c") + 1).alias("c"), F.expr("leave[0]").alias("entry"), F.expr("count[0]").alias("base"))
    marked = T.StructType([*placed.schema.fields, T.StructField("batch_id", T.LongType())])
    e = entry.select(F.col("g").alias("_g"), F.col("c").alias("_gc"), "entry", "base")
    # the entry of its chunk rides on every row; the rows that the next chunk lends only end batches
    lent = placed.where((F.col("_i") < most) & (F.col("_c") > 0)).withColumn("_c", F.col("_c") - 1).withColumn("_i", F.col("_i") + CHUNK)
    wide = placed.unionByName(lent)
    j = wide.join(e, wide[group].eqNullSafe(e["_g"]) & (F.col("_c") == F.col("_gc")), "left").withColumn("_entry", F.coalesce("entry", F.lit(0))).withColumn(
        "_base", F.coalesce("base", F.lit(0))).drop("_g", "_gc", "entry", "base")

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        own = int((pdf["_i"] < CHUNK).sum())
        nxt = _nexts(pdf["_cost"].to_numpy(np.int64), own, most, budget).tolist()
        at, batch = int(pdf["_entry"].iloc[0]), int(pdf["_base"].iloc[0])
        ids = np.full(own, batch - 1, np.int64)  # rows before the entry end a batch of the chunk before
        while at < own:
            ids[at:nxt[at]] = batch
            at, batch = nxt[at], batch + 1
        return pdf.iloc[:own].drop(columns=["_entry", "_base"]).assign(batch_id=ids)

    out = j.groupBy(group, "_c").applyInPandas(mark, marked)
    return out.drop("_c", "_i", "_cost", "place")
