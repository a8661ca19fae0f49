"""Quartile bucket digests: hashed byte triplets, the quartile of each bucket's count, and the length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from redpencil.llm.common import arrow_rows, by_bytes, stored

BUCKETS = 256
_SKIPS = ((1, 2), (1, 3), (2, 3))  # the other two bytes of a triplet, counted from its first
# A pair of quartiles scores its distance, and a jump from end to end scores double; unrelated texts
# of one language come to about 0.9 a bucket, where likeness ends
_STEP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.int64)
_WORST = 0.9 * BUCKETS
_LENGTH_STEP = 4  # score of one step of the length code


def counts(data: bytes) -> np.ndarray:
    """How many triplets of nearby bytes fall into each bucket."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    total = np.zeros(BUCKETS, np.int64)
    for k, (i, j) in enumerate(_SKIPS):
        if len(b) > j:
            n = len(b) - j
            h = b[:n] * np.uint32(0x9E3779B1) + b[i:i + n] * np.uint32(0x85EBCA77) + b[j:] * np.uint32(0xC2B2AE3D)
            h += np.uint32(0x27D4EB2F * (k + 1) & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            total += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return total


def length_code(n: int) -> int:
    """The length on a scale of tenths: a step of the code is a tenth of the length."""
    return min(255, round(np.log1p(n) / np.log(1.1)))


def digest(data: bytes) -> str:
    """Length code and the quartile (0 to 3) of each bucket, two bits each, as hex."""
    c = counts(data)
    cuts = np.partition(c, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1])[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    q = (c[:, None] > cuts).sum(1).astype(np.uint8).reshape(-1, 4)
    packed = (q << np.array([6, 4, 2, 0], np.uint8)).sum(1, dtype=np.uint8)
    return f"{length_code(len(data)):02x}{packed.tobytes().hex()}"


def difference(a: str, b: str) -> int:
    """Sum of the quartile steps and of the length steps; 0 for equal digests."""
    x, y = (np.frombuffer(bytes.fromhex(d), np.uint8) for d in (a, b))
    u, v = ((z[1:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3 for z in (x, y))
    return int(_STEP[u, v].sum()) + _LENGTH_STEP * max(0, abs(int(x[0]) - int(y[0])) - 1)


def likeness(a: str, b: str) -> float:
    """The difference, bounded and turned: 1 for equal digests, 0 from unrelated texts on."""
    return max(0.0, 1.0 - difference(a, b) / _WORST)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and digest of each row's whole text (UTF-8); null counts as empty."""
    @F.pandas_udf(T.StringType())
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: digest(t.encode()))
    return df.select(F.col(id_col), of(F.coalesce(F.col(text_col), F.lit(""))).alias("fingerprint"))


def _edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def _judged(key, text: str, mine: str, following: str, theirs: str) -> dict:
    edited = _edited(text, following).encode()
    changed = digest(edited)
    return {"id": key, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited).hexdigest(), "fingerprint": mine,
            "edited_fingerprint": changed, "near_edited": likeness(mine, changed), "near_next": likeness(mine, theirs)}


def edit_trial(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Fingerprint each text, an edited form of it and its neighbour, and score the likeness.

    The edited form replaces the last quarter of the code points by the start of the next
    document in id order (after the last comes the first). Returns id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    Whole texts travel once, range-partitioned by id; inside a partition each row meets its
    follower as they stream by. Only the last row of a partition waits for the first one of the
    next: two texts a partition, joined by the partition's number.

    Defined cases: a null text is empty; a null id comes first; rows that repeat an id follow each
    other in the order of a hash of their texts; a single row follows itself; an empty table
    gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[id_col].dataType
    out = [T.StructField("id", kind), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
           T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
           T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
    names = [f.name for f in out]
    edge = [T.StructField("edge", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType())]
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "tie", F.xxhash64("text"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def made() -> Iterator[list[dict]]:
            last = None
            for batch in by_bytes(batches):
                some = []
                for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    mine = digest(text.encode())
                    some.append({"id": key, "edge": "first", "part": part, "text": text, "fingerprint": mine}
                                if last is None else _judged(*last, text, mine))
                    last = (key, text, mine)
                yield some
            if last is not None:
                yield [{"id": last[0], "edge": "last", "part": part, "text": last[1], "fingerprint": last[2]}]
        return arrow_rows(made(), T.StructType(out + edge))

    # the stored rows are digests, and two texts for each partition
    dealt = rows.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    kept = stored(dealt.mapInArrow(stream, T.StructType(out + edge)), "fingerprints")
    firsts = kept.where("edge = 'first'")
    order = Window.orderBy("part")  # one row for each partition
    before = F.coalesce(F.lag("part").over(order), F.max("part").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    turn = firsts.select("part", before.alias("before"))
    follow = firsts.join(turn, "part").select("before", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mine"))
    ends = kept.where("edge = 'last'").join(follow, F.col("part") == F.col("before")).select(
        "id", "text", "fingerprint", "next_text", "next_mine")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow_rows(([_judged(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)] for batch in by_bytes(batches)),
                          T.StructType(out))

    done = kept.where("edge is null").select(*names).unionByName(ends.mapInArrow(finish, T.StructType(out)))
    return done.withColumnRenamed("id", id_col)
