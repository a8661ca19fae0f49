"""Pieces the operators of this subpackage share: shared scratch tables and text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from string import ascii_lowercase, ascii_uppercase
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    import pyarrow as pa


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only a local session without that setting (tests) gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows once to the shared folder and read them back.

    A lost executor costs at most the tasks it was running, since every later
    step starts from the files.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_rows(batches: Iterable[list[dict]], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Lists of rows as Arrow batches of a Spark schema; a key that a row lacks is null."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    for rows in batches:
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)


def by_bytes(batches: Iterable[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices of about ``limit`` bytes at most; a longer row is a slice of its own."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        end, at = np.cumsum(size), 0
        while at < batch.num_rows:
            before = end[at] - size[at]
            stop = max(at + 1, int(np.searchsorted(end, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


BATCH_ROWS = 256
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Jobs that run in this block send their rows to Python in batches of few rows.

    A batch of whole texts is held by the executor and by its worker, 10,000 rows of them at a time by default.
    """
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows if int(before) <= 0 else min(int(before), rows)))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def fold(column: Column) -> Column:
    """CRC-32 of an id written as text, which deals rows into training and held-out folds."""
    return F.crc32(column.cast("string").cast("binary"))
