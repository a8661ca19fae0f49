"""Results by key, kept across runs (J21): what is known is read, what is missing is computed once and added."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ResultCache:
    """Parquet below ``path``, in buckets of the key. A fill appends one folder when its results are complete."""

    def __init__(self, spark: SparkSession, path: str, result: T.StructType, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.result = [f for f in result if f.name != "key"]
        self.schema = T.StructType([T.StructField("key", T.StringType()), *self.result,
                                    T.StructField("fill", T.StringType()), T.StructField("bucket", T.IntegerType())])

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        """All rows; fills that ran at the same time may both hold a key."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def fill(self, work: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``work`` with the results of its keys; ``compute`` sees one row for each key that is not known yet.

        ``work`` carries ``key``; ``compute`` returns key and the result columns. A result whose columns
        are all null is no result: it is not kept, and its key is computed again next time.
        """
        names = [f.name for f in self.result]
        keyed = work.withColumn("bucket", self._bucket())
        misses = keyed.dropDuplicates(["key"]).join(self.read().select("bucket", "key"), ["bucket", "key"], "left_anti").drop("bucket")
        found = compute(misses.where("key is not null")).select("key", *names)
        found = found.where(F.exists(F.array(*[F.col(f"`{n}`").isNotNull() for n in names]), lambda x: x))
        name = uuid.uuid4().hex
        # each bucket goes to a few tasks, so a fill makes few files; the folder appears when all are written
        found.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/fill={name}")
        known = self.read().select("bucket", "key", F.struct(*names, "fill").alias("r")).groupBy("bucket", "key").agg(F.min_by("r", "r.fill").alias("r"))
        return keyed.join(known, ["bucket", "key"], "left").select(*work.columns, *[F.col(f"r.{n}").alias(n) for n in names])
